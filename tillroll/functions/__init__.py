from tillroll.functions.filters import valid_line, valid_lines
from tillroll.functions.windows import Window

__all__ = ["Window", "valid_line", "valid_lines"]
