from tillroll.sources.tables import RAW_TABLES, read_table

__all__ = ["RAW_TABLES", "read_table"]
