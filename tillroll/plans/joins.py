"""Joins of inputs that grow with the tables.

Spark sizes a join input before it runs by the bytes of the files under it and
the widths of its columns.  It does not see that an explode or a map multiplies
rows, that files are compressed, or that a hash table takes several times its
rows; an input of tens of millions of rows may be sized below
``autoBroadcastJoinThreshold`` and is then collected on the driver.  A join with
``by_shuffle`` stays a sort-merge join, whose skewed partitions Spark splits;
the driver sees none of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as an input of a join that broadcasts neither side."""
    return df.hint("merge")
