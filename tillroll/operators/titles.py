"""Volume and unit extracted from product titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two patterns (first digit run; first unit token).
VOLUME_PATTERN = r"(\d+)\s?"
UNIT_PATTERN = r"(ml|oz|fl\.oz|g|cm|inch|mm|gallons)"


# The unit right behind the first number, in any case, and no part of a word.
STRICT_UNIT_PATTERN = r"^\D*\d+\s?((?i:ml|fl\.oz|oz|g|cm|inch|mm|gallons))(?![A-Za-z])"


def title_volume_unit(titles: DataFrame, attributes: DataFrame, category: str, *, strict: bool = False) -> DataFrame:
    """product_id, product_title, volume (first number, NULL if none or too
    large), volume_unit (first unit token, lower-cased; case-sensitive and
    unanchored as in the reference, so any 'g' in a word matches).

    ``strict``: the unit must follow the first number and end there, in any
    case ("5 gallons" is gallons, "Strong 8fl.oz" is fl.oz).

    ``attributes`` may hold a product more than once: it only says which ids
    are in the category, so titles are not multiplied.

    Both regexes are JVM built-ins evaluated in one projection; an empty
    match (no match) becomes NULL.
    """
    t = titles.join(attributes.filter(F.col("category") == category).select("product_id"), "product_id", "left_semi")
    raw = F.nullif(F.regexp_extract("product_title", VOLUME_PATTERN, 1), F.lit(""))
    pattern = STRICT_UNIT_PATTERN if strict else UNIT_PATTERN
    unit = F.lower(F.nullif(F.regexp_extract("product_title", pattern, 1), F.lit("")))
    return t.select(
        "product_id",
        "product_title",
        raw.try_cast("bigint").alias("volume"),
        unit.alias("volume_unit"),
    ).distinct()
