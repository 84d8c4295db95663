"""City, state and postal code out of a one-line address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: `..., City, ST 12345[-6789]` and `..., City, ST` at the end of the text ---
CITY_STATE_ZIP = r"(?i)(?:^|,\s*)([A-Za-z\s]+?)\s*,\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)\s*$"
CITY_STATE = r"(?i)(?:^|,\s*)([A-Za-z\s]+?)\s*,\s*([A-Z]{2})\s*$"


def parse_address(c: Column) -> Column:
    """struct(city, state, postal_code); all null where neither pattern matches."""
    s = F.trim(c)

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(s, pattern, group)
        return F.nullif(F.trim(found), F.lit(""))

    return F.struct(
        F.coalesce(part(CITY_STATE_ZIP, 1), part(CITY_STATE, 1)).alias("city"),
        F.upper(F.coalesce(part(CITY_STATE_ZIP, 2), part(CITY_STATE, 2))).alias("state"),
        part(CITY_STATE_ZIP, 3).alias("postal_code"),
    )


def split_address(c: Column) -> Column:
    """struct(city, state, postal_code) by comma position: `street, city, ST zip`."""
    parts = F.split(c, ",", 3)
    tail = F.get(parts, F.lit(2))
    return F.struct(
        F.get(parts, F.lit(1)).alias("city"),
        F.substring(tail, 2, 2).alias("state"),
        F.substring(tail, 5, 20).alias("postal_code"),
    )
