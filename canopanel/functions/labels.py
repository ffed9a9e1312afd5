"""Member labels and longitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_id(label: Column) -> Column:
    """Integer id from the digits of a label (``LHC0042`` -> 42); raises when it has none."""
    digits = F.regexp_replace(label.cast("string"), "[^0-9]", "")
    return F.when(label.isNull(), F.lit(None).cast("long")).when(
        digits != "", digits.cast("long")
    ).otherwise(
        F.raise_error(F.concat(F.lit("no digits in member label: "), label.cast("string"))).cast("long")
    )


def longitude_360(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))
