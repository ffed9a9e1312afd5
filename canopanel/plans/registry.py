"""Registration of queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named views."""
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return f
    return register


# Half a unit plus a small shift.  Means of decimals often end in an exact 5, where the last
# bit would decide; the shift moves that edge away from them.
_HALF = 0.500137


def rounded(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Round every double column, so that the order of summation cannot show.

    Plain arithmetic, which both engines carry out bit by bit alike.
    """
    def one(name: str):
        scale = float(f"1e{columns.get(name, digits)}")
        return (F.floor(F.col(name) * scale + _HALF) / scale).alias(name)

    return df.select(*[
        one(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def r(expression: str, digits: int = 6) -> str:
    """The oracle's side of :func:`rounded`."""
    return f"CAST(floor(({expression}) * 1e{digits} + {_HALF}::DOUBLE) AS BIGINT) / 1e{digits}"
