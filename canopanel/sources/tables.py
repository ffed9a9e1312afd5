"""Open and write the tables of a study."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.schema import nan_to_null, params_schema, require_columns


def open_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Iterable[str] | None = None,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Open one or many files (globs allowed) as one table; ``KeyError`` on a missing column.

    Files are concatenated by column name; their order does not matter because time is a
    column.  NaN becomes NULL.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    table = reader.load([paths] if isinstance(paths, str) else list(paths))
    if columns is not None:
        columns = list(columns)
        table = require_columns(table, columns).select(*columns)
    return nan_to_null(table)


def read_params_csv(
    spark: SparkSession, path: str, names: Iterable[str], member_type: T.DataType | None = None
) -> DataFrame:
    """Parameter table: one CSV row per member.  The header must match ``names``."""
    schema = params_schema(names, member_type)
    return nan_to_null(
        spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST"))


def time_from_file_name(table: DataFrame, step: str = "step", steps_per_file: int = 12) -> DataFrame:
    """Replace the step number 0..11 of yearly files ``<stem>_YYYY`` by month starts.

    A year is a file ``obs_2000.parquet`` or a folder ``obs_2000`` of part files.  Each must
    hold exactly the steps 0 .. ``steps_per_file`` - 1, otherwise this raises.  ``table``
    must come straight from a file scan.
    """
    stem = r".*/([^/]*_(\d{4}))(?:/|\.[^/]*$)"
    path = F.col("_metadata.file_path")
    named = table.withColumns({
        "_stem": F.regexp_extract(path, stem, 1), "_year": F.regexp_extract(path, stem, 2)})
    bad = named.groupBy("_stem").agg(
        F.count_distinct(step).alias("steps"), F.min(step).alias("first"), F.max(step).alias("last")
    ).where(
        (F.col("_stem") == "") | (F.col("steps") != steps_per_file) | (F.col("first") != 0)
        | (F.col("last") != steps_per_file - 1)
    ).limit(5).collect()
    if bad:
        raise ValueError(f"files without {steps_per_file} steps or a year in their name: "
                         f"{sorted((r['_stem'], r['steps']) for r in bad)}")
    return named.withColumn(
        "time", F.make_date(F.col("_year").cast("int"), F.col(step) + 1, F.lit(1))
    ).drop("_stem", "_year", step)


def read_yearly_files(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                      step: str = "step", fmt: str = "parquet") -> DataFrame:
    """Observed yearly files, concatenated along time."""
    reader = spark.read.format(fmt).schema(schema)
    table = reader.load([paths] if isinstance(paths, str) else list(paths))
    return nan_to_null(time_from_file_name(table, step))


def write_table(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    table.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_split(samples: DataFrame, path: str, split: str = "split") -> None:
    """Write the train and validation subsets as partitions of one table."""
    write_table(require_columns(samples, [split]).where(F.col(split).isNotNull()), path, [split])


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
