"""Leakage-free train/validation splits and slices of the year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopanel.functions.calendar import in_period, season
from canopanel.functions.labels import member_id
from canopanel.operators.ranking import axis_index
from canopanel.schema import require_columns


def split_members(table: DataFrame, n_train: int, n_val: int, member: str = "member",
                  strict: bool = False) -> DataFrame:
    """(member, member_split): the first ``n_train`` sorted members train, the next ``n_val`` validate.

    More members asked for than exist raises; ``strict`` also raises when some are left over.
    """
    require_columns(table, [member])
    index = axis_index(table, member, "_i")
    found = index.count()
    if n_train + n_val > found or (strict and n_train + n_val != found):
        raise ValueError(f"{n_train} + {n_val} members asked for, {found} found")
    return index.select(member, F.when(F.col("_i") < n_train, F.lit("train"))
                        .when(F.col("_i") < n_train + n_val, F.lit("val")).alias("member_split"))


def year_split(time, val_years: tuple[int, int]):
    """``val`` for the validation years, both inclusive; ``train`` for all others."""
    first, last = val_years
    if last < first:
        raise ValueError("val_years must be (first, last) with first <= last")
    return F.when(F.year(time).between(first, last), F.lit("val")).when(time.isNotNull(), F.lit("train"))


def split_member_time(samples: DataFrame, members: DataFrame, val_years: tuple[int, int],
                      member: str = "member", time: str = "time", out: str = "split") -> DataFrame:
    """``train`` = train member in a train year, ``val`` = validation member in a validation year.

    The other two blocks (train members in validation years and the reverse) and members
    in neither list get NULL.  ``members`` is the result of :func:`split_members`.
    """
    require_columns(samples, [member, time])
    years = year_split(F.col(time), val_years)
    return (samples.join(members, member, "left")
            .withColumn(out, F.when(F.col("member_split") == years, years)).drop("member_split"))


def split_masks(samples: DataFrame, members: DataFrame, val_years: tuple[int, int],
                member: str = "member", time: str = "time") -> DataFrame:
    """Boolean ``train_mask`` and ``val_mask`` per sample.

    Members may be integers or labels such as ``LHC0042``: both sides are compared by id.
    """
    ids = members.select(member_id(F.col(member)).alias("_id"), F.col("member_split").alias("_split"))
    keyed = samples.withColumn("_id", member_id(F.col(member)))
    years = year_split(F.col(time), val_years)
    both = keyed.join(ids, "_id", "left").withColumn(
        "_s", F.when(F.col("_split") == years, years))
    return both.withColumns({
        "train_mask": F.coalesce(F.col("_s") == "train", F.lit(False)),
        "val_mask": F.coalesce(F.col("_s") == "val", F.lit(False)),
    }).drop("_id", "_split", "_s")


def split_periods(table: DataFrame, train: tuple[str, str], val: tuple[str, str],
                  time: str = "time") -> DataFrame:
    """Chronological split by two periods: ``in_train``, ``in_val`` and ``overlap`` flags.

    The periods may share rows, which then leak; ``overlap`` marks them.
    """
    t, v = in_period(F.col(time), *train), in_period(F.col(time), *val)
    return table.where(t | v).withColumns({"in_train": t, "in_val": v, "overlap": t & v})


def split_artifacts(samples: DataFrame, members: DataFrame, split: str = "split",
                    member: str = "member", time: str = "time", sample_id: str | None = None) -> DataFrame:
    """What a run must remember of its split, as (kind, value) rows.

    Kinds: ``train_member``, ``val_member``, ``train_year``, ``val_year``, ``n_train``,
    ``n_val``, and with ``sample_id`` one ``train_index`` or ``val_index`` row per sample.
    """
    lists = members.where("member_split IS NOT NULL").select(
        F.concat("member_split", F.lit("_member")).alias("kind"), F.col(member).cast("long").alias("value"))
    used = samples.where(F.col(split).isNotNull())
    counts = used.groupBy(split, F.year(time).alias("_year")).agg(F.count("*").alias("_n"))
    years = counts.select(F.concat(split, F.lit("_year")).alias("kind"), F.col("_year").cast("long").alias("value"))
    sizes = counts.groupBy(F.concat(F.lit("n_"), F.col(split)).alias("kind")).agg(
        F.sum("_n").alias("value"))
    result = lists.unionByName(years).unionByName(sizes)
    if sample_id is None:
        return result
    return result.unionByName(used.select(
        F.concat(split, F.lit("_index")).alias("kind"), F.col(sample_id).cast("long").alias("value")))


def split_coverage(samples: DataFrame, split: str = "split", time: str = "time") -> DataFrame:
    """First, last and number of distinct years per split."""
    return (samples.where(F.col(split).isNotNull())
            .groupBy(split, F.year(time).alias("_year")).agg(F.count("*").alias("_n"))
            .groupBy(split).agg(
                F.min("_year").alias("first_year"), F.max("_year").alias("last_year"),
                F.count("*").alias("n_years"), F.sum("_n").alias("n_samples")))


def check_split_inputs(x: DataFrame, y: DataFrame, n_train: int, n_val: int,
                       val_years: tuple[int, int], keys: Sequence[str] = ("member", "time")) -> None:
    """Raise before any fit when the split cannot be made."""
    for name, table in (("features", x), ("target", y)):
        missing = [k for k in keys if k not in table.columns]
        if missing:
            raise ValueError(f"{name} lack the columns {missing}")
    if val_years[1] < val_years[0]:
        raise ValueError("val_years must be (first, last) with first <= last")
    found = x.select(keys[0]).distinct().count()
    if n_train + n_val > found:
        raise ValueError(f"{n_train} + {n_val} members asked for, {found} found")


def with_month_slice(table: DataFrame, time: str = "time") -> DataFrame:
    return table.withColumn("slice", F.month(time))


def with_season_slice(table: DataFrame, time: str = "time") -> DataFrame:
    return table.withColumn("slice", season(F.month(time)))
