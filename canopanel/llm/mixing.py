"""Mixing sources to target weights by Poisson replication.

A source with target share ``w`` of ``B`` characters, of which it has ``c``, needs each of its
documents ``w * B / c`` times on average.  A document's count is the inverse Poisson
distribution at a hash of its id, so every run, retry and cluster draws the same counts.  Each
copy then goes to a place of the output that a second hash decides.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import column, fresh, whole_text

# A large mean is drawn as the sum of parts of at most this mean, each of its own hash.
PART_MEAN = 8.0
# Terms of one part's distribution; beyond them 2^-52 cannot be exceeded any more.
TERMS = 60


def uniform(*of: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the values, null and text told apart."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in of])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """The Poisson distribution function of ``mean`` at 0, 1, ..., TERMS - 1, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5,
                 epochs: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, chars, rate, parts, distribution): how often a document of a source is wanted.

    ``weights`` gives each source's target share (relative; a source not named has 0).  Without
    it shares are the sources' characters to the power ``temperature``.  The mixture has
    ``epochs`` times the characters of the input.  A source without characters cannot reach a
    share and has rate 1 if its weight is over 0.  Null is a source of its own, which weights
    name as None.
    """
    sizes = docs.select(column(source_col).alias("source"), F.length(whole_text(text_col)).cast("long").alias("n"))
    sizes = sizes.groupBy("source").agg(F.sum("n").alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
            raise ValueError("weights must be finite, not negative and not all 0")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    # Sources without characters take no share from the others.
    sizes = stored(sizes.withColumn("weight", weight), "mix-sizes")
    totals = sizes.where("chars > 0").agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight")).first()
    all_chars, all_weight = float(totals["all_chars"] or 0), float(totals["all_weight"] or 0)
    share = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_chars * epochs)
    rate = F.when(F.col("chars") > 0, share / F.col("chars")).otherwise((F.col("weight") > 0).cast("double"))
    if weights is None:
        rate = F.when(F.col("chars") > 0, rate).otherwise(F.lit(1.0))
    rated = sizes.withColumn("rate", rate).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    return rated.withColumn("distribution", _distribution(F.col("rate") / F.col("parts")))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5,
                epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", replica_col: str = "replica", key_col: str = "shuffle_key") -> DataFrame:
    """Every document as often as its Poisson count says, globally shuffled.

    Adds ``replica`` (1, 2, ...; a document of count 0 has no row) and ``shuffle_key``, a hash
    of (seed, id, replica): rows are dealt to partitions by it and sorted within them.  Rows
    repeated with one id have the same count each; a row without id is drawn and dealt by its text.
    A very long text is read for its length only and moved once for each copy.  Columns of
    ``docs`` called replica or shuffle_key are kept; the new ones then get a longer name.  Null texts have
    no characters.  An empty table gives an empty one.
    """
    rates = stored(
        source_rates(docs, weights, temperature, epochs, text_col, source_col)
        .where("rate > 0").select("source", "parts", "distribution"), "mix-rates")
    src, parts, dist = fresh(docs, "_source", "_parts", "_distribution")
    replica, key = fresh(docs, replica_col, key_col)
    rates = rates.withColumnsRenamed({"source": src, "parts": parts, "distribution": dist})
    # A row without id goes by its text.
    name = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("~"), F.md5(whole_text(text_col))))
    # One hash for each part, then its place in the distribution.
    drawn = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(seed), name, j))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter(dist, lambda t: t <= u)))
    # Documents of a rare source may be wanted very often: parts are summed per document,
    # and the copies are made row by row before the shuffle.
    copies = (
        docs.join(rates, column(source_col).eqNullSafe(F.col(src)))
        .withColumn(replica, F.explode(F.sequence(F.lit(0), count)))
        .where(F.col(replica) > 0))
    copies = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(f"{seed} place"), name, F.col(replica).cast("string"))))
    return copies.select(*[column(c) for c in docs.columns], replica, key).repartition(F.col(key)).sortWithinPartitions(key)
