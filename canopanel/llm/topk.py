"""Exact top-k search by distributed histogram selection over integer inner products.

Queries and candidates are dealt into blocks; each pair of blocks is one group in which numpy
multiplies two matrices.  Passes over all scores narrow, for every query at once, the range
that holds its k-th score: a global histogram of the current range gives the bin, which is the
next range, until a bin is one value.  A last pass returns scores above that value and, of the
scores equal to it, the smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import column

BIN_BITS = 10
# Candidates are copied for each block of queries and queries for each block of candidates; there are
# far fewer queries, so their blocks are the larger ones.
QUERY_BLOCK = 1 << 14
CANDIDATE_BLOCK = 8192
_SLICE = 128  # queries scored at once in a group


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of every component, of rows that take part in a search.

    Rows take no part whose id or vector is null or whose vector holds a null or a value that
    is not finite.
    """
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.select(column(id_col).alias("id"), column(vec_col).alias(vec_col)).where(
        F.col("id").isNotNull() & F.col(vec_col).isNotNull() & sound).select(
        "id", F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones end in zeros."""
    column = column.combine_chunks()
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point as long as every partial sum is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    if bound < 2**63:
        return queries @ candidates.T
    raise OverflowError("an inner product may not fit 64 bits")


def _slices(queries, candidates, width: int):
    """(positions of queries, their scores, whether a candidate counts), a few queries at a time."""
    q, c = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
    q_ids, c_ids = queries.column("id").to_numpy(), candidates.column("id").to_numpy()
    for at in range(0, len(q), _SLICE):
        here = slice(at, min(at + _SLICE, len(q)))
        yield here, _scores(q[here], c), q_ids[here, None] != c_ids[None, :]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to smaller ids.

    Both tables are (id, v) as :func:`quantised` makes them.  A row with the query's id is its
    own and no candidate; a query with fewer candidates than k returns them all.  Repeated rows
    are candidates each; of queries with one id the smallest vector asks.  Vectors of different
    lengths are compared as if the shorter ended in zeros.  Without vectors or queries there
    are no rows.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = stored(vectors, "topk-vectors")
    queries = stored(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
    width = max(sizes["width"] or 0, asked["width"] or 0)
    reach = int(math.sqrt((sizes["norm"] or 0.0) * (asked["norm"] or 0.0)) * (1 + 1e-9)) + 1
    n_query_blocks = math.ceil(asked["n"] / QUERY_BLOCK) or 1
    n_blocks = math.ceil(sizes["n"] / CANDIDATE_BLOCK) or 1

    def cells(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Rows in their block, once for each block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def each_pair(state: DataFrame, work, schema: str) -> DataFrame:
        left = cells(state, "qb", n_query_blocks, "cb", n_blocks).groupBy("qb", "cb")
        right = cells(vectors, "cb", n_blocks, "qb", n_query_blocks).groupBy("qb", "cb")
        return left.cogroup(right).applyInArrow(work, schema)

    def counted(shift: int):
        def work(left, right):
            import pyarrow as pa

            ids, bins, counts = [], [], []
            low, q_ids = left.column("low").to_numpy(), left.column("id").to_numpy()
            need = left.column("need").to_numpy()
            for here, scores, counts_here in _slices(left, right, width):
                at = (scores - low[here, None]) >> shift
                inside = counts_here & (at >= 0) & (at < 1 << BIN_BITS)
                row = np.nonzero(inside)[0]
                found = np.bincount((row << BIN_BITS) + at[inside], minlength=len(at) << BIN_BITS)
                found = found.reshape(len(at), -1)[:, ::-1]
                # The k-th score of all is no lower than the k-th here: bins further down are not needed.
                above = np.cumsum(found, axis=1) - found
                i, b = np.nonzero((found > 0) & (above < need[here, None]))
                ids.append(q_ids[here][i])
                bins.append((1 << BIN_BITS) - 1 - b)
                counts.append(found[i, b])
            arrays = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ids, bins, counts)]
            return pa.table([pa.array(a.astype(np.int64)) for a in arrays], names=["id", "bin", "n"])

        return work

    def chosen(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        low, need, q_ids = (left.column(x).to_numpy() for x in ("low", "need", "id"))
        c_ids = right.column("id").to_numpy()
        order = np.argsort(c_ids, kind="stable")
        for here, scores, counts_here in _slices(left, right, width):
            scores, counts_here = scores[:, order], counts_here[:, order]
            equal = counts_here & (scores == low[here, None])
            equal &= np.cumsum(equal, axis=1) <= need[here, None]
            i, j = np.nonzero(equal | (counts_here & (scores > low[here, None])))
            for values, value in zip(out, (q_ids[here][i], c_ids[order][j], scores[i, j])):
                values.append(value)
        arrays = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]
        return pa.table([pa.array(a.astype(np.int64)) for a in arrays], names=["query_id", "vec_id", "score"])

    # Every score lies in [-reach, reach]; low is the least value of the range still open and
    # need how many of the k are not above that range.
    passes = max(1, math.ceil((2 * reach + 1).bit_length() / BIN_BITS))
    state = queries.withColumns({"low": F.lit(-reach).cast("long"), "need": F.lit(k).cast("long")})
    for i in reversed(range(passes)):
        shift = i * BIN_BITS
        bins = each_pair(state, counted(shift), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        bins = bins.withColumn("above", F.sum("n").over(down) - F.col("n"))
        ends = bins.join(state.select("id", "need"), "id").where("above < need").groupBy("id").agg(
            F.min("bin").alias("bin"), F.max("above").alias("above"), F.first("need").alias("had"))
        state = stored(state.join(ends, "id", "left").select(
            "id", "v", (F.col("low") + F.coalesce("bin", F.lit(0)) * F.lit(1 << shift)).alias("low"),
            (F.col("need") - F.coalesce("above", F.lit(0))).alias("need")), "topk-state")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = each_pair(state, chosen, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
