"""N-gram Jaccard join by chosen paths: all links of similarity 0.8 or more between shingle sets.

Documents with one set are collapsed first.  In each run every set picks, with shared
randomness, about 1 / threshold of its shingles; a picked shingle is a child node, and two sets
of the wanted similarity share at least one child on average.  A node of one set is given up,
a small one is compared by brute force, a large one is split again on further shared shingles.
Runs are repeated until any link is met with the target recall.  Nodes still large at the
greatest depth are compared whole, in blocks.  Before shingles are fetched, the 32 smallest of
each set give an estimate that rules out pairs five standard deviations below the threshold.

A pair is looked at only in the first node its two sets share, so links are counted once
without a list of pairs: a comparison returns, per set, the number of documents linked and one
edge of a spanning forest.  Work and rows are linear in the members of nodes; a class of
thousands of near copies costs matrix products inside tasks, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import bounded_batches, column, fresh, in_slots, whole_text
from canopanel.llm.shingles import WORDS, mix, sets_of

THRESHOLD = 0.8
RECALL = 0.9999  # of a link at the threshold whose sets share large nodes all the way down
SMALL = 48  # sets of a node that are compared at once
BLOCK = 1000  # sets of a block of a node that never became small
_STEP = 1 << 15
SKETCH = 32  # smallest shingles of a set, by which most pairs are ruled out
DEPTHS = (1, 3)  # where nodes are counted; the last is the greatest depth


def runs_for(recall: float, depth: int) -> int:
    """Runs needed: the chance of a shared path is that of a critical Poisson branching process."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _limit(size: int, threshold: float) -> np.uint64:
    """A hash under this picks a shingle of a set: 1 / threshold of them on average."""
    return np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * max(size, 1)))))


def _children(tokens: np.ndarray, node: np.uint64, limit: np.uint64) -> np.ndarray:
    """The child nodes of a set below ``node``: one for each shingle it picks there."""
    salt = mix(np.array([node, node + np.uint64(1)], dtype=np.uint64))
    drawn = (tokens ^ salt[0]) * (salt[1] | np.uint64(1))
    return mix(tokens[drawn < limit] ^ salt[1])


def _sids(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    b = mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signed(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray], kind):
    """An Arrow list column of numpy arrays."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _text_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("t"), whole_text(text_col).alias("text"))


def _members(docs: DataFrame, threshold: float, runs: int, seed: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, s1, s2, size, sketch, paths): each row's set, and the nodes of depth 1 it picks in all runs."""
    def made(batches):
        import pyarrow as pa

        seeds = _seeds(runs, seed)
        for batch in batches:
            s1, s2, sizes, sketches, paths = [], [], [], [], []
            for tokens in sets_of(batch.column("text"), words):
                a, b = _sids(tokens)
                limit = _limit(len(tokens), threshold)
                picked = []
                for at in range(0, len(tokens), _STEP):  # a long text's draws are never held at once
                    part = tokens[at:at + _STEP]
                    drawn = (part[None, :] ^ seeds[:runs, None]) * (seeds[runs:, None] | np.uint64(1))
                    run, which = np.nonzero(drawn < limit)
                    picked.append(_signed(mix(part[which] ^ seeds[run])))
                s1.append(a)
                s2.append(b)
                sizes.append(len(tokens))
                sketches.append((tokens[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                paths.append(np.unique(np.concatenate(picked)) if picked else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(sizes, pa.int64()), _lists(sketches, np.int32), _lists(paths, np.int64)],
                names=["id", "t", "s1", "s2", "size", "sketch", "paths"])

    rows = _text_key(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(made, f"id {kind}, t long, s1 long, s2 long, size long, sketch array<int>, paths array<long>")


def _texts_of(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``sets`` (rep, ...) with the text of the document that represents each."""
    key = F.xxhash64("id", "t")
    wanted = sets.select(F.col("rep.id").alias("rep_id"), F.col("rep.t").alias("rep_t"), *[c for c in sets.columns if c != "rep"])
    near = in_slots(_text_key(docs, id_col, text_col), key, wanted, F.xxhash64("rep_id", "rep_t"), "met").where("met")
    return near.join(wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("t") == F.col("rep_t"))).drop("rep_id", "rep_t", "id", "t", "met")


def _deeper(docs: DataFrame, large: DataFrame, sets: DataFrame, depths, threshold: float, words: int,
            id_col: str, text_col: str) -> DataFrame:
    """(s1, s2, nodes): for the nodes of depth 1 that are large, all nodes below, by counted depth.

    ``nodes`` are structs (depth, node, parent): the parent is the node at the counted depth above.
    """
    own = large.groupBy("s1", "s2").agg(F.collect_set("node").alias("large")).join(
        sets.select("s1", "s2", "rep"), ["s1", "s2"])
    counted = list(depths[1:])

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, tokens in enumerate(sets_of(batch.column("text"), words)):
                limit = _limit(len(tokens), threshold)
                s1, s2 = batch.column("s1")[i].as_py(), batch.column("s2")[i].as_py()
                for top in batch.column("large")[i].values.to_numpy():
                    level = [(np.uint64(int(top) & (1 << 64) - 1), int(top))]
                    for depth in range(depths[0] + 1, counted[-1] + 1):
                        level = [(child, above) for node, above in level for child in _children(tokens, node, limit)]
                        if depth in counted:
                            for child, above in level:
                                for values, value in zip(out, (s1, s2, depth, int(child.astype(np.int64)), above)):
                                    values.append(value)
                            level = [(child, int(child.astype(np.int64))) for child, _ in level]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["s1", "s2", "depth", "node", "parent"])

    rows = _texts_of(docs, own, id_col, text_col).select("text", "s1", "s2", "large")
    return rows.mapInArrow(made, "s1 long, s2 long, depth long, node long, parent long")


def _nodes(rows: DataFrame, small: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Nodes to compare (node, n, s1, s2) and, but for the last depth, those to split (node, s1, s2)."""
    counts = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    met = stored(rows.join(counts, "node").select("node", "n", "s1", "s2"), "near-met")
    if last:
        return met, None
    return met.where(F.col("n") <= small), met.where(F.col("n") > small).select("node", "s1", "s2")


def _common(owners: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of ``n`` owners share, by products of incidence matrices."""
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[place]
    nth = np.cumsum(shared) - 1
    owners, place = owners[keep], nth[place[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owners, place = owners[order], place[order]
    step = 4096
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, [at, at + step])
        part = np.zeros((n, step), dtype=np.float32)
        part[owners[a:b], place[a:b] - at] = 1
        out += part @ part.T
    return out


def _runs(batches, keys: list[str], lists: tuple[str, ...]) -> Iterator:
    """(columns, a, b) for each run a:b of rows that agree in ``keys``, of rows that come sorted by them.

    Columns are numpy arrays, those named in ``lists`` pairs of offsets and values; other
    columns, of types numpy lacks, stay Arrow arrays.
    """
    import pyarrow as pa

    rest = None

    def opened(table):
        columns = {}
        for name in table.column_names:
            column = table.column(name).combine_chunks()
            if name in lists:
                columns[name] = (column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False))
            else:
                columns[name] = column if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)
        new = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            new[1:] |= columns[key][1:] != columns[key][:-1]
        return columns, np.concatenate([[0], np.flatnonzero(new)])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        columns, starts = opened(table)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield table, columns, a, b
        rest = table.slice(int(starts[-1])).combine_chunks()
        if rest.num_rows < table.num_rows:  # a copy, so that the batch can go
            rest = rest.take(np.arange(rest.num_rows))
    if rest is not None:
        columns, _ = opened(rest)
        yield rest, columns, 0, rest.num_rows


def _part(column: tuple, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners 0, 1, ... and values of rows a:b of a list column."""
    offsets, values = column
    return np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1])), values[offsets[a]:offsets[b]]


def _alike(sketches: np.ndarray, x: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets may reach the threshold with set ``x``, from the smallest shingles of both."""
    both = np.concatenate([np.broadcast_to(sketches[x], (len(others), sketches.shape[1])), sketches[others]], axis=1)
    both.sort(axis=1)
    shared = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _NO_SHINGLE)
    nth = np.arange(1, both.shape[1]) - np.cumsum(shared, axis=1)  # of the distinct ones, from 0
    distinct = 1 + ((both[:, 1:] < _NO_SHINGLE) & ~shared).sum(axis=1)
    seen = np.minimum(distinct, sketches.shape[1])
    found = (shared & (nth < sketches.shape[1])).sum(axis=1)
    slack = np.where(distinct <= sketches.shape[1], 1e-9, 5 * np.sqrt(threshold * (1 - threshold) / seen))
    return found >= (threshold - slack) * seen


def _candidates(columns: dict, a: int, b: int, threshold: float) -> np.ndarray:
    """Which pairs of rows a:b are first met here and may be linked (a symmetric matrix)."""
    n, sizes = b - a, columns["size"][a:b]
    allowed = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    np.fill_diagonal(allowed, False)
    if columns["i"][a] != columns["j"][a]:
        block = columns["block"][a:b]
        allowed &= block[:, None] != block[None, :]
    if n == 1 or not allowed.any():
        return allowed
    if n <= 8:
        offsets, values = columns["earlier"]
        earlier = [set(values[offsets[k]:offsets[k + 1]].tolist()) for k in range(a, b)]
        for x in range(n):
            for y in range(x):
                if allowed[x, y] and not earlier[x].isdisjoint(earlier[y]):
                    allowed[x, y] = allowed[y, x] = False
    else:
        owners, values = _part(columns["earlier"], a, b)
        if len(values):
            allowed &= _common(owners, values, n) == 0
    if allowed.any():
        offsets, values = columns["sketch"]
        lengths = np.diff(offsets[a:b + 1])
        sketches = np.full((n, SKETCH), _NO_SHINGLE, dtype=np.int64)
        sketches[np.arange(SKETCH) < lengths[:, None]] = values[offsets[a]:offsets[b]].astype(np.int32).view(np.uint32)
        for x in np.flatnonzero(np.triu(allowed).any(axis=1)):
            others = x + 1 + np.flatnonzero(allowed[x, x + 1:])
            allowed[x, others] = allowed[others, x] = _alike(sketches, x, others, threshold)
    return allowed


_NO_SHINGLE = 1 << 40
_GROUP = ["node", "i", "j"]
_ROW = "node long, i int, j int, block int, s1 long, s2 long, size long, weight long, sketch array<int>, earlier array<int>"


def _in_groups(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "s1", "s2").mapInArrow(work, schema)


def _needed(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows that have a candidate in their group; no shingles but those of sketches are looked at yet."""
    def work(batches):
        current, wanted = None, []
        for table, columns, a, b in _runs(batches, _GROUP, ("sketch", "earlier")):
            if table is not current:
                if wanted:
                    yield from current.take(np.concatenate(wanted)).combine_chunks().to_batches()
                current, wanted = table, []
            own = np.flatnonzero(_candidates(columns, a, b, threshold).any(axis=1))
            if len(own):
                wanted.append(own + a)
        if wanted:
            yield from current.take(np.concatenate(wanted)).combine_chunks().to_batches()

    return _in_groups(rows, work, _ROW)


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(s1, s2, links, r1, r2): documents linked to a set in a group, and its root there."""
    def work(batches):
        import pyarrow as pa

        out: list[list] = [[], [], [], [], []]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["s1", "s2", "links", "r1", "r2"])
            for values in out:
                values.clear()
            return batch

        for _, columns, a, b in _runs(batches, _GROUP, ("sketch", "earlier")):
            s1, s2 = columns["s1"][a:b], columns["s2"][a:b]
            pairs = _candidates(columns, a, b, threshold)
            # A representative that was repeated comes twice, side by side: the first counts.
            again = np.concatenate([[False], (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])])
            pairs[again] = False
            pairs[:, again] = False
            if not pairs.any():
                continue
            sizes = columns["size"][a:b].astype(np.float64)
            sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in columns["tokens"][a:b]]
            if len(sets) <= 4:
                common = np.zeros(pairs.shape)
                for x, y in zip(*np.nonzero(np.triu(pairs))):
                    common[x, y] = common[y, x] = np.intersect1d(sets[x], sets[y], assume_unique=True).size
            else:
                owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                common = _common(owners, np.concatenate(sets), len(sets)).astype(np.float64)
            pairs &= common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            linked = np.flatnonzero(pairs.any(axis=1))
            if not len(linked):
                continue
            links = pairs @ columns["weight"][a:b]
            root = np.arange(len(sets))
            while True:  # the least row reachable: few rounds, as near copies are close to cliques
                least = np.where(pairs, root[None, :], len(sets)).min(axis=1)
                new = np.minimum(root, least)
                if (new == root).all():
                    break
                root = new
            for values, value in zip(out, (s1[linked], s2[linked], links[linked], s1[root[linked]], s2[root[linked]])):
                values.extend(value.tolist())
            if len(out[0]) > 5000:
                yield flush()
        if out[0]:
            yield flush()

    return _in_groups(rows, work, "s1 long, s2 long, links long, r1 long, r2 long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex of the undirected ``edges`` (u, v): its component's least vertex.

    Alternates large-star and small-star steps, each a join and an aggregation, until the
    edges are stars.  Vertices may be of any type with an order.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = stored(oriented(edges), "components")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(
            lower.select("u", F.col("m").alias("v")))
        edges = stored(oriented(stars), "components")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return edges.select("u", F.col("v").alias("root")).unionByName(roots)


def _classes(docs: DataFrame, threshold: float, recall: float, words: int, small: int, block: int, depths, seed: int,
             id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (id, t, s1, s2, size), and per set (s1, s2, n, links, class_rep, class_size)."""
    bounded_batches(docs.sparkSession)
    runs = runs_for(recall, depths[-1])
    members = stored(_members(docs, threshold, runs, seed, words, id_col, text_col), "near-members")
    order = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("t"))
    sets = stored(members.where("size > 0").groupBy("s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("rep"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "near-sets")
    first = sets.select(F.explode("paths").alias("node"), "s1", "s2")
    leaves, large = _nodes(first, small, last=len(depths) == 1)
    leaves = [leaves]
    if large is not None and not large.isEmpty():
        below = stored(_deeper(docs, large, sets, depths, threshold, words, id_col, text_col).distinct(), "near-below")
        for depth in depths[1:]:
            here = below.where(F.col("depth") == depth)
            if depth != depths[1]:  # only below nodes that were large at the counted depth above
                here = here.join(large.select("s1", "s2", F.col("node").alias("parent")), ["s1", "s2", "parent"], "left_semi")
            found, large = _nodes(here.select("node", "s1", "s2").distinct(), small, last=depth == depths[-1])
            leaves.append(found)
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    # Each set's nodes in order; those before a node, as 32-bit hashes, tell where a pair was met first.
    listed = nodes.groupBy("s1", "s2").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("nodes")).join(
        sets.select("s1", "s2", "size", "sketch", F.col("n").alias("weight")), ["s1", "s2"])
    short = F.transform("nodes", lambda x: F.hash(x["node"]))
    rows = listed.select("s1", "s2", "size", "weight", "sketch", short.alias("short"), F.posexplode("nodes").alias("at", "x"))
    blocks = F.when(F.col("x.n") > small, F.ceil(F.col("x.n") / F.lit(block)).cast("int")).otherwise(F.lit(1))
    rows = rows.select(
        F.col("x.node").alias("node"), "s1", "s2", "size", "weight", "sketch", F.slice("short", F.lit(1), F.col("at")).alias("earlier"),
        blocks.alias("k"), F.pmod(F.col("s1"), blocks).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
        "s1", "s2", "size", "weight", "sketch", "earlier")
    needed = stored(_needed(rows, threshold), "near-needed")
    texts = _texts_of(docs, needed.select("s1", "s2").distinct().join(sets.select("s1", "s2", "rep"), ["s1", "s2"]), id_col, text_col)

    def tokens_of(batches):
        import pyarrow as pa

        for batch in batches:
            tokens = [s.tobytes() for s in sets_of(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array(tokens, pa.binary())], names=["s1", "s2", "tokens"])

    tokens = texts.select("text", "s1", "s2").mapInArrow(tokens_of, "s1 long, s2 long, tokens binary")
    found = stored(_verified(needed.join(tokens, ["s1", "s2"]), threshold), "near-links")
    linked = found.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.struct("s1", "s2").alias("u"), F.struct(F.col("r1").alias("s1"), F.col("r2").alias("s2")).alias("v")))
    roots = stored(roots.select("u.s1", "u.s2", "root"), "near-roots")
    classes = roots.join(sets.select("s1", "s2", "n", "rep"), ["s1", "s2"]).groupBy("root").agg(
        F.min("rep").alias("class_rep"), F.sum("n").alias("class_size"))
    placed = roots.join(classes, "root").select("s1", "s2", "class_rep", "class_size")
    per_set = sets.select("s1", "s2", "n", "rep").join(linked, ["s1", "s2"], "left").join(placed, ["s1", "s2"], "left").select(
        "s1", "s2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_rep", "rep").alias("class_rep"),
        F.coalesce("class_size", "n").alias("class_size"))
    return members.select("id", "t", "s1", "s2", "size"), stored(per_set, "near-classes")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, small: int = SMALL,
                 block: int = BLOCK, depths=DEPTHS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, class_id, class_size, n_links.

    A class is a connected component of links; ``class_id`` is its smallest id that is not
    null.  ``n_links`` counts the other rows whose shingle set has a Jaccard similarity of
    ``threshold`` or more with the row's own, copies included.  Texts of fewer words than
    ``words`` have one shingle; rows without words, or with a null text, are alone.  Repeated
    rows are copies.  An empty table gives no rows; other columns are not read.
    """
    members, per_set = _classes(docs, threshold, recall, words, small, block, depths, seed, id_col, text_col)
    found = members.join(per_set, ["s1", "s2"], "left")
    alone = (F.col("size") == 0) | F.col("n").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_rep.id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("n") - 1).cast("long").alias("n_links"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, small: int = SMALL,
               block: int = BLOCK, depths=DEPTHS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one of each class stays.

    It is the row of the smallest id that is not null; of rows repeated with one id the one
    whose text has the smallest hash, and of rows with one id and text any one.  Rows without
    words all stay.
    """
    members, per_set = _classes(docs, threshold, recall, words, small, block, depths, seed, id_col, text_col)
    members = members.where("size > 0")
    stays = F.col("id").eqNullSafe(F.col("class_rep.id")) & (F.col("t") == F.col("class_rep.t"))
    gone = stored(members.join(per_set, ["s1", "s2"]).where(~stays).select("id", "t").distinct(), "near-gone")
    again = stored(members.groupBy("id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "t"), "near-again")
    i, t, met, own = fresh(docs, "_i", "_t", "_met", "_own")
    keys = gone.unionByName(again)
    text = F.xxhash64(whole_text(text_col))
    marked = in_slots(docs.withColumn(own, text), F.xxhash64(column(id_col), F.col(own)), keys, F.xxhash64("id", "t"), met)

    def same(keys: DataFrame) -> tuple[DataFrame, Column]:
        renamed = keys.withColumnsRenamed({"id": i, "t": t})
        return renamed, column(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(t))

    out = marked.where(F.col(met)).join(*same(gone), "left_anti")
    if not again.isEmpty():
        once = out.join(*same(again), "left_anti")
        out = once.unionByName(out.join(*same(again), "left_semi").dropDuplicates([id_col, own]))
    wanted = [column(c) for c in docs.columns]
    return marked.where(~F.col(met)).select(wanted).unionByName(out.select(wanted))
