"""A Merkle manifest of a table by time-forward processing.

Every row is a leaf.  The leaves of a group, in order, are hashed two by two until one node is
left, the group's root; the group roots are hashed likewise to the root of the table.  The work
follows the nodes' labels (level, place): a node's digest is a message to its parent, and all
messages are delivered in the order of their labels by a priority queue.  Spark's shuffle is the
external part of that queue: it brings the messages for 2^10 neighbouring nodes to one task,
which takes ten levels from a heap.  The sweep back runs through the same labels in reverse and
delivers to each child the siblings on its way to the root, so a leaf ends with its whole proof.

A group of any size is thus many tasks of at most 2^10 nodes each; a round takes ten levels, so
10^12 leaves take four rounds.  Nothing but the number of rounds and the root reaches the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import join_on_keys, stored
from canopanel.llm.common import column
from canopanel.llm.ordered import positions

LEVELS = 10  # levels of a tree that one task takes
STEP = 33  # bytes of one step of a packed proof: the side of the sibling and its digest
LEFT, RIGHT, ALONE = b"L", b"R", b"-"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else length in UTF-8 bytes, ``:``, value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def parent_digest(children: Sequence[bytes]) -> bytes:
    """SHA-256 of the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def forward(first: int, digests: Sequence[bytes], levels: int) -> list[dict[int, bytes]]:
    """Digests by place for each level, from the nodes ``first, first + 1, ...`` of the lowest one.

    A heap ordered by label (level, place) delivers the digests; those with one parent leave it
    one after the other and become the parent's digest, which joins the heap.
    """
    queue = [(0, first + i, d) for i, d in enumerate(digests)]
    known: list[dict[int, bytes]] = [{} for _ in range(levels + 1)]
    while queue:
        level, place, digest = heapq.heappop(queue)
        known[level][place] = digest
        if level == levels:
            continue
        run = [digest]
        if queue and queue[0][:2] == (level, place | 1) and not place & 1:
            run.append(heapq.heappop(queue)[2])
            known[level][place | 1] = run[1]
        heapq.heappush(queue, (level + 1, place >> 1, parent_digest(run)))
    return known


def backward(known: list[dict[int, bytes]], proof: bytes) -> dict[int, bytes]:
    """The packed proof of each node of the lowest level, from that of the one node at the top.

    Labels leave the heap in reverse; each node sends its children their sibling before its own proof.
    """
    top = len(known) - 1
    queue = [(-top, -place, proof) for place in known[top]]
    out = {}
    while queue:
        level, place, above = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            out[place] = above
            continue
        left, right = known[level - 1][2 * place], known[level - 1].get(2 * place + 1)
        if right is None:
            heapq.heappush(queue, (1 - level, -2 * place, ALONE + bytes(32) + above))
        else:
            heapq.heappush(queue, (1 - level, -2 * place, RIGHT + right + above))
            heapq.heappush(queue, (1 - level, -2 * place - 1, LEFT + left + above))
    return out


def _levels_of(size: int, most: int) -> int:
    """Levels that a round of at most ``most`` takes from a tree with ``size`` nodes at its lowest level."""
    return min(most, (size - 1).bit_length())


def _lift(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes ``most`` levels higher (or the root, if that is lower): (tree, pos, size, digest)."""
    def climb(table):
        import pyarrow as pa

        rows = sorted(zip(table["pos"].to_pylist(), table["digest"].to_pylist()))
        size, first = table["size"][0].as_py(), rows[0][0]
        levels = _levels_of(size, most)
        (place, digest), = forward(first, [d for _, d in rows], levels)[levels].items()
        return pa.table({"tree": table["tree"][:1], "pos": [place], "size": [-(-size >> levels)], "digest": [digest]})

    schema = f"tree {nodes.schema['tree'].dataType.simpleString()}, pos long, size long, digest binary"
    block = F.shiftright("pos", most).alias("block")
    return nodes.where("size > 1").select("tree", "pos", "size", "digest").groupBy("tree", block).applyInArrow(climb, schema)


def _deliver(nodes: DataFrame, proofs: DataFrame, most: int) -> DataFrame:
    """``nodes`` (of trees with several) with their packed proofs, from the ``proofs`` ``most`` levels higher."""
    kept = [c for c in nodes.columns if c not in ("size", "digest")]

    def descend(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        message = table.filter(pc.equal(table["kind"], 0))
        rows = table.filter(pc.equal(table["kind"], 1)).sort_by("pos")
        place, size = rows["pos"].to_pylist(), rows["size"][0].as_py()
        known = forward(place[0], rows["digest"].to_pylist(), _levels_of(size, most))
        proof = backward(known, message["proof"][0].as_py())
        return rows.select(kept).append_column("proof", pa.array([proof[p] for p in place], pa.binary()))

    block = F.shiftright("pos", most)
    rows = nodes.where("size > 1").withColumn("block", block).withColumn("kind", F.lit(1))
    messages = proofs.select("tree", F.col("pos").alias("block"), "proof").withColumn("kind", F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(kept).schema) + ", proof binary"
    return rows.unionByName(messages, allowMissingColumns=True).groupBy("tree", "block").applyInArrow(descend, schema)


class Tree:
    """The nodes of many trees every ``levels`` levels, each a stored table (tree, pos, size, digest)."""

    def __init__(self, leaves: DataFrame, name: str, levels: int):
        """``leaves``: (tree, pos, size, digest, ...), a stored table; other columns stay with the leaves."""
        self.rounds = [leaves]
        longest = leaves.agg(F.max("size")).first()[0] or 0
        self.name, self.levels = name, levels
        while longest > 1:
            self.rounds.append(stored(_lift(self.rounds[-1], levels), f"{name}-lift"))
            longest = -(-longest >> levels)

    def roots(self) -> DataFrame:
        """(tree, digest): the one node left of each tree."""
        done = [nodes.where("size = 1").select("tree", "digest") for nodes in self.rounds]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def leaves(self, above: DataFrame) -> DataFrame:
        """The leaves with their packed proof; ``above``: (tree, proof) of each root."""
        proofs = None
        for i, nodes in reversed(list(enumerate(self.rounds))):
            roots = join_on_keys(nodes.where("size = 1"), above, ["tree"], "inner").drop("size", "digest")
            if proofs is not None:
                roots = roots.unionByName(_deliver(nodes, proofs, self.levels))
            proofs = roots if i == 0 else stored(roots, f"{self.name}-proofs")
        return proofs


def _steps(packed: Column) -> Column:
    """A packed proof as an array of (side, digest): where the sibling stands, none at all if ``-``."""
    n = F.floor(F.octet_length(packed) / STEP).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(
        F.substring(packed, i * STEP + 1, F.lit(1)).cast("string").alias("side"),
        F.lower(F.hex(F.substring(packed, i * STEP + 2, F.lit(STEP - 1)))).alias("digest")))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` (hex) leads to with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(
        F.when(step["side"] == LEFT.decode(), F.concat(step["digest"], node))
        .when(step["side"] == RIGHT.decode(), F.concat(node, step["digest"])).otherwise(node), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of the siblings' digests, from leaf to root."""
    siblings = F.filter(proof, lambda step: step["side"] != ALONE.decode())
    return F.sha2(F.array_join(F.transform(siblings, lambda step: step["digest"]), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             group_col: str = "lang", id_col: str = "doc_id", extra: dict[str, Column] | None = None,
             levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: the id, group, leaf, subroot, root, proof and the ``extra`` columns.

    ``leaf``, ``subroot`` (of the row's group) and ``root`` are lowercase hex digests; ``proof`` is an
    array of (side, digest) from the leaf to the root, for :func:`fold`.  ``fields`` are hashed into
    the leaf; ``extra`` are expressions over ``docs`` that travel along.  A task takes ``levels`` levels.

    Null values, ids and groups count as values of their own: a null field is ``-``, a null id comes
    first, null groups are one group and come first.  Rows with one id are ordered by their leaf;
    repeated rows are leaves of their own, side by side.  A text of any length is hashed whole where
    it is read; only digests move.  An empty table gives no rows.  Other columns of ``docs`` are not
    read, so their names may be any.
    """
    extra = {} if extra is None else extra
    carried = [e.alias(f"x{i}") for i, e in enumerate(extra.values())]
    rows = docs.select(
        column(group_col).alias("tree"), column(id_col).alias("id"),
        F.unhex(leaf_digest([column(f) for f in fields])).alias("digest"), *carried)
    leaves = stored(positions(rows, "tree", ["id", "digest"], "pos", "size", "merkle"), "merkle-leaves")
    groups = Tree(leaves.withColumn("leaf", F.col("digest")), "merkle-group", levels)
    subroots = stored(groups.roots().withColumnsRenamed({"tree": "group", "digest": "subroot"}), "merkle-subroots")
    tops = positions(
        subroots.select(F.lit(0).alias("tree"), "group", F.col("subroot").alias("digest")),
        "tree", ["group"], "pos", "size", "merkle-top")
    top = Tree(stored(tops.withColumn("subroot", F.col("digest")), "merkle-tops"), "merkle-top", levels)
    root = top.roots().first()  # one row, or none for an empty table
    empty = top.rounds[0].select("tree").distinct().withColumn("proof", F.lit(b""))
    above = stored(top.leaves(empty).select(F.col("group").alias("tree"), "subroot", "proof"), "merkle-above")
    found = join_on_keys(groups.leaves(above.select("tree", "proof")), above.select("tree", "subroot"), ["tree"], "inner")
    to_hex = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias(id_col), F.col("tree").alias(group_col), to_hex("leaf").alias("leaf"),
        to_hex("subroot").alias("subroot"),
        F.lit(None if root is None else root["digest"].hex()).alias("root"), _steps(F.col("proof")).alias("proof"),
        *[F.col(f"x{i}").alias(name) for i, name in enumerate(extra)])
