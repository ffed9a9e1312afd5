"""Repair of a conversation's structure at least cost, by divide and conquer in linear space.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials.  What has been said so
far is one of four states (nothing, a system row, user, assistant), so an edit of a row, with
insertions before it, is a step from state to state.  Hirschberg's scheme finds the cheapest
edits: four-state cost vectors run forward over the first half of the rows and backward over the
second, meet in the middle, the best crossing splits the task in two, and the halves are solved
likewise, without a table of back pointers.  Of equally cheap edits those whose letters are
ASCII-least are taken: the forward vector also ranks its four states by the letters that lead to
them.  All of these end with the edit of the same row, none begins another, so the order of what
is behind decides before what is to come.

A conversation of any length is cut into blocks of 2^10 rows.  A block is summed up as what it
costs from each state to each other one; blocks of blocks likewise, as often as needed.  The
same recursion then runs over the summaries from the top, and tells each block where it is
entered and left, so that blocks are solved apart from each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.cluster import join_on_keys, stored
from canopanel.llm.common import bounded_batches, column, fresh
from canopanel.llm.ordered import positions

BLOCK_BITS = 10
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
RULE_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5

# States: nothing yet, after a system row, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_AFTER_INSERT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Insertions that end a conversation left in a state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
# Initials of roles, and what ails a row: nothing, truncated, or blank or duplicate.
INITIALS = "sua"
SOUND, TRUNCATED, SPOILT = range(3)
_LEGAL = {(0, 1), (1, 2), (2, 1)}

# An element's steps: for each state the (state reached, cost, rank of its letters).
Steps = Sequence[Sequence[tuple[int, int, int]]]
Vector = list[tuple[int, int] | None]


def _kept(state: int, initial: int) -> int | None:
    """The state after a row with this initial (3: any other) is kept, if it may be."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def row_steps(initial: int, ailment: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state, state) -> (cost, letters) of the best edit of one row, with insertions before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED_COST if ailment == TRUNCATED else 0
    for start in STATES:
        state = start
        for inserted in range(3):  # a third insertion would only repeat a state
            ways = [("D", state, 0)]
            if ailment != SPOILT:
                ways += [("K", _kept(state, initial), extra), ("R", _AFTER_INSERT[state], extra)]
            for letter, end, more in ways:
                if end is None:
                    continue
                way = (inserted * RULE_COST["I"] + RULE_COST[letter] + more, "I" * inserted + letter)
                best[start, end] = min(best.get((start, end), way), way)
            state = _AFTER_INSERT[state]
    return best


def _ranked(best: dict[tuple[int, int], tuple[int, str]]) -> Steps:
    steps = []
    for start in STATES:
        ends = sorted((letters, end, cost) for (s, end), (cost, letters) in best.items() if s == start)
        steps.append(tuple((end, cost, rank) for rank, (_, end, cost) in enumerate(ends)))
    return tuple(steps)


LETTERS = {(i, a): row_steps(i, a) for i in range(4) for a in range(3)}
ROW_STEPS = {key: _ranked(best) for key, best in LETTERS.items()}


def begin(state: int) -> Vector:
    return [(0, 0) if s == state else None for s in STATES]


def advance(vector: Vector, steps: Steps) -> Vector:
    """Least (cost, rank of letters) of each state after one more element."""
    best: list[tuple[int, int, int] | None] = [None] * 4
    for state in STATES:
        if vector[state] is None:
            continue
        cost, rank = vector[state]
        for end, more, order in steps[state]:
            way = (cost + more, rank, order)
            if best[end] is None or way < best[end]:
                best[end] = way
    order = sorted(way[1:] for way in best if way is not None)
    return [None if way is None else (way[0], order.index(way[1:])) for way in best]


def retreat(costs: list[int | None], steps: Steps) -> list[int | None]:
    """Least cost from each state through one element to what ``costs`` leads on to."""
    return [
        min((more + costs[end] for end, more, _ in steps[state] if costs[end] is not None), default=None) for state in STATES]


def crossings(elements: Sequence[Steps], entry: int, leave: int) -> list[tuple[int, int]]:
    """The (entry, exit) state of every element on the best way from ``entry`` to ``leave``."""
    out: list[tuple[int, int]] = [(entry, leave)] * len(elements)

    def halve(low: int, high: int, first: int, last: int) -> None:
        if high - low == 1:
            out[low] = (first, last)
            return
        middle = (low + high) // 2
        vector = begin(first)
        for element in elements[low:middle]:
            vector = advance(vector, element)
        costs: list[int | None] = [0 if s == last else None for s in STATES]
        for i in range(high - 1, middle - 1, -1):
            costs = retreat(costs, elements[i])
        meet = min(
            (way[0] + cost, way[1], state) for state, (way, cost) in enumerate(zip(vector, costs))
            if way is not None and cost is not None)[2]
        halve(low, middle, first, meet)
        halve(middle, high, meet, last)

    halve(0, len(elements), entry, leave)
    return out


def best_exit(elements: Sequence[Steps]) -> int:
    """The state in which the best repair of a whole conversation leaves its last row."""
    vector = begin(NOTHING)
    for element in elements:
        vector = advance(vector, element)
    return min(
        (way[0] + len(CLOSING[state]) * RULE_COST["I"], way[1], state)
        for state, way in enumerate(vector) if way is not None)[2]


def summed(elements: Sequence[Steps]) -> Steps:
    """Many elements as one."""
    steps = []
    for entry in STATES:
        vector = begin(entry)
        for element in elements:
            vector = advance(vector, element)
        steps.append(tuple((end, *way) for end, way in enumerate(vector) if way is not None))
    return tuple(steps)


# ---- on Spark -----------------------------------------------------------------------

def _packed(steps: Steps) -> list[int]:
    flat = [-1] * 32
    for state, ways in enumerate(steps):
        for end, cost, rank in ways:
            flat[8 * state + 2 * end: 8 * state + 2 * end + 2] = [cost, rank]
    return flat


def _unpacked(flat: Sequence[int]) -> Steps:
    return tuple(
        tuple((end, flat[8 * s + 2 * end], flat[8 * s + 2 * end + 1]) for end in STATES if flat[8 * s + 2 * end] >= 0)
        for s in STATES)


def _blocks(batches) -> Iterator[list[dict]]:
    """Neighbouring rows of one (conv, block): a bounded number of them and a message."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in itertools.groupby(rows, key=lambda row: (row["conv"], row["block"])):
        yield list(block)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of neighbouring nodes, each whole in one partition."""
    return nodes.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")


def _elements(rows: list[dict]) -> list[Steps]:
    if rows[0].get("steps") is not None:
        return [_unpacked(row["steps"]) for row in rows]
    return [ROW_STEPS[row["initial"], row["ailment"]] for row in rows]


def _batches(rows: Iterator[tuple], names: list[str], schema, size: int = 4096):
    import pyarrow as pa

    while part := list(itertools.islice(rows, size)):
        arrays = [pa.array(values, schema.field(i).type) for i, values in enumerate(zip(*part))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _map_blocks(nodes: DataFrame, work, conv_type: str, fields: str) -> DataFrame:
    """``work(rows of a block) -> tuples``, as a table (conv, *fields)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(f"conv {conv_type}, {fields}")
    arrow, names = to_arrow_schema(struct), struct.names

    def mapped(batches):
        yield from _batches((out for block in _blocks(batches) for out in work(block)), names, arrow)

    return nodes.mapInArrow(mapped, struct)


def _summaries(nodes: DataFrame, bits: int, conv_type: str) -> DataFrame:
    """(conv, pos, size, steps): the blocks of conversations longer than one block, as nodes."""
    def work(rows):
        yield rows[0]["conv"], rows[0]["block"], -(-rows[0]["size"] >> bits), _packed(summed(_elements(rows)))

    long_ones = _in_blocks(nodes.where(F.col("size") > 1 << bits).withColumn("block", F.shiftright("pos", bits)))
    return _map_blocks(long_ones, work, conv_type, "pos long, size long, steps array<long>")


def _with_messages(nodes: DataFrame, ways: DataFrame | None, bits: int) -> DataFrame:
    """Nodes in blocks, in front of each block the states in which it is entered and left, if known."""
    rows = nodes.withColumn("block", F.shiftright("pos", bits))
    if ways is not None:
        rows = rows.unionByName(
            ways.select("conv", F.col("pos").alias("block"), "entry", "leave", F.lit(-1).cast("long").alias("pos")),
            allowMissingColumns=True)
    return _in_blocks(rows)


def _ways(rows: list[dict]) -> tuple[list[dict], list[tuple[int, int]], bool]:
    """A block's nodes, their (entry, exit), and whether the block ends its conversation."""
    ends = rows[-1]["pos"] == rows[-1]["size"] - 1
    if rows[0]["pos"] < 0:
        entry, leave, rows = rows[0]["entry"], rows[0]["leave"], rows[1:]
        elements = _elements(rows)
    else:
        elements = _elements(rows)
        entry, leave = NOTHING, best_exit(elements)
    return rows, crossings(elements, entry, leave), ends


def _block_ways(nodes: DataFrame, ways: DataFrame | None, bits: int, conv_type: str) -> DataFrame:
    """(conv, pos, entry, leave) of every node, from those of the blocks of nodes."""
    def work(rows):
        nodes, states, _ = _ways(rows)
        for node, (entry, leave) in zip(nodes, states):
            yield node["conv"], node["pos"], entry, leave

    return _map_blocks(_with_messages(nodes, ways, bits), work, conv_type, "pos long, entry int, leave int")


_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def _edits(rows: DataFrame, ways: DataFrame | None, bits: int, conv_type: str) -> DataFrame:
    """Per row that stays or is inserted (conv, block, i, role, old_role, text_key), and per block its sums.

    A row of sums has ``audit``; ``text_key`` is null where a row is inserted.
    """
    def work(block):
        nodes, states, ends = _ways(block)
        conv, number = nodes[0]["conv"], nodes[0]["block"]
        audit, cost, i = [], 0, itertools.count()
        for node, (state, leave) in zip(nodes, states):
            more, letters = LETTERS[node["initial"], node["ailment"]][state, leave]
            cost += more
            audit.append(letters)
            for letter in letters:
                if letter == "I":
                    state = _AFTER_INSERT[state]
                    yield conv, number, next(i), _ROLE_OF[state], None, None, None, None, None, None, None
                elif letter != "D":
                    role = node["role"] if letter == "K" else _ROLE_OF[leave]
                    yield conv, number, next(i), role, node["role"], node["text_key"], None, None, None, None, None
        if ends:
            state = states[-1][1]
            audit.append(CLOSING[state])
            cost += len(CLOSING[state]) * RULE_COST["I"]
            for _ in CLOSING[state]:
                state = _AFTER_INSERT[state]
                yield conv, number, next(i), _ROLE_OF[state], None, None, None, None, None, None, None
        roles = [node["initial"] for node in nodes]
        illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))
        yield conv, number, None, None, None, None, "".join(audit), cost, illegal, roles[0], roles[-1]

    fields = ("block long, i int, role string, old_role string, text_key binary, "
              "audit string, cost long, illegal long, first int, last int")
    return _map_blocks(_with_messages(rows, ways, bits), work, conv_type, fields)


def _codes(said: DataFrame) -> DataFrame:
    """Rows without their texts, in order, with what ails each: a stored table."""
    bare = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "", 3).otherwise(F.pmod(F.instr(F.lit(INITIALS), first) - 1, F.lit(4)))
    rows = said.select(
        "conv", "turn", "role", F.unhex(F.md5("text")).alias("text_key"), initial.cast("int").alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    rows = stored(positions(rows, "conv", ["turn", "role", "text_key"], "pos", "size", "conversations"), "conversations")
    seen = rows.groupBy("conv", "role", "text_key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = join_on_keys(rows, seen.drop("n"), ["conv", "role", "text_key"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    cut = ~F.col("blank") & ~duplicate & F.col("cut")
    ailment = F.when(F.col("blank") | duplicate, SPOILT).when(cut, TRUNCATED).otherwise(SOUND)
    return stored(rows.select(
        "conv", "turn", "role", "text_key", "initial", "pos", "size", "blank", duplicate.alias("duplicate"),
        cut.alias("truncated"), ailment.cast("int").alias("ailment")), "conversation-codes")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """What is wrong in each conversation, and the repaired conversations.

    The first table has a row per conversation: ``conv_col``, gaps, blank, duplicate, truncated,
    illegal, cost, audit.  The second has the repaired rows: ``conv_col``, place (ascending within a
    conversation, with gaps), ``role_col``, ``text_col``; inserted rows have an empty text.

    Nulls: a null role or text is one space, null conversation ids are one conversation, null turns
    come first and count for no gap.  Rows of one turn are ordered by role, then by the MD5 of their
    text, so rows alike stand side by side, and the later ones are duplicates.  A conversation of a
    third of all rows is solved in blocks; texts of any length are moved once and joined to the rows
    that keep them.  An empty table gives empty tables; other columns are not read.
    """
    bounded_batches(rows.sparkSession)
    value = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    said = rows.select(
        column(conv_col).alias("conv"), column(turn_col).alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"))
    conv_type = said.schema["conv"].dataType.simpleString()
    codes = _codes(said)
    rounds = [codes.select("conv", "pos", "size", "role", "text_key", "initial", "ailment")]
    longest = codes.agg(F.max("size")).first()[0] or 0
    while longest > 1 << block_bits:
        rounds.append(stored(_summaries(rounds[-1], block_bits, conv_type), "conversation-blocks"))
        longest = -(-longest >> block_bits)
    ways = None
    for nodes in reversed(rounds[1:]):
        ways = stored(_block_ways(nodes, ways, block_bits, conv_type), "conversation-ways")
    edits = stored(_edits(rounds[0], ways, block_bits, conv_type), "conversation-edits")

    by_turn = codes.groupBy("conv", "turn").agg(*[
        F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    parts = edits.where("audit IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(
        "block", "audit", "first", "last"))).alias("parts"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    n = F.size("parts")
    joints = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(
        F.get("parts", i - 1)["last"].cast("string"), F.get("parts", i)["first"].cast("string"))))
    legal = [f"{a}{b}" for a, b in sorted(_LEGAL)]
    broken = F.coalesce(F.size(F.filter(joints, lambda j: ~j.isin(*legal))), F.lit(0))
    audits = parts.select(
        "conv", (F.col("illegal") + F.when(n > 1, broken).otherwise(0)).cast("long").alias("illegal"), "cost",
        F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    report = join_on_keys(counts, audits, ["conv"], "inner").withColumnRenamed("conv", conv_col)

    place = F.shiftleft("block", 32).bitwiseOR(F.col("i").cast("long")).alias("place")
    staying = edits.where("text_key IS NOT NULL").select("conv", place, F.col("role").alias("new_role"), F.col("old_role").alias("role"), "text_key")
    inserted = edits.where("i IS NOT NULL AND text_key IS NULL").select("conv", place, "role", F.lit("").alias("text"))
    texts = said.groupBy("conv", "role", F.unhex(F.md5("text")).alias("text_key")).agg(F.first("text").alias("text"))
    repaired = join_on_keys(staying, texts, ["conv", "role", "text_key"], "inner").select(
        "conv", "place", F.col("new_role").alias("role"), "text")
    out = repaired.unionByName(inserted).select(
        F.col("conv").alias(conv_col), "place", F.col("role").alias(role_col), F.col("text").alias(text_col))
    return report, out


def joined_digest(rows: DataFrame, key: str, order: str, line: Column, digest_col: str) -> DataFrame:
    """(key, digest_col): hex SHA-256 of each key's ``line`` values, in order, joined by newlines.

    Rows stream through one task a key, which a hash of all of them asks for; none is held.
    """
    bounded_batches(rows.sparkSession)
    dealt = rows.select(column(key).alias("k"), column(order).alias("o"), line.alias("line"))
    dealt = dealt.repartition("k").sortWithinPartitions("k", "o").select("k", "line")

    def digest(batches):
        import hashlib

        import pyarrow as pa

        pairs = ((k, v) for batch in batches for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        keys, digests = [], []
        for k, group in itertools.groupby(pairs, key=lambda pair: pair[0]):
            state = hashlib.sha256(next(group)[1].encode())
            for _, text in group:
                state.update(b"\n")
                state.update(text.encode())
            keys.append(k)
            digests.append(state.hexdigest())
            if len(keys) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(digests)], names=[key, digest_col])
                keys, digests = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(digests, pa.string())], names=[key, digest_col])

    from pyspark.sql.pandas.types import to_arrow_type
    spark_type = dealt.schema["k"].dataType
    key_type = to_arrow_type(spark_type)
    return dealt.mapInArrow(digest, f"`{key}` {spark_type.simpleString()}, `{digest_col}` string")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``rows`` with faults planted by the CRC-32 of ``conversation:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it
    the user's.  Null ids, turns, roles and texts are one space there.
    """
    value = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(value(conv_col), F.lit(":"), value(turn_col)).cast("binary")) % 20
    changed = {
        role_col: F.when(fault == 4, "user").otherwise(value(role_col)),
        text_col: F.when(fault == 1, "").when(fault == 2, F.regexp_replace(value(text_col), "[.!?]", "")).otherwise(value(text_col))}
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    copy, = fresh(rows, "_copy")
    return rows.select(
        *[changed.get(c, column(c)).alias(c) for c in rows.columns], F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)
