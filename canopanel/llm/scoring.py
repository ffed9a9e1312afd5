"""Language-model scores by a weighted backoff automaton over the n-grams of a corpus.

The model interpolates orders with a Dirichlet prior: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k),
h' being h without its first word, down to p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).  As an automaton,
each context is a state and each n-gram an arc with the weight log10 p; a state's failure arc leads
to the shorter context at the weight log10(k / (c(h) + k)).  A text is scored in one traversal from
left to right that carries the state and adds up weights.

Counts are of the whole corpus and grow with it, so no task holds them all.  Texts are dealt into
batches of bounded size.  A batch asks for the counts of its distinct n-grams: their 64-bit hashes,
sorted and cut into ranges (shards), with how often its own training texts have them.  The shards
add up what all batches have and answer each request in the order it came, so an answer needs no
hashes.  A batch then compiles the part of the automaton that its texts can reach and runs it.
A frequent word or phrase is one entry of each batch, however often it occurs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopanel.llm.common import bounded_batches, column

BATCH_BYTES = 8 << 20  # text whose distinct n-grams a task holds
SHARD_BYTES = 8 << 20  # text, at all batches together, for each range of hashes
PIECE = 1 << 20  # bytes that are split into words at once
KEPT_WORDS = 1 << 18  # different words that a task counts before it sends them on
ADDED = 0.1  # added to each word's count

_BEGIN, _END = 0, 1  # ids of the marks around a text
_MARKS = (b" begin", b" end")  # no word has a space
_NEXT_SPACE = re.compile(rb"[ \t-\r]")


class Vocabulary(dict):
    """Ids of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) + len(_MARKS)
        return i

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each id."""
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, (*_MARKS, *self)), np.uint64, len(self) + len(_MARKS))

    def ids(self, text: bytes) -> list[np.ndarray]:
        """Ids of the words of a text, ASCII letters in lower case, piece by piece."""
        text, at, out = text.lower(), 0, []
        while at < len(text):
            space = _NEXT_SPACE.search(text, at + PIECE)
            end = len(text) if space is None else space.start()
            words = text[at:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return out


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word."""
    h = context * np.uint64(0x9E3779B97F4A7C15) + word
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Batch:
    """Texts as one sequence of tokens, each between its marks, and the distinct n-grams in it.

    ``grams[m]`` are the sorted hashes of order m + 1, ``arc[m][i]`` which of them ends at token i
    (or a wrong one where the text is too short), ``first[m]`` a token where each ends.
    """

    def __init__(self, texts: list[bytes | None], learn: list[bool], order: int):
        words, parts, lengths = Vocabulary(), [], []
        begin, end = np.array([_BEGIN], np.int32), np.array([_END], np.int32)
        for text in texts:
            ids = words.ids(text or b"")
            lengths.append(sum(map(len, ids)) + 2)
            parts += [begin, *ids, end]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.starts = self.ends - np.array(lengths, dtype=np.int64)
        hashes = words.hashes()[ids]
        place = (np.arange(len(ids)) - np.repeat(self.starts, lengths)).astype(np.int32)
        del words, parts, ids
        learned = np.repeat(np.array(learn, dtype=bool), lengths)
        self.grams, self.arc, self.first, self.own = [], [], [], []
        gram = hashes
        for m in range(order):
            if m:
                gram = np.concatenate([hashes[:1], _mixed(gram[:-1], hashes[1:])])
            valid = np.flatnonzero(place >= m).astype(np.int32)
            distinct, first, which = np.unique(gram[valid], return_index=True, return_inverse=True)
            arc = np.zeros(len(hashes), dtype=np.int32)
            arc[valid] = which
            self.grams.append(distinct)
            self.first.append(valid[first])
            self.arc.append(arc)
            self.own.append(np.bincount(which[learned[valid]], minlength=len(distinct)).astype(np.uint32))


class Automaton:
    """The part of the model that a batch can reach: weights of arcs and of failure arcs by order.

    ``totals[m]`` are the corpus' counts of ``batch.grams[m]``; an n-gram it does not have is no arc.
    """

    def __init__(self, batch: Batch, totals: list[np.ndarray], tokens: int, kinds: int, prior: float):
        self.batch, self.totals = batch, totals
        count = totals[0].astype(np.float64)
        p = (count + ADDED) / (tokens + ADDED * (kinds + 1))
        self.base = np.log10(p)
        self.arcs, self.fails = [self.base], []
        for m in range(1, len(totals)):
            last = batch.first[m]
            context = totals[m - 1][batch.arc[m - 1][last - 1]].astype(np.float64)
            p = (totals[m] + prior * p[batch.arc[m - 1][last]]) / (context + prior)
            # The last one stands for all where no text is long enough for this order.
            self.arcs.append(np.append(np.where(totals[m] > 0, np.log10(p), np.nan), np.nan))
            self.fails.append(np.log10(prior / (totals[m - 1] + prior)))

    def base_score(self, doc: int) -> float:
        part = slice(self.batch.starts[doc] + 1, self.batch.ends[doc])
        return math.fsum(self.base[self.batch.arc[0][part]].tolist())

    def known(self, doc: int) -> int:
        part = slice(self.batch.starts[doc] + 1, self.batch.ends[doc])
        return int((self.totals[0][self.batch.arc[0][part]] > 0).sum())

    def walk(self, doc: int) -> float:
        """The weight of the path that a text takes from the state after its opening mark."""
        start, end = int(self.batch.starts[doc]), int(self.batch.ends[doc])
        orders = len(self.arcs)
        # By order, for each token: its arc's weight, and that of failing in the context before it.
        arcs = [weights[self.batch.arc[m][start:end]].tolist() for m, weights in enumerate(self.arcs)]
        fails = [weights[self.batch.arc[m][start:end]].tolist() for m, weights in enumerate(self.fails)]
        known = (self.totals[0][self.batch.arc[0][start:end]] > 0).tolist()
        path = []
        state = 1 if known[0] and orders > 1 else 0  # how many words of context the state has
        for i in range(1, end - start):
            while state:
                weight = arcs[state][i]
                if weight == weight:
                    break
                state -= 1
                path.append(fails[state][i - 1])
            else:
                weight = arcs[0][i]
            path.append(weight)
            state = min(state + 1, orders - 1) if known[i] else 0
        return math.fsum(path)


# ---- on Spark -----------------------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: zero bytes lie together, where compression finds them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _sent(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _received(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _ranges(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The slice of sorted hashes in each range that has any."""
    if not len(hashes):
        return
    shards = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(shards[a]), slice(a, b)


def _corpus_size(texts: DataFrame, bits: int) -> tuple[int, int]:
    """(N, V): how many tokens the training texts have, and how many different ones."""
    def words(batches):
        import pyarrow as pa

        vocabulary, n, docs = Vocabulary(), 0, 0

        def spilled():
            hashes = np.sort(vocabulary.hashes()[len(_MARKS):])
            cut = list(_ranges(hashes, bits))
            rows = [(shard, 0, 0, _sent(hashes[part])) for shard, part in cut] + [(-1, n, docs, None)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["shard", "n", "docs", "hashes"])

        for batch in batches:
            for text in batch.column(0):
                n += sum(map(len, vocabulary.ids(text.as_py() or b""))) + 1
                docs += 1
                if len(vocabulary) > KEPT_WORDS:
                    yield from spilled()
                    vocabulary, n, docs = Vocabulary(), 0, 0
        yield from spilled()

    def distinct(table):
        import pyarrow as pa

        found = [_received(h) for h in table["hashes"].to_pylist() if h is not None]
        return pa.table({
            "n": [sum(table["n"].to_pylist())], "docs": [sum(table["docs"].to_pylist())],
            "kinds": [len(np.unique(np.concatenate(found))) if found else 0]})

    sent = texts.where("learn").select("text").mapInArrow(words, "shard int, n long, docs long, hashes binary")
    sums = sent.groupBy("shard").applyInArrow(distinct, "n long, docs long, kinds long")
    row = sums.agg(F.sum("n"), F.sum("docs"), F.sum("kinds")).first()
    return int(row[0] or 0), int(row[2] or 0) + (1 if row[1] else 0)  # the end is a token of its own


def score_texts(docs: DataFrame, learn: Column, order: int = 3, prior: float = 4.0, id_col: str = "doc_id",
                text_col: str = "text", batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens, n_known, train_tokens, base_score and score.

    Words are what stands between ASCII white space, ASCII letters in lower case; a text's end is a
    token as well.  ``learn`` tells which rows the counts are taken from (null: not).  ``base_score``
    is the log10 probability by words alone, ``score`` that of the model of ``order`` with ``prior`` (k above).

    A null text is empty: it has its end only.  Repeated rows are scored, and counted, each by itself;
    null or repeated ids do no harm, ids are only passed on.  Words of a text of any length are taken
    in pieces; its n-grams are held by one task.  Without training rows every token is as likely as
    can be, with a score of 0.  An empty table gives no rows.  Other columns are not read.  N-grams
    whose 64-bit hashes are equal are taken as one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        column(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), column(text_col).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 16).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = int(size["bytes"] or 0) + 16 * int(size["rows"])
    batches = max(1, -(-total // batch_bytes))
    bits = max(0, math.ceil(math.log2(max(1, total / shard_bytes))))
    tokens, kinds = _corpus_size(texts, bits)

    def ask(table):
        import pyarrow as pa

        mine = Batch(table["text"].to_pylist(), table["learn"].to_pylist(), order)
        rows = [
            (table["batch"][0].as_py(), m, shard, _sent(grams[part]), _planes(own[part]))
            for m, (grams, own) in enumerate(zip(mine.grams, mine.own)) for shard, part in _ranges(grams, bits)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays(
            [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=["batch", "m", "shard", "hashes", "own"])

    def answer(table):
        import pyarrow as pa

        hashes = [_received(h) for h in table["hashes"].to_pylist()]
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate([_from_planes(o, np.uint32) for o in table["own"].to_pylist()])
        counts = np.bincount(which, weights=own, minlength=len(distinct)).astype(np.uint64)[which]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        return table.select(["batch", "m", "shard"]).append_column(
            "totals", pa.array([_planes(part) for part in np.split(counts, cuts)], pa.binary()))

    def score(table, answers):
        import pyarrow as pa

        mine = Batch(table["text"].to_pylist(), table["learn"].to_pylist(), order)
        answers = answers.sort_by("shard")
        of_order, parts = answers["m"].to_pylist(), answers["totals"].to_pylist()
        totals = [
            np.concatenate([_from_planes(p, np.uint64) for k, p in zip(of_order, parts) if k == m] or [np.empty(0, np.uint64)])
            for m in range(order)]
        if [len(t) for t in totals] != [len(g) for g in mine.grams]:
            raise RuntimeError("a batch of texts changed between its request and its answer")
        model = Automaton(mine, totals, tokens, kinds, prior)
        docs = range(len(mine.ends))
        return pa.table({
            "id": table["id"], "n_tokens": (mine.ends - mine.starts - 1),
            "n_known": pa.array([model.known(d) for d in docs], pa.int64()),
            "base_score": pa.array([model.base_score(d) for d in docs], pa.float64()),
            "score": pa.array([model.walk(d) for d in docs], pa.float64())})

    # One exchange of the texts, read by both the requests and the scoring; rows are dealt evenly.
    dealt = texts.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int")).repartition(batches, "batch")
    asked = dealt.groupBy("batch").applyInArrow(ask, "batch int, m int, shard int, hashes binary, own binary")
    answered = asked.groupBy("m", "shard").applyInArrow(answer, "batch int, m int, shard int, totals binary")
    id_type = texts.schema["id"].dataType.simpleString()
    scored = dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(
        score, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
