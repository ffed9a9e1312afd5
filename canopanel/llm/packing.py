"""Packing documents into token windows with the sum-of-squares rule.

Tokens of a document are its ids and an end id.  Whole windows are cut off first; what is left,
shorter than a window, is placed online: of the fill levels it fits into, the one that makes
the sum over levels of (number of windows at that level) squared smallest.  Counts per level
are one array, so a placement is a subtraction and a minimum.  Each task packs the documents of
its partition in their order and holds only windows that are not yet full.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from canopanel.llm.common import bounded_batches, column, whole_text
from canopanel.llm.segments import ByteBpe

WINDOW = 1024
# Windows a task may hold open; beyond it the fullest ones are filled up from each other.
MAX_OPEN = 4096
_TASK_SHIFT = 33  # sequence ids: the task's number above, its windows below


class SumOfSquares:
    """Places pieces online; ``put`` and ``close`` yield finished windows as lists of pieces.

    A piece is (document, start, ids).  Where over ``max_open`` windows are open, an eighth of them,
    the fullest, are poured into each other, cutting pieces: they lose the least by it, and the rule goes
    on for all other levels.  ``close`` pours all that are open, and cuts the last rest into powers of two.
    """

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open, self.n_open = size, max_open, 0
        self.windows: list[list[list]] = [[] for _ in range(size)]
        # What the sum of squares gains when a window comes to a level, and loses when it goes.
        self.gain = np.ones(size + 1, dtype=np.int64)
        self.gain[size] = 0
        self.loss = np.full(size + 1, -(1 << 40), dtype=np.int64)
        self.loss[0] = 0

    def _count(self, level: int) -> None:
        n = len(self.windows[level])
        self.gain[level] = 2 * n + 1
        self.loss[level] = 2 * n - 1 if n else -(1 << 40)

    def level_for(self, length: int) -> int:
        """The fill level to put ``length`` ids on (0: a new window); ties go to the fullest."""
        change = self.gain[length:] - self.loss[:self.size + 1 - length]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def put(self, document: int, ids: np.ndarray) -> Iterator[list]:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            yield [(document, at, ids[at:at + self.size])]
        if whole == len(ids):
            return
        rest = ids[whole:].copy() if whole else ids
        level = self.level_for(len(rest))
        if level:
            window = self.windows[level].pop()
            self._count(level)
            self.n_open -= 1
        else:
            window = []
        window.append((document, whole, rest))
        level += len(rest)
        if level == self.size:
            yield window
            return
        self.windows[level].append(window)
        self._count(level)
        self.n_open += 1
        if self.n_open > self.max_open:
            rest, held = yield from self._pour(max(2, self.max_open // 8))
            if held:
                self.windows[held].append(rest)
                self._count(held)
                self.n_open += 1

    def _pour(self, many: int) -> Iterator[list]:
        """Empty the ``many`` fullest windows into full ones; what is left, and how much, is returned."""
        window, held = [], 0
        for level in range(self.size - 1, 0, -1):
            while self.windows[level] and many:
                many -= 1
                self.n_open -= 1
                for document, start, ids in self.windows[level].pop():
                    while len(ids):
                        part = ids[:self.size - held]
                        window.append((document, start, part))
                        start, ids, held = start + len(part), ids[len(part):], held + len(part)
                        if held == self.size:
                            yield window
                            window, held = [], 0
            self._count(level)
        return window, held

    def close(self) -> Iterator[list]:
        window, held = yield from self._pour(self.n_open)
        while held:
            room = 1 << (held.bit_length() - 1)
            held, taken = held - room, []
            while room:
                document, start, ids = window[0]
                taken.append((document, start, ids[:room]))
                if len(ids) > room:
                    window[0] = (document, start + room, ids[room:])
                else:
                    window.pop(0)
                room -= min(room, len(ids))
            yield taken


def pack(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: the id, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` is a ``tokenizers`` JSON file, read on the driver; no special tokens are
    added.  ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.  Every
    sequence has ``size`` ids, but for those at the end of a task, which have powers of two.
    Null texts are empty: their documents have the end id only.  Every row is a document of its
    own, also one that repeats another's id.  Null ids are allowed.  Whole windows of a very long text
    are cut off as they are met.  An empty table gives no
    rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def packed(batches):
        import pyarrow as pa

        coder = ByteBpe(model.value)
        end = np.array([end_id], dtype="<u4")
        packer = SumOfSquares(size, max_open)
        first = TaskContext.get().partitionId() << _TASK_SHIFT
        names: dict[int, tuple] = {}  # documents with pieces in open windows: id and tokens
        state = {"sequence": 0, "document": 0}
        columns: list[list] = [[] for _ in range(7)]

        def emit(window):
            offset = 0
            for document, start, ids in window:
                name, total = names[document]
                row = (name, start, len(ids), ids.tobytes(), total, first + state["sequence"], offset)
                for values, value in zip(columns, row):
                    values.append(value)
                offset += len(ids)
            state["sequence"] += 1

        def flush():
            arrays = [pa.array(values, type=kind) for values, kind in zip(columns, kinds)]
            for values in columns:
                values.clear()
            if packer.n_open == 0:
                names.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.concatenate([np.frombuffer(coder.encode(text.as_py()), dtype="<u4"), end])
                names[state["document"]] = (name, len(ids))
                for window in packer.put(state["document"], ids):
                    emit(window)
                state["document"] += 1
                if len(columns[0]) >= 2000:
                    yield flush()
                    held = {piece[0] for level in packer.windows for window in level for piece in window}
                    for gone in [d for d in names if d not in held]:
                        del names[gone]
        for window in packer.close():
            emit(window)
        if columns[0]:
            yield flush()

    rows = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(packed, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
