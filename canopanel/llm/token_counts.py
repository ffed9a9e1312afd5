"""Token counts under a unigram vocabulary without building tokens: a count-only Viterbi.

The best segmentation of a text is the one of the highest sum of piece scores.  An Aho-Corasick
automaton reports all pieces that end at a character, longest first; the best score to that
character and the number of pieces on that path are all that is carried on.  Ties go to the
piece that starts earliest, as in the ``tokenizers`` library's unigram model; a character that
no piece of its own covers costs the lowest score less ten and counts its UTF-8 bytes (byte
fallback).  A space is the mark U+2581, and a text that is not empty begins with one more.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopanel.llm.common import bounded_batches, column, fresh, whole_text
from canopanel.llm.segments import SegmentCache

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class CountOnlyViterbi:
    """Counts pieces of marked texts; ``count`` is exact for any text, however long."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        # Texts may be cut before a run of marks and line feeds unless a piece goes across.
        across = re.compile(f"[^{MARK}\n][{MARK}\n]")
        self.may_cut = not any(across.search(piece) for piece, _ in pieces)

    def segments(self, text: str) -> list[str]:
        """A marked text cut where no piece can cross; scores and ties of the parts do not change."""
        if not self.may_cut:
            return [text] if text else []
        return re.findall(f"[{MARK}\n]+[^{MARK}\n]*|[^{MARK}\n]+", text)

    def counter(self, limit: int = 200_000):
        """A function that counts the tokens of a text; segments met before are not counted anew."""
        words = SegmentCache(lambda new: [self.count(MARK + s) for s in new], limit)
        others = SegmentCache(lambda new: [self.count(s) for s in new], limit)

        def tokens(text: str) -> int:
            # A mark for each space, one between words: then every word is a segment.
            if text and self.may_cut and text[0] != " " and "  " not in text and MARK not in text:
                return sum(words.results(text.split(" ")))
            return sum(others.results(self.segments(marked(text))))

        return tokens

    def count(self, text: str) -> int:
        scores, counts = [0.0], [0]
        best, pieces, single, at = None, 0, False, 0

        def close():
            """The end of character ``at`` is done: the path over it alone comes last."""
            nonlocal best, pieces, single, at
            if not single:
                alone = scores[at] + self.unknown
                if best is None or alone > best:
                    best, pieces = alone, counts[at] + len(text[at].encode("utf-8", "replace"))
            scores.append(best)
            counts.append(pieces)
            best, single, at = None, False, at + 1

        for end, (length, score) in self.automaton.iter(text):
            while at < end:
                close()
            through = scores[end + 1 - length] + score
            if best is None or through > best:
                best, pieces = through, counts[end + 1 - length] + 1
            single = single or length == 1
        while at < len(text):
            close()
        return counts[-1]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", count_col: str = "n_tokens",
                 carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, unless given) and the number of tokens of each whole text.

    ``vocabulary_path`` is read on the driver.  Null and empty texts have 0 tokens.  Rows are
    counted one by one, so repeated rows and ties change nothing.  A column called n_tokens
    stays and makes the new one's name longer.  An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    text, n = fresh(docs, "_text", count_col)
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def counted(batches):
        import pyarrow as pa

        tokens = CountOnlyViterbi(pieces.value).counter()
        for batch in batches:
            counts = [tokens(t.as_py()) for t in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], pa.array(counts, pa.int64())], names=[*carry, n])

    read = docs.select(*[column(c) for c in carry], whole_text(text_col).alias(text))
    schema = T.StructType([*read.schema.fields[:len(carry)], T.StructField(n, T.LongType())])
    return read.mapInArrow(counted, schema)
