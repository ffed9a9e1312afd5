"""Texts cut where no token can cross, so that each distinct segment is worked on once.

Both tokenizers used here never join a character that is not white space with a space after it
into one token.  A segment is such a stretch: a space, then everything up to the next one.
Results per segment are kept in a dictionary of bounded size; a text's result is put together
from those of its segments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

# White space right before a space: the cut must then come before all of it.
_SPACES = re.compile(r"\s ")
_CAREFUL = re.compile(r"(?<=\S)(?= )")

# Fixed value: the pattern by which byte-level vocabularies of this family split a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def segments(text: str) -> list[str]:
    """The segments of ``text``; joined they are the text."""
    if _SPACES.search(text):
        return [s for s in _CAREFUL.split(text) if s]
    first, *others = text.split(" ")
    return [first, *[" " + s for s in others]]


class SegmentCache:
    """Results of segments: ``work`` maps a list of new segments to their results.

    The first ``limit`` segments are remembered; others are worked on whenever they come.
    """

    def __init__(self, work: Callable[[list[str]], Iterable], limit: int = 200_000):
        self.work, self.limit, self.known = work, limit, {}

    def results(self, parts: list[str]) -> list:
        """The results of segments in order."""
        known = self.known
        new = list(set(parts).difference(known))
        if new:
            known.update(zip(new, self.work(new)))
        found = list(map(known.__getitem__, parts))
        if len(known) > self.limit:
            for part in new:
                del known[part]
        return found


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the others in order for 256 and up.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def bpe_coder(model: bytes) -> Callable[[str], list[int]]:
    """Text to ids under a ``tokenizers`` file, as that library gives them without special tokens added.

    A byte-level file whose merges are in the order of their ids is a rank table, which
    tiktoken applies about four times as fast, with the same ids; any other file is left to
    ``tokenizers``.
    """
    described = json.loads(model)
    split, inner = described.get("pre_tokenizer") or {}, described["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in inner.get("merges", [])]
    vocabulary, special = inner["vocab"], {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    ranked = (
        inner["type"] == "BPE" and described.get("normalizer") is None and not inner.get("ignore_merges")
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(inner.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in described.get("added_tokens", [])))
    if not ranked:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(model)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def coded(text: str) -> list[int]:
        if "<|" in text or any(s in text for s in special):
            return encoding.encode(text, allowed_special="all", disallowed_special=())
        return encoding.encode_ordinary(text)

    return coded


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, model: bytes, limit: int = 200_000):
        import numpy as np

        self.np, self.code = np, bpe_coder(model)
        described = json.loads(model)["model"]["vocab"]
        mark = next(c for c, b in byte_alphabet().items() if b == ord(" "))
        self.after_space = np.zeros(max(described.values()) + 1, dtype=bool)
        self.after_space[[i for token, i in described.items() if token.startswith(mark)]] = True
        self.whole = SegmentCache(lambda new: [self._ids(s).tobytes() for s in new], limit)
        self.spaced = SegmentCache(self._words, limit)

    def _ids(self, text: str):
        return self.np.array(self.code(text), dtype="<u4")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it, from one text: only a word's first token begins with it."""
        plain = [w for w in words if w and not w[-1].isspace()]
        found = {}
        if plain:
            ids = self._ids(" " + " ".join(plain))
            starts = self.np.flatnonzero(self.after_space[ids])
            if len(starts) == len(plain):
                data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                found = dict(zip(plain, [data[a:b] for a, b in zip((4 * starts).tolist(), ends)]))
        return [found[w] if w in found else self._ids(" " + w).tobytes() for w in words]

    def encode(self, text: str) -> bytes:
        if _SPACES.search(text):
            return b"".join(self.whole.results(segments(text)))
        first, *others = text.split(" ")
        return b"".join([*self.whole.results([first]), *self.spaced.results(others)])
