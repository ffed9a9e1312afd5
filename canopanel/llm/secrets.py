"""Secret scans: three fixed patterns, and a token-efficiency test that exposes random strings.

A byte-pair vocabulary spells ordinary words in few tokens, random strings in many: a run of
key characters with few characters per token is reported.  What a fixed pattern has already and
what is known by its form (digests, UUIDs, numbers) is cut out of the run first, and the rest is
tested.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import re
from pathlib import Path

from pyspark.sql import DataFrame

from canopanel.llm.common import bounded_batches, column, whole_text

# The three patterns of the base scan with the length each needs, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run long enough is the same match with the length in the pattern: shorter ones hold none.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LENGTH - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Runs that may be random: no dots, so that host names and sentences fall apart.
MIN_RANDOM = 8
WINDOW = 20  # longer runs are looked at in windows of this length as well
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_SEPARATORS = "+/_=-"
# Known by form, between separators or ends: digests of a usual length, UUIDs, numbers.
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:%s|%s|[0-9+/_=-]{4,})(?![A-Za-z0-9])" % (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in (32, 40, 48, 56, 64, 96, 128))))
_LETTERS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{%d,}(?![A-Za-z0-9])" % WINDOW)
# Words in capitals are spelled as in lower case, where the vocabulary knows them.
_CAPITALS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,}(?![A-Za-z0-9])")
# A run is spelled in parts of this length, so that the time for one is in proportion to it.
_SPELL = 4096
# Words have more characters per token than this in any language of Latin letters, if there are
# enough of them; single words may have fewer, so that a shorter run needs a lower ratio.
CHARS_PER_TOKEN = 2.4
SHORT_LIMITS = ((16, 2.0), (12, 1.7), (MIN_RANDOM, 1.5))  # from this length on, below WINDOW


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base scan, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _left(text: str, start: int, end: int, cuts: list[tuple[int, int]], least: int = WINDOW) -> list[tuple[int, int]]:
    """Pieces of at least ``least`` characters that ``cuts`` leave, without the separator at a cut."""
    out, at = [], start
    for s, e in [*sorted(cuts), (end, end)]:
        a = at + (at > start and text[at:at + 1] in _SEPARATORS)
        b = s - (a < s < end and text[s - 1] in _SEPARATORS)
        if b - a >= least:
            out.append((a, b))
        at = max(at, e)
    return out


def _low(tokens: list[str], ratio: float) -> bool:
    """Whether tokens have few characters; separators, which join words too, count for neither."""
    own = [len(t) for t in tokens if t.strip(_SEPARATORS)]
    return sum(own) < ratio * len(own)


def _low_windows(tokens: list[str], ratio: float) -> list[tuple[int, int]]:
    """Where windows of WINDOW characters or the next end of a token are low.

    They grow to the separators around them, so that a secret is whole, and are joined if they meet.
    """
    run = "".join(tokens)
    bounds = [0, *[i for i, c in enumerate(run) if c in _SEPARATORS], len(run)]
    out: list[tuple[int, int]] = []
    start, end, last = 0, 0, 0
    for first, token in enumerate(tokens):
        while last < len(tokens) and end - start < WINDOW:
            end += len(tokens[last])
            last += 1
        if end - start < WINDOW:
            break
        if _low(tokens[first:last], ratio):
            low, high = bounds[bisect.bisect_right(bounds, start, hi=len(bounds) - 1) - 1], bounds[bisect.bisect_left(bounds, end)]
            low += run[low] in _SEPARATORS
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        start += len(token)
    return out


def random_spans(text: str, spelled, base: list[tuple[int, int, int]], ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, 3, end) of places with fewer than ``ratio`` characters per token, outside base spans.

    ``spelled`` gives the tokens of a string.  A piece of a run is reported whole where its
    average is low, else its windows that are: words beside a secret do not hide it.  A long
    part of letters between separators is a word if its own average is not low.  A piece of under
    WINDOW characters is looked at as a whole, with the limit of its length (at most ``ratio``).
    """
    def tokens(start: int, end: int) -> list[str]:
        run = text[start:end] if end - start < WINDOW and text[start:end].islower() else _CAPITALS.sub(lambda w: w.group().lower(), text[start:end])
        if len(run) <= _SPELL:
            return spelled(run)
        return [t for at in range(0, len(run), _SPELL) for t in spelled(run[at:at + _SPELL])]

    out = []
    for m in _RUN.finditer(text):
        cuts = [(s, e) for s, _, e in base if s < m.end() and m.start() < e]
        cuts += [(m.start() + k.start(), m.start() + k.end()) for k in _KNOWN.finditer(m.group())]
        for start, end in _left(text, m.start(), m.end(), cuts, MIN_RANDOM):
            if end - start < WINDOW:
                limit = next(limit for length, limit in SHORT_LIMITS if end - start >= length)
                if _low(tokens(start, end), min(limit, ratio)):
                    out.append((start, 3, end))
                continue
            if _low(tokens(start, end), ratio):
                out.append((start, 3, end))
                continue
            parts = [(start + w.start(), start + w.end()) for w in _LETTERS.finditer(text[start:end])]
            words = [w for w in parts if not _low(tokens(*w), ratio)]
            for a, b in _left(text, start, end, words):
                out += [(a + s, 3, a + e) for s, e in _low_windows(tokens(a, b), ratio)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, separated by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, ratio: float = CHARS_PER_TOKEN,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex, n_random, base, spans.

    ``base`` and ``spans`` list places as kind:start:end.  ``ranks_path`` is a tiktoken rank
    file, read on the driver, ``pattern`` the pattern that goes with it.  A null text is empty
    and has no spans.  Rows are scanned one by one, so repeated rows, ties and null ids change
    nothing; other columns are not read.  A very long text is scanned whole, a very long run spelled
    in parts.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def scanned(batches):
        import base64

        import pyarrow as pa
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.value.splitlines() if line)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        merged = {rank: token.decode("latin-1") for token, rank in merges.items()}

        @functools.lru_cache(maxsize=1 << 16)  # words of usual length come again and again
        def spelled(run: str) -> list[str]:
            return [merged[t] for t in encoding.encode_ordinary(run)]

        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                spans = base + random_spans(text, spelled, base, ratio)
                counts = [sum(kind == k for _, kind, _ in spans) for k in range(len(KINDS))]
                for values, value in zip(columns, (*counts, joined(base), joined(spans))):
                    values.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(v, k) for v, k in zip(columns, kinds)]], names=["id", *names])

    names = ["n_assign", "n_access", "n_hex", "n_random", "base", "spans"]
    rows = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scanned, f"id {kind}, n_assign long, n_access long, n_hex long, n_random long, base string, spans string")
    return out.withColumnRenamed("id", id_col)
