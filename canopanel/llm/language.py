"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of 64; in each a GRU reads forward, another backward,
and every byte gets a distribution over languages from both states.  A document's distribution
is the mean over all its bytes.  The network is small enough for numpy: it is trained on the
driver, by backpropagation through time and Adam, on a bounded sample of windows, and applied
to whole texts in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopanel.cluster import stored
from canopanel.llm.common import bounded_batches, column, fresh

UNDETERMINED = "und"
FOLDS = 5  # rows of fold 0 are held out: no part of them is learned from


@dataclass
class Settings:
    """Bounds of the training sample, and of the network and its training."""

    sample_docs: int = 4000  # labelled documents in the sample, shared evenly among languages, but
    least_docs: int = 20  # so many of each language at least
    windows_per_doc: int = 6
    window: int = 64
    hidden: int = 8  # units of each direction for up to four languages; four more whenever they double
    batch: int = 256
    steps: int = 500
    rate: float = 0.01
    seed: int = 0


def held_out(id_col: str):
    """Whether a row is in fold 0: CRC-32 of its id as text, modulo 5 (null ids: held out)."""
    fold = F.crc32(column(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class ByteTagger:
    """Two GRUs and a softmax; arrays are (features, windows), one step per byte."""

    def __init__(self, languages: list[str], hidden: int, rng: np.random.Generator | None = None):
        self.languages, self.hidden, n = languages, hidden, len(languages)
        rng = rng or np.random.default_rng(0)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
        # Per direction: input of each byte to (reset, update, candidate), and the recurrent weights.
        self.weights = {}
        for side in "fb":
            self.weights |= {
                f"in_{side}": (rng.normal(0, 0.3, (3 * hidden, 256))).astype(np.float32),
                f"rec_{side}": draw(3 * hidden, hidden), f"out_{side}": draw(n, hidden)}
        self.weights["bias"] = np.zeros((n, 1), dtype=np.float32)

    def _run(self, side: str, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte, (steps, hidden, windows), in the order of the text."""
        w, h = self.weights, self.hidden
        table, rec = w[f"in_{side}"], w[f"rec_{side}"]
        steps, n = windows.shape
        states = np.empty((steps, h, n), dtype=np.float32)
        state = np.zeros((h, n), dtype=np.float32)
        own, back = np.empty((3 * h, n), dtype=np.float32), np.empty((3 * h, n), dtype=np.float32)
        for t in range(steps) if side == "f" else reversed(range(steps)):
            np.take(table, windows[t], axis=1, out=own, mode="clip")
            np.matmul(rec, state, out=back)
            gates = own[:2 * h]
            gates += back[:2 * h]
            _sigmoid(gates)
            reset, update = gates[:h], gates[h:]
            candidate = reset * back[2 * h:]
            candidate += own[2 * h:]
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep.append((t, state, reset.copy(), update.copy(), candidate, back[2 * h:].copy()))
            new = states[t]
            np.subtract(state, candidate, out=new)
            new *= update
            new += candidate
            state = new
        return states

    def logits(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(steps, languages, windows) for byte windows of (steps, windows)."""
        total = None
        for side in "fb":
            kept = None if keep is None else keep.setdefault(side, [])
            states = self._run(side, windows, kept)
            if keep is not None:
                keep[f"states_{side}"] = states
            part = np.matmul(self.weights[f"out_{side}"], states)
            total = part if total is None else total + part
        return total + self.weights["bias"]

    def position_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.logits(windows)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def loss_and_gradient(self, windows: np.ndarray, mask: np.ndarray, truth: np.ndarray):
        """Mean cross-entropy of all unmasked bytes, and its gradient by backpropagation through time."""
        w, h = self.weights, self.hidden
        keep: dict = {}
        z = self.logits(windows, keep)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        n, cols = max(mask.sum(), 1), np.arange(len(truth))
        loss = -(np.log(np.maximum(p[:, truth, cols], 1e-12)) * mask).sum() / n
        p[:, truth, cols] -= 1
        p *= (mask / n)[:, None, :]
        grad = {"bias": p.sum(axis=(0, 2))[:, None]}
        for side in "fb":
            grad[f"out_{side}"] = np.einsum("tcn,thn->ch", p, keep[f"states_{side}"], optimize=True)
            from_out = np.matmul(w[f"out_{side}"].T, p)
            rec = w[f"rec_{side}"]
            g_in, g_rec = np.zeros_like(w[f"in_{side}"]), np.zeros_like(rec)
            g_state = np.zeros_like(from_out[0])
            for t, state, reset, update, candidate, back in reversed(keep[side]):
                g_new = g_state + from_out[t]
                g_candidate = g_new * (1 - update) * (1 - candidate * candidate)
                g_update = g_new * (state - candidate) * update * (1 - update)
                g_reset = g_candidate * back * reset * (1 - reset)
                g_own = np.concatenate([g_reset, g_update, g_candidate])
                g_back = np.concatenate([g_reset, g_update, g_candidate * reset])
                for row in range(3 * h):
                    g_in[row] += np.bincount(windows[t], weights=g_own[row], minlength=256)
                g_rec += g_back @ state.T
                g_state = g_new * update + rec.T @ g_back
            grad |= {f"in_{side}": g_in, f"rec_{side}": g_rec}
        return float(loss), grad

    def fit(self, windows: np.ndarray, mask: np.ndarray, truth: np.ndarray, settings: Settings) -> list[float]:
        """Adam on batches in which every language has the same share; the losses by step."""
        rng = np.random.default_rng(settings.seed)
        by_language = [np.flatnonzero(truth == c) for c in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, settings.steps + 1):
            share = -(-settings.batch // len(by_language))
            chosen = np.concatenate([rng.choice(own, share) for own in by_language])
            loss, grad = self.loss_and_gradient(windows[:, chosen], mask[:, chosen], truth[chosen])
            rate = settings.rate * min(1.0, 2 * (1 - (step - 1) / settings.steps))
            for k, g in grad.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(loss)
        return losses

    def classify(self, texts: list[str | None], window: int, at_once: int | None = None) -> tuple[list[str], list[float]]:
        """The language and its probability for each text; null or empty ones are undetermined."""
        # Windows at once, so that probabilities of all their bytes and languages stay under 16 MB.
        at_once = at_once or max(16, min(4096, (1 << 22) // (window * len(self.languages))))
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        n_windows = -(-lengths // window)
        pooled = np.zeros((len(data), len(self.languages)))
        owner = np.repeat(np.arange(len(data)), n_windows)
        padded = np.frombuffer(b"".join(d + bytes(-len(d) % window) for d in data), dtype=np.uint8).reshape(-1, window)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        held = np.minimum(lengths[owner] - nth * window, window)
        for at in range(0, len(owner), at_once):
            part = slice(at, at + at_once)
            p = self.position_probabilities(np.ascontiguousarray(padded[part].T))
            if held[part].min() < window:
                p *= (np.arange(window)[:, None] < held[part])[:, None, :]
            sums = p.sum(axis=0, dtype=np.float64)
            for c in range(len(self.languages)):
                pooled[:, c] += np.bincount(owner[part], weights=sums[c], minlength=len(data))
        share = pooled / np.maximum(lengths, 1)[:, None]
        best = share.argmax(axis=1)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, lengths)]
        return names, [float(min(1.0, share[i, b])) if lengths[i] else 0.0 for i, b in enumerate(best)]


def _training_windows(sample: DataFrame, settings: Settings) -> DataFrame:
    """(lang, bytes): windows at places of the whole texts that a seeded draw decides."""
    def cut(frames):
        import zlib

        import pandas as pd

        for frame in frames:
            out = []
            for key, lang, text in zip(frame["key"], frame["lang"], frame["text"]):
                data = text.encode("utf-8", "replace")
                n = -(-len(data) // settings.window)
                rng = np.random.default_rng([settings.seed, zlib.crc32(str(key).encode())])
                for i in sorted(rng.choice(n, min(n, settings.windows_per_doc), replace=False)):
                    out.append((key, lang, data[i * settings.window:(i + 1) * settings.window]))
            yield pd.DataFrame(out, columns=["key", "lang", "bytes"])

    return sample.mapInPandas(cut, "key long, lang string, bytes binary")


def train(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> ByteTagger | None:
    """A tagger learned from labelled rows outside fold 0, or None where there are none.

    Every label is learned, from at most ``sample_docs`` rows shared among them or ``least_docs`` of
    each, whichever is more.  A language's rows are sampled by a hash of the id, so the sample does not
    depend on how the table is partitioned.  Rows without label, text or a letter are not learned
    from; repeated rows may be drawn each.  Of a very long text windows all over it are learned from.
    """
    settings = settings or Settings()
    labelled = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang")).where(
        ~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    n_languages = counts.count()
    if not n_languages:
        return None
    quota = max(settings.least_docs, settings.sample_docs // n_languages)
    # Twice the quota passes on average; the window then takes exactly the first by hash.
    shares = counts.select("lang", F.least(F.lit(1.0), 2 * quota / F.col("n")).alias("share"))
    key = F.xxhash64(F.lit(settings.seed), "id", "text")
    sample = labelled.withColumn("key", key).join(shares, "lang").where(
        (F.col("key").cast("double") / float(1 << 64) + 0.5) < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    sample = sample.withColumn("nth", nth).where(F.col("nth") <= quota).select("key", "lang", "text")
    rows = _training_windows(sample, settings).orderBy("lang", "key", "bytes").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    data = rows.column("bytes").to_pylist()
    windows = np.zeros((settings.window, len(data)), dtype=np.uint8)
    mask = np.zeros((settings.window, len(data)), dtype=np.float32)
    for i, d in enumerate(data):
        windows[:len(d), i] = np.frombuffer(d, dtype=np.uint8)
        mask[:len(d), i] = 1
    truth = np.searchsorted(languages, rows.column("lang").to_pylist())
    hidden = settings.hidden + 4 * max(0, (len(languages) - 1).bit_length() - 2)
    tagger = ByteTagger(languages, hidden, np.random.default_rng(settings.seed))
    tagger.fit(windows, mask, truth, settings)
    return tagger


def identify(docs: DataFrame, tagger: ByteTagger | None, window: int = 64, text_col: str = "text",
             lang_col: str = "lang_pred", score_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, unless given), the language of each whole text, its probability.

    A null text, one without a letter, and every text where no language was learned are
    ``und`` with score 0.  Only the text decides, so repeated rows get one answer; of languages equally
    likely the first by name is given.  A text of any length is classified whole, window by window.  Columns of the same names stay, the new ones
    then have longer names.  An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    pred, score = fresh(docs, lang_col, score_col)
    letters, = fresh(docs, "_letters")
    carry = docs.columns if carry is None else carry

    def batches_of(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores = [], []
            texts = batch.column(len(carry))
            for at in range(0, len(texts), 256):
                part = texts[at:at + 256].to_pylist()
                if tagger is None:
                    known, sure = [UNDETERMINED] * len(part), [0.0] * len(part)
                else:
                    known, sure = tagger.classify(part, window)
                names += known
                scores += sure
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*carry, pred, score])

    # The text as far as it has a letter; null otherwise.
    seen = docs.select(*[column(c) for c in carry], F.when(column(text_col).rlike(r"\p{L}"), column(text_col)).alias(letters))
    schema = T.StructType([*seen.schema.fields[:len(carry)], T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return seen.mapInArrow(batches_of, schema)
