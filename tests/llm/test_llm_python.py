"""Top-k, secrets, near copies, packing, token counts and language ID against brute force."""

import collections
import json
import random
import re
import string
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from canopanel.llm import language, near, packing, secrets, segments, token_counts, topk
from canopanel.llm.shingles import sets_of

SF = "/root/testdata/sf0.001"
BPE, UNIGRAM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "\n", "a", "a  b", "a\n\nb \n c", "x" * 70_000, "é ü 漢字 😀 ▁ a▁ b", "tab\tand\x1cother  spaces  ",
             "<|endoftext|> <s> <0x0A>", "it's we'll  \t\n x"]


# --- top-k ---------------------------------------------------------------------------------

def brute_top(rows, k, asked):
    vectors = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in vectors:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # one vector that is very common
    rows += [(2001, None), (None, rows[0][1]), (2003, [1.0, None]), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (2006, []), (2007, [scale])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, low int, qb string")
    found = topk.quantised(table)
    got = topk.exact_top_k(found, found.where(F.col("id") % 10 == 0), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    found = topk.quantised(table)
    assert sorted(map(tuple, topk.exact_top_k(found, found.where("id = 0"), 5).collect())) == [(0, 1, 1, 131072), (0, 2, 2, -196608)]
    assert topk.exact_top_k(found, found.where("id = 9"), 5).count() == 0
    assert topk.exact_top_k(found.where("id = 9"), found.where("id = 9"), 5).count() == 0


# --- secrets -------------------------------------------------------------------------------

def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m.group()) >= 32]
    return sorted(spans)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "token", "Secret: ", "API_KEY", "apikey='", "password", "=", ":", " ", '"', "abcdefgh12", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "x.y", "passwd = "]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == brute_base(text)


def test_random_strings_and_names(spark):
    rows = [
        (1, "key é k9Xq2LmZ7rTfB4wVpN8sYc3HdJ6gQaE1 end"), (2, "some_function_name_with_words and thatIsAnIdentifierInCamelCase"),
        (3, "d41d8cd98f00b204e9800998ecf8427e"), (4, "550e8400-e29b-41d4-a716-446655440000"), (5, "12345678901234567890-1234567890"),
        (6, None), (7, ""), (8, "token = 'k9Xq2LmZ7rTfB4wVpN8sYc3HdJ6gQaE1'"), (8, "donaudampfschifffahrtsgesellschaft " * 2000)]
    got = secrets.scan_secrets(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string"), RANKS, public_tokenizers.PATTERN)
    spans = sorted((r.doc_id, r.spans) for r in got.collect())
    assert spans == [(1, "random:6:38"), (2, ""), (3, "hex:0:32"), (4, ""), (5, ""), (6, ""), (7, ""), (8, ""), (8, "assign:0:41")]


def random_parts(spark, texts):
    """The random strings found in each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan_secrets(rows, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    spans = [[s.split(":") for s in r.spans.split(",")] if r.spans else [] for r in found]
    return [[t[int(a):int(b)] for kind, a, b in own if kind == "random"] for t, own in zip(texts, spans)]


def test_random_letters_are_secrets_too(spark):
    draw = random.Random(3)
    keys = ["".join(draw.choices(letters, k=32)) + digits for letters in (string.ascii_lowercase, string.ascii_uppercase)
            for digits in ("", "7", "2024") for _ in range(50)]
    assert random_parts(spark, keys) == [[k] for k in keys]
    names = ["configurationServiceConnectionFactory", "internationalization2024", "MAXIMUM_CONNECTION_RETRIES"]
    assert random_parts(spark, names) == [[], [], []]


def test_random_strings_beside_other_things(spark):
    draw = random.Random(4)

    def key(n, more=""):
        return "".join(draw.choices(string.ascii_letters + string.digits + more, k=n))

    digest = "".join(draw.choices("0123456789abcdef", k=32))
    access = "AKIA" + "".join(draw.choices(string.ascii_uppercase, k=16))
    for before, after in ((access + "/", ""), (digest + "-", ""), ("", "_" + digest), ("", "/" + digest.upper()), ("550e8400-e29b-41d4-a716-446655440000/", "")):
        keys = [key(40) for _ in range(50)]
        assert random_parts(spark, [before + k + after for k in keys]) == [[k] for k in keys]
    for n in (20, 24, 32):
        keys = [key(n) for _ in range(200)]
        found = random_parts(spark, ["config/production/database/credentials/" + k for k in keys])
        assert all(len(f) == 1 and f[0].endswith(k) for f, k in zip(found, keys))
    names = ["article/2019/05/21/some-words-in-a-title", "path/to/donaudampfschifffahrtsgesellschaft/index", digest + "/" + digest.upper()]
    assert random_parts(spark, names) == [[], [], []]


def test_base_spans_of_given_documents(spark):
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert secrets.base_spans(row.text) == brute_base(row.text)


# --- near copies ---------------------------------------------------------------------------

def shingles(text):
    words = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        own = members[find(i)]
        out.append((d, min((rows[j][0] for j in own if rows[j][0] is not None), default=None), len(own), links[i]))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    rows += [(100 + i, " ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))])) for i in range(90)]
    base = [word() for _ in range(120)]
    for i in range(80):  # a large class of near copies
        copy = list(base)
        copy[rng.randrange(120)] = word()
        rows.append((300 + i, " ".join(copy)))
    rows += [(500, rows[0][1].upper()), (501, rows[0][1]), (501, rows[0][1]), (502, None), (503, ""), (504, "!!"), (505, "a b"), (506, "A  b"),
             (None, rows[5][1]), (507, "one two three four five"), (508, "one two three four"), (3, rows[9][1])]
    return rows


@pytest.mark.parametrize("small,block", [(48, 1000), (6, 20)])
def test_near_classes(spark, small, block):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, paths string")
    got = near.near_classes(docs, small=small, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = near_rows()[:-1]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _t int, _own string")
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted({c if c is not None else d for (d, c, _, _) in brute_classes(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert near.near_dedup(docs.limit(0)).count() == 0


def test_runs_and_components(spark):
    assert near.runs_for(0.9999, 1) == 10 and near.runs_for(0.9999, 4) == 25 and near.runs_for(0.9999, 3) == 20
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)], "u long, v long")
    assert {tuple(r) for r in near.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def test_sets_match_words():
    texts = [*ODD_TEXTS, "A b C d e f g", "a b c d e " * 3, "ÉCOLE école"]
    assert [len(s) for s in sets_of(pa.array(texts))] == [len(shingles(t)) for t in texts]


# --- packing -------------------------------------------------------------------------------

def check_packed(rows, got, size=1024):
    tokenizer = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for d, t in rows:
        want[(d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]))] += 1
    windows = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, tuple(ids)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0 and at < size
    assert sum(n for _, ids in want.elements() for n in [len(ids)]) == sum(r.length for r in got)
    for (d, ids), n in want.items():
        for start, part in pieces[(d, len(ids))]:
            if n == 1 and sum(1 for (e, x) in want if (e, len(x)) == (d, len(ids))) == 1:
                assert ids[start:start + len(part)] == part
    return windows


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").coalesce(2)
    got = packing.pack(table, BPE).collect()
    windows = check_packed(rows, got)
    assert len(windows) < sum(r.length for r in got) / 1024 + 2 * 11 + 2
    check_packed(rows, packing.pack(table, BPE, size=64, max_open=3).collect(), 64)
    assert packing.pack(table.limit(0), BPE).count() == 0


def test_sum_of_squares_rule():
    rng, packer, counts = random.Random(0), packing.SumOfSquares(32, 10**6), [0] * 33
    for i in range(500):
        n = rng.randrange(1, 32)
        change = {}
        for level in range(0, 33 - n):
            if level == 0 or counts[level]:
                after = list(counts)
                if level:
                    after[level] -= 1
                if level + n < 32:
                    after[level + n] += 1
                change[level] = sum(c * c for c in after[1:32])
        best = min(change.values())
        level = max(x for x, v in change.items() if v == best)
        assert packer.level_for(n) == level
        list(packer.put(i, np.zeros(n, dtype=np.uint32)))
        if level:
            counts[level] -= 1
        if level + n < 32:
            counts[level + n] += 1
        assert counts[1:32] == [len(w) for w in packer.windows[1:]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t\r\x1c\x85  !1's"), max_size=40))
def test_segments_keep_tokens(text):
    tokenizer = Tokenizer.from_file(BPE) if not hasattr(test_segments_keep_tokens, "tok") else test_segments_keep_tokens.tok
    test_segments_keep_tokens.tok = tokenizer
    parts = segments.segments(text)
    assert "".join(parts) == text
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    if not hasattr(test_segments_keep_tokens, "coder"):
        test_segments_keep_tokens.coder = segments.ByteBpe(Path(BPE).read_bytes(), limit=20)
    assert np.frombuffer(test_segments_keep_tokens.coder.encode(text), dtype="<u4").tolist() == whole
    assert [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids] == whole


def test_ids_are_the_tokenizers():
    """On given documents and odd texts, by ranks as well as by the library's own merges."""
    tokenizer, model = Tokenizer.from_file(BPE), Path(BPE).read_bytes()
    coder = segments.ByteBpe(model)
    texts = [t or "" for t in ODD_TEXTS] + pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    for text in texts:
        assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    other = json.loads(model)
    other["normalizer"] = {"type": "Lowercase"}
    assert segments.bpe_coder(json.dumps(other).encode())("ABC Def") == tokenizer.encode("abc def", add_special_tokens=False).ids


# --- token counts --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def unigram():
    vocabulary = token_counts.vocabulary(UNIGRAM)
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return tokenizer


def test_token_counts_are_the_tokenizers(spark, unigram):
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 10_000] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "y")], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, UNIGRAM)
    assert got.columns == [*docs.columns, "n_tokens_"]
    counts = {r.doc_id: r.n_tokens_ for r in got.collect()}
    assert counts == {i: len(unigram.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), UNIGRAM, carry=["doc_id"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab▁", min_size=1, max_size=4), st.integers(-6, 0)), min_size=1, max_size=12), st.text(alphabet="abc \n", max_size=30))
def test_viterbi_ties(pieces, text):
    vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + [(p, float(s)) for p, s in dict(pieces).items()]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    viterbi = token_counts.CountOnlyViterbi(vocabulary)
    marked = token_counts.marked(text)
    want = len(tokenizer.encode(text).ids)
    assert viterbi.count(marked) == want
    assert sum(viterbi.count(s) for s in viterbi.segments(marked)) == want


# --- language ------------------------------------------------------------------------------

def test_gradient_is_the_finite_difference():
    rng = np.random.default_rng(3)
    tagger = language.ByteTagger(["a", "b", "c"], 3, rng)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    windows = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    mask = (rng.random((6, 5)) < 0.8).astype(np.float64)
    truth = np.array([0, 1, 2, 1, 0])
    run = tagger._run
    tagger._run = lambda side, w, keep=None: _exact_run(tagger, side, w, keep)
    del run
    _, grad = tagger.loss_and_gradient(windows, mask, truth)
    for name, values in tagger.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name.startswith("in_"):
                at = (at[0], int(windows[rng.integers(0, 6), rng.integers(0, 5)]))
            old, e = values[at], 1e-6
            values[at] = old + e
            up = tagger.loss_and_gradient(windows, mask, truth)[0]
            values[at] = old - e
            down = tagger.loss_and_gradient(windows, mask, truth)[0]
            values[at] = old
            assert abs((up - down) / (2 * e) - grad[name][at]) < 1e-6, name


def _exact_run(tagger, side, windows, keep=None):
    """The recurrence written out in double precision."""
    w, h = tagger.weights, tagger.hidden
    state, out = np.zeros((h, windows.shape[1])), np.zeros((len(windows), h, windows.shape[1]))
    for t in range(len(windows)) if side == "f" else reversed(range(len(windows))):
        own, back = w[f"in_{side}"][:, windows[t]], w[f"rec_{side}"] @ state
        reset, update = (1 / (1 + np.exp(-(own[i * h:(i + 1) * h] + back[i * h:(i + 1) * h]))) for i in range(2))
        candidate = np.tanh(own[2 * h:] + reset * back[2 * h:])
        if keep is not None:
            keep.append((t, state, reset, update, candidate, back[2 * h:]))
        state = update * state + (1 - update) * candidate
        out[t] = state
    return out


def test_forward_pass_is_the_recurrence():
    rng = np.random.default_rng(4)
    tagger = language.ByteTagger(["a", "b"], 4, rng)
    windows = rng.integers(0, 256, (10, 7)).astype(np.uint8)
    for side in "fb":
        assert np.allclose(tagger._run(side, windows), _exact_run(tagger, side, windows), atol=1e-5)


def test_pooling_covers_whole_texts():
    tagger = language.ByteTagger(["a", "b"], 4, np.random.default_rng(0))
    text = "some text that is longer than a window " * 9
    names, scores = tagger.classify([text, "", None, "x"], window=16, at_once=3)
    data = text.encode()
    p = np.zeros(2)
    for at in range(0, len(data), 16):
        part = data[at:at + 16]
        padded = np.frombuffer(part + bytes(16 - len(part)), dtype=np.uint8)[:, None]
        p += tagger.position_probabilities(padded)[:len(part), :, 0].sum(axis=0)
    p /= len(data)
    assert names[0] == "ab"[p.argmax()] and abs(scores[0] - p.max()) < 1e-6
    assert names[1:3] == ["und", "und"] and scores[1:3] == [0.0, 0.0]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "z", 1), (90_002, "123 !!", "en", "z", 1), (90_003, "", None, "z", 1), (None, "the and of", "en", "z", 1)], docs.schema)
    tagger = language.train(docs, language.Settings(steps=150))
    found = language.identify(docs.unionByName(odd).withColumn("score", F.lit("own")), tagger)
    assert found.columns[-2:] == ["lang_pred", "score_"]
    rows = found.withColumn("held", language.held_out("doc_id")).collect()
    scored = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 90_000]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in rows if r.doc_id is not None)
    assert len(scored) > 100 and sum(r.lang == r.lang_pred for r in scored) > 0.97 * len(scored)
    assert all(0 <= r.score_ <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (90_001, 90_002, 90_003)} == {"und"}


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language.train(docs) is None
    assert [tuple(r)[-2:] for r in language.identify(docs, None).collect()] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), None, carry=["doc_id"]).count() == 0
