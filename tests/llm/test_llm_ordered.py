"""Merkle manifest, conversation repair and language-model scores against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopanel.llm import conversations as conv
from canopanel.llm import merkle, scoring

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, X0 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Merkle manifest -------------------------------------------------------------------

def framed(values):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def climb(level):
    """All levels of a tree from its leaves' digests."""
    levels = [level]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        if place ^ 1 < len(level):
            out.append(("L" if place & 1 else "R", level[place ^ 1]))
        else:
            out.append(("-", None))
        place >>= 1
    return out


def refold(leaf, path):
    for side, digest in path:
        leaf = sha(digest + leaf if side == "L" else leaf + digest if side == "R" else leaf)
    return leaf


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof digest, root folded from leaf), sorted."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], framed(row[:5])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([d for _, d in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        ordered = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for place, (doc_id, leaf) in enumerate(ordered):
            path = siblings(trees[g], place) + siblings(top, k)
            proof = sha("".join(d for side, d in path if side != "-"))
            assert refold(leaf, path) == top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof))
    return sorted(out, key=str)


def manifest_rows(spark, rows, levels):
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), levels=levels)
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")),
                       merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r[5] == r[3] for r in out)
    return sorted((tuple(r)[:5] for r in out), key=str)


def some_docs(n, seed=0):
    rng = random.Random(seed)
    lang = lambda: rng.choice(["en", "en", "en", "de", None, "é", "Z", ""])
    rows = [(i, rng.choice(["web", None]), lang(), rng.choice([None, 5]), rng.choice([None, "", "ü x", "t" * 5000]), "x", 1, "y")
            for i in range(n)]
    return rows + [(None, "a", "en", 1, "null id", None, None, None)] * 2 + rows[:9] + [(3, "a", "en", 1, "tie", "", 0, "")]


@pytest.mark.parametrize("n, levels", [(1, 10), (70, 2), (70, 10), (33, 1)])
def test_manifest_equals_brute_force(spark, n, levels):
    """Nulls in every column, empty texts, repeated rows and ids, clashing columns, trees of several rounds."""
    rows = some_docs(n)
    assert manifest_rows(spark, rows, levels) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    row = (7, "s", "en", 3, "abc", "", 0, "")
    (doc_id, leaf, subroot, root, proof), = manifest_rows(spark, [row], 10)
    assert leaf == subroot == root == framed(row[:5]) and proof == sha("")
    assert manifest_rows(spark, [], 10) == []


def test_a_changed_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame(some_docs(40), DOCS)
    changed = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    found = merkle.manifest(docs, extra={"changed": changed, "n": F.col("n_chars")})
    rows = found.select("n", (merkle.fold(F.col("changed"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert all(r["same"] == (r["n"] is None) for r in rows) and len({r["same"] for r in rows}) == 2


def test_heap_and_reverse_sweep_on_one_block():
    digests = [bytes([i]) * 32 for i in range(5)]
    known = merkle.forward(8, digests, 3)
    assert sorted(known[0]) == [8, 9, 10, 11, 12] and known[1][6] == merkle.parent_digest([digests[4]])
    proof = merkle.backward(known, b"")
    assert proof[12][:1] == merkle.ALONE and proof[9] == b"L" + digests[0] + b"R" + known[1][5] + b"R" + known[2][3]


# ---- conversation repair ---------------------------------------------------------------

SAID = "conv_id long, turn long, role string, text string, pos int, Block string"


def brute_repair(rows):
    """The report and repaired lines of one conversation, by a table of best letters per state."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], hashlib.md5(row[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    after = lambda s: "a" if s == "u" else "u"  # noqa: E731  the initial that may be inserted behind s
    ways = {"": (0, "", ())}

    def insertions(ways):
        for _ in range(2):
            for s, (c, a, out) in list(ways.items()):
                z, way = after(s), (c + 5, a + "I", (*out, (after(s), "")))
                if z not in ways or way[:2] < ways[z][:2]:
                    ways[z] = way
        return ways

    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        # Each way with its insertions is offered on its own, or a longer prefix could hide a better one.
        for s0, way0 in ways.items():
            for s, (c, a, out) in insertions({s0: way0}).items():
                offer(s, (c + 2, a + "D", out))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                first = role[:1]
                if (first == "s" and s == "") or (first == "u" and s != "u") or (first == "a" and s == "u"):
                    offer(first, (c + more, a + "K", (*out, (role, text))))
                offer(after(s), (c + 1 + more, a + "R", (*out, ({"u": "user", "a": "assistant"}[after(s)], text))))
        ways = new
    ends = []
    for s0, way0 in ways.items():
        ends += [w for s, w in insertions({s0: way0}).items() if s in ("", "a")]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    lines = [f"{ {'u': 'user', 'a': 'assistant'}.get(r, r) if x == '' else r}:{x}" for r, x in out]
    roles = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), "\n".join(lines)


def repaired_rows(spark, rows, bits):
    report, out = conv.repair(spark.createDataFrame(rows, SAID), block_bits=bits)
    line = F.concat("role", F.lit(":"), "text")
    digests = {r[0]: r[1] for r in conv.joined_digest(out, "conv_id", "place", line, "d").collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (tuple(r[n] for n in names), digests.get(r["conv_id"], sha(""))) for r in report.collect()}


def some_talk(seed, lengths):
    rng, rows = random.Random(seed), []
    for c, n in enumerate(lengths):
        own = None if c == 3 else c
        for t in range(n):
            turn = None if rng.random() < 0.1 else t + (t > 4)
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", f"What {t}?", "cut", "", " \n\t", None, f"é {t}. ", "long " * 400 + "."])
            rows.append((own, turn, role, text, 1, "x"))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_repair_equals_brute_force(spark, bits):
    """Nulls in every column, repeated rows, ties of turns, empty and long texts, in one block and in many."""
    rows = some_talk(1, [1, 2, 3, 9, 40, 17, 70])
    by_conv = defaultdict(list)
    for c, *said, _, _ in rows:
        by_conv[c].append(tuple(said))
    want = {c: (report, sha(text)) for c, (report, text) in ((c, brute_repair(said)) for c, said in by_conv.items())}
    assert repaired_rows(spark, rows, bits) == want


def test_repair_of_no_rows(spark):
    assert repaired_rows(spark, [], 10) == {}
    assert conv.damaged(spark.createDataFrame([], SAID)).count() == 0


def test_damage_by_hash(spark):
    rows = [(c, t, "assistant", "One. Two!", 1, "x") for c in range(40) for t in (0, None)]
    got = Counter((r[0], r[1], r[2], r[3]) for r in conv.damaged(spark.createDataFrame(rows, SAID)).collect())
    want = Counter()
    for c, t, role, text, *_ in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fault == 4 else role, {1: "", 2: "One Two"}.get(fault, text)
        want[c, t, role, text] += {0: 0, 3: 2}.get(fault, 1)
    assert got == +want


def test_crossings_are_the_best_letters():
    """Halving with ranked vectors, also over summed blocks, against a plain table of letters."""
    rng = random.Random(2)
    for n in list(range(1, 30)) * 4:
        rows = [(rng.choice([0, 1, 1, 2, 2, 2, 3]), rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]
        ways = {0: (0, "")}
        for key in rows:
            new = {}
            for s, (c, letters) in ways.items():
                for (a, z), (more, text) in conv.LETTERS[key].items():
                    if a == s:
                        new[z] = min(new.get(z, (math.inf, "")), (c + more, letters + text))
            ways = new
        want = min((c + 5 * len(conv.CLOSING[s]), t + conv.CLOSING[s]) for s, (c, t) in ways.items())
        elements = [conv.ROW_STEPS[r] for r in rows]
        leave = conv.best_exit(elements)
        crossed = conv.crossings(elements, 0, leave)
        assert "".join(conv.LETTERS[r][w][1] for r, w in zip(rows, crossed)) + conv.CLOSING[leave] == want[1]
        k = rng.randint(1, 6)
        blocks = [conv.summed(elements[i:i + k]) for i in range(0, n, k)]
        assert conv.best_exit(blocks) == leave
        inner = [w for i, (a, b) in enumerate(conv.crossings(blocks, 0, leave)) for w in conv.crossings(elements[i * k:i * k + k], a, b)]
        assert inner == crossed


# ---- language-model scores -------------------------------------------------------------

TEXTS = "doc_id long, text string, learn boolean, batch int, id string"


def words_of(text):
    lower = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def brute_scores(rows, order, prior):
    counts = [Counter() for _ in range(order)]
    for _, text, learn, *_ in rows:
        if learn:
            tokens = [" ", *words_of(text)]
            for m in range(order):
                counts[m].update(tuple(tokens[i - m:i + 1]) for i in range(m, len(tokens)))
    n = sum(c for (w,), c in counts[0].items() if w != " ")
    kinds = sum(w != " " for (w,) in counts[0])
    out = []
    for doc_id, text, *_ in rows:
        tokens, base, score, known = [" ", *words_of(text)], 0.0, 0.0, 0
        for i in range(1, len(tokens)):
            c = counts[0][(tokens[i],)]
            p = (c + 0.1) / (n + 0.1 * (kinds + 1))
            base, known = base + math.log10(p), known + (c > 0)
            for m in range(1, min(order, i + 1)):
                context = tuple(tokens[i - m:i])
                p = (counts[m][(*context, tokens[i])] + prior * p) / (counts[m - 1][context] + prior)
            score += math.log10(p)
        out.append((doc_id, len(tokens) - 1, known, n, base, score))
    return out


def some_texts(n):
    rng = random.Random(4)
    vocabulary = ["the", "The", "a", "of", "Étang", "étang", "x1", " y", "end"]
    rows = [(i, " ".join(rng.choice(vocabulary[:rng.randint(2, 9)]) for _ in range(rng.randint(0, 60))), rng.random() < 0.7, 1, "z")
            for i in range(n)]
    return rows + [(None, None, True, 0, ""), (n, "", None, 0, ""), (n, "\t\x0b unknown word\r\n", False, 0, ""),
                   (n + 1, "long the words " * 20_000, True, 0, "")] + rows[:5]


@pytest.mark.parametrize("order, batch_bytes, shard_bytes", [(1, 1 << 23, 1 << 23), (2, 3000, 1000), (3, 2000, 500), (4, 1 << 23, 1 << 23)])
def test_scores_equal_brute_force(spark, order, batch_bytes, shard_bytes):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, in one batch and in many."""
    rows = some_texts(80)
    docs = spark.createDataFrame(rows, TEXTS)
    found = scoring.score_texts(docs, F.col("learn"), order, 2.5, batch_bytes=batch_bytes, shard_bytes=shard_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    got = sorted((tuple(r) for r in found.collect()), key=key)
    want = sorted(brute_scores(rows, order, 2.5), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-10)


def test_scores_without_rows_or_training(spark):
    assert scoring.score_texts(spark.createDataFrame([], TEXTS), F.col("learn")).count() == 0
    row = scoring.score_texts(spark.createDataFrame([(1, "a b", None, 0, "")], TEXTS), F.col("learn")).first()
    assert tuple(row) == (1, 3, 0, 0, 0.0, 0.0)


def test_the_model_is_a_distribution():
    """From every context the weights of all known words, of the end and of one unknown word sum to one."""
    texts = [b"a b a c", b"b a b", b"c"]
    known = sorted({w for t in texts for w in t.split()})
    learned = scoring.Batch(texts, [True] * 3, 3)
    tokens, kinds = sum(len(t.split()) + 1 for t in texts), len(known) + 1
    for context in itertools.chain([()], itertools.product([b"a", b"b", b"zz"], repeat=2)):
        total = 0.0
        for word in [*known, b"new", None]:
            said = b" ".join([*context, *([word] if word else [])])
            batch = scoring.Batch([said, b" ".join(context)], [False] * 2, 3)
            totals = [
                np.array([dict(zip(learned.grams[m].tolist(), learned.own[m].tolist())).get(g, 0) for g in grams.tolist()], dtype=np.uint64)
                for m, grams in enumerate(batch.grams)]
            model = scoring.Automaton(batch, totals, tokens, kinds, 2.0)
            end = model.walk(1)  # the context and then the end
            if word is None:
                p = end - _open(model, len(context))
            else:
                p = _open(model, len(context) + 1) - _open(model, len(context))
            total += 10 ** p
        assert total == pytest.approx(1.0, abs=1e-9)


def _open(model, n):
    """The weight of the first ``n`` words of the first text."""
    ends = model.batch.ends.copy()
    model.batch.ends = ends.copy()
    model.batch.ends[0] = model.batch.starts[0] + 1 + n
    weight = model.walk(0)
    model.batch.ends = ends
    return weight
