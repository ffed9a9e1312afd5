"""Exact dedup, mixing, sharding and line dedup: odd rows, hot groups, and brute force."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from canopanel.llm.exact_dedup import exact_dedup, exact_groups
from canopanel.llm.line_dedup import line_dedup
from canopanel.llm.mixing import mix_sources, source_rates
from canopanel.llm.sharding import shard, write_shards

SCHEMA = "doc_id long, text string, source string, _h string, replica string, removed_lines string, _gone int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", "r", "l", 7) for i, t, s in rows], SCHEMA)


ODD = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, None, "x"), (4, "", None), (None, "a", "q"),
       (5, "c", "z"), (6, "bb", "x"), (2, "c", "x"), (7, "é" * 40_000, "x"), (8, "é" * 40_000, "x")]


def weak(text):
    """A digest under which most texts collide."""
    return F.substring(F.md5(text), 1, 0).cast("binary")


@pytest.mark.parametrize("digest", [None, weak])
def test_exact_groups(spark, digest):
    extra = {} if digest is None else {"digest": digest}
    got = [tuple(r) for r in exact_groups(docs_of(spark, ODD), **extra).collect()]
    groups = collections.defaultdict(list)
    for i, t, _ in ODD:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        once = False
        for i in ids:
            want.append((i, keep, len(ids), i == keep and not once, hashlib.sha256(t.encode()).hexdigest()))
            once = once or i == keep
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("digest", [None, weak])
def test_exact_dedup_keeps_one_row_of_each_text(spark, digest):
    extra = {} if digest is None else {"digest": digest}
    docs = docs_of(spark, ODD)
    kept = exact_dedup(docs, **extra)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(
        {(max(i for i, u, _ in ODD if (u or "") == t and i is not None), t) for t in {t or "" for _, t, _ in ODD}})


def test_exact_dedup_of_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_groups(docs).where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(rows) == (1000, 2997, 1)


@pytest.mark.parametrize("operator", [exact_groups, exact_dedup, mix_sources, line_dedup, lambda d: shard(d, 10)])
def test_empty_tables(spark, operator):
    assert operator(docs_of(spark, [])).count() == 0


def poisson_count(mean, parts, u_of):
    total = 0
    for j in range(1, parts + 1):
        u, k, term = u_of(j), 0, math.exp(-mean / parts)
        acc = term
        while acc <= u:
            k += 1
            term *= mean / parts / k
            acc += term
        total += k
    return total


def test_mix_sources_against_brute_force(spark):
    rows = [(i, "w" * (i % 7 + 1), "big" if i % 3 else "small") for i in range(600)] + [(1000, "rare text", "rare"), (1001, None, None), (1001, "x", None)]
    weights = {"big": 1.0, "small": 2.0, "rare": 1.0, None: 0.5}
    docs = docs_of(spark, rows)
    got = collections.Counter((r.doc_id, r.source) for r in mix_sources(docs, weights, epochs=1.5).collect())
    chars = collections.Counter()
    for _, t, s in rows:
        chars[s] += len(t or "")
    want = collections.Counter()
    for i, _, s in rows:
        rate = weights[s] / 4.5 * sum(chars.values()) * 1.5 / chars[s]
        parts = max(1, math.ceil(rate / 8))
        n = poisson_count(rate, parts, lambda j: int(hashlib.md5(f"0|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52)
        want[(i, s)] += n
    assert got == +want
    # A rare source is repeated: its share of the characters comes near the target.
    rare = got[(1000, "rare")] * len("rare text")
    assert 0.15 < rare / sum(n * len(next(t or "" for i, t, s in rows if (i, s) == k)) for k, n in got.items()) < 0.3


def test_mix_sources_order_columns_and_replicas(spark):
    docs = docs_of(spark, [(i, "some text", "x") for i in range(300)])
    mixed = mix_sources(docs, {"x": 1.0}, epochs=2.0)
    assert mixed.columns == [*docs.columns, "replica_", "shuffle_key"]
    rows = mixed.collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r.replica_)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_doc.values())
    assert 500 < len(rows) < 700
    order = [r.doc_id for r in rows]
    assert order != sorted(order)
    assert mix_sources(docs, {"x": 1.0}, epochs=2.0).count() == len(rows)
    assert mix_sources(docs, {"y": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, {"x": 0.0})


def test_source_without_characters(spark):
    rates = {r.source: r.rate for r in source_rates(docs_of(spark, [(1, "", "e"), (2, "abc", "f"), (3, None, None)])).collect()}
    assert rates == {"e": 1.0, "f": 1.0, None: 1.0}


def test_shards_fit_and_cover_all(spark):
    rows = [(i, "x" * (i % 50), "s") for i in range(1500)] + [(5000, "y" * 3000, "s"), (5001, None, "s"), (None, "zz", "s")] + [(7, "same row " * 3, "s")] * 400
    got = shard(docs_of(spark, rows), 1000).collect()
    assert sorted((str(r.doc_id), r.bytes) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in rows)
    sizes, members = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.shard] += r.bytes
        members[r.shard] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_docs) == (sizes[r.shard], members[r.shard])
        assert r.depth == (64 if r.shard.startswith("!") else len(r.shard))
        assert sizes[r.shard] <= 1000 or r.shard.startswith("!") and members[r.shard] == 1
    # Only buckets over the limit were split: siblings together do not fit one shard.
    plain = {s for s in sizes if not s.startswith("!")}
    for s in plain:
        if s:
            assert sum(sizes[o] for o in plain if o.startswith(s[:-1])) > 1000
    assert {r.shard for r in shard(docs_of(spark, rows), 1 << 30).collect()} == {""}
    with pytest.raises(ValueError):
        shard(docs_of(spark, rows), 0)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, "x" * (i % 50), f"s{i}") for i in range(200)] + [(5000, "y" * 3000, "s"), (5001, None, "s"), (None, "zz", "s")]
    rows += [(7, "same row " * 3, f"r{i}") for i in range(60)]
    docs = docs_of(spark, rows)
    for limit in (1000, 1 << 30):
        path = str(tmp_path / str(limit))
        write_shards(docs, path, limit)
        back = spark.read.parquet(path)
        key = lambda r: str(tuple(r))
        assert sorted(back.select(docs.columns).collect(), key=key) == sorted(docs.collect(), key=key)
        held = collections.Counter()
        for r in back.collect():
            held[r.shard] += len(r.text or "")
        want = {"b" + r.shard: r.shard_bytes for r in shard(docs, limit).collect()}
        assert held == collections.Counter(want) and set(held) == set(want)
        assert len(list(tmp_path.glob(f"{limit}/*/*.parquet"))) == len(want)


def brute_line_dedup(rows, min_words):
    """Windows of each (id, text) in order; lines of windows that have an earlier equal go."""
    texts = sorted({(i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in texts:
        lines = t.split("\n")
        full = [(p, x.strip(" \t\r")) for p, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a in range(len(full)):
            held, b = 0, a
            while b < len(full) and held < min_words:
                held += len(full[b][1].split())
                b += 1
            if held >= min_words:
                content = tuple(x for _, x in full[a:b])
                if content in seen:
                    gone |= set(range(full[a][0], full[b - 1][0] + 1))
                seen.add(content)
        out[(i, t)] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def test_line_dedup_against_brute_force(spark):
    passage = "\n".join(f"line number {k} of a passage that repeats" for k in range(4))
    long_line = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"start one\n{passage}\nend one"), (2, f"start two\n\n{passage}\n\nend two"), (3, long_line), (4, f"before\n{long_line}\nafter"),
            (5, "short line\nshort line"), (6, None), (7, ""), (8, "\n".join(["again and again and again"] * 9)),
            (9, passage.replace("\n", "\n\n")), (10, passage[:60]), (10, passage[:60]), (11, f"{passage}\n{long_line}\n{passage}")]
    docs = spark.createDataFrame([(i, t, "l", 3) for i, t in rows], "doc_id long, text string, removed_lines string, _gone int")
    cleaned = line_dedup(docs, min_words=20)
    assert cleaned.columns == [*docs.columns, "removed_lines_"]
    want = brute_line_dedup(rows, 20)
    got = sorted((r.doc_id, r.text, r.removed_lines_) for r in cleaned.collect())
    assert got == sorted((i, *want[(i, t or "")]) for i, t in rows)
    assert dict((i, n) for i, _, n in got)[4] == 1


def test_line_dedup_of_a_very_common_line(spark):
    line = " ".join(f"word{k}" for k in range(55))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\n" + line)).alias("text"))
    got = line_dedup(docs).groupBy("removed_lines").count().collect()
    assert {r.removed_lines: r["count"] for r in got} == {0: 1, 1: 899}


def brute_whole_runs(rows, min_words):
    """Lines (none blank) of each text in a maximal run of enough words that an earlier place has too."""
    texts = [(i, [(x, len(x.split())) for x in t.split("\n")]) for i, t in sorted(rows)]
    out = {}
    for n, (i, own) in enumerate(texts):
        gone = set()
        for m, (_, other) in enumerate(texts[:n + 1]):
            for a in range(len(own)):
                for b in range(a if m == n else len(other)):
                    if own[a] != other[b] or a and b and own[a - 1] == other[b - 1]:
                        continue
                    k = 0
                    while a + k < len(own) and b + k < len(other) and own[a + k] == other[b + k]:
                        k += 1
                    if sum(w for _, w in own[a:a + k]) >= min_words:
                        gone |= set(range(a, a + k))
        out[i] = "\n".join(x for p, (x, _) in enumerate(own) if p not in gone), len(gone)
    return out


def test_line_dedup_deletes_whole_runs(spark):
    def line(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    draw = random.Random(5)
    pool = [line(name, n) for name, n in zip("abcdefgh", (1, 2, 3, 5, 8, 13, 19, 24))]
    rows = [(i, "\n".join([f"own {i}", *draw.choices(pool, k=draw.randint(1, 9)), f"end {i}"])) for i in range(60)]
    # The first copy of a passage ends early, a later one goes on: a third is deleted whole.
    long, tail = line("long", 76), line("tail", 12)
    rows += [(100, f"x\n{long}\ny"), (101, f"z\n{long}\n{tail}\nv"), (102, f"u\n{long}\n{tail}\nw"), (103, f"{tail}\nu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup(docs, min_words=20).collect()}
    assert got == brute_whole_runs(rows, 20)
    assert got[101] == (f"z\n{tail}\nv", 1) and got[102] == ("u\nw", 2) and got[103][1] == 0
