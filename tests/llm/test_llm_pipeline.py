"""The pipeline's stages one after the other, each held against what it was given."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopanel.cluster import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark):
    """The documents before and after each stage, as the driver would write them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    return tables


def test_stages_keep_columns(passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    assert all(t.schema.simpleString() == passed[0].schema.simpleString() for t in passed[:-1])


def test_language_stage_rejects_only_texts_without_language(passed):
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in passed[:2])
    assert set(after) <= set(before)
    # Clean documents have words with letters: nearly all of their characters.
    for i in set(before) - set(after):
        assert len(re.findall(r"\w", before[i])) < 0.6 * len(before[i]), before[i][:200]


def test_exact_stage(passed):
    by_text = collections.defaultdict(list)
    for r in passed[1].collect():
        by_text[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in passed[2].collect()) == sorted(max(v) for v in by_text.values())


def test_near_stage(passed):
    rows = passed[2].collect()

    def shingles(text):
        words = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", text.lower())
        return {hash(tuple(words[i:i + 5])) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = collections.Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in passed[3].collect()) == sorted({find(d) for d in sets})


def test_mixing_stage(passed):
    before = {r.doc_id: r for r in passed[3].collect()}
    after = passed[4].collect()
    assert all(before[r.doc_id] == r for r in after)
    chars = sum(len(r.text) for r in before.values())
    assert 0.8 * chars < sum(len(r.text) for r in after) < 1.2 * chars


def test_packing_stage(passed):
    pieces = passed[5]
    last = pieces.where("start + length = doc_tokens")
    assert pieces.agg(F.sum("length")).first()[0] == last.agg(F.sum("doc_tokens")).first()[0]
    assert last.count() == passed[4].count()
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r.n == r.m and (r.n == 1024 or r.n & (r.n - 1) == 0) for r in sums)


def test_run_gives_the_rows_of_the_last_stage(spark, passed):
    ran = corpus_pipeline.run(spark, SF)
    assert ran.agg(F.sum("length"), F.count("*")).first()[0] == passed[-1].agg(F.sum("length")).first()[0]
