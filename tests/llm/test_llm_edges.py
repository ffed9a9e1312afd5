"""Empty tables, nulls, ties, repeated rows, clashing columns, very long texts, and sizes that were once limits."""

import collections
import random
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopanel.llm import language, line_dedup, mixing, near, packing, secrets, sharding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan_secrets(docs, RANKS, public_tokenizers.PATTERN)
    return {r["doc_id"]: r["spans"] for r in found.collect()}


# ---- secrets ---------------------------------------------------------------------------

def test_secrets_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert secrets.scan_secrets(docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("length, least", [(8, 0.7), (10, 0.8), (12, 0.9), (14, 0.9), (16, 0.97), (18, 0.97), (24, 0.99)])
def test_recall_of_random_strings_by_length(spark, length, least):
    draw = random.Random(length)
    keys = ["".join(draw.choices(string.ascii_letters + string.digits, k=length)) for _ in range(400)]
    found = scanned(spark, [f"the value is {k} here" for k in keys])
    assert sum(found[i] == f"random:13:{13 + length}" for i in range(400)) >= least * 400


def test_usual_words_names_and_numbers_are_no_secrets(spark):
    texts = ["internationalization responsibilities straightforward", "user_name first-name README LICENSE", "call 555-7713 on 2024-01-15",
             "get_connection_string read-only long_variable_name", "Donaudampfschiff Geschwindigkeit", "CONFIGURATION DEVELOPMENT"]
    assert set(scanned(spark, texts).values()) == {""}


# ---- packing ---------------------------------------------------------------------------

def test_the_rule_stays_in_force_beyond_the_open_windows():
    """More windows than may be open: the fullest go, all ids stay, and later pieces still find levels."""
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(1024, max_open=packing.MAX_OPEN)
    sent, full = 0, []
    for i in range(packing.MAX_OPEN + 500):  # none of these fits onto another one
        n = int(rng.integers(513, 1024))
        sent += n
        full += packer.put(i, np.full(n, i, dtype="<u4"))
    held = [len(w) for w in packer.windows]
    assert packer.n_open == sum(held) <= packing.MAX_OPEN and packer.n_open > packing.MAX_OPEN * 3 // 4
    assert [1 if n == 0 else 2 * n + 1 for n in held[1:]] == packer.gain[1:1024].tolist()
    lowest = next(level for level, n in enumerate(held) if n)
    assert packer.level_for(1024 - lowest) == lowest  # onto the fullest level it fits, not into a new window
    full += packer.close()
    sizes = [sum(len(ids) for _, _, ids in w) for w in full]
    assert sum(sizes) == sent and all(n == 1024 or n & (n - 1) == 0 for n in sizes) and sum(n < 1024 for n in sizes) <= 10
    ids = collections.Counter()
    for window in full:
        for document, _, part in window:
            assert set(part.tolist()) == {document}
            ids[document] += len(part)
    assert len(ids) == packing.MAX_OPEN + 500


# ---- language --------------------------------------------------------------------------

def test_every_label_is_learned(spark):
    """600 labels: none is left out, and a batch of texts stays within its memory."""
    rows = [(i, f"text {i % 600} of words", f"l{i % 600:03d}", None, None) for i in range(2400)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    tagger = language.train(docs, language.Settings(steps=3))
    learned = {r["lang"] for r in docs.where(~language.held_out("doc_id")).select("lang").distinct().collect()}
    assert set(tagger.languages) == learned and len(learned) == 600
    names, scores = tagger.classify(["some text", None, ""], 64)
    assert names[0] in learned and names[1:] == [language.UNDETERMINED] * 2 and 0 < scores[0] <= 1


def test_language_of_repeated_long_and_strange_texts(spark):
    rows = [(i, "the words of this and that " * 3 if i % 2 else "der und die das ist nicht " * 3, "en" if i % 2 else "de", "s", i) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    tagger = language.train(docs, language.Settings(steps=60))
    asked = [(1, "the and of this", "x", 0), (1, "the and of this", "x", 0), (None, "der und das", "y", 1), (3, "und die nicht " * 20_000, "y", 1),
             (4, None, "z", 2), (5, " 12 !", "z", 2)]
    frame = spark.createDataFrame(asked, "doc_id long, text string, lang_pred string, score int")
    found = language.identify(frame, tagger)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "lang_pred_", "score_"]
    got = sorted((str(r["doc_id"]), r["lang_pred_"]) for r in found.collect())
    assert got == sorted([("1", "en"), ("1", "en"), ("None", "de"), ("3", "de"), ("4", "und"), ("5", "und")])
    alike = language.ByteTagger(["a", "b"], 4)
    for w in alike.weights.values():
        w[...] = 0
    assert alike.classify(["tie"], 64) == (["a"], [0.5])


# ---- near copies, lines, mixing, sharding -----------------------------------------------

def test_near_classes_of_an_empty_table_and_of_a_long_text(spark):
    assert near.near_classes(spark.createDataFrame([], "doc_id long, text string, class_id int")).count() == 0
    draw = random.Random(7)
    long = " ".join(f"w{draw.randrange(40_000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " and a few more words"), (3, "short text of its own"), (None, long), (3, None)]
    got = {(r["doc_id"], r["class_size"]): r["n_links"] for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 3): 2, (2, 3): 2, (None, 3): 2, (3, 1): 0}


def test_lines_of_a_very_long_text(spark):
    own = "\n".join(f"line {i} has a few words of its own" for i in range(8000))
    passage = "\n".join(f"passage line {i} with some more words" for i in range(12))
    docs = spark.createDataFrame([(1, f"{own}\n{passage}"), (2, f"x\n{passage}\ny"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (f"{own}\n{passage}", 0), 2: ("x\ny", 12), 3: ("", 0)}
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_rows_without_id_are_drawn_each_by_its_text(spark):
    docs = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(docs, weights={"s": 1.0}, epochs=2.0)
    counts = collections.Counter(r["text"] for r in mixed.select("text").collect())
    assert abs(sum(counts.values()) - 8000) < 500 and len(set(counts.values())) > 3
    assert mixed.select("shuffle_key").distinct().count() == sum(counts.values())


def test_shards_beside_a_column_of_that_name(spark, tmp_path):
    rows = [(i % 7, "x" * (i % 5 + 1), "mine") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.sharded(docs, 40)
    assert out.columns == ["doc_id", "text", "shard", "shard_"]
    assert sorted(tuple(r)[:3] for r in out.collect()) == sorted(rows)
    sharding.write_shards(docs, str(tmp_path / "shards"), 40)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == sorted(rows)
    assert back.groupBy("shard_").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 40").count() == 0


# ---- pipeline --------------------------------------------------------------------------

def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_nulls_repeated_ids_and_clashing_columns(spark, tmp_path):
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "und", "the", "of", "le", "que"]
    texts = [" ".join(draw.choices(words, k=40)) + f" number {i}" for i in range(60)]
    rows = [(i, t, draw.choice(["en", "de", None]), draw.choice(["web", None]), None, 1, "a", "b") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "web", 3, 1, "a", "b")] * 2 + [(5, texts[7], None, None, None, 1, "a", "b"), (99, None, "en", "web", 0, 1, "a", "b"),
             (98, " 77 ", "en", "web", 0, 1, "a", "b"), (97, "ä " * 3000, "de", "web", 0, 1, "a", "b")]
    spark.createDataFrame(rows, DOCUMENTS + ", start int, replica string, lang_pred string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2  # those without letters
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    whole = pieces.where("start + length = doc_tokens")
    assert pieces.agg(F.sum("length")).first()[0] == whole.agg(F.sum("doc_tokens")).first()[0]


def test_a_clean_text_in_several_languages_stays(spark):
    rows = [(i, t * 4, lang, "s", 1) for i, (t, lang) in enumerate([
        ("the cat is on the table and it was there ", "en"), ("der hund ist nicht auf dem tisch und ", "de"),
        ("le chat est dans la maison avec une ", "fr"), ("el perro esta en la casa con una ", "es")] * 30)]
    mixed = (9999, "the cat is on the table der hund ist nicht auf le chat est dans la el perro esta en la", None, "s", 1)
    docs = spark.createDataFrame([*rows, mixed], DOCUMENTS)
    assert corpus_pipeline.identify_language(spark, docs, "").where("doc_id = 9999").count() == 1
