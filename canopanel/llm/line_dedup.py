"""Line dedup: winnowing over line hashes finds repeated runs of lines, later ones are deleted.

A window is the shortest run of lines from a line onward that holds ``min_words`` words; its
fingerprint is the smallest line hash in it.  A run of lines with that many words, wherever it
occurs, contains a whole window, hence a fingerprint that every copy of the run selects too.
Fingerprints met more than once bring their windows together by content; each window that has
an earlier equal is a match, and matches that touch or overlap extend each other.  Windows from
a line onward reach back to the first line of a repeated run, but may end before its last one:
the shortest run up to that line is a window too, so that both together are the whole run,
whichever of the earlier copies goes on alike.  No pairs of positions are formed: every window
meets the first of its like only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopanel.cluster import stored
from canopanel.llm.common import column, fresh, in_slots, whole_text

MIN_WORDS = 50


def _windows(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, pos, last, f, w1, w2): the windows of all texts; t tells texts of one id apart."""
    text = whole_text(text_col)
    lines = docs.select(
        column(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    trimmed = F.trim(F.col("line"), F.lit(" \t\r"))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    hashed = lines.select(
        "id", "t", "pos", words.alias("words"), F.xxhash64(F.lit(1), trimmed).alias("h1"), F.xxhash64(F.lit(2), trimmed).alias("h2"))
    # A row repeated with id and text is one document; blank lines are in no window.
    own = hashed.where("words > 0").repartition("id", "t").groupBy("id", "t", "pos").agg(
        F.first("words").alias("words"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    doc = Window.partitionBy("id", "t").orderBy("pos")
    before = own.withColumn("end", F.sum("words").over(doc)).withColumn("start", F.col("end") - F.col("words"))
    frames = [Window.partitionBy("id", "t").orderBy("start").rangeBetween(0, min_words - 1),
              Window.partitionBy("id", "t").orderBy("end").rangeBetween(1 - min_words, 0)]
    kinds = [F.struct(
        F.min("pos").over(frame).alias("pos"), F.max("pos").over(frame).alias("last"), F.sum("words").over(frame).alias("held"),
        F.min("h1").over(frame).alias("f"), F.collect_list("h1").over(frame).alias("all1"),
        F.collect_list("h2").over(frame).alias("all2")) for frame in frames]
    both = before.select("id", "t", "words", *[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    # A run up to a line that holds enough without it is no window from its first line onward.
    wanted = [F.col("k0.held") >= min_words, F.col("k1.held") - F.col("words") >= min_words]
    return both.select("id", "t", F.explode(F.array(*[
        F.when(w, F.struct(*[F.col(f"k{i}.{c}").alias(c) for c in ("pos", "last", "f")],
                           F.xxhash64(f"k{i}.all1").alias("w1"), F.xxhash64(f"k{i}.all2").alias("w2")))
        for i, w in enumerate(wanted)])).alias("w")).where("w is not null").select("id", "t", "w.*")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, t, first, last): maximal runs of lines to delete, by number from 0.

    A run is deleted when an equal window precedes each of its windows, in the order of
    (id, hash of the text, line); the first of its like stays.
    """
    windows = stored(_windows(docs, min_words, id_col, text_col), "line-windows")
    shared = stored(windows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"), "line-fingerprints")
    met = windows.join(shared, "f", "left_semi")
    firsts = stored(
        met.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "t", "pos")).alias("one"))
        .where("n > 1").select("w1", "w2", "one"), "line-firsts")
    later = windows.join(firsts, ["w1", "w2"]).where(~F.struct("id", "t", "pos").eqNullSafe(F.col("one")))
    doc = Window.partitionBy("id", "t").orderBy("pos")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.select("id", "t", "pos", "last", F.when(F.col("pos") <= reach + 1, 0).otherwise(1).alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(doc))
    return runs.groupBy("id", "t", "run").agg(F.min("pos").alias("first"), F.max("last").alias("last")).drop("run")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
               removed_col: str = "removed_lines") -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text, and how many lines went.

    Lines are compared without leading and trailing blanks and tabs; runs of under
    ``min_words`` words stay.  Lines between two deleted lines of a run that are blank go with
    it.  A null text becomes empty.  Rows repeated with id and text are one document, so
    neither is a copy of the other.  Null ids come first in order.  Within one text a run that
    overlaps its own repeat keeps the part before the overlap.  A text of any length is split where it
    is read; its lines, as hashes, are put in order by one task.  An empty table gives no rows.  Other columns stay as they are;
    one called removed_lines makes the new one's name longer.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    gone = stored(
        runs.groupBy("id", "t").agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("gone")), "line-gone")
    i, t, lost, own, met = fresh(docs, "_id", "_t", "_gone", "_own", "_met")
    removed, = fresh(docs, removed_col)
    gone = gone.withColumnsRenamed({"id": i, "t": t, "gone": lost})
    text = whole_text(text_col)
    # Texts that lose no line pass without a shuffle.
    whole = docs.withColumn(own, F.xxhash64(text)).withColumn(text_col, text)
    marked = in_slots(whole, F.xxhash64(column(id_col), F.col(own)), gone, F.xxhash64(F.col(i), F.col(t)), met)
    same = column(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(t))
    lines = F.split(column(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    cleaned = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    cut = marked.where(met).join(gone, same, "left").withColumns({
        text_col: F.when(F.col(lost).isNull(), column(text_col)).otherwise(cleaned),
        removed: F.when(F.col(lost).isNull(), 0).otherwise(F.size(F.col(lost))).cast("long")})
    wanted = [*[column(c) for c in docs.columns], column(removed)]
    return marked.where(~F.col(met)).withColumn(removed, F.lit(0).cast("long")).select(wanted).unionByName(cut.select(wanted))
