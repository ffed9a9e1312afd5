"""Queries of the operators that follow an order, of rows or of words, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import join_on_keys
from canopanel.llm import conversations, merkle, scoring
from canopanel.llm.common import query, table
from canopanel.plans.registry import r, rounded

TAMPER_EVERY = 7
FOLDS = 10  # rows of fold 0 are held out
ORDER, PRIOR = 2, 4.0

# CRC-32 in SQL: the table of the polynomial, then one step for each character of an ASCII text.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS crcs
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text; needs ``crc_table`` in the FROM clause."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"""


def _framed_sql(*fields: str) -> str:
    return " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)


def _tree_sql(name: str, leaves: str, tree: str) -> str:
    """Recursive members: all nodes of the trees of ``leaves`` (tree, pos, size, digest)."""
    return f"""{name}(tree, level, pos, size, digest) AS (
  SELECT {tree}, 0, pos, size, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 2, size)"""


def _proof_sql(leaves: str, key: str, tree: str, nodes: str) -> str:
    """For each leaf the list of its siblings, each behind its side, from below."""
    return f"""SELECT {key}, list(CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos < n.pos THEN 'L' || s.digest ELSE 'R' || s.digest END
                ORDER BY n.level) FILTER (WHERE n.size > 1) AS proof
  FROM {leaves} l JOIN {nodes} n ON n.tree IS NOT DISTINCT FROM {tree} AND n.pos = l.pos >> n.level
  LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM n.tree AND s.level = n.level AND s.pos = xor(n.pos, 1)
  GROUP BY ALL"""


@query("op11_merkle_manifest", f"""
WITH RECURSIVE {CRC_TABLE},
rows AS (
  SELECT doc_id, lang, sha256({_framed_sql('doc_id', 'source', 'lang', 'n_chars', 'text')}) AS digest,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % {TAMPER_EVERY} = 0
              THEN sha256({_framed_sql('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')}) END AS tampered
  FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS size FROM rows),
{_tree_sql('nodes', 'leaves', 'lang')},
tops AS (
  SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
{_tree_sql('top_nodes', 'tops', '0')},
low AS ({_proof_sql('leaves', 'l.doc_id, l.lang, l.pos, l.digest, l.tampered', 'l.lang', 'nodes')}),
high AS ({_proof_sql('tops', 'l.lang, l.digest', '0', 'top_nodes')}),
proofs AS (
  SELECT low.*, high.digest AS subroot, (SELECT digest FROM top_nodes WHERE size = 1) AS root,
         list_concat(coalesce(low.proof, []), coalesce(high.proof, [])) AS steps
  FROM low JOIN high ON low.lang IS NOT DISTINCT FROM high.lang),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(tampered, digest), steps), lambda node, step:
         sha256(CASE WHEN step[1] = 'L' THEN step[2:] || node WHEN step[1] = 'R' THEN node || step[2:] ELSE node END)) AS folded_root
  FROM proofs)
SELECT doc_id, digest AS leaf, subroot, root,
       sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a partly tampered table still verifies."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    changed = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    found = merkle.manifest(table(spark, sf_dir, "documents"), extra={"tampered": F.unhex(F.when(chosen, changed))})
    leaf = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    folded = found.withColumn("folded_root", merkle.fold(leaf, F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_conversation_repair", f"""
WITH RECURSIVE {CRC_TABLE},
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
  FROM conversations, crc_table),
said AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded),
bare AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM said),
told AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
  FROM bare),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM told GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES
  (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')
) AS t(state, met, inserted)),
edits AS (SELECT * FROM (VALUES
  (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3),
  (0, '*', 'R', 2), (1, '*', 'R', 2), (3, '*', 'R', 2), (2, '*', 'R', 3),
  (0, '*', 'D', 0), (1, '*', 'D', 1), (2, '*', 'D', 2), (3, '*', 'D', 3)) AS t(met, initial, letter, reached)),
ways(conv_id, pos, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM told
  UNION ALL
  SELECT conv_id, pos, reached, cost, audit FROM (
    SELECT w.conv_id, r.pos, reached, audit || inserted || letter AS audit,
           w.cost + 5 * length(inserted) + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
             + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END AS cost,
    FROM ways w JOIN told r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
    JOIN inserts USING (state)
    JOIN edits e ON e.met = inserts.met AND e.initial IN ('*', r.initial) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, reached ORDER BY cost, audit) = 1),
ends AS (
  SELECT w.conv_id, w.cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND pos = n),
ended AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS i FROM ended WHERE audit <> ''),
numbered AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM letters),
staying AS (
  SELECT l.conv_id, i, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role, letter = 'K' AND initial = 's' AS is_system,
         row_number() OVER (PARTITION BY l.conv_id ORDER BY i) AS j
  FROM numbered l LEFT JOIN told r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.pos WHERE letter <> 'D'),
roles AS (
  SELECT *, CASE WHEN letter = 'K' THEN role WHEN (j - max(is_system::INTEGER) OVER (PARTITION BY conv_id)) % 2 = 1
                 THEN 'user' ELSE 'assistant' END AS new_role FROM staying),
joined AS (SELECT conv_id, string_agg(new_role || ':' || text, chr(10) ORDER BY i) AS repaired FROM roles GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in every damaged conversation, the cheapest repair, and a digest of what it gives."""
    rows = table(spark, sf_dir, "conversations")
    report, repaired = conversations.repair(conversations.damaged(rows))
    line = F.concat(F.col("role"), F.lit(":"), F.col("text"))
    digests = conversations.joined_digest(repaired, "conv_id", "place", line, "repaired_sha256")
    found = join_on_keys(join_on_keys(rows.select("conv_id").distinct(), report, ["conv_id"]), digests, ["conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _held_out(id_col: str):
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def _grams_sql(order: int) -> str:
    """Counts of the n-grams of each order, and the probability of each token by each order."""
    gram = lambda m, shift=0: ", ".join(f"w{k}" for k in range(m - 1 + shift, shift - 1, -1))
    parts, joins = [], []
    for m in range(1, order + 1):
        parts.append(f"grams{m} AS (SELECT {gram(m)}, count(*) AS c FROM tokens "
                     f"WHERE NOT held_out AND w{m - 1} IS NOT NULL GROUP BY ALL)")
        on = " AND ".join(f"g{m}.w{k} = t.w{k}" for k in range(m))
        joins.append(f"LEFT JOIN grams{m} g{m} ON {on}")
        if m > 1:
            on = " AND ".join(f"h{m}.w{k} = t.w{k + 1}" for k in range(m - 1))
            joins.append(f"LEFT JOIN grams{m - 1} h{m} ON {on}")
    p = "p1"
    for m in range(2, order + 1):
        p = f"((coalesce(c{m}, 0) + {PRIOR}::DOUBLE * {p}) / (coalesce(x{m}, 0) + {PRIOR}::DOUBLE))"
    counts = "".join(f", g{m}.c AS c{m}, h{m}.c AS x{m}" for m in range(2, order + 1))
    return f"""{", ".join(parts)},
corpus AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM grams1 WHERE w0 <> ' begin'),
counted AS (
  SELECT doc_id, t.w0, coalesce(g1.c, 0) AS c, (coalesce(g1.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p1{counts}
  FROM tokens t CROSS JOIN corpus {" ".join(joins)} WHERE t.w0 <> ' begin'),
weighed AS (SELECT *, log10({p}) AS weight FROM counted)"""


@query("op13_lm_score", f"""
WITH {CRC_TABLE},
texts AS (
  SELECT doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % {FOLDS} = 0, true) AS held_out,
         list_concat([' begin'], list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda w: w <> ''), [' end']) AS words
  FROM documents, crc_table),
placed AS (SELECT doc_id, held_out, words, unnest(range(1, len(words) + 1)) AS i FROM texts),
tokens AS (
  SELECT doc_id, held_out, {", ".join(f"CASE WHEN i > {k} THEN words[i - {k}] END AS w{k}" for k in range(ORDER))} FROM placed),
{_grams_sql(ORDER)},
scored AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known,
         fsum(log10(p1)) AS base_score, fsum(weight) AS score FROM weighed GROUP BY doc_id)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, {r('base_score')} AS base_score, {r('score')} AS score
FROM scored JOIN texts USING (doc_id) CROSS JOIN corpus
""")
def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under a model of nine of ten of them."""
    docs = table(spark, sf_dir, "documents")
    found = scoring.score_texts(docs, ~_held_out("doc_id"), ORDER, PRIOR)
    return rounded(found.select(
        "doc_id", _held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
