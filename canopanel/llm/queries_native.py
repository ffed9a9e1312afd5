"""Queries whose work is DataFrame operations only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopanel.llm import exact_dedup, line_dedup, mixing, sharding
from canopanel.llm.common import query, table

# At most this many bytes of text in a shard of the query: small shards that loaders can hold whole.
SHARD_BYTES = 1 << 20


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: which row of its group of equal texts stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op1_mix_sources", f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, ''))) AS chars, sqrt(sum(length(coalesce(text, '')))::DOUBLE) AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM sizes WHERE chars > 0)
           * (SELECT sum(chars) FROM sizes)::DOUBLE / chars ELSE 1 END AS rate
  FROM sizes),
parted AS (SELECT source, rate, greatest(ceil(rate / {mixing.PART_MEAN}), 1)::INTEGER AS parts FROM rates),
terms AS (
  SELECT source, parts, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0) AS term
  FROM parted, (SELECT unnest(range(0, {mixing.TERMS})) AS k)),
distribution AS (
  SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS total FROM terms),
draws AS (
  SELECT doc_id, source, unnest(range(1, parts + 1)) AS j FROM documents JOIN parted USING (source)),
uniform AS (
  SELECT doc_id, source, j, ('0x' || substr(md5('0|' || doc_id || '|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM draws),
counts AS (
  SELECT doc_id, source, sum((SELECT count(*) FROM distribution d WHERE d.source = uniform.source AND d.total <= u)) AS n
  FROM uniform GROUP BY doc_id, source),
copies AS (SELECT doc_id, unnest(range(1, n::BIGINT + 1))::INTEGER AS replica FROM counts)
SELECT documents.*, replica, md5('0 place|' || doc_id || '|' || replica) AS shuffle_key
FROM copies JOIN documents USING (doc_id)
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that sources weigh as the square root of their characters."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op6_shard", f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         md5(doc_id || '|' || md5(coalesce(text, '')) || '|1') AS digest FROM documents),
bits AS (
  SELECT doc_id, bytes, lpad(bin(('0x' || substr(digest, 1, 8))::UBIGINT), 32, '0')
         || lpad(bin(('0x' || substr(digest, 9, 8))::UBIGINT), 32, '0') AS bits FROM rows),
levels AS (SELECT doc_id, bytes, bits, d FROM bits, (SELECT unnest(range(0, 65)) AS d) WHERE bytes <= {SHARD_BYTES}),
buckets AS (
  SELECT substr(bits, 1, d) AS shard, d, sum(bytes) AS shard_bytes, count(*) AS shard_docs
  FROM levels GROUP BY 1, 2 HAVING sum(bytes) <= {SHARD_BYTES}),
best AS (
  SELECT doc_id, min(l.d) AS depth FROM levels l JOIN buckets b ON b.d = l.d AND b.shard = substr(bits, 1, l.d) GROUP BY 1)
SELECT bits.doc_id, bytes, shard, depth::INTEGER AS depth, shard_bytes, shard_docs
FROM bits JOIN best USING (doc_id) JOIN buckets ON buckets.d = depth AND shard = substr(bits, 1, depth)
UNION ALL SELECT doc_id, bytes, '!' || bits, 64, bytes, 1 FROM bits WHERE bytes > {SHARD_BYTES}
""")
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, none over SHARD_BYTES bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op5_line_dedup", f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM split),
words AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
         len(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13)), '\\s+')) AS words
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
ends AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS reached FROM words),
starts AS (SELECT *, reached - words AS start FROM ends),
windows AS (
  SELECT doc_id, pos, max(pos) OVER ahead AS last, sum(words) OVER ahead AS held,
         array_to_string(list(line) OVER ahead, chr(10)) AS content
  FROM starts
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {line_dedup.MIN_WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER behind, pos, sum(words) OVER behind, array_to_string(list(line) OVER behind, chr(10))
  FROM starts
  WINDOW behind AS (PARTITION BY doc_id ORDER BY reached RANGE BETWEEN {line_dedup.MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS n
  FROM windows WHERE held >= {line_dedup.MIN_WORDS}),
later AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM numbered WHERE n > 1),
runs AS (
  SELECT *, sum(CASE WHEN pos <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM later),
spans AS (SELECT doc_id, min(pos) AS first, max(last) AS last FROM runs GROUP BY doc_id, run),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM spans),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.doc_id IS NULL), '') AS text,
         count(g.doc_id) AS removed_lines
  FROM lines LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, cleaned.text, lang, source, n_chars, removed_lines FROM documents JOIN cleaned USING (doc_id)
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of whole runs of lines."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))
