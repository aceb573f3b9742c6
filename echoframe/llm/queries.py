"""The queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .html_extraction import extract_text
from .importance import resample
from .jaccard_join import group_documents
from .language_id import identify_languages
from .line_dedup import dedup_lines
from .lm_scoring import score_documents
from .packing_bins import pack_documents
from .quality_rules import apply_rules
from .sharding import assign_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_shingles").cast("long"), "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


#: Shards this small keep the query telling on the smallest tables; a cluster would use 256 MiB.
SHARD_BYTES = 1 << 20


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), keep_ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    predicted = identify_languages(docs, docs.filter(~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs", "proportions")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM (SELECT *, least(10, len(w)) AS m FROM b) WHERE m > 0)
), g AS (
  SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT m FROM p))
), h AS (
  SELECT doc_id, item_id, k, m FROM g JOIN p USING (m, g)
), n AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM h)) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, reached) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""

_OP4_SQL = """
WITH l AS (
  SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS g, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), r AS (
  SELECT *, (g + 31 * coalesce(lag(g) OVER w, 0)) % 2147483647 AS r, lead(n) OVER w AS following FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, CASE WHEN following IS NULL OR n >= 50 OR following >= 50 OR coalesce(r > lag(r) OVER w AND r >= lead(r) OVER w, false) THEN 1 ELSE 0 END AS cut
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM c
), b AS (
  SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines, count(*) FILTER (n > 0) AS filled, sum(n) AS words FROM k GROUP BY doc_id, no
), f AS (
  SELECT doc_id, no, (filled >= 2 OR words >= 50) AND row_number() OVER (PARTITION BY body ORDER BY doc_id, no) > 1 AS gone FROM b
), q AS (
  SELECT doc_id, i, line, n, lag(line) OVER w AS before, lag(n) OVER w AS n_before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT *, row_number() OVER (PARTITION BY before, line ORDER BY doc_id, i) > 1 AS later FROM q WHERE i > 0
), u AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s WHERE later
), p AS (
  SELECT doc_id, min(i) - 1 AS a, max(i) AS z FROM u GROUP BY doc_id, run HAVING sum(n) + min_by(n_before, i) >= 50
), v AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM p
), x AS (
  SELECT k.doc_id, k.i, k.line, f.gone OR v.i IS NOT NULL AS gone FROM k JOIN f USING (doc_id, no) LEFT JOIN v ON v.doc_id = k.doc_id AND v.i = k.i
), t AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS removed_lines FROM x GROUP BY doc_id
), y AS (
  SELECT doc_id, count(*) FILTER (gone) AS removed_chunks FROM f GROUP BY doc_id
), z AS (
  SELECT doc_id, count(*) AS removed_passages FROM p GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
  CAST(coalesce(removed_chunks, 0) AS BIGINT) AS removed_chunks, CAST(coalesce(removed_passages, 0) AS BIGINT) AS removed_passages,
  CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""

_OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), p AS (
  SELECT depth, hash >> (60 - depth) AS p, sum(bytes) AS shard_bytes
  FROM (SELECT *, unnest(range(0, 61)) AS depth FROM d) GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES} OR min(hash) = max(hash)
), m AS (
  SELECT doc_id, bytes, hash, min(depth) AS depth, min_by(shard_bytes, depth) AS shard_bytes
  FROM (SELECT *, unnest(range(0, 61)) AS depth FROM d) x JOIN p USING (depth) WHERE p.p = x.hash >> (60 - depth) GROUP BY doc_id, bytes, hash
)
SELECT doc_id, bytes, CAST(depth AS BIGINT) AS depth, substr(lpad(bin(hash), 60, '0'), 1, depth) AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM m
"""

_ALL = (
    op1_lm_scoring,
    op2_ngram_jaccard_join,
    op3_quality_classifier,
    op4_line_dedup,
    op5_benchmark_decontamination,
    op6_quality_rules,
    op7_html_extraction,
    op8_sharding,
    op9_best_fit_packing,
    op10_language_id,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": _OP2_SQL,
    "op4_line_dedup": _OP4_SQL,
    "op5_benchmark_decontamination": _OP5_SQL,
    "op8_sharding": _OP8_SQL,
}
