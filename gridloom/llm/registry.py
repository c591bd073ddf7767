"""The queries opN_<name>, thin over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, fingerprints, lines, minhash, mixing, sharding, topk, toxicity, unigram, warc
from gridloom.llm.common import documents


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.Rule(words=3, percent=85))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_top_k, op2_warc, op3_token_counts, op4_toxicity, op5_mixing, op6_sharding, op7_bpe, op8_near_duplicates, op9_fingerprints, op10_line_dedup)}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS low FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low < page_id THEN low END AS refers_to
FROM f
"""

OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS sizes, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2, 3
), l AS (
  SELECT u, v FROM p WHERE 100 * c >= 85 * (sizes - c) UNION SELECT v, u FROM p WHERE 100 * c >= 85 * (sizes - c)
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.node = l.u
), m AS (
  SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d
), c AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l
), s AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c
), f AS (
  SELECT a.doc_id, a.i AS st, min(b.i) AS en FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
), g AS (
  SELECT a.doc_id, max(a.i) AS st, b.i AS en FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 3
), n AS (
  SELECT doc_id, st, en, array_to_string(ls[st:en], chr(10)) AS run FROM (SELECT * FROM f UNION SELECT * FROM g) JOIN d USING (doc_id)
), k AS (
  SELECT doc_id, st, en, min(doc_id) OVER (PARTITION BY run) AS low, row_number() OVER (PARTITION BY run, doc_id ORDER BY st) AS nth FROM n
), x AS (
  SELECT DISTINCT doc_id, unnest(range(st, en + 1)) AS i FROM k WHERE low < doc_id OR nth > 1
)
SELECT c.doc_id, count(*) AS n_lines, count(x.i) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY c.i) FILTER (x.i IS NULL), '') AS text
FROM c LEFT JOIN x ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1_SQL, "op2_warc": OP2_SQL, "op8_near_duplicates": OP8_SQL, "op10_line_dedup": OP10_SQL}
