"""The queries of this subpackage: each operator over its whole table, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, html_extract, langid, minhash, packing, token_store, topk, toxicity, warc
from tidemark.llm.common import documents

TOXIC_FROM = 0.3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, at: int) -> Column:
    return F.coalesce(fold(id_col, folds) == at, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(bpe.encode_documents(documents(spark, sf_dir), ranks), ranks)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = topk.search(vectors, vectors.filter(F.col("id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP3_SQL = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM t WHERE vec_id % 50 = 0), s AS (
  SELECT q.vec_id AS query_id, t.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN t ON q.vec_id <> t.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.planned(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return warc.read(warc.merge(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM t),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN d.page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < winner THEN winner END AS refers_to
FROM d LEFT JOIN w ON d.payload_digest = w.payload_digest AND payload_bytes >= 1000
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.group(documents(spark, sf_dir), words=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("group").alias("component_id"), F.col("id").eqNullSafe(F.col("group")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM t
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS root FROM s
  UNION SELECT l.b, r.root FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) l ON l.a = r.doc_id
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(root) AS component_id, min(root) = s.doc_id AS kept FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(sh)
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    out = langid.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def toxicity_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Network | None:
    """Fitted on labelled rows outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 4) != 2)
    return toxicity.fit(docs, labels)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read(manifest).withColumnRenamed("key", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity_network(spark, docs, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_topk": op3_topk,
    "op4_warc": op4_warc,
    "op5_minhash": op5_minhash,
    "op6_langid": op6_langid,
    "op7_token_store": op7_token_store,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op3_topk": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op5_minhash": OP5_SQL,
    "op10_exact_dedup": OP10_SQL,
}
