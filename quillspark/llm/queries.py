"""The operators of this subpackage as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .ann import nearest
from .exact_dedup import exact_dedup
from .html_text import extract
from .license_scan import scan_licenses
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .pii import find_pii
from .quality import ACCEPT, fit_quality, score_quality
from .toxicity import fit_toxicity, score_toxicity


def tokenizer_path() -> str:
    """The tokenizer file that production packing uses; the package that holds it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _scored(scores: DataFrame, parts: int, part: int, accept: float) -> DataFrame:
    return scores.select("doc_id", C.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~C.held_out(F.col("doc_id"), 4, 2)))
    return _scored(score_quality(docs, model), 4, 2, ACCEPT)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(C.table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1 AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM c),
f AS (SELECT max(level) FILTER (WHERE ratio >= level) AS found FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN found IS NOT NULL AND ratio >= found THEN found * weight ELSE cap END AS target
  FROM l, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (
  SELECT d.*, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken
FROM q
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(C.table(spark, sf_dir, "documents"), k=4)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~C.held_out(F.col("doc_id"), 5, 0)))
    return _scored(score_toxicity(docs, model), 5, 0, 0.5)


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_ann": op2_ann,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_html": op6_html,
        "op7_near_dedup": op7_near_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_license": op10_license,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op8_exact_dedup": OP8_SQL}
