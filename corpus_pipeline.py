"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing, each stage over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet to the shared folder and
reads it again as the next one's docs. All but the last return the columns of documents. Stages leave clean documents
alone: quality drops what the classifier rejects, the dedup stages drop all but one of a group, mixing repeats or leaves
out documents by their source's target, packing gives the pieces of sequences.

Stages judge and drop rows, not ids: rows that repeat an id with different texts are documents of their own, and of rows that
are the same in id and text one stays. Null texts count as empty: quality judges them like any empty text; all of them, and
empty texts, are one group of exact copies; near_dedup keeps texts without words; mixing leaves out documents without words;
packing gives them their end mark. A row with a null id is never anyone's near copy. Texts of any length are read whole.
Empty tables go through as empty tables; columns beyond those of documents are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common as C
from quillspark.llm.exact_dedup import drop_exact_copies
from quillspark.llm.mixing import mix, repeated
from quillspark.llm.near_dedup import drop_near_copies
from quillspark.llm.packing import pack
from quillspark.llm.quality import accepted, fit_quality
from quillspark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from rows of ``labels`` that are not held out."""
    labels = C.table(spark, sf_dir, "labels").where(~C.held_out(F.col("doc_id"), 4, 2))
    return accepted(docs, fit_quality(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id (as the tries' terminal nodes hold; only the
    contract of op8 asks for the largest)."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id. Five-word shingles, as stages take them (only the
    contract of op7 asks for four), similarity 0.8."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents repeated, whole or in part, as their source's target says."""
    return repeated(docs, C.saved(mix(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = C.saved(stage(spark, docs, sf_dir))
    return docs
