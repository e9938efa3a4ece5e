"""The corpus pipeline: quality, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages that filter return the
columns of documents; the last returns the pieces of packed sequences. Empty tables give empty results. Rows with a
null id are judged like others; a null text counts as empty unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, language, packing, quality, simhash
from textloom.llm.common import materialise, read
from textloom.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go; null and empty texts are scored as texts without words."""
    labels = quality.training_labels(read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.good(docs, quality.train(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or beyond the radius of their nearest centroid, go."""
    return language.accepted(docs, language.train(language.training_rows(docs.select("doc_id", "text", "lang"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (fingerprints within 3 bits, or five-word shingles at 0.8 or more), one document stays:
    that of the smallest id, of repeated rows one, of null ids only where the group has no other."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go; those without words stay."""
    return decontamination.contaminated_filter(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Models and tokenizers have no SQL. No test holds the rows of run() against a plain version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
