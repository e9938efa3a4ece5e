"""The index as one object: build, search, read, chunks and counts over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import retrieval, sections
from textloom.sources import files


class CorpusIndex:
    """Pages with their mirrors marked, and the index over the searchable ones."""

    def __init__(self, pages: DataFrame, derived: DataFrame | None = None):
        self.pages = retrieval.mark_mirrors(pages)
        self.index = retrieval.build(self.pages, derived)

    @classmethod
    def build(cls, spark: SparkSession, artifact: str, priorities: DataFrame | None = None) -> "CorpusIndex":
        """Load an artifact folder, with the derived questions it may hold; sources without a priority have 1."""
        pages = files.artifact_pages(spark, artifact)
        pages = retrieval.with_priorities(pages, priorities) if priorities is not None else pages.withColumn("priority", F.lit(1).cast("long"))
        questions = f"{artifact}/derived.jsonl"
        return cls(pages, files.derived_questions(spark, questions) if files.exists(spark, questions) else None)

    def search(self, queries: DataFrame | str, k: int = 10, module: str | None = None) -> DataFrame:
        """Hits of many queries (query_id, query), or of one given as text."""
        if isinstance(queries, str):
            queries = self.pages.sparkSession.createDataFrame([(0, queries)], "query_id bigint, query string")
        return retrieval.search(self.index, queries, k, module)

    def read(self, page_id: str) -> str:
        row = self.pages.where(F.col("id") == page_id).select("content").first()
        if row is None:
            raise KeyError(page_id)
        return row.content

    def chunks(self) -> DataFrame:
        return sections.chunks(self.pages)

    def page_count(self) -> int:
        return self.pages.count()

    def searchable_count(self) -> int:
        return self.pages.where("mirror_of IS NULL").count()
