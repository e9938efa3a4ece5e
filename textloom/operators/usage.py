"""What a log of served queries says about a corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import retrieval

_UNITS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def parse_since(text: str) -> int:
    """30d, 12h, 45m, 90s or a bare number, in seconds."""
    found = re.fullmatch(r"([+-]?\d+)([dhms]?)", text)
    if not found or not -(2**63) <= (seconds := int(found[1]) * _UNITS.get(found[2], 1)) < 2**63:
        raise ValueError(f"not a duration: {text!r}")
    return seconds


def since(trail: DataFrame, seconds: int | None, now: str) -> DataFrame:
    """Entries at or after now less `seconds`; entries whose time can't be read stay."""
    if seconds is None:
        return trail
    at = F.try_to_timestamp("at")
    return trail.where(at.isNull() | (at >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))))


def top_retrieved(retrieved: Column, ranks: Column) -> Column:
    """The id with the first least rank when ranks stand beside ids, else the first id."""
    aligned = (F.size(ranks) == F.size(retrieved)) & (F.size(ranks) > 0)
    return F.when(aligned, F.get(retrieved, (F.array_position(ranks, F.array_min(ranks)) - 1).cast("int"))).otherwise(F.get(retrieved, F.lit(0)))


def never_retrieved(pages: DataFrame, trail: DataFrame) -> DataFrame:
    return pages.select("id").distinct().join(trail.select(F.explode("retrieved").alias("id")).distinct(), "id", "left_anti")


def retrieved_never_cited(trail: DataFrame) -> DataFrame:
    got = trail.select(F.explode("retrieved").alias("id")).distinct()
    return got.join(trail.select(F.explode("cited").alias("id")).distinct(), "id", "left_anti")


def uncited_queries(trail: DataFrame) -> DataFrame:
    """query, top_retrieved of queries no entry of which cited anything; the first entry with a result gives the top."""
    top = top_retrieved(F.col("retrieved"), F.col("ranks"))
    grouped = trail.groupBy("query").agg(
        F.max(F.coalesce(F.size("cited"), F.lit(0))).alias("cited"), F.min(F.when(top.isNotNull(), F.struct("line_no", top.alias("top")))).alias("first")
    )
    return grouped.where("cited <= 0").select("query", F.col("first.top").alias("top_retrieved"))


def gap_candidates(trail: DataFrame, residue: DataFrame) -> DataFrame:
    """Uncited queries with the residue page that fits them best, if any."""
    queries = uncited_queries(trail)
    best = retrieval.residue_best(residue, queries.select("query")).toDF("query", "residue_id", "residue_score")
    return queries.join(best, "query", "left")


def uncited_by_page(queries: DataFrame) -> DataFrame:
    """top_retrieved, n, queries: uncited queries grouped by the page they got first."""
    return queries.groupBy("top_retrieved").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("query")).alias("queries"))
