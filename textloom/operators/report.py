"""Facts for review, gates over them, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import globs
from textloom.functions import text as T
from textloom.operators import ledgers

# Gates, in the order they are checked.
GATES = ("undecided_residue_max", "removed_pages_max", "expired_decisions_max", "archived_sources_max", "unresolved_links_max", "duplicates_max")


def summary(pages: DataFrame, residue: DataFrame, decisions: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """One row of counts. Each relation is aggregated once, to one row; those rows are then put side by side."""
    shown = ledgers.undecided(residue, decisions, include_excluded=True)
    parts = [
        pages.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("pages")),
        residue.agg(F.count("*").alias("residue"), F.count_if(F.col("reason") == "excluded").alias("excluded")),
        shown.agg(F.count("*").alias("undecided")),
        ledgers.effective(decisions).agg(F.count("*").alias("decisions")),
    ]
    if diff is not None:
        parts.append(diff.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def unresolved_by_source(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def violations(counts: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """gate, maximum, actual of gates whose count is above its maximum; gates that are not set are passed over.

    counts: one row with a column for each gate that is set."""
    rows = [F.struct(F.lit(g).alias("gate"), F.lit(m).cast("long").alias("maximum"), F.col(g).cast("long").alias("actual")) for g in GATES if (m := limits.get(g)) is not None]
    if not rows:
        return counts.sparkSession.createDataFrame([], "gate string, maximum bigint, actual bigint")
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("actual > maximum")


def gate_warnings(limits: dict[str, int | None], has_previous: bool) -> list[str]:
    """Gates that can't fail on this report."""
    if limits.get("removed_pages_max") is not None and not has_previous:
        return ["removed_pages_max is set, but without a previous manifest no page counts as removed"]
    return []


def policy_violations(pages: DataFrame, sources: DataFrame, deny: list[str], drop_archived: bool, min_pages: int) -> DataFrame:
    """kind (min_pages, archived, deny) and subject (source or page id)."""
    counted = sources.join(pages.groupBy("source").agg(F.count("*").alias("n")), "source", "left")
    out = counted.where(F.coalesce("n", F.lit(0)) < min_pages).select(F.lit("min_pages").alias("kind"), F.col("source").alias("subject"))
    if drop_archived:
        out = out.unionByName(sources.where("archived").select(F.lit("archived").alias("kind"), F.col("source").alias("subject")))
    return out.unionByName(pages.where(globs.matches(F.col("path"), deny)).select(F.lit("deny").alias("kind"), F.col("id").alias("subject")))


def page_mention(title: str, url: str) -> str:
    """A page as the report names it."""
    return f"[{title}]({url})" if url else title


def cell(text: str) -> str:
    return " ".join(text.split()).replace("|", "\\|")


def shown(residue: DataFrame) -> DataFrame:
    """Residue with the excerpt that the report shows."""
    return residue.withColumn("excerpt", T.shown_excerpt(F.col("content")))


def markdown(facts: dict[str, list[dict]]) -> str:
    """Render collected facts, section by section in a fixed order; empty sections are left out."""
    order = ["summary", "added", "removed", "changed", "new_residue", "undecided", "expired", "unresolved", "duplicates", "usage"]
    out = ["# Corpus report"]
    for name in order:
        rows = facts.get(name) or []
        if rows:
            columns = list(rows[0])
            out += ["", f"## {name.replace('_', ' ').capitalize()} ({len(rows)})", "", "| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
            out += ["| " + " | ".join(cell("" if row[c] is None else str(row[c])) for c in columns) + " |" for row in rows]
    return "\n".join(out) + "\n"
