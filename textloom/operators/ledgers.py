"""Decision ledgers, residue, and the registry of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("include", "exclude", "unsure")
REASONS = ("not_selected", "excluded", "new_source", "unresolved_link")


def effective(decisions: DataFrame) -> DataFrame:
    """The last line of every id: a partial maximum, so a much decided page costs one row a task."""
    fields = [c for c in decisions.columns if c not in ("id", "line_no")]
    last = decisions.groupBy("id").agg(F.max(F.struct("line_no", *fields)).alias("d"))
    return last.select("id", F.col("d.line_no").alias("line_no"), *(F.col(f"d.{c}").alias(c) for c in fields))


def applies(decision_hash: Column, page_hash: Column) -> Column:
    """A decision holds while the page's hash is the one it was made for; an empty hash never is."""
    return F.coalesce((page_hash != "") & (decision_hash == page_hash), F.lit(False))


def expired(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """id, decision, why (gone or changed) of effective decisions that no longer hold. current: id, sha256."""
    now = current.select("id", F.col("sha256").alias("current")).dropDuplicates(["id"])
    joined = effective(decisions).join(now, "id", "left")
    why = F.when(F.col("current").isNull(), "gone").when(F.col("current") != F.col("sha256"), "changed")
    return joined.withColumn("why", why).where("why IS NOT NULL").select("id", "decision", "sha256", "current", "why")


def with_decision(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add the verdict of the effective decision that holds for each row (id, sha256), or null."""
    held = effective(decisions).select("id", F.col("sha256").alias("__sha"), F.col("decision").alias("verdict"), F.col("reason").alias("decided_why"), F.col("by").alias("decided_by"))
    joined = rows.join(held, "id", "left")
    holds = applies(F.col("__sha"), F.col("sha256"))
    return joined.withColumns({c: F.when(holds, F.col(c)) for c in ("verdict", "decided_why", "decided_by")}).drop("__sha")


def undecided(residue: DataFrame, decisions: DataFrame, source: str | None = None, reason: str | None = None, include_excluded: bool = False) -> DataFrame:
    """Residue without a decision that holds; excluded rows only when asked for."""
    if source is not None:
        residue = residue.where(F.col("source") == source)
    if reason is not None:
        residue = residue.where(F.col("reason") == reason)
    if not include_excluded and reason != "excluded":
        residue = residue.where(F.col("reason") != "excluded")
    return with_decision(residue, decisions).where("verdict IS NULL").drop("verdict", "decided_why", "decided_by")


def active_excludes(residue: DataFrame, decisions: DataFrame) -> DataFrame:
    return with_decision(residue, decisions).where("verdict = 'exclude'").select("id").distinct()


def new_residue(residue: DataFrame, decisions: DataFrame, previous_ids: DataFrame) -> DataFrame:
    """Undecided residue that the previous manifest listed neither as residue nor as unresolved."""
    return undecided(residue, decisions).join(previous_ids.select("id").distinct(), "id", "left_anti")


def by_rule(residue: DataFrame) -> DataFrame:
    """rule_text, rule_key, n, ids: groups of one rule; rows without one stand under a rule of their own."""
    # What stands for a missing rule.
    key, text = F.coalesce("rule.key", F.lit("unknown")), F.coalesce("rule.text", F.lit("no rule recorded"))
    grouped = residue.groupBy(text.alias("rule_text"), key.alias("rule_key"))
    return grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy("rule_text", "rule_key")


def decide(decisions: DataFrame, residue: DataFrame, pages: DataFrame, identity: str, verdict: str, reason: str = "", by: str = "", at: str = "") -> DataFrame:
    """One decision row to append: the hash is the residue's, else the manifest's. Unknown ids and verdicts are errors."""
    if verdict not in VERDICTS:
        raise ValueError(f"unknown verdict {verdict!r}")
    known = residue.where("sha256 <> ''").select("id", "sha256", F.lit(0).alias("o")).unionByName(pages.select("id", "sha256", F.lit(1).alias("o")))
    found = known.where(F.col("id") == identity).orderBy("o").limit(1).collect()
    if not found:
        raise KeyError(identity)
    return decisions.sparkSession.createDataFrame([(identity, found[0].sha256, verdict, reason, by, at)], "id string, sha256 string, decision string, reason string, by string, at string")


def registry(pages: DataFrame, residue: DataFrame) -> DataFrame:
    """id, source, path, sha256, title, status: manifest pages and residue, the first row (by source and path) of an id
    within its status."""
    both = pages.select("id", "source", "path", "sha256", "title", F.lit("selected").alias("status")).unionByName(
        residue.select("id", "source", "path", "sha256", "title", F.lit("residue").alias("status"))
    )
    first = both.groupBy("id", "status").agg(F.min(F.struct("source", "path", "sha256", "title")).alias("r"))
    return first.select("id", "r.source", "r.path", "r.sha256", "r.title", "status")


def lookup(registered: DataFrame) -> DataFrame:
    """One row an id; a selected page hides residue of its id."""
    best = registered.groupBy("id").agg(F.max(F.struct((F.col("status") == "selected").alias("s"), "source", "path", "sha256", "title", "status")).alias("r"))
    return best.select("id", "r.source", "r.path", "r.sha256", "r.title", "r.status")


def add_artifact_only(registered: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded pages that the registry doesn't know, added as artifact_only."""
    more = loaded.join(registered.select("id"), "id", "left_anti").select("id", "source", "path", "sha256", "title", F.lit("artifact_only").alias("status"))
    return registered.unionByName(more)
