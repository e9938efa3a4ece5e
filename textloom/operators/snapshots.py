"""Comparing two manifests."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_diff(old: DataFrame, new: DataFrame, new_residue: DataFrame) -> DataFrame:
    """id, change (added, removed, changed), title, old_sha256, new_sha256, reason of removals.

    old, new: id, source, sha256, title; new_residue: id. Both sides meet once, in a full outer join on id."""
    o = old.select("id", F.col("source").alias("os"), F.col("sha256").alias("old_sha256"), F.col("title").alias("ot"))
    n = new.select("id", F.col("source").alias("ns"), F.col("sha256").alias("new_sha256"), F.col("title").alias("nt"))
    both = o.join(n, "id", "full_outer")
    change = F.when(F.col("os").isNull(), "added").when(F.col("ns").isNull(), "removed").when(F.col("old_sha256") != F.col("new_sha256"), "changed")
    both = both.withColumn("change", change).where("change IS NOT NULL")
    sources = new.select(F.col("source").alias("os"), F.lit(True).alias("source_there")).distinct()
    listed = new_residue.select("id", F.lit(True).alias("listed")).distinct()
    both = both.join(sources, "os", "left").join(listed, "id", "left")
    reason = F.when(F.col("change") == "removed", F.when(F.col("source_there").isNull(), "source_removed").when(F.col("listed"), "dropped_by_resolver").otherwise("gone_upstream"))
    return both.select("id", "change", F.coalesce("nt", "ot").alias("title"), "old_sha256", "new_sha256", reason.alias("reason"))


def source_diff(old: DataFrame, new: DataFrame, old_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """source, status, old_commit, new_commit. A source is unchanged when its commit and all its page entries are.

    Page entries are compared as order-free sums of row hashes and counts: one partial aggregation a side."""

    def digest(pages: DataFrame, name: str) -> DataFrame:
        columns = sorted(c for c in pages.columns if c not in ("source", "id"))
        return pages.groupBy("source").agg(
            F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))).alias(name)
        )

    o = old.select("source", F.col("commit").alias("old_commit")).join(digest(old_pages, "od"), "source", "left")
    n = new.select("source", F.col("commit").alias("new_commit")).join(digest(new_pages, "nd"), "source", "left")
    both = o.withColumn("o", F.lit(True)).join(n.withColumn("n", F.lit(True)), "source", "full_outer")
    same = F.col("old_commit").eqNullSafe(F.col("new_commit")) & F.col("od").eqNullSafe(F.col("nd"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select("source", status.alias("status"), "old_commit", "new_commit")


def is_empty(pages: DataFrame, sources: DataFrame) -> bool:
    """No page and no source differs; a commit that moved alone counts as a difference."""
    return pages.isEmpty() and sources.where("status <> 'unchanged'").isEmpty()


def removed_reasons(diff: DataFrame, excludes: DataFrame) -> DataFrame:
    """Removed pages, with an exclude decision that holds as the reason unless their source is gone."""
    held = excludes.select("id", F.lit(True).alias("held")).distinct()
    reason = F.when(F.col("held") & (F.col("reason") != "source_removed"), "excluded_by_decision").otherwise(F.col("reason"))
    return diff.where("change = 'removed'").join(held, "id", "left").select("id", "title", reason.alias("reason"))


def count_lines(old: str | None, new: str | None) -> tuple[int, int]:
    """(added, removed) lines by the longest common subsequence; 0 and 0 where a side is missing.

    Common ends are cut off first; the rest is counted over the positions at which lines match (patience in the
    Hunt-Szymanski way), whose cost follows the matches rather than the product of the lengths."""
    from bisect import bisect_left

    if old is None or new is None:
        return 0, 0
    a, b = _lines(old), _lines(new)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    places: dict[str, list[int]] = {}
    for at, line in enumerate(b):
        places.setdefault(line, []).append(at)
    tails: list[int] = []
    for line in a:
        for at in reversed(places.get(line, ())):
            k = bisect_left(tails, at)
            tails[k : k + 1] = [at]
    return len(b) - len(tails), len(a) - len(tails)


def _lines(text: str) -> list[str]:
    parts = [p.removesuffix("\r") for p in text.split("\n")]
    return parts[:-1] if parts[-1] == "" else parts


def _line_diff():
    """The pandas UDF over (old, new); made when it is used, since workers import this module without a session."""

    def count(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_lines(a, b) for a, b in zip(old, new, strict=True)], columns=["added", "removed"])

    return F.pandas_udf(count, "added int, removed int")


def with_line_counts(diff: DataFrame, old_text: DataFrame, new_text: DataFrame) -> DataFrame:
    """Add lines_added and lines_removed of changed pages. Only their texts are joined."""
    changed = diff.where("change = 'changed'")
    o, n = old_text.select("id", F.col("content").alias("__old")), new_text.select("id", F.col("content").alias("__new"))
    counted = changed.join(o, "id", "left").join(n, "id", "left").withColumn("__d", _line_diff()("__old", "__new"))
    return counted.withColumns({"lines_added": F.col("__d.added"), "lines_removed": F.col("__d.removed")}).drop("__d", "__old", "__new")
