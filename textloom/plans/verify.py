"""Whether a manifest, a configuration and an artifact agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import schema
from textloom.functions import text as T
from textloom.operators import selection
from textloom.sources import artifact, files


def stale_sources(configured: DataFrame, recorded: DataFrame) -> DataFrame:
    """source, problem of sources that the configuration and the manifest don't both have alike.

    configured, recorded: source, repo (slug), ref, resolver."""
    c = configured.select("source", F.struct("repo", "ref").alias("cr"), F.col("resolver").alias("ck"))
    m = recorded.select("source", F.struct("repo", "ref").alias("mr"), F.col("resolver").alias("mk"))
    both = c.join(m, "source", "full_outer")
    problems = F.array(
        F.when(F.col("mr").isNull(), "not in manifest"), F.when(F.col("cr").isNull(), "not in config"),
        F.when(F.col("cr") != F.col("mr"), "repo or ref differs"), F.when(F.col("ck") != F.col("mk"), "resolver differs"),
    )
    return both.select("source", F.explode(F.array_compact(problems)).alias("problem"))


def artifact_problems(pages: DataFrame, files: DataFrame) -> DataFrame:
    """id, problem: a page's file is missing, its content isn't the recorded one, or a file belongs to no page.

    pages: id, sha256; files: id, sha256 of what is there."""
    p = pages.select("id", F.col("sha256").alias("recorded"))
    f = files.select("id", F.col("sha256").alias("there"))
    both = p.join(f, "id", "full_outer")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.col("recorded") != F.col("there"), "differs")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("id", "problem")


def reproduced(manifest_pages: DataFrame, checkout: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, problems) when a manifest itself is the selection. checkout: source, path, content, sha256, commit."""
    at = commits.select("source", F.col("commit").alias("wanted"))
    found = manifest_pages.select("id", "source", "path", F.col("sha256").alias("recorded")).join(checkout, ["source", "path"], "left").join(at, "source", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("commit") != F.col("wanted"), "other commit").when(F.col("sha256") != F.col("recorded"), "differs")
    judged = found.withColumn("problem", problem)
    return judged.where("problem IS NULL").drop("problem", "wanted", "recorded"), judged.where("problem IS NOT NULL").select("id", "problem")


def recorded_residue(manifest: DataFrame, checkout: DataFrame) -> DataFrame:
    """Residue rows of a manifest's lists, with the rule that says so; listed files that the checkout lacks fail.

    checkout: source, path, content (binary). Unresolved links have no text."""
    sources = files.manifest_sources(manifest)
    facts = sources.select("source", T.repo_slug(F.concat(F.lit("https://github.com/"), "repo")).alias("slug"), "commit")
    there = checkout.select("source", "path", "content", F.lit(True).alias("found"))
    listed = files.manifest_ids(manifest, "residue").join(there, ["source", "path"], "left")
    held = F.assert_true(F.col("found").isNotNull(), F.concat("id", F.lit(" is missing from the checkout")))
    text = F.decode("content", "UTF-8")
    kept = listed.where(held.isNull()).select(
        "id", "source", "path", F.lit("not_selected").alias("reason"), F.sha2("content", 256).alias("sha256"), T.title_of(F.lit(""), text).alias("title"), T.excerpt(T.strip_front_matter(text)).alias("excerpt"),
    )
    blank = F.lit("")
    links = files.manifest_ids(manifest, "unresolved").select("id", "source", "path", F.lit("unresolved_link").alias("reason"), blank.alias("sha256"), blank.alias("title"), blank.alias("excerpt"))
    both = kept.unionByName(links).join(facts, "source")
    url = T.blob_url(F.col("slug"), F.col("commit"), F.col("path"))
    return both.select("id", "source", "path", "reason", "sha256", "title", "excerpt", blank.alias("context"), url.alias("url"), selection.rule("reproduced:from-manifest").alias("rule"))


def reproduce(manifest: DataFrame, checkout: DataFrame, commits: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, residue): write the artifact of a recorded manifest again.

    checkout: source, path, content, as fetched at the recorded commits, rendered files among them; commits: source,
    commit that were fetched. A source that lacks or has another commit is an error."""
    at = commits.select("source", F.col("commit").alias("fetched"))
    wrong = files.manifest_sources(manifest).select("source", "commit").join(at, "source", "left").where("fetched IS NULL OR fetched <> commit").orderBy("source").first()
    if wrong:
        raise artifact.ArtifactError(f"{wrong.source}: recorded is commit {wrong['commit']}, fetched {wrong.fetched or 'none'}")
    now = manifest.withColumn("artifact_version", F.lit(schema.ARTIFACT_VERSION))
    residue = recorded_residue(now, checkout)
    artifact.write(now, checkout, folder)
    return now, residue
