"""From files and candidates to pages and residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import globs
from textloom.functions import text as T
from textloom.operators import ledgers

# Rule keys and their sentences.
RULES = {
    "sidebar:unlinked": "not linked from `{}`",
    "docusaurus:unlinked": "not linked from `{}`",
    "mdbook:unlinked": "not linked from `{}`",
    "sitemap:unlisted": "not listed in `{}`",
    "glob:extension": "not one of the configured extensions ({})",
    "glob:outside-include": "outside the configured include patterns",
    "external:not-selected": "the resolver command reported it unselected",
    "external:unmatched": "outside the paths the resolver command's output covers",
    "nav:dangling-link": "linked from `{}` but the file does not exist",
    "external:dangling-link": "the resolver command reported a page that does not exist in the checkout",
    "policy:deny": "matches `policy.deny` (`{}`)",
    "resolver:exclude": "matches `resolver.exclude` (`{}`)",
    "decision:exclude": "excluded by {}: {}",
    "source:archived": "the source is archived upstream and policy.archived is drop",
    "source:new": "the source appeared after the previous manifest, so nothing in it has been reviewed yet",
    "reproduced:from-manifest": "recomputed by `resolve --from-manifest`; the original resolver did not run",
}


def rule(key: str, *values: Column) -> Column:
    pieces, out = RULES[key].split("{}"), []
    for k, piece in enumerate(pieces):
        out.append(F.lit(piece))
        if k < len(values):
            out.append(values[k])
    return F.struct(F.lit(key).alias("key"), F.concat(*out).alias("text"))


def glob_candidates(files: DataFrame, include: list[str], extensions: list[str], residue_scope: list[str]) -> DataFrame:
    """Candidates of a glob source: files in scope, selected when a pattern and the extension match.
    files: source, path."""
    chosen = globs.matches(F.col("path"), include) & globs.has_extension(F.col("path"), extensions)
    scope = globs.matches(F.col("path"), residue_scope or include)
    return files.where(chosen | scope).select("source", "path", chosen.alias("selected"))


def not_selected(resolver: str, nav_file: str = "", include: list[str] = (), extensions: list[str] = (), mentioned: Column | None = None, own: Column | None = None) -> Column:
    """Why a resolver didn't select a file: a rule for `classify`.

    glob tells a wrong extension from a path outside its patterns; external takes the rule that its command gave
    (`own`), else tells paths the command named (`mentioned`) from others; the rest name their navigation file."""
    if resolver == "glob":
        listed = F.lit(", ".join(extensions) or "none configured")
        wrong = globs.matches(F.col("path"), list(include)) & ~globs.has_extension(F.col("path"), list(extensions))
        return F.when(wrong, rule("glob:extension", listed)).otherwise(rule("glob:outside-include"))
    if resolver == "external":
        plain = F.when(mentioned if mentioned is not None else F.lit(False), rule("external:not-selected")).otherwise(rule("external:unmatched"))
        return F.coalesce(own, plain) if own is not None else plain
    key = {"vitepress": "sidebar:unlinked", "docusaurus": "docusaurus:unlinked", "mdbook": "mdbook:unlinked", "sitemap": "sitemap:unlisted"}[resolver]
    return rule(key, F.lit(nav_file))


def match_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Full outer join of candidates and files: has_file, is_candidate beside the columns of both."""
    return candidates.withColumn("is_candidate", F.lit(True)).join(files.withColumn("has_file", F.lit(True)), ["source", "path"], "full_outer").withColumns(
        {"has_file": F.coalesce("has_file", F.lit(False)), "is_candidate": F.coalesce("is_candidate", F.lit(False))}
    )


def unresolved(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose file is missing."""
    return candidates.join(files.select("source", "path"), ["source", "path"], "left_anti")


def include_extra(candidates: DataFrame, files: DataFrame, include: list[str]) -> DataFrame:
    """Files that match `include` and have no candidate at all."""
    return files.where(globs.matches(F.col("path"), include)).join(candidates.select("source", "path"), ["source", "path"], "left_anti")


def scope_fill(candidates: DataFrame, files: DataFrame, in_scope: Column, decided_ids: DataFrame) -> DataFrame:
    """Files in scope, or with any decision on record, that have no candidate: bare, unselected candidates."""
    bare = files.join(candidates.select("source", "path"), ["source", "path"], "left_anti").withColumn("id", T.page_id(F.col("source"), F.col("path")))
    recorded = bare.join(decided_ids.select("id").distinct().withColumn("__decided", F.lit(True)), "id", "left")
    return recorded.where(in_scope | F.col("__decided").isNotNull()).select("source", "path", F.lit(False).alias("selected"))


def precedence(denied: Column, excluded: Column, verdict: Column, selected_by: Column) -> Column:
    """deny, then exclude, then a decision's include or exclude, then the resolver."""
    return (
        F.when(denied, "denied").when(excluded, "excluded").when(verdict == "include", "selected:decision")
        .when(verdict == "exclude", "residue:decision").when(selected_by.isNotNull(), F.concat(F.lit("selected:"), selected_by)).otherwise("residue:not_selected")
    )


def classify(rows: DataFrame, decisions: DataFrame, deny: list[str], exclude: list[str], mention: str | None = None, not_selected: Column | None = None) -> DataFrame:
    """Add outcome, selected_by, reason and rule to candidates with a file.

    rows: id, source, path, sha256, text, selected, by (resolver or include), new_source (boolean). Ordinary residue
    that doesn't mention `mention` (a regular expression) is dropped."""
    path = F.col("path")
    df = ledgers.with_decision(rows, decisions)
    denied, excluded = globs.matches(path, deny), globs.matches(path, exclude)
    df = df.withColumn("outcome", precedence(denied, excluded, F.col("verdict"), F.when(F.col("selected"), F.col("by"))))
    if mention is not None:
        df = df.where(~F.col("outcome").startswith("residue:") | F.col("text").rlike(mention))
    reason = F.when(F.col("outcome").isin("denied", "excluded"), "excluded").when(F.col("outcome").startswith("residue:"), F.when(F.col("new_source"), "new_source").otherwise("not_selected"))
    by = F.coalesce(T.nonempty(F.col("decided_by")), F.lit("a decision"))
    why = F.coalesce(T.nonempty(F.col("decided_why")), F.lit("no reason given"))
    plain = not_selected if not_selected is not None else F.struct(F.lit("not_selected").alias("key"), F.lit("the resolver did not select it").alias("text"))
    found = (
        F.when(F.col("outcome") == "denied", rule("policy:deny", globs.first_match(path, deny))).when(F.col("outcome") == "excluded", rule("resolver:exclude", globs.first_match(path, exclude)))
        .when(F.col("outcome") == "residue:decision", rule("decision:exclude", by, why)).when((F.col("outcome") == "residue:not_selected") & F.col("new_source"), rule("source:new"))
        .when(F.col("outcome") == "residue:not_selected", plain)
    )
    selected_by = F.when(F.col("outcome").startswith("selected:"), F.substring("outcome", 10, 100))
    return df.withColumns({"selected_by": selected_by, "reason": reason, "rule": found}).drop("verdict", "decided_by", "decided_why")


def archived_drop(pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that stay, residue of archived sources) under a policy that drops archived sources."""
    gone = sources.where("archived").select("source")
    dropped = pages.join(gone, "source", "left_semi").withColumns({"reason": F.lit("excluded"), "rule": rule("source:archived")})
    return pages.join(gone, "source", "left_anti"), dropped


def new_sources(sources: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Add new_source: only with a previous manifest that lacks the source."""
    if previous is None:
        return sources.withColumn("new_source", F.lit(False))
    known = previous.select("source").distinct().withColumn("__known", F.lit(True))
    return sources.join(known, "source", "left").withColumn("new_source", F.col("__known").isNull()).drop("__known")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve navigation links (source, base, link, ...) against files (source, path): add target, resolved.

    External, anchor and empty links are left out; others try their file, or .md, .mdx, README.md and index.md of it."""
    link = T.trim_unicode(F.col("link"))
    plain = F.get(F.split(link, "[#?]"), F.lit(0))
    df = links.where((link != "") & ~link.rlike("^(?:https?://|//|mailto:)") & (plain != ""))
    joined = T.join_path(F.col("base"), F.regexp_replace(plain, "^/", ""))
    guesses = (
        F.when(T.is_markdown(joined), F.array(joined)).when(joined == "", F.array(F.lit("README.md"), F.lit("index.md")))
        .otherwise(F.array(*(F.concat(joined, F.lit(end)) for end in (".md", ".mdx", "/README.md", "/index.md"))))
    )
    keys = [c for c in df.columns if c != "link"] + ["link"]
    tried = df.select(*keys, F.posexplode(guesses).alias("guess", "path")).join(files.select("source", "path", F.lit(True).alias("there")), ["source", "path"], "left")
    best = tried.groupBy(*keys).agg(
        F.min(F.when(F.col("there"), F.struct("guess", "path"))).alias("found"), F.min(F.struct("guess", "path")).alias("first")
    )
    return best.select(*keys, F.coalesce("found.path", "first.path").alias("target"), F.col("found").isNotNull().alias("resolved"))
