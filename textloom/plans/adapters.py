"""The driver's tables as the engine's relations, in Spark and in SQL.

A document is a page: its source as it is, docs/<id>.md as its path, its first line as title, its second as heading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import assist


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    parts = F.split("text", "\n")
    return docs.select(
        "doc_id", T.page_id(F.col("source"), path).alias("id"), "source", path.alias("path"), F.col("source").alias("module"),
        F.get(parts, F.lit(0)).alias("title"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("heading"),
        (1 + F.regexp_extract("source", "([0-9]+)", 1).cast("long") % 5).alias("priority"), F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"),
        F.element_at(F.array(F.lit("resolver"), F.lit("decision"), F.lit("include")), (F.col("doc_id") % 3 + 1).cast("int")).alias("selected_by"),
        F.concat(F.lit("https://github.com/acme/"), "source", F.lit("/blob/c1/"), path).alias("url"),
    )


PAGES = """pages AS (SELECT doc_id, source || '::docs/' || doc_id || '.md' AS id, source, 'docs/' || doc_id || '.md' AS path, source AS module,
  split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS heading, 1 + CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 5 AS priority,
  text AS content, sha256(text) AS sha256, ['resolver', 'decision', 'include'][CAST(doc_id % 3 + 1 AS INTEGER)] AS selected_by FROM documents)"""


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with headings and fences put in by line number."""
    marked = F.transform(F.col("ls"), lambda x, i: F.when(i % 11 == 7, F.lit("```")).when(i % 4 == 1, F.concat(F.lit("## "), x)).when(i % 4 == 3, F.concat(F.lit("### "), x)).otherwise(x))
    return pages(spark, sf_dir).withColumn("ls", F.split("content", "\n")).withColumn("content", F.array_join(marked, "\n")).drop("ls").withColumn("mirror_of", F.lit(None).cast("string"))


MARKDOWN = """md_lines AS (SELECT id, title, i, CASE WHEN i % 11 = 7 THEN '```' WHEN i % 4 = 1 THEN '## ' || l WHEN i % 4 = 3 THEN '### ' || l ELSE l END AS line
  FROM (SELECT id, title, unnest(range(len(string_split(content, chr(10))))) AS i, unnest(string_split(content, chr(10))) AS l FROM pages))"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages stand as residue, with a reason by remainder."""
    rows = pages(spark, sf_dir).where("doc_id % 3 = 0")
    reason = F.when(F.col("doc_id") % 5 == 0, "excluded").when(F.col("doc_id") % 5 == 1, "new_source").otherwise("not_selected")
    key = F.when(F.col("doc_id") % 5 == 0, "policy:deny").when(F.col("doc_id") % 5 == 1, "source:new")
    return rows.withColumns({"reason": reason, "rule": F.when(key.isNotNull(), F.struct(key.alias("key"), F.concat(F.lit("because of "), key).alias("text")))})


RESIDUE = """residue AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'excluded' WHEN doc_id % 5 = 1 THEN 'new_source' ELSE 'not_selected' END AS reason,
  CASE WHEN doc_id % 5 = 0 THEN 'policy:deny' WHEN doc_id % 5 = 1 THEN 'source:new' END AS rule_key FROM pages WHERE doc_id % 3 = 0)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from labels; every seventh is made for an older text, and every fifth is followed by another verdict."""
    base = table(spark, sf_dir, "labels").join(pages(spark, sf_dir).select("doc_id", "id", "sha256"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "include").otherwise("unsure")
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256"))
    first = base.select("id", sha.alias("sha256"), verdict.alias("decision"), F.lit("by label").alias("reason"), F.lit("labeller").alias("by"), F.lit("").alias("at"), F.col("doc_id").alias("line_no"))
    again = base.where("doc_id % 5 = 0").select("id", "sha256", F.lit("exclude").alias("decision"), F.lit("second look").alias("reason"), F.lit("").alias("by"), F.lit("").alias("at"), (F.col("doc_id") + 1_000_000_000).alias("line_no"))
    return first.unionByName(again)


DECISIONS = """base AS (SELECT l.*, id, sha256 FROM labels l JOIN pages USING (doc_id)),
decisions AS (SELECT id, CASE WHEN doc_id % 7 = 0 THEN repeat('0', 64) ELSE sha256 END AS sha256, CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 THEN 'include' ELSE 'unsure' END AS decision,
    'by label' AS reason, 'labeller' AS by, doc_id AS line_no FROM base
  UNION ALL SELECT id, sha256, 'exclude', 'second look', '', doc_id + 1000000000 FROM base WHERE doc_id % 5 = 0),
effective AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old pages, new pages, new residue): parts of the pages, some with another text, one source gone and one new."""
    every = pages(spark, sf_dir).select("doc_id", "id", "source", "path", "sha256", "title", "content")
    old = every.where("doc_id % 10 <> 3 AND source <> 'src7'")
    changed = F.col("doc_id") % 7 == 0
    new = every.where("doc_id % 10 <> 4 AND source <> 'src8'").withColumns(
        {"content": F.when(changed, F.concat("content", F.lit("\nadded"))).otherwise(F.col("content")), "sha256": F.when(changed, F.sha2(F.concat("content", F.lit("\nadded")), 256)).otherwise(F.col("sha256"))}
    )
    return old, new, every.where("doc_id % 20 = 4").select("id")


SNAPSHOTS = """old AS (SELECT * FROM pages WHERE doc_id % 10 <> 3 AND source <> 'src7'),
new AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN sha256(content || chr(10) || 'added') ELSE sha256 END AS sha256) FROM pages WHERE doc_id % 10 <> 4 AND source <> 'src8'),
listed AS (SELECT id FROM pages WHERE doc_id % 20 = 4)"""


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served queries from events: a click cites what a view retrieves."""
    e = table(spark, sf_dir, "events")
    ids = F.array(*(F.concat(F.lit("src"), ((F.col("event_id") + k) % 20).cast("string"), F.lit("::docs/"), ((F.col("event_id") * 7 + k) % 1500).cast("string"), F.lit(".md")) for k in range(3)))
    query = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    empty = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").alias("line_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), query.alias("query"),
        F.when(F.col("event_type") == "error", empty).otherwise(ids).alias("retrieved"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit(2), F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("ranks"),
        F.when(F.col("event_type") == "purchase", F.slice(ids, 1, 1)).otherwise(empty).alias("cited"),
    )


TRAIL = """trail AS (SELECT event_id AS line_no, ts, event_type || '-' || user_id AS query,
  CASE WHEN event_type = 'error' THEN [] ELSE [ 'src' || ((event_id + k) % 20) || '::docs/' || ((event_id * 7 + k) % 1500) || '.md' for k in range(3) ] END AS retrieved, event_id % 2 = 0 AS ranked,
  CASE WHEN event_type = 'purchase' THEN [ 'src' || (event_id % 20) || '::docs/' || (event_id * 7 % 1500) || '.md' ] ELSE [] END AS cited FROM events)"""


#: What the derived texts of the fixture were asked with.
QUESTIONS, PROMPT = 3, "Write questions that this page answers."


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every other page, those of every seventh for an older text, and some of pages that are gone."""
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256"))
    page = F.when(F.col("doc_id") % 22 == 0, F.concat(F.lit("gone::"), "path")).otherwise(F.col("id"))
    rows = pages(spark, sf_dir).where("doc_id % 2 = 0")
    return rows.select(page.alias("page"), F.lit("questions").alias("kind"), assist.freshness(sha, QUESTIONS, PROMPT).alias("input_sha256"), F.lit("scripted").alias("model"))


DERIVED = f"""inputs AS (SELECT *, sha256(concat_ws(chr(10), 'questions-v1', sha256, '{QUESTIONS}', '{PROMPT}')) AS input_sha256 FROM pages),
derived AS (SELECT CASE WHEN doc_id % 22 = 0 THEN 'gone::' || path ELSE id END AS page,
  CASE WHEN doc_id % 7 = 0 THEN sha256(concat_ws(chr(10), 'questions-v1', repeat('0', 64), '{QUESTIONS}', '{PROMPT}')) ELSE input_sha256 END AS input_sha256 FROM inputs WHERE doc_id % 2 = 0)"""


def navigation_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A navigation file for every page: a sidebar with its title over its heading, a summary with drafts and fences, a
    sitemap with addresses in both cases."""
    label = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\[\]]", ""))
    number = F.col("doc_id").cast("string")

    def literal(column: str):
        made = F.to_json(F.array(F.coalesce(column, F.lit(""))))
        return F.substring(made, F.lit(2), F.length(made) - 2)

    text = {
        "vitepress": F.concat(
            F.lit("import x from 'y'\nexport default { title: 'T', // {\n sidebar: [ { text: "), literal("title"), F.lit(", items: [ { text: "), literal("heading"), F.lit(", link: '/"), number,
            F.lit("', }, ] }, /* [ */ { text: \"Home\", link: `/` } ] }"),
        ),
        "mdbook": F.concat(F.lit("# Summary\n\n- [Start](start.md)\n- [Draft]()\n# "), "source", F.lit("\n```\n- [No](no.md)\n```\n  - ["), label, F.lit("]( docs/"), number, F.lit(".md )\n")),
        "sitemap": F.concat(F.lit("<urlset><url><loc>\n https://x/"), "source", F.lit("/"), number, F.lit(".html </loc></url>\n<url><LOC>https://x/"), number, F.lit("</LOC></url></urlset>")),
    }[kind]
    return pages(spark, sf_dir).select("source", F.lit("docs").alias("base"), text.alias("text"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of one source and one page for every page."""
    empty = F.array().cast("array<string>")
    text = F.lit("").cast("string")
    entry = F.struct("sha256", "title", text.alias("doc_type"), text.alias("section"), "selected_by", F.lit(None).cast("string").alias("rendered_from"))
    source = F.struct(
        F.lit("acme/x").alias("repo"), F.lit("main").alias("ref"), F.lit("c1").alias("commit"), F.create_map("path", entry).alias("pages"),
        F.array(F.concat(F.lit("more/"), "path")).alias("residue"), empty.alias("unresolved"), empty.alias("unrendered"),
    )
    return pages(spark, sf_dir).select(F.lit(1).alias("version"), F.lit(1).alias("artifact_version"), F.create_map("source", source).alias("sources"))
