"""JSON Lines, manifests, artifacts and file listings as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import schema
from textloom.functions import text as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def jsonl(spark: SparkSession, path: str, kind: str, missing_is_empty: bool = False) -> DataFrame:
    """Rows of a JSON Lines file; a line that isn't JSON of the schema fails the read, blank lines are passed over."""
    if missing_is_empty and not exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def numbered_jsonl(spark: SparkSession, path: str, kind: str, missing_is_empty: bool = False) -> DataFrame:
    """As jsonl with line_no, counted from 1 over all lines of the file, blank ones too.

    A ledger is one file; its lines are numbered inside the reader's splits, and the splits' line counts (one number
    each) are added up before them, so no single task reads the file."""
    if missing_is_empty and not exists(spark, path):
        return spark.createDataFrame([], kind).withColumn("line_no", F.lit(0).cast("long"))
    raw = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    split, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = raw.groupBy(split.alias("__split")).agg(F.count("*").alias("n"))
    before = counts.select("__split", F.coalesce(F.sum("n").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    lined = raw.withColumn("__split", split).join(F.broadcast(before), "__split").select((F.col("before") + own + 1).alias("line_no"), "value")
    parsed = lined.where(F.trim("value") != "").select("line_no", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "line_no")


def trail(spark: SparkSession, path: str) -> DataFrame:
    """Served queries with line_no: lines of a newer version and ids without two halves are errors."""
    raw = numbered_jsonl(spark, path, schema.TRAIL, missing_is_empty=True)
    empty = F.array().cast("array<string>")
    filled = raw.withColumns({"version": F.coalesce("version", F.lit(1)), "retrieved": F.coalesce("retrieved", empty), "cited": F.coalesce("cited", empty), "ranks": F.coalesce("ranks", F.array().cast("array<int>"))})
    newer = F.assert_true(F.col("version") <= schema.TRAIL_VERSION, F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" has a newer version")))
    shaped = F.assert_true(F.forall(F.concat("retrieved", "cited"), lambda i: T.split_page_id(i).isNotNull()), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" has an id without a source and a path")))
    return filled.where(newer.isNull() & shaped.isNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row. A newer version of manifest or artifact is an error."""
    df = spark.read.schema(schema.MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = df.select("version", "artifact_version").first()
    schema.check_version("the manifest", head.version, schema.MANIFEST_VERSION)
    schema.check_version("its artifact", head.artifact_version, schema.ARTIFACT_VERSION)
    return df


def manifest_sources(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_entries("sources")).alias("s")).select(F.col("s.key").alias("source"), "s.value.*")


def manifest_pages(df: DataFrame) -> DataFrame:
    """id, source, path and the page's entry, one row a page."""
    pages = manifest_sources(df).select("source", F.explode(F.map_entries("pages")).alias("p"))
    return pages.select(T.page_id(F.col("source"), F.col("p.key")).alias("id"), "source", F.col("p.key").alias("path"), "p.value.*")


def manifest_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids of a manifest's lists: residue, unresolved or unrendered."""
    return manifest_sources(df).select("source", F.explode(column).alias("path")).select(T.page_id(F.col("source"), F.col("path")).alias("id"), "source", "path")


def manifest_derived(df: DataFrame) -> DataFrame:
    pages = df.select(F.explode(F.map_entries("derived")).alias("p")).select(F.col("p.key").alias("page"), F.explode(F.map_entries("p.value")).alias("k"))
    return pages.select("page", F.col("k.key").alias("kind"), "k.value.*")


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path (relative), content, length of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    base = F.concat(F.regexp_replace(F.lit(root), "^file:/*", "/"), F.lit("/"))
    whole = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/*", "/")
    at = F.instr(whole, base)
    return reader.load(root).select(F.substring(whole, at + F.length(base), F.length(whole)).alias("path"), "content", "length")


def artifact_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of an artifact folder (<source>/.../*.md beside <source>/meta.json): names that begin with _ are skipped."""
    files = listing(spark, root, "*.md")
    source = F.substring_index("path", "/", 1)
    inner = F.substring(F.col("path"), F.length(source) + 2, F.length("path"))
    files = files.where(F.col("path").contains("/") & ~source.startswith("_")).select(source.alias("source"), inner.alias("path"), "content")
    return as_pages(files, artifact_meta(spark, root))


#: Type of meta.json's pages.
META_PAGES = "map<string,struct<title:string,doc_type:string,section:string>>"


def as_pages(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Pages of files (source, path, content) with what the meta rows of their sources say of them."""
    text = F.decode(F.col("content"), "UTF-8")
    nav = meta.select("source", F.explode_outer(F.map_entries("pages")).alias("e")).select("source", F.col("e.key").alias("path"), F.col("e.value").alias("nav"))
    facts = meta.select("source", "repo", "module", "base_url")
    df = files.join(nav, ["source", "path"], "left").join(facts, "source", "left").withColumn("raw", text)
    return df.select(
        T.page_id(F.col("source"), F.col("path")).alias("id"), "source", "path", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("module", "source").alias("module"),
        T.title_of(F.coalesce("nav.title", F.lit("")), F.col("raw")).alias("title"), F.coalesce(T.first_h1(F.col("raw")), F.lit("")).alias("heading"),
        F.coalesce("nav.doc_type", F.lit("")).alias("doc_type"), F.coalesce("nav.section", F.lit("")).alias("section"), T.clean_content(F.col("raw")).alias("content"), F.sha2("content", 256).alias("sha256"),
    )


def artifact_meta(spark: SparkSession, root: str) -> DataFrame:
    """One row a source; an unreadable meta.json is empty, a newer version an error."""
    files = listing(spark, root, "meta.json").where(F.size(F.split("path", "/")) == 2)
    parsed = files.select(F.substring_index("path", "/", 1).alias("source"), F.from_json(F.decode(F.col("content"), "UTF-8"), schema.META).alias("m")).select("source", "m.*")
    known = F.assert_true(F.coalesce("artifact_version", F.lit(0)) <= schema.ARTIFACT_VERSION, F.concat("source", F.lit(" has a newer artifact version")))
    return parsed.where(known.isNull())


def derived_questions(spark: SparkSession, path: str) -> DataFrame:
    """page_id, text: the last line of each page; other kinds are passed over."""
    rows = numbered_jsonl(spark, path, schema.DERIVED, missing_is_empty=True).where("kind = 'questions'")
    last = rows.groupBy("page").agg(F.max(F.struct("line_no", "text")).alias("r"))
    return last.select(F.col("page").alias("page_id"), F.array_join("r.text", "\n").alias("text"))


def write_jsonl(df: DataFrame, path: str, order: list[str], append: bool = False) -> None:
    """Sorted lines with keys in alphabetical order, written by Spark's own committer."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    out = df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order).select(line.alias("value"))
    out.write.mode("append" if append else "overwrite").text(path)


def pretty(rows: list[dict]) -> str:
    """Sorted keys, two spaces, a line feed at the end."""
    return json.dumps(rows[0] if len(rows) == 1 else rows, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_artifact(pages: DataFrame, path: str) -> None:
    """Pages as Parquet, a folder a source, into a folder that isn't there yet; rows whose content isn't what their hash
    says fail the write. `artifact.write` makes the folder of Markdown files."""
    checked = pages.where(F.assert_true(F.col("sha256") == F.sha2("content", 256), F.concat(F.lit("hash of "), "id")).isNull())
    checked.write.mode("errorifexists").partitionBy("source").parquet(path)
