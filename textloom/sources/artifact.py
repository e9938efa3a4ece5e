"""The artifact folder: Markdown files by source, meta.json, residue, the manifest and derived text.

Files are written and read by the tasks through the folder's own file system, so the folder must be one that all
executors reach. A manifest is one JSON document; it and what follows from it by source are made on the driver."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import schema
from textloom.functions import text as T
from textloom.sources import files

# Names in an artifact.
MANIFEST_FILE, META_FILE, DERIVED_FILE, RESIDUE_DIR = "manifest.json", "meta.json", "derived.jsonl", "_residue"


class ArtifactError(ValueError):
    """A folder that is no artifact, a page that isn't what its manifest records, or a path that leaves the folder."""


def _store(folder: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
    return store, base.rstrip("/")


def _inside(base: str, file: str) -> str:
    if any(part in ("", ".", "..") for part in file.split("/")):
        raise ArtifactError(f"{file}: leaves the artifact")
    return f"{base}/{file}"


def manifest_record(manifest: DataFrame) -> dict:
    """The manifest as it is written: fields without a value and empty derived text are left out."""
    record = json.loads(manifest.select(F.to_json(F.struct("*"))).first()[0])
    if not record.get("derived"):
        record.pop("derived", None)
    return record


def meta_record(name: str, source: dict) -> dict:
    """What the manifest implies for a source's meta.json."""
    repo, commit = source.get("repo", ""), source.get("commit", "")
    kept = {path: {k: entry.get(k, "") for k in ("title", "doc_type", "section")} for path, entry in source.get("pages", {}).items()}
    lists = {k: source.get(k, []) for k in ("residue", "unresolved", "unrendered")}
    return {"artifact_version": schema.ARTIFACT_VERSION, "repo": repo, "module": name, "base_url": f"https://github.com/{repo}/blob/{commit}", "commit": commit, "pages": kept, **lists}


def derived_lines(manifest: DataFrame) -> DataFrame:
    """kind, page, text of the manifest's derived texts, without those of pages that it doesn't list."""
    pages = files.manifest_pages(manifest).select(F.col("id").alias("page"))
    return files.manifest_derived(manifest).select("kind", "page", "text").join(pages, "page", "left_semi").select("kind", "page", "text")


def write_derived(manifest: DataFrame, folder: str) -> None:
    """Write derived.jsonl from the manifest alone, or remove it where nothing is derived."""
    lines = derived_lines(manifest)
    store, base = _store(folder)
    if lines.isEmpty():
        kind = store.get_file_info(f"{base}/{DERIVED_FILE}").type.name
        if kind == "Directory":
            store.delete_dir(f"{base}/{DERIVED_FILE}")
        elif kind == "File":
            store.delete_file(f"{base}/{DERIVED_FILE}")
    else:
        files.write_jsonl(lines, f"{folder}/{DERIVED_FILE}", ["page", "kind"])


def prepare(folder: str) -> None:
    """An empty folder. One that has files but no manifest is refused, so that nothing else is cleared by mistake."""
    from pyarrow import fs

    store, base = _store(folder)
    if store.get_file_info(base).type.name != "NotFound":
        if store.get_file_info(fs.FileSelector(base)) and store.get_file_info(f"{base}/{MANIFEST_FILE}").type.name != "File":
            raise ArtifactError(f"{folder} has files and no {MANIFEST_FILE}; it isn't cleared")
        store.delete_dir(base)
    store.create_dir(base)


def _put(rows: DataFrame, folder: str) -> None:
    """Write rows (file, content). A file appears under its name when it is whole; a task that runs again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                target = _inside(base, file)
                at, name = posixpath.split(target)
                store.create_dir(at)
                part = f"{at}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _get(rows: DataFrame, folder: str, hashes: bool) -> DataFrame:
    """rows (with file) and the file's content, or its hash; null where there is no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for k, file in enumerate(batch.column("file").to_pylist()):
                try:
                    with store.open_input_stream(_inside(base, file)) as stream:
                        content = stream.read()
                except (FileNotFoundError, IsADirectoryError):
                    content = None
                got = hashlib.sha256(content).hexdigest() if hashes and content is not None else content
                kind = pa.string() if hashes else pa.binary()
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([got], kind)], names=[*batch.schema.names, "there"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, there {'string' if hashes else 'binary'}")


def write(manifest: DataFrame, checkout: DataFrame, folder: str) -> None:
    """Write the artifact of a manifest (one row) from checkout: source, path, content (binary).

    Every page is held against its recorded hash before the folder is touched; pages that differ or lack are an error.
    Residue that the checkout lacks is passed over. The manifest is written last."""
    spark = manifest.sparkSession
    pages = files.manifest_pages(manifest).select("id", "source", "path", F.col("sha256").alias("recorded"))
    there = checkout.select("source", "path", "content")
    hashed = there.select("source", "path", F.sha2("content", 256).alias("sha256"))
    bad = pages.join(hashed, ["source", "path"], "left").where("sha256 IS NULL OR sha256 <> recorded").orderBy("id").select("id", "recorded", "sha256").first()
    if bad:
        raise ArtifactError(f"{bad.id}: " + ("missing from the checkout" if bad.sha256 is None else f"has {bad.sha256}, recorded is {bad.recorded}"))
    record = manifest_record(manifest)
    prepare(folder)
    file = F.concat("source", F.lit("/"), "path").alias("file")
    residue = files.manifest_ids(manifest, "residue").select("source", "path").distinct()
    _put(pages.join(there, ["source", "path"]).select(file, "content"), folder)
    _put(residue.join(there, ["source", "path"]).select(F.concat(F.lit(f"{RESIDUE_DIR}/"), file).alias("file"), "content"), folder)
    metas = [(f"{name}/{META_FILE}", files.pretty([meta_record(name, source)])) for name, source in sorted(record.get("sources", {}).items())]
    _put(spark.createDataFrame(metas, "file string, content string"), folder)
    write_derived(manifest, folder)
    _put(spark.createDataFrame([(MANIFEST_FILE, files.pretty([record]))], "file string, content string"), folder)


def check(manifest: DataFrame, folder: str) -> DataFrame:
    """id, problem of an artifact held against a manifest: the manifest differs, a page is missing or differs, a
    source's meta.json differs, derived.jsonl differs. Files that the manifest doesn't name are passed over."""
    spark, record = manifest.sparkSession, manifest_record(manifest)

    def digest(value: dict) -> str:
        return hashlib.sha256(files.pretty([value]).encode()).hexdigest()

    made = [(MANIFEST_FILE, MANIFEST_FILE, digest(record), "manifest differs", "manifest differs")]
    for name, source in sorted(record.get("sources", {}).items()):
        made.append((f"{name}/{META_FILE}", f"{name}/{META_FILE}", digest(meta_record(name, source)), "meta.json differs", "meta.json differs"))
    shape = "id string, file string, recorded string, lacks string, differs string"
    pages = files.manifest_pages(manifest).select("id", F.concat("source", F.lit("/"), "path").alias("file"), F.col("sha256").alias("recorded"), F.lit("missing").alias("lacks"), F.lit("differs").alias("differs"))
    held = _get(pages.unionByName(spark.createDataFrame(made, shape)), folder, hashes=True)
    problem = F.when(F.col("there").isNull(), F.col("lacks")).when(F.col("there") != F.coalesce("recorded", F.lit("")), F.col("differs"))
    wrong = held.select("id", problem.alias("problem")).where("problem IS NOT NULL")
    wanted = derived_lines(manifest)
    path = f"{folder}/{DERIVED_FILE}"
    found = files.jsonl(spark, path, schema.DERIVED, missing_is_empty=True).select("kind", "page", "text")
    apart = wanted.exceptAll(found).unionAll(found.exceptAll(wanted)).limit(1)
    return wrong.unionByName(apart.select(F.lit(DERIVED_FILE).alias("id"), F.lit("derived.jsonl differs").alias("problem")))


def residue_pages(ids: DataFrame, root: str) -> DataFrame:
    """Pages of residue by id, from the artifact's residue folder; an id without two halves or a file fails the read."""
    halves = T.split_page_id(F.col("id"))
    shaped = F.assert_true(halves.isNotNull(), F.concat("id", F.lit(" is no id with a source and a path")))
    wanted = ids.select("id").distinct().where(shaped.isNull()).select("id", halves.alias("h")).select("id", "h.source", "h.path")
    read = _get(wanted.withColumn("file", F.concat(F.lit(f"{RESIDUE_DIR}/"), "source", F.lit("/"), "path")), root, hashes=False)
    held = F.assert_true(F.col("there").isNotNull(), F.concat("id", F.lit(" is missing from the residue")))
    return files.as_pages(read.where(held.isNull()).select("source", "path", F.col("there").alias("content")), files.artifact_meta(ids.sparkSession, root).withColumn("pages", F.lit(None).cast(files.META_PAGES)))
