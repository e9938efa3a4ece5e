"""Programs of the user's own that choose or generate pages, run on the driver, once a source.

A resolver prints a JSON object a line; a renderer reads selected pages as JSON lines and writes files below a staging
folder, printing a line for each. The programs see TEXTLOOM_SOURCE and TEXTLOOM_COMMIT in their environment."""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from textloom import schema

GENERATED = "source string, path string, source_path string, title string, doc_type string, section string, content string"


class CommandFailed(RuntimeError):
    """A program that ended with an error, or printed what can't be read."""


def _run(command: list[str], folder: str, source: str, commit: str, given: str | None = None) -> list[dict]:
    env = os.environ | {"TEXTLOOM_SOURCE": source, "TEXTLOOM_COMMIT": commit}
    done = subprocess.run(command, cwd=folder, env=env, input=given, capture_output=True, text=True)
    if done.returncode:
        raise CommandFailed(f"{source}: {command[0]} ended with {done.returncode}: {done.stderr.strip()[-500:]}")
    rows = []
    for number, line in enumerate(done.stdout.split("\n"), 1):
        if line.strip():
            try:
                rows.append(json.loads(line))
            except ValueError as bad:
                raise CommandFailed(f"{source}: line {number} is no JSON") from bad
            if not str(rows[-1].get("path") or "").strip():
                raise CommandFailed(f"{source}: line {number} has no path")
    return rows


def candidates(spark: SparkSession, source: str, command: list[str], folder: str, commit: str = "") -> DataFrame:
    """Candidates that a resolver prints; of lines for one path the last counts, and a line is a selection unless it
    says otherwise."""
    last = {row["path"]: row for row in _run(command, folder, source, commit)}
    out = []
    for path, row in sorted(last.items()):
        rule = row.get("rule")
        out.append((source, path, row.get("title") or "", row.get("doc_type") or "", row.get("section") or "", bool(row.get("selected", True)), row.get("context") or "", (rule["key"], rule["text"]) if rule else None))
    return spark.createDataFrame(out, schema.CANDIDATE)


def rendered(spark: SparkSession, source: str, command: list[str], pages: list[dict], staging: str, commit: str = "") -> DataFrame:
    """Pages that a renderer generates from selected ones. A path outside the staging folder, or a source_path that
    wasn't given, is an error."""
    known, root, out = {page["path"] for page in pages}, Path(staging).resolve(), []
    for row in _run(command, staging, source, commit, "".join(json.dumps(page) + "\n" for page in pages)):
        at = (root / row["path"]).resolve()
        if root not in at.parents:
            raise CommandFailed(f"{source}: {row['path']} is outside the staging folder")
        if row.get("source_path") not in known:
            raise CommandFailed(f"{source}: {row.get('source_path')} was not given")
        out.append((source, row["path"], row["source_path"], row.get("title") or "", row.get("doc_type") or "", row.get("section") or "", at.read_text(encoding="utf-8", errors="replace")))
    return spark.createDataFrame(out, GENERATED)
