"""Model-assisted steps: verdicts on residue and duplicates in batches, and derived questions with their freshness.

The model is reached through a transport that the caller injects: a picklable callable (model, messages) -> (status,
text). Calls run in tasks; a batch is one call. Results are written before they are used again, since a lazy plan
would ask twice."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ledgers

# Attempts and waits of a call, statuses worth another attempt, rows of a batch.
ATTEMPTS, WAITS, RETRIED, BATCH = 3, (0.05, 0.2), {429, 500, 502, 503, 504}, 20
Transport = Callable[[str, list[dict]], tuple[int, str]]


class ModelError(RuntimeError):
    """A call that failed for good."""


def ask(transport: Transport, model: str, messages: list[dict], pause: Callable[[float], None] = time.sleep) -> str:
    """One answer; overload and server errors are tried again, other errors and broken transports are not."""
    for attempt in range(ATTEMPTS):
        status, text = transport(model, messages)
        if status == 200:
            return text
        if status not in RETRIED or attempt == ATTEMPTS - 1:
            raise ModelError(f"status {status}: {text[:200]}")
        pause(WAITS[min(attempt, len(WAITS) - 1)])
    raise AssertionError


def candidates(residue: DataFrame, decisions: DataFrame, pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """id, kind, excerpt to be judged: undecided residue, excluded ones too, then duplicates of selected pages that are
    not among them."""
    first = ledgers.undecided(residue, decisions, include_excluded=True).select("id", "reason", "excerpt", F.lit(0).alias("kind"))
    second = pairs.select(F.col("duplicate").alias("id")).distinct().join(first.select("id"), "id", "left_anti").join(pages.where("excerpt <> ''").select("id", "excerpt"), "id")
    return first.unionByName(second.select("id", F.lit("duplicate").alias("reason"), "excerpt", F.lit(1).alias("kind")))


def numbered_batches(rows: DataFrame, n: int = BATCH, buckets: int = 64) -> DataFrame:
    """Add batch: rows of one bucket of ids, n at a time. Numbers are unique and no task sees all rows."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))
    place = F.floor((F.row_number().over(Window.partitionBy("__b").orderBy("id")) - 1) / n)
    return rows.withColumn("__b", bucket).withColumn("batch", F.concat_ws("-", "__b", place)).drop("__b")


def classify(rows: DataFrame, transport: Transport, model: str, prompt: str, n: int = BATCH) -> DataFrame:
    """id, verdict, rationale of rows (id, reason, excerpt); verdicts that are no word of the ledger are unsure, and so
    is include for a new source; ids that weren't asked for are left out, rows without an answer have a null verdict."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = [{"id": i, "excerpt": e} for i, e in zip(group["id"], group["excerpt"], strict=True)]
        answer = json.loads(ask(transport, model, [{"role": "system", "content": prompt}, {"role": "user", "content": json.dumps(asked, ensure_ascii=False)}]))
        found = {str(a.get("id")): a for a in answer if isinstance(a, dict)}
        out = []
        for i, reason in zip(group["id"], group["reason"], strict=True):
            a = found.get(i)
            verdict = None if a is None else a.get("verdict") if a.get("verdict") in ledgers.VERDICTS else "unsure"
            verdict = "unsure" if verdict == "include" and reason == "new_source" else verdict
            out.append((i, verdict, None if a is None else str(a.get("rationale") or "no rationale given")))
        return pd.DataFrame(out, columns=["id", "verdict", "rationale"])

    return numbered_batches(rows, n).groupBy("batch").applyInPandas(run, "id string, verdict string, rationale string")


def freshness(page_hash: Column, n: int, prompt: str) -> Column:
    """What a derived text depends on: the page, the number asked for and the prompt, not the model."""
    return F.sha2(F.concat_ws("\n", F.lit("questions-v1"), page_hash, F.lit(str(n)), F.lit(prompt)), 256)


def stale(pages: DataFrame, derived: DataFrame, n: int, prompt: str) -> DataFrame:
    """Pages (id, sha256, content, mirror_of) that mirror no other and have no fresh derived text."""
    wanted = pages.where("mirror_of IS NULL").withColumn("input_sha256", freshness(F.col("sha256"), n, prompt))
    return wanted.join(derived.select(F.col("page").alias("id"), "input_sha256"), ["id", "input_sha256"], "left_anti")


def carried_over(pages: DataFrame, derived: DataFrame, n: int, prompt: str) -> DataFrame:
    """Derived rows that are fresh for pages that still are; the rest is dropped."""
    now = pages.where("mirror_of IS NULL").select(F.col("id").alias("page"), freshness(F.col("sha256"), n, prompt).alias("input_sha256"))
    return derived.join(now, ["page", "input_sha256"], "left_semi").select(derived.columns)


def clean_questions(questions: Column, n: int) -> Column:
    """Trimmed, without blanks and without repeats that differ in case only (the first stays), at most n."""
    trimmed = F.filter(F.transform(questions, lambda q: F.trim(q)), lambda q: q != "")
    lower = F.transform(trimmed, lambda q: F.lower(q))
    first = F.filter(trimmed, lambda q, i: F.array_position(lower, F.lower(q)) == i + 1)
    return F.slice(first, 1, n)


def derive(pages: DataFrame, transport: Transport, model: str, n: int, prompt: str) -> DataFrame:
    """page, kind, input_sha256, model, text for stale pages, one call a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [json.loads(ask(transport, model, [{"role": "system", "content": prompt}, {"role": "user", "content": c}])) for c in batch["content"]]
            yield pd.DataFrame({"page": batch["id"], "input_sha256": batch["input_sha256"], "text": [[str(q) for q in t] for t in texts]})

    asked = pages.select("id", "input_sha256", "content").mapInPandas(run, "page string, input_sha256 string, text array<string>")
    return asked.select("page", F.lit("questions").alias("kind"), "input_sha256", F.lit(model).alias("model"), clean_questions(F.col("text"), n).alias("text"))
