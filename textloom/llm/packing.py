"""Packing token sequences by column generation for the cutting-stock problem.

A document's ids, with an end id, are cut at every `size` ids: whole pieces are sequences of their own. What is left
is cut once more, into an item whose length is a multiple of STEP and a tail shorter than STEP; items fill sequences
with items, tails with tails, so that a length class holds one length only and no room is lost to rounding. Items are
counted by class over all documents; from that histogram, whose size does not depend on the input, the driver finds
patterns, for items and for tails: a linear program over patterns of classes that fit a sequence,
whose columns are priced by an unbounded knapsack solved by dynamic programming, and its solution rounded down, with
the few items left over packed first-fit by falling class. Items are ranked within their class across all tasks, by
counts of buckets added up before a rank inside the bucket, so that no task sees a whole class; a rank gives the
item's pattern, sequence and place by arithmetic, from a table of the patterns of its class.

A sequence is padded to `size`, except at a power of two: one that holds 1, 2, 4, ... ids stays as long as it is. The
column padded_to has that length. `rounds` bounds the columns that are generated; whatever patterns there are by then
hold every item, at the price of more padding only.

Null texts are empty: their document is the end id alone. Repeated rows and null ids are kept, one set of pieces each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions
from .token_ids import encoded

SIZE, STEP = 1024, 32
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, step: int = STEP) -> DataFrame:
    """The cut pieces of every document; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [*range(0, n - n % size + 1, size), n - n % step, n]
                for first, last in pairwise(cuts):
                    if last > first:
                        rows.append((doc_id, first, last - first, zlib.crc32(ids[4 * first : 4 * last]), n))
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits; each item may be taken again and again."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], took[room] = best[room - 1], -1
        fits = np.flatnonzero(weight <= room)
        if len(fits):
            gain = best[room - weight[fits]] + value[fits]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], took[room] = gain[k], fits[k]
    counts, room = np.zeros(len(value), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= weight[took[room]]
    return float(best[capacity]), counts


def column_generation(weight: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, at the least number of sequences, as real numbers."""
    m = len(weight)
    basis = np.diag((capacity // weight).astype(float))  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(0)
        worth, pattern = knapsack(prices, weight, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        basis[:, out] = pattern
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
    return basis.T.astype(np.int64), used


def plan_patterns(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {class: items}) of patterns that hold every item exactly once."""
    classes = np.array(sorted(c for c, n in demand.items() if n), np.int64)
    if not len(classes):
        return []
    left = np.array([demand[int(c)] for c in classes], np.int64)
    patterns, used = column_generation(classes, left.astype(float), capacity)
    plan = []
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64), strict=True):
        some = pattern > 0
        times = int(min([times, *(left[some] // pattern[some])]))
        if times:
            left -= times * pattern
            plan.append((times, {int(c): int(k) for c, k in zip(classes, pattern, strict=True) if k}))
    while left.any():  # the fractions' items: first fit by falling class, equal sequences at once
        room, pattern = capacity, {}
        for k in range(len(classes) - 1, -1, -1):
            take = int(min(left[k], room // classes[k]))
            if take:
                pattern[int(classes[k])] = take
                room -= take * int(classes[k])
        times = min(int(left[np.searchsorted(classes, c)]) // k for c, k in pattern.items())
        for c, k in pattern.items():
            left[np.searchsorted(classes, c)] -= times * k
        plan.append((times, pattern))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, items of the class in a sequence, first sequence) by pattern."""
    rows, ranks, sequence = [], {}, 0
    for times, pattern in plan:
        for c, k in pattern.items():
            first = ranks.get(c, 0)
            ranks[c] = first + times * k
            rows.append((c, first, ranks[c], k, sequence))
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, step: int = STEP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to of every piece."""
    spark = docs.sparkSession
    # classes: 0 whole pieces, below `step` tails by length, from `step` on items by length
    length_class = F.when(F.col("length") == size, F.lit(0)).otherwise(F.col("length")).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shuffle_partitions(spark))).cast("int")
    cut = pieces(docs, tokenizer, end_id, size, step).withColumns({"class": length_class, "bucket": bucket})
    cut = materialise(cut, "pieces")
    counts = cut.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.select("class", "bucket", "n", before.alias("before")), "offsets")
    demand = {row[0]: row.n for row in offsets.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    whole = demand.pop(0, 0)
    plan = [(n, {c * step: k for c, k in pattern.items()}) for n, pattern in plan_patterns({c // step: n for c, n in demand.items() if c >= step}, size // step)]
    plan += plan_patterns({c: n for c, n in demand.items() if c < step}, size)

    own = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.join(offsets.drop("n"), ["class", "bucket"]).withColumn("rank", F.col("before") + own)
    full = ranked.where("class = 0").select("*", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(size).cast("long").alias("padded_to"))
    # a few rows a pattern, and at most twice as many patterns as classes and leftovers: a bounded table
    table = spark.createDataFrame(slots(plan), "class int, low long, high long, per long, base long")
    at = F.col("rank") - F.col("low")
    mixed = ranked.where("class > 0").join(F.broadcast(table), ["class"]).where("rank >= low AND rank < high")
    mixed = mixed.withColumns({"sequence_id": F.col("base") + F.floor(at / F.col("per")) + whole, "slot": at % F.col("per")})
    inside = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "slot").rowsBetween(Window.unboundedPreceding, -1)
    mixed = mixed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    mixed = mixed.withColumn("padded_to", F.when(F.bit_count(total) == 1, total).otherwise(F.lit(size)).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]
    return full.select(columns).unionByName(mixed.select(columns))
