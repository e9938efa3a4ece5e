"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; none is lost.

Words are those of the fingerprints; a text of fewer words has one shingle of all of them, one without words none.
Two such sets share one of the first size - ceil(0.8 size) + 1 of each, in any common order. The order is by count in
a sample of the texts, then by hash: it decides how many texts meet, never which links are found. Texts that meet
over a shingle and can still reach the similarity by sizes and places are candidates.

To spare groups of near copies the pairs among them, the texts of a shingle that many have are first held against one
of them only, then in PIVOT_ROUNDS rounds against PIVOTS texts of the largest component at the shingle; what these
links join isn't compared again, and all other pairs that meet are compared in a last round. So a group in which only
some of the pairs are similar still becomes one component by a number of comparisons in proportion to its texts. The
texts of a shingle that few have are all paired at once.

A candidate is first held against counts: every text has the numbers of its shingles in 256 ranges of hashes, and two
texts share at most the sum of the lesser numbers. After the first round texts bring these counts (by 64 ranges) along,
so that a passage that many texts share makes no rows. Only the sets of pairs that the bound leaves are brought
together, so that of all texts but few move.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialise, release, shuffle_partitions, with_maybe

WIDTH, SIMILARITY = 5, 0.8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the set of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxh64_intdigest(word, 7) for word in words], np.uint64)
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : len(words) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def ordered(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By count in the sample (zero where it isn't in `common`, which is sorted), then by hash."""
    if not len(common):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]


def prefix(size: int, similarity: float) -> int:
    return size - int(np.ceil(similarity * size - 1e-9)) + 1


def _per_text(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(text hash, text) gives the columns of its rows; a task makes them once for equal texts it has seen lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set = set()
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part, made = batch.slice(first, 200), []
                for th, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if th not in seen:
                        seen.add(th)
                        made.append(make(th, text))
                if len(seen) > 500_000:
                    seen.clear()
                made = [m for m in made if len(m[0])]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) else list(chain.from_iterable(c))) for c in zip(*made, strict=True)], names=names)

    return docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def common_shingles(docs: DataFrame, n: int, sample: int = 10_000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample of the texts, sorted, and their counts: they come last in the order."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample))) == 0)
    each = _per_text(some, lambda th, text: (shingles(text).view(np.int64),), "h bigint")
    counted = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).collect()
    hashes = np.array([r.h for r in counted], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in counted], np.int64)[order]


#: Kinds of rows of `meetings`: a text at a shingle of many; a text's counts by range; a pair to compare first.
MEET, COUNTS, STAR = 0, 1, 2
#: A shingle of so many texts is one of few.
FEW = 8
#: Rounds between the first and the last, and texts of a shingle that its others are held against in each.
PIVOT_ROUNDS, PIVOTS = 2, 8


def range_counts(hashes: np.ndarray) -> bytes:
    """Numbers of hashes in 256 ranges, a byte each; nothing where one has no room, which bounds nothing."""
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded_counts(counts: bytes) -> bytes:
    """Numbers by 64 ranges; nothing where one has no room."""
    folded = np.frombuffer(counts, np.uint8).reshape(64, 4).sum(1, dtype=np.int64)
    return folded.astype(np.uint8).tobytes() if folded.max() < 256 else b""


def meetings(docs: DataFrame, n: int, similarity: float = SIMILARITY, rows_per_task: int = 1_000_000) -> DataFrame:
    """(kind, key, th, size, pos, counts). MEET: texts by the shingles of their prefixes, of those that over FEW texts
    have. COUNTS: size and counts of every text. STAR: pairs (key, th) of texts, those of a shingle with its first, and
    all of a shingle of few."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common_shingles(docs, n))
    names = ["kind", "key", "th", "size", "pos", "counts"]

    def make(th: int, text: str):
        hashes = shingles(text)
        size, own = len(hashes), prefix(len(hashes), similarity) if len(hashes) else 0
        if not own:
            return [np.empty(0, k) for k in (np.int8, np.int64, np.int64, np.int32, np.int32)] + [[]]
        kind = np.zeros(own + 1, np.int8)
        kind[own] = COUNTS
        keys = np.append(ordered(hashes, *shared.value)[:own].view(np.int64), th)
        return kind, keys, np.full(own + 1, th, np.int64), np.full(own + 1, size, np.int32), np.arange(own + 1, dtype=np.int32), [None] * own + [range_counts(hashes)]

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            table = pa.concat_tables(tables)
            kind, key, th, size, pos = (table.column(c).to_numpy() for c in names[:5])
            order = np.lexsort((th, key, kind))
            new = np.ones(len(key), bool)
            new[1:] = (kind[order][1:] != kind[order][:-1]) | (key[order][1:] != key[order][:-1]) | (th[order][1:] != th[order][:-1])
            order = order[new]
            own = order[kind[order] == COUNTS]
            met = order[kind[order] == MEET]
            first = np.searchsorted(key[met], key[met])
            many = np.searchsorted(key[met], key[met], "right") - first
            yield from table.take(pa.array(np.concatenate([met[many > FEW], own]))).combine_chunks().to_batches()
            for star, some in ((False, met[(many > 1) & (many <= FEW)]), (True, met[many > FEW])):
                held = {"key": key[some], "th": th[some], "size": size[some], "pos": pos[some], "root": th[some]}
                for a, b in pairs_met(held, star, similarity):
                    nothing = np.zeros(len(a), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), STAR, np.int8)), pa.array(a), pa.array(b), pa.array(nothing), pa.array(nothing), pa.nulls(len(a), pa.binary())], names=names)

    schema = "kind tinyint, key bigint, th bigint, size int, pos int, counts binary"
    entries = _per_text(docs, make, schema)
    tasks = max(shuffle_partitions(spark), -(-n * 60 // rows_per_task))
    return materialise(entries.repartition(tasks, "key").mapInArrow(several, schema), "meetings")


def open_pairs(a: np.ndarray, b: np.ndarray, root: np.ndarray, size: np.ndarray, pos: np.ndarray, counts: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (a, b) that lie in different components and may reach the similarity by sizes, places, counts."""
    need = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9)
    can = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
    can &= np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need
    a, b, need = a[can], b[can], need[can]
    if counts is not None:
        can = np.ones(len(a), bool)
        for some in np.array_split(np.arange(len(a)), -(-max(len(a), 1) // 100_000)):
            x, y = counts[a[some]], counts[b[some]]
            can[some] = (np.minimum(x, y).sum(1, dtype=np.int64) >= need[some]) | ~x.any(1) | ~y.any(1)
        a, b = a[can], b[can]
    return a, b


def pivot_pairs(table: dict[str, np.ndarray], seed: int, pivots: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of `pivots` texts of a key's largest component, chosen by a hash that is the same at every key, and the
    key's texts in other components; as many as there are rows, times `pivots`, at most."""
    mixed = (table["th"].view(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed ^ (mixed >> np.uint64(31)), table["root"], table["key"]))
    key, th, size, pos, root, counts = (table[c][order] for c in ("key", "th", "size", "pos", "root", "counts"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (root[1:] != root[:-1])
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, len(key)))
    largest = np.lexsort((-length, key[runs]))
    largest = largest[np.unique(key[runs][largest], return_index=True)[1]]
    own = np.searchsorted(key[runs[largest]], key)
    first, most = runs[largest][own], length[largest][own]
    for nth in range(pivots):
        b = np.flatnonzero(most > nth)
        a, b = open_pairs(first[b] + nth, b, root, size, pos, counts, similarity)
        a, b = th[a], th[b]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        if len(found):
            yield found[:, 0], found[:, 1]


def once(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (the lesser first), each once among about `most` that are gathered."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for found in chain(pairs, [None]):
        if found is not None and len(found[0]):
            waiting.append((np.minimum(*found), np.maximum(*found)))
        if waiting and (found is None or sum(len(a) for a, _ in waiting) >= most):
            a, b = (np.concatenate(side) for side in zip(*waiting, strict=True))
            waiting.clear()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield a[new], b[new]


def pairs_met(table: dict[str, np.ndarray], star: bool, similarity: float, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts of one key that lie in different components and may reach the similarity; with `star` those with
    the first text of the key only. `counts`, where given, has a row of counts by range (zero for none) a text.

    They are made and pruned a chunk at a time, so that a key of many texts takes no more memory than others."""
    yield from once(_pairs_met(table, star, similarity, chunk))


def _pairs_met(table: dict[str, np.ndarray], star: bool, similarity: float, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((table["th"], table["root"], table["key"]))
    key, th, size, pos, root = (table[c][order] for c in ("key", "th", "size", "pos", "root"))
    counts = table["counts"][order] if "counts" in table else None
    first = np.searchsorted(key, key)
    if star:
        left = (np.arange(len(key)) > first).astype(np.int64)
    else:
        # rows before this one's run of equal roots
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (root[1:] != root[:-1])
        left = np.flatnonzero(new)[np.cumsum(new) - 1] - first
    ends, at = np.cumsum(left), 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        n = left[at:end]
        b = np.repeat(np.arange(at, end), n)
        a = first[b] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = open_pairs(a, b, root, size, pos, counts, similarity)
        yield th[a], th[b]
        at = end


def later_round(meet: DataFrame, root_of: DataFrame, seed: int | None, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of texts that meet over a shingle but lie in different components: with a seed those with pivots, without
    one all. root_of: th, root."""

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [folded_counts(c) if c else b"" for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("th"), batch.column("root"), pa.array(folded, pa.binary())], names=["th", "root", "counts"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            table = pa.concat_tables(tables)
            columns = {c: table.column(c).to_numpy() for c in ("key", "th", "size", "pos", "root")}
            columns["counts"] = np.zeros((len(table), 64), np.uint8)
            for row, counts in enumerate(table.column("counts").to_pylist()):
                if counts:
                    columns["counts"][row] = np.frombuffer(counts, np.uint8)
            for a, b in pairs_met(columns, False, similarity) if seed is None else pivot_pairs(columns, seed, PIVOTS, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    facts = meet.where(F.col("kind") == COUNTS).select("th", "counts").join(root_of, "th").select("th", "root", "counts").mapInArrow(bring, "th bigint, root bigint, counts binary")
    placed = meet.where(F.col("kind") == MEET).select("key", "th", "size", "pos").join(facts, "th").select("key", "th", "size", "pos", "root", "counts")
    return placed.repartition(shuffle_partitions(meet.sparkSession), "key").mapInArrow(candidates, "a bigint, b bigint")


def similar(docs: DataFrame, meet: DataFrame, pairs: DataFrame, root_of: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """(a, b) roots of the pairs (a, b) of texts in different components whose sets are similar; None without any."""

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = np.minimum(na, nb)
            for row, (x, y) in enumerate(zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), strict=True)):
                if x and y:
                    most[row] = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64)
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(most >= similarity / (1 + similarity) * (na + nb) - 1e-9))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    facts = meet.where(F.col("kind") == COUNTS).select("th", "size", "counts").join(root_of, "th")
    open_ = pairs.distinct().join(facts.toDF("a", "na", "ca", "ra"), "a").join(facts.toDF("b", "nb", "cb", "rb"), "b").where("ra <> rb")
    open_ = materialise(open_.select("a", "b", "na", "nb", "ca", "cb", "ra", "rb").mapInArrow(may_be, "a bigint, b bigint, ra bigint, rb bigint"), "candidates")
    if open_.isEmpty():
        return None
    needed = open_.select(F.explode(F.array("a", "b")).alias("th"))
    hashed = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("th"))
    texts = with_maybe(hashed, "th", bitmap(needed, "th")).where("maybe").select("text")
    sets = _per_text(texts, lambda th, text: ([th], [shingles(text).tobytes()]), "th bigint, shingles binary").join(needed.distinct(), "th", "left_semi").dropDuplicates(["th"])
    held = open_.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    near = materialise(held.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "sa", "sb").mapInArrow(compare, "a bigint, b bigint"), "similar")
    return None if near.isEmpty() else near
