"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

Fingerprints: words are lower-cased (A-Z) runs between ASCII white space; every shingle of three words (all words,
where there are fewer) is hashed with XXH64, and a bit of the fingerprint is set when over half the hashes have it.

Search: two fingerprints within `most` bits agree, in one of m bit groups at least, to within that group's
threshold, as long as the thresholds add up to most - m + 1 (a threshold of -1 leaves a group out). Bits that go
together in the corpus are put into the same group. For each fingerprint dynamic programming picks the thresholds
with the least cost, from the numbers of probes and the candidates expected from counts of bytes over all
fingerprints; m is the number of groups with the least cost over all fingerprints. A fingerprint is indexed by its
bits in each group, and probes every key within its thresholds; candidates are compared in full.

Equal fingerprints are one node. A task that finds many links among nodes passes on a spanning forest of them only,
so a group of copies of any size costs as many rows as it has nodes. A key with more than `bucket` nodes is cut
into blocks of that size, and each pair of blocks is a bucket of its own: no task holds an unbounded bucket, and
none of its pairs is left out. Components come from alternating large-star and small-star rounds, each written to
the shared folder.

Null and empty texts have no words: fingerprint zero, linked like any other. Rows with a null id are kept and take
the smallest id of their component (null where it has none). Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_links
from .common import bitmap, join_evenly, materialise, release, shuffle_partitions, with_maybe

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(shingles), 1 << 16):
        hashes = np.array([xxh64_intdigest(s, 42) for s in shingles[first : first + (1 << 16)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """id and fingerprint (as a signed long) of every row, and the columns to carry along; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                made = np.array([fingerprint(text, width) for text in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made), *part.columns[2:]], names=[id_column, "fp", *carried])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_column, *carried)}
    return docs.select(id_column, text_column, *carried).mapInArrow(run, ", ".join([f"`{id_column}` {kinds[id_column]}", "fp bigint", *(f"`{c}` {kinds[c]}" for c in carried)]))


# --- the cost model -------------------------------------------------------------------------------------------------


def _summed(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all fingerprints of an array of fixed size: one array a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(batch.column(0).to_numpy().view(np.uint64)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "n"])

    out = np.zeros(size)
    for at, n in df.select("fp").mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_order(together: np.ndarray, n: int) -> list[int]:
    """Bits so ordered that each run of eight has bits that agree or differ most often with each other."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    phi = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    left, order = list(range(BITS)), []
    while left:
        sub = phi[np.ix_(left, left)]
        block = [left[int(sub.sum(1).argmax())]]
        left.remove(block[0])
        while len(block) < 8:
            nearest = left[int(phi[np.ix_(left, block)].sum(1).argmax())]
            block.append(nearest)
            left.remove(nearest)
        order += block
    return order


def reordered(fps: np.ndarray, order: list[int]) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(_bits(fps)[:, order], axis=1, bitorder="little")).view("<u8").reshape(-1)


class Plan:
    """Bit groups (runs of bytes of the reordered fingerprint) and the costs of thresholds."""

    VERIFY = 0.02  # the cost of comparing a candidate, in probes

    def __init__(self, order: list[int], groups: list[tuple[int, int]], near: np.ndarray, n: int, most: int):
        self.order, self.groups, self.n, self.most = order, groups, n, most
        self.near = near  # byte place, byte value, distance 0..most: share of fingerprints there

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """fingerprint x group x (threshold + 1): probes and expected comparisons."""
        bytes_ = codes.astype("<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros((len(codes), len(self.groups), self.most + 2))
        for g, (first, end) in enumerate(self.groups):
            chance = np.zeros((len(codes), self.most + 1))
            chance[:, 0] = 1
            for place in range(first, end):
                here = self.near[place][bytes_[:, place]]
                chance = np.stack([sum(chance[:, a] * here[:, d - a] for a in range(d + 1)) for d in range(self.most + 1)], axis=1)
            probes = np.cumsum([comb(8 * (end - first), t) for t in range(self.most + 1)])
            out[:, g, 1:] = probes + self.VERIFY * self.n * np.cumsum(chance, axis=1)
        return out

    def allocate(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds of each fingerprint by dynamic programming over the groups, and their cost."""
        costs, total = self.costs(codes), self.most + 1  # thresholds plus one add up to this
        rows = np.arange(len(codes))
        best = np.full((len(codes), total + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((len(self.groups), len(codes), total + 1), np.int8)
        for g in range(len(self.groups)):
            options = np.full((len(codes), total + 1, total + 1), np.inf)
            for t in range(total + 1):
                options[:, t:, t] = best[:, : total + 1 - t] + costs[:, g, t, None]
            choice[g] = options.argmin(2)
            best = options.min(2)
        thresholds, left = np.zeros((len(codes), len(self.groups)), np.int8), np.full(len(codes), total)
        for g in reversed(range(len(self.groups))):
            took = choice[g, rows, left]
            thresholds[:, g], left = took - 1, left - took
        return thresholds, best[:, total]

    def keys(self, codes: np.ndarray, g: int) -> np.ndarray:
        first, end = self.groups[g]
        return (codes >> np.uint64(8 * first)) & np.uint64((1 << 8 * (end - first)) - 1)

    def masks(self, g: int, threshold: int) -> np.ndarray:
        width = 8 * (self.groups[g][1] - self.groups[g][0])
        return np.array([sum(1 << i for i in flips) for t in range(threshold + 1) for flips in combinations(range(width), t)], np.uint64)


def make_plan(nodes: DataFrame, n: int, most: int) -> Plan:
    order = correlated_order(_summed(nodes, lambda fps: (b := _bits(fps).astype(np.float64)).T @ b, BITS * BITS).reshape(BITS, BITS), n)

    def bytes_seen(fps):
        bytes_ = reordered(fps, order).view(np.uint8).reshape(-1, 8)
        return np.stack([np.bincount(bytes_[:, place], minlength=256) for place in range(8)]).astype(float)

    seen = _summed(nodes, bytes_seen, 8 * 256).reshape(8, 256)
    apart = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)])
    near = np.stack([np.stack([(apart == d) @ seen[place] for d in range(most + 1)], axis=1) for place in range(8)]) / max(n, 1)
    plans = [Plan(order, [(8 * g // m, 8 * (g + 1) // m) for g in range(m)], near, n, most) for m in range(1, min(8, most + 1) + 1) if m > 1 or most < 2]

    def cost_of_each(fps):
        return np.array([plan.allocate(reordered(fps, order))[1].sum() for plan in plans])

    return plans[int(_summed(nodes, cost_of_each, len(plans)).argmin())]


# --- links ----------------------------------------------------------------------------------------------------------


def _entries(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(part, key, query, fp): one row a group for the index, one row a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(at, 2000).to_numpy()
                codes = reordered(fps.view(np.uint64), plan.order)
                thresholds, _ = plan.allocate(codes)
                for g in range(len(plan.groups)):
                    keys = plan.keys(codes, g)
                    yield _entry_batch(g, keys, False, fps)
                    for t in range(plan.most + 1):
                        rows = np.flatnonzero(thresholds[:, g] == t)
                        if len(rows):
                            masks = plan.masks(g, t)
                            for some in np.array_split(rows, -(-len(rows) * len(masks) // 500_000)):
                                yield _entry_batch(g, (keys[some, None] ^ masks).ravel(), True, np.repeat(fps[some], len(masks)))

    return nodes.select("fp").mapInArrow(run, "part tinyint, key bigint, query boolean, fp bigint")


def _entry_batch(g: int, keys: np.ndarray, query: bool, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(fps), g, np.int8)), pa.array(keys.view(np.int64)), pa.array(np.full(len(fps), query)), pa.array(fps)],
        names=["part", "key", "query", "fp"],
    )


def _blocked(entries: DataFrame, bucket: int) -> DataFrame:
    """Deal keys with more than `bucket` index rows out in blocks: the index row goes to its block for every block of
    probes, the probe to its block for every block of index rows."""
    large = (
        entries.where(~F.col("query")).groupBy("part", "key").count().where(F.col("count") > bucket)
        .select("part", "key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks"))
    )
    joined = entries.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.when(F.col("query"), other * F.col("blocks") + own).otherwise(own * F.col("blocks") + other),
    )
    return joined.select("part", "key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pairs)).alias("block"), "query", "fp")


class Forest:
    """Union of links among the nodes of one task, a chunk of links at a time."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.root = nodes, np.arange(len(nodes))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.root != np.arange(len(self.nodes)))
        return self.nodes[own], self.nodes[self.root[own]]


def probe(group: np.ndarray, query: np.ndarray, fps: np.ndarray, most: int, chunk: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between index rows and probes that share a group number."""
    nodes, at = np.unique(fps, return_inverse=True)
    forest = Forest(nodes)
    index, probes = np.flatnonzero(~query), np.flatnonzero(query)
    index = index[np.argsort(group[index], kind="stable")]
    sorted_groups, codes = group[index], nodes.view(np.uint64)
    low, high = np.searchsorted(sorted_groups, group[probes]), np.searchsorted(sorted_groups, group[probes], "right")
    some = high > low
    probes, low, size = probes[some], low[some], (high - low)[some]
    ends = np.cumsum(size)
    first = 0
    while first < len(probes):
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + chunk, "right")))
        n = size[first:end]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b = at[index[np.repeat(low[first:end], n) + offset]]
        a = np.repeat(at[probes[first:end]], n)
        near = np.flatnonzero(a > b)
        near = near[np.bitwise_count(codes[a[near]] ^ codes[b[near]]) <= most]
        forest.add(a[near], b[near])
        first = end
    return forest.edges()


def links(nodes: DataFrame, most: int = 3, bucket: int = 20_000, rows_per_task: int = 1_000_000) -> DataFrame:
    """(a, b) pairs of fingerprints that connect all fingerprints within `most` bits of each other."""
    spark, n = nodes.sparkSession, nodes.count()
    plan = make_plan(nodes, n, most)
    entries = _entries(nodes, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            table = pa.concat_tables(tables)
            part, key, block, query, fps = (table.column(c).to_numpy() for c in ("part", "key", "block", "query", "fp"))
            order = np.lexsort((block, key, part))
            same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (part, key, block)])
            group = np.empty(len(order), np.int64)
            group[order] = np.concatenate([[0], np.cumsum(~same)])
            a, b = probe(group, query, fps, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    tasks = max(shuffle_partitions(spark), -(-n * 30 // rows_per_task))
    return _blocked(entries, bucket).repartition(tasks, "part", "key", "block").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, now = None, state(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), "links")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, most: int = 3, width: int = 3, bucket: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row of docs."""
    prints = materialise(fingerprints(docs, width), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    member = components(links(nodes, most, bucket)).withColumnRenamed("node", "fp")
    named = member.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    whole = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_evenly(prints, whole, "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, most: int = 3, similarity: float = shingle_links.SIMILARITY) -> DataFrame:
    """doc_id, th (the text's hash), fp and root of every row: texts within `most` bits, or whose five-word shingles
    have a Jaccard similarity of `similarity` or more, share a root."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    prints = materialise(fingerprints(hashed, carried=("th",)), "prints")
    nodes = materialise(prints.select("fp").distinct(), "nodes")
    texts = materialise(prints.select("th", "fp").distinct(), "texts")
    member = components(links(nodes, most)).select(F.col("node").alias("fp"), "root")
    root_of = materialise(texts.join(member, "fp", "left").select("th", F.coalesce("root", "fp").alias("root")), "roots")
    meet = shingle_links.meetings(docs, texts.count(), similarity)
    stars = meet.where(F.col("kind") == shingle_links.STAR).select(F.col("key").alias("a"), F.col("th").alias("b"))
    later = () if meet.where(F.col("kind") == shingle_links.MEET).isEmpty() else (*range(1, shingle_links.PIVOT_ROUNDS + 1), None)
    for seed in (0, *later):
        pairs = stars if seed == 0 else shingle_links.later_round(meet, root_of, seed, similarity)
        near = shingle_links.similar(docs, meet, pairs, root_of, similarity)
        if near is not None:
            joined = components(near).toDF("root", "least")
            root_of = materialise(root_of.join(joined, "root", "left").select("th", F.coalesce("least", "root").alias("root")), "roots")
    return join_evenly(prints, root_of, "th", "doc_id").select("doc_id", "th", "fp", "root")


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row of each group: the one with the smallest id, then fingerprint, then text; ids that are null come last.
    Of rows that repeat both id and text, the one whose other columns come first stays.

    Rows whose id and text aren't in a bitmap of those that go or repeat stay where they are; only the others move."""
    rows = materialise(grouped(docs, most), "groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "th")).alias("m"))
    stay = first.select(F.col("m.doc_id").alias("id"), F.col("m.th").alias("t"), F.lit(True).alias("stays"))
    each = rows.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    each = each.join(stay, each["doc_id"].eqNullSafe(stay["id"]) & (each["th"] == stay["t"]), "left")
    odd = each.where("stays IS NULL OR n > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.coalesce("stays", F.lit(False)).alias("__stays"))
    odd = materialise(odd.withColumn("__h", F.xxhash64("__id", "__t")), "odd")
    named = docs.withColumn("__th", F.xxhash64("text")).withColumn("__key", F.xxhash64("doc_id", "__th"))
    marked = with_maybe(named.withColumn("__row", F.struct(*docs.columns)).select("__row", "__th", "__key"), "__key", bitmap(odd, "__h"))
    same = (F.col("__key") == F.col("__h")) & F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t"))
    moved = materialise(marked.where("maybe").join(odd, same, "left").where("__h IS NULL OR __stays").select("__row", "__th", F.col("__h").isNull().alias("once")), "moved")
    again = moved.where("NOT once").groupBy(F.col("__row.doc_id").alias("d"), "__th").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    kept = marked.where("NOT maybe").select("__row").unionByName(moved.where("once").select("__row")).unionByName(again.select("__row"))
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns))
