"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: 13 consecutive words, or the whole item where it has fewer. For
each pattern length a table over blocks of two words says how far a search position can move on without passing an
occurrence; where it can't move, the block's bucket holds the few windows that end so, and words are compared.
A text's words are read at about every twelfth place only. One-word items have one-word blocks.

The benchmark is a query set. It is written in blocks of about BLOCK_BYTES of text to the shared folder; neither the
driver nor a broadcast holds it. A worker holds the compiled tables of one block at a time: with one block (the usual
case) they are compiled once a worker; with several the blocks are the outer loop over row groups of GROUP_BYTES of
text, so a benchmark of any size is searched whole in bounded memory and compiled once a group.

Null and empty texts have no words: no hits, not contaminated. Items without words have no window. Items that share
an id count once; a null item_id hits but is not listed. Repeated rows and null ids are kept, one output row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_characters_of, kept, scratch

BLOCK_BYTES, GROUP_BYTES = 64 << 20, 32 << 20
WINDOW = 13

#: A-Z to lower case; ASCII that is neither letter nor digit to a space. Bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Patterns:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, window: tuple[bytes, ...], item) -> None:
        for end in range(self.block, self.length + 1):
            key = window[end - self.block : end]
            self.shift[key] = min(self.shift.get(key, self.furthest), self.length - end)
        self.buckets.setdefault(window[-self.block :], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first, end, items) of every occurrence."""
        length, block, furthest, shift = self.length, self.block, self.furthest, self.shift.get
        at, n = length, len(words)
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            move = shift(key, furthest)
            if move:
                at += move
                continue
            for window, items in self.buckets[key].items():
                if tuple(words[at - length : at]) == window:
                    yield at - length, at, items
            at += 1


def compile_items(items: list[tuple], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        if length:
            patterns = by_length.setdefault(length, Patterns(length))
            for first in range(len(words) - length + 1):
                patterns.add(tuple(words[first : first + length]), item)
    return list(by_length.values())


def find_hits(words: list[bytes], tables: list[Patterns], hit: bytearray, items: set) -> None:
    """Mark hit words and add the ids of items whose windows occur."""
    for patterns in tables:
        for first, end, found in patterns.search(words):
            hit[first:end] = b"\1" * (end - first)
            items |= found


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int) -> list[str]:
    """Files of the items (item, text), each a block of about `most` bytes once compiled."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = scratch(spark, "benchmark")
    items.repartition(max(1, math.ceil(4 * size / most))).write.parquet(path)
    return sorted(spark.read.schema(items.schema).parquet(path).inputFiles())


def _tables(path: str, window: int) -> list[Patterns]:
    """The compiled tables of one block; a worker keeps those of the last one."""

    def make() -> list[Patterns]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as source:
            items = pq.read_table(source).to_pydict()
        return compile_items(list(zip(items["item"], items["text"], strict=True)), window)

    return kept(("patterns", path, window), make)


def hits_of(texts: list[str | None], blocks: list[str], window: int) -> list[tuple[int, int, set]]:
    """(words, hit words, items that occur) of each text of a row group, block by block."""
    hits: list[bytearray | None] = [None] * len(texts)
    found: list[set] = [set() for _ in texts]
    for block in blocks:
        tables = _tables(block, window)
        for k, text in enumerate(texts):
            words = words_of(text)
            if hits[k] is None:
                hits[k] = bytearray(len(words))
            find_hits(words, tables, hits[k], found[k])
    hits = [bytearray(len(words_of(text))) if hit is None else hit for text, hit in zip(texts, hits, strict=True)]  # no block at all
    return [(len(hit), sum(hit), items) for hit, items in zip(hits, found, strict=True)]


def is_contaminated(n_words: int, n_hit: int, least_share: int) -> bool:
    return n_hit > 0 and least_share * n_hit >= n_words


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: int = 20, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """For every document: id, n_words, n_hit, n_items, items_sha256, contaminated (a share of 1/least_share hit)."""
    blocks = item_blocks(benchmark, item_column, item_text, block_bytes)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in by_characters_of(batch.column(1), group_bytes):
                part, rows = batch.slice(first, end - first), []
                for n_words, n_hit, items in hits_of(part.column(1).to_pylist(), blocks, window):
                    named = sorted(i for i in items if i is not None)
                    rows.append((n_words, n_hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), is_contaminated(n_words, n_hit, least_share)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_column, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(id_column, F.col(text_column)).mapInArrow(run, schema)


def contaminated_filter(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: int = 20, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one narrow pass."""
    blocks = item_blocks(benchmark, "item_id", "text", block_bytes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for first, end in by_characters_of(batch.column(at), group_bytes):
                keep += [not is_contaminated(n_words, n_hit, least_share) for n_words, n_hit, _ in hits_of(batch.column(at).slice(first, end - first).to_pylist(), blocks, window)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT r, i, dw.m, item_id FROM dw JOIN win ON dw.m = win.m AND dw.t = win.t),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
