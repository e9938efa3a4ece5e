"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one input table; the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on this machine
    alone gets a fresh folder, and one on a cluster an error: executors don't see the driver's own folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            base = set_before.get()
        else:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="textloom-")
            spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def by_characters(texts: list[str], most: int = 1_000_000):
    """Index ranges of consecutive texts that hold about `most` characters, to bound working memory."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def by_characters_of(texts: pa.Array, most: int = 1_000_000):
    """`by_characters` of texts that are still in Arrow, by their bytes."""
    return by_characters([range(n) for n in pc.fill_null(pc.binary_length(texts), 0).to_pylist()], most)


def bitmap(hashes: DataFrame, column: str, places: int = 24) -> DataFrame:
    """(word, bits): the places of hashes in a map of 2^places bits; 2^(places - 6) small rows at most, for any input."""
    place = F.col(column).bitwiseAND((1 << places) - 1)
    return hashes.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def with_maybe(rows: DataFrame, column: str, words: DataFrame, places: int = 24) -> DataFrame:
    """Rows with `maybe`: false where the hash in `column` surely isn't among those of the bitmap. The bitmap's bound
    lets it be broadcast; beyond it more rows are just `maybe`, which the caller settles by a join."""
    word = F.shiftright(F.col(column).bitwiseAND((1 << places) - 1), 6).cast("int")
    marked = rows.withColumn("word", word).join(F.broadcast(words), "word", "left")
    there = F.expr(f"(shiftright(bits, cast(`{column}` & 63 AS int)) & 1L) = 1L")
    return marked.withColumn("maybe", F.coalesce(there, F.lit(False))).drop("word", "bits")


def join_evenly(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join with a table that has one row a key. A key with more than half a partition's even share of the rows
    is dealt out to several tasks by the hash of `spread`; there are at most twice as many such keys as partitions."""
    parts = shuffle_partitions(rows.sparkSession)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    share = max(1, rows.count() // (2 * parts))
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("blocks")))
    salt = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int"))
    dealt = rows.join(hot, key, "left").withColumn("salt", salt).drop("blocks")
    copies = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(copies, [key, "salt"]).drop("salt")


_kept: dict = {}


def kept(key, make):
    """What a worker process keeps over tasks: one thing at a time, so that stages of one application don't add up."""
    if key not in _kept:
        release()  # before anything new is made: a worker keeps freed memory else, and stages of one application add up
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Called by tasks that keep nothing, so that what an earlier stage has kept or freed doesn't add to their memory."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trim(memory: dict, most: int) -> None:
    """Halve a memory that has grown over its bound. What was learned first stays: frequent words come early."""
    if len(memory) > most:
        for _ in range(len(memory) - most // 2):
            memory.popitem()
