"""Bottom-k sketches of texts' word shingles, with DataFrame functions only.

A text's words are runs between ASCII white space, in lower case; each run of five words (all of them, where there
are fewer) is hashed by XXH64 over the words' own XXH64 values; the sketch is the sorted array of the k least
distinct hashes. The sketch of a union is the k least of the sketches' union, so sketches of parts merge. From two
sketches follow estimates of resemblance (exact while both texts have fewer than k shingles), of containment and,
from the k-th value, of the number of distinct shingles.

Null texts are empty; a text without words has the empty sketch. Two empty sketches resemble each other fully.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

K = 256
WIDTH = 5


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the sketch of a text column. The word hashes are a column of their own, so that they are made once."""
    hashes = f"__{out}_words"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    of = F.col(hashes)
    runs = F.slice(F.transform(of, lambda h, i: F.xxhash64(h, *(F.get(of, i + j) for j in range(1, width)))), 1, F.greatest(F.size(of) - (width - 1), F.lit(1)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(runs)), 1, k)).drop(hashes)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts or parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Add the estimated share of shingles that two sketches' texts have in common."""
    union, both = f"__{out}_union", f"__{out}_both"
    df = df.withColumn(union, merged(F.col(a), F.col(b), k)).withColumn(both, F.array_intersect(a, b))
    last = F.get(F.col(union), F.size(union) - 1)
    share = F.size(F.filter(both, lambda x: x <= last)) / F.size(union)
    return df.withColumn(out, F.when(F.size(union) == 0, F.lit(1.0)).otherwise(share)).drop(union, both)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.get(sketch, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Add the estimated share of a's shingles that b has too (1 for an empty a)."""
    like, union = f"__{out}_like", f"__{out}_all"
    df = resemblance(df, a, b, like, k).withColumn(union, merged(F.col(a), F.col(b), k))
    share = F.col(like) * distinct_count(F.col(union), k) / distinct_count(F.col(a), k)
    return df.withColumn(out, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))).drop(like, union)


def printable(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


# --- neighbours by id -----------------------------------------------------------------------------------------------


def _bucket(column: Column, bounds: list[int]) -> Column:
    """How many bounds lie below a value: an expression whose code doesn't grow with their number."""
    return F.size(F.filter(F.lit(bounds), lambda b: b < column)) if bounds else F.lit(0)


def with_next_text(docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Add the bucket of each row and join on what follows it in descending doc_id (after the last: the first).

    docs: doc_id, text (not null), sketch. Rows are dealt out once, by at most 1,024 ranges of doc_id of about equal
    size; the row that follows a range is the first one of the range below. Those rows are fetched beforehand, and
    broadcast if their texts' measured size allows, else joined by their range. Rows of equal id are in order of
    text; null ids are last."""
    spark = docs.sparkSession
    n = min(1023, 4 * shuffle_partitions(spark))
    found = docs.select(F.percentile_approx("doc_id", [i / (n + 1) for i in range(1, n + 1)], 10 * n)).first()[0]
    bounds = sorted(set(found or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("doc_id"), bounds))
    tops = sorted((r.bucket, r.top) for r in docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    above = {tops[i][0]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}  # the range that a range follows
    ids = [top for _, top in tops if top is not None]
    heads = docs.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull() if tops and tops[0][0] == -1 else F.col("doc_id").isin(ids))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("place = 1")
    after = F.create_map(*(F.lit(x) for pair in above.items() for x in pair)) if above else F.create_map().cast("map<int,int>")
    heads = materialise(heads.select(after[bucket].alias("bucket"), F.col("text").alias("head_text"), F.col("sketch").alias("head_sketch")), "heads")
    size = heads.agg(F.sum(F.octet_length("head_text"))).first()[0] or 0
    heads = F.broadcast(heads) if size <= broadcast_bytes else heads.hint("shuffle_merge")

    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    dealt = docs.withColumn("bucket", bucket)
    led = dealt.withColumns({"led_text": F.lead("text").over(order), "led_sketch": F.lead("sketch").over(order)})
    return led.join(heads, "bucket", "left").select(
        "doc_id", "text", "sketch", F.coalesce("led_text", "head_text").alias("next_text"), F.coalesce("led_sketch", "head_sketch").alias("next_sketch")
    )


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of (doc_id, text)."""
    docs = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", k)
    df = with_next_text(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = with_sketch(df, "edited", "edited_sketch", k)
    df = resemblance(resemblance(df, "sketch", "edited_sketch", "near_edited", k), "sketch", "next_sketch", "near_next", k)
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printable(F.col("sketch")).alias("fingerprint"),
        printable(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
