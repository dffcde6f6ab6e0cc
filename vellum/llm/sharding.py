"""Reproducible shuffle and sharding: a Feistel permutation over global row numbers.

Rows get global numbers 0..n-1 without a single-task sort: a hash of the id
deals them to a fixed number of buckets, a bucket's rows are ranked, and the
counts of the buckets before it are added. The permutation of 0..n-1 is an
alternating Feistel network over a rectangle of a x b >= n cells whose excess is
less than one column, with cycle walking for the cells beyond n. Shard and slot
follow from the permuted number: number mod shards, number div shards. Shard
sizes differ by one row at most (law "rows").

All of it is DataFrame and SQL functions.

Defined results: a null text has size 1 and the crc32 of the empty text; null
ids share a bucket that the text's hash spreads; rows repeated in full are
numbered one after the other (which copy gets which number does not matter, as
they are alike); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Buckets of the row numbering; its counts are the only thing broadcast.
BUCKETS = 4096
ROUNDS = 8


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0..a*b-1: eight rounds that alternate between both sides of a rectangle."""
    start = F.struct((x % F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

    def turn(pair: Column, k: Column) -> Column:
        side = F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        mixed = F.pmod(F.xxhash64(pair["r"], k, F.lit(seed)), side)
        return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + mixed, side).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda p: p["r"] * F.lit(a) + p["l"])


def rectangle(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, math.ceil(n / a))


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """How often the cells beyond n must be walked on until all are inside; fewer than sqrt(n) + 1 such cells."""
    if n < 2:
        return 1
    a, b = rectangle(n)
    beyond, steps = spark.range(n, a * b).select(F.col("id").alias("x")), 0
    while True:
        beyond = beyond.select(feistel(F.col("x"), a, b, seed).alias("x")).where(F.col("x") >= n)
        steps += 1
        left = beyond.count()
        if not left:
            return steps


def permuted(x: Column, n: int, seed: int, walk: int) -> Column:
    """The permutation of 0..n-1: walk on while outside."""
    a, b = rectangle(n)
    once = feistel(x, a, b, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once, lambda y, _: F.when(y >= n, feistel(y, a, b, seed)).otherwise(y))


def row_numbers(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds row, the global number of each row, from its bucket and rank."""
    counts = rows.groupBy("bucket").count()
    before = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    ranked = rows.withColumn("rank", rank.cast("long"))
    # at most `buckets` rows of two longs, whatever the input's size
    return ranked.join(F.broadcast(before), "bucket").withColumn("row", F.coalesce("before", F.lit(0)) + F.col("rank") - 1)


def shard(docs: DataFrame, shards: int = 16, seed: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.xxhash64("doc_id") if buckets == 1 else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("tie"),
        F.pmod(keys, F.lit(buckets)).alias("bucket"),
    )
    n = docs.count()
    walk = longest_walk(docs.sparkSession, n, seed)
    numbered = row_numbers(rows, ["doc_id", "tie", "size", "text_crc32"], buckets)
    placed = numbered.withColumn("at", permuted(F.col("row"), max(n, 1), seed, walk))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("at") % shards).cast("int").alias("shard"), F.floor(F.col("at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
