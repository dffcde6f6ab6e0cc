"""Exact dedup with an extendible-hash index on shared files.

Each scan task normalises its texts and merges equal ones batch by batch. What
is left goes to owner tasks, each of which owns one range of the key (the first
64 bits of SHA-256). An owner inserts into an extendible hash table: an overfull
bucket is split on its next key bit and the directory doubles when the bucket
was as deep as the directory. Texts under the same key are chained, and an
entry is only merged with one whose bytes are the same. The buckets are written
as Parquet to the shared folder. Every document then finds its range's directory
(the depths of the range's buckets), with it its bucket, and there its entry, by
the whole 256 bits of its digest; texts are not shuffled a second time.

Defined results: null text counts as empty; rows that repeat a doc_id and text
share one decision; a null doc_id sorts after all others; long texts count whole;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import SPACE, SPACE_BYTES, narrow, shuffle_width, stored, unused

PARTIAL = "key long, sha binary, norm binary, best_len long, best_id long, n long"
ENTRY = "range long, bucket long, depth int, key long, chain int, sha binary, keep_id long, group_size long"
#: The directory stops doubling here; a bucket below it grows a longer chain.
DEEPEST = 20


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _rank(length: int, doc_id: int | None) -> tuple:
    """Smaller is better: most code points, then smallest id, null ids last."""
    return (-length, doc_id is None, doc_id or 0)


class Bucket:
    __slots__ = ("depth", "chains", "size")

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.chains: dict[int, list[list]] = {}


class ExtendibleIndex:
    """key -> chain of [norm, sha, rank, doc_id, count]; the directory is indexed by the key's low bits."""

    def __init__(self, capacity: int = 512):
        self.capacity, self.depth = capacity, 0
        self.directory = [Bucket(0)]

    def bucket(self, key: int) -> Bucket:
        return self.directory[key & ((1 << self.depth) - 1)]

    def add(self, key: int, norm: bytes, sha: bytes, rank: tuple, doc_id: int | None, n: int) -> None:
        bucket = self.bucket(key)
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == norm:
                entry[4] += n
                if rank < entry[2]:
                    entry[2], entry[3] = rank, doc_id
                return
        chain.append([norm, sha, rank, doc_id, n])
        bucket.size += 1
        while bucket.size > self.capacity and len(bucket.chains) > 1 and bucket.depth < DEEPEST:
            self.split(bucket, key)
            bucket = self.bucket(key)

    def split(self, old: Bucket, key: int) -> None:
        if old.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << old.depth
        pair = (Bucket(old.depth + 1), Bucket(old.depth + 1))
        for k, chain in old.chains.items():
            half = pair[bool(k & bit)]
            half.chains[k] = chain
            half.size += len(chain)
        for i in range(key & (bit - 1), len(self.directory), bit):
            self.directory[i] = pair[bool(i & bit)]

    def buckets(self) -> Iterator[tuple[int, Bucket]]:
        """Each bucket once, under the smallest directory slot that points to it."""
        for i, bucket in enumerate(self.directory):
            if i < 1 << bucket.depth:
                yield i, bucket


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, list] = {}
        for doc_id, text, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            norm, rank = text.translate(None, SPACE_BYTES), _rank(length, doc_id)
            entry = found.get(norm)
            if entry is None:
                found[norm] = [rank, length, doc_id, 1]
            else:
                entry[3] += 1
                if rank < entry[0]:
                    entry[:3] = rank, length, doc_id
        shas = [hashlib.sha256(norm).digest() for norm in found]
        rows = list(found.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_signed(_key(s)) for s in shas], pa.int64()),
                pa.array(shas, pa.binary()),
                pa.array(list(found), pa.binary()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["key", "sha", "norm", "best_len", "best_id", "n"],
        )


def _owner(range_bits: int, capacity: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, ExtendibleIndex] = {}
        for batch in batches:
            for key, sha, norm, length, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key &= (1 << 64) - 1
                index = ranges.setdefault(key >> (64 - range_bits), ExtendibleIndex(capacity))
                index.add(key, norm, sha, _rank(length, doc_id), doc_id, n)
        for r, index in ranges.items():
            rows = [(r, i, b.depth, _signed(key), c, e[1], e[3], e[4]) for i, b in index.buckets() for key, chain in b.chains.items() for c, e in enumerate(chain)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            names = ["range", "bucket", "depth", "key", "chain", "sha", "keep_id", "group_size"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return own


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(t.translate(None, SPACE_BYTES)).digest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(_key(s)) for s in shas], pa.int64()), pa.array(shas, pa.binary())], names=["doc_id", "key", "sha"])


def build_index(docs: DataFrame, owner_bytes: int = 128 << 20, capacity: int = 512) -> tuple[DataFrame, int]:
    """The buckets of the index, in the shared folder, one row for each distinct normalised text; and the bits of a key that name its range.

    owner_bytes bounds the text that a key range holds on average, and so the
    memory of its owner, whatever the input's size; a range has a task of its own.
    """
    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.length("text").cast("long").alias("length"))
    total = narrow(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(shuffle_width(docs.sparkSession), math.ceil(total / owner_bytes))
    bits = max(1, math.ceil(math.log2(owners)))
    entries = (
        src.mapInArrow(_partials, PARTIAL)
        .repartitionById(1 << bits, _range("key", bits).cast("int"))
        .mapInArrow(_owner(bits, capacity), ENTRY)
    )
    return stored(entries, "exact-index"), bits


def _range(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def exact_dedup(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    index, bits = build_index(docs, **sizes)
    slots = index.select("range", "bucket", "depth").distinct()
    directory = slots.groupBy("range").agg(F.collect_list(F.struct("bucket", "depth")).alias("slots"))
    digests = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_digests, "doc_id long, key long, sha binary")
    found = F.filter("slots", lambda s: s["bucket"] == F.col("key").bitwiseAND(F.pow(F.lit(2), s["depth"]).cast("long") - 1))
    looked_up = digests.withColumn("range", _range("key", bits)).join(directory, "range").withColumn("bucket", F.get(found, F.lit(0))["bucket"])
    entries = index.select("range", "bucket", "sha", "keep_id", "group_size")
    return looked_up.join(entries, ["range", "bucket", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each normalised text, with the columns of docs; of rows that repeat its doc_id and text, one."""
    some_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own, sha, nth = (unused(docs, c) for c in ("own", "sha", "nth"))
    kept = exact_dedup(docs).where("kept").select(some_id.alias(own), F.col("text_sha256").alias(sha)).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(own, some_id).withColumn(sha, F.sha2(F.translate(text, SPACE, "").cast("binary"), 256))
    alike = Window.partitionBy(own, sha).orderBy(F.length(text).desc(), F.xxhash64("text"))
    found = rows.join(kept, [own, sha], "left_semi").withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
