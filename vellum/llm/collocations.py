"""Phrase collocations: a minimal perfect hash over Apriori-safe candidates, counted in arrays.

1. Each text is read once. Words become 64-bit hashes, breaks between pieces 0;
   a task writes its hashes in blocks by language, and its word counts. That no two
   words of the corpus share a hash is checked, with another seed if they did, so
   from here on hashes stand for words exactly.
2. Words that reach the support, then pairs of such words, then longer phrases of
   such pairs: each step counts 64-bit hashes of phrases (summed in the task, then
   by hash), and those that reach the support become a bitmap of fixed length that
   the next steps read. Hashes that meet, in a phrase's or in the bitmap, only let
   more through.
3. Candidates are the words and phrases whose own bit and those of all phrases
   within are set: nothing frequent is lost. They are dealt to shards, and each
   shard's task builds its minimal perfect hash and lays the keys out by slot.
4. Mappers look every phrase up, compare the key stored at its slot, and count
   slots in numpy arrays, which are summed along a tree.
5. The counts of a phrase's two parts at each cut are read by slot; scores are
   Python integers.

What mappers hold is bounded: LONGEST bitmaps of BITS bits, and the functions, keys and counts of
at most ROUND_SLOTS candidates. More candidates are counted in further rounds, each
over all blocks. Only these bounded tables go through the driver; blocks,
candidates, counts and phrases stay Spark tables.

Defined results: null texts and texts without words add nothing; null lang is
`und`; doc_id is not read, so null or repeated ids change nothing and repeated rows
count again; long texts are read whole; ties go by count, then by phrase in UTF-8
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import release, stored
from .perfect_hash import PerfectHash, build, mixed

SUPPORT = 100
LONGEST = 5
TOP = 2000
#: Ids in one block of a language; ids, and words, that a task holds before it writes them.
BLOCK = 1 << 11
FLUSH = 1 << 20
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
KNOWN = 1 << 18
BITS = 1 << 24
#: Hashes of phrases that a task holds before it sums them up.
HELD = 1 << 21
SHARD_SLOTS = 1 << 14
ROUND_SLOTS = 1 << 20
#: Entries of an array that are summed as one row, and arrays that one task sums.
PIECE = 1 << 16
FAN = 16
#: Languages whose totals are broadcast; with more they are joined by shuffle.
LANGS = 1 << 14
#: Rows that Spark hands to Python at once: blocks (16 kB each; its Parquet reader takes 4,096 together), and shards (0.8 MB each).
BLOCK_ROWS, SHARD_ROWS = 256, 16
U = np.uint64
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, every break to a full stop, tab to space.
TO_PIECES = bytes(46 if b in BREAKS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def hash_of(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def hash_of_lang(lang: str, seed: int) -> int:
    """Of another family than the words', since a language's name may be a word, too."""
    return hash_of(lang.encode("utf-8", "surrogatepass"), seed + (1 << 32))


class Vocabulary(dict):
    """Word to its number in this task; hashes by number. The break is number 0."""

    def __init__(self, seed: int) -> None:
        super().__init__({b".": 0})
        self.seed, self.hashes = seed, [0]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(hash_of(word, self.seed))
        return n


def encoded(docs: DataFrame, seed: int, longest: int = LONGEST) -> DataFrame:
    """Blocks (lang, ids) of word hashes, and rows (lang, word, h, n) of word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Vocabulary(seed), {}, 0

        def write() -> Iterator[pa.RecordBatch]:
            hashes = np.array(known.hashes, U)
            words = [w.decode("utf-8", "surrogatepass") for w in known]
            for lang, parts in held.items():
                numbers = np.concatenate(parts)
                for k in range(0, len(numbers), BLOCK):
                    # a phrase over the block's end is in this block: the next one's first words follow as far as a phrase reaches
                    tail = numbers[k : k + BLOCK + longest - 1]
                    yield row(lang=[lang], ids=[hashes[tail].astype("<u8").tobytes()], own=[min(BLOCK, len(numbers) - k)])
                counts = np.bincount(numbers, minlength=1)
                at = np.flatnonzero(counts[1:]) + 1
                for k in range(0, len(at), 1 << 16):
                    some = at[k : k + (1 << 16)]
                    yield row(lang=[lang] * len(some), word=[words[i] for i in some.tolist()], h=hashes[some].view(np.int64), n=counts[some])

        def row(lang: list, ids: list | None = None, own: list | None = None, word: list | None = None, h: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
            none = [None] * len(lang)
            columns = [pa.array(lang, pa.string()), pa.array(none if ids is None else ids, pa.binary()), pa.array(none if own is None else own, pa.int64()), pa.array(none if word is None else word, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(none if x is None else x, pa.int64()) for x in (h, n))], names=["lang", "ids", "own", "word", "h", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass").translate(TO_PIECES)
                parts, start = held.setdefault(lang, []), 0
                while start < len(data):
                    end = data.find(b" ", start + SLICE)
                    end = len(data) if end < 0 else end
                    parts.append(np.fromiter(map(known.__getitem__, data[start:end].replace(b".", b" . ").split()), np.int32))
                    size += len(parts[-1])
                    start = end
                parts.append(np.zeros(1, np.int32))
                if size >= FLUSH or len(known) >= KNOWN:
                    yield from write()
                    known, held, size = Vocabulary(seed), {}, 0
                    release()
        yield from write()
        known, held = Vocabulary(seed), {}
        release()

    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "lang string, ids binary, own long, word string, h long, n long")


def chained(lang: np.ndarray | int, ids: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of the first, the first two, ... of the words whose hashes are given, after their language's."""
    out, h = [], lang
    with np.errstate(over="ignore"):
        for k, x in enumerate(ids):
            h = mixed((h ^ x) * U(0xD6E8FEB86659FD93), k + 1)
            out.append(h)
    return out


ARRAYS = "maker long, piece long, data binary"


def summed(arrays: DataFrame, kind: type = np.int64, add: np.ufunc = np.add) -> DataFrame:
    """piece, data: arrays (maker, piece, data) added up piece by piece along a tree, FAN to a task at a time, until one is left."""

    def total(table: pa.Table) -> pa.Table:
        data = reduce(add, (np.frombuffer(x.as_buffer(), kind) for x in table["data"]))
        return pa.table({"maker": table["next"][:1], "piece": table["piece"][:1], "data": [data.tobytes()]}, schema=schema)

    schema = pa.schema([("maker", pa.int64()), ("piece", pa.int64()), ("data", pa.binary())])
    makers = arrays.rdd.getNumPartitions()
    while makers > 1:
        arrays = arrays.withColumn("next", F.expr(f"maker div {FAN}")).groupBy("piece", "next").applyInArrow(total, ARRAYS)
        makers = -(-makers // FAN)
    return arrays.select("piece", "data")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which of so many bits (packed) the hashes h set; their number is fixed, so this comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for b in batches:
            found[b.column("h").to_numpy().view(U) % U(bits)] = True
        data, maker = np.packbits(found), TaskContext.get().partitionId()
        for k in range(0, len(data), PIECE):
            if data[k : k + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([maker]), pa.array([k // PIECE]), pa.array([data[k : k + PIECE].tobytes()], pa.binary())], names=["maker", "piece", "data"])

    out = np.zeros(-(-bits // 8), np.uint8)
    for piece, data in summed(hashes.select("h").mapInArrow(run, ARRAYS), np.uint8, np.bitwise_or).collect():
        out[piece * PIECE : piece * PIECE + len(data)] = np.frombuffer(data, np.uint8)
    return out


def word_hashes(words: DataFrame, seed: int, support: int) -> DataFrame:
    """h of the words (lang, h) that reach the support, as phrases of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([hash_of_lang(x, seed) for x in b.column("lang").to_pylist()], U)
            yield pa.RecordBatch.from_arrays([pa.array(chained(lang, [b.column("h").to_numpy().view(U)])[0].view(np.int64))], names=["h"])

    return words.where(F.col("n") >= support).select("lang", "h").mapInArrow(run, "h long")


def windows(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Language hash, ids of all its blocks in the batch, and which places are a block's own (what follows a block is the next one's, too)."""
    ids: dict[str, list[np.ndarray]] = {}
    own: dict[str, list[np.ndarray]] = {}
    end = np.zeros(1, U)
    for lang, data, n in zip(batch.column("lang").to_pylist(), batch.column("ids"), batch.column("own").to_pylist(), strict=True):
        block = np.frombuffer(data.as_buffer(), "<u8")
        ids.setdefault(lang, []).extend((block, end))
        own.setdefault(lang, []).append(np.arange(len(block) + 1) < n)
    for lang, parts in ids.items():
        yield hash_of_lang(lang, seed), np.concatenate(parts), np.concatenate(own[lang])


def is_set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes % U(bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def safe_starts(lang: int, ids: np.ndarray, own: np.ndarray, maps: list[np.ndarray], bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, their hashes) of the phrases that can be frequent: their own bit and those of all phrases within are set, as far as there are bitmaps."""
    hashes = chained(U(lang), [ids])[0]
    at = np.flatnonzero((ids != 0) & is_set(maps[0], hashes, bits))
    hashes = hashes[at]
    yield 1, at[own[at]], hashes[own[at]]
    for k in range(1, longest):
        # a phrase goes on where the phrase without its first word begins at the next place
        on = np.flatnonzero(np.diff(at) == 1)
        at, hashes = at[on], hashes[on]
        with np.errstate(over="ignore"):
            hashes = mixed((hashes ^ ids[at + k]) * U(0xD6E8FEB86659FD93), k + 1)
        if k < len(maps):
            good = is_set(maps[k], hashes, bits)
            at, hashes = at[good], hashes[good]
        yield k + 1, at[own[at]], hashes[own[at]]


def frequent_hashes(blocks: DataFrame, seed: int, maps: list[np.ndarray], bits: int, longest: int, support: int) -> list[np.ndarray]:
    """Bitmaps of the phrases of more words than the last of maps, up to `longest`, whose hashes reach the support."""
    done = len(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def write() -> Iterator[pa.RecordBatch]:
            for length, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                for k in range(0, len(h), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[some]), length)), pa.array(h[some].view(np.int64)), pa.array(n[some])], names=["length", "h", "n"])
            held.clear()
            release()

        for b in batches:
            for lang, ids, own in windows(b, seed):
                for length, at, hashes in safe_starts(lang, ids, own, shared.value, bits, longest):
                    if length > done:
                        held.setdefault(length, []).append(hashes)
                        size += len(at)
                if size > HELD:
                    yield from write()
                    size = 0
        yield from write()

    shared = blocks.sparkSession.sparkContext.broadcast(maps)
    found = blocks.mapInArrow(run, "length long, h long, n long").groupBy("length", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    found = stored(found.select("length", "h"), "frequent")
    return [bitmap(found.where(F.col("length") == k), bits) for k in range(done + 1, longest + 1)]


def candidates(blocks: DataFrame, seed: int, maps: list[np.ndarray], bits: int, longest: int) -> DataFrame:
    """h, key: the hash and the words' hashes (after the language's) of every phrase or word that can be frequent, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def once(rows: np.ndarray) -> np.ndarray:
            """Rows (hash, language, words), each once; of rows that only share a hash all stay."""
            _, first, which = np.unique(rows[:, 0], return_index=True, return_inverse=True)
            other = np.flatnonzero((rows != rows[first][which]).any(axis=1))
            return rows[np.append(first, other)]

        def write() -> Iterator[pa.RecordBatch]:
            for length, parts in held.items():
                rows = once(np.concatenate(parts))
                for k in range(0, len(rows), 1 << 15):
                    some = rows[k : k + (1 << 15)]
                    data = pa.py_buffer(np.ascontiguousarray(some[:, 1:]).astype("<u8").tobytes())
                    keys = pa.Array.from_buffers(pa.binary(8 * (length + 1)), len(some), [None, data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].view(np.int64)), keys], names=["h", "key"])
            held.clear()
            release()

        for b in batches:
            for lang, ids, own in windows(b, seed):
                for length, at, hashes in safe_starts(lang, ids, own, shared.value, bits, longest):
                    rows = once(np.stack([hashes, np.full(len(at), lang, U), *(ids[at + k] for k in range(length))], axis=1))
                    held.setdefault(length, []).append(rows)
                    size += len(rows)
            if size > HELD // 4:
                held.update({k: [once(np.concatenate(v))] for k, v in held.items()})
                size = sum(len(v[0]) for v in held.values())
                if size > HELD // 8:
                    yield from write()
                    size = 0
        yield from write()

    shared = blocks.sparkSession.sparkContext.broadcast(maps)
    return blocks.mapInArrow(run, "h long, key binary").distinct()


def key_table(keys: list[bytes], longest: int) -> np.ndarray:
    """A row of uint64 for each key: language, words, zeros."""
    out = np.zeros((len(keys), longest + 1), U)
    for i, k in enumerate(keys):
        x = np.frombuffer(k, "<u8")
        out[i, : len(x)] = x
    return out


def shards_of(found: DataFrame, shards: int, longest: int) -> DataFrame:
    """shard, sizes, words, keys: a minimal perfect hash of each shard's candidates and their keys by slot."""

    def make(table: pa.Table) -> pa.Table:
        sizes, words, order = build(table["h"].to_numpy().view(U))
        keys = key_table(table["key"].to_pylist(), longest)[order]
        return pa.table({"shard": table["shard"][:1], "sizes": [sizes.tobytes()], "words": [words.tobytes()], "keys": [keys.tobytes()]}, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()), ("keys", pa.binary())])
    return found.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(make, "shard long, sizes binary, words binary, keys binary")


class Round:
    """The functions, keys and counts of some shards."""

    def __init__(self, rows: list, shards: int, longest: int, counts: dict[int, bytes] | None = None) -> None:
        self.shards, self.longest = shards, longest
        self.place = np.full(shards, -1, np.int64)
        self.ids = [r["shard"] for r in rows]
        self.place[self.ids] = np.arange(len(rows))
        self.function = PerfectHash([(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["words"], U)) for r in rows])
        self.keys = np.concatenate([np.frombuffer(r["keys"], U).reshape(-1, longest + 1) for r in rows])
        each = [len(r["keys"]) // (8 * (longest + 1)) for r in rows]
        self.starts = np.concatenate([[0], np.cumsum(each)])
        self.counts = None if counts is None else np.concatenate([np.frombuffer(counts[r["shard"]], np.int64) if r["shard"] in counts else np.zeros(n, np.int64) for r, n in zip(rows, each, strict=True)])

    def slots(self, hashes: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each hash whose stored key is the one given (columns: language, words), else -1."""
        place = self.place[(hashes.view(np.int64) % self.shards)]
        here = np.flatnonzero(place >= 0)
        slot = self.function.slots(hashes[here], place[here])
        here, slot = here[slot >= 0], slot[slot >= 0]
        same = np.ones(len(here), bool)
        for k in range(self.longest + 1):
            same &= self.keys[slot, k] == (keys[k][here] if k < len(keys) else U(0))
        out = np.full(len(hashes), -1, np.int64)
        out[here[same]] = slot[same]
        return out


def counted(blocks: DataFrame, shared, seed: int, maps, bits: int, longest: int) -> DataFrame:  # noqa: ANN001
    """shard, data: occurrences by slot of the round's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this = shared.value
        total, held, size = np.zeros(this.function.size, np.int64), [], 0
        for b in batches:
            for lang, ids, own in windows(b, seed):
                for length, at, hashes in safe_starts(lang, ids, own, maps.value, bits, longest):
                    found = this.slots(hashes, [np.full(len(at), lang, U), *(ids[at + k] for k in range(length))])
                    held.append(found[found >= 0])
                    size += len(held[-1])
                if size > len(total):
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        maker = TaskContext.get().partitionId()
        for shard, a, z in zip(this.ids, this.starts[:-1], this.starts[1:], strict=True):
            if total[a:z].any():
                yield pa.RecordBatch.from_arrays([pa.array([maker]), pa.array([shard]), pa.array([total[a:z].tobytes()], pa.binary())], names=["maker", "piece", "data"])

    return summed(blocks.mapInArrow(run, ARRAYS)).withColumnRenamed("piece", "shard")


def frequent_of(shards: DataFrame, counts: DataFrame, support: int, longest: int) -> DataFrame:
    """key, length, a: the phrases of two words or more with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, data in zip(b.column("keys"), b.column("data"), strict=True):
                table = np.frombuffer(keys.as_buffer(), U).reshape(-1, longest + 1)
                a = np.frombuffer(data.as_buffer(), np.int64)
                length = (table[:, 1:] != 0).sum(axis=1)
                at = np.flatnonzero((a >= support) & (length > 1))
                out = [table[i, : length[i] + 1].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(table[at, 0].view(np.int64)), pa.array(length[at]), pa.array(a[at])], names=["key", "lh", "length", "a"])

    return shards.join(counts, "shard").select("keys", "data").mapInArrow(run, "key binary, lh long, length long, a long")


def with_parts(phrases: DataFrame, shared, longest: int) -> DataFrame:  # noqa: ANN001
    """phrases with l and r (arrays by cut) filled in where a part is among this round's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this = shared.value
        for b in batches:
            keys = key_table(b.column("key").to_pylist(), longest)
            length = b.column("length").to_numpy()
            sides = {s: b.column(s).to_pylist() for s in ("l", "r")}
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                words = [keys[at, k] for k in range(n + 1)]
                for k in range(1, n):
                    for side, part in (("l", words[1 : k + 1]), ("r", words[k + 1 :])):
                        slot = this.slots(chained(words[0], part)[-1], [words[0], *part])
                        for i, s in zip(at[slot >= 0].tolist(), slot[slot >= 0].tolist(), strict=True):
                            sides[side][i][k - 1] = int(this.counts[s])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "lh", "length", "a")), *(pa.array(sides[s], pa.list_(pa.int64())) for s in ("l", "r"))], names=["key", "lh", "length", "a", "l", "r"])

    return phrases.mapInArrow(run, "key binary, lh long, length long, a long, l array<long>, r array<long>")


def best_cut(a: int, n: int, left: list[int], right: list[int]) -> tuple[int, int, int]:
    """score, l, r of the cut that scores lowest, the first of equals; exact."""
    score, k = min((1000 * a * n // (x * y), k) for k, (x, y) in enumerate(zip(left, right, strict=True)))
    return score, left[k], right[k]


SCORED = "key binary, lang string, a long, l long, r long, score long, n long, within array<binary>, hashes array<long>"


def scored(phrases: DataFrame) -> DataFrame:
    """The phrases with score, l and r of their cut, their words' hashes, and in `within` the parts of one word less that occur no more often: they are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            cut = [best_cut(a, n, x, y) for a, n, x, y in zip(rows["a"], rows["n"], rows["l"], rows["r"], strict=True)]
            within = []
            for key, a, x, y in zip(rows["key"], rows["a"], rows["l"], rows["r"], strict=True):
                parts = [key[:-8]] * (100 * a >= 100 * x[-1]) + [key[:8] + key[16:]] * (100 * a >= 100 * y[0])
                within.append(parts if len(key) > 24 else [])
            columns = [pa.array([c[i] for c in cut], pa.int64()) for i in (1, 2, 0)]
            hashes = pa.array([np.frombuffer(k, "<i8")[1:].tolist() for k in rows["key"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("lang"), b.column("a"), *columns, b.column("n"), pa.array(within, pa.list_(pa.binary())), hashes], names=["key", "lang", "a", "l", "r", "score", "n", "within", "hashes"])

    return phrases.mapInArrow(run, SCORED)


def _distinct_hashes(frame: DataFrame, h: str, *of: str) -> bool:
    return frame.select(h, *of).distinct().groupBy(h).count().where("count > 1").isEmpty()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, jobs hand at most so many rows to Python at once: by default it is 10,000, however large they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mined(docs: DataFrame, seed: int, support: int, longest: int, round_slots: int, shard_slots: int, bits: int) -> tuple[DataFrame, DataFrame] | None:
    """Scored phrases and the words with their hashes; None if two different things share a hash under this seed."""
    spark: SparkSession = docs.sparkSession
    read = stored(encoded(docs, seed, longest), "encoded")
    words = stored(read.where("word IS NOT NULL").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
    blocks = read.where("ids IS NOT NULL").select("lang", "ids", "own")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("lh", F.udf(lambda x: int(np.array([hash_of_lang(x, seed)], U).view(np.int64)[0]), "long")("lang")), "totals")
    if not (_distinct_hashes(words, "h", "word") and words.where("h = 0").isEmpty() and _distinct_hashes(totals, "lh", "lang")):
        return None
    size = totals.agg(F.sum("n")).first()[0] or 0
    # every mapper makes a whole array of counts, so there are no more of them than there is counting for
    makers = max(2 * spark.sparkContext.defaultParallelism, size // (16 * round_slots))
    maps = [bitmap(word_hashes(words, seed, support), bits)]
    with batches_of(spark, BLOCK_ROWS):
        return counted_and_cut(blocks, makers, words, totals, maps, seed, support, longest, round_slots, shard_slots, bits)


def counted_and_cut(blocks: DataFrame, makers: int, words: DataFrame, totals: DataFrame, maps: list[np.ndarray], seed: int, support: int, longest: int, round_slots: int, shard_slots: int, bits: int) -> tuple[DataFrame, DataFrame] | None:
    """The passes over the blocks, and the cuts. Sums by hash hold a task's different hashes, so their tasks stay as small as they were read; arrays of counts are made by `makers` tasks."""
    spark = blocks.sparkSession
    for reach in sorted({min(2, longest), longest}):
        maps = maps + frequent_hashes(blocks, seed, maps, bits, reach, support)
    blocks = blocks.coalesce(makers)
    found = stored(candidates(blocks, seed, maps, bits, longest), "candidates")
    if not _distinct_hashes(found, "h", "key"):
        return None
    count = found.count()
    shards = max(1, -(-count // shard_slots))
    table = stored(shards_of(found, shards, longest), "shards")
    each = max(1, round_slots // shard_slots)
    maps_shared = spark.sparkContext.broadcast(maps)
    parts, rounds = [], []
    for k in range(0, shards, each):
        rows = table.where(F.col("shard").between(k, k + each - 1)).orderBy("shard").collect()  # at most round_slots candidates or so
        if rows:
            shared = spark.sparkContext.broadcast(Round(rows, shards, longest))
            parts.append(stored(counted(blocks, shared, seed, maps_shared, bits, longest), "counts"))
            shared.unpersist()
            rounds.append((k, parts[-1]))
    if not parts:
        return spark.createDataFrame([], SCORED), words
    with batches_of(spark, SHARD_ROWS):
        phrases = stored(frequent_of(table, reduce(DataFrame.unionAll, parts), support, longest), "phrases")
    empty = F.array_repeat(F.lit(0).cast("long"), (F.col("length") - 1).cast("int"))
    phrases = phrases.withColumns({"l": empty, "r": empty})
    for k, counts in rounds:
        rows = table.where(F.col("shard").between(k, k + each - 1)).orderBy("shard").collect()
        this = Round(rows, shards, longest, {r["shard"]: r["data"] for r in counts.collect()})
        phrases = stored(with_parts(phrases, spark.sparkContext.broadcast(this), longest), "parts")
    few = totals.count() <= LANGS
    phrases = phrases.join(F.broadcast(totals) if few else totals, "lh")
    return stored(scored(phrases.select("key", "lang", "length", "a", "l", "r", "n")), "scored"), words


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, round_slots: int = ROUND_SLOTS, shard_slots: int = SHARD_SLOTS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases."""
    seed = 0
    while (found := mined(docs, seed, support, longest, round_slots, shard_slots, bits)) is None:
        seed += 1
    phrases, words = found
    dropped = phrases.select(F.explode("within").alias("key")).distinct()
    left = phrases.join(dropped, "key", "left_anti").drop("within")
    order = [F.col("score").desc(), F.col("a").desc()]
    # words are joined to the phrases that can be among the first, ties and all
    left = left.withColumn("at_best", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at_best") <= top)
    cells = left.select("key", "lang", F.posexplode("hashes").alias("place", "h"))
    texts = cells.join(words.where(F.col("n") >= support).select("lang", "h", "word"), ["lang", "h"]).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase")))
    return left.join(texts, "key").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Lengths as rows of one table; products as HUGEINT.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)
), every AS (
  SELECT lang, [w1] AS p FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM runs WHERE w5 IS NOT NULL
), f AS (SELECT lang, p, count(*) AS a FROM every GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (
  SELECT f.lang, f.p, f.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * f.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f) f JOIN f x ON x.lang = f.lang AND x.p = f.p[1:k] JOIN f y ON y.lang = f.lang AND y.p = f.p[k + 1:] JOIN totals t ON t.lang = f.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, part, a FROM (SELECT lang, a, p[i:j] AS part FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM f), range(1, 6) t(j) WHERE j > i AND j <= len(p) AND j - i + 1 < len(p))
), left_over AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = b.lang AND s.part = b.p AND 100 * s.a >= 100 * b.a)),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM left_over)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""
