"""Near-dedup with ProbMinHash: shingles, banding, verification, classes.

A document's shingles are its distinct windows of five words (lower case, split
at white space), each of weight 1 however often it occurs, since pairs are
verified by sets. Each shingle's arrivals form a Poisson process whose rate is its
weight and whose times depend on the shingle alone; an arrival picks a register,
and a register keeps the shingle that came first. A shingle stops as soon as its
arrivals come later than every register's. Two documents agree in a register with
the Jaccard similarity of their sets of shingles as probability.

Registers are banded. Texts with the same word sequence are one text from the
start. Each text of a band's bucket is first compared with the bucket's first.
Then, the links found so far joined to components, texts outside the first text's
component are compared with all texts of other components, whatever the size of
the bucket; a large number of them is dealt out in parts, to each of which the
bucket's texts go. Sketches are compared within the join, so that only pairs that
can be similar come out of it. Pairs are verified with the exact Jaccard
similarity of their sets of shingles, at least 0.8.

Defined results: null text counts as empty; texts of one to four words have one
shingle, all their words; texts without words are one class; a class is named
after its smallest doc_id (a null id only if there is no other); an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import Recent
from .common import narrow, stored, unused
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 8
REGISTERS = BANDS * ROWS
#: A bucket's texts outside its first text's component are dealt out in parts of about so many.
LARGE = 256
#: Share of registers in which all but one in 4000 pairs of similarity 0.8 agree (3.5 standard deviations below the mean).
LEAST_AGREEING = 0.8125 - 3.5 * math.sqrt(0.8125 * 0.1875 / REGISTERS)
#: Odd multipliers of the mixing functions.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def word_hashes() -> Recent:
    return Recent(lambda w: xxhash.xxh64_intdigest(w), 60_000)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def word_key(words: list[bytes]) -> bytes:
    """The id of a word sequence: 128 bits."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each window, in order, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : k + len(out)] + MIX[0])
    return out


def signatures(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers of each document of parts, given its distinct shingles and weights."""
    docs = len(parts)
    sig, best = np.zeros((docs, REGISTERS), np.uint64), np.full((docs, REGISTERS), np.inf)
    flat_sig, flat_best = sig.ravel(), best.ravel()
    owner = np.repeat(np.arange(docs), [len(p[0]) for p in parts])
    shingle = np.concatenate([p[0] for p in parts])
    rate = np.concatenate([p[1] for p in parts]).astype(float)
    at, step = np.zeros(len(shingle)), 1
    while len(shingle):
        many = max(1, min(64, 20_000 // len(shingle)))  # arrivals drawn at once
        k = np.arange(step, step + many, dtype=np.uint64)
        z = mixed(shingle[:, None] + k * MIX[0])
        gap = -np.log(((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[:, None]
        times = at[:, None] + np.cumsum(gap, axis=1)
        register = ((mixed(z + MIX[2]) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        cell = (owner[:, None] * REGISTERS + register).ravel()
        flat = times.ravel()
        early = np.flatnonzero(flat < flat_best[cell])
        np.minimum.at(flat_best, cell[early], flat[early])
        won = early[flat_best[cell[early]] == flat[early]]
        flat_sig[cell[won]] = shingle[won // many]
        at, step = times[:, -1], step + many
        going = at < best.max(axis=1)[owner]
        owner, shingle, rate, at = owner[going], shingle[going], rate[going], at[going]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        out = mixed(out * MIX[0] + sig.reshape(len(sig), BANDS, ROWS)[:, :, r])
    return out.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a number."""
    nibbles = (mixed(sig) >> np.uint64(60)).reshape(len(sig), REGISTERS // 16, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _agreeing(x: str, y: str) -> Column:
    """How many registers two sketches agree in."""

    def differing(a: Column, b: Column) -> Column:
        v = a.bitwiseXOR(b)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        return F.bit_count(v.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(REGISTERS) - F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, d: s + d)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
        found: dict[bytes, tuple] = {}
        for text in batch.column(0):
            words = words_of(text.as_py())
            if words and (key := word_key(words)) not in found:
                found[key] = np.unique(shingles(words))
        order = sorted(found, key=lambda k: len(found[k]))  # documents of like size together
        for a in _chunks([len(found[k]) for k in order], 30_000):
            keys = order[a]
            sig = signatures([(found[k], np.ones(len(found[k]))) for k in keys])
            bands = band_keys(sig)
            ids = pa.array([k for k in keys for _ in range(BANDS)], pa.binary())
            sizes = pa.array(np.repeat([len(found[k]) for k in keys], BANDS), pa.int64())
            first = (list(x) if b == 0 else None for x in sketches(sig) for b in range(BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), ids, sizes, pa.array(list(first), pa.list_(pa.int64()))], names=["bucket", "id", "n", "sketch"])


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and (total + n > most or i - begin >= 2000):
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if total:
        yield slice(begin, len(sizes))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_key(words_of(t.as_py())) for t in batch.column(1)], pa.binary())], names=["doc_id", "id"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {word_key(w): b" ".join(w) for t in batch.column(0) if (w := words_of(t.as_py()))}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["id", "words"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Recent(lambda w: np.unique(shingles(w.split(b" "))), 500)
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = known[x.as_py()], known[y.as_py()]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= SIMILAR * (len(a) + len(b) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""
    first, second = texts.select(F.col("id").alias("a"), F.col("words").alias("x")), texts.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a binary, b binary")


def _first_of(rows: DataFrame) -> DataFrame:
    """Adds to the rows of buckets of two texts or more the bucket's first text."""
    rows = rows.distinct()
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.count("*").alias("texts")).where("texts > 1")
    return rows.join(buckets.drop("texts"), "bucket")


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """Adds the component of each text and whether it is another than that of its bucket's first; label as components() gives it."""
    own = label.select(F.col("node").alias("id"), F.col("label"))
    firsts = label.select(F.col("node").alias("first"), F.col("label").alias("first_label"))
    named = members.join(own, "id", "left").join(firsts, "first", "left")
    return named.withColumn("label", F.coalesce("label", "id")).withColumn("outside", F.col("label") != F.coalesce("first_label", "first")).drop("first_label")


FITS = f"least(n, n_first) >= {SIMILAR} * greatest(n, n_first)"


def _with_first(members: DataFrame) -> DataFrame:
    return members.where("id != first").where(FITS).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()


def near_links(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) between ids of word sequences, enough to join each class."""
    text = narrow(docs).select("text")
    rows = stored(text.mapInArrow(_band_rows, "bucket long, id binary, n long, sketch array<long>"), "bands")
    members = stored(_first_of(rows.select("bucket", "id", "n")), "buckets")
    needed = members.select("id").distinct()
    texts = stored(text.mapInArrow(_texts, "id binary, words binary").join(needed, "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = stored(verified(_with_first(members), texts), "links")

    label = components(links)
    mixed_up = _labelled(members, label).where("outside").groupBy("bucket").agg(F.ceil(F.count("*") / large).cast("int").alias("parts"))
    mixed_up = stored(mixed_up, "mixed")
    named = _labelled(members.join(mixed_up, "bucket"), label)
    own = members.join(mixed_up, "bucket", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
    known = rows.where("sketch IS NOT NULL").select("id", "sketch").dropDuplicates(["id"]).join(own, "id")
    named = stored(named.join(known, "id"), "named")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = named.where("outside").select("bucket", part.alias("part"), F.col("id").alias("a"), F.col("n").alias("n_first"), F.col("label").alias("la"), F.col("sketch").alias("sa"), F.col("own").alias("oa"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    right = named.where("id != first").select("bucket", every.alias("part"), F.col("id").alias("b"), "n", F.col("label").alias("lb"), F.col("outside").alias("ob"), F.col("sketch").alias("sb"), F.col("own").alias("bb"))
    # a pair counts in the first bucket that it shares
    here = F.get(F.array_intersect("oa", "bb"), F.lit(0)) == left["bucket"]
    able = (left["bucket"] == right["bucket"]) & (left["part"] == right["part"]) & F.expr("la != lb AND (NOT ob OR a < b)") & F.expr(FITS) & (_agreeing("sa", "sb") >= math.floor(REGISTERS * LEAST_AGREEING)) & here
    rest = left.join(right, able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(verified(rest, texts))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept for every row of docs."""
    keyed = stored(narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keyed, "doc_id long, id binary"), "keys")
    label = components(near_links(docs))
    named = keyed.join(label, keyed["id"] == label["node"], "left").select("doc_id", F.coalesce("label", "id").alias("label"))
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(classes, "label").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names its class, with the columns of docs."""
    own = unused(docs, "own")
    kept = near_classes(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    found = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
