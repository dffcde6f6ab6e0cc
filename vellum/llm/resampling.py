"""Importance resampling towards a target distribution: array-scored weights, sorted runs, tournament trees.

Two passes over the texts. The first counts hashed features (runs of one and two
words, crc32 modulo `buckets`) in numpy arrays, one an executor task, which Spark
sums; the second adds each document's gains up. The noise of a document comes
from its id alone, so a draw can be repeated.

The second pass leaves one sorted run a task in the shared folder. How many rows
have which score is known before anything is merged (scores are integers of less
than 2^18 different values whatever the counts: 1000 times the logarithm of a
ratio of 64-bit counts, plus noise between -3,200 and 22,200), and so is the score
at which the draw ends: what lies below is left out of the merge. The rest is
dealt by range of (score, doc_id, row); in each range a k-way tournament tree
merges the pieces of all runs and stops after the draw's count. A range's first
rank is the number of rows in the ranges before it. A range holds RANGE_ROWS rows
on average, whatever repeats: the row's place in its run divides equal ids, too.

Defined results: a null text has no features (weight 0); a null doc_id is hashed
as the empty text and comes after other ids among ties; rows that repeat a doc_id
are each weighed and drawn by themselves, in the order of their runs if their
scores are equal; long texts are read whole, in blocks; without benchmark texts
t and T are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import narrow, shuffle_width, stored
from .license_scan import TO_WORDS

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
RANGE_ROWS = 1 << 20
BLOCK = 1 << 20
FLUSH = 1 << 21
#: monotonically_increasing_id() has the task above this bit and the row's place below.
PLACE_BITS = 33
END = (math.inf,)


def features(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of one and two words; a long text comes in blocks."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS)
    start, before = 0, None
    while start < len(data):
        end = data.find(b" ", start + BLOCK)
        end = len(data) if end < 0 else end
        words = data[start:end].split()
        start = end
        if not words:
            continue
        own = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), own))
        pairs = list(map(crc32, words[1:], spaced))
        if before is not None:
            pairs.append(crc32(words[0], before))
        before = spaced[-1]
        yield np.array(own + pairs, np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array a task, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for found in features(text.as_py(), buckets):
                    held.append(found)
                    n += len(found)
                if n > FLUSH:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target against its share in the corpus, both smoothed by one a bucket."""
    buckets, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_raw + buckets) / ((s + 1) * (all_target + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of every row."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights, scores = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = total = 0
                for found in features(text.as_py(), buckets):
                    n += len(found)
                    total += int(gain[found].sum())
                weights.append(total // n if n else 0)
                sizes.append(n)
                scores.append(weights[-1] + noise(doc_id, seed))
            words = [(n + 1) // 2 for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, weights, scores, words))], names=["doc_id", "n_features", "weight", "score", "n_words"])

    return docs.mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, n_words long")


def tournament(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The entries of sorted runs in order: a tree of losers, in which a run's next entry is played from its leaf to the root."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    heads = [next(r, END) for r in runs] + [END] * (size - len(runs))
    runs = runs + [iter(())] * (size - len(runs))
    loser, winner = [0] * size, list(range(size))
    while len(winner) > 1:
        up = []
        for k in range(0, len(winner), 2):
            a, b = winner[k], winner[k + 1]
            if heads[b] < heads[a]:
                a, b = b, a
            up.append(a)
            loser[(len(winner) + k) >> 1] = b
        winner = up
    first = winner[0]
    while heads[first] is not END:
        yield heads[first]
        heads[first] = next(runs[first], END)
        node = (first + size) >> 1
        while node:
            if heads[loser[node]] < heads[first]:
                loser[node], first = first, loser[node]
            node >>= 1


COLUMNS = ["doc_id", "n_features", "weight", "score", "row"]


def merged(dealt: DataFrame, stop: int) -> DataFrame:
    """The rows of each partition of dealt (pieces of runs, one after the other) with range and place from 1 on in merged order, which is null beyond `stop`."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        if not table.num_rows:
            return
        ids, scores, rows = (table[c].to_pylist() for c in ("doc_id", "score", "row"))
        run_of = np.asarray(rows, np.int64) >> PLACE_BITS
        cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(rows)]

        def entries(a: int, b: int) -> Iterator[tuple]:
            return ((-scores[i], ids[i] is None, ids[i] or 0, rows[i], i) for i in range(a, b))

        order = np.empty(len(rows), np.int64)
        taken = np.zeros(len(rows), bool)
        n = 0
        for entry in tournament([entries(a, b) for a, b in zip(cuts, cuts[1:])]):
            if n == stop:
                break
            order[n] = entry[-1]
            taken[entry[-1]] = True
            n += 1
        order[n:] = np.flatnonzero(~taken)
        place = pa.array(np.arange(1, len(rows) + 1), mask=np.arange(len(rows)) >= n)
        here = pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int64))
        out = table.select(["doc_id", "n_features", "weight", "score"]).take(pa.array(order)).append_column("range", here).append_column("place", place)
        yield from out.to_batches(max_chunksize=1 << 16)

    return dealt.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, range long, place long")


def resample(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs."""
    spark = docs.sparkSession
    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(src, buckets), bucket_counts(benchmark, buckets))
    runs = weighed(src, gain, seed).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    runs = stored(runs.withColumn("row", F.monotonically_increasing_id()), "runs")
    eligible = F.col("n_words") >= min_words
    by_score = sorted(runs.where(eligible).groupBy("score").count().collect(), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    reached, cut = 0, None
    for score, n in by_score:
        if reached >= draw:
            break
        reached, cut = reached + n, score
    columns = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = eligible & (F.col("score") >= cut)
    width = max(shuffle_width(spark), -(-reached // range_rows))
    dealt = runs.where(above).select(*COLUMNS).repartitionByRange(width, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    ranked = stored(merged(dealt.sortWithinPartitions("row"), draw), "ranked")
    sizes = sorted(ranked.groupBy("range").count().collect())
    starts, n = [], 0
    for k, rows in sizes:
        starts.append((k, n))
        n += rows
    starts = spark.createDataFrame(starts, "range long, start long")  # a row for each RANGE_ROWS rows of the draw
    rank = F.col("start") + F.col("place")
    drawn = ranked.join(F.broadcast(starts), "range").select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(runs.where(~above).select(*columns, F.lit(None).cast("long").alias("rank")))


#: crc32 byte by byte over the features that differ; everything else is counting. Holds where no doc_id repeats.
ORACLE = """
WITH RECURSIVE table_of(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_of WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS tab FROM table_of WHERE k = 8),
split AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark
), words AS (SELECT kind, row, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
pairs AS (SELECT kind, row, a, lead(a) OVER (PARTITION BY kind, row ORDER BY i) AS b FROM words),
feature AS (SELECT kind, row, a AS f FROM words UNION ALL SELECT kind, row, a || ' ' || b FROM pairs WHERE b IS NOT NULL),
known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda k: (instr('0123456789ABCDEF', substr(x, 2 * k::INT + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * k::INT + 2, 1)) - 1)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM known, crc_table
), per_bucket AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM feature JOIN hashed USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM per_bucket
), weights AS (
  SELECT row, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM feature JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (row) WHERE kind = 'd'
), placed AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY eligible) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
