"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

The n-grams are all words of the text and all pairs of words that follow one
another. They are hashed into BUCKETS buckets. The raw multinomial counts all
documents; the target's counts documents that `labels` marks with quality 1, a
sample of at most `trusted` ids drawn by hash (the bound of what is broadcast),
and is smoothed towards the raw one by PRIOR counts. A document's score is the
mean over its n-grams of log(p_target / p_raw); it is kept if no base rule fails
it and the score is at least `threshold`, in nats an n-gram. The default lies below
every labelled good document of the test tables (-0.011 at the least of 200
documents, -0.043 of 1,000, -0.018 of 4,000) and above most of the poor ones that
pass the base rules (4 of 6, 25 of 27, 84 of 114).

Only DataFrame functions: a document's windows of three words are compared
within its row. A window's key holds 40 bits of its hash and the position of its
first word, so that sorting brings equal windows together; the words themselves
are compared before they count as equal, and a row where two different windows
share a hash, or with 2^24 words or more, goes by the words alone.

Defined results: null text has no words and fails; without labels, or without a
trusted document, the ratio is 0 for every n-gram and only the base rules
decide; rows that repeat a doc_id are each measured by their own text; a null
doc_id is measured like any other; long texts are read whole; an empty table
gives no rows; clashing extra columns stay with the input.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, SPACE_CLASS

BUCKETS = 1 << 12
#: Sixteen counts a bucket: in a small corpus, where a document's own words are most of what their buckets hold, no score goes far.
PRIOR = 16.0 * BUCKETS
POSITION = 24
TRUSTED = 16_000
THRESHOLD = -0.05
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def _bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1))


def _hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hash of each two words that follow one another."""
    return F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(hashes, i), x))


def ratios(docs: DataFrame, labels: DataFrame | None, trusted: int = TRUSTED) -> list[float]:
    """log(p_target / p_raw) of each bucket, both smoothed by one."""
    words = docs.select("doc_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    if labels is None:
        return [0.0] * BUCKETS
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted)
    flagged = words.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    hashed = flagged.select(F.col("good_id").isNotNull().cast("long").alias("t"), _hashes("w").alias("h"))
    grams = hashed.select("t", F.explode(F.concat("h", _pairs(F.col("h")))).alias("x")).select("t", _bucket(F.col("x")).alias("bucket"))
    counts = {r["bucket"]: (r["raw"], r["good"]) for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()}
    n_raw, n_good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not n_good:
        return [0.0] * BUCKETS

    def ratio(raw: int, good: int) -> float:
        p = (raw + 1) / (n_raw + BUCKETS)
        return round(math.log((good + PRIOR * p) / (n_good + PRIOR) / p), 6)

    return [ratio(*counts.get(b, (0, 0))) for b in range(BUCKETS)]


def measured(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with the measures and verdict of each row, all named with the prefix."""
    at = {k: f"{prefix}{k}" for k in ["t", "w", "h", "pairs", "sorted", "twins", "same", "total", *MEASURES]}
    c = {k: F.col(f"`{v}`") for k, v in at.items()}
    model = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    df = docs.withColumn(at["t"], F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(at["w"], _words(c["t"]))
    df = df.withColumn(at["h"], _hashes(c["w"]))
    df = df.withColumn(at["pairs"], _pairs(c["h"]))
    n = F.size(c["w"])
    mask = (1 << POSITION) - 1
    keyed = F.transform(F.slice(c["h"], 3, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(c["pairs"], i), x).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

    def ratio_of(grams: Column, start: Column) -> Column:
        return F.aggregate(grams, start, lambda s, x: s + F.get(model, _bucket(x).cast("int")))

    df = df.withColumn(at["sorted"], F.sort_array(keyed)).withColumn(at["total"], ratio_of(c["pairs"], ratio_of(c["h"], F.lit(0.0))))

    def hash_of(x: Column) -> Column:
        return F.shiftright(x, POSITION)

    def word(x: Column, k: int) -> Column:
        return F.get(c["w"], x.bitwiseAND(F.lit(mask)).cast("int") + k)

    def near(array: Column, i: Column) -> Column:
        return F.coalesce(hash_of(F.get(array, i)), F.lit(1 << 62))

    twins = F.filter(c["sorted"], lambda x, i: (hash_of(x) == near(c["sorted"], i - 1)) | (hash_of(x) == near(c["sorted"], i + 1)))
    df = df.withColumn(at["twins"], twins)
    clash = F.exists(
        F.transform(c["twins"], lambda x, i: (hash_of(x) == near(c["twins"], i + 1)) & ~((word(x, 0) == word(F.get(c["twins"], i + 1), 0)) & (word(x, 1) == word(F.get(c["twins"], i + 1), 1)) & (word(x, 2) == word(F.get(c["twins"], i + 1), 2)))),
        lambda bad: F.coalesce(bad, F.lit(False)),
    )
    by_words = F.transform(F.slice(c["w"], 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(c["w"], i + 1), F.get(c["w"], i + 2)).alias("k"), i.cast("long").alias("p")))
    ordered = F.array_sort(by_words)
    exact = F.transform(F.filter(F.zip_with(ordered, F.concat(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(0))), F.array(F.lit(None).cast("struct<k:string,p:bigint>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"]["k"] == p["b"]["k"]), lambda p: F.array(p["a"]["p"], p["b"]["p"]))
    fast = F.transform(c["twins"], lambda x: x.bitwiseAND(F.lit(mask)))
    df = df.withColumn(at["same"], F.when(clash | (n >= mask), F.flatten(exact)).otherwise(fast))
    lines = F.filter(F.split(c["t"], "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    covered = F.array_distinct(F.flatten(F.transform(c["same"], lambda p: F.array(p, p + 1, p + 2))))
    df = (
        df.withColumn(at["n_words"], n.cast("long"))
        .withColumn(at["word_chars"], F.length(F.array_join(c["w"], "")).cast("long"))
        .withColumn(at["n_symbols"], F.length(F.regexp_replace(c["t"], "[^#*$%&|<>]+", "")).cast("long"))
        .withColumn(at["n_dup_lines"], (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn(at["n_repeat_words"], F.size(covered).cast("long"))
    )
    grams = F.greatest(2 * c["n_words"] - 1, F.lit(1))
    df = df.withColumn(at["base_failed"], (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).withColumn(at["score"], c["total"] / grams)
    df = df.withColumn(at["kept"], ~c["base_failed"] & (c["score"] >= threshold))
    return df.drop(*(at[k] for k in ("t", "w", "h", "pairs", "sorted", "twins", "same", "total")))


def quality(docs: DataFrame, labels: DataFrame | None, **model: int) -> DataFrame:
    """doc_id and the measures of every row of docs."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return measured(src, ratios(src, labels, **model)).select("doc_id", *MEASURES)


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    rated = measured(docs, ratios(docs, labels), prefix="__quality_")
    # a row id keeps the filter above the measures; pushed down it would have them evaluated anew within one another
    rated = rated.withColumn("__quality_row", F.monotonically_increasing_id())
    return rated.where("`__quality_kept` AND `__quality_row` >= 0").select(*(F.col(f"`{c}`") for c in docs.columns))
