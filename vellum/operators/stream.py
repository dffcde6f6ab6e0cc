"""Ordered streams: words, runs, lines and what is counted over them.

Every operator takes the columns of its order and its partition, so one shuffle
by document serves all windows of a stream.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_plain, folded


def ordered(keys: Sequence[str], order: Sequence[str]):  # noqa: ANN201
    return Window.partitionBy(*keys).orderBy(*order)


def from_text(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of plain text: doc, line (from 0), pos in line, form. White space parts words, \\n lines; \\r\\n counts as \\n."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    lines = docs.select(doc, F.posexplode(F.split(clean, "\n", -1)).alias("line", "text"))
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    return lines.select(doc, F.col("line").cast("long").alias("line"), F.posexplode(words).alias("pos", "form")).withColumn("pos", F.col("pos").cast("long"))


def to_text(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The plain text of tokens: words joined by spaces, lines by \\n; empty lines are gone."""
    lines = tokens.groupBy(doc, "line").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("w"))
    joined = lines.select(doc, "line", F.array_join(F.transform("w", lambda w: w["form"]), " ").alias("t"))
    return joined.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def words(items: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds word, the number of the word each token is part of: a token goes on with the word before it that joins on.

    Breaks between joined tokens are passed over; an object ends the word. items
    has kind (token, break, object), join_next and form.
    """
    over = ordered([doc], [pos])
    real = items.where("kind != 'break'")
    joined = F.lag(F.when((F.col("kind") == "token") & F.col("join_next"), F.lit(True)).otherwise(F.lit(False))).over(over)
    starts = real.withColumn("starts", F.when((F.col("kind") == "token") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0))
    return starts.withColumn("word", F.sum("starts").over(over).cast("long")).where("kind = 'token'").drop("starts")


def segment_runs(items: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds run and the segment in force: an item belongs to the start before it; has_start tells a start without a segment from none."""
    over = ordered([doc], [pos])
    run = F.sum(F.col("has_start").cast("int")).over(over)
    segment = F.last(F.when(F.col("has_start"), F.struct("seg_id", "seg_part")), ignorenulls=True).over(over)
    return items.withColumn("run", run.cast("long")).withColumn("segment", segment)


def languages_of(tokens: DataFrame, keys: Sequence[str], lang: str, order: str) -> DataFrame:
    """Languages of each key by how many tokens have them, ties by the first met: rank, lang, n."""
    counts = tokens.where(F.col(lang).isNotNull()).groupBy(*keys, lang).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at"))
    return counts.withColumn("rank", rank.cast("long"))


def islands(rows: DataFrame, keys: Sequence[str], at: Column, step: int = 1) -> DataFrame:
    """Maximal runs of consecutive values of at within each key: first, last, n."""
    over = Window.partitionBy(*keys).orderBy("at")
    marked = rows.select(*keys, at.alias("at")).distinct()
    marked = marked.withColumn("starts", (F.coalesce(F.col("at") - F.lag("at").over(over), F.lit(step + 1)) > step).cast("int"))
    numbered = marked.withColumn("island", F.sum("starts").over(over))
    return numbered.groupBy(*keys, "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("island")


def gaps(rows: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """What lies between values of at that are not consecutive: after, before, lost."""
    over = Window.partitionBy(*keys).orderBy("at")
    marked = rows.select(*keys, at.alias("at")).distinct().withColumn("after", F.lag("at").over(over))
    return marked.where("at - after > 1").select(*keys, "after", F.col("at").alias("before"), (F.col("at") - F.col("after") - 1).alias("lost"))


def coverage(rows: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """First and last value of each key, how many it has and how many between are lost."""
    own = rows.select(*keys, at.alias("at")).distinct().groupBy(*keys).agg(F.min("at").alias("first_key"), F.max("at").alias("last_key"), F.count("*").alias("n_keys"))
    return own.withColumn("n_lost", F.col("last_key") - F.col("first_key") + 1 - F.col("n_keys"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, *, strict: bool = False) -> DataFrame:
    """left with the value of right's last row at or before (strict: before) each row, by one pass over their union."""
    a = left.withColumns({"__at": F.col(left_at), "__side": F.lit(0 if strict else 1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.col(value).alias("__v"), F.lit(True).alias("__right"))
    both = a.withColumn("__right", F.lit(False)).unionByName(b, allowMissingColumns=True)
    over = Window.partitionBy(*keys).orderBy("__at", "__side")
    found = F.last(F.when(F.col("__right"), F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(over)
    return both.withColumn(value, found["v"]).where("NOT __right").drop("__at", "__side", "__v", "__right")


def before_in_order(rows: DataFrame, cell: str, value: str, width: int = 4096) -> DataFrame:
    """cell, earlier: the last value of the cells before each (numbers, each once; null: none there).

    Cells are taken in stretches of width; only the stretches' last values, one in width of the cells, are carried on in one order.
    """
    wide = rows.withColumn("__s", F.floor(F.col(cell) / width))
    inside = Window.partitionBy("__s").orderBy(cell)
    own = wide.withColumn("__in", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = wide.groupBy("__s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(cell))).alias("__end"))
    carried = ends.withColumn("__out", F.last("__end", ignorenulls=True).over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))).select("__s", "__out")
    return own.join(carried, "__s").select(cell, F.coalesce("__in", "__out").alias("earlier"))


def dedupe_consecutive(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Drops a row whose value is that of the row before it."""
    before = F.lag(F.struct(value)).over(ordered(keys, order))
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | ~F.col("__b")[value].eqNullSafe(F.col(value))).drop("__b")


def phrase_hits(tokens: DataFrame, phrase: Sequence[str], keys: Sequence[str], order: Sequence[str], word: str) -> DataFrame:
    """Rows at which the words of a phrase stand one after the other."""
    over = ordered(keys, order)
    names = [f"__w{k}" for k in range(1, len(phrase))]
    ahead = tokens.withColumns({n: F.lead(word, k).over(over) for k, n in enumerate(names, 1)})
    match = F.col(word) == phrase[0]
    for n, w in zip(names, phrase[1:], strict=True):
        match &= F.col(n) == w
    return ahead.where(match).drop(*names)


def search(docs: DataFrame, phrase: Sequence[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line, pos of the places where folded words of a document are those of the phrase, over line ends too.

    The phrase is folded as the text is; words that fold to nothing are left out of it,
    and a phrase without any finds nothing.

    A document is folded once as a whole; only one that holds the phrase's words
    one after the other is taken apart into words.
    """
    phrase = [w for x in phrase for w in folded(x).split()]
    if not phrase:
        return from_text(docs.limit(0), doc, text)
    run = r"(?U)(^|\s)" + r"\s+".join(map(re.escape, phrase)) + r"(\s|$)"
    # punctuation between spaces leaves an empty word, which parts the words beside it
    whole = docs.where(F.concat(F.lit(" "), fold_plain(F.coalesce(F.col(text), F.lit("")))).rlike(run))
    words = from_text(whole, doc, text).withColumn("__w", fold_plain("form"))
    return phrase_hits(words, phrase, [doc], ["line", "pos"], "__w").drop("__w")


def band_links(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, reach: int, *, cell: str = "__cell") -> DataFrame:
    """Pairs of rows with equal keys whose positions are at most reach apart: an equi-join on cells, not a range scan.

    Columns of the sides other than keys and at must differ.
    """
    a = left.withColumn(cell, F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / reach) + d)))
    b = right.withColumn(cell, F.floor(F.col(at) / reach)).withColumnRenamed(at, f"{at}_b")
    return a.join(b, [*keys, cell]).where(F.abs(F.col(at) - F.col(f"{at}_b")) <= reach).drop(cell)


def out_of_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str) -> DataFrame:
    """Rows whose rank is below that of the row before."""
    return rows.withColumn("previous", F.lag(rank).over(ordered(keys, order))).where(F.col(rank) < F.col("previous"))
