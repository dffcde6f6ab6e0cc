"""Comparing the order in which two texts have the same segments."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.keeping import kept


def kept_in_order(base: list[str], own: list[str]) -> list[str]:
    """The longest list of ids that both have in the same order, of several the one earliest in own; each id once."""
    at = {x: i for i, x in enumerate(base)}
    common = [x for x in own if x in at]
    # from the right: how long an ascending list can begin with each id; heads[k] is the largest place that begins one of k + 1
    heads: list[int] = []
    reach = []
    for x in reversed(common):
        k = bisect_left(heads, -at[x])
        heads[k : k + 1] = [-at[x]]
        reach.append(k + 1)
    out, want, place = [], len(heads), -1
    for x, n in zip(common, reversed(reach), strict=True):
        if n == want and at[x] > place:
            out.append(x)
            want, place = want - 1, at[x]
    return out


def blocks(base: list[str], own: list[str]) -> list[tuple[list[str], str | None, str | None]]:
    """The fewest block moves from one order to the other, over what both have: ids moved together, what they follow in own and in base."""
    shared = set(base) & set(own)
    first, second = [x for x in base if x in shared], [x for x in own if x in shared]
    stay, at, out = set(kept_in_order(first, second)), {x: i for i, x in enumerate(first)}, []
    for i, x in enumerate(second):
        if x in stay:
            continue
        if i and second[i - 1] not in stay:
            out[-1][0].append(x)
        else:
            out.append(([x], second[i - 1] if i else None, first[at[x] - 1] if at[x] else None))
    return out


def statements(base: Column | str, own: Column | str) -> Column:
    """blocks() of two arrays of distinct ids."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"moved": m, "after": x, "after_in_base": y} for m, x, y in blocks(list(p), list(q))] for p, q in zip(a, b, strict=True)])

    return F.pandas_udf(run, "array<struct<moved:array<string>,after:string,after_in_base:string>>")(base, own)


def moved(base: Column | str, own: Column | str) -> Column:
    """Of two arrays of ids those that own has elsewhere in the order: what is left after the longest common order."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            kept, had = set(kept_in_order(list(x), list(y))), set(x)
            out.append([i for i in y if i in had and i not in kept])
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(base, own)


def _variant_rows(base: DataFrame, orders: DataFrame, far: int) -> DataFrame:
    """grp, at, far, segments, reading, after (positions in the edition), is_base, text, n: one row for each variant and order that has a reading there."""
    # texts with one order are one from here on
    alike = orders.groupBy("grp", "own").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    places = base.select("grp", F.posexplode("base").alias("pos", "segment"))
    has = kept(alike.select("grp", "text", "n", F.posexplode("own").alias("place", "segment")).join(places, ["grp", "segment"]).select("grp", "text", "n", "pos", "place"))
    own = has.groupBy("grp", "text", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pos"))), lambda x: x["pos"]).alias("own"))
    other = own.withColumn("base", F.array_sort("own")).where("own != base").withColumn("s", F.explode(statements(F.col("base").cast("array<string>"), F.col("own").cast("array<string>"))))
    said = other.select("grp", "text", "n", F.col("s.moved").cast("array<int>").alias("moved"), F.col("s.after").cast("int").alias("after"))
    point = F.coalesce(F.col("after") + 1, F.lit(0))
    said = kept(said.withColumns({"lo": F.least(F.array_min("moved"), point), "hi": F.greatest(F.array_max("moved"), point - 1), "block": F.array_sort("moved")}))

    # a block that one text has far from its place is given by what it follows, for all texts
    blocks_far = kept(said.where(F.col("hi") - F.col("lo") + 1 > far).select("grp", "block").distinct())
    near, away = said.join(blocks_far, ["grp", "block"], "left_anti"), said.join(blocks_far, ["grp", "block"], "left_semi")
    carried = away.select("grp", "text", F.explode("moved").alias("pos"))

    # stretches that overlap are one: a new one begins beyond all ends so far
    run = Window.partitionBy("grp").orderBy("lo", "hi")
    ends = F.max("hi").over(run.rowsBetween(Window.unboundedPreceding, -1))
    spans = near.select("grp", "lo", "hi").distinct().withColumn("__new", F.coalesce(F.col("lo") > ends, F.lit(True)).cast("int")).withColumn("__k", F.sum("__new").over(run))
    stretches = kept(spans.groupBy("grp", "__k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__k"))
    cells = stretches.withColumn("pos", F.explode(F.sequence("lo", "hi")))
    inside = has.join(carried, ["grp", "text", "pos"], "left_anti").join(cells, ["grp", "pos"])
    read = inside.groupBy("grp", "lo", "hi", "text", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pos"))), lambda x: x["pos"]).alias("reading")).where(F.size("reading") > 1)
    read = kept(read.withColumn("is_base", F.col("reading") == F.array_sort("reading")))
    nothing = F.lit(None).cast("int")
    whole = F.sequence("lo", "hi")
    varying = read.where("NOT is_base").select("grp", "lo", "hi").distinct()
    texts = read.join(varying, ["grp", "lo", "hi"], "left_semi")
    columns = ["grp", "at", "far", "segments", "reading", "after", "is_base", "text", "n"]
    stood = texts.select("grp", F.col("lo").alias("at"), F.lit(False).alias("far"), whole.alias("segments"), F.when(F.col("is_base"), whole).otherwise(F.col("reading")).alias("reading"), nothing.alias("after"), "is_base", "text", "n")
    edition = varying.select("grp", F.col("lo").alias("at"), F.lit(False).alias("far"), whole.alias("segments"), whole.alias("reading"), nothing.alias("after"), F.lit(True).alias("is_base"), F.lit(None).cast(orders.schema["text"].dataType).alias("text"), F.lit(0).cast("long").alias("n"))

    first = F.get("block", F.lit(0))
    follows = F.when(first > 0, first - 1)
    of_block = [first.alias("at"), F.lit(True).alias("far"), F.col("block").alias("segments")]
    moved_there = away.select("grp", *of_block, F.col("moved").alias("reading"), "after", F.lit(False).alias("is_base"), "text", "n")
    # with the edition are texts that have some of the block and move none of it
    in_block = blocks_far.withColumn("pos", F.explode("block"))
    movers = said.select("grp", "text", F.explode("moved").alias("pos")).join(in_block, ["grp", "pos"]).select("grp", "block", "text").distinct()
    keepers = has.join(in_block, ["grp", "pos"]).select("grp", "block", "text", "n").distinct().join(movers, ["grp", "block", "text"], "left_anti")
    kept_there = keepers.select("grp", *of_block, F.col("block").alias("reading"), follows.alias("after"), F.lit(True).alias("is_base"), "text", "n")
    edition_far = blocks_far.select("grp", *of_block, F.col("block").alias("reading"), follows.alias("after"), F.lit(True).alias("is_base"), F.lit(None).cast(orders.schema["text"].dataType).alias("text"), F.lit(0).cast("long").alias("n"))
    rows = stood.select(columns)
    for part in (edition, moved_there, kept_there, edition_far):
        rows = rows.unionByName(part.select(columns))
    return rows


def order_variants(base: DataFrame, orders: DataFrame, far: int = 8) -> DataFrame:
    """grp, place, far, segments, reading, after, is_base, text, n_texts: where texts have the edition's segments in another order.

    base: grp, base (array of the edition's segment ids, each once); orders: grp, text, own (array,
    each once). A block that stands elsewhere concerns the shortest stretch of the edition with the
    block and its place; stretches that overlap are one variant, read by each text in the order of
    those of its segments that it has (fewer than two: it is not there). A stretch of over far
    segments is given as the block and what it follows (after, null: it opens the text) instead. place is
    the variant's in the edition, text the smallest id of the n_texts with the reading; the
    edition's own reading is there even where no text has it.
    """
    rows = _variant_rows(base, orders, far).groupBy("grp", "at", "far", "segments", "reading", "after", "is_base").agg(F.min("text").alias("text"), F.sum("n").alias("n_texts"))

    def named(c: str) -> Column:
        return F.transform(c, lambda k: F.get("base", k)).alias(c)

    return rows.join(base.select("grp", "base"), "grp").select("grp", F.col("at").cast("long").alias("place"), "far", named("segments"), named("reading"), F.get("base", F.col("after")).alias("after"), "is_base", "text", "n_texts")
