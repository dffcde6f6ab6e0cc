"""Histories: sessions, thinning, differences and who changed what last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.keeping import kept

#: A session goes on over pauses of up to twenty minutes.
PAUSE = 20 * 60


def sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, user: str | None = None, pause: int = PAUSE) -> DataFrame:
    """Adds session, numbered from 1 within the keys: a longer pause ends one, and so does another user's row."""
    over = Window.partitionBy(*keys).orderBy(*order)
    waited = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(over).cast("timestamp"))
    starts = waited.isNull() | (waited > pause * 1_000_000)
    if user:
        starts |= ~F.col(user).eqNullSafe(F.lag(user).over(over))
    return rows.withColumn("__s", starts.cast("long")).withColumn("session", F.sum("__s").over(over)).drop("__s")


def thin(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, user: str, kept: Column, unit: str = "hour") -> DataFrame:
    """Merges consecutive rows of one user and one slot of time, never across a kept one: first, last, n of each."""
    over = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__slot", F.date_trunc(unit, F.col(at))).withColumn("__kept", kept)
    starts = ~(F.col(user).eqNullSafe(F.lag(user).over(over)) & F.col("__slot").eqNullSafe(F.lag("__slot").over(over))) | F.coalesce(F.lag("__kept").over(over), F.lit(True))
    grouped = rows.withColumn("__g", starts.cast("long")).withColumn("part", F.sum("__g").over(over))
    return grouped.groupBy(*keys, "part").agg(F.min(order[0]).alias("first_id"), F.max(order[0]).alias("last_id"), F.count("*").alias("n"))


def parents(rows: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    return rows.withColumn("parent_id", F.lag(id_col).over(Window.partitionBy(*keys).orderBy(*order)))


def diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed) and the fields that differ, joined in order; equal rows are left out."""
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    differing = F.concat_ws(",", *(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differing != "", "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change", F.when(F.col("change") == "changed", differing).otherwise("").alias("fields"))


def last_author(rows: DataFrame, item: str, user: str, order: Sequence[str]) -> DataFrame:
    return rows.groupBy(item).agg(F.max_by(user, F.struct(*order)).alias("last_author"))


def later_touching(rows: DataFrame, item: str, order: Column) -> DataFrame:
    """For each row how many later rows touch the same item."""
    later = Window.partitionBy(item).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n_later", F.count("*").over(later))


def fast_forward(changes: DataFrame, parents_of: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether the local head is among the ancestors of the incoming head, by joining parents level by level.

    changes: id; parents_of: id, parent; heads: doc, local, incoming. Rounds go on until no
    ancestor is new; what a round finds is checkpointed.
    """
    found = ancestors(heads.select("doc", F.col("incoming").alias("id")), parents_of)
    return heads.join(found.withColumnRenamed("id", "local").withColumn("fast", F.lit(True)), ["doc", "local"], "left").withColumn("fast", F.coalesce("fast", F.lit(False)))


def thin_by_age(rows: DataFrame, keys: Sequence[str], order: str, at: str, user: str, kept_row: Column, now: str, hourly_after_s: int, daily_after_s: int) -> DataFrame:
    """Merges consecutive rows of one user within an hour, or a day once they are older; newer rows stay by themselves, and nothing is merged across a kept one.

    keys, first_id, last_id, n, slot of each row that is left.
    """
    over = Window.partitionBy(*keys).orderBy(order)
    age = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col(at).cast("timestamp"))
    unit = F.when(age > daily_after_s * 1_000_000, "day").when(age > hourly_after_s * 1_000_000, "hour").otherwise("none")
    slot = F.when(unit == "day", F.date_format(at, "yyyy-MM-dd")).when(unit == "hour", F.date_format(at, "yyyy-MM-dd'T'HH")).otherwise(F.concat(F.lit("one "), F.col(order).cast("string")))
    marked = rows.withColumn("__slot", F.concat_ws("|", F.col(user).cast("string"), unit, slot)).withColumn("__kept", kept_row)
    starts = ~F.col("__slot").eqNullSafe(F.lag("__slot").over(over)) | F.coalesce(F.lag("__kept").over(over), F.lit(True))
    grouped = marked.withColumn("__g", starts.cast("long")).withColumn("__part", F.sum("__g").over(over))
    return grouped.groupBy(*keys, "__part").agg(F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.count("*").alias("n"), F.first("__slot").alias("slot")).drop("__part")


def moved_items(before: DataFrame, after: DataFrame, doc: str, item: str, pos: str) -> DataFrame:
    """doc, item (as text) of the items in both states that stand elsewhere: those outside the longest common order. Documents with one order in both are left out first."""
    from .order import moved

    both = before.select(doc, item, F.col(pos).alias("a")).join(after.select(doc, item, F.col(pos).alias("b")), [doc, item])
    over = Window.partitionBy(doc).orderBy("a")
    turned = both.withColumn("__t", F.col("b") < F.lag("b").over(over)).groupBy(doc).agg(F.max("__t").alias("t")).where("t").select(doc)
    lists = both.join(turned, doc, "left_semi").groupBy(doc).agg(*(F.transform(F.array_sort(F.collect_list(F.struct(c, item))), lambda x: x[item].cast("string")).alias(c) for c in ("a", "b")))
    return lists.select(doc, F.explode(moved("a", "b")).alias(item))


def to_review(changes: DataFrame, positions: DataFrame, accepted: DataFrame, doc: str, version: str, person: str) -> DataFrame:
    """person, doc, version of the changes after a person's position that they have not accepted one by one; their own don't count."""
    later = changes.join(positions, doc).where((F.col(version) > F.col("position")) & ~F.col("author").eqNullSafe(F.col(person)))
    return later.join(accepted, [person, doc, version], "left_anti").select(person, doc, version)


def published(snapshots: DataFrame, changes: DataFrame, doc: str, version: str) -> DataFrame:
    """doc, number, version, n_changes of each published snapshot: numbered in order, with the changes since the one before."""
    over = Window.partitionBy(doc).orderBy(version)
    numbered = snapshots.select(doc, version).withColumn("number", F.row_number().over(over).cast("long"))
    ends = numbered.select(doc, F.col(version).alias("__end"), "number")
    # each change belongs to the first snapshot at or after it
    tagged = ends.select(doc, F.col("__end").alias("__at"), F.lit(0).alias("__c"), "__end").unionByName(changes.select(doc, F.col(version).alias("__at"), F.lit(1).alias("__c"), F.lit(None).cast(changes.schema[version].dataType).alias("__end")))
    following = Window.partitionBy(doc).orderBy(F.desc("__at"), F.asc("__c"))
    counted = tagged.withColumn("__end", F.last("__end", ignorenulls=True).over(following)).where("__c = 1 AND __end IS NOT NULL").groupBy(doc, "__end").agg(F.count("*").alias("n_changes"))
    return ends.join(counted, [doc, "__end"], "left").select(doc, "number", F.col("__end").alias(version), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


def index_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, action: the rows of a derived index to write (new or other by hash) and to drop; equal rows are left alone."""
    a = old.select(*keys, F.xxhash64(*values).alias("h_old"))
    b = new.select(*keys, F.xxhash64(*values).alias("h_new"))
    both = a.join(b, list(keys), "full_outer").where(~F.col("h_old").eqNullSafe(F.col("h_new")))
    return both.select(*keys, F.when(F.col("h_new").isNull(), "drop").otherwise("write").alias("action"))


def reconciled(heads: DataFrame, changes: DataFrame, local_from: DataFrame, incoming_from: DataFrame) -> DataFrame:
    """doc, outcome: nothing, fast-forward, keep, merge or conflict.

    heads: doc, local, incoming (changes' ids). local_from and incoming_from: doc, id of all that each
    head comes from, itself too (as ancestors() gives it). changes: id, item (what a change touches).
    Two histories conflict where both touched an item that the other side had not seen.
    """
    new_there = incoming_from.join(local_from, ["doc", "id"], "left_anti")
    new_here = local_from.join(incoming_from, ["doc", "id"], "left_anti")
    touched = [side.join(changes, "id").select("doc", "item").distinct() for side in (new_here, new_there)]
    clash = touched[0].join(touched[1], ["doc", "item"]).groupBy("doc").agg(F.count("*").alias("n_clash"))
    n_here, n_there = new_here.groupBy("doc").agg(F.count("*").alias("n_here")), new_there.groupBy("doc").agg(F.count("*").alias("n_there"))
    found = heads.join(n_here, "doc", "left").join(n_there, "doc", "left").join(clash, "doc", "left")
    outcome = F.when(F.col("n_there").isNull(), F.when(F.col("n_here").isNull(), "nothing").otherwise("keep")).when(F.col("n_here").isNull(), "fast-forward").when(F.col("n_clash").isNull(), "merge").otherwise("conflict")
    return found.select("doc", outcome.alias("outcome"), F.coalesce("n_clash", F.lit(0)).alias("n_clash"))


def ancestors(heads: DataFrame, parents_of: DataFrame) -> DataFrame:
    """doc, id of all that each head (doc, id) comes from, itself too; rounds go on until none is new, each checkpointed."""
    frontier = kept(heads.select("doc", "id").distinct())
    found = frontier
    while not frontier.isEmpty():
        above = frontier.join(parents_of, "id").select("doc", F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
        frontier = kept(above.join(found, ["doc", "id"], "left_anti"))
        found = kept(found.unionByName(frontier))
    return found
