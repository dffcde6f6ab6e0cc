"""Relational operators of the catalogue: grants, searches, tallies, lookups, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import letter_suffix


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of parts of one schema with the name of each as kind."""
    return reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(k)) for k, df in parts.items()))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value of each key's last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def escaped(pattern: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in pattern)


def search(rows: DataFrame, text: str, columns: Sequence[str], order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows with text in any of the columns, whatever its case; order must be total."""
    hit = reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{escaped(text)}%") for c in columns))
    return rows.where(hit).orderBy(*order).offset(offset).limit(limit)


def disambiguated(rows: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Labels that repeat get a, b, ..., z, aa, ... in order."""
    n = F.count("*").over(Window.partitionBy(label))
    nth = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("shown", F.when(n > 1, F.concat(F.col(label), letter_suffix(nth))).otherwise(F.col(label)))


def fallback_lookup(asked: DataFrame, entries: DataFrame, key: str, loose: str, value: str) -> DataFrame:
    """value by exact key, else by loose key; asked and entries have both keys, the least value counts."""
    exact = entries.groupBy(key).agg(F.min(value).alias("__exact"))
    near = entries.groupBy(loose).agg(F.min(value).alias("__loose"))
    found = asked.join(exact, key, "left").join(near, loose, "left")
    return found.withColumn(value, F.coalesce("__exact", "__loose")).withColumn("how", F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "loose").otherwise("none")).drop("__exact", "__loose")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], *, greatest: str | None = None, order: Sequence[str] = (), nothing: bool = False) -> DataFrame:
    """table with changes in place of rows of the same key, of several changes the last by order.

    greatest: the larger value of that column stays. nothing: rows that are there stay as they are.
    """
    if greatest:
        both = table.unionByName(changes)
        return both.groupBy(*keys).agg(F.max(greatest).alias(greatest))
    columns = changes.columns
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*(order or columns))).alias("__r")).select("__r.*") if columns else changes
    if nothing:
        return table.unionByName(last.join(table.select(*keys), list(keys), "left_anti"))
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(last)


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """column with old ids replaced by new ones; mapping has old and new, each old once."""
    return rows.join(mapping, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", F.col(column))).drop("old", "new")


def alias_chains(merges: DataFrame, hops: int = 20) -> DataFrame:
    """old, new: where each merged id stands after hops merges at most; a chain that comes back to itself stands where the hops end.

    merges has each old once. The powers of the step are composed as hops' binary digits say, so the joins are few.
    """
    power = merges.select("old", "new")
    at = merges.select("old", F.col("old").alias("new"))

    def after(first: DataFrame, then: DataFrame) -> DataFrame:
        ahead = then.select(F.col("old").alias("new"), F.col("new").alias("further"))
        return first.join(ahead, "new", "left").select("old", F.coalesce("further", "new").alias("new"))

    while hops:
        if hops % 2:
            at = after(at, power)
        hops //= 2
        if hops:
            power = after(power, power)
    return at


def unique_slugs(rows: DataFrame, slug: str, order: Sequence[str]) -> DataFrame:
    """A slug that is taken gets -2, -3, ... in order."""
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return rows.withColumn("__n", nth).withColumn(slug, F.when(F.col("__n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("__n").cast("string")))).drop("__n")


def top_merge(parts: dict[str, DataFrame], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of all parts together; each part gives its own first k only."""
    own = {kind: df.orderBy(*order).limit(k) for kind, df in parts.items()}
    return tagged_union(own).orderBy(*order, "kind").limit(k)


def two_source_tally(a: DataFrame, b: DataFrame, key: str, at: str, member: str) -> DataFrame:
    """key, n_a, n_b, members (different ones in either), last_at: two sources counted apart, joined by key with what one lacks as none."""
    one = a.groupBy(key).agg(F.count("*").alias("n_a"), F.max(at).alias("at_a"))
    two = b.groupBy(key).agg(F.count("*").alias("n_b"), F.max(at).alias("at_b"))
    both = a.select(key, member).union(b.select(key, member)).groupBy(key).agg(F.countDistinct(member).alias("members"))
    joined = both.join(one, key, "left").join(two, key, "left")
    return joined.select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "members", F.greatest("at_a", "at_b").alias("last_at"))


def merge_preview(source: DataFrame, target: DataFrame, used: DataFrame, key: str, id_col: str) -> DataFrame:
    """id, state of each record of source: matched (target has its key), blocked (its key is null, or stands twice in target), moved (target lacks it); and whether something uses it."""
    there = target.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.min(id_col).alias("into"))
    state = F.when(F.col(key).isNull() | (F.col("__n") > 1), "blocked").when(F.col("__n") == 1, "matched").otherwise("moved")
    uses = used.select(F.col(id_col).alias("__u")).distinct()
    found = source.join(there, key, "left").join(uses, F.col(id_col) == F.col("__u"), "left").withColumn("state", state)
    return found.select(id_col, key, "state", F.when(F.col("state") == "matched", F.col("into")).alias("into"), F.col("__u").isNotNull().alias("used"))


def dependents(record: DataFrame, id_col: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """id and for each kind of child how many rows name it, counted before a delete; free where there is none."""
    out = record.select(id_col)
    for name, (rows, column) in children.items():
        counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(id_col)).agg(F.count("*").alias(name))
        out = out.join(counts, id_col, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("free", sum((F.col(n) for n in children), F.lit(0)) == 0)


def delete_using(rows: DataFrame, mapping: DataFrame, column: str, rest: Sequence[str]) -> DataFrame:
    """rows without those whose column is to be remapped onto a key that is there already (column's new value, and rest alike)."""
    taken = rows.select(F.col(column).alias("new"), *rest).distinct()
    clashing = rows.join(mapping, F.col(column) == F.col("old")).join(taken, ["new", *rest], "left_semi").select(column, *rest).distinct()
    return rows.join(clashing, [column, *rest], "left_anti")


def taken(queue: DataFrame, due: Column) -> tuple[DataFrame, DataFrame]:
    """What a worker takes from a queue, and what stays."""
    return queue.where(due), queue.where(~F.coalesce(due, F.lit(False)))


def visible(records: DataFrame, grants: DataFrame, user: str, record: str, owner: str, public: Column) -> DataFrame:
    """record, user, right of all that a user may see: own, shared by a grant, or public; the strongest right once.

    Rights by ownership and by grant come from joins on keys; a public record has one row without a user.
    """
    own = records.where(F.col(owner).isNotNull()).select(record, F.col(owner).alias(user), F.lit(2).alias("__r"))
    given = grants.join(records.select(record), record).select(record, user, F.lit(1).alias("__r"))
    open_ = records.where(public).select(record, F.lit(None).cast(records.schema[owner].dataType).alias(user), F.lit(0).alias("__r"))
    best = own.union(given).union(open_).groupBy(record, user).agg(F.max("__r").alias("__r"))
    return best.select(record, user, F.when(F.col("__r") == 2, "own").when(F.col("__r") == 1, "shared").otherwise("public").alias("right"))


def ranked_lookup(asked: DataFrame, entries: DataFrame, key: str, value: str, rank: Column, limit: int = 12) -> DataFrame:
    """asked with each entry of its key once, better ranks first, at most limit of them: adds value and nth."""
    found = entries.groupBy(key, value).agg(F.min(rank).alias("__rank"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("__rank", value))
    best = found.withColumn("nth", nth.cast("long")).where(F.col("nth") <= limit)
    return asked.join(best.drop("__rank"), key)


def resolved(asked: DataFrame, known: DataFrame, merges: DataFrame, identifiers: DataFrame) -> DataFrame:
    """asked (ask, id, identifier) with the record it means: by its id, else by its chain of merges, else by a canonical identifier; how tells which.

    known: id; merges: old, new; identifiers: identifier, id (the least id of an identifier counts).
    """
    ends = alias_chains(merges).join(known.select(F.col("id").alias("new")), "new", "left_semi").select(F.col("old").alias("id"), F.col("new").alias("__merged"))
    by_name = identifiers.groupBy("identifier").agg(F.min("id").alias("__named"))
    rows = asked.join(known.select("id", F.col("id").alias("__own")), "id", "left").join(ends, "id", "left").join(by_name, "identifier", "left")
    how = F.when(F.col("__own").isNotNull(), "id").when(F.col("__merged").isNotNull(), "merge").when(F.col("__named").isNotNull(), "identifier").otherwise("none")
    return rows.select("ask", F.coalesce("__own", "__merged", "__named").alias("record"), how.alias("how"))


def sync_report(here: DataFrame, there: DataFrame, key: str, head: str) -> DataFrame:
    """key, state: same, differs, only-here, only-there."""
    a, b = here.select(key, F.col(head).alias("a")), there.select(key, F.col(head).alias("b"))
    state = F.when(F.col("a").isNull(), "only-there").when(F.col("b").isNull(), "only-here").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def conditional_counts(rows: DataFrame, keys: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
