"""The operators applied to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..operators import collate, history, order, passages, registry, stream
from ..streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = r"""
lines AS (SELECT doc_id, lang, source, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS t FROM (
  SELECT doc_id, lang, source, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents)),
tokens AS (SELECT doc_id, lang, source, line, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS form FROM (
  SELECT doc_id, lang, source, line, [x for x in regexp_split_to_array(t, '\s+') if x <> ''] AS w FROM lines))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.from_text(table(spark, sf_dir, "documents"))


@query(f"WITH {TOKENS} SELECT doc_id, line, pos, form FROM tokens")
def tokenize_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return tokens(spark, sf_dir)


@query(f"WITH {TOKENS} SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT doc_id, line, string_agg(form, ' ' ORDER BY pos) AS t FROM tokens GROUP BY doc_id, line) GROUP BY doc_id")
def text_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    return stream.to_text(tokens(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT fold, count(*)::BIGINT AS n, count(DISTINCT form) AS forms FROM (SELECT form, lower(regexp_replace(form, '[\\pP\\pS]', '', 'g')) AS fold FROM tokens) GROUP BY fold")
def fold_words(spark, sf_dir):  # noqa: ANN001, ANN201
    forms = tokens(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n"))
    return forms.groupBy(fx.fold_plain("form").alias("fold")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query(f"WITH {TOKENS} SELECT bare, sum(n)::BIGINT AS n FROM (SELECT strip_accents(form) AS bare, n FROM (SELECT form, count(*) AS n FROM tokens GROUP BY form)) GROUP BY bare")
def strip_diacritics(spark, sf_dir):  # noqa: ANN001, ANN201
    forms = tokens(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n"))
    return forms.select(fx.strip_diacritics("form").alias("bare"), "n").groupBy("bare").agg(F.sum("n").alias("n"))


@query(f"""WITH {TOKENS} SELECT CASE WHEN t = '' THEN form ELSE t END AS trimmed, sum(n)::BIGINT AS n FROM (
SELECT form, n, trim(regexp_replace(form, '^[-,.;:!?·…–—()«»“”"\\[\\]]+|[-,.;:!?·…–—()«»“”"\\[\\]]+$', '', 'g')) AS t FROM (SELECT form || CASE WHEN length(form) % 5 = 0 THEN '’.' ELSE '' END AS form, count(*) AS n FROM tokens GROUP BY 1)) GROUP BY 1""")
def trim_punctuation(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every fifth length of word is elided here: its mark stays."""
    elided = F.concat("form", F.when(F.length("form") % 5 == 0, "’.").otherwise(""))
    forms = tokens(spark, sf_dir).groupBy(elided.alias("form")).agg(F.count("*").alias("n"))
    return forms.groupBy(fx.trim_punctuation("form").alias("trimmed")).agg(F.sum("n").alias("n"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first_at FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)
SELECT source, lang, n, first_at, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_at) AS rank FROM c""")
def languages_of(spark, sf_dir):  # noqa: ANN001, ANN201
    return stream.languages_of(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)
SELECT source, arg_max(lang, n * 1000000000 - f) AS main_language FROM c GROUP BY source""")
def main_language(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("f"))).alias("main_language"))


@query("""
SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_copies(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
SELECT p.p_partkey, string_agg(DISTINCT l.l_suppkey::VARCHAR, ',' ORDER BY l.l_suppkey::VARCHAR) AS suppliers, count(DISTINCT l.l_suppkey) AS n
FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey""")
def coverage_matrix(spark, sf_dir):  # noqa: ANN001, ANN201
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    sets = pairs.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.col("l_suppkey").cast("string"))).alias("s"))
    joined = table(spark, sf_dir, "part").join(sets, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.array_join("s", ",").alias("suppliers"), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query("""
WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS "at" FROM orders)
SELECT o_custkey, min("at") AS first_key, max("at") AS last_key, count(*) AS n_keys, max("at") - min("at") + 1 - count(*) AS n_lost FROM d GROUP BY o_custkey""")
def coverage_span_lost(spark, sf_dir):  # noqa: ANN001, ANN201
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return stream.coverage(table(spark, sf_dir, "orders"), ["o_custkey"], day)


@query("""
WITH have AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'),
lack AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM have) AND l_orderkey > (SELECT min(o_orderkey) FROM have) AND l_orderkey < (SELECT max(o_orderkey) FROM have))
SELECT l_orderkey, (o_orderkey) AS after_key FROM lack ASOF JOIN have ON l_orderkey > o_orderkey""")
def unprinted_asof(spark, sf_dir):  # noqa: ANN001, ANN201
    printed = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select("o_orderkey")
    span = printed.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    lacking = keys.join(printed, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").join(F.broadcast(span), (F.col("l_orderkey") > F.col("low")) & (F.col("l_orderkey") < F.col("high")))
    # keys lie in cells of 4096; a row looks for its predecessor in its own cell, else in the last cell before it that has one
    cell = 4096
    have = printed.withColumn("cell", F.floor(F.col("o_orderkey") / cell)).withColumn("after_key", F.col("o_orderkey"))
    found = stream.as_of(lacking.select("l_orderkey", F.floor(F.col("l_orderkey") / cell).alias("cell")), have, ["cell"], "l_orderkey", "o_orderkey", "after_key", strict=True)
    tops = have.groupBy("cell").agg(F.max("o_orderkey").alias("top"))
    before = stream.before_in_order(tops.unionByName(found.select("cell").distinct().join(tops, "cell", "left_anti").withColumn("top", F.lit(None).cast("long"))), "cell", "top")
    return found.join(before, "cell", "left").select("l_orderkey", F.coalesce("after_key", "earlier").alias("after_key"))


@query("""
WITH d AS (SELECT DISTINCT event_type, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS "at" FROM events),
g AS (SELECT event_type, "at", lag("at") OVER (PARTITION BY event_type ORDER BY "at") AS after FROM d)
SELECT event_type, after, "at" AS before, "at" - after - 1 AS lost FROM g WHERE "at" - after > 1""")
def absent_ranges(spark, sf_dir):  # noqa: ANN001, ANN201
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return stream.gaps(table(spark, sf_dir, "events"), ["event_type"], hour)


@query("""
WITH d AS (SELECT DISTINCT event_type, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS "at" FROM events),
g AS (SELECT *, "at" - row_number() OVER (PARTITION BY event_type ORDER BY "at") AS k FROM d)
SELECT event_type, min("at") AS first, max("at") AS last, count(*) AS n FROM g GROUP BY event_type, k""")
def present_ranges(spark, sf_dir):  # noqa: ANN001, ANN201
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return stream.islands(table(spark, sf_dir, "events"), ["event_type"], hour)


SESSIONS = """
WITH s AS (SELECT *, CASE WHEN {keep} THEN 0 ELSE 1 END AS b FROM (
  SELECT *, lag(ts) OVER w AS pt, lag(user_id) OVER w AS pu FROM events WINDOW w AS (PARTITION BY {key} ORDER BY {order})))
SELECT event_id, sum(b) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s"""


@query(SESSIONS.format(keep="ts - pt <= INTERVAL 20 MINUTE", key="user_id", order="ts, event_id"))
def sessions_user(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.sessions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts").select("event_id", "session")


@query(SESSIONS.format(keep="ts - pt <= INTERVAL 20 MINUTE AND pu IS NOT DISTINCT FROM user_id", key="event_id % 997", order="event_id"))
def sessions_interleaved(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.sessions(table(spark, sf_dir, "events").withColumn("doc", F.col("event_id") % 997), ["doc"], ["event_id"], "ts", "user_id").select("event_id", "session")


@query("""
WITH s AS (SELECT event_id, user_id % 500 AS doc, event_id % 50 = 0 AS kept, user_id, date_trunc('day', ts) AS slot FROM events),
b AS (SELECT *, CASE WHEN lag(user_id) OVER w IS NOT DISTINCT FROM user_id AND lag(slot) OVER w IS NOT DISTINCT FROM slot AND NOT coalesce(lag(kept) OVER w, true) THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY doc ORDER BY event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM b)
SELECT doc, part, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM g GROUP BY doc, part""")
def thin_history(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.thin(table(spark, sf_dir, "events").withColumn("doc", F.col("user_id") % 500), ["doc"], ["event_id"], "ts", "user_id", F.col("event_id") % 50 == 0, "day")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def describe_dedupe(spark, sf_dir):  # noqa: ANN001, ANN201
    return stream.dedupe_consecutive(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS parent_id FROM events")
def changeset_parent(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.parents(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["event_id"], "event_id").select("event_id", "event_type", "parent_id")


@query(f"WITH {TOKENS} SELECT doc_id, string_agg(form || '@' || CASE WHEN form ~ '^[A-Z]' THEN 'la' ELSE lang END, ' ' ORDER BY line, pos) AS tagged FROM tokens GROUP BY doc_id")
def tag_language(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"(?U)\s+"), lambda w: w != "")
    tagged = F.transform(words, lambda w: F.concat(w, F.lit("@"), F.when(w.rlike("^[A-Z]"), F.lit("la")).otherwise(F.col("lang"))))
    return docs.select("doc_id", tagged.alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("tagged"))


@query("""
SELECT c.c_custkey, coalesce(o.first_priority, 'none') AS first_priority FROM customer c
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def first_match_default(spark, sf_dir):  # noqa: ANN001, ANN201
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    joined = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("p", F.lit("none")).alias("first_priority"))


@query("""
WITH s AS (SELECT DISTINCT o_custkey, l_partkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT a.o_custkey, count(*) AS n_conflicting, min(a.l_partkey) AS first_conflict FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.l_partkey = b.l_partkey
WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' GROUP BY a.o_custkey""")
def conflicting_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    touched = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    either = touched.groupBy("o_custkey", "l_partkey").agg(*(F.max(F.col("o_orderstatus") == x).alias(x) for x in "FO")).where("F AND O")
    return either.groupBy("o_custkey").agg(F.count("*").alias("n_conflicting"), F.min("l_partkey").alias("first_conflict"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_later FROM lineitem""")
def undo_conflicts(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.later_touching(table(spark, sf_dir, "lineitem"), "l_partkey", F.struct("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "n_later")


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE 'o_orderstatus' END AS fields
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def diff_states(spark, sf_dir):  # noqa: ANN001, ANN201
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = orders.where("o_orderkey % 5 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return history.diff(orders.where("o_orderkey % 3 != 0"), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_type, arg_max(user_id, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS last_author FROM events GROUP BY event_type")
def last_author(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.last_author(table(spark, sf_dir, "events"), "event_type", "user_id", ["ts", "event_id"])


@query("""
WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id, c.event_id AS checkpoint FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM c GROUP BY user_id, ts) c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_checkpoint(spark, sf_dir):  # noqa: ANN001, ANN201
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    points = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("checkpoint"))
    return stream.as_of(events, points, ["user_id"], "ts", "ts", "checkpoint").select("event_id", "checkpoint")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') AS has_version FROM customer")
def has_version(spark, sf_dir):  # noqa: ANN001, ANN201
    live = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("o_custkey").isNotNull().alias("has_version"))


@query("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")
def latest_version(spark, sf_dir):  # noqa: ANN001, ANN201
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


@query("""
SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier
UNION ALL SELECT 'order', o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey""")
def grants_union(spark, sf_dir):  # noqa: ANN001, ANN201
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("id")).select(F.col("o_orderkey").alias("id"), "nation")
    return registry.tagged_union({"customer": customers, "supplier": suppliers, "order": orders})


@query("SELECT s_suppkey, s_name, count(DISTINCT l_partkey) AS parts, count(l_orderkey) AS n, max(l_shipdate) AS last_at FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name")
def works_of_witness(spark, sf_dir):  # noqa: ANN001, ANN201
    tally = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.max("l_shipdate").alias("last_at"))
    joined = table(spark, sf_dir, "supplier").join(tally, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("s_suppkey", "s_name", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("n", F.lit(0)).alias("n"), "last_at")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a_1%' ESCAPE '!' OR p_brand ILIKE '%3%' ORDER BY p_name, p_partkey LIMIT 50".replace("%a_1%' ESCAPE '!'", "%a!_1%' ESCAPE '!'"))
def registry_search(spark, sf_dir):  # noqa: ANN001, ANN201
    hit = F.col("p_name").ilike("%a\\_1%") | F.col("p_brand").ilike("%3%")
    return table(spark, sf_dir, "part").where(hit).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%' ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def bibliography_page(spark, sf_dir):  # noqa: ANN001, ANN201
    return registry.search(table(spark, sf_dir, "customer"), "1", ["c_name", "c_mktsegment"], ["c_name", "c_custkey"], 20, 20).select("c_custkey", "c_name")


LOOSE = "regexp_replace(lower(p_name), '[^a-z]', '', 'g')"


@query(f"""
WITH e AS (SELECT p_name, {LOOSE} AS loose, p_partkey FROM part WHERE p_partkey % 2 = 0),
q AS (SELECT p_partkey AS asked, p_name, {LOOSE} AS loose FROM part),
x AS (SELECT p_name, min(p_partkey) AS k FROM e GROUP BY p_name), y AS (SELECT loose, min(p_partkey) AS k FROM e GROUP BY loose)
SELECT asked, coalesce(x.k, y.k) AS entry, CASE WHEN x.k IS NOT NULL THEN 'exact' WHEN y.k IS NOT NULL THEN 'loose' ELSE 'none' END AS how
FROM q LEFT JOIN x USING (p_name) LEFT JOIN y USING (loose)""")
def dictionary_fallback(spark, sf_dir):  # noqa: ANN001, ANN201
    part = table(spark, sf_dir, "part").withColumn("loose", F.regexp_replace(F.lower("p_name"), "[^a-z]", ""))
    asked = part.select(F.col("p_partkey").alias("asked"), "p_name", "loose")
    entries = part.where("p_partkey % 2 = 0").select("p_name", "loose", F.col("p_partkey").alias("entry"))
    return registry.fallback_lookup(asked, entries, "p_name", "loose", "entry").select("asked", "entry", "how")


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linenumber AS label FROM lineitem),
n AS (SELECT *, count(*) OVER (PARTITION BY label) AS c, row_number() OVER (PARTITION BY label ORDER BY l_orderkey) - 1 AS r FROM l),
s AS (SELECT k, k AS rest, '' AS t FROM range((SELECT max(c) FROM n)) x(k) UNION ALL SELECT k, rest // 26 - 1, chr((97 + rest % 26)::INT) || t FROM s WHERE rest >= 0)
SELECT l_orderkey, l_linenumber, CASE WHEN c = 1 THEN label ELSE label || t END AS shown FROM n JOIN s ON s.k = n.r AND s.rest < 0""")
def disambiguate_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    labels = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", "l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    return registry.disambiguated(labels, "label", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "shown")


@query("SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_linenumber AS label, lpad(l_orderkey::VARCHAR, greatest(8, length(l_orderkey::VARCHAR))::INT, '0') || '.' || lpad(l_linenumber::VARCHAR, 8, '0') AS sort_key FROM lineitem")
def sort_key(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", a, b).alias("label"), fx.sort_key(fx.number_key(a), fx.number_key(b)).alias("sort_key"))


@query("SELECT p_partkey, regexp_extract(p_brand, '^(\\D*)(\\d*)$', 1) AS head, regexp_extract(p_brand, '^(\\D*)(\\d*)$', 2) AS tail FROM part")
def parse_label(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"^(\D*)(\d*)$", 1).alias("head"), F.regexp_extract("p_brand", r"^(\D*)(\d*)$", 2).alias("tail"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(s, '\\d$') THEN regexp_extract(s, '^(.*?)(\\d*)$', 1) || lpad((regexp_extract(s, '(\\d+)$', 1)::BIGINT + 1)::VARCHAR, greatest(length(regexp_extract(s, '(\\d+)$', 1)), length((regexp_extract(s, '(\\d+)$', 1)::BIGINT + 1)::VARCHAR))::INT, '0')
  WHEN regexp_matches(s, '[a-y]$') THEN left(s, length(s) - 1) || chr(ascii(right(s, 1)) + 1) END AS next
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || lpad((p_partkey % 100)::VARCHAR, 2, '0') END AS s FROM part)""")
def next_label(spark, sf_dir):  # noqa: ANN001, ANN201
    s = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", fx.next_label("s").alias("next"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id").groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT page_id, list_contains([lower(x) for x in string_split(url, '/')], lower(split_part(url, '/', 3))) AS host_found, len(string_split(url, '/'))::BIGINT AS parts FROM pages")
def identifier_match(spark, sf_dir):  # noqa: ANN001, ANN201
    parts = F.split("url", "/")
    wanted = F.lower(F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf_dir, "pages").select("page_id", F.exists(parts, lambda x: F.lower(x) == wanted).alias("host_found"), F.size(parts).cast("long").alias("parts"))


@query(f"""
WITH {TOKENS}, h AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS head FROM documents), b AS (SELECT head, min(doc_id) AS base_id FROM h GROUP BY head HAVING count(*) > 1),
t AS (SELECT doc_id, line, pos, lower(form) AS w FROM tokens WHERE regexp_matches(form, '^[A-Za-z]+$')),
p AS (SELECT DISTINCT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b FROM h JOIN b ON h.head = b.head AND h.doc_id <> b.base_id JOIN t x ON x.doc_id = h.doc_id JOIN t y ON y.doc_id = b.base_id AND y.line = x.line AND y.pos = x.pos WHERE x.w <> y.w)
SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS likeness FROM p WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.6""")
def near_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pairs of words (ASCII) that stand at one place in texts that begin alike and are near one another; each pair is compared once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))).alias("head"))
    sets = docs.groupBy("head").agg(F.min("doc_id").alias("base_id"), F.count("*").alias("n")).where("n > 1")
    members = docs.join(sets, "head").select("doc_id", "base_id")
    words = tokens(spark, sf_dir).where(F.col("form").rlike("^[A-Za-z]+$")).select("doc_id", "line", "pos", F.lower("form").alias("w"))
    own = words.join(members, "doc_id")
    # words of one group meet by place; equal words of a place count once before they are compared with the base's
    read = own.where("doc_id != base_id").select("base_id", "line", "pos", "w").distinct()
    base = own.where("doc_id = base_id").select("base_id", "line", "pos", F.col("w").alias("x"))
    pairs = read.join(base, ["base_id", "line", "pos"]).where("w != x").select(F.least("w", "x").alias("a"), F.greatest("w", "x").alias("b")).distinct()
    return pairs.withColumn("likeness", fx.similarity("a", "b")).where("likeness >= 0.6").select("a", "b", F.round("likeness", 6).alias("likeness"))


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.event_id - b.event_id) <= 240 WHERE a.event_type = 'purchase' AND b.event_type = 'refund'""".replace("'refund'", "'signup'"))
def band_link(spark, sf_dir):  # noqa: ANN001, ANN201
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id")
    right = events.where("event_type = 'signup'").select("user_id", "event_id")
    return stream.band_links(left, right, ["user_id"], "event_id", 240).select(F.col("event_id").alias("a"), F.col("event_id_b").alias("b"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def review_backlog(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT c_custkey, last_at FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE last_at > TIMESTAMP '1998-01-01'")
def changed_since(spark, sf_dir):  # noqa: ANN001, ANN201
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at")).where("last_at > timestamp_ntz'1998-01-01'")
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "last_at")


@query("SELECT conv_id, turn, previous FROM (SELECT *, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, length(text) AS len FROM conversations) WHERE len < previous")
def conform_order(spark, sf_dir):  # noqa: ANN001, ANN201
    turns = table(spark, sf_dir, "conversations").withColumn("len", F.length("text").cast("long"))
    return stream.out_of_order(turns, ["conv_id"], ["turn"], "len").select("conv_id", "turn", "previous")


@query(f"""
WITH {TOKENS}, f AS (SELECT doc_id, line, pos, lower(regexp_replace(form, '[\\pP\\pS]', '', 'g')) AS w FROM tokens),
g AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY line, pos) AS w2 FROM f)
SELECT doc_id, line, pos FROM g WHERE w = 'of' AND w2 = 'the'""")
def search_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    return stream.search(table(spark, sf_dir, "documents"), ["of", "the"]).select("doc_id", "line", "pos")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only-there' WHEN b.doc_id IS NULL THEN 'only-here' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state
FROM (SELECT doc_id, n_chars AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS h FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id""")
def sync_report(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("h"))
    there = docs.where("doc_id % 5 != 0").withColumn("h", F.when(F.col("doc_id") % 4 == 0, F.lit(0)).otherwise(F.col("h")))
    return registry.sync_report(docs.where("doc_id % 3 != 0"), there, "doc_id", "h")


@query("""
WITH RECURSIVE r AS (SELECT c_custkey AS old, c_custkey // 2 AS new, 1 AS hop FROM customer WHERE c_custkey % 4 = 0 AND c_custkey > 0
  UNION ALL SELECT r.old, r.new // 2, hop + 1 FROM r WHERE r.new % 4 = 0 AND r.new > 0 AND hop < 20)
SELECT old, arg_max(new, hop) AS new FROM r GROUP BY old""")
def alias_chain(spark, sf_dir):  # noqa: ANN001, ANN201
    merges = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0 AND c_custkey > 0").select(F.col("c_custkey").alias("old"), F.expr("c_custkey div 2").alias("new"))
    return registry.alias_chains(merges)


@query("""
SELECT event_type, max(v) AS value FROM (SELECT event_type, user_id, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT event_type, user_id, value + 1 FROM events WHERE event_id % 2 = 1) GROUP BY event_type""")
def upsert_greatest(spark, sf_dir):  # noqa: ANN001, ANN201
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    changes = events.where("event_id % 2 = 1").select("event_type", (F.col("value") + 1).alias("value"))
    return registry.upsert(events.where("event_id % 2 = 0").select("event_type", "value"), changes, ["event_type"], greatest="value")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY user_id""")
def count_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    tests = {"clicks": F.col("event_type") == "click", "purchases": F.col("event_type") == "purchase", "large": F.col("value") > 50}
    return registry.conditional_counts(table(spark, sf_dir, "events"), ["user_id"], tests)


def _collation(spark, sf_dir):  # noqa: ANN001, ANN202
    return collate.Collation(collate.keyed(collate.lined_up(table(spark, sf_dir, "documents").select("doc_id", "text"))))


@query()
def collate_sites(spark, sf_dir):  # noqa: ANN001, ANN201
    return collate.apparatus(_collation(spark, sf_dir).readings())


@query()
def collate_kinds(spark, sf_dir):  # noqa: ANN001, ANN201
    return _collation(spark, sf_dir).kinds().groupBy("site_kind").agg(F.count("*").alias("n"))


@query()
def collate_anchors(spark, sf_dir):  # noqa: ANN001, ANN201
    return _collation(spark, sf_dir).anchors().groupBy("grp").agg(F.count("*").alias("n"))


@query()
def order_moves(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lines that a document has in another order than the first document that begins alike; repeated lines count once, where they come first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))
    docs = docs.where(F.size("lines") > 0).withColumn("head", F.sha2(F.get("lines", F.lit(0)), 256))
    base = docs.groupBy("head").agg(F.min_by("lines", "doc_id").alias("base"), F.min("doc_id").alias("base_id"))
    pairs = docs.join(base, "head").where("doc_id != base_id")
    moves = pairs.select("doc_id", "base_id", order.moved("base", "lines").alias("moved"))
    return moves.select("doc_id", "base_id", F.size("moved").cast("long").alias("n_moved"))


@query("""
WITH w AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN ts - p < INTERVAL 20 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 20 MINUTE AS closed_at, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):  # noqa: ANN001, ANN201
    found = keyed.session_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return found.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("closed_at").cast("timestamp_ntz").alias("closed_at"), "n")


@query("""SELECT kind, record, "at" AS last_at FROM (SELECT 'user' AS kind, user_id::VARCHAR AS record, max(ts) AS "at" FROM events GROUP BY user_id UNION ALL SELECT 'type', event_type, max(ts) FROM events GROUP BY event_type) WHERE TIMESTAMP '2024-02-01' - "at" >= INTERVAL 3600 SECOND""")
def quiet_marks(spark, sf_dir):  # noqa: ANN001, ANN201
    marks = keyed.changes(table(spark, sf_dir, "events"), {"user": "user_id", "type": "event_type"}, "ts")
    return keyed.quiet(marks, "2024-02-01 00:00:00", 3600).withColumnRenamed("at", "last_at")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS start, 1 AS c FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - r.start >= 3600000000 THEN o.t ELSE r.start END, CASE WHEN o.t - r.start >= 3600000000 THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id AS hit_id, c <= 3 AS allowed FROM r""")
def rate_limited(spark, sf_dir):  # noqa: ANN001, ANN201
    hits = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("hit_id"), "ts")
    return keyed.rate_limit_batch(hits, "user_id", "ts", 3, 3600)


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
w AS (SELECT page_id, [x for x in regexp_split_to_array(t, '\s+') if x <> ''] AS w FROM t)
SELECT page_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS form FROM w""")
def html_to_stream(spark, sf_dir):  # noqa: ANN001, ANN201
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(words).alias("pos", "form")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH RECURSIVE {TOKENS}, l AS (SELECT doc_id, line, count(*) AS n, arg_max(form, pos) AS last FROM tokens GROUP BY doc_id, line),
s AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, coalesce(NOT regexp_matches(lag(last) OVER (PARTITION BY doc_id ORDER BY line), '[.!?|]$'), false) AS uncut FROM l),
r AS (SELECT doc_id, k, line AS segment, line AS passage, 1 AS taken, n AS words FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, s.line, CASE WHEN uncut AND taken < 12 AND words + n <= 240 THEN passage ELSE s.line END, CASE WHEN uncut AND taken < 12 AND words + n <= 240 THEN taken + 1 ELSE 1 END, CASE WHEN uncut AND taken < 12 AND words + n <= 240 THEN words + n ELSE n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
SELECT doc_id, segment, passage FROM r""")
def plan_passages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lines of documents as segments; a boundary is uncut where the line before does not end a sentence."""
    from pyspark.sql.window import Window

    lines = tokens(spark, sf_dir).groupBy("doc_id", "line").agg(F.count("*").alias("n_words"), F.max_by("form", "pos").alias("last"))
    before = F.lag("last").over(Window.partitionBy("doc_id").orderBy("line"))
    segments = lines.select("doc_id", F.col("line").alias("segment"), "n_words", F.coalesce(~before.rlike(r"[.!?|]$"), F.lit(False)).alias("uncut"))
    return passages.plan_passages(segments)
