"""Histories, the relational layer, JSON, apparatus and keyed streams over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apparatus, attach, edits, history, order, passages, registry, undo
from ..streaming import keyed, saving
from .keeping import kept
from .queries import query, table

@query("""
WITH e AS (SELECT event_id, user_id % 20 AS doc, event_id AS v, ts, user_id, event_id % 40 = 0 AS kept, date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 1e6 AS age FROM events),
s AS (SELECT *, user_id || '|' || CASE WHEN age > 1296000 THEN 'day|' || strftime(ts, '%Y-%m-%d') WHEN age > 432000 THEN 'hour|' || strftime(ts, '%Y-%m-%dT%H') ELSE 'none|one ' || v END AS slot FROM e),
b AS (SELECT *, CASE WHEN slot IS NOT DISTINCT FROM lag(slot) OVER w AND NOT coalesce(lag(kept) OVER w, true) THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY doc ORDER BY v)),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY v ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT doc, min(v) AS first_id, max(v) AS last_id, count(*) AS n, min(slot) AS slot FROM g GROUP BY doc, part""")
def thin_by_age(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "events").withColumn("doc", F.col("user_id") % 20)
    return history.thin_by_age(rows, ["doc"], "event_id", "ts", "user_id", F.col("event_id") % 40 == 0, "2024-02-01 00:00:00", 432_000, 1_296_000)


@query("""
WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS a FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
n AS (SELECT doc, count(*) AS n FROM i GROUP BY doc)
SELECT i.doc, item FROM i JOIN n USING (doc) WHERE i.doc % 3 = 0 AND (n > 2 AND i.a = n OR n = 2 AND i.a = 1)
UNION ALL SELECT i.doc, item FROM i JOIN n USING (doc) WHERE n > 1 AND i.doc % 3 = 1 AND i.a = 1""")
def moved_items(spark, sf_dir):  # noqa: ANN001, ANN201
    """The last item of every third document is put first, the first of another third last."""
    before = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item")).agg(F.min("l_linenumber").alias("pos"))
    n = before.groupBy("doc").agg(F.max("pos").alias("last"), F.min("pos").alias("first"))
    turned = F.when((F.col("doc") % 3 == 0) & (F.col("pos") == F.col("last")), -1).when((F.col("doc") % 3 == 1) & (F.col("pos") == F.col("first")), 1000).otherwise(F.col("pos"))
    after = before.join(n, "doc").select("doc", "item", turned.alias("pos"))
    found = history.moved_items(before, after, "doc", "item", "pos")
    return found.withColumn("item", F.col("item").cast("int"))


def _log(spark, sf_dir):  # noqa: ANN001, ANN202
    """Edits of a document for each customer: each order inserts an item at the end or, every third, sets the one before; every fifth names none that is there."""
    from pyspark.sql.window import Window

    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(over).cast("long")).withColumn("last", F.lag("o_orderkey").over(over))
    key, last = F.col("o_orderkey").cast("string"), F.col("last").cast("string")
    insert = F.to_json(F.struct(F.lit("insert").alias("t"), F.lit(None).cast("string").alias("after"), F.array(F.struct(key.alias("id"), F.col("o_orderstatus").alias("form"))).alias("items")))
    remove = F.to_json(F.struct(F.lit("delete").alias("t"), F.array(last).alias("ids")))
    bad = F.to_json(F.struct(F.lit("delete").alias("t"), F.array(F.lit("none")).alias("ids")))
    edit = F.when(F.col("version") % 5 == 0, bad).when((F.col("version") % 3 == 0) & (F.col("version") % 5 != 1), remove).otherwise(insert)
    return rows.select(F.col("o_custkey").cast("string").alias("doc_id"), "version", edit.alias("edit"))


LOG = """WITH o AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders),
k AS (SELECT *, CASE WHEN version % 5 = 0 THEN 'bad' WHEN version % 3 = 0 AND version % 5 <> 1 THEN 'delete' ELSE 'insert' END AS t FROM o),
p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY version) AS before FROM k)"""


@query(f"""{LOG} SELECT doc_id, version, CASE t WHEN 'insert' THEN true WHEN 'delete' THEN before = 'insert' ELSE false END AS ok FROM p""")
def fold_edits(spark, sf_dir):  # noqa: ANN001, ANN201
    return edits.fold_edits(_log(spark, sf_dir)).select("doc_id", "version", "ok")


@query(f"""{LOG}, gone AS (SELECT doc_id, version - 1 AS version FROM p WHERE t = 'delete' AND before = 'insert' AND version <= 7),
s AS (SELECT p.doc_id, p.version, o_orderkey FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.version = p.version WHERE t = 'insert' AND p.version <= 7)
SELECT d.doc_id, coalesce(string_agg(o_orderkey::VARCHAR, ' ' ORDER BY s.version DESC), '') AS ids FROM (SELECT DISTINCT doc_id FROM o) d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""")
def rebuild_version(spark, sf_dir):  # noqa: ANN001, ANN201
    """The state at version 7 from checkpoints at every fourth version."""
    log = _log(spark, sf_dir)
    points = edits.fold_edits(log.where("version <= 4"), every=4).where("items IS NOT NULL").select("doc_id", "version", "items")
    wanted = log.select("doc_id").distinct().withColumn("version", F.lit(7).cast("long"))
    found = edits.rebuilt(log, points, wanted)
    return found.select("doc_id", F.array_join(F.transform(F.from_json("items", "array<struct<id:string>>"), lambda x: x["id"]), " ").alias("ids"))


@query("""SELECT o_custkey, string_agg('e' || o_orderkey, ' ' ORDER BY o_orderkey) AS edits, string_agg('r' || o_orderkey, ' ' ORDER BY o_orderkey DESC) AS reverses, max(o_orderkey) AS version FROM orders GROUP BY o_custkey""")
def compose(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.concat(F.lit("e"), k).alias("edit"), F.concat(F.lit("r"), k).alias("reverse"))
    return edits.composed(rows, ["o_custkey"]).select("o_custkey", "version", F.array_join("edits", " ").alias("edits"), F.array_join("reverses", " ").alias("reverses"))


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS version, o_orderkey % 5 AS author FROM orders), p AS (SELECT c_custkey AS doc, c_custkey % 5 AS person, 20 * c_custkey AS position FROM customer)
SELECT person, doc, version FROM c JOIN p USING (doc) WHERE version > position AND author <> person AND version % 4 <> 0""")
def review_state(spark, sf_dir):  # noqa: ANN001, ANN201
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 5).alias("author"))
    positions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 5).alias("person"), (20 * F.col("c_custkey")).alias("position"))
    accepted = changes.where("version % 4 = 0").join(positions, "doc").select("person", "doc", "version")
    return history.to_review(changes, positions, accepted, "doc", "version", "person")


@query("""WITH s AS (SELECT o_custkey AS doc, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM orders WHERE o_orderstatus = 'F')
SELECT s.doc, s.number, s.version, count(c.o_orderkey) AS n_changes FROM s LEFT JOIN orders c ON c.o_custkey = s.doc AND c.o_orderkey <= s.version AND c.o_orderkey > s.before GROUP BY s.doc, s.number, s.version""")
def published_versions(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    return history.published(rows.where("o_orderstatus = 'F'"), rows, "doc", "version")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS t FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_name END AS t FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'drop' ELSE 'write' END AS action FROM a FULL JOIN b ON a.k = b.k WHERE a.t IS DISTINCT FROM b.t""")
def index_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("t"))
    new = rows.where("k % 5 != 0").withColumn("t", F.when(F.col("k") % 7 == 0, "new").otherwise(F.col("t")))
    return history.index_changes(rows.where("k % 3 != 0"), new, ["k"], ["t"])


FAMILY = """p AS (SELECT o_orderkey AS id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 2 THEN first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS parent, o_custkey AS doc FROM orders),
h AS (SELECT doc, max(id) AS local, max(id) FILTER (WHERE doc % 4 <> 0 OR id % 2 = 0) AS incoming FROM p GROUP BY doc)"""


def _family(spark, sf_dir):  # noqa: ANN001, ANN202
    """Changes whose parent is the one before the last: two histories in each document, one for its last change and one for another."""
    from pyspark.sql.window import Window

    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey", 2).over(over).alias("parent"), F.col("o_custkey").alias("doc"))
    ends = rows.groupBy("doc").agg(F.max("id").alias("local"), F.max(F.when((F.col("doc") % 4 != 0) | (F.col("id") % 2 == 0), F.col("id"))).alias("incoming"))
    return rows, ends


@query(f"""WITH RECURSIVE {FAMILY}, a AS (SELECT doc, local AS id FROM h UNION SELECT a.doc, p.parent FROM a JOIN p ON p.id = a.id WHERE p.parent IS NOT NULL) SELECT doc, id FROM a""")
def ancestors(spark, sf_dir):  # noqa: ANN001, ANN201
    rows, ends = _family(spark, sf_dir)
    return history.ancestors(ends.select("doc", F.col("local").alias("id")), rows.select("id", "parent"))


@query(f"""WITH RECURSIVE {FAMILY}, a AS (SELECT doc, local AS id FROM h UNION SELECT a.doc, p.parent FROM a JOIN p ON p.id = a.id WHERE p.parent IS NOT NULL),
b AS (SELECT doc, incoming AS id FROM h WHERE incoming IS NOT NULL UNION SELECT b.doc, p.parent FROM b JOIN p ON p.id = b.id WHERE p.parent IS NOT NULL),
here AS (SELECT * FROM a EXCEPT SELECT * FROM b), there AS (SELECT * FROM b EXCEPT SELECT * FROM a),
x AS (SELECT DISTINCT doc, id % 6 AS item FROM here), y AS (SELECT DISTINCT doc, id % 6 AS item FROM there), z AS (SELECT doc, count(*) AS n_clash FROM x JOIN y USING (doc, item) GROUP BY doc)
SELECT h.doc, CASE WHEN h.doc NOT IN (SELECT doc FROM there) THEN CASE WHEN h.doc IN (SELECT doc FROM here) THEN 'keep' ELSE 'nothing' END WHEN h.doc NOT IN (SELECT doc FROM here) THEN 'fast-forward' WHEN z.n_clash IS NULL THEN 'merge' ELSE 'conflict' END AS outcome, coalesce(n_clash, 0) AS n_clash FROM h LEFT JOIN z ON z.doc = h.doc""")
def reconcile(spark, sf_dir):  # noqa: ANN001, ANN201
    rows, ends = _family(spark, sf_dir)
    sides = [history.ancestors(ends.where(f"{c} IS NOT NULL").select("doc", F.col(c).alias("id")), rows.select("id", "parent")) for c in ("local", "incoming")]
    return history.reconciled(ends, rows.select("id", (F.col("id") % 6).alias("item")), *sides)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT o_custkey, count(*) FILTER (WHERE k = 0) AS inserted, count(*) FILTER (WHERE k = 1) AS deleted, count(*) FILTER (WHERE k = 2) AS moved, count(*) FILTER (WHERE k = 3) AS form, count(*) FILTER (WHERE k = 4) AS norm, count(*) FILTER (WHERE k = 5) AS segments,
count(*) FILTER (WHERE k = 6) AS marks, count(*) FILTER (WHERE k = 7) AS split, count(*) FILTER (WHERE k = 8) AS joined, count(*) FILTER (WHERE k = 9) AS other FROM (SELECT o_custkey, l_partkey % 10 AS k FROM i JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_custkey""")
def count_ops(spark, sf_dir):  # noqa: ANN001, ANN201
    names = ["inserted", "deleted", "moved", "form", "norm", "segments", "marks", "split", "joined", "other"]
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return registry.conditional_counts(rows, ["o_custkey"], {n: F.col("l_partkey") % 10 == i for i, n in enumerate(names)})


@query("""WITH b AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS x, count(*) AS n, min(o_orderkey) AS f, max(o_orderkey) AS l, max(o_orderkey) FILTER (WHERE o_orderkey < m) AS p FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n < 2 THEN '' WHEN n = 2 THEN f || ' after ' || l || ' (base: -)' ELSE l || ' after - (base: ' || p || ')' END AS moves FROM b""")
def order_statements(spark, sf_dir):  # noqa: ANN001, ANN201
    """A customer's orders, compared with the same where the last is put first."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    lists = lists.select("o_custkey", F.transform("a", lambda x: x.cast("string")).alias("a"))
    turned = F.concat(F.array(F.element_at("a", -1)), F.slice("a", 1, F.size("a") - 1))
    moves = F.transform(order.statements("a", "b"), lambda s: F.concat(F.array_join(s["moved"], " "), F.lit(" after "), F.coalesce(s["after"], F.lit("-")), F.lit(" (base: "), F.coalesce(s["after_in_base"], F.lit("-")), F.lit(")")))
    found = lists.withColumn("b", turned).select("o_custkey", moves.alias("m"))
    return found.select("o_custkey", F.array_join("m", "; ").alias("moves"))


@query("""SELECT kind, id, at FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS "at" FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem) ORDER BY "at" DESC, id, kind LIMIT 20""".replace("SELECT kind, id, at FROM", 'SELECT kind, id, "at" AS seen_at FROM'))
def recent_work(spark, sf_dir):  # noqa: ANN001, ANN201
    parts = {"order": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at")), "line": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("seen_at"))}
    return registry.top_merge(parts, [F.desc("seen_at"), F.asc("id")], 20).select("kind", "id", "seen_at")


@query("""SELECT k AS part, count(*) FILTER (WHERE s = 0) AS n_a, count(*) FILTER (WHERE s = 1) AS n_b, count(DISTINCT m) AS members, max(d) AS last_at FROM (
SELECT l_partkey AS k, 0 AS s, l_suppkey AS m, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 1, l_suppkey, l_shipdate FROM lineitem WHERE l_linestatus = 'O') GROUP BY k""")
def two_source_tally(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    return registry.two_source_tally(rows.where("l_returnflag = 'R'"), rows.where("l_linestatus = 'O'"), "part", "l_shipdate", "l_suppkey")


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS key FROM part WHERE p_partkey % 2 = 1), t AS (SELECT p_partkey AS id, p_name AS key FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT key, count(*) AS n, min(id) AS into_id FROM t GROUP BY key)
SELECT s.id, s.key, CASE WHEN s.key IS NULL OR n > 1 THEN 'blocked' WHEN n = 1 THEN 'matched' ELSE 'moved' END AS state, CASE WHEN n = 1 THEN into_id END AS "into", s.id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS used FROM s LEFT JOIN g ON g.key = s.key""")
def merge_preview(spark, sf_dir):  # noqa: ANN001, ANN201
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    source = part.where("id % 2 = 1").withColumn("key", F.when(F.col("id") % 9 != 0, F.col("key")))
    return registry.merge_preview(source, part.where("id % 2 = 0"), used, "key", "id")


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(*) FROM customer WHERE c_custkey = s_suppkey) AS customers, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) + (SELECT count(*) FROM customer WHERE c_custkey = s_suppkey) = 0 AS free FROM supplier""")
def dependents(spark, sf_dir):  # noqa: ANN001, ANN201
    return registry.dependents(table(spark, sf_dir, "supplier"), "s_suppkey", {"lines": (table(spark, sf_dir, "lineitem"), "l_suppkey"), "customers": (table(spark, sf_dir, "customer"), "c_custkey")})


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), m AS (SELECT s_suppkey AS old, s_suppkey // 2 AS new FROM supplier WHERE s_suppkey % 2 = 1)
SELECT l_orderkey, coalesce(new, l_suppkey) AS l_suppkey FROM r LEFT JOIN m ON old = l_suppkey WHERE new IS NULL OR NOT EXISTS (SELECT 1 FROM r x WHERE x.l_orderkey = r.l_orderkey AND x.l_suppkey = m.new)""")
def remap_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rows that would fall onto a key that is there go first, then the ids change."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    mapping = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("old"), F.expr("s_suppkey div 2").alias("new"))
    return registry.remap(registry.delete_using(rows, mapping, "l_suppkey", ["l_orderkey"]), mapping, "l_suppkey").select("l_orderkey", "l_suppkey")


@query("""SELECT event_id, TIMESTAMP '2024-01-20' - ts >= INTERVAL 1 DAY AS due FROM events""")
def take_queue(spark, sf_dir):  # noqa: ANN001, ANN201
    due = F.col("ts") <= F.lit("2024-01-19").cast("timestamp_ntz")
    now, later = registry.taken(table(spark, sf_dir, "events").select("event_id", "ts"), due)
    return now.select("event_id", F.lit(True).alias("due")).unionByName(later.select("event_id", F.lit(False).alias("due")))


@query("""WITH r AS (SELECT o_orderkey AS record, o_custkey AS owner, o_orderstatus = 'F' AS public FROM orders), g AS (SELECT l_orderkey AS record, l_suppkey AS person FROM lineitem),
u AS (SELECT record, owner AS person, 2 AS r FROM r UNION ALL SELECT record, person, 1 FROM g UNION ALL SELECT record, NULL, 0 FROM r WHERE public)
SELECT record, person, CASE max(r) WHEN 2 THEN 'own' WHEN 1 THEN 'shared' ELSE 'public' END AS "right" FROM u WHERE record IN (SELECT record FROM r) GROUP BY record, person""")
def rights_visible(spark, sf_dir):  # noqa: ANN001, ANN201
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("owner"), (F.col("o_orderstatus") == "F").alias("public"))
    grants = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("person"))
    return registry.visible(records, grants, "person", "record", "owner", F.col("public"))


@query("""WITH e AS (SELECT l_partkey AS key, l_suppkey AS value, min(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS r FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, value) AS nth FROM e)
SELECT p_partkey AS key, value, nth FROM part JOIN n ON key = p_partkey WHERE nth <= 3""")
def analyses_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"), "l_linestatus")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return registry.ranked_lookup(asked, entries, "key", "value", F.when(F.col("l_linestatus") == "O", 0).otherwise(1), 3)


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), m AS (SELECT c_custkey AS old, c_custkey // 3 AS new FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0),
c AS (SELECT old, new, 1 AS hop FROM m UNION ALL SELECT c.old, m.new, hop + 1 FROM c JOIN m ON m.old = c.new WHERE hop < 20), e AS (SELECT old, arg_max(new, hop) AS new FROM c GROUP BY old),
n AS (SELECT c_name AS identifier, min(c_custkey) AS id FROM customer GROUP BY c_name), a AS (SELECT c_custkey AS ask, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS identifier FROM customer)
SELECT ask, coalesce(k.id, x.new, n.id) AS record, CASE WHEN k.id IS NOT NULL THEN 'id' WHEN x.new IS NOT NULL THEN 'merge' WHEN n.id IS NOT NULL THEN 'identifier' ELSE 'none' END AS how
FROM a LEFT JOIN k ON k.id = a.id LEFT JOIN (SELECT e.* FROM e JOIN k ON k.id = e.new) x ON x.old = a.id LEFT JOIN n ON n.identifier = a.identifier""")
def record_resolution(spark, sf_dir):  # noqa: ANN001, ANN201
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("identifier"))
    merges = customer.where("id % 3 = 0 AND id > 0").select(F.col("id").alias("old"), F.expr("id div 3").alias("new"))
    asked = customer.select(F.col("id").alias("ask"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.col("identifier")).alias("identifier"))
    return registry.resolved(asked, customer.where("id % 3 != 0").select("id"), merges, customer)


# JSON


@query("""WITH d AS (SELECT l_orderkey AS k, list({'id': l_partkey, 'n': l_linenumber}) AS items FROM lineitem GROUP BY l_orderkey) SELECT k, len(list_filter(items, lambda i: i.id = 7 OR i.id = 11)) > 0 AS contained FROM d""")
def json_containment(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("n")))).alias("content"))
    items = F.from_json("content", "array<struct<id:long,n:int>>")
    return docs.select("k", F.exists(items, lambda i: i["id"].isin(7, 11)).alias("contained"))


@query("""SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events""")
def json_key_exists(spark, sf_dir):  # noqa: ANN001, ANN201
    keys = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.map_contains_key(keys, "k"), F.lit(False)).alias("has_k"), F.coalesce(F.map_contains_key(keys, "missing"), F.lit(False)).alias("has_missing"))


@query("""WITH x AS (SELECT user_id, unnest([event_id % 5, event_id % 3, event_id % 5]) AS e FROM events) SELECT user_id, string_agg(DISTINCT e::VARCHAR, ' ' ORDER BY e::VARCHAR) AS "union" FROM x GROUP BY user_id""")
def set_union(spark, sf_dir):  # noqa: ANN001, ANN201
    """Accepted sets of a person, each change's joined to those before: the union is taken before the shuffle, too."""
    own = table(spark, sf_dir, "events").select("user_id", F.explode(F.array_union(F.array(F.col("event_id") % 5), F.array(F.col("event_id") % 3, F.col("event_id") % 5))).alias("e"))
    return own.groupBy("user_id").agg(F.array_join(F.array_sort(F.transform(F.collect_set("e"), lambda x: x.cast("string"))), " ").alias("union"))


@query("""SELECT p_partkey, '[{"ref":"' || CASE WHEN p_partkey % 4 = 0 THEN 'new' || p_partkey // 4 ELSE 'old' || p_partkey END || '","note":"old' || p_partkey || '"}]' AS content FROM part""")
def json_replace_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    """Ids inside JSON go by a table of merges; text that looks like an id stays."""
    k = F.col("p_partkey").cast("string")
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('[{"ref":"old'), k, F.lit('","note":"old'), k, F.lit('"}]')).alias("content"))
    mapping = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("old"), k).alias("old"), F.concat(F.lit("new"), F.expr("p_partkey div 4").cast("string")).alias("new"))
    rows = docs.select("p_partkey", F.posexplode(F.from_json("content", "array<struct<ref:string,note:string>>")).alias("i", "x")).select("p_partkey", "i", "x.ref", "x.note")
    new = registry.remap(rows, mapping, "ref").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("i", "ref", "note"))).alias("a"))
    return new.select("p_partkey", F.to_json(F.transform("a", lambda x: F.struct(x["ref"], x["note"]))).alias("content"))


@query("""SELECT a.p_partkey, a.p_brand = b.p_brand AND a.p_size = b.p_size AS equal FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def structural_equality(spark, sf_dir):  # noqa: ANN001, ANN201
    """JSON objects compared whatever the order of their keys."""
    part = table(spark, sf_dir, "part")
    one = part.select("p_partkey", F.to_json(F.struct("p_brand", "p_size")).alias("a"))
    two = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.to_json(F.struct("p_size", "p_brand")).alias("b"))
    shape = "p_brand string, p_size int"
    return one.join(two, "p_partkey").select("p_partkey", F.from_json("a", shape).eqNullSafe(F.from_json("b", shape)).alias("equal"))


# what only migrations use


@query("""SELECT DISTINCT w FROM (SELECT l_partkey AS w FROM lineitem WHERE l_quantity > 40 UNION SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_discount = 0)) u WHERE w NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def mark_if_absent(spark, sf_dir):  # noqa: ANN001, ANN201
    items = table(spark, sf_dir, "lineitem")
    marks = items.where("l_quantity > 40").select(F.col("l_partkey").alias("w")).union(items.where("l_discount = 0").select("l_partkey")).distinct()
    there = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("w"))
    return registry.upsert(there, marks, ["w"], nothing=True).join(there, "w", "left_anti")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'home' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE lower(c_mktsegment) END AS category, coalesce(nullif(c_nationkey, 0), 99) AS nation FROM customer""")
def category_clean_up(spark, sf_dir):  # noqa: ANN001, ANN201
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(s.isin("BUILDING", "HOUSEHOLD"), "home").when(s == "MACHINERY", None).otherwise(F.lower(s)).alias("category"), F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)), F.lit(99)).alias("nation"))


@query("""SELECT s_suppkey, '[{"name":"' || s_name || '"}]' AS editors FROM supplier""")
def text_to_json(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.array(F.struct(F.col("s_name").alias("name")))).alias("editors"))


@query("""SELECT DISTINCT 'work' AS kind, c_nationkey AS record FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT DISTINCT 'person', o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def fan_out(spark, sf_dir):  # noqa: ANN001, ANN201
    """From a changed record to what must be written anew: itself and, by a join, the work it belongs to."""
    changed = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'")
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return keyed.fan_out(changed.select("o_custkey"), {"person": ("o_custkey", None, None), "work": ("o_custkey", works, "c_nationkey")})


@query("""WITH e AS (SELECT event_id, user_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM events) SELECT event_id, user_id, CASE WHEN head IS NULL OR head < event_id THEN 'apply' ELSE 'late' END AS verdict FROM e""")
def late_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    """A change whose version is not above the head that is there when it comes is late."""
    return keyed.in_order(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["ts", "event_id"]).select("event_id", "user_id", "verdict")


# apparatus


@query("""WITH r AS (SELECT l_orderkey AS grp, l_linenumber AS site, l_suppkey % 4 AS key, min(l_partkey) % 2 = 0 AS is_base FROM lineitem GROUP BY 1, 2, 3), q AS (SELECT DISTINCT grp, site FROM r WHERE NOT is_base)
SELECT q.grp, q.site FROM q WHERE (q.grp + q.site) % 3 <> 0""")
def apparatus_backlog(spark, sf_dir):  # noqa: ANN001, ANN201
    readings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("site"), (F.col("l_suppkey") % 4).alias("key")).agg((F.min("l_partkey") % 2 == 0).alias("is_base"))
    reviewed = readings.where("(grp + site) % 3 = 0").select("grp", "site").distinct()
    return apparatus.backlog(readings, reviewed)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS grp, l_suppkey % 7 AS w FROM lineitem), t AS (SELECT grp, list(w) AS ws FROM r GROUP BY grp)
SELECT grp, array_to_string(list_sort(list_concat(CASE WHEN list_has_all(ws, [1, 2, 3]) THEN ['g'] ELSE [] END, list_transform(list_filter(ws, lambda w: NOT (list_has_all(ws, [1, 2, 3]) AND w IN (1, 2, 3))), lambda w: w::VARCHAR))), ' ') AS sigla FROM t""")
def group_sigla(spark, sf_dir):  # noqa: ANN001, ANN201
    readings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("texts"))
    groups = spark.createDataFrame([("g", ["1", "2", "3"])], "siglum string, members array<string>")
    return passages.group_sigla(readings, groups).select("grp", F.array_join(F.array_sort("texts"), " ").alias("sigla"))


ATTACH = """WITH RECURSIVE i AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS supp, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
u AS (SELECT o_custkey AS grp, o, part, row_number() OVER (PARTITION BY o_custkey ORDER BY o, n) - 1 AS idx, CASE WHEN supp % 17 > 0 THEN chr((97 + supp % 5)::INT) END AS w, o_orderpriority AS p FROM i JOIN orders ON o = o_orderkey),
b AS (SELECT grp, list(w ORDER BY idx) AS ws FROM u GROUP BY grp),
d AS (SELECT grp, o, min(idx) AS f, max(idx) + 1 AS t, list(w ORDER BY idx) AS ws, min(p) AS p FROM u GROUP BY grp, o),
s AS (SELECT grp, f, t, wanting, others, array_to_string(list_slice(ws, f + 1, t), ' ') AS key, row_number() OVER (PARTITION BY grp ORDER BY t, f DESC) AS number FROM b JOIN (
  SELECT grp, idx AS f, idx + 1 AS t, false AS wanting, chr((97 + (part // 4) % 6)::INT) AS others FROM u WHERE part % 4 = 0 UNION ALL SELECT grp, f, t, true, '' FROM d WHERE p LIKE '1%' AND t - f > 1) USING (grp)),
r AS (SELECT grp, o AS id, row_number() OVER (PARTITION BY grp ORDER BY o) AS k, CASE WHEN o % 11 = 0 THEN '' WHEN o % 13 = 0 THEN 'b z' ELSE array_to_string(list_slice(ws, 1, 1 + o % 3), ' ') END AS lemma, CASE WHEN o % 5 = 0 THEN coalesce(ws[-1], '') ELSE 'x' END AS reading,
  CASE WHEN o % 2 = 0 AND t - f > 1 THEN f + 1 ELSE -1 END AS a, CASE WHEN o % 4 = 1 THEN f ELSE 0 END AS low, CASE WHEN o % 4 = 1 THEN t ELSE 1000000 END AS high FROM d),
m AS (SELECT id, s.*, CASE WHEN a >= f AND a < t AND lemma <> '' AND key = lemma THEN 1 WHEN a >= f AND a < t AND NOT wanting THEN 2 WHEN low > f OR t > high THEN NULL WHEN lemma <> '' AND key = lemma THEN 3 WHEN lemma <> '' AND others = lemma THEN 4 WHEN reading <> '' AND key = reading THEN 5 END AS rule FROM r JOIN s USING (grp)),
g AS (SELECT id, rule, false AS late, number, f, t, key FROM m WHERE rule IS NOT NULL),
q AS (SELECT *, string_split(CASE WHEN lemma <> '' THEN lemma ELSE reading END, ' ') AS ph FROM r WHERE lemma <> '' OR reading <> ''),
w AS (SELECT id, st AS f, st + len(ph) AS t, array_to_string(ph, ' ') AS key, row_number() OVER (PARTITION BY id ORDER BY a >= st AND a < st + len(ph) DESC, st) AS c FROM (SELECT q.*, ws, unnest(range(0, len(ws))) AS st FROM q JOIN b USING (grp)) WHERE list_slice(ws, st + 1, st + len(ph)) = ph AND low <= st AND st + len(ph) <= high),
x AS (SELECT r.*, f, t, key, id IN (SELECT id FROM g) AS given FROM r LEFT JOIN w USING (id) WHERE coalesce(c, 1) = 1),
y AS (SELECT grp, 0::BIGINT AS k, []::STRUCT(f BIGINT, t BIGINT, key VARCHAR, id BIGINT)[] AS opened FROM b
  UNION ALL SELECT y.grp, x.k, CASE WHEN given OR x.f IS NULL OR len(list_filter(opened, lambda p: a >= p.f AND a < p.t OR low <= p.f AND p.t <= high AND (lemma <> '' AND p.key = lemma OR reading <> '' AND p.key = reading))) > 0 THEN opened ELSE list_append(opened, {'f': x.f, 't': x.t, 'key': x.key, 'id': x.id}) END FROM y JOIN x ON x.grp = y.grp AND x.k = y.k + 1),
z AS (SELECT grp, p.f AS f, p.t AS t, p.key AS key, p.id AS number FROM (SELECT grp, unnest(arg_max(opened, k)) AS p FROM y GROUP BY grp)),
v AS (SELECT id, CASE WHEN number = id THEN 6 WHEN a >= f AND a < t AND key = lemma THEN 1 WHEN a >= f AND a < t THEN 2 WHEN low > f OR t > high THEN NULL WHEN lemma <> '' AND key = lemma THEN 3 WHEN reading <> '' AND key = reading THEN 5 END AS rule, true AS late, number, f, t, key FROM r JOIN z USING (grp) WHERE number <= id),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule, late, number) AS c FROM (SELECT * FROM g UNION ALL SELECT * FROM v WHERE rule IS NOT NULL)) WHERE c = 1)
"""


def _attachment(spark, sf_dir):  # noqa: ANN001, ANN202
    """A customer's order lines are the base's words, each order a segment: some words are places, some orders are wanting as a whole, and each order has a record on its words."""
    from pyspark.sql.window import Window

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("supp"), F.min("l_partkey").alias("part"))
    rows = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("p")), "o")
    word = F.when(F.col("supp") % 17 > 0, F.char(97 + F.col("supp") % 5))
    units = kept(rows.select("grp", "o", "part", "p", (F.row_number().over(Window.partitionBy("grp").orderBy("o", "n")) - 1).alias("idx"), word.alias("word"), F.array(F.concat_ws(".", "o", "n")).alias("token_ids")))
    orders = units.groupBy("grp", "o", "p").agg(F.min("idx").alias("from"), (F.max("idx") + 1).alias("to"), F.array_sort(F.collect_list(F.struct("idx", "word", "token_ids"))).alias("x"))
    words = F.transform("x", lambda u: u["word"])
    joined = F.array_join(words, " ")
    single = units.where("part % 4 = 0").select("grp", F.col("idx").alias("from"), (F.col("idx") + 1).alias("to"), F.coalesce("word", F.lit("")).alias("key"), F.lit(False).alias("wanting"), F.char(97 + F.floor(F.col("part") / 4) % 6).alias("other"))
    whole = orders.where("p LIKE '1%' AND to - from > 1").select("grp", "from", "to", joined.alias("key"), F.lit(True).alias("wanting"), F.lit("").alias("other"))
    sites = single.unionByName(whole).withColumn("site", F.row_number().over(Window.partitionBy("grp").orderBy("to", F.desc("from"))))
    both = F.explode(F.array(F.struct("key", F.lit(True).alias("is_base")), F.struct(F.col("other").alias("key"), F.lit(False).alias("is_base")))).alias("r")
    readings = sites.select("grp", "site", "from", "to", "wanting", both).select("grp", "site", "from", "to", "wanting", "r.*")
    o = F.col("o")
    lemma = F.when(o % 11 == 0, None).when(o % 13 == 0, "b z").otherwise(F.array_join(F.slice(words, F.lit(1), (1 + o % 3).cast("int")), " "))
    hangs = F.when((o % 2 == 0) & (F.size("x") > 1), F.get("x", F.lit(1))["token_ids"])
    ranged = o % 4 == 1
    records = orders.select(
        o.alias("record_id"), "grp", lemma.alias("lemma"), F.when(o % 5 == 0, F.element_at(words, -1)).otherwise("x").alias("reading"), hangs.alias("anchors"),
        F.when(ranged, F.col("from")).alias("low"), F.when(ranged, F.col("to")).alias("high"),
    )
    return attach.Attachment(records, readings, units.select("grp", "idx", "word", "token_ids"))


@query(f"""{ATTACH} SELECT id AS record_id, coalesce(rule, 0) AS rule, f AS from_idx, t AS to_idx, coalesce(late, false) AS opened, coalesce(reading <> '' AND reading = key, false) AS adopted FROM r LEFT JOIN e USING (id)""")
def attach_records(spark, sf_dir):  # noqa: ANN001, ANN201
    """Where each record goes, and by which rule."""
    placed = _attachment(spark, sf_dir).placed
    return placed.select("record_id", "rule", F.col("from").alias("from_idx"), F.col("to").alias("to_idx"), (F.col("site").isNull() & (F.col("rule") > 0)).alias("opened"), "adopted")


@query(f"""{ATTACH}, h AS (SELECT e.f, e.t, r.grp, min(reading <> '' AND upper(reading) = upper(replace(key, ' ', ''))) AS same, count(*) AS n FROM e JOIN r USING (id) WHERE late GROUP BY 1, 2, 3)
SELECT grp, f AS from_idx, t AS to_idx, number AS opened_by, CASE WHEN same THEN 'interpretative' ELSE 'textual' END AS site_kind FROM z JOIN h USING (grp, f, t)""")
def attach_places(spark, sf_dir):  # noqa: ANN001, ANN201
    """The places that records open where no text departs, and of which kind they are."""
    return _attachment(spark, sf_dir).opened.select("grp", F.col("from").alias("from_idx"), F.col("to").alias("to_idx"), F.col("by").alias("opened_by"), "site_kind")


@query("""WITH r AS (SELECT l_orderkey AS grp, l_suppkey % 4 AS key, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT grp, max(n) AS m, count(*) AS k, sum(n) AS total FROM r GROUP BY grp)
SELECT r.grp, r.key, CASE WHEN k = 1 THEN 'codd.' WHEN n = m AND n > 2 AND r.key = (SELECT min(x.key) FROM r x WHERE x.grp = r.grp AND x.n = a.m) THEN 'cett.' ELSE n::VARCHAR END AS named FROM r JOIN a ON a.grp = r.grp""")
def name_witnesses(spark, sf_dir):  # noqa: ANN001, ANN201
    readings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), (F.col("l_suppkey") % 4).alias("key")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("texts"))
    return apparatus.named(readings, "grp", "key").select("grp", "key", F.when(F.col("named").isin("cett.", "codd."), F.col("named")).otherwise(F.size("texts").cast("string")).alias("named"))


# passages

SIDES = """z AS (SELECT l_orderkey AS ed, l_linenumber AS segment, min(l_partkey) % 9 AS n_base, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n_base) OVER (PARTITION BY ed ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, row_number() OVER (PARTITION BY ed ORDER BY segment) AS nth FROM z),
sides AS (SELECT ed, segment, t AS text_id, (s + t) % 7 <> 0 AS words FROM z, range(3) r(t) WHERE (s + t) % 5 <> 0),
sites AS (SELECT ed, segment, text_id, (n_base // 2)::INT AS f, CASE WHEN text_id = 1 THEN (n_base // 2)::INT ELSE (n_base // 2 + n_base % 2)::INT END AS t FROM sides JOIN z USING (ed, segment) WHERE (s + segment + text_id) % 3 = 0 AND words),
edges AS (SELECT ed, segment, s % 2 = 0 AS at_end FROM z WHERE s % 11 = 3)"""


@query(f"""WITH {SIDES}, d AS (SELECT v.ed, v.text_id, b.nth, b.x + f - CASE WHEN f = t THEN 0.5 ELSE 0 END AS first, b.x + t + CASE WHEN f = t THEN 0.5 ELSE 0 END AS last FROM sites v JOIN b USING (ed, segment)),
th AS (SELECT ed, text_id, nth, words FROM sides JOIN b USING (ed, segment)),
dep AS (SELECT DISTINCT p.ed, k.nth FROM d p JOIN d q ON q.ed = p.ed AND q.text_id = p.text_id JOIN b k ON k.ed = p.ed AND k.nth > p.nth AND k.nth <= q.nth WHERE k.x - p.last < 4 AND q.first - k.x < 4
  AND (SELECT count(*) FROM th WHERE th.ed = p.ed AND th.text_id = p.text_id AND th.nth BETWEEN p.nth AND q.nth) = q.nth - p.nth + 1),
wo AS (SELECT DISTINCT a.ed, a.nth FROM th a JOIN th p ON p.ed = a.ed AND p.text_id = a.text_id AND p.nth = a.nth - 1 WHERE NOT (a.words AND p.words)),
ed AS (SELECT DISTINCT e.ed, b.nth + CASE WHEN at_end THEN 1 ELSE 0 END AS nth FROM edges e JOIN b USING (ed, segment))
SELECT b.ed, b.segment, CASE WHEN b.s % 13 = 5 THEN 'divided' WHEN ed.nth IS NOT NULL THEN 'words' WHEN wo.nth IS NOT NULL THEN 'without' WHEN dep.nth IS NOT NULL THEN 'departures' END AS reason
FROM b LEFT JOIN ed ON ed.ed = b.ed AND ed.nth = b.nth LEFT JOIN wo ON wo.ed = b.ed AND wo.nth = b.nth LEFT JOIN dep ON dep.ed = b.ed AND dep.nth = b.nth WHERE b.nth > 1""")
def boundary_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    z = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ed"), F.col("l_linenumber").alias("segment")).agg((F.min("l_partkey") % 9).alias("n_base"), F.min("l_suppkey").alias("s"))
    every = z.withColumn("text_id", F.explode(F.array(*map(F.lit, range(3))))).where("(s + text_id) % 5 != 0").withColumn("words", (F.col("s") + F.col("text_id")) % 7 != 0)
    half = F.expr("int(n_base div 2)")
    sites = every.where("(s + segment + text_id) % 3 = 0 AND words").select("ed", "segment", "text_id", half.alias("from"), F.when(F.col("text_id") == 1, half).otherwise(half + F.expr("int(n_base % 2)")).alias("to"))
    edges = z.where("s % 11 = 3").select("ed", "segment", F.lit(0).alias("text_id"), (F.col("s") % 2 == 0).alias("at_end"))
    return passages.boundary_reasons(every.select("ed", "segment", "text_id", "words"), z.select("ed", "segment", "n_base"), sites, edges, z.where("s % 13 = 5").select("ed", "segment"))


@query("""WITH w AS (SELECT o_custkey AS ed, o_orderkey % 3 AS letters, o_orderkey // 60 AS passage, o_orderkey AS "at", o_orderkey % 2 AS side FROM orders),
p AS (SELECT m.ed, m."at" AS m, a."at" AS a, abs(m."at" - a."at") AS distance FROM w m JOIN w a ON a.ed = m.ed AND a.letters = m.letters AND m.side = 0 AND a.side = 1 AND a.passage <> m.passage AND abs(m."at" - a."at") <= 24),
r AS (SELECT *, row_number() OVER (PARTITION BY ed, m ORDER BY distance, m, a) AS i, row_number() OVER (PARTITION BY ed, a ORDER BY distance, m, a) AS j FROM p),
f AS (SELECT * FROM r WHERE i = 1 AND j = 1), s AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ed = p.ed AND (f.m = p.m OR f.a = p.a))),
r2 AS (SELECT *, row_number() OVER (PARTITION BY ed, m ORDER BY distance, m, a) AS i, row_number() OVER (PARTITION BY ed, a ORDER BY distance, m, a) AS j FROM s)
SELECT ed, m, a, distance FROM f UNION ALL SELECT ed, m, a, distance FROM r2 WHERE i = 1 AND j = 1""")
def link_passages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Two rounds of the SQL are enough for the links that these rows can have."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ed"), F.lit("t").alias("text_id"), (F.col("o_orderkey") % 3).alias("letters"), F.expr("o_orderkey div 60").alias("passage"), F.col("o_orderkey").alias("at"))
    return passages.link_words(rows.where("at % 2 = 0"), rows.where("at % 2 = 1")).select("ed", "m", "a", "distance")


@query("""WITH RECURSIVE t AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey AS version, l_suppkey % 20 AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
r AS (SELECT doc_id, min(version) AS target, min(version) AS version FROM t GROUP BY doc_id
UNION SELECT r.doc_id, r.target, b.version FROM r JOIN t a ON a.doc_id = r.doc_id AND a.version = r.version JOIN t b ON b.doc_id = r.doc_id AND b.id = a.id AND b.version > r.version)
SELECT doc_id, target, version FROM r WHERE version <> target""")
def undo_dependents(spark, sf_dir):  # noqa: ANN001, ANN201
    """What depends on each document's first change, over several items."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    touches = lines.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("version"), (F.col("l_suppkey") % 20).alias("id"))
    return undo.dependents(touches, touches.groupBy("doc_id").agg(F.min("version").alias("target")))


@query(f"""{LOG}, w AS (SELECT doc_id, max(version) AS n, 1 + doc_id::BIGINT % 4 AS target FROM o GROUP BY doc_id HAVING max(version) >= 1 + doc_id::BIGINT % 4),
gone AS (SELECT doc_id, version - 1 AS version FROM p WHERE t = 'delete' AND before = 'insert'),
s AS (SELECT p.doc_id, p.version AS r, o_orderkey FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.version = p.version JOIN w ON w.doc_id = p.doc_id WHERE t = 'insert' AND p.version <> target
UNION ALL SELECT p.doc_id, n + 1, o_orderkey FROM p JOIN w ON w.doc_id = p.doc_id WHERE target = 3 AND p.version = 2)
SELECT w.doc_id, target, CASE WHEN target = 2 AND n > 2 THEN 'salvaged' ELSE 'clean' END AS outcome, CASE WHEN target = 2 AND n > 2 THEN 1 ELSE 0 END::BIGINT AS n_skipped, coalesce(string_agg(o_orderkey::VARCHAR, ' ' ORDER BY r DESC), '') AS ids
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, target, n""")
def undo_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    """One of the first four changes of each log is taken back: what was put in goes, what was taken out comes back, and what is gone already is skipped."""
    log = _log(spark, sf_dir)
    targets = log.groupBy("doc_id").agg(F.max("version").alias("n")).withColumn("target", 1 + F.col("doc_id").cast("long") % 4).where("target <= n")
    found = undo.undone(log, targets.select("doc_id", "target"), force=True)
    return found.select("doc_id", "target", "outcome", "n_skipped", F.array_join(F.transform(F.from_json("items", "array<struct<id:string>>"), lambda x: x["id"]), " ").alias("ids"))


def _lines(spark, sf_dir):  # noqa: ANN001, ANN202
    lines = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("base"))


def _shown(found):  # noqa: ANN001, ANN202
    return found.withColumn("reading", F.md5(F.array_join("reading", "\n"))).withColumn("after", F.md5("after")).select("grp", "place", "far", F.size("segments").cast("long").alias("n_segments"), "reading", "after", "is_base", "text", "n_texts")


@query("""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
d AS (SELECT doc_id, [s[i] for i in generate_series(1, len(s)) if trim(s[i]) <> '' AND list_position(s, s[i]) = i] AS l FROM s),
e AS (SELECT doc_id AS grp, l, len(l) AS n FROM d WHERE len(l) > 1),
c AS (SELECT grp, n, l, [l[2], l[1]] || l[3:] AS b, [l[n]] || l[1:n-1] AS c, l[1:n-2] || [l[n], l[n-1]] AS d FROM e),
v AS (
SELECT grp, 0 AS place, false AS far, n AS n_segments, l AS reading, NULL AS after, true AS is_base, 'a' AS text, 1 AS n_texts FROM c WHERE n <= 8
UNION ALL SELECT grp, 0, false, n, b, NULL, false, 'b', CASE WHEN n = 2 THEN 3 ELSE 1 END FROM c WHERE n <= 8
UNION ALL SELECT grp, 0, false, n, c, NULL, false, 'c', 1 FROM c WHERE n BETWEEN 3 AND 8
UNION ALL SELECT grp, 0, false, n, d, NULL, false, 'd', 1 FROM c WHERE n BETWEEN 3 AND 8
UNION ALL SELECT grp, 0, false, 2, l[1:2], NULL, true, 'a', 3 FROM c WHERE n > 8
UNION ALL SELECT grp, 0, false, 2, b[1:2], NULL, false, 'b', 1 FROM c WHERE n > 8
UNION ALL SELECT grp, n - 2, false, 2, l[n-1:], NULL, true, 'a', 2 FROM c WHERE n > 8
UNION ALL SELECT grp, n - 2, false, 2, d[n-1:], NULL, false, 'd', 1 FROM c WHERE n > 8
UNION ALL SELECT grp, n - 1, true, 1, l[n:], l[n-1], true, 'a', 3 FROM c WHERE n > 8
UNION ALL SELECT grp, n - 1, true, 1, l[n:], NULL, false, 'c', 1 FROM c WHERE n > 8)
SELECT grp, place::BIGINT AS place, far, n_segments::BIGINT AS n_segments, md5(array_to_string(reading, chr(10))) AS reading, md5(after) AS after, is_base, text, n_texts::BIGINT AS n_texts FROM v""")
def order_variants(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each document against four orders of its lines: its own, the first two lines turned round, the last line first, the last two turned round."""
    docs = _lines(spark, sf_dir).where(F.size("base") > 1).select(F.col("doc_id").alias("grp"), "base")
    n, get = F.size("base"), lambda k: F.get("base", k)
    two = F.array(get(F.lit(1)), get(F.lit(0)))
    own = {
        "a": F.col("base"), "b": F.concat(two, F.slice("base", F.lit(3), n)), "c": F.concat(F.array(get(n - 1)), F.slice("base", F.lit(1), n - 1)),
        "d": F.concat(F.slice("base", F.lit(1), n - 2), F.array(get(n - 1), get(n - 2))),
    }
    orders = docs.select("grp", F.explode(F.array(*(F.struct(F.lit(k).alias("text"), c.alias("own")) for k, c in own.items()))).alias("o")).select("grp", "o.text", "o.own")
    return _shown(order.order_variants(docs, orders))


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
k AS (SELECT *, n % 4 = 0 AS stale, n % 7 = 0 AND n % 4 <> 0 AS early FROM o),
h AS (SELECT *, sum(CASE WHEN stale OR early THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM k)
SELECT doc_id, o_orderkey::VARCHAR AS request_id, CASE WHEN stale THEN 'rejected' ELSE 'saved' END AS outcome, head::BIGINT AS version, CASE WHEN stale THEN (head % 3 > 0)::BIGINT ELSE 0 END AS n_since,
  CASE WHEN NOT stale AND head % 3 = 0 THEN (SELECT string_agg(b.o_orderkey::VARCHAR, ' ' ORDER BY b.n DESC) FROM h b WHERE b.doc_id = h.doc_id AND b.n <= h.n AND NOT b.stale AND NOT b.early) END AS ids
FROM h WHERE NOT early""")
def save_edits(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each customer's orders as edits saved in turn: every fourth is made on the version before the head, some on versions that never come."""
    from pyspark.sql.window import Window

    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(over))
    rows = rows.withColumn("stale", F.col("n") % 4 == 0).withColumn("early", (F.col("n") % 7 == 0) & ~F.col("stale"))
    head = F.sum(F.when(F.col("stale") | F.col("early"), 0).otherwise(1)).over(over)
    made_on = F.when(F.col("early"), F.lit(1 << 40)).otherwise(head - 1)
    key = F.col("o_orderkey").cast("string")
    edit = F.to_json(F.struct(F.lit("insert").alias("t"), F.array(F.struct(key.alias("id"), F.col("o_orderstatus").alias("form"))).alias("items")))
    at = F.timestamp_seconds(F.col("o_orderkey"))
    requests = rows.select(F.col("o_custkey").cast("string").alias("doc_id"), key.alias("request_id"), at.alias("at"), made_on.alias("from_version"), edit.alias("edit"))
    found = saving.save_batch(requests, 3)
    ids = F.array_join(F.transform(F.from_json("items", "array<struct<id:string>>"), lambda x: x["id"]), " ")
    return found.select("doc_id", "request_id", "outcome", "version", F.coalesce(F.size("since"), F.lit(0)).cast("long").alias("n_since"), ids.alias("ids"))
