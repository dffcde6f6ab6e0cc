import json
import random

from pyspark.sql import functions as F

from tests.test_edits import random_edit
from vellum.operators import edits, undo

LOG = "doc_id string, version long, edit string"


def fold(log, n=None):
    items = []
    for _, v, e in log:
        if n is None or v <= n:
            try:
                edits.apply_edit(items, json.loads(e))
            except edits.Edit:
                pass
    return items


def ids_of(e):
    if e["t"] == "all":
        return {x for y in e["edits"] for x in ids_of(y)}
    return {*e.get("ids", ()), *(x["id"] for x in e.get("items", ())), *(e[k] for k in ("id", "new_id", "after") if e.get(k))}


def logs(seed, n_docs, n_edits):
    rng, out = random.Random(seed), []
    for d in range(n_docs):
        items, log = [], []
        for v in range(1, n_edits + 1):
            e = random_edit(rng, items, v)
            log.append((f"d{d}", v, json.dumps(e)))
            try:
                edits.apply_edit(items, e)
            except edits.Edit:
                pass
        out.append(log)
    return out


def test_touched(spark):
    rng, rows = random.Random(1), []
    items = [{"id": c, "form": "ab"} for c in "abcdef"]
    for n in range(60):
        e = random_edit(rng, items, n)
        rows.append((json.dumps({"t": "all", "edits": [e]} if n % 3 == 0 else e), sorted(ids_of(e))))
    got = spark.createDataFrame(rows, "e string, want array<string>").select(F.array_sort(undo.touched("e")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_dependents_follow_ids_however_far(spark):
    rng, rows, want = random.Random(2), [], set()
    for d in range(12):
        touched = {v: {rng.randrange(14) for _ in range(rng.choice([1, 2]))} for v in range(1, 15)}
        rows += [(d, v, i) for v, ids in touched.items() for i in ids]
        for target in (1, 4):
            tainted = set(touched[target])
            for v in range(target + 1, 15):
                if touched[v] & tainted:
                    tainted |= touched[v]
                    want.add((d, target, v))
    rows += [(99, v, i) for v in range(1, 9) for i in (v, v + 1)]  # each only by way of the one before
    want |= {(99, 1, v) for v in range(2, 9)} | {(99, 4, v) for v in range(5, 9)}
    touches = spark.createDataFrame(rows, "doc_id long, version long, id long")
    targets = touches.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("target"))
    got = [tuple(r) for r in undo.dependents(touches, targets).select("doc_id", "target", "version").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert undo.dependents(touches.limit(0), targets).count() == 0


def test_undone_is_the_log_without_the_change(spark):
    all_logs = logs(5, 40, 9)
    targets = [(log[0][0], 1 + i % 6) for i, log in enumerate(all_logs)] + [("none", 1)]
    df = spark.createDataFrame([r for log in all_logs for r in log], LOG)
    wanted = spark.createDataFrame(targets, "doc_id string, target long")
    got = {r["doc_id"]: r for r in undo.undone(df, wanted).collect()}
    forced = {r["doc_id"]: r for r in undo.undone(df, wanted, force=True).collect()}
    assert got["none"]["outcome"] == "unknown" and set(got) == {d for d, _ in targets}
    seen = set()
    for log, (doc, target) in zip(all_logs, targets, strict=False):
        r, now = got[doc], fold(log)
        seen.add(r["outcome"])
        edit = json.loads(log[target - 1][2])
        own = ids_of(edit)
        clash = any(own & ids_of(json.loads(e)) for _, v, e in log if v > target)
        if r["outcome"] in ("unknown", "refused"):
            assert json.loads(r["items"]) == now
            assert r["outcome"] == "unknown" or forced[doc]["outcome"] == "salvaged"
        else:
            assert not clash and r["items"] == forced[doc]["items"]
            if edit["t"] in ("insert", "set", "split"):
                assert json.loads(r["items"]) == fold([x for x in log if x[1] != target])
        state = fold(log)
        for e in json.loads(forced[doc]["edits"]):
            edits.apply_edit(state, e)  # what was done is edits that apply one after the other
        assert state == json.loads(forced[doc]["items"])
    assert {"clean", "refused"} <= seen


def test_salvage():
    def run(now, reverse, references=()):
        items = [{"id": c, "form": c} for c in now]
        done, skipped = undo.salvage(items, reverse, [[{"id": c, "form": c} for c in r] for r in references])
        return "".join(x["id"] for x in items), len(done), skipped

    put = lambda after, *ids: {"t": "insert", "after": after, "items": [{"id": x, "form": x} for x in ids]}
    assert run("ade", [put("c", "x")], ["abcde"]) == ("axde", 1, 0)  # c and b are gone
    assert run("de", [put("c", "x")], ["abcde"]) == ("xde", 1, 0)
    assert run("ade", [put("q", "x")], ["abcde"]) == ("ade", 0, 1)  # nobody knows q's place
    assert run("axd", [put("a", "x", "y")]) == ("ayxd", 1, 0)  # x is back already
    assert run("axd", [put("a", "x")]) == ("axd", 0, 1)
    assert run("abc", [{"t": "delete", "ids": ["b", "q"]}, {"t": "delete", "ids": ["q"]}]) == ("ac", 1, 1)
    assert run("abcd", [{"t": "move", "ids": ["b", "d"], "after": None}]) == ("abcd", 0, 1)  # no longer together
    assert run("abcd", [{"t": "move", "ids": ["c", "q", "d"], "after": None}]) == ("cdab", 1, 0)
    assert run("abcd", [{"t": "replace", "ids": ["b", "c"], "items": [{"id": "c", "form": "c"}, {"id": "d", "form": "d"}]}]) == ("acd", 1, 0)
    assert run("ab", [{"t": "set", "id": "q", "fields": {}}, {"t": "join", "id": "b"}]) == ("ab", 0, 2)


def test_revert():
    one, two = [{"id": "a", "form": "a"}], [{"id": "b", "form": "b"}, {"id": "a", "form": "c"}]
    for now in ([], one, two):
        for then in ([], one, two):
            items = [dict(x) for x in now]
            for e in undo.revert_edits(now, then):
                edits.apply_edit(items, e)
            assert items == then


def test_undone_in_one_pass(spark):
    """Two targets of one document are taken back each by itself; checkpoints among the edits change nothing, one beyond the log does not count."""
    log = logs(3, 12, 9)
    df = spark.createDataFrame([r for x in log for r in x], LOG)
    wanted = spark.createDataFrame([(x[0][0], t) for x in log for t in (2, 5)], "doc_id string, target long")
    points = [(x[0][0], v, json.dumps(fold([r for r in x if r[1] <= v]), sort_keys=True)) for x in log for v in (1, 5, 7)] + [(log[0][0][0], 99, "[]")]
    points = spark.createDataFrame(points, "doc_id string, version long, items string")
    plain = undo.undone(df, wanted, force=True)
    got = {(r["doc_id"], r["target"]): tuple(r) for r in plain.collect()}
    assert len(got) == 24 and plain.count() == 24
    assert {(r["doc_id"], r["target"]): tuple(r) for r in undo.undone(df, wanted, force=True, checkpoints=points).collect()} == got
    for t in (2, 5):
        alone = undo.undone(df, wanted.where(f"target = {t}"), force=True).collect()
        assert {(r["doc_id"], t): tuple(r) for r in alone} == {k: v for k, v in got.items() if k[1] == t}
    assert "FlatMapGroups" not in plain._jdf.queryExecution().toString()
