import json
import random

import pytest

from vellum.operators import edits, passages


def random_edit(rng, items, n):
    ids = [x["id"] for x in items]
    kind = rng.choice(["insert", "delete", "set", "move", "split", "join", "replace", "all"])
    if kind == "insert" or len(ids) < 3:
        return {"t": "insert", "after": rng.choice([None, *ids]), "items": [{"id": f"n{n}", "form": "word"}, {"id": f"m{n}", "form": "ab", "lang": "la"}]}
    one = rng.choice(ids)
    some = rng.sample(ids, 2)
    at = rng.randrange(len(ids) - 1)
    return {
        "replace": {"t": "replace", "ids": ids[at : at + 2], "items": rng.choice([[], [{"id": f"r{n}", "form": "new"}, {"id": ids[at], "form": "old"}]])},
        "all": {"t": "all", "edits": [{"t": "delete", "ids": [one]}, {"t": "delete", "ids": [rng.choice([one, *(i for i in ids if i != one)])]}]},
        "delete": {"t": "delete", "ids": some}, "set": {"t": "set", "id": one, "fields": {"form": "new", "lang": rng.choice([None, "grc"])}},
        "move": {"t": "move", "ids": some, "after": rng.choice([None, *(i for i in ids if i not in some)])},
        "split": {"t": "split", "id": one, "at": 1, "new_id": f"s{n}"}, "join": {"t": "join", "id": one},
    }[kind]


def test_reverse_restores_exactly():
    rng = random.Random(4)
    for _ in range(200):
        items, undo, states = [], [], []
        for n in range(12):
            trial = list(items)
            try:
                back = edits.apply_edit(trial, random_edit(rng, items, n))
            except edits.Edit:
                assert trial == items  # what does not fit changes nothing
                continue
            states.append(items)
            undo.append(json.loads(json.dumps(back)))
            items = trial
        for back, state in zip(undo[::-1], states[::-1], strict=True):
            edits.apply_edit(items, back)
            assert items == state


def test_errors():
    items = [{"id": "a", "form": "xy"}]
    for bad in ({"t": "delete", "ids": ["z"]}, {"t": "insert", "after": None, "items": [{"id": "a"}]}, {"t": "join", "id": "a"}, {"t": "split", "id": "a", "at": 2, "new_id": "b"}, {"t": "move", "ids": ["a"], "after": "a"}, {"t": "move", "ids": ["a"], "after": "z"}, {"t": "replace", "ids": [], "items": []}, {"t": "replace", "ids": ["a", "b"], "items": []}):
        with pytest.raises(edits.Edit):
            edits.apply_edit(items, bad)
    assert items == [{"id": "a", "form": "xy"}]


def test_fold_with_checkpoint(spark):
    log = [("d", v, json.dumps(e)) for v, e in enumerate([
        {"t": "insert", "after": None, "items": [{"id": "a", "form": "one"}, {"id": "b", "form": "two"}]},
        {"t": "delete", "ids": ["z"]}, {"t": "set", "id": "b", "fields": {"form": "TWO"}}, {"t": "move", "ids": ["b"], "after": None},
    ], 1)]
    df = spark.createDataFrame(log, "doc_id string, version long, edit string")
    got = {r["version"]: r for r in edits.fold_edits(df, every=1).collect()}
    assert [got[v]["ok"] for v in (1, 2, 3, 4)] == [True, False, True, True]
    assert [x["form"] for x in json.loads(got[4]["items"])] == ["TWO", "one"]
    point = spark.createDataFrame([("d", 3, got[3]["items"])], "doc_id string, version long, items string")
    again = edits.fold_edits(df, point).collect()
    assert [(r["version"], r["items"]) for r in again] == [(4, got[4]["items"])]


def test_passages(spark):
    rows = [("e", s, 30, s not in (0, 5)) for s in range(16)]
    got = passages.plan_passages(spark.createDataFrame(rows, "doc_id string, segment long, n_words long, uncut boolean")).collect()
    assert {r["segment"]: r["passage"] for r in got} == {s: 0 if s < 5 else 5 if s < 13 else 13 for s in range(16)}


def test_group_sigla(spark):
    read = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A"]), (3, []), (4, None), (5, ["D", "C", "B", "A"]), (6, ["A", "B", "C"])], "site int, texts array<string>")
    groups = spark.createDataFrame([("β", ["A", "B"]), ("γ", ["C", "D", "B"]), ("δ", ["C", "D"]), ("ε", []), ("ζ", ["A", "Z"])], "siglum string, members array<string>")
    got = {r["site"]: r["texts"] for r in passages.group_sigla(read, groups).collect()}
    assert got == {1: ["C", "β"], 2: ["A"], 3: [], 4: None, 5: ["A", "γ"], 6: ["C", "β"]}
    assert passages.group_sigla(read, groups.limit(0)).where("texts IS NULL").count() == 1


def test_documents_are_folded_as_rows_in_order(spark):
    """No group is handed to Python by itself, however many there are; the checkpoint at or before the version asked for counts."""
    put = lambda v: json.dumps({"t": "insert", "after": None, "items": [{"id": f"i{v}"}]})
    log = spark.createDataFrame([(f"d{d}", v, put(v)) for d in range(50) for v in range(1, 10)], "doc_id string, version long, edit string")
    points = spark.createDataFrame([("d1", 3, '[{"id": "x"}]'), ("d1", 5, '[{"id": "y"}]'), ("d1", 8, '[{"id": "z"}]'), ("d2", 6, '[{"id": "w"}]')], "doc_id string, version long, items string")
    wanted = spark.createDataFrame([(f"d{d}", 6) for d in range(40)] + [("none", 6)], "doc_id string, version long")
    found = edits.rebuilt(log, points, wanted)
    got = {r["doc_id"]: [x["id"] for x in json.loads(r["items"])] for r in found.collect()}
    plain = [f"i{v}" for v in range(6, 0, -1)]
    assert got == {f"d{d}": plain for d in range(40)} | {"d1": ["i6", "y"], "d2": ["w"], "none": []}
    for df in (found, edits.fold_edits(log, points)):
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
