"""Logs of edits: state at a version, each edit with its exact reverse.

An edit is one of insert (items after an id, null: at the start), delete (ids),
set (fields of an id; a null value removes the field), move (ids after an id),
split (an id's form at a code point, the rest under new_id), join (the
opposite) and replace (items in place of a run of ids). A document's edits are folded in version order; documents are
independent, so they are dealt by doc_id, and a checkpoint cuts what is folded. A task has its documents one after
another, as rows in order, and holds the state of one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and letters of one batch that a fold gives back.
ROWS, LETTERS = 2_000, 4_000_000


class Edit(ValueError):
    """An edit that does not fit the state: an unknown, repeated or misplaced id."""


def _at(items: list[dict], wanted: str) -> int:
    for i, x in enumerate(items):
        if x["id"] == wanted:
            return i
    raise Edit(f"no item {wanted}")


def _after(items: list[dict], wanted: str | None) -> int:
    return 0 if wanted is None else _at(items, wanted) + 1


def apply_edit(items: list[dict], edit: dict) -> dict:
    """Changes items in place and returns the edit that undoes it, as a list under `all` where it takes several."""
    kind = edit["t"]
    if kind == "all":
        undo = []
        try:
            for e in edit["edits"]:
                undo.append(apply_edit(items, e))
        except (Edit, KeyError):
            for e in undo[::-1]:
                apply_edit(items, e)
            raise
        return {"t": "all", "edits": undo[::-1]}
    if kind == "replace":
        first = _at(items, edit["ids"][0]) if edit["ids"] else 0
        old = items[first : first + len(edit["ids"])]
        new = [x["id"] for x in edit["items"]]
        if not edit["ids"] or [x["id"] for x in old] != edit["ids"]:
            raise Edit("what is replaced is no run")
        if len(set(new)) < len(new) or ({x["id"] for x in items} - set(edit["ids"])) & set(new):
            raise Edit("an id is there already")
        items[first : first + len(old)] = [dict(x) for x in edit["items"]]
        if not new:
            return {"t": "insert", "after": items[first - 1]["id"] if first else None, "items": old}
        return {"t": "replace", "ids": new, "items": old}
    if kind == "insert":
        new = [x["id"] for x in edit["items"]]
        if len(set(new)) < len(new) or {x["id"] for x in items} & set(new):
            raise Edit("an id is there already")
        k = _after(items, edit.get("after"))
        items[k:k] = [dict(x) for x in edit["items"]]
        return {"t": "delete", "ids": new}
    if kind in ("delete", "move"):
        places = sorted(_at(items, x) for x in edit["ids"])
        back = [{"after": items[k - 1]["id"] if k else None, "item": items[k]} for k in places]
        taken = {items[k]["id"]: items[k] for k in places}
        if kind == "delete":
            items[:] = [x for x in items if x["id"] not in taken]
            return {"t": "all", "edits": [{"t": "insert", "after": b["after"], "items": [b["item"]]} for b in back]}
        if edit.get("after") in taken:
            raise Edit("items cannot move after one of themselves")
        _after(items, edit.get("after"))
        items[:] = [x for x in items if x["id"] not in taken]
        k = _after(items, edit.get("after"))
        items[k:k] = [taken[x] for x in edit["ids"]]
        return {"t": "all", "edits": [{"t": "move", "after": b["after"], "ids": [b["item"]["id"]]} for b in back]}
    if kind not in ("set", "split", "join"):
        raise Edit(f"no edit {kind}")
    k = _at(items, edit["id"])
    item = items[k]
    if kind == "set":
        before = {f: item.get(f) for f in edit["fields"]}
        items[k] = {f: v for f, v in {**item, **edit["fields"]}.items() if v is not None}
        return {"t": "set", "id": edit["id"], "fields": before}
    if kind == "split":
        if not 0 < edit["at"] < len(item["form"]) or any(x["id"] == edit["new_id"] for x in items):
            raise Edit("no place to split")
        items[k : k + 1] = [{**item, "form": item["form"][: edit["at"]]}, {"id": edit["new_id"], "form": item["form"][edit["at"] :]}]
        return {"t": "join", "id": edit["id"]}
    if k + 1 == len(items):
        raise Edit("nothing to join")
    head, rest = item["form"], items[k + 1]
    items[k : k + 2] = [{**item, "form": head + rest["form"]}]
    undo = {"t": "split", "id": edit["id"], "at": len(head), "new_id": rest["id"]}
    others = {f: v for f, v in rest.items() if f not in ("id", "form")}
    return {"t": "all", "edits": [undo, {"t": "set", "id": rest["id"], "fields": others}]} if others else undo


def streamed(rows: DataFrame, order: list[Column | str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, key: str = "doc_id") -> DataFrame:
    """What fold makes of the rows, which it gets as tuples: those of a key together, in order. Nothing holds more of a key than fold does."""
    names, shape = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out, letters = [], 0
        for t in fold(tuples):
            out.append(t)
            letters += sum(len(x) for x in t if isinstance(x, str))
            if len(out) >= ROWS or letters >= LETTERS:
                yield batch(out)
                out, letters = [], 0
        if out:
            yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).select(*names).mapInArrow(run, schema)


def dumped(items: list[dict]) -> str:
    return json.dumps(items, sort_keys=True)


def applied(items: list[dict], edit: str) -> str | None:
    """Changes items in place and returns the reverse (JSON), or None for an edit that does not fit."""
    try:
        return json.dumps(apply_edit(items, json.loads(edit)), sort_keys=True)
    except (Edit, KeyError):
        return None


def fold_edits(log: DataFrame, checkpoints: DataFrame | None = None, every: int = 0) -> DataFrame:
    """doc_id, version, ok, reverse (JSON) of each edit of log (doc_id, version, edit as JSON), and items (JSON) of a document's last version.

    checkpoints (doc_id, version, items) gives states to start from: of each
    document the last one counts, and edits up to it are left out. every: items
    also of each version that it divides, as new checkpoints. An edit that does
    not fit leaves the state as it is, with ok false.
    """
    rows = log.select("doc_id", "version", "edit", F.lit(None).cast("string").alias("items"))
    if checkpoints is not None:
        last = checkpoints.groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("items", "version").alias("items"))
        rows = rows.unionByName(last.select("doc_id", "version", F.lit(None).cast("string").alias("edit"), "items"))

    def fold(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for doc, own in groupby(tuples, itemgetter(0)):
            items, begin = [], None
            held: list[list] = []  # the rows of the latest version, until it is known whether it is the last
            for _, version, edit, at_point in own:
                if edit is None:
                    items, begin = json.loads(at_point), version
                    continue
                if begin is not None and version <= begin:
                    continue
                if held:
                    again, kept = held[-1][1] == version, every and held[-1][1] % every == 0
                    if again or kept:
                        held[-1][3] = dumped(items)
                    if not again:
                        yield from ((*r[:3], r[3] if kept else None, r[4]) for r in held)
                        held = []
                reverse = applied(items, edit)
                held.append([doc, version, reverse is not None, None, reverse])
            if held:
                held[-1][3] = dumped(items)
                yield from map(tuple, held)

    return streamed(rows, [F.col("edit").isNotNull(), F.asc_nulls_last("version"), "edit"], fold, "doc_id string, version long, ok boolean, items string, reverse string")


def rebuilt(log: DataFrame, checkpoints: DataFrame, versions: DataFrame) -> DataFrame:
    """doc_id, version, items: the state at the version asked for (one a document), from the checkpoint at or before it."""
    none = F.lit(None).cast("string")
    wanted = versions.select("doc_id", F.lit(0).alias("what"), "version", none.alias("value"))
    points = checkpoints.select("doc_id", F.lit(1).alias("what"), "version", F.col("items").alias("value"))
    rows = wanted.unionByName(points).unionByName(log.select("doc_id", F.lit(2).alias("what"), "version", F.col("edit").alias("value")))

    def fold(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for doc, own in groupby(tuples, itemgetter(0)):
            what, end = next(own)[1:3]
            if what:
                continue  # nothing is asked for
            begin, point, items = None, "[]", None
            for _, what, version, value in own:
                if end is None or version is None or version > end:
                    continue
                if what == 1:
                    begin, point = version, value
                elif begin is None or version > begin:
                    items = json.loads(point) if items is None else items
                    applied(items, value)
            yield doc, end, point if items is None else dumped(items)

    return streamed(rows, ["what", "version", "value"], fold, "doc_id string, version long, items string")


def composed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One change for each of keys: its edits in order of version, and its reverses the other way round."""
    rows = changes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("version", "edit", "reverse"))).alias("c"), F.max("version").alias("version"))
    return rows.select(*keys, "version", F.transform("c", lambda x: x["edit"]).alias("edits"), F.reverse(F.transform("c", lambda x: x["reverse"])).alias("reverses"))
