"""Undoing earlier changes: what depends on them, and as much of them as can still be taken back.

A change is one row of a log (doc_id, version, edit as JSON; see edits). It is undone by
applying its reverse to the present state as a new change, so a history is never rewritten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.keeping import kept
from .edits import Edit, applied, apply_edit, dumped, streamed

#: Fields of an edit's JSON, as far as they name ids.
_FIELDS = "t: string, id: string, new_id: string, after: string, ids: array<string>, items: array<struct<id: string>>"
_INNER = f"array<struct<{_FIELDS}>>"
_OUTER = f"array<struct<{_FIELDS}, edits: {_INNER}>>"
_EDIT = f"struct<{_FIELDS}, edits: {_OUTER}>"


def _ids(e: Column) -> Column:
    none = F.array().cast("array<string>")
    listed = F.concat(F.array(e["id"], e["new_id"], e["after"]), F.coalesce(e["ids"], none), F.coalesce(e["items"]["id"], none))
    return F.filter(listed, lambda x: x.isNotNull())


def touched(edit: Column | str) -> Column:
    """The ids that an edit (JSON) changes or stands beside, each once; those of edits under `all`, too, two levels deep."""
    e = F.from_json(edit, _EDIT)
    outer = F.coalesce(e["edits"], F.array().cast(_OUTER))
    inner = F.flatten(F.transform(outer, lambda x: F.coalesce(x["edits"], F.array().cast(_INNER))))
    return F.array_distinct(F.concat(_ids(e), F.flatten(F.transform(outer, _ids)), F.flatten(F.transform(inner, _ids))))


def dependents(touches: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, target, version of all changes that depend on a target: later ones that touch an id which the target, or what depends on it, touched before.

    touches: doc_id, version, id; targets: doc_id, target (a version). Of each target and id only
    the first version from which it is reached is held, so the state has at most one row for each
    id of the document; a round takes all later changes of the ids it reached, however many,
    so rounds are as many as the ids from one to the next, not as the changes.
    """
    touches = kept(touches.select("doc_id", "version", "id").distinct())
    start = targets.select("doc_id", "target").distinct()
    reached = kept(start.join(touches.withColumnRenamed("version", "since"), (start["doc_id"] == touches["doc_id"]) & (F.col("since") == F.col("target"))).select(start["doc_id"], "target", "id", "since"))
    new = reached
    while not new.isEmpty():
        later = new.join(touches, ["doc_id", "id"]).where("version > since").select("doc_id", "target", "version").distinct()
        found = later.join(touches, ["doc_id", "version"]).groupBy("doc_id", "target", "id").agg(F.min("version").alias("since"))
        known = reached.groupBy("doc_id", "target", "id").agg(F.min("since").alias("known"))
        new = kept(found.join(known, ["doc_id", "target", "id"], "left").where("known IS NULL OR since < known").drop("known"))
        reached = kept(reached.unionByName(new).groupBy("doc_id", "target", "id").agg(F.min("since").alias("since")))
    hit = reached.join(touches, ["doc_id", "id"]).where("version > since")
    return hit.select("doc_id", "target", "version").distinct()


def single_edits(edit: dict) -> list[dict]:
    """The edits that one is made of, in order."""
    return [x for e in edit["edits"] for x in single_edits(e)] if edit["t"] == "all" else [edit]


class _Places:
    """Where what is gone stood in earlier states: an id gives way to the nearest one before it that is still there."""

    def __init__(self, states: list[list[dict]]) -> None:
        self.orders = [[x["id"] for x in s] for s in states]
        self.places = [{x: i for i, x in enumerate(o)} for o in self.orders]

    def anchor(self, wanted: str | None, there: set[str]) -> tuple[bool, str | None]:
        """Whether a place is known, and what stands before it (None: it is the start)."""
        if wanted is None or wanted in there:
            return True, wanted
        for order, places in zip(self.orders, self.places, strict=True):
            if wanted in places:
                return True, next((x for x in reversed(order[: places[wanted]]) if x in there), None)
        return False, None


def _fitted(items: list[dict], edit: dict, places: _Places) -> dict | None:
    """What of a single edit still has something to act on, or None."""
    order = [x["id"] for x in items]
    there = set(order)
    if "id" in edit:  # set, split and join
        return edit if edit["id"] in there else None
    fits = dict(edit)
    if "items" in edit:
        stays = set(edit.get("ids", ()))
        fits["items"] = [x for x in edit["items"] if x["id"] not in there or x["id"] in stays]
    if "ids" in edit:
        fits["ids"] = [x for x in edit["ids"] if x in there]
        if not fits["ids"]:
            return None
        first = order.index(fits["ids"][0])
        if edit["t"] != "delete" and order[first : first + len(fits["ids"])] != fits["ids"]:
            return None
    elif not fits["items"]:
        return None
    if edit["t"] in ("insert", "move"):
        known, fits["after"] = places.anchor(edit.get("after"), there)
        if not known or fits["after"] in fits.get("ids", ()):
            return None
    return fits


def salvage(items: list[dict], edits: list[dict], references: list[list[dict]]) -> tuple[list[dict], int]:
    """Applies to items, in place, as much of the edits as fits: what was done, and how many could not be.

    Ids that are gone are left out, items that are back already are not put in twice, and an anchor
    that is gone gives way to the nearest id before it in the first of the references that has it.
    """
    places, done, skipped = _Places(references), [], 0
    for edit in edits:
        fits = _fitted(items, edit, places)
        if fits is None:
            skipped += 1
            continue
        try:
            apply_edit(items, fits)
            done.append(fits)
        except (Edit, KeyError):
            skipped += 1
    return done, skipped


def revert_edits(now: list[dict], then: list[dict]) -> list[dict]:
    """The one edit, if any, that makes the state what it was, ids included."""
    if not now:
        return [{"t": "insert", "after": None, "items": then}] if then else []
    ids = [x["id"] for x in now]
    return [{"t": "replace", "ids": ids, "items": then} if then else {"t": "delete", "ids": ids}]


class _Target:
    """A change to be undone, with what a pass over its document's log finds of it."""

    def __init__(self, version: int | None) -> None:
        self.version, self.ids, self.clash, self.reverse = version, set(), False, None
        self.before: list[dict] = []
        self.after: list[dict] = []


class _Document:
    """The state of a document, as far as it is needed: edits wait until it is, and a checkpoint takes their place."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.version: int | None = None
        self.waiting: list[str] = []
        self.point: str | None = None

    def state(self) -> list[dict]:
        for edit in self.waiting:
            applied(self.items, edit)
        self.waiting = []
        return self.items

    def start_from(self, point: str) -> None:
        self.items, self.waiting, self.point = json.loads(point), [], None

    def checkpoint(self, version: int, point: str) -> None:
        """A state at the version that is there; or at a later one: then it counts once the log goes on."""
        if version == self.version:
            self.start_from(point)
        else:
            self.point = point

    def edit(self, version: int, edit: str, targets: list[_Target]) -> None:
        if self.point is not None:
            self.start_from(self.point)
        self.version = version
        if not targets:
            self.waiting.append(edit)
            return
        before = list(self.state())
        reverse = applied(self.items, edit)
        for t in targets:
            t.before, t.reverse, t.after = before, reverse, list(self.items)


def _taken_back(now: list[dict], t: _Target, force: bool) -> tuple:
    """outcome, edits, n_skipped, items of a target, from the present state, which stays."""
    items, outcome, done, skipped = list(now), "unknown", [], 0
    if t.reverse is not None:
        edits = single_edits(json.loads(t.reverse))
        outcome = "refused" if t.clash else "clean"
        if outcome == "clean":
            try:
                apply_edit(items, {"t": "all", "edits": edits})
                done = edits
            except (Edit, KeyError):
                outcome = "refused"
        if outcome == "refused" and force:
            outcome = "salvaged"
            done, skipped = salvage(items, edits, [t.before, t.after])
    return outcome, json.dumps(done, sort_keys=True), skipped, dumped(items)


def undone(log: DataFrame, targets: DataFrame, *, force: bool = False, checkpoints: DataFrame | None = None) -> DataFrame:
    """doc_id, target, outcome, edits (JSON list), n_skipped, items (JSON): each target (doc_id, target) taken back, by itself.

    outcome is clean (no later change touches what the target touched, and its reverse applies),
    refused (one does), salvaged (the same, with force: what still fits is taken back), or
    unknown (there is no such change, or it did not fit when it was made). A refused or unknown one
    leaves the state as it is. checkpoints (doc_id, version, items): states to start from.

    One pass over the log finds the reverse of the target as it was applied, the states before and
    after it, later changes that touch its ids, and the present state. Only documents in which
    something is undone are folded.
    """
    none = F.array().cast("array<string>")
    rows = targets.select("doc_id", F.lit(0).alias("what"), F.col("target").alias("version"), F.lit(None).cast("string").alias("value"), none.alias("ids")).distinct()
    rows = rows.unionByName(log.select("doc_id", F.lit(1).alias("what"), "version", F.col("edit").alias("value"), touched("edit").alias("ids")))
    if checkpoints is not None:
        rows = rows.unionByName(checkpoints.select("doc_id", F.lit(2).alias("what"), "version", F.col("items").alias("value"), none.alias("ids")))

    def fold(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for doc, own in groupby(tuples, itemgetter(0)):
            wanted: list[_Target] = []
            document = _Document()
            for _, what, version, value, ids in own:
                if what == 0:
                    wanted.append(_Target(version))
                elif not wanted:
                    break  # nothing is undone here
                elif version is None:
                    continue
                elif what == 2:
                    document.checkpoint(version, value)
                    for t in wanted:
                        if t.version == version:
                            t.after = json.loads(value)
                else:
                    here = [t for t in wanted if t.version == version]
                    document.edit(version, value, here)
                    for t in here:
                        t.ids.update(ids or ())
                    for t in wanted:
                        t.clash = t.clash or t.version is not None and version > t.version and not t.ids.isdisjoint(ids or ())
            now = document.state() if wanted else []
            yield from ((doc, t.version, *_taken_back(now, t, force)) for t in wanted)

    order = [F.col("what") > 0, "version", "what"]
    return streamed(rows, order, fold, "doc_id string, target long, outcome string, edits string, n_skipped long, items string")
