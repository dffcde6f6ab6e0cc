"""Saving edits against a document's head: a request says which version it was made on.

requests: doc_id, request_id, at, from_version (0: the empty document), edit (JSON). Each gets one row:

- saved: it was made on the head and fits; version is the new head's, reverse undoes it
- unfit: it was made on the head and does not fit its state
- rejected: the document had moved on; since holds the edits (JSON, in order) that came after
  from_version, as far as the last checkpoint, and version is the head that is there
- repeated: the request was saved before, since the last checkpoint; version is the one it made

A request made on a version that is not there yet waits for it and has its row then. Requests of
one document that come together go by from_version, at, request_id. Every so many versions items
holds the state (JSON), a checkpoint for edits.rebuilt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.edits import Edit, apply_edit, streamed

#: Versions from one checkpoint to the next.
EVERY = 50
RESULT = "doc_id string, request_id string, outcome string, version long, reverse string, since array<string>, items string"
_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


class Request(NamedTuple):
    from_version: int
    at: pd.Timestamp
    request_id: str
    edit: str


class Head:
    """A document as its last checkpoint and the edits since, [(request_id, edit)]."""

    def __init__(self, base: int, items: list[dict], since: list[tuple[str, str]]) -> None:
        self.base, self.at_base, self.since = base, json.dumps(items, sort_keys=True), list(since)
        self.items = items
        for _, edit in since:
            apply_edit(self.items, json.loads(edit))
        self.made = {r: base + i for i, (r, _) in enumerate(since, 1)}

    @property
    def version(self) -> int:
        return self.base + len(self.since)

    def take(self, r: Request, every: int) -> tuple:
        """outcome, version, reverse, since, items of a request whose version is there."""
        if r.request_id in self.made:
            return "repeated", self.made[r.request_id], None, None, None
        if r.from_version != self.version:
            return "rejected", self.version, None, [e for _, e in self.since[max(r.from_version - self.base, 0) :]], None
        try:
            reverse = json.dumps(apply_edit(self.items, json.loads(r.edit)), sort_keys=True)
        except (Edit, KeyError, TypeError, ValueError):
            return "unfit", self.version, None, None, None
        self.since.append((r.request_id, r.edit))
        self.made[r.request_id] = version = self.version
        if version % every:
            return "saved", version, reverse, None, None
        # the checkpoint takes the place of the edits before it
        self.base, self.at_base, self.since = version, json.dumps(self.items, sort_keys=True), []
        self.made = {r.request_id: version}
        return "saved", version, reverse, None, self.at_base


def _taken(doc: str, head: Head, requests: list[Request], every: int) -> tuple[list[tuple], list[Request]]:
    """The rows of requests, and those that go on waiting."""
    out, waiting = [], []
    for r in sorted(requests, key=lambda r: (r.from_version, r.at, r.request_id)):
        if r.from_version > head.version:
            waiting.append(r)
        else:
            out.append((doc, r.request_id, *head.take(r, every)))
    return out, waiting


def _requests(frame: pd.DataFrame) -> list[Request]:
    return [Request(*r) for r in frame[list(Request._fields)].itertuples(index=False)]


def save_batch(requests: DataFrame, every: int = EVERY) -> DataFrame:
    """All requests at once, on empty documents; those that still wait for their version have no row."""

    def fold(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for doc, own in groupby(tuples, itemgetter(0)):
            head = Head(0, [], [])
            for _, version, request, edit, _ in own:
                if version <= head.version:
                    yield doc, request, *head.take(Request(version, None, request, edit), every)

    rows = requests.select("doc_id", "from_version", "request_id", "edit", "at")
    return streamed(rows, ["from_version", "at", "request_id", "edit"], fold, RESULT)


class _Saving(StatefulProcessor):
    """Of each document: the last checkpoint, the edits since (at most as many as lie between two), and what waits.

    A batch adds to the edits; the state of the whole document is written only at a checkpoint.
    """

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "version long, items string, last_request string")
        self.edits = handle.getListState("edits", "request_id string, edit string")
        self.waiting = handle.getListState("waiting", "from_version long, at timestamp, request_id string, edit string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        base, items, last = self.head.get() if self.head.exists() else (0, "[]", None)
        head = Head(base, json.loads(items), [tuple(x) for x in self.edits.get()] if self.edits.exists() else [])
        if last is not None:
            head.made[last] = base
        waited = [Request(*x) for x in self.waiting.get()] if self.waiting.exists() else []
        known = len(head.since)
        new = [r for frame in rows for r in _requests(frame)]
        out, waiting = _taken(key[0], head, [r._replace(at=pd.Timestamp(r.at)) for r in waited + new], self.every)
        if head.base != base:
            at_base = next((r for r, v in head.made.items() if v == head.base), None)
            self.head.update((head.base, head.at_base, at_base))
            self.edits.clear()
            known = 0
        for x in head.since[known:]:
            self.edits.appendValue(x)
        if waiting or waited:
            self.waiting.clear()
        for r in waiting:
            self.waiting.appendValue((r.from_version, r.at.to_pydatetime(), r.request_id, r.edit))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def save_stream(requests: DataFrame, every: int = EVERY) -> DataFrame:
    """The same over a stream. Its state goes to the query's checkpoint folder, so a query started anew goes on from there.

    The session's state store must be one that keeps lists (RocksDB's).
    """
    rows = requests.select("doc_id", *Request._fields)
    return rows.groupBy("doc_id").transformWithStateInPandas(_Saving(every), RESULT, "append", "None")
