"""Keyed streams: debounce, fixed windows from the first hit, sessions and change marks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def changes(rows: DataFrame, kinds: dict[str, str], at: str) -> DataFrame:
    """Marks (kind, record, at) of the rows changed: one for each of kinds, a name and the column with the record's id."""
    marks = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("record")) for k, c in kinds.items()))
    return rows.select(F.col(at).alias("at"), F.explode(marks).alias("m")).select("m.kind", "m.record", "at").where("record IS NOT NULL")


def fan_out(changed: DataFrame, routes: dict[str, tuple[str, DataFrame | None, str | None]]) -> DataFrame:
    """kind, record of what a change makes to be written anew, each once: by the changed column itself, or through a table joined on it.

    Holds for a stream of changes, too: the tables are static sides. Duplicates are then dropped within the batch.
    """
    parts = []
    for kind, (column, via, target) in routes.items():
        rows = changed.select(column) if via is None else changed.select(column).join(via.select(column, target), column)
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(target or column).alias("record")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.where("record IS NOT NULL").distinct()


def in_order(rows: DataFrame, keys: list[str], version: str, arrival: list[str]) -> DataFrame:
    """Adds verdict: late for a row whose version is not above the highest that came before it, else apply."""
    over = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    head = F.max(version).over(over)
    return rows.withColumn("verdict", F.when(head.isNull() | (head < F.col(version)), "apply").otherwise("late"))


def quiet(marks: DataFrame, now: str, delay_s: int) -> DataFrame:
    """Batch form of debounce: keys whose last mark is at least delay_s before now."""
    last = marks.groupBy("kind", "record").agg(F.max("at").alias("at"))
    return last.where(F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("at").cast("timestamp")) >= delay_s * 1_000_000)


def debounce(marks: DataFrame, delay_s: int, late: str = "1 hour") -> DataFrame:
    """Emits a key's last mark once event time has passed it by delay_s; marks is a stream of kind, record, at.

    The state of a key is one time. A mark that comes later than `late` is dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"kind": [key[0]], "record": [key[1]], "at": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for frame in frames:
            last = max(last, int(frame["at"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + delay_s * 1000, state.getCurrentWatermarkMs() + 1))

    marked = marks.withWatermark("at", late)
    return marked.groupBy("kind", "record").applyInPandasWithState(run, "kind string, record string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _limited(times: list[int], start: int, count: int, window_us: int, limit: int) -> tuple[list[bool], int, int]:
    allowed = []
    for t in times:
        if count == 0 or t - start >= window_us:
            start, count = t, 0
        count += 1
        allowed.append(count <= limit)
    return allowed, start, count


def rate_limit_batch(hits: DataFrame, key: str, at: str, limit: int, window_s: int) -> DataFrame:
    """Adds allowed: a window opens with the first hit and admits so many.

    A task reads the hits of its keys in order and holds the window of one, so a key
    may have any number of them. A hit without a time comes last and falls in the window that is open.
    """
    window_us = window_s * 1_000_000
    schema = f"{key} {hits.schema[key].dataType.simpleString()}, hit_id {hits.schema['hit_id'].dataType.simpleString()}, allowed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, start, count = None, None, 0
        for batch in batches:
            keys, ids, times = batch.columns
            allowed = []
            for k, t in zip(keys.to_pylist(), times.cast(pa.int64()).to_pylist(), strict=True):
                if k != of:
                    of, count = k, 0
                if count == 0 or t is not None and t - start >= window_us:
                    start, count = t, 0
                count += 1
                allowed.append(count <= limit)
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(allowed, pa.bool_())], names=[key, "hit_id", "allowed"])

    rows = hits.select(key, "hit_id", F.col(at).cast("timestamp_ntz").alias(at))
    return rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last(at), "hit_id").mapInArrow(run, schema)


def rate_limit(hits: DataFrame, key: str, at: str, limit: int, window_s: int) -> DataFrame:
    """The same over a stream; the state of a key is its window's start and count. Rows of a batch go by their time."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values([at, "hit_id"])
        allowed, start, count = _limited((rows[at].astype("int64") // 1000).tolist(), start, count, window_s * 1_000_000, limit)
        state.update((start, count))
        yield pd.DataFrame({key: k[0], "hit_id": rows["hit_id"], "allowed": allowed})

    schema = f"{key} {hits.schema[key].dataType.simpleString()}, hit_id {hits.schema['hit_id'].dataType.simpleString()}, allowed boolean"
    return hits.select(key, "hit_id", at).groupBy(key).applyInPandasWithState(run, schema, "start long, count long", "append", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, user: str, at: str, pause: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that a pause has closed: first, last bound and rows."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    found = stream.groupBy(user, F.session_window(at, pause).alias("w")).agg(F.count("*").alias("n"))
    return found.select(user, F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "n")
