"""Suffix-array dedup: removes every byte covered by a WINDOW-byte string that also starts anywhere else.

1. Texts are dealt to blocks by their SHA-256, so that equal texts meet; a text
   of WINDOW bytes or more that occurs twice is removed whole, and one copy of it
   takes part in what follows.
2. Anchors: of each window's grams of GRAM bytes the one with the least hash is
   picked (the leftmost of equals). Equal windows pick the same gram, so windows
   that repeat have an anchor whose hash repeats. Anchors are counted by hash and
   by a hash of their context, the bytes that windows around the anchor span.
3. A context that occurs twice is covered whole. Contexts that are alone, in a
   group of anchors with other contexts, are fetched and sorted: the suffixes of
   the group's contexts by linear grouping (suffix_array), where the bytes that
   all of them share around the anchor are one symbol, and a suffix that shares
   WINDOW bytes or more with its neighbour in order covers what it shares.
4. A group of more than GROUP different contexts is not sorted in one task: its
   windows are divided into those that start further left and further right of
   the anchor, contexts are grouped anew by the bytes that all windows of their
   half hold, and so on down to single windows, which need no sorting.

Contexts are compared by 128 bits of hash (anchor and context) and texts by
SHA-256; what is sorted is compared byte by byte.

Defined results: null text counts as empty; texts shorter than WINDOW lose bytes
never; an empty table gives no rows; rows that repeat a doc_id are judged each
by its text; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import narrow, shuffle_width, stored, unused
from .suffix_array import common_prefixes, suffix_array

WINDOW, GRAM = 200, 48
REACH = WINDOW - GRAM
GROUP = 2000
BLOCK_BYTES = 8 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.frombuffer(hashlib.shake_128(b"anchor bytes").digest(2048), "<u8")
_POSITION = np.uint64(0xFFFFFFFF)

ANCHOR = "block long, hash long, context long, n long, tid long, pos int"
CONTEXT = "hash binary, block long, tid long, pos int, left int, bytes binary, n long, low int, high int"
SPANS = "block long, hash long, context long, tid long, spans array<int>"
CONTEXT_FIELDS = [("hash", pa.binary()), ("block", pa.int64()), ("tid", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("bytes", pa.binary()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]
RESULT = "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each start: a polynomial, by doubling, then mixed."""
    with np.errstate(over="ignore"):
        h, width, mul, parts = _BYTE[data], 1, _MUL, {}
        while True:
            if GRAM & width:
                parts[width] = (h, mul)
            if width * 2 > GRAM:
                break
            h, width, mul = h[:-width] * mul + h[width:], width * 2, mul * mul
        n, at, out = len(data) - GRAM + 1, 0, None
        for width, (h, mul) in sorted(parts.items(), reverse=True):
            part = h[at : at + n]
            out = part if out is None else out * mul + part
            at += width
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the picked grams of a text of WINDOW bytes at least."""
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, REACH + 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if rest := span - width:
        least = np.minimum(least[:-rest], least[rest:])
    pos = (least & _POSITION).astype(np.int64)
    pos = pos[np.r_[True, pos[1:] != pos[:-1]]]
    return pos, hashes[pos].view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contexts(data: bytes, pos: np.ndarray) -> list[int]:
    hashed = xxhash.xxh3_64_intdigest
    return [_signed(hashed(data[max(0, p - REACH) : p + WINDOW])) for p in pos.tolist()]


def _tid(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _distinct(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for x in batch.column(0):
                text = x.as_py()
                entry = found.setdefault(hashlib.sha256(text).digest(), [text, 0])
                entry[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([_tid(s) % blocks for s in found], pa.int64()), pa.array(list(found), pa.binary()), pa.array([e[0] for e in found.values()], pa.binary()), pa.array([e[1] for e in found.values()], pa.int64())],
                names=["block", "sha", "text", "n"],
            )

    return run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        parts = []
        for block, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if sha in seen:
                continue
            seen.add(sha)
            data = text.as_py()
            if len(data) >= WINDOW:
                pos, hashes = anchors(data)
                parts.append((np.full(len(pos), block), hashes, np.array(contexts(data, pos), np.int64), np.full(len(pos), _tid(sha)), pos))
        if not parts:
            continue
        block, hashes, context, tid, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((context, hashes, block))
        block, hashes, context, tid, pos = (c[order] for c in (block, hashes, context, tid, pos))
        new = np.r_[True, (block[1:] != block[:-1]) | (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(new)])
        yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(hashes[first]), pa.array(context[first]), pa.array(count), pa.array(tid[first]), pa.array(pos[first].astype(np.int32))], names=["block", "hash", "context", "n", "tid", "pos"])


def _texts_by_tid(table: pa.Table) -> dict[int, list[tuple[bytes, bytes]]]:
    found: dict[int, dict[bytes, bytes]] = {}
    for sha, text in zip(table.column("sha").to_pylist(), table.column("text").to_pylist(), strict=True):
        found.setdefault(_tid(sha), {})[sha] = text
    return {k: list(v.items()) for k, v in found.items()}


def _fetch(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    texts, rows = (_texts_by_tid(docs) if wanted.num_rows else {}), []
    for r in wanted.to_pylist():
        for _, text in texts.get(r["tid"], ()):
            begin = max(0, r["pos"] - REACH)
            data = text[begin : r["pos"] + WINDOW]
            if _signed(xxhash.xxh3_64_intdigest(data)) == r["context"]:
                rows.append((r["hash"].to_bytes(8, "big", signed=True), r["block"], r["tid"], r["pos"], r["pos"] - begin, data, r["n"], 0, REACH))
                break
    return _table(rows, CONTEXT_FIELDS)


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _longest(sides: list[bytes]) -> tuple[list[int], int]:
    """The longest start that each side shares with another one, and what all share."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        h = _shared(sides[i], sides[j])
        out[i], out[j] = max(out[i], h), max(out[j], h)
    return out, _shared(sides[order[0]], sides[order[-1]])


def repeats(members: list[tuple[int, bytes, bool]], core: tuple[int, int] = (0, GRAM)) -> list[list[tuple[int, int]]]:
    """For each (left, bytes, wanted): the spans, from its anchor, that a repeated window of the group covers.

    core: the bytes, from the anchor, that all windows looked for hold and all
    members share. What a member shares with no other is cut off at both sides;
    members that are then equal are one string. Spans are only told where wanted.
    """
    head, tail = core
    lefts = [b[: a + head][::-1] for a, b, _ in members]
    rights = [b[a + tail :] for a, b, _ in members]
    left_most, left_all = _longest(lefts)
    right_most, right_all = _longest(rights)
    width = left_all + (tail - head) + right_all
    strings: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (a, data, _) in enumerate(members):
        if left_most[i] + (tail - head) + right_most[i] >= WINDOW:
            ends = (data[a + head - left_most[i] : a + head - left_all], rights[i][right_all : right_most[i]])
            strings.setdefault(ends, []).append(i)
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    at = head - left_all
    for (left, right), own in strings.items():
        if len(own) > 1:
            for i in own:
                out[i] = [(at - len(left), at + width + len(right))]
    if len(strings) < 2 or not any(len(own) == 1 and members[own[0]][2] for own in strings.values()):
        return out
    text: list[int] = []
    begins, base = [], len(strings)
    for k, (left, right) in enumerate(strings):  # bytes, the shared core as one symbol, and a mark of its own after each
        begins.append(len(text))
        text += [base + x for x in left]
        text.append(base + 256)
        text += [base + x for x in right]
        text.append(k)
    order = suffix_array(text)
    lcp = [*common_prefixes(text, order), 0]
    shared = [0] * len(text)
    for r, s in enumerate(order):
        shared[s] = max(lcp[r], lcp[r + 1])
    for begin, ((left, _), own) in zip(begins, strings.items(), strict=True):
        if len(own) == 1:
            n = len(left)
            spans = [(at - n + j, at - n + j + h - 1 + width) for j in range(n + 1) if (h := shared[begin + j]) > n - j and h - 1 + width >= WINDOW]
            out[own[0]] = merged(spans)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by hash; a group has GROUP members at most."""
    held: list[tuple] = []

    def solve() -> list[tuple]:
        rows = []
        by_gram: dict[bytes, list[tuple]] = {}
        for m in held:
            core = (-m[7], WINDOW - m[8])
            by_gram.setdefault(m[5][m[4] + core[0] : m[4] + core[1]], []).append(m)
        for same in by_gram.values():
            if len(same) > 1:
                for m, spans in zip(same, repeats([(m[4], m[5], m[6] == 1) for m in same], core), strict=True):
                    if spans and m[6] == 1:
                        rows.append((m[1], 0, 0, m[2], [m[3] + x for s in spans for x in s]))
        return rows

    for batch in batches:
        rows = []
        for m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != m[0]:
                rows += solve()
                held = []
            held.append(m)
        yield from _spans(rows)
    yield from _spans(solve())


def _spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        fields = [("block", pa.int64()), ("hash", pa.int64()), ("context", pa.int64()), ("tid", pa.int64()), ("spans", pa.list_(pa.int32()))]
        yield from _table(rows, fields).to_batches()


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Divides the windows that start low..high bytes left of the anchor into halves, each with its bytes."""
    for batch in batches:
        rows = []
        for key, block, tid, pos, left, data, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mid = (low + high) // 2
            for a, b in ((low, mid), (mid + 1, high)):
                if a > b or left < a or left - b + WINDOW > len(data):
                    continue  # no window of this half
                begin = max(0, left - b)
                middle = data[left - a : left - b + WINDOW]
                rows.append((xxhash.xxh3_128_digest(key + bytes([a, b]) + middle), block, tid, pos, left - begin, data[begin : left - a + WINDOW], n, a, b))
        yield from _table(rows, CONTEXT_FIELDS).to_batches()


def _split(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of groups that are too large: spans of contexts that repeat in a half, and the halves' groups of different contexts."""
    alike = Window.partitionBy("hash", "bytes")
    parts = large.mapInArrow(_halved, CONTEXT).withColumn("copies", F.sum("n").over(alike)).withColumn("nth", F.row_number().over(alike.orderBy("block", "tid", "pos")))
    parts = stored(parts, "halves")
    begin = F.col("pos") - F.col("left")
    whole = parts.where("copies > 1 AND n = 1").select("block", F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("context"), "tid", F.array(begin, begin + F.octet_length("bytes")).alias("spans"))
    return whole, parts.where("nth = 1").withColumn("n", F.col("copies")).drop("copies", "nth")


def _solve(groups: DataFrame) -> DataFrame:
    """Spans of every context that is alone, over groups of any size: eight rounds at most divide REACH + 1 starts."""
    spans = None
    while True:
        sizes = groups.groupBy("hash").agg(F.count("*").alias("members"), F.min("n").alias("least")).where("members > 1 AND least = 1")
        sized = stored(groups.join(sizes, "hash").select(*(n for n, _ in CONTEXT_FIELDS), "members"), "groups")
        small = sized.where(F.col("members") <= GROUP).drop("members").repartition("hash").sortWithinPartitions("hash")
        found = small.mapInArrow(_sorted_groups, SPANS)
        spans = found if spans is None else spans.union(found)
        large = sized.where(F.col("members") > GROUP).drop("members")
        if large.isEmpty():
            return spans
        whole, groups = _split(large)
        spans = spans.union(whole)


def _result(sha: bytes, text: bytes, spans: list[tuple[int, int]]) -> tuple:
    """What is left of a text: its hash, and its characters but for those that were cut in part."""
    begins = [0, *(b for _, b in spans)]
    kept = b"".join(text[a:b] for a, b in zip(begins, [*(a for a, _ in spans), len(text)], strict=True))
    return sha, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    whole = {(h, c) for h, c, s in zip(marks.column("hash").to_pylist(), marks.column("context").to_pylist(), marks.column("spans").to_pylist(), strict=True) if s is None}
    spans: dict[int, list] = {}
    for tid, s in zip(marks.column("tid").to_pylist(), marks.column("spans").to_pylist(), strict=True):
        if s is not None:
            spans.setdefault(tid, []).extend(zip(s[::2], s[1::2], strict=True))
    count: dict[bytes, int] = {}
    for sha, n in zip(docs.column("sha").to_pylist(), docs.column("n").to_pylist(), strict=True):
        count[sha] = count.get(sha, 0) + n
    rows = []
    for same in _texts_by_tid(docs).values():
        for sha, text in same:
            if len(text) < WINDOW:
                continue
            if count[sha] > 1:
                rows.append(_result(sha, text, [(0, len(text))]))
                continue
            own = list(spans.get(_tid(sha), ()))
            if whole:
                pos, hashes = anchors(text)
                own += [(max(0, p - REACH), min(len(text), p + WINDOW)) for p, h, c in zip(pos.tolist(), hashes.tolist(), contexts(text, pos), strict=True) if (h, c) in whole]
            if own:
                rows.append(_result(sha, text, merged(own)))
    return _table(rows, [("sha", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def changed_texts(docs: DataFrame) -> DataFrame:
    """sha (of the text), n_bytes, n_removed, n_spans, kept_sha256, text (what is left) for every different text that loses bytes."""
    text = narrow(docs).select(F.col("text").cast("binary").alias("text"))
    total = narrow(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_width(docs.sparkSession), math.ceil(total / BLOCK_BYTES))
    routed = text.mapInArrow(_distinct(blocks), "block long, sha binary, text binary, n long").repartition(blocks, "block")
    found = routed.mapInArrow(_anchor_rows, ANCHOR).repartition("hash")
    same_hash, same_context = Window.partitionBy("hash"), Window.partitionBy("hash", "context")
    found = found.withColumn("all", F.sum("n").over(same_hash)).withColumn("many", F.min("context").over(same_hash) != F.max("context").over(same_hash))
    found = found.where("all > 1").withColumn("copies", F.sum("n").over(same_context)).withColumn("nth", F.row_number().over(same_context.orderBy("block", "tid", "pos")))
    found = stored(found.drop("all"), "anchors")
    wanted = found.where("many AND nth = 1").select("block", "hash", "context", F.col("copies").alias("n"), "tid", "pos")
    fetched = routed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_fetch, CONTEXT)
    spans = _solve(stored(fetched, "contexts"))
    whole = found.where("copies > 1").select("block", "hash", "context", F.lit(0).cast("long").alias("tid"), F.lit(None).cast("array<int>").alias("spans"))
    marks = stored(spans.select("block", "hash", "context", "tid", "spans").union(whole), "marks")
    return routed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut, RESULT)


def _with_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "sha", "bytes"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    changed = stored(changed_texts(docs).select("sha", "n_removed", "n_spans", "kept_sha256"), "changed")
    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shas = src.mapInArrow(_with_sha, "doc_id long, sha binary, bytes long")
    return shas.join(changed, "sha", "left").select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with each text reduced to its remaining bytes; a character that was cut in part goes.

    n_chars, where docs has it, is counted anew.
    """
    changed = stored(changed_texts(docs).select("sha", "text"), "changed")
    own, left = unused(docs, "sha"), unused(docs, "left_text")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    joined = docs.withColumn(own, sha).join(changed.select(F.col("sha").alias(own), F.col("text").alias(left)), own, "left")
    cut = joined.withColumn("text", F.coalesce(F.col(left), F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))

