"""LM scoring by context-tree weighting over binary-decomposed bytes.

The text (A-Z in lower case) is a string of bytes with an end byte; each byte is
eight binary decisions, most significant first. For each decision a context tree
over the preceding bytes holds Krichevsky-Trofimov counts at depth 0 to DEPTH,
and the tree mixes all depths: the weight of a node's own estimate against its
children's is its share of the node's weighted probability of the training data,
which depends on counts alone. So training is counting: byte strings of length
DEPTH + 1 over all training documents.

Documents are dealt to blocks. Each block counts its own words and byte strings;
the counts are summed by key, the tree is computed in tasks that each hold whole
subtrees below the two last context bytes (above these it has 257 contexts at
most), and every block gets back the values of the keys that it holds. Nothing
that grows with the corpus is broadcast or passes through the driver.

Defined results: null text counts as empty (its end is scored); without training
documents the model gives each bit 1/2; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import crc_of_id, narrow, release, shuffle_width, stored

DEPTH = 4
WIDTH = DEPTH + 1
#: Not a byte of UTF-8: stands before and after each text.
END = b"\xff"
#: The end as a token; no word has white space.
END_WORD = b" "
BLOCK_BYTES = 16 << 20
#: Byte strings that a task of the tree holds on average, at most; a context of two bytes is never divided.
TASK_KEYS = 400_000
#: Byte strings are sorted so many at a time.
CHUNK = 1 << 20

COUNT = "block long, word boolean, key binary, n long"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"


def grams(text: bytes) -> np.ndarray:
    """Each byte of text and its end, behind its DEPTH preceding bytes, as one number."""
    data = np.frombuffer(END * DEPTH + text + END, np.uint8).astype(np.uint64)
    out = data[: len(data) - DEPTH]
    for k in range(1, DEPTH + 1):
        out = (out << np.uint64(8)) | data[k : len(data) - DEPTH + k]
    return out


def binary(keys: np.ndarray) -> pa.Array:
    """Byte strings of WIDTH from their numbers."""
    data = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :])
    offsets = np.arange(0, WIDTH * (len(keys) + 1), WIDTH, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def numbers(keys: pa.ChunkedArray) -> np.ndarray:
    """Numbers of byte strings of WIDTH, read from the column's own memory."""
    out = np.zeros((len(keys), 8), np.uint8)
    at = 0
    for part in keys.chunks:
        if len(part):
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            out[at : at + len(part), 8 - WIDTH :] = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
            at += len(part)
    return out.view(">u8").ravel().astype(np.int64)


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different byte strings of texts and how often each occurs, by sorting a chunk at a time."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, size = [], 0

    def sort() -> None:
        parts.append(np.unique(np.concatenate(held), return_counts=True))
        held.clear()

    for text in texts:
        held.append(grams(text))
        size += len(text)
        if size >= CHUNK:
            sort()
            size = 0
    if held:
        sort()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        by_block: dict[int, list] = {}
        for block, held, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            by_block.setdefault(block, []).append((held, text.as_py().lower()))
        for block, docs in by_block.items():
            words: Counter[bytes] = Counter()
            for held, text in docs:
                if not held:
                    words.update(text.split())
                    words[END_WORD] += 1
            for held, text in docs:
                if held:
                    for w in text.split():
                        words.setdefault(w, 0)
                    words.setdefault(END_WORD, 0)
            known = counted([t for h, t in docs if not h])
            other = np.setdiff1d(counted([t for h, t in docs if h])[0], known[0])
            keys = binary(np.concatenate([known[0], other]))
            release()
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(words) + n, block)),
                    pa.array(np.r_[np.ones(len(words), bool), np.zeros(n, bool)]),
                    pa.concat_arrays([pa.array(list(words), pa.binary()), keys]),
                    pa.array(np.concatenate([np.fromiter(words.values(), np.int64, len(words)), known[1], np.zeros(len(other), np.int64)])),
                ],
                names=["block", "word", "key", "n"],
            )


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - math.log(math.pi)


def weighed(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


class Subtrees:
    """The nodes below some contexts of two bytes, from keys and counts that hold each such subtree whole."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte = keys & 0xFF
        steps = np.arange(8)
        prefix = (1 << steps) | (byte[:, None] >> (8 - steps))
        self.bit = ((byte[:, None] >> (7 - steps)) & 1).astype(np.uint8)
        context = keys >> 8
        self.levels = []  # by depth, deepest first: ids, which id each decision has, zeros, ones
        for depth in range(DEPTH, 1, -1):
            node = ((context & ((1 << 8 * depth) - 1))[:, None] << 8) | prefix
            ids, at = np.unique(node, return_inverse=True)
            at = at.reshape(node.shape).astype(np.int32)
            ones = np.bincount(at.ravel(), weights=(self.bit * counts[:, None]).ravel(), minlength=len(ids))
            total = np.bincount(at.ravel(), weights=np.broadcast_to(counts[:, None], node.shape).ravel(), minlength=len(ids))
            self.levels.append((ids, at, total - ones, ones))
        self.log_own = [kt(z, o) for _, _, z, o in self.levels]
        self.log_weighed = [self.log_own[0]]
        for k in range(1, len(self.levels)):
            child, up = self.levels[k - 1][0], self.levels[k][0]
            depth = DEPTH - k
            parent = (child >> 8 & ((1 << 8 * depth) - 1)) << 8 | child & 0xFF
            below = np.bincount(np.searchsorted(up, parent), weights=self.log_weighed[-1], minlength=len(up))
            self.log_weighed.append(weighed(self.log_own[k], below))

    def top(self) -> tuple[np.ndarray, ...]:
        """Of the nodes at depth 2: context byte and decision above them, zeros, ones, log weighed probability."""
        ids, _, zeros, ones = self.levels[-1]
        return (ids & 0xFFFF), zeros, ones, self.log_weighed[-1]

    def log10(self, upper: UpperTree) -> np.ndarray:
        """Log10 probability of each key's byte in its context."""
        p = None
        for k, (_, at, zeros, ones) in enumerate(self.levels):
            own = (ones + 0.5) / (zeros + ones + 1)
            share = np.ones_like(own) if k == 0 else np.exp(self.log_own[k] - math.log(2) - self.log_weighed[k])
            p = own[at] if k == 0 else share[at] * own[at] + (1 - share[at]) * p
        node = self.levels[-1][0][self.levels[-1][1]] & 0xFFFF
        p = upper.mix(node, p)
        return np.log10(np.where(self.bit == 1, p, 1 - p)).sum(axis=1)


class UpperTree:
    """Depth 0 and 1, from sums over the nodes at depth 2: 256 x 255 entries at most."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(ids)
        self.ids, zeros, ones, below = ids[order], zeros[order], ones[order], below[order]
        own = kt(zeros, ones)
        log_1 = weighed(own, below)
        self.p1, self.share1 = (ones + 0.5) / (zeros + ones + 1), np.exp(own - math.log(2) - log_1)
        self.root, at = np.unique(self.ids & 0xFF, return_inverse=True)
        zeros, ones, below = (np.bincount(at, weights=x, minlength=len(self.root)) for x in (zeros, ones, log_1))
        own = kt(zeros, ones)
        self.p0, self.share0 = (ones + 0.5) / (zeros + ones + 1), np.exp(own - math.log(2) - weighed(own, below))

    def mix(self, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        i, r = np.searchsorted(self.ids, node), np.searchsorted(self.root, node & 0xFF)
        p = self.share1[i] * self.p1[i] + (1 - self.share1[i]) * p
        return self.share0[r] * self.p0[r] + (1 - self.share0[r]) * p


def _subtrees(batches: Iterator[pa.RecordBatch]) -> tuple[Subtrees | None, pa.ChunkedArray | None]:
    release()
    table = [b for b in batches if b.num_rows]
    if not table:
        return None, None
    keys = pa.chunked_array([b.column(0) for b in table])
    n = np.concatenate([b.column(1).to_numpy() for b in table]).astype(float)
    return Subtrees(numbers(keys), n), keys


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, _ = _subtrees(batches)
    if tree:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in tree.top()], names=["id", "zeros", "ones", "below"])
        del tree
        release()


def _log10(upper):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys = _subtrees(batches)
        if tree:
            values, at = tree.log10(upper.value), 0
            for part in keys.chunks:
                yield pa.RecordBatch.from_arrays([part, pa.array(values[at : at + len(part)])], names=["key", "value"])
                at += len(part)
            del tree, keys, values
            release()

    return run


def context_tree(totals: DataFrame) -> DataFrame:
    """key, value: the log10 probability of each byte string's last byte after the others; totals has key and n."""
    width = max(shuffle_width(totals.sparkSession), math.ceil(totals.count() / TASK_KEYS))
    subtree = totals.repartition(width, F.substring("key", DEPTH - 1, 2))
    sums = subtree.mapInArrow(_tops, "id long, zeros double, ones double, below double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    rows = sums.collect()  # 256 x 255 at most
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    upper = UpperTree(np.array(columns[0], np.int64), *(np.array(c, float) for c in columns[1:]))
    return subtree.mapInArrow(_log10(totals.sparkSession.sparkContext.broadcast(upper)), "key binary, value double")


def _score(docs: pa.Table, values: pa.Table) -> pa.Table:
    release()  # what the block before has left
    is_word = np.asarray(values.column("word").to_numpy(), bool)
    value = values.column("value").to_numpy()
    words, strings = values.column("key").filter(pa.array(is_word)), values.column("key").filter(pa.array(~is_word))
    count = dict(zip(words.to_pylist(), value[is_word].astype(np.int64).tolist(), strict=True))
    known = numbers(strings).astype(np.uint64)
    order = np.argsort(known)
    known, log10 = known[order], value[~is_word][order]
    rows = []
    for doc_id, held, text in zip(docs.column("doc_id").to_pylist(), docs.column("held_out").to_pylist(), docs.column("text"), strict=True):
        low = text.as_py().lower()
        c = np.array([*map(count.__getitem__, low.split()), count[END_WORD]], np.int64)
        rows.append((doc_id, held, len(c), int(np.count_nonzero(c)), float(np.log10(c + 1.0).sum()), float(log10[np.searchsorted(known, grams(low))].sum())))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    del count, words, strings, known, log10
    release()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    total = narrow(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_width(spark), math.ceil(total / BLOCK_BYTES))
    src = narrow(docs).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
        (crc_of_id() % 7 == 2).alias("held_out"), F.col("text").cast("binary").alias("text"),
    )
    routed = src.repartition(blocks, "block")
    counts = routed.mapInArrow(_counts, COUNT).repartition("key")
    same = Window.partitionBy("key", "word")
    counts = stored(counts.withColumn("c", F.sum("n").over(same)).withColumn("nth", F.row_number().over(same.orderBy("block"))).drop("n"), "counts")
    train, distinct = counts.where("word AND nth = 1").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tree = context_tree(counts.where("NOT word AND nth = 1").select("key", F.col("c").alias("n")))
    strings = counts.where("NOT word").select("block", "key").join(tree, "key").select("block", F.lit(False).alias("word"), "key", "value")
    values = counts.where("word").select("block", "word", "key", F.col("c").cast("double").alias("value")).union(strings)
    scored = routed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score, OUT)
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(train + distinct + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
