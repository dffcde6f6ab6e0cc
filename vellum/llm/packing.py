"""Packing into sequences of a fixed length by best-fit decreasing.

Scan tasks tokenise and cut: an overlong document is first cut into full
windows, its rest is a piece to be packed. Pieces go to packing groups by a hash
of doc_id, several thousand documents to a group, so a hot source or a group of
copies is spread out; a group loses a fraction of one sequence. Within a group
pieces are taken longest first and each goes to the open sequence it fills best,
found in a segment tree indexed by remaining capacity.

Ids come from the tiktoken library over the same vocabulary and pre-tokeniser
pattern as the named tokenizers file, with that file's special tokens found
first; the tests hold them against the tokenizers library.

Defined results: null text counts as empty (one piece with the end id only);
rows that repeat a doc_id are packed each for itself; an empty table gives no
rows; a document of exactly one window is one full sequence.
"""

from __future__ import annotations

import base64
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .bpe import CUT, PATTERN, Recent, byte_symbols
from .common import narrow, release

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FastIds:
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 340_000):  # from 349,526 keys on a dict takes twice the memory
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back = {c: b for b, c in byte_symbols().items()}
        special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        ranks = {bytes(back[c] for c in s): i for s, i in file["model"]["vocab"].items() if s not in special}
        self.encoding = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {s: struct.pack("<I", i) for s, i in special.items()}
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.of_stretch = Recent(lambda s: np.array(self.encoding.encode_ordinary(s), "<u4").tobytes(), limit)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        cut = CUT.split(text)
        get = self.of_stretch.__getitem__
        return get(cut[0]) + b"".join([get(" " + s) for s in cut[1:]])

    def __call__(self, text: str) -> bytes:
        if self.is_special is None or not self.is_special.search(text):
            return self.plain(text)
        return b"".join(self.special[s] if k % 2 else self.plain(s) for k, s in enumerate(self.is_special.split(text)))


@lru_cache(maxsize=2)
def load(path: str) -> FastIds:
    return FastIds(path)


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open sequences with that capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least need that an open sequence has."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:  # a right child: its parent has nothing further right
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i + (not count[2 * i])
        return i - self.leaves


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; lengths must not increase."""
    tree, free, used, out = CapacityTree(size), [[] for _ in range(size + 1)], 0, []
    for length in lengths:
        capacity = tree.tightest(length)
        if capacity is None:
            sequence, capacity, used = used, size, used + 1
        else:
            sequence = free[capacity].pop()
            tree.add(capacity, -1)
        out.append((sequence, size - capacity))
        if left := capacity - length:
            free[left].append(sequence)
            tree.add(left, 1)
    return out


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """The pieces of every document: full windows and the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = load(path), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, text, salt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                rows += [(doc_id, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n, salt) for s in range(0, n, size)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        ids_of.of_stretch.clear()  # the worker lives on, beside those of other stages
        release()

    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.withColumn("salt", F.xxhash64("doc_id", "text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    group_docs is the number of documents that a packing group holds on average.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = np.array(best_fit(part["length"].tolist(), size), np.int64).reshape(-1, 2)
        part["sequence_id"] = (int(key[0]) << 32) + placed[:, 0]
        part["offset"] = placed[:, 1]
        return part[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    spread = pieces(docs, path, size, end_id).withColumn("bin", F.pmod("salt", F.lit(groups))).drop("salt")
    return spread.groupBy("bin").applyInPandas(fill, PACKED)
