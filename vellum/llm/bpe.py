"""Byte-level BPE: encoding with a priority queue over a doubly linked symbol list, and decoding.

The vocabulary file is a parameter; it is read once in each Python worker. A
text is cut before every single space that a non-space follows; no piece of the
pre-tokeniser's pattern crosses such a cut, so a stretch's ids depend on the
stretch alone and a bounded cache holds those of recent stretches; when it is
full, those used since it was last full stay.

Defined results: null text counts as empty (no ids); an empty table gives no
rows; the special tokens named in the file are found in a text before all else,
as the file says; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import narrow

#: The pattern is part of the byte-level format and a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r" (?=\S)")
OTHER_SPACE = re.compile(r" (?!\S)")
#: A space and such a stretch are one piece.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = (b for b in range(256) if b not in shown)
    return shown | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """A cache that drops its older half-life: at the limit it starts anew."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Lasting(Recent):
    """A cache of two generations: at the limit the younger one becomes the older, from which what is asked for comes back.

    Keys of over longest characters are not kept, so that texts without spaces don't fill the memory.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__(make, limit)
        self.longest = longest
        self.older: dict = {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBPE:
    def __init__(self, path: str, limit: int = 690_000):  # from 699,051 keys on a dict takes twice the memory
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        symbol = byte_symbols()
        back = {c: b for b, c in symbol.items()}
        self.base = [vocab[symbol[b]] for b in range(256)]
        ids = max(vocab.values()) + 1
        #: The id of no symbol; it stands after the last one and where one was merged away.
        self.none = ids
        #: For each symbol, the ranks of its pairs by the symbol to the right.
        self.ranks: list[dict[int, int]] = [unpaired := {}] * (ids + 1)
        self.made = []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if self.ranks[i := vocab[left]] is unpaired:
                self.ranks[i] = {}
            self.ranks[i][vocab[right]] = rank
            self.made.append(vocab[left + right])
        strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.strings = np.empty(max(strings) + 1, object)
        self.strings[list(strings)] = list(strings.values())
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        #: Of stretches after a cut, without their space; it has their first pieces, too.
        self.of_stretch = Lasting(self._stretch, limit)
        self.of_piece = Lasting(self._piece, limit // 4)

    def _piece(self, piece: str) -> bytes:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [*map(self.base.__getitem__, piece.encode())]
        n, ranks, made, none = len(ids), self.ranks, self.made, self.none
        if n == 1:
            return struct.pack("<I", ids[0])
        ids.append(none)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        bits = 14 if n < 1 << 14 else 32  # small numbers are faster
        place = (1 << bits) - 1
        waits = []  # at each symbol the queue's entry of its pair: rank and place
        row = ranks[ids[0]]
        for i, right in enumerate(ids[1:]):
            waits.append(row[right] << bits | i if right in row else None)
            row = ranks[right]
        waits.append(None)
        queue = [entry for entry in waits if entry is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & place
            if waits[i] != top:
                continue  # stale: one of its two symbols has since been merged
            j = after[i]
            new = ids[i] = made[top >> bits]
            ids[j], waits[j] = none, None
            k = after[i] = after[j]
            before[k] = i
            row, right = ranks[new], ids[k]
            if right in row:
                waits[i] = entry = row[right] << bits | i
                heappush(queue, entry)
            else:
                waits[i] = None
            if (h := before[i]) >= 0:
                row = ranks[ids[h]]
                if new in row:
                    waits[h] = entry = row[new] << bits | h
                    heappush(queue, entry)
                else:
                    waits[h] = None
        ids = [x for x in ids if x != none]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a space and the stretch."""
        if LETTERS.fullmatch(stretch):
            return self._piece(" " + stretch)
        first, *rest = self.pieces.findall(" " + stretch)
        if not rest:
            return self._piece(first)
        return self.of_stretch[first[1:]] + b"".join(map(self.of_piece.__getitem__, rest))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = CUT.split(text) if OTHER_SPACE.search(text) else text.split(" ")
        return b"".join(map(self.of_piece.__getitem__, self.pieces.findall(first))) + b"".join(map(self.of_stretch.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.is_special is None or not self.is_special.search(text):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[s]) if k % 2 else self._plain(s) for k, s in enumerate(self.is_special.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(self.strings.take(np.frombuffer(ids, "<u4")).tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
