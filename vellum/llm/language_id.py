"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily into longest matches against each automaton;
from the number of phrases p, the length n and the sample length m the cross
entropy estimate is p * log2(m) / n, and the language with the fewest normalised
phrases wins. Parsing runs in blocks of BLOCK characters, each of which opens a
phrase of its own, so whole texts of any length are parsed in lanes of equal
length: an automaton with greedy restarts is one table step for each character.

The model is fitted on a sample of bounded size: 2 * sample_docs documents a
language are drawn on average; of each the first 4 * chars / sample_docs
characters (200 at least) count, one after another until there are chars for the
language. chars is sample_chars, or fewer with so many languages that
max_table_bytes would be passed. The alphabet is that of all languages: the 62
most frequent letters of the sample, any other letter being one symbol, so that
languages of several scripts lose their rarer letters. Everything predicted uses
the whole text.

Defined results: null text, and text without a letter, give `und` with score 0;
ties go to the language that sorts first; with no labelled row all is `und`;
one learned language is given score 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_of_id

BLOCK = 512
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


class Alphabet:
    """Maps code points to a small alphabet: 0 for all that is no letter, 1 for a rare letter, then the sample's letters."""

    def __init__(self, texts: list[str], size: int = 64):
        count = Counter(c for t in texts for c in t.lower() if c.isalpha())
        kept = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: size - 2]]
        self.code = {c: i + 2 for i, c in enumerate(kept)}
        self.size = len(kept) + 2
        self.table = np.zeros(0x110000, np.uint8)
        for p in range(0x110000):
            c = chr(p)
            if c.isalpha():
                low = c.lower()
                self.table[p] = self.code.get(low if len(low) == 1 else c, 1)

    def codes(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def step_table(go: list[dict[int, int]], size: int) -> np.ndarray:
    """Where each state goes on each character, as 4 * row offset + the number of phrases that end there.

    A character that cannot be matched at the root is a phrase by itself, and ends the one before it.
    """
    root = np.full(size, 2, np.int32)
    for c, q in go[0].items():
        root[c] = 4 * q * size + 1
    table = np.tile(root, (len(go), 1))
    for s, moves in enumerate(go):
        for c, q in moves.items():
            table[s, c] = 4 * q * size
    table[0] = root - 1  # at the root nothing is open that could end
    return table.ravel()


def parse_counts(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each lane; lanes are sorted by length, longest first."""
    n = len(starts)
    state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if n else 0) + 1), side="right")
    for k, live in enumerate(alive):
        at = table.take((state[:live] >> 2) + codes[starts[:live] + k])
        state[:live] = at
        count[:live] += at & 3
    return count + (state >= 4)  # a phrase may still be open at the end


class Model:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet(list(samples.values()))
        self.tables, self.bits = [], []
        for lang in self.langs:
            codes = self.alphabet.codes(samples[lang]).tolist()
            self.tables.append(step_table(suffix_automaton(codes), self.alphabet.size))
            self.bits.append(np.log2(max(2, len(codes))))

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language; whether a text has a letter."""
        parts = [self.alphabet.codes(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        begins = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = begins[owner] + nth * BLOCK
        lengths = np.minimum(BLOCK, begins[owner] + sizes[owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        rate = np.zeros((len(texts), len(self.langs)))
        for j, table in enumerate(self.tables):
            count = parse_counts(codes, starts[order], lengths[order], table)
            rate[:, j] = np.bincount(owner[order], weights=count, minlength=len(texts)) * self.bits[j] / np.maximum(sizes, 1)
        letters = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=codes > 0, minlength=len(texts))
        return rate, letters > 0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        rate, letters = self.rates([t or "" for t in texts])
        out = []
        for r, has in zip(rate, letters, strict=True):
            if not has or not self.langs:
                out.append(("und", 0.0))
                continue
            best = int(np.argmin(r))
            rest = np.delete(r, best)
            out.append((self.langs[best], float(rest.min() / (rest.min() + r[best])) if len(rest) else 1.0))
        return out


def fit(docs: DataFrame, sample_docs: int = 48, sample_chars: int = 24_000, max_table_bytes: int = 96 << 20) -> Model:
    """Learn from non-null lang and text of the documents that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_of_id() % 3 != 1))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    chars = min(sample_chars, max(1, max_table_bytes // (len(counts) * 2 * 64 * 4)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, 2.0 * sample_docs / v)]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    drawn = known.withColumn("draw", draw).where(F.col("draw") < share * (1 << 30)).select("draw", "lang", F.substring("text", 1, chars).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"][: max(200, 4 * chars // sample_docs)])
    return Model({k: "\n".join(v)[:chars] for k, v in samples.items()})


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)  # bounded by max_table_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found, texts = [], batch.column(2).to_pylist()
            for i in range(0, len(texts), 2000):
                found += own.predict(texts[i : i + 2000])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % 3 == 1).alias("held_out"), "text")
    return src.mapInArrow(run, OUT)
