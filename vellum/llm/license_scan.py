"""Licence scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

A text is lower-cased (A-Z) and everything that is no word character becomes
one space, so that a phrase is found where its words stand consecutively. One
automaton holds the notice phrases and the words of the identifier tag. After a
tag the expression that follows in the text as written is parsed: identifiers
joined by AND, OR and WITH (WITH binds closest, then AND, then OR) and brackets;
it is evaluated to the labels it names and to whether it lets a reuser choose or
be bound to permissive terms only. Only identifiers that are known (FAMILIES and
SINGLE below, and references to a licence of the text's own) become labels; other
words after a tag are none.

score is the share of the found places (notices, and tags whose expression names
a known identifier) whose terms are permissive; 0 where nothing was found.

Defined results: null text counts as empty; texts without words give zeros and
empty label lists; an expression that does not parse adds the identifiers before
the fault; each row is scanned by itself, so repeated rows and null doc_ids give
rows like any other; long texts are scanned whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import narrow

#: Fixed values of the contract: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices of the method's own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: Families of licence identifiers, and identifiers that stand alone.
FAMILIES = ["agpl", "lgpl", "gpl", "apache", "mpl", "cc0", "epl", "eupl", "bsd", "cddl", "artistic", "afl", "osl", "ofl", "bsl", "ecl", "upl", "psf", "python"]
SINGLE = ["mit", "mit-0", "0bsd", "isc", "zlib", "unlicense", "wtfpl", "x11", "ncsa", "postgresql", "libpng", "openssl", "ms-pl", "ms-rl", "vim", "beerware", "blueoak-1.0.0"]
FAMILY = re.compile(rf"({'|'.join(FAMILIES)})(-[0-9].*|v?[0-9].*)?")
CC_BY = re.compile(r"(cc-by(?:-(?:nc|sa|nd))*)(-[0-9].*)?")
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc-by", "cc0", "mit-0", "0bsd", "unlicense", "zlib"}
TAG_IN_TEXT = re.compile(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
POWER = {"or": 1, "and": 2, "with": 3}
#: Every byte that is no word character to a space, A-Z to a-z; bytes from 0x80 stay.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (len(phrase), label, phrase in BASE))
    a.make_automaton()
    return a


def label_of(identifier: str) -> str | None:
    """The label of a known identifier: its family where that has one, else itself in lower case."""
    name = identifier.lower().rstrip(".")
    if found := FAMILY.fullmatch(name) or CC_BY.fullmatch(name):
        return found[1]
    if name.startswith("licenseref-"):
        return "licenseref"
    return name if name in SINGLE else None


def parse(expression: str) -> list[str]:
    """Postfix order by shunting-yard; stops where the expression stops being one."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif word in POWER and not operand:
            while held and held[-1] != "(" and POWER[held[-1]] >= POWER[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif operand and token not in ("(", ")") and word not in POWER:
            out.append(token)
            operand = False
        else:
            break
    while held:
        if (top := held.pop()) != "(":
            out.append(top)
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The labels named, and whether permissive terms suffice: any side of OR, both of AND; an exception adds no label."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in POWER:
            if len(stack) < 2:
                continue  # the operator's right side is missing
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1])))
        else:
            label = label_of(token)
            stack.append(({label} if label else set(), label in PERMISSIVE))
    if not stack:
        return set(), False
    return set().union(*(s[0] for s in stack)), all(s[1] for s in stack)


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    base_at, base, labels, places, good, tags = [], set(), set(), 0, 0, 0
    starts = None
    for end, (length, label, is_base) in automaton().iter(line):
        if not label:
            tags += 1
            continue
        labels.add(label)
        places += 1
        good += label in PERMISSIVE
        if is_base:
            base.add(label)
            if starts is None:
                starts = [m.start() for m in re.finditer(" ", line)]
            base_at.append(bisect_right(starts, end - length - 1) - 1)
    if tags:
        for m in TAG_IN_TEXT.finditer(text):
            found, permissive = evaluate(parse(m[1]))
            if found:
                labels |= found
                places += 1
                good += permissive
    score = good / places if places else 0.0
    first, last = (min(base_at), max(base_at)) if base_at else (None, None)
    return len(words), len(base_at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(scan(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(found, FIELDS, strict=True))], names=["doc_id", *(n for n, _ in FIELDS)])

    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
