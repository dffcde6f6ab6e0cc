"""Secret scan: fixed patterns, and assignments read as name-literal pairs.

Source and configuration text is read in order. A name (bare, quoted as in JSON, or
a subscript) followed by `=`, `:`, `:=` or `=>` is a target; what follows is an
expression of string literals, names and bare values, joined by `+`, `.`, `..` or by
standing side by side. Comparisons are no assignments. Each target's value is kept,
so that a later expression that names it, or a string that interpolates it, gets
its literals: constants are propagated along the text.

A target's score comes from the words of its name (camel case, snake case and
paths are taken apart); a last word such as `path` or `length` says that it holds
no secret. A value's score comes from its length, its empirical entropy and the
kinds of its characters; placeholders and interpolations that nothing resolves
score 0. Where the product reaches THRESHOLD the value's literals are spans: kind
`literal` if they stand in the target's own expression, `constant` if they came
from elsewhere. Spans are those of the literal without its quotes.

Fixed kinds (`assign`, `access`, `hex`) are the spans of whole matches.

A value has the values that it names as parts, which are shared and never copied, and
a score is put together from theirs: all values of a text are kept to its end, in
room that grows with the text even where each target goes on from the one before.

Defined results: null text counts as empty and has no spans; texts are scanned
whole, with the values of all their targets; equal spans of one kind are given once, spans of different kinds may overlap; repeated rows and null doc_ids
are scanned like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import narrow

#: Fixed patterns of the contract and the least lengths of what they find.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, HEX_LEAST = 8, 32
KINDS = ["assign", "access", "hex", "literal", "constant"]

THRESHOLD = 0.4
#: Bits that make a value certain, whatever follows; a little over what value_score asks, for rounding.
SURE = 41
#: Counts stop here: two different characters among so many are SURE.
MANY = 1 << 60
#: How much a word of a target's name says, and pairs of words that say it together.
WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "secrets": 1.0, "apikey": 1.0, "token": 0.9, "bearer": 0.9, "jwt": 0.9,
    "credential": 0.9, "credentials": 0.9, "authorization": 0.9, "pass": 0.8, "auth": 0.6, "salt": 0.5, "cookie": 0.5, "pin": 0.4,
}
BEFORE_KEY = {"api", "access", "private", "secret", "encryption", "signing", "account", "auth", "master", "ssh", "shared", "deploy", "license"}
#: Last words of names that hold something about a secret, not the secret.
ABOUT = {"name", "file", "path", "url", "uri", "length", "len", "size", "count", "type", "id", "hint", "policy", "field", "label", "expiry", "expires", "ttl", "header", "format", "prefix", "regex", "pattern", "min", "max", "timeout", "limit", "rules", "help", "prompt", "strength", "enabled", "required"}
PLACEHOLDER = re.compile(r"(?i)change[_-]?me|example.*|placeholder|dummy|test|sample|none|null|nil|true|false|undefined|redacted|password|secret|token|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}")
#: First characters that decide, with the last two, whether a value is a placeholder: more than any fixed one has.
HEAD = 12
SAME = re.compile(r"(?i)(.)\1*")

NAME = r"[A-Za-z_$@][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*"
TARGET = re.compile(
    rf"""(?a)(?<![\w$@.-])(?:(?P<q>["'])(?P<quoted>{NAME})(?P=q)|(?P<bare>{NAME})(?:\[(?P<s>["'])(?P<sub>{NAME})(?P=s)\])?)\]?
    (?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]]*(?=[ \t]*=(?!=)))?[ \t]*(?::=|=>|=(?![=~])|:(?![:/=]))[ \t]*""",
    re.VERBOSE,
)
STRING = re.compile(r"""(?ai)(?:[rbfu]{0,2})(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)""")
BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>&|]+""")
SCHEME = re.compile(r"(?i)(?:bearer|basic|token)[ ]+(?=\S)")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\|)?[ \t]*")
ONLY_NAME = re.compile(rf"(?a){NAME}")
INSIDE = re.compile(rf"(?a)\$\{{({NAME})\}}|\{{({NAME})\}}|%\(({NAME})\)s|\$([A-Za-z_]\w*)")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Piece = tuple[str, int, int]  # a literal's text and span


def name_score(name: str) -> float:
    """How likely a target of this name holds a secret, 0 to 1."""
    words = [w.lower() for w in PART.findall(name)]
    score = max((WORDS.get(w, 0.0) for w in words), default=0.0)
    if any(b == "key" and a in BEFORE_KEY for a, b in zip(words, words[1:])):
        score = 1.0
    return score * (0.2 if words and words[-1] in ABOUT else 1.0)


def bits_of(counts: Counter) -> float:
    """How much so many characters say, by their own frequencies. Those of more text never say less."""
    n = counts.total()
    if len(counts) < 2:
        return 0.0
    return math.inf if n >= MANY else -sum(c * math.log2(c / n) for c in counts.values())


@dataclass(slots=True)
class Looks:
    """What value_score asks of a text; that of texts put together comes from theirs. Few fields are long: counts are None once SURE, and 12 different characters are."""

    size: int
    head: str
    tail: str
    same: bool
    kinds: int
    space: bool
    counts: Counter | None

    @classmethod
    def of(cls, text: str) -> Looks:
        counts = Counter(text)
        kinds = sum(any(map(f, counts)) << k for k, f in enumerate((str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())))
        return cls(len(text), text[:HEAD], text[-2:], bool(SAME.fullmatch("".join(counts))), kinds, any(map(str.isspace, counts)), counts if bits_of(counts) < SURE else None)

    def then(self, more: Looks) -> Looks:
        if not (self.size and more.size):
            return self if self.size else more
        counts = None
        if self.counts is not None and more.counts is not None:
            counts = self.counts + more.counts
            counts = Counter({c: min(n, MANY) for c, n in counts.items()})
        same = self.same and more.same and bool(SAME.fullmatch(self.head[0] + more.head[0]))
        return Looks(min(self.size + more.size, MANY), (self.head + more.head)[:HEAD], (self.tail + more.tail)[-2:], same, self.kinds | more.kinds, self.space or more.space, counts if counts is not None and bits_of(counts) < SURE else None)


def value_score(value: Looks, quoted: bool) -> float:
    """How much a value looks like a secret, 0 to 1: 40 bits by its own letters' frequencies make it certain."""
    if value.size < 6 or value.same or PLACEHOLDER.fullmatch(value.head + value.tail * (value.size > HEAD)):
        return 0.0
    score = 1.0 if value.counts is None else min(1.0, bits_of(value.counts) / 40)
    if not quoted and value.kinds.bit_count() < 2:
        score *= 0.3  # a word of prose after a colon
    if value.space:
        score *= 0.4
    return score


class Value:
    """What a target holds: literals, and values that it has from elsewhere."""

    __slots__ = ("parts", "_looks", "given")

    def __init__(self, parts: list[Piece | Value]) -> None:
        self.parts = tuple(p for p in parts if isinstance(p, Value) or p[0])
        self._looks: Looks | None = None
        self.given = False

    def looks(self) -> Looks:
        todo = [self]  # values may hang on each other in long rows
        while todo:
            value = todo[-1]
            waiting = [p for p in value.parts if isinstance(p, Value) and p._looks is None]
            if not waiting:
                value._looks = reduce(Looks.then, (p._looks if isinstance(p, Value) else Looks.of(p[0]) for p in value.parts), Looks.of(""))
                todo.pop()
            todo += waiting
        return self._looks

    def spans(self, begin: int) -> Iterator[tuple[int, str, int]]:
        """start, kind, end of its literals; those from before `begin` once, whatever else they reach."""
        todo = list(reversed(self.parts))
        while todo:
            part = todo.pop()
            if not isinstance(part, Value):
                yield part[1], "literal" if part[1] >= begin else "constant", part[2]
            elif not part.given:
                part.given = True
                todo += reversed(part.parts)


class Reader:
    """The assignments of one text in order, with the values of the names so far."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.values: dict[str, Value] = {}

    def value_of(self, name: str) -> Value | None:
        found = self.values.get(name)
        return self.values.get(re.split(r"\.|->|::", name)[-1]) if found is None else found

    def interpolated(self, piece: Piece) -> list[Piece | Value]:
        """A literal in pieces: what it says itself, and the values of the names that it interpolates."""
        text, start, _ = piece
        out: list[Piece | Value] = []
        at = 0
        for m in INSIDE.finditer(text):
            known = self.value_of(next(filter(None, m.groups())))
            if known and known.parts:
                out += [(text[at : m.start()], start + at, start + m.start())] * (m.start() > at) + [known]
                at = m.end()
        return out + [(text[at:], start + at, start + len(text))] * (at < len(text) or not out)

    def expression(self, at: int) -> tuple[list[Piece | Value], bool, int]:
        """The literals and values that make up the value that begins here, whether one was quoted, and where it ends."""
        pieces: list[Piece | Value] = []
        quoted, text = False, self.text
        while True:
            if m := STRING.match(text, at):
                group = m.lastindex
                pieces += self.interpolated((m[group], m.start(group), m.end(group)))
                quoted = True
            elif (m := ONLY_NAME.match(text, at)) and (known := self.value_of(m[0])) is not None:
                pieces += [known] * bool(known.parts)
                quoted = True
            elif not pieces and not quoted:
                scheme = SCHEME.match(text, at)
                m = BARE.match(text, scheme.end() if scheme else at)
                if not m or text[m.end() : m.end() + 1] == "(":
                    return [], False, at
                return self.interpolated((m[0].rstrip(".:"), m.start(), m.start() + len(m[0].rstrip(".:")))), False, m.end()
            else:
                return pieces, quoted, at
            at = m.end()
            join = JOIN.match(text, at)
            if not STRING.match(text, join.end()) and not (join[0].strip() and ONLY_NAME.match(text, join.end())):
                return pieces, quoted, at
            at = join.end()

    def spans(self) -> Iterator[tuple[int, str, int]]:
        """start, kind, end of the literals that reach sensitive targets."""
        at = 0
        while m := TARGET.search(self.text, at):
            name = m["quoted"] or m["sub"] or m["bare"]
            begin = m.end()
            pieces, quoted, end = self.expression(begin)
            at = begin if not pieces else max(end, begin)
            if not pieces:
                continue
            value = self.values[name] = Value(pieces)
            if (score := name_score(name)) and score * value_score(value.looks(), quoted) >= THRESHOLD:
                yield from value.spans(begin)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """The fixed patterns' matches: start, kind, end. Each pattern is tried only where the text holds what it can't do without."""
    out, low = [], text.lower()
    if any(x in low for x in ("passw", "secret", "token", "key")):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    if max(map(len, text.split()), default=0) >= HEX_LEAST:
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, kind, z in sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans."""
    base = base_spans(text)
    n = Counter(kind for _, kind, _ in base)
    own = list(Reader(text).spans()) if "=" in text or ":" in text else []
    return n["assign"], n["access"], n["hex"], sha256(joined(base).encode()).hexdigest(), joined(base + own)


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(scan(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(found, FIELDS, strict=True))], names=["doc_id", *(n for n, _ in FIELDS)])

    src = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with every span of a scan, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for a, z in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]
