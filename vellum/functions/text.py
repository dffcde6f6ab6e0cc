"""Column expressions for folding, comparing and labelling text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Invisible characters that never count (fixed values): soft hyphen, zero-width space to joiner, word joiner, no-break mark.
INVISIBLE = "­​‌‍⁠﻿"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language(lang: Column | str) -> Column:
    """The primary subtag of a language tag."""
    return F.lower(F.element_at(F.split(F.coalesce(_col(lang), F.lit("")), "-"), 1))


def fold_plain(text: Column | str, lang: Column | str | None = None) -> Column:
    """Fold of text that is in composed form already: invisible marks, punctuation and symbols go, case and final sigma go.

    Latin also writes v as u and j as i.
    """
    out = F.regexp_replace(F.translate(_col(text), INVISIBLE, ""), r"[\p{P}\p{S}]", "")
    out = F.translate(F.lower(out), "ς", "σ")
    if lang is None:
        return out
    return F.when(language(lang).isin("la", "lat"), F.translate(out, "vj", "ui")).otherwise(out)


def _fold(text: str, bare: bool) -> str:
    kept = (c for c in unicodedata.normalize("NFC", text) if c not in INVISIBLE and unicodedata.category(c)[0] not in "PS")
    out = "".join(kept)
    if bare:
        out = _bare(out)
    return out.lower().replace("ς", "σ")


def folded(text: str) -> str:
    """Fold of a text that is given to a query and not read from a table."""
    return _fold(text, False)


#: Languages (fixed values) whose v and j are u and i, and whose points don't count.
LATIN, BARE = ("la", "lat"), ("he", "heb", "ar", "ara")
UV = str.maketrans("vj", "ui")


def _bare(text: str) -> str:
    marks = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")
    return unicodedata.normalize("NFC", "".join(marks))


def _vectorised(function):  # noqa: ANN001, ANN202
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return F.pandas_udf(run, StringType())


def fold(text: Column | str, lang: Column | str | None = None) -> Column:
    """Fold of any text by the defaults of its language: composed first, which Spark has no function for."""

    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        def one(t: str, lang: str | None) -> str:
            primary = (lang or "").lower().split("-")[0]
            out = _fold(t, primary in BARE)
            return out.translate(UV) if primary in LATIN else out

        return pd.Series([None if t is None else one(t, x) for t, x in zip(texts, langs, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(_col(text), F.lit(None).cast("string") if lang is None else _col(lang))


def fold_bare(text: Column | str) -> Column:
    """Fold without diacritics."""
    return _vectorised(lambda t: _fold(t, True))(_col(text))


def strip_diacritics(text: Column | str) -> Column:
    return _vectorised(_bare)(_col(text))


def composed(text: Column | str) -> Column:
    """Normal form C."""
    return _vectorised(lambda t: unicodedata.normalize("NFC", t))(_col(text))


#: Sentence punctuation that is trimmed at the edges of a phrase; marks of elision are not among it.
EDGE = r",.;:!?\u00b7\u0387\u037e\u2026\-\u2013\u2014()\[\]\u00ab\u00bb\u201c\u201d\""
#: The characters that mark an elision.
ELISION = "\u02bc\u2019\u1fbd'\u2032"


def trim_punctuation(text: Column | str) -> Column:
    """Sentence punctuation at either end goes, and white space with it; a text of nothing else stays."""
    out = F.regexp_replace(F.regexp_replace(_col(text), f"^[{EDGE}]+|[{EDGE}]+$", ""), r"(?U)^\s+|\s+$", "")
    return F.when(out == "", _col(text)).otherwise(out)


def trim_punctuation_at(text: Column | str, edge: str) -> Column:
    """trim_punctuation at the start or the end only."""
    marks, space = (f"^[{EDGE}]+", r"(?U)^\s+") if edge == "start" else (f"[{EDGE}]+$", r"(?U)\s+$")
    out = F.regexp_replace(F.regexp_replace(_col(text), marks, ""), space, "")
    return F.when(out == "", _col(text)).otherwise(out)


def is_all_caps(text: Column | str) -> Column:
    letters = F.regexp_replace(_col(text), r"\P{L}", "")
    return (F.upper(letters) == letters) & (F.lower(letters) != letters)


def greek_lower(text: Column | str) -> Column:
    """Lower case with the final sigma where a word ends."""
    return F.regexp_replace(F.translate(F.lower(_col(text)), "ς", "σ"), r"σ(?=\P{L}|$)", "ς")


def _agreement(word: str, lang: str | None) -> str:
    marks = unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).replace("\u0300", "\u0301"))
    marks = "".join("\u2019" if c in ELISION else c for c in marks if c not in INVISIBLE)
    primary = (lang or "").lower().split("-")[0]
    if primary in BARE:
        marks = _bare(marks)
    out = " ".join(marks.lower().replace("ς", "σ").split())
    return out.translate(UV) if primary in LATIN else out


def agreement(word: Column | str, lang: Column | str | None = None) -> Column:
    """The key two words agree by: case, grave for acute, kinds of elision mark don't count; punctuation and accents do."""

    def run(words: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else _agreement(w, x) for w, x in zip(words, langs, strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(_col(word), F.lit(None).cast("string") if lang is None else _col(lang))


def _archetype(text: str) -> str:
    letters = unicodedata.normalize("NFD", text).replace("\u0345", "ι")
    out = "".join(c for c in letters if unicodedata.category(c)[0] == "L" and c != "\u02bc").upper()
    return out.replace("ς", "Σ").replace("V", "U").replace("J", "I")


def archetype_letters(text: Column | str) -> Column:
    """Capital letters alone, an iota subscript as an iota, v as u and j as i."""
    return _vectorised(_archetype)(_col(text))


def differ_only_in_fold(a: Column, b: Column, fold_a: Column, fold_b: Column) -> Column:
    return (a != b) & (fold_a == fold_b)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(_col(a), _col(b)) / longer)


def number_key(value: Column | str, width: int = 8) -> Column:
    """Sort key of a numbered level: leading digits padded at the left (never cut), the rest as it is."""
    digits, rest = F.regexp_extract(_col(value), r"^(\d*)", 1), F.regexp_extract(_col(value), r"^\d*(.*)$", 1)
    return F.concat(F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"), rest)


def text_key(value: Column | str, width: int = 8) -> Column:
    v = _col(value)
    return F.rpad(v, F.greatest(F.lit(width), F.length(v)), " ")


def sort_key(*levels: Column) -> Column:
    return F.concat_ws(".", *levels)


def next_label(label: Column | str) -> Column:
    """The label after: trailing digits count on and keep their width; else a trailing letter a to y moves on; else null."""
    t = _col(label)
    head, digits = F.regexp_extract(t, r"^(.*?)(\d*)$", 1), F.regexp_extract(t, r"(\d*)$", 1)
    counted = (F.when(digits == "", F.lit("0")).otherwise(digits).cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")
    numbered = F.concat(head, F.lpad(counted, F.greatest(F.length(digits), F.length(counted)), "0"))
    last = F.substring(t, -1, 1)
    lettered = F.concat(F.expr("left({0}, length({0}) - 1)".format("`" + label + "`")) if isinstance(label, str) else F.regexp_replace(t, ".$", ""), F.char(F.ascii(last) + 1))
    return F.when(digits != "", numbered).when(last.rlike("^[a-y]$"), lettered)


def letter_suffix(n: Column) -> Column:
    """a, b, ..., z, aa, ab, ..., zz, aaa, ... for 1, 2, ...; as many letters as the number needs (a long needs 14 at most)."""
    n, letters = n.cast("long"), []
    for k in range(13, -1, -1):
        least = sum(26**j for j in range(k + 1))  # the first number of k + 1 letters
        letters.append(F.when(n >= least, F.char(F.call_function("div", n - least, F.lit(26**k)) % 26 + 97)).otherwise(""))
    return F.concat(*letters)


def unbracketed(text: Column | str) -> Column:
    """Without the one pair of brackets that encloses all of it; brackets that close before the end stay."""
    t = _col(text)
    inner = F.regexp_extract(t, r"^\[([^\[\]]*)\]$|^\(([^()]*)\)$", 0)
    return F.when(inner != "", F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def slugify(text: Column | str) -> Column:
    out = F.regexp_replace(F.lower(strip_diacritics(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def orcid_ok(orcid: Column | str) -> Column:
    """Whether the last character of an identifier of 16 is its check character (ISO 7064, MOD 11-2)."""
    digits = F.regexp_replace(_col(orcid), "-", "")
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0), lambda s, d: F.when(d == "", s).otherwise((s + d.cast("int")) * 2))
    rest = (12 - total % 11) % 11
    return F.when(digits.rlike(r"^\d{15}[\dX]$"), F.substring(digits, 16, 1) == F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string"))).otherwise(False)
