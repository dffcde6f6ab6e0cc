"""Bibliography files: entries with their fields, from text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Other names of entry types and of fields, in the order of the format's manual, and the macros of months.
TYPES = {"conference": "inproceedings", "electronic": "online", "mastersthesis": "thesis", "phdthesis": "thesis", "techreport": "report", "www": "online"}
FIELDS = {"address": "location", "annote": "annotation", "archiveprefix": "eprinttype", "journal": "journaltitle", "key": "sortkey", "pdf": "file", "primaryclass": "eprintclass", "school": "institution"}
#: The field type that a name of an entry type stands for.
IMPLIED = {"mastersthesis": "mathesis", "phdthesis": "phdthesis", "techreport": "techreport"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
HEAD = re.compile(r"@\s*(\w+)\s*([{(])\s*")


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """The value that begins at a place, its parts joined by #, and where it ends."""
    out = ""
    while True:
        at = _skip(text, at)
        if text[at] == "{":
            depth, begin = 0, at + 1
            while True:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
                if not depth:
                    break
            out += text[begin : at - 1]
        elif text[at] == '"':
            begin, depth, at = at + 1, 0, at + 1
            while text[at] != '"' or depth:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
            out, at = out + text[begin:at], at + 1
        else:
            word = re.compile(r"[^\s,#{}()]+").match(text, at)
            if not word:
                raise ValueError("no value")
            out, at = out + macros.get(word[0].lower(), word[0]), word.end()
        at = _skip(text, at)
        if text[at : at + 1] != "#":
            return " ".join(out.split()), at
        at += 1


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def entries(text: str) -> list[dict]:
    """kind, key, fields of each entry; one that cannot be read has the reason as its fault, and reading goes on after it."""
    macros = {m: str(i) for i, m in enumerate(MONTHS, 1)}
    out, at = [], 0
    while head := HEAD.search(text, at):
        kind, at = head[1].lower(), head.end()
        if kind in ("comment", "preamble"):
            continue
        close = "}" if head[2] == "{" else ")"
        try:
            key = ""
            if kind != "string":
                key, at = text[at : text.index(",", at)].strip(), text.index(",", at) + 1
                if not re.fullmatch(r'[^{}()"#\\]+', key):
                    raise ValueError(f"no usable key: {key!r}")
            fields: dict[str, str] = {}
            while (at := _skip(text, at)) < len(text) and text[at] != close:
                name = re.compile(r"([\w-]+)\s*=").match(text, at)
                if not name:
                    raise ValueError(f"no field at {text[at : at + 20]!r}")
                value, at = _value(text, name.end(), macros)
                word = name[1].lower()
                fields[word if kind == "string" else FIELDS.get(word, word)] = value  # of two the last stays
                at = _skip(text, at)
                at += text[at : at + 1] == ","
            if at >= len(text):
                raise ValueError("the entry has no end")
        except (ValueError, IndexError) as e:
            out.append({"kind": kind, "key": None, "fields": {}, "fault": str(e)})
            continue
        if kind == "string":
            macros |= {k: v for k, v in fields.items()}
        else:
            implied = {"type": IMPLIED[kind]} if kind in IMPLIED else {}
            out.append({"kind": TYPES.get(kind, kind), "key": key, "fields": implied | fields, "fault": None})
    return out


def dated(fields: Column) -> Column:
    """Fields with year and month made one date; they stay where there is a date, or the year is not four digits. A month that is none stays, too."""
    year, month = F.trim(fields["year"]), F.lower(F.trim(F.regexp_replace(fields["month"], "[{}]", "")))
    digits = F.when(month.rlike("^[0-9]{1,2}$"), month.cast("int"))
    n = F.coalesce(F.when(digits.between(1, 12), digits), F.nullif(F.array_position(F.lit(MONTHS), F.substring(month, 1, 3)), F.lit(0)).cast("int"))
    plain = F.coalesce(year.rlike("^[0-9]{4}$") & fields["date"].isNull(), F.lit(False))
    left = F.map_filter(fields, lambda k, v: (k != "year") & ((k != "month") | n.isNull()))
    return F.when(plain, F.map_concat(left, F.create_map(F.lit("date"), F.concat_ws("-", year, F.lpad(n.cast("string"), 2, "0"))))).otherwise(fields)


def read_biblatex(files: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, n, kind, key, fields (see dated), fault of the entries of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, value in zip(frame[doc], frame[text], strict=True):
                found = [{doc: key, "n": n, **e} for n, e in enumerate(entries(value or ""))]
                yield pd.DataFrame(found, columns=[doc, "n", "kind", "key", "fields", "fault"])

    read = files.select(doc, text).mapInPandas(run, f"{doc} {files.schema[doc].dataType.simpleString()}, n long, kind string, key string, fields map<string,string>, fault string")
    return read.withColumn("fields", dated(F.col("fields")))
