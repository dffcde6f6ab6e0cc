"""Citation schemes: labels and addresses of a work's units.

A scheme is a list of levels (key, kind number or text, separator before it);
an address is a map of level key to value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .text import number_key, sort_key, text_key

#: Names by which sources call a level, by the level's own name.
SYNONYMS = {
    "book": ["book", "liber", "bk", "rhapsody", "song", "canto"],
    "line": ["line", "l", "verse", "v", "linea"],
    "chapter": ["chapter", "cap", "caput", "ch"],
    "section": ["section", "sec", "sect", "paragraph", "par", "subsection"],
    "page": ["page", "p", "pag", "stephanus", "bekker", "pagina"],
    "column": ["column", "col"],
    "verse": ["verse", "v"],
    "fragment": ["fragment", "fr", "frag"],
    "poem": ["poem", "carmen", "ode", "epigram"],
    "letter": ["letter", "epistle", "ep"],
    "act": ["act"],
    "scene": ["scene"],
}


class Level(NamedTuple):
    key: str
    kind: str = "number"
    separator: str = "."


def _value(address: Column, level: Level) -> Column:
    return F.coalesce(address[level.key], F.lit(""))


def format_label(levels: Sequence[Level], address: Column) -> Column:
    """The printed label; levels without a value are left out with their separators."""
    parts = [F.when(_value(address, x) != "", F.concat(F.lit(x.separator if i else ""), _value(address, x))).otherwise("") for i, x in enumerate(levels)]
    return F.concat(*parts)


def address_key(levels: Sequence[Level], address: Column) -> Column:
    """Sorts addresses as the work runs."""
    return sort_key(*(number_key(_value(address, x)) if x.kind == "number" else text_key(_value(address, x)) for x in levels))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of the value, which is computed once a row, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _own(level: Level) -> str:
    return "[0-9]" if level.kind == "number" else "[^0-9]"


def _begins(level: Level, letter: Column) -> Column:
    digit = letter.between("0", "9")
    return digit if level.kind == "number" else (letter != "") & ~digit


def parse_label(levels: Sequence[Level], label: Column | str) -> Column:
    """The address of a label as a map, or null where it is none of the scheme.

    Read from the right, each level has the places from which it and all that
    follow can be read; then, from the left, each level ends at its separator's
    first place from which the rest can be read. A number begins with a digit;
    where a level has no separator before it, the level above has all that is of
    its own kind, so levels of one kind need one (see scheme_faults).
    """
    last = len(levels) - 1

    def read(text: Column) -> Column:
        size = F.char_length(text)
        places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))

        def rest(at: Column) -> Column:
            return F.substring(text, at, size)

        def run(at: Column, level: Level) -> Column:
            """How many characters from there are of the level's kind."""
            return F.char_length(F.regexp_extract(rest(at), f"^{_own(level)}*", 0))

        def begins(at: Column, i: int) -> Column:
            free = levels[i].kind == "text" and (i == 0 or levels[i].separator != "")
            return F.lit(True) if free else _begins(levels[i], F.substring(text, at, F.lit(1)))

        def leftwards(i: int, following: Column, ends: list[Column | None]) -> Column:
            """following: the places where level i + 1 may begin; ends: of the levels after i, where the separator to the next may stand."""
            parted = levels[i + 1].separator
            if parted:

                def before(own: Column) -> Column:
                    after = F.array_max(own)
                    if i == 0:
                        return F.when((after > 1) & begins(F.lit(1), 0), rightwards(0, F.lit(1), [], [own, *ends]))
                    return _let(F.filter(places, lambda p: (p < after) & begins(p, i)), lambda x: leftwards(i - 1, x, [own, *ends]))

                stand = F.transform(following, lambda p: p - len(parted))
                return _let(F.filter(stand, lambda p: (p > 0) & (F.substring(text, p, F.lit(len(parted))) == parted)), before)

            def readable(p: Column) -> Column:
                return _let(run(p, levels[i]), lambda n: (n > 0) & F.array_contains(following, p + n))

            if i == 0:
                return F.when(readable(F.lit(1)), rightwards(0, F.lit(1), [], [None, *ends]))
            return _let(F.filter(places, readable), lambda x: leftwards(i - 1, x, [None, *ends]))

        def rightwards(i: int, at: Column, found: list[Column], ends: list[Column | None]) -> Column:
            if i == last:
                values = F.array(*map(F.btrim, [*found, rest(at)]))
                named = lambda v: F.create_map(*[x for k, level in enumerate(levels) for x in (F.lit(level.key), F.get(v, F.lit(k)))])
                return _let(values, lambda v: F.when(~F.array_contains(v, ""), named(v)))
            own = ends[i]
            end = at + run(at, levels[i]) if own is None else F.array_min(F.filter(own, lambda p: p > at))
            width = len(levels[i + 1].separator)
            return _let(end, lambda p: rightwards(i + 1, p + width, [*found, F.substring(text, at, p - at)], ends))

        if last == 0:
            return F.when((size > 0) & begins(F.lit(1), 0), rightwards(0, F.lit(1), [], [None]))
        return _let(F.filter(places, lambda p: begins(p, last)), lambda x: leftwards(last - 1, x, [None]))

    return _let(F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"(?U)^\s+|\s+$", ""), read)


def scheme_faults(levels: Sequence[Level]) -> list[str]:
    """What keeps a scheme from dividing its labels; empty for a sound one."""
    keys = [x.key for x in levels]
    found = [] if levels else ["no level"]
    found += [f"level {i + 1} has no key" for i, k in enumerate(keys) if not k]
    found += [f"two levels have the key {k}" for i, k in enumerate(keys) if k in keys[:i]]
    return found + [f"nothing parts {a.key} and {b.key}" for a, b in zip(levels, levels[1:], strict=False) if b.separator == "" and a.kind == b.kind]


def propose_mapping(units: Sequence[str], levels: Sequence[Level]) -> dict[str, str]:
    """Which level each kind of unit of a source fills: by name, by synonym, and the last of both by what is left."""

    def plain(x: str) -> str:
        return re.sub("[^a-z]", "", x.lower())

    free, found = [x.key for x in levels], {}
    for unit in units:
        names = [k for k in free if plain(k) == plain(unit)] + [k for k in free if plain(unit) in SYNONYMS.get(plain(k), [])]
        if names:
            found[unit] = names[0]
            free.remove(names[0])
    rest = [u for u in units if u not in found]
    return found | ({rest[0]: free[0]} if len(free) == len(rest) == 1 else {})


def resolve_starts(starts: DataFrame, levels: Sequence[Level], doc: str, order: str) -> DataFrame:
    """Adds address and label to starts that give some levels (a column each, null: not given): a higher level goes on from the start before.

    A start without its lowest level, or whose higher levels nobody gave yet, has a null address.
    """
    over = Window.partitionBy(doc).orderBy(order)
    given = {x.key: F.col(x.key) for x in levels}
    lowest = levels[-1].key
    # only a start that resolves hands its levels on; it resolves if its lowest level is given and each higher one is known
    usable = starts.withColumn("__ok", given[lowest].isNotNull() & (given[lowest] != ""))
    filled = {k: F.last(F.when(F.col("__ok"), c), ignorenulls=True).over(over) for k, c in given.items() if k != lowest}
    rows = usable.withColumns({f"__{k}": c for k, c in filled.items()}).withColumn(f"__{lowest}", given[lowest])
    known = F.col("__ok")
    for x in levels:
        known = known & F.col(f"__{x.key}").isNotNull()
    address = F.when(known, F.create_map(*[y for x in levels for y in (F.lit(x.key), F.col(f"__{x.key}"))]))
    out = rows.withColumn("address", address).drop("__ok", *(f"__{x.key}" for x in levels))
    return out.withColumn("label", F.when(F.col("address").isNotNull(), format_label(levels, F.col("address"))))


def relabel(segments: DataFrame, old: Sequence[Level], new: Sequence[Level], label: str) -> DataFrame:
    """After a change of scheme: label and sort_key anew from each address, kept by the position of the level; null where a level is missing."""
    wholes = lambda a: F.create_map(*[x for o, n in zip(old, new, strict=False) for x in (F.lit(n.key), a[o.key])])
    shown = lambda m: F.struct(format_label(new, m).alias("new_label"), address_key(new, m).alias("new_key"))
    none = F.lit(None).cast("struct<new_label:string,new_key:string>")
    made = _let(parse_label(old, label), lambda a: F.when(a.isNotNull(), _let(wholes(a), shown))) if len(new) <= len(old) else none
    return segments.withColumn("__a", made).withColumn("new_label", F.col("__a.new_label")).withColumn("new_key", F.col("__a.new_key")).drop("__a")


def label_ranges(rows: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """keys, ranges: runs of consecutive values of order as first–last labels, a single one by itself, joined by commas."""
    over = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("__i", F.col(order) - F.row_number().over(over))
    runs = numbered.groupBy(*keys, "__i").agg(F.min(order).alias("__at"), F.min_by(label, order).alias("a"), F.max_by(label, order).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit("–"), "b"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", shown.alias("s")))), lambda x: x["s"]), ", ").alias("ranges"))
