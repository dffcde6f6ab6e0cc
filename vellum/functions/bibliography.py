"""Bibliography entries: names, years, labels and citations.

An entry is a type, a key and a map of fields. Names are written in lists that
`and` parts, "Family, Given" or "Given Family"; braces keep a name in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME = "struct<family:string,given:string>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unbraced(c: Column) -> Column:
    return _trim(F.translate(c, "{}", ""))


def parse_names(value: Column | str) -> Column:
    """The names of a list in order; a particle in lower case belongs to the family name."""
    text = F.col(value) if isinstance(value, str) else value
    # what stands in braces holds no separator: its spaces and commas are set aside first
    held = F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0)), lambda x: F.when(x.startswith("{"), F.translate(x, " ,", "\u0001\u0002")).otherwise(x)))
    names = F.filter(F.transform(F.split(held, r"(?i)(?<=\s)and(?=\s)"), _trim), lambda x: x != "")

    def free(c: Column) -> Column:
        return _unbraced(F.translate(c, "\u0001\u0002", " ,"))

    def one(name: Column) -> Column:
        parts = F.transform(F.split(name, ","), _trim)
        words = F.split(name, r"\s+")
        n = F.size(words)
        low = F.array_position(F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda w: F.translate(w, "{", "").rlike(r"^\p{Ll}")), F.lit(True)).cast("int")
        start = F.when(low > 0, low).otherwise(n)
        comma = F.struct(free(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")).alias("family"), free(F.element_at(parts, -1)).alias("given"))
        plain = F.struct(free(F.array_join(F.slice(words, start, n), " ")).alias("family"), free(F.array_join(F.slice(words, 1, start - 1), " ")).alias("given"))
        return F.when(F.size(parts) > 1, comma).when(n < 2, F.struct(free(name).alias("family"), F.lit("").alias("given"))).otherwise(plain)

    return F.transform(names, one)


def serialize_names(names: Column) -> Column:
    """Names back to a list, each "Family, Given"; a family name of several words that stands alone is braced."""

    def one(x: Column) -> Column:
        bare = F.when(x["family"].contains(" "), F.concat(F.lit("{"), x["family"], F.lit("}"))).otherwise(x["family"])
        return F.when(x["given"] == "", bare).otherwise(F.concat_ws(", ", x["family"], x["given"]))

    return F.array_join(F.transform(F.filter(names, lambda x: x["family"] != ""), one), " and ")


def _families(names: Column) -> Column:
    """One name, two with "and", more as "et al."; a name "others" counts as more."""
    known = F.filter(F.transform(names, lambda x: x["family"]), lambda x: x != "")
    others = F.array_position(F.transform(known, F.lower), F.lit("others"))
    first, second = F.get(known, F.lit(0)), F.get(known, F.lit(1))
    more = F.concat(first, F.lit(" et al."))
    return F.when((F.size(known) == 0) | (others == 1), "").when(others > 1, more).when(F.size(known) == 1, first).when(F.size(known) == 2, F.concat_ws(" and ", first, second)).otherwise(more)


def citation_year(fields: Column) -> Column:
    """The first four digits of date, else of year, else empty."""
    found = [F.regexp_extract(F.coalesce(fields[f], F.lit("")), r"\d{4}", 0) for f in ("date", "year")]
    return F.when(found[0] != "", found[0]).otherwise(found[1])


def _title(fields: Column) -> Column:
    head = _trim(F.get(F.split(_unbraced(F.coalesce(fields["title"], F.lit(""))), "[:.;?!]"), F.lit(0)))
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    short = _unbraced(F.coalesce(fields["shorttitle"], F.lit("")))
    return F.when(short != "", short).otherwise(F.array_join(F.when(F.size(words) <= 4, words).otherwise(F.slice(words, 1, 3)), " "))


def citation_label(fields: Column, key: Column) -> Column:
    """Author and year by which an entry is cited: author, editor or translator, else a body, else the title; else its key."""
    people = [_families(parse_names(F.coalesce(fields[f], F.lit("")))) for f in ("author", "editor", "translator")]
    bodies = [_unbraced(F.get(F.split(F.coalesce(fields[f], F.lit("")), r"(?i)\sand\s"), F.lit(0))) for f in ("organization", "institution", "publisher")]
    named = F.coalesce(*(F.when(x != "", x) for x in [*people, *bodies, _title(fields)]))
    year = citation_year(fields)
    label = F.concat_ws(" ", named, F.when(year != "", year))
    return F.when(label == "", key).otherwise(label)


#: The order in which fields are written.
FIELD_ORDER = ["author", "editor", "title", "journaltitle", "booktitle", "date", "volume", "number", "pages", "publisher", "location", "doi", "url"]


def serialized(kind: Column, key: Column, fields: Column) -> Column:
    """An entry as text: known fields in their order, the others by name."""
    rank = F.create_map(*[F.lit(x) for i, f in enumerate(FIELD_ORDER) for x in (f, i)])
    rows = F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(F.element_at(rank, e["key"]), F.lit(len(FIELD_ORDER))).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
    lines = F.transform(F.array_sort(rows), lambda e: F.concat(F.lit("  "), e["k"], F.lit(" = {"), e["v"], F.lit("},\n")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ""), F.lit("}"))


def reference(fields: Column, key: Column) -> Column:
    """A reference in one line: names, title, place and year, as far as they are given."""
    people = _families(parse_names(F.coalesce(fields["author"], fields["editor"], F.lit(""))))
    year = citation_year(fields)
    place = F.concat_ws(": ", F.when(F.coalesce(fields["location"], F.lit("")) != "", fields["location"]), F.when(F.coalesce(fields["publisher"], F.lit("")) != "", fields["publisher"]))
    parts = [F.when(people != "", people), F.when(F.coalesce(fields["title"], F.lit("")) != "", _unbraced(fields["title"])), F.when(place != "", place), F.when(year != "", year)]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", key).otherwise(F.concat(text, F.lit(".")))


def format_citation(label: Column, before: Column, after: Column) -> Column:
    """A citation with what stands before and after it: before label, after."""
    own = lambda c: F.when(_trim(c) != "", _trim(c))
    return F.concat_ws(", ", F.concat_ws(" ", own(before), label), own(after))
