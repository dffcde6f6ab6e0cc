"""Identifiers, licences, rights statements and passage addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import orcid_ok

#: How free a licence is, most free first.
LICENCES = ["cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0"]
#: The rights statements an image may carry, and whether it may then be copied.
CREATIVE_COMMONS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
PUBLIC_DOMAIN = ["publicdomain/mark/1.0/", "publicdomain/zero/1.0/"]
COPYABLE_STATEMENTS, OTHER_STATEMENTS = ["NoC-NC", "NoC-OKLR"], ["InC", "InC-EDU", "InC-NC", "CNE", "UND", "NKC"]
#: Schemes of identifiers whose values are digits.
DIGIT_SCHEMES = ["diktyon", "trismegistos", "viaf"]
CTS_WORK = r"^urn:cts:[^:\s]+:[^:\s]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_orcid(value: Column | str) -> Column:
    """Four groups of four; null where the value is none or its check character is wrong."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(_trim(_col(value)), r"(?i)^https?://(www\.)?orcid\.org/", ""), r"[\s-]", ""))
    return F.when(orcid_ok(bare), F.regexp_replace(bare, r"^(.{4})(.{4})(.{4})(.{4})$", "$1-$2-$3-$4"))


def licence_compatible(source: Column, target: Column) -> Column:
    """Whether what has one licence may enter what has the other: only into the same or a less free one."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(LICENCES) for x in (name, i)])
    return F.coalesce(F.element_at(rank, F.lower(source)) <= F.element_at(rank, F.lower(target)), F.lit(False))


def _statements() -> list[tuple[str, bool]]:
    cc = "https://creativecommons.org/"
    free = [(cc + x, True) for x in PUBLIC_DOMAIN] + [(f"{cc}licenses/{x}/4.0/", True) for x in CREATIVE_COMMONS]
    rs = [(x, True) for x in COPYABLE_STATEMENTS] + [(x, False) for x in OTHER_STATEMENTS]
    return free + [(f"http://rightsstatements.org/vocab/{x}/1.0/", copy) for x, copy in rs]


def normal_rights(value: Column | str) -> Column:
    """The listed address of a rights statement, else null.

    Looked up by host and path, so with either protocol, in any case, with or
    without the last slash, and with a deed or legalcode page (of any language) under it.
    """
    parts = F.split(F.lower(_trim(_col(value))), "/")
    page = F.coalesce(F.get(parts, F.lit(6)), F.lit(""))
    well_formed = F.get(parts, F.lit(0)).isin("http:", "https:") & (F.get(parts, F.lit(1)) == "") & (F.size(parts) <= 7) & page.rlike(r"^((deed|legalcode)(\.[a-z-]+)?)?$")
    listed = F.create_map(*[F.lit(x) for uri, _ in _statements() for x in ("/".join(uri.lower().split("/")[2:6]), uri)])
    return F.when(well_formed, F.element_at(listed, F.array_join(F.slice(parts, 3, 4), "/")))


def is_copyable(uri: Column | str) -> Column:
    return F.coalesce(_col(uri).isin([u for u, copy in _statements() if copy]), F.lit(False))


def passage_urn(work: Column, levels: list[Column]) -> Column:
    """The work's URN and the levels up to the first one that is missing or blank; null without a work's URN or a level."""
    urn, known, parts = _trim(work), F.lit(True), []
    for level in levels:
        value = _trim(level)
        known = known & F.coalesce(value != "", F.lit(False))
        parts.append(F.when(known, value))
    joined = F.concat_ws(".", *parts)
    return F.when(urn.rlike(CTS_WORK) & (joined != ""), F.concat_ws(":", urn, joined))


def normal_identifier(scheme: Column | str, value: Column | str) -> Column:
    """The value of an identifier as it is kept, or null where its scheme does not allow it."""
    s, v = _col(scheme), _trim(_col(value))
    item = F.regexp_replace(v, "^q", "Q")
    checked = (
        F.when(s == "cts", F.when(v.rlike(CTS_WORK), v)).when(s == "wikidata", F.when(item.rlike(r"^Q[1-9]\d*$"), item))
        .when(s.isin(DIGIT_SCHEMES), F.when(v.rlike(r"^\d+$"), v)).when(s == "url", F.when(v.rlike(r"^https?://[^\s/?#]+[^\s]*$"), v)).when(s == "other", v)
    )
    return F.when((v != "") & (F.length(v) <= 300), checked)


def identifier_href(scheme: Column | str, value: Column | str) -> Column:
    """Where an identifier is looked up, for the schemes that have such a place."""
    s, v = _col(scheme), normal_identifier(scheme, value)
    #: The addresses of the resolvers.
    places = {"wikidata": ("https://www.wikidata.org/wiki/", ""), "viaf": ("https://viaf.org/viaf/", ""), "trismegistos": ("https://www.trismegistos.org/text/", ""), "diktyon": ("https://pinakes.irht.cnrs.fr/notices/cote/", "/")}
    found = F.when(s == "url", v)
    for name, (before, after) in places.items():
        found = found.when(s == name, F.concat(F.lit(before), v, F.lit(after)))
    return found


def union_identifiers(a: Column | str, b: Column | str) -> Column:
    """Typed identifiers of both, each once, in order."""
    return F.array_union(a, b)
