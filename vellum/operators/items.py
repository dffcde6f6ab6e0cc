"""Item streams: the words, runs, lines, paragraphs and units derived from the items of a document.

items has one row for each item: the document, pos (its order), id, kind (token,
break, object), type (of a break: line, column, page, paragraph; of an object:
gap, figure, note, ...), form, norm (null: as written), lang, join_next,
unchecked, has_start with seg_id and seg_part (a start without a segment has a
null seg_id), page_id, lineation, marks and attrs; operators use the columns that
they name. All windows of a document stand over one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

MARKS = "array<struct<kind:string,attrs:map<string,string>,from:int,to:int>>"


def _over(doc: str, pos: str = "pos"):  # noqa: ANN202
    return Window.partitionBy(doc).orderBy(pos)


def _rows_before(doc: str, pos: str = "pos"):  # noqa: ANN202
    return _over(doc, pos).rowsBetween(Window.unboundedPreceding, -1)


def read_form() -> Column:
    return F.coalesce("norm", "form")


def started(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds run: how many runs have begun; text before the first start is a run from its first token or object on (0 before that)."""
    over = _over(doc)
    real = F.col("kind") != "break"
    starts = F.sum(F.when(real & F.col("has_start"), 1).otherwise(0)).over(over)
    leading = F.coalesce(F.max(F.when(real & ~F.col("has_start"), 1)).over(over), F.lit(0))
    first_is_start = F.first(F.when(real, F.col("has_start")), ignorenulls=True).over(over)
    run = starts + F.when((leading == 1) & ~F.coalesce(first_is_start, F.lit(True)), 1).otherwise(0)
    return items.withColumn("run", run.cast("long"))


def segment_runs(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, run, seg_id, part, from, to (exclusive) of every run, in the order of the stream."""
    rows = started(items, doc).where("run > 0")
    first = F.min_by(F.struct(F.when(F.col("has_start"), F.col("seg_id")).alias("seg_id"), F.when(F.col("has_start"), F.coalesce("seg_part", F.lit(1))).otherwise(1).alias("part")), "pos")
    runs = rows.groupBy(doc, "run").agg(first.alias("s"), F.min("pos").alias("from"), (F.max("pos") + 1).alias("to"))
    return runs.select(doc, "run", "s.seg_id", "s.part", "from", "to")


def runs_by_segment(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The runs of each segment in the order of its content (part, then place): adds nth."""
    runs = segment_runs(items, doc).where("seg_id IS NOT NULL")
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy(doc, "seg_id").orderBy("part", "from")).cast("long"))


def segment_order(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, seg_id, nth: the segments of a document by first appearance."""
    first = segment_runs(items, doc).where("seg_id IS NOT NULL").groupBy(doc, "seg_id").agg(F.min("from").alias("first_at"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(doc).orderBy("first_at")).cast("long"))


def segment_at(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds at_segment and at_part: those of the nearest start at or before each item."""
    start = F.when((F.col("kind") != "break") & F.col("has_start"), F.struct("seg_id", F.coalesce("seg_part", F.lit(1)).alias("part")))
    return items.withColumn("__s", F.last(start, ignorenulls=True).over(_over(doc))).withColumn("at_segment", F.col("__s.seg_id")).withColumn("at_part", F.col("__s.part")).drop("__s")


def lines(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, line, opener (id of the break that opens it), from, to of every line, those without items too."""
    numbered = items.withColumn("line", F.sum((F.col("kind") == "break").cast("long")).over(_over(doc)))
    ends = numbered.groupBy(doc, "line").agg(F.min_by("kind", "pos").alias("first"), F.min_by("id", "pos").alias("id"), F.min("pos").alias("low"), (F.max("pos") + 1).alias("to"))
    opened = F.col("first") == "break"
    own = ends.select(doc, "line", F.when(opened, F.col("id")).alias("opener"), F.when(opened, F.col("low") + 1).otherwise(F.col("low")).alias("from"), "to")
    # a stream that opens with a break has an empty line before it
    empty = ends.where((F.col("line") == 1)).join(ends.where("line = 0").select(doc), doc, "left_anti").select(doc, F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("opener"), F.col("low").alias("from"), F.col("low").alias("to"))
    return own.unionByName(empty)


def line_of(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds line: the breaks before each item."""
    return items.withColumn("line", F.coalesce(F.sum((F.col("kind") == "break").cast("long")).over(_rows_before(doc)), F.lit(0)))


def _paragraph(convention: str, doc: str, *, strict: bool = False) -> Column:
    own = F.when((F.col("kind") == "break") & (F.col("type") == "paragraph"), F.coalesce("lineation", F.lit(convention)))
    return F.coalesce(F.last(own, ignorenulls=True).over(_rows_before(doc) if strict else _over(doc)), F.lit(convention))


def lineations(items: DataFrame, convention: str = "verse", doc: str = "doc_id") -> DataFrame:
    """Adds paragraph_kind: verse or prose, by the last paragraph break at or before each item, else the convention."""
    return items.withColumn("paragraph_kind", _paragraph(convention, doc))


def paragraph_kinds(items: DataFrame, convention: str = "verse", doc: str = "doc_id") -> DataFrame:
    """doc, break_id (null: the paragraph before the first break), kind; a break that opens the stream also kinds the first."""
    breaks = items.where("kind = 'break' AND type = 'paragraph'").select(doc, F.col("id").alias("break_id"), F.coalesce("lineation", F.lit(convention)).alias("paragraph_kind"))
    first = items.groupBy(doc).agg(F.min_by(F.struct("kind", "type", "lineation"), "pos").alias("f"))
    leads = (F.col("f.kind") == "break") & (F.col("f.type") == "paragraph")
    opening = first.select(doc, F.lit(None).cast("string").alias("break_id"), F.when(leads, F.coalesce("f.lineation", F.lit(convention))).otherwise(convention).alias("paragraph_kind"))
    return breaks.unionByName(opening)


def shown_breaks(items: DataFrame, convention: str = "verse", doc: str = "doc_id") -> DataFrame:
    """doc, id, shown: hyphen (a verse word divided at a line's end) or hidden (a break within a prose paragraph)."""
    rows = items.withColumn("k", _paragraph(convention, doc)).withColumn("next_kind", F.lead("kind").over(_over(doc)))
    hidden = (F.col("kind") == "break") & (F.col("type") != "paragraph") & (F.col("k") == "prose")
    hyphen = (F.col("kind") == "token") & F.coalesce("join_next", F.lit(False)) & (F.col("next_kind") == "break") & (F.col("k") == "verse")
    return rows.withColumn("shown", F.when(hidden, "hidden").when(hyphen, "hyphen")).where("shown IS NOT NULL").select(doc, "id", "shown")


def layout_lines(items: DataFrame, label: Column, every: int = 1, convention: str = "verse", doc: str = "doc_id") -> DataFrame:
    """doc, line, label (printed beside it or null), paragraph, lineation, page_id, n_items of every shown line.

    label gives a segment's label from seg_id. A line's label is that of the first
    segment that begins on it. In verse every n-th number is printed, and the first
    of the text; in prose each. Lines without items are left out unless they open a
    paragraph or a page.
    """
    rows = items.withColumn("line", F.sum((F.col("kind") == "break").cast("long")).over(_over(doc))).withColumn("k", _paragraph(convention, doc))
    real = F.col("kind") != "break"
    first_start = F.min_by(label, F.when(real & F.col("has_start") & F.col("seg_id").isNotNull(), F.col("pos")))
    by_line = rows.groupBy(doc, "line").agg(
        first_start.alias("own"), F.max_by("k", "pos").alias("lineation"), F.count_if(real).alias("n_items"),
        F.bool_or(~real & (F.col("type") == "paragraph")).alias("paragraph"), F.max(F.when(~real & (F.col("type") == "page"), F.col("page_id"))).alias("page_id"),
    )
    nth = F.count("own").over(Window.partitionBy(doc).orderBy("line"))
    number = F.regexp_extract("own", r"(\d+)[^\d]*$", 1)
    step = F.when(F.col("lineation") == "prose", F.lit(1)).otherwise(max(1, every))
    printed = F.when((nth == 1) | (step == 1) | ((number != "") & (number.cast("decimal(38,0)") % step == 0)), F.col("own"))
    shown = by_line.withColumn("label", printed).where("n_items > 0 OR paragraph OR page_id IS NOT NULL")
    return shown.select(doc, "line", "label", "paragraph", "lineation", "page_id", "n_items")


def run_on(lines_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines as shown: those of a prose paragraph are one. doc, line (the first), n_lines, n_items, label (the first line's), lineation."""
    over = Window.partitionBy(doc).orderBy("line")
    goes_on = (F.lag("lineation").over(over) == "prose") & (F.col("lineation") == "prose") & ~F.col("paragraph")
    numbered = lines_.withColumn("shown", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("long")).over(over))
    return numbered.groupBy(doc, "shown").agg(F.min("line").alias("line"), F.count("*").alias("n_lines"), F.sum("n_items").alias("n_items"), F.min_by(F.struct("label"), "line").alias("l"), F.min_by("lineation", "line").alias("lineation")).select(doc, "line", "n_lines", "n_items", "l.label", "lineation")


def continues_word(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds continues: whether the item before each token, breaks passed over, is a token that joins the next."""
    joins = F.when(F.col("kind") != "break", F.struct(((F.col("kind") == "token") & F.coalesce("join_next", F.lit(False))).alias("j")))
    before = F.last(joins, ignorenulls=True).over(_rows_before(doc))
    return items.withColumn("continues", (F.col("kind") == "token") & F.coalesce(before["j"], F.lit(False)))


def words(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, at (pos of its first token), run (that it begins in), form, norm, lang, ids, marks (of each token), length of each token, for every word."""
    tokens = continues_word(started(items, doc), doc).where("kind = 'token'")
    tokens = tokens.withColumn("at", F.last(F.when(~F.col("continues"), F.col("pos")), ignorenulls=True).over(_over(doc)))
    part = F.struct("pos", "id", "form", "norm", "lang", "run", "marks", F.length("form").alias("n"))
    found = tokens.groupBy(doc, "at").agg(F.collect_list(part).alias("p"))
    first = F.get("p", F.lit(0))
    ordered = found.withColumn("p", F.array_sort("p", lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)))
    joined = F.array_join(F.transform("p", lambda t: F.coalesce(t["norm"], t["form"])), "")
    return ordered.select(
        doc, "at", first["run"].alias("run"), F.array_join(F.transform("p", lambda t: t["form"]), "").alias("form"), F.coalesce(first["norm"], joined).alias("norm"),
        first["lang"].alias("lang"), F.transform("p", lambda t: t["id"]).alias("ids"), F.transform("p", lambda t: t["marks"]).alias("marks"), F.transform("p", lambda t: t["n"]).alias("lengths"),
    )


def _whole(marks: Column, length: Column, kind: str) -> Column:
    """The mark of a kind that covers a whole token, or null."""
    covers = F.filter(marks, lambda m: (m["kind"] == kind) & (m["from"].isNull() | ((m["from"] == 0) & (m["to"] == length))))
    return F.get(covers, F.lit(0))


def excluded(state: str = "corrected", *, up_to: int | None = None, hands: list[str] | None = None) -> Column:
    """Whether a word (as words() gives it) is left out of a state: corrected, original, stage (up_to) or hand (hands)."""

    def applies(mark: Column) -> Column:
        if state == "stage":
            return F.coalesce(mark["attrs"]["seq"].cast("double") <= up_to, F.lit(False))
        if state == "hand":
            return F.coalesce(mark["attrs"]["hand"].isin(hands or []), F.lit(False))
        return F.lit(state != "original")

    def all_of(kind: str) -> Column:
        return F.zip_with("marks", "lengths", lambda m, n: _whole(m, n, kind))

    added, deleted = all_of("add"), all_of("del")
    every = lambda marks: F.forall(marks, lambda m: m.isNotNull())
    return (every(added) & ~applies(F.get(added, F.lit(0)))) | (every(deleted) & applies(F.get(deleted, F.lit(0))))


def broken_by_gap() -> Column:
    """Whether a word has a gap as a point mark."""
    return F.exists("marks", lambda own: F.exists(F.coalesce(own, F.array().cast(MARKS)), lambda m: (m["kind"] == "gap") & (m["from"] == m["to"])))


def variant_spans(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, span, group, reading, ids, from: consecutive tokens whose variant marks have one group; a gap ends a span, breaks and other objects don't."""
    mark = F.get(F.filter("marks", lambda m: (m["kind"] == "variant") & m["attrs"]["group"].isNotNull()), F.lit(0))
    rows = items.where("kind = 'token' OR (kind = 'object' AND type = 'gap')").withColumn("v", F.when(F.col("kind") == "token", mark["attrs"]))
    group = F.col("v")["group"]
    over = _over(doc)
    starts = group.isNotNull() & ~F.coalesce(F.lag(group).over(over) == group, F.lit(False))
    found = rows.withColumn("span", F.sum(starts.cast("long")).over(over)).withColumn("group", group).where("group IS NOT NULL")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return found.groupBy(doc, "span", "group").agg(F.min_by(F.col("v")["reading"], "pos").alias("reading"), ids.alias("ids"), F.min("pos").alias("from"))


def units(items: DataFrame, state: str = "corrected", doc: str = "doc_id", **of: object) -> DataFrame:
    """doc, run, at, k, text (null: a gap), lang, ids of every unit that is compared: a word's read form, divided at spaces, or a gap.

    A word is read whole in the run where it begins. What is left of a word that a
    gap breaks counts with a gap directly before it in its run. In the state
    variant, the words of a noted variant give way to its reading, once.
    """
    found = words(items, doc).where(~F.coalesce(excluded("corrected" if state == "variant" else state, **of), F.lit(False)))
    if state == "variant":
        spans = variant_spans(items, doc).select(doc, "reading", F.col("ids").alias("span_ids"))
        member = spans.select(doc, "reading", "span_ids", F.explode("span_ids").alias("id"))
        first = F.get("span_ids", F.lit(0)) == F.col("id")
        hits = words(items, doc).select(doc, "at", F.posexplode("ids").alias("i", "id")).join(member, [doc, "id"])
        hits = hits.groupBy(doc, "at").agg(F.min_by(F.struct("reading", "span_ids", first.alias("begins")), "i").alias("v"))
        all_words = words(items, doc).join(hits, [doc, "at"], "left")
        kept = all_words.where(F.col("v.begins") | (F.col("v").isNull() & ~F.coalesce(excluded("corrected"), F.lit(False))))
        found = kept.withColumn("norm", F.when(F.col("v").isNotNull(), F.coalesce("v.reading", F.lit(""))).otherwise(F.col("norm"))).withColumn("ids", F.coalesce("v.span_ids", "ids")).withColumn("broken", broken_by_gap() & F.col("v").isNull()).drop("v")
    else:
        found = found.withColumn("broken", broken_by_gap())
    parts = F.filter(F.split("norm", r"(?U)\s+"), lambda x: x != "")
    read = found.withColumn("parts", F.when(F.col("broken"), F.array(F.lit(None).cast("string"))).otherwise(parts)).where(F.size("parts") > 0)
    read = read.select(doc, "run", "at", "parts", "lang", "ids", F.col("broken").alias("gap"), "broken")
    gaps = started(items, doc).where("kind = 'object' AND type = 'gap'").select(doc, "run", F.col("pos").alias("at"), F.array(F.lit(None).cast("string")).alias("parts"), F.lit(None).cast("string").alias("lang"), F.array().cast("array<string>").alias("ids"), F.lit(True).alias("gap"), F.lit(False).alias("broken"))
    over = Window.partitionBy(doc).orderBy("at")
    both = read.unionByName(gaps)
    merged = F.col("broken") & F.coalesce(F.lag("gap").over(over) & (F.lag("run").over(over) == F.col("run")), F.lit(False))
    left = both.withColumn("merged", merged).where("NOT merged")
    empty = F.array().cast("array<string>")
    return left.select(doc, "run", "at", F.when(F.col("gap"), F.lit(None)).otherwise(F.col("lang")).alias("lang"), F.when(F.col("gap"), empty).otherwise(F.col("ids")).alias("ids"), F.posexplode("parts").alias("k", "text"))


def segment_units(items: DataFrame, state: str = "corrected", doc: str = "doc_id", **of: object) -> DataFrame:
    """doc, seg_id, idx, text, lang, ids: the units of each segment, every run in the order of its content."""
    runs = runs_by_segment(items, doc).select(doc, "run", "seg_id", "nth")
    own = units(items, state, doc, **of).join(runs, [doc, "run"])
    idx = F.row_number().over(Window.partitionBy(doc, "seg_id").orderBy("nth", "at", "k")) - 1
    return own.select(doc, "seg_id", idx.cast("long").alias("idx"), "text", "lang", "ids")


def segments_joined(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, seg_id, runs_into: the segments that a word begun in a segment runs on into."""
    runs = segment_runs(items, doc).select(doc, "run", "seg_id")
    tokens = continues_word(started(items, doc), doc).where("kind = 'token'").select(doc, "pos", "run", "continues").join(runs, [doc, "run"])
    first = F.last(F.when(~F.col("continues"), F.struct("seg_id")), ignorenulls=True).over(_over(doc))
    rows = tokens.withColumn("first", first["seg_id"]).where("continues AND first IS NOT NULL AND seg_id IS NOT NULL AND first != seg_id")
    return rows.select(doc, F.col("first").alias("seg_id"), F.col("seg_id").alias("runs_into")).distinct()


def words_on_page(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page_id (null before the first page break), n: tokens of each page."""
    page = F.last(F.when((F.col("kind") == "break") & (F.col("type") == "page"), F.struct("page_id")), ignorenulls=True).over(_over(doc))
    return items.withColumn("p", page["page_id"]).where("kind = 'token'").groupBy(doc, F.col("p").alias("page_id")).agg(F.count("*").alias("n"))


def not_transcribed(items: DataFrame) -> DataFrame:
    """Gaps whose reason is an ellipsis: text that was left out, not lost."""
    return items.where((F.col("kind") == "object") & (F.col("type") == "gap") & (F.col("attrs")["reason"] == "ellipsis"))


def unmapped_tokens(items: DataFrame, zones: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tokens that no zone has; zones has the document and token_ids."""
    mapped = zones.select(doc, F.explode("token_ids").alias("id"))
    return items.where("kind = 'token'").join(mapped, [doc, "id"], "left_anti")


def unchecked_tokens(items: DataFrame) -> DataFrame:
    return items.where("kind = 'token' AND unchecked")


def to_plain(items: DataFrame, convention: str = "verse", doc: str = "doc_id") -> DataFrame:
    """doc, text: read forms with spaces between words, \\n at shown breaks, hyphens at a verse word's division, (...) for a gap."""
    shown = shown_breaks(items, convention, doc)
    over = _over(doc)
    rows = items.join(shown, [doc, "id"], "left").withColumn("next_kind", F.lead("kind").over(over)).withColumn("joined", F.coalesce("join_next", F.lit(False)))
    rows = rows.withColumn("text", F.when(F.col("kind") == "token", read_form()).when((F.col("kind") == "object") & (F.col("type") == "gap"), "(...)"))
    broken = (F.col("kind") == "break") & ~F.coalesce(F.col("shown") == "hidden", F.lit(False))
    after = F.when(F.col("shown") == "hyphen", "-").when(F.col("joined"), "").when(F.col("text").isNotNull(), " ").otherwise("")
    piece = F.when(broken, "\n").when(F.col("text").isNotNull(), F.concat("text", after)).otherwise("")
    joined = rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return joined.select(doc, F.regexp_replace(F.regexp_replace("text", " +(\n|$)", "$1"), " +", " ").alias("text"))
