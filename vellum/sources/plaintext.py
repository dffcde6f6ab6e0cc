"""Plain text with numbers in it: how a text is numbered, and its words with the labels they begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Fixed values, which the results depend on. A label is a number, then any further numbers each after a dot or a
#: colon, then perhaps one letter, which a number may follow (12.3b4). It stands at a line's start, where one dot
#: or bracket may close it, or at a line's end, with blanks between it and the words, or anywhere in brackets.
LABEL = r"\d+(?:[.:]\d+)*(?:[a-zA-Z]\d*)?"
LINE_START = rf"^[ \t]*({LABEL})[.)]?[ \t]+(?=\S)"
LINE_END = rf"(?<=\S)[ \t]+({LABEL})[ \t]*$"
BRACKETED = rf"[\[(]({LABEL})[\])]"
#: A label lifted out of a line: a mark, the label, a space.
MARK = "\u0001"


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line, text of every line."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    return docs.select(doc, F.posexplode(F.split(clean, "\n", -1)).alias("line", "text"))


def _margin() -> Column:
    start = F.regexp_extract("text", LINE_START, 1)
    return F.when(start != "", start).otherwise(F.regexp_extract("text", LINE_END, 1))


def detect_numbering(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, rank, kind, score, matches, sample: the ways in which a text may be numbered, the likeliest first.

    A margin counts where its numbers stand on every n-th line, two lines apart at
    least, and go on by the lines between them; numbers at line starts by how many
    lines have them; brackets by how many there are; a number for every line where
    nine lines in ten are short, unless the text is numbered otherwise.
    """
    rows = lines.where(F.trim("text") != "").withColumn("at", F.row_number().over(Window.partitionBy(doc).orderBy("line")) - 1)
    rows = rows.withColumn("start", F.regexp_extract("text", LINE_START, 1)).withColumn("margin", _margin()).withColumn("brackets", F.regexp_extract_all("text", F.lit(BRACKETED), F.lit(1)))
    hit = F.struct("at", F.col("margin").alias("label"))
    by_doc = rows.groupBy(doc).agg(
        F.count("*").alias("n"), F.count_if(F.col("start") != "").alias("starts"), F.min_by("start", F.when(F.col("start") != "", F.col("at"))).alias("start_sample"),
        F.sum(F.size("brackets")).alias("n_brackets"), F.min_by(F.get("brackets", F.lit(0)), F.when(F.size("brackets") > 0, F.col("at"))).alias("bracket_sample"),
        F.count_if(F.length("text") <= 100).alias("short"), F.min_by(F.substring(F.trim("text"), 1, 60), "at").alias("first_line"),
        F.array_sort(F.collect_list(F.when(F.col("margin") != "", hit))).alias("hits"),
    )
    gaps = F.transform(F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0))), lambda x, i: x["at"] - F.get("hits", i)["at"])
    by_doc = by_doc.withColumn("gaps", gaps).withColumn("every", F.array_min("gaps"))
    numeric = F.forall("hits", lambda h: h["label"].rlike(r"^\d+$"))
    advance = F.forall(F.zip_with(F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0))), F.transform("gaps", lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h, g: h["label"].cast("double") - F.get("hits", g["i"])["label"].cast("double") == g["g"]), lambda ok: F.coalesce(ok, F.lit(False)))
    regular = F.coalesce((F.col("every") >= 2) & F.forall("gaps", lambda g: g % F.col("every") == 0) & (~numeric | advance), F.lit(False))
    share = F.col("starts") / F.col("n")
    bracket = F.when(F.col("n_brackets") >= 2, 2 + F.least(F.lit(1.0), F.col("n_brackets") / F.col("n"))).otherwise(1.0)
    start_score, verse = F.when(share >= 0.5, 2.0).otherwise(1.0) + share, (F.col("n") >= 2) & (F.col("short") / F.col("n") >= 0.9)
    numbered = regular | ((F.col("starts") > 0) & (start_score >= 2)) | ((F.col("n_brackets") > 0) & (bracket >= 2))

    def way(order: int, kind: str, score: Column, matches: Column, sample: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), matches.cast("long").alias("matches"), sample.alias("sample"))

    ways = F.array(
        F.when(regular, way(0, "margin-every-n", F.lit(3.0), F.size("hits"), F.get("hits", F.lit(0))["label"])),
        F.when(F.col("starts") > 0, way(1, "line-start-number", start_score, F.col("starts"), F.col("start_sample"))),
        F.when(F.col("n_brackets") > 0, way(2, "bracketed", bracket, F.col("n_brackets"), F.col("bracket_sample"))),
        F.when(verse, way(3, "every-line", F.when(numbered, 0.5).otherwise(2.5), F.col("n"), F.col("first_line"))),
    )
    ranked = F.array_sort(F.array_compact(ways), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["order"] - b["order"]))
    return by_doc.select(doc, F.posexplode(ranked).alias("rank", "w")).select(doc, (F.col("rank") + 1).cast("long").alias("rank"), "w.kind", "w.score", "w.matches", "w.sample")


def numbered_words(lines: DataFrame, kind: str, doc: str = "doc_id") -> DataFrame:
    """doc, line, pos, form, label (of the word that begins a labelled stretch), repeated (the label stood before): the words without the numbers.

    A label goes to the first word at or after it, the last of several to one word.
    In a margin, the lines between two numbers count on from the number before.
    """
    full = F.trim("text") != ""
    if kind == "bracketed":
        marked = lines.withColumn("text", F.regexp_replace("text", rf"\s*{BRACKETED}\s*", f" {MARK}$1 "))
    elif kind == "line-start-number":
        marked = lines.withColumn("text", F.regexp_replace("text", LINE_START, f"{MARK}$1 "))
    elif kind == "every-line":
        nth = F.sum(full.cast("long")).over(Window.partitionBy(doc).orderBy("line"))
        marked = lines.withColumn("text", F.when(full, F.concat(F.lit(MARK), nth.cast("string"), F.lit(" "), "text")).otherwise(F.col("text")))
    else:
        over = Window.partitionBy(doc).orderBy("line")
        at = F.sum(full.cast("long")).over(over)
        rows = lines.withColumn("own", F.when(full, F.nullif(_margin(), F.lit("")))).withColumn("at", at)
        seen = F.when(F.col("own").rlike(r"^\d+$"), F.struct("at", F.col("own").cast("long").alias("n")))
        before, after = F.last(seen, ignorenulls=True).over(over), F.first(seen, ignorenulls=True).over(over.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        counted = F.coalesce(before["n"] + F.col("at") - before["at"], after["n"] - after["at"] + F.col("at"))
        label = F.coalesce("own", F.when(full & (counted > 0), counted.cast("string")))
        bare = F.regexp_replace(F.regexp_replace("text", LINE_START, ""), LINE_END, "")
        marked = rows.withColumn("label", label).withColumn("text", F.when(F.col("own").isNotNull(), bare).otherwise(F.col("text")))
        marked = marked.select(doc, "line", F.when(F.col("label").isNotNull(), F.concat(F.lit(MARK), "label", F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    parts = marked.select(doc, "line", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("i", "form"))
    order = Window.partitionBy(doc).orderBy("line", "i")
    is_mark = F.col("form").startswith(MARK)
    before = F.lag(F.when(is_mark, F.substring("form", 2, 100))).over(order)
    words = parts.withColumn("label", before).where(~is_mark)
    pos = F.row_number().over(Window.partitionBy(doc, "line").orderBy("i")) - 1
    repeated = F.col("label").isNotNull() & (F.row_number().over(Window.partitionBy(doc, "label").orderBy("line", "i")) > 1)
    return words.select(doc, F.col("line").cast("long").alias("line"), pos.cast("long").alias("pos"), "form", "label", repeated.alias("repeated"))
