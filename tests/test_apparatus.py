from pyspark.sql import functions as F

from vellum.functions import identifiers as ids, text as fx
from vellum.operators import apparatus


def test_review(spark):
    read = spark.createDataFrame([("g", 1, "arma", True), ("g", 1, "alma", False), ("g", 2, "cano", True), ("g", 2, "", False)], "grp string, site long, key string, is_base boolean")
    assert [r["site"] for r in apparatus.backlog(read, spark.createDataFrame([("g", 2)], "grp string, site long")).collect()] == [1]


def test_lemma_places_and_drift(spark):
    units = spark.createDataFrame([("g", i, w) for i, w in enumerate("a b a b c".split())], "grp string, idx int, key string")
    records = spark.createDataFrame([(1, "g", "a b"), (2, "g", "b a b"), (3, "g", "c a")], "record_id int, grp string, lemma string")
    assert {(r["record_id"], r["idx"]) for r in apparatus.lemma_places(records, units).collect()} == {(1, 0), (1, 2), (2, 1)}
    words = spark.createDataFrame([("w1", "hello", ["a", "b"]), ("w2", "x", ["c"]), ("w3", "y", ["z"])], "word_id string, form string, token_ids array<string>")
    now = spark.createDataFrame([("a", "hel"), ("b", "lo"), ("c", "X")], "token_id string, form string")
    assert {(r["word_id"], r["reads"]) for r in apparatus.drift(words, now).collect()} == {("w2", "X"), ("w3", "")}


def test_columns(spark):
    row = spark.range(1).select(
        ids.normal_orcid(F.lit("https://orcid.org/0000-0002-1825-0097")).alias("orcid"), fx.orcid_ok(F.lit("0000-0002-1825-0097")).alias("ok"), fx.orcid_ok(F.lit("0000-0002-1825-0098")).alias("bad"),
        ids.licence_compatible(F.lit("CC-BY-4.0"), F.lit("CC-BY-SA-4.0")).alias("in_"), ids.licence_compatible(F.lit("CC-BY-SA-4.0"), F.lit("CC0-1.0")).alias("out"),
        ids.passage_urn(F.lit("urn:cts:lib:w"), [F.lit("1"), F.lit(None).cast("string"), F.lit("3")]).alias("urn"), ids.passage_urn(F.lit("urn:w"), [F.lit("1")]).alias("no_urn"), ids.normal_orcid(F.lit("0000-0002-1825-0098")).alias("no_orcid"),
        fx.fold(F.lit("Λόγος, «ΑΒ»")).alias("fold"), fx.fold_bare(F.lit("Λόγος,")).alias("bare"), fx.fold_plain(F.lit("Iulius vidit"), F.lit("la")).alias("la"),
        fx.sort_key(fx.number_key(F.lit("12b")), fx.text_key(F.lit("pr"))).alias("key"), fx.similarity(F.lit(""), F.lit("")).alias("same"), fx.slugify(F.lit("  Élan vital! ")).alias("slug"),
    ).first()
    assert row.asDict() == {"orcid": "0000-0002-1825-0097", "ok": True, "bad": False, "in_": True, "out": False, "urn": "urn:cts:lib:w:1", "no_urn": None, "no_orcid": None, "fold": "λόγοσ αβ", "bare": "λογοσ", "la": "iulius uidit", "key": "00000012b.pr      ", "same": 1.0, "slug": "elan-vital"}
