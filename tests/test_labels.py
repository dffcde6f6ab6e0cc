from pyspark.sql import functions as F

from vellum.functions import scheme, text as fx
from vellum.operators import registry


def suffix(n):
    out = ""
    while n:
        n, d = divmod(n - 1, 26)
        out = chr(97 + d) + out
    return out


def test_letter_suffix_of_any_length(spark):
    known = {1: "a", 26: "z", 27: "aa", 702: "zz", 703: "aaa", 18_278: "zzz", 18_279: "aaaa", 2**63 - 1: suffix(2**63 - 1)}
    rows = spark.createDataFrame([(n,) for n in known], "n long").select("n", fx.letter_suffix(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == known


def test_labels_of_one_hot_label_stay_apart(spark):
    rows = spark.range(1, 18_281).select(F.col("id"), F.lit("x ").alias("label"))
    shown = {r["id"]: r["shown"] for r in registry.disambiguated(rows, "label", ["id"]).select("id", "shown").collect()}
    assert shown == {n: "x " + suffix(n) for n in range(1, 18_281)}


def test_relabel_reads_each_label_once(spark):
    old, new = [scheme.Level("book"), scheme.Level("line")], [scheme.Level("part"), scheme.Level("item", "text", ",")]
    rows = spark.createDataFrame([("1.2",), (" 12.34a ",), ("1.2.3",), ("x.1",), ("1.",), ("",), (None,)], "label string")
    found = scheme.relabel(rows, old, new, "label")
    got = [(r["new_label"], r["new_key"]) for r in found.collect()]
    assert got == [("1,2", "00000001.2       "), ("12,34a", "00000012.34a     "), ("1,2.3", "00000001.2.3     "), (None, None), (None, None), (None, None), (None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(label") == 1
    assert [r["new_label"] for r in scheme.relabel(rows, old, [*new, scheme.Level("more")], "label").collect()] == [None] * 7
