from datetime import datetime

from pyspark.sql import functions as F

from vellum.streaming import keyed

ROWS = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:01:05"), (2, "2024-01-01 00:00:30")]


def frame(spark):
    return spark.createDataFrame([(u, i, datetime.fromisoformat(t)) for i, (u, t) in enumerate(ROWS)], "user long, hit_id long, at timestamp")


def drained(df, name, spark, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_rate_limit(spark, tmp_path):
    hits = frame(spark)
    want = {0: True, 1: True, 2: False, 3: True, 4: True}  # the window opens with the first hit, at 0 s
    assert {r["hit_id"]: r["allowed"] for r in keyed.rate_limit_batch(hits, "user", "at", 2, 60).collect()} == want
    hits.write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    assert {r["hit_id"]: r["allowed"] for r in drained(keyed.rate_limit(stream, "user", "at", 2, 60), "limited", spark)} == want


def test_debounce(spark, tmp_path):
    rows = frame(spark)
    marks = keyed.changes(rows, {"user": "user"}, "at")
    assert [r["record"] for r in keyed.quiet(marks, "2024-01-01 00:01:20", 30).collect()] == ["2"]
    later = spark.createDataFrame([(9, 9, datetime(2024, 1, 1, 4))], rows.schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "marks" / "a"))
    later.coalesce(1).write.parquet(str(tmp_path / "marks" / "b"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "marks"))
    found = drained(keyed.debounce(keyed.changes(stream, {"user": "user"}, "at"), 30), "quiet", spark)
    assert {r["record"]: str(r["at"]) for r in found} == {"1": "2024-01-01 00:01:05", "2": "2024-01-01 00:00:30"}


def test_sessions(spark):
    rows = frame(spark)
    got = keyed.session_counts(rows, "user", "at", "30 seconds").groupBy("user").agg(F.count("*").alias("s"), F.sum("n").alias("n")).collect()
    assert {(r["user"], r["s"], r["n"]) for r in got} == {(1, 2, 4), (2, 1, 1)}


def test_rate_limit_in_one_pass(spark):
    """No window is handed to Python by itself; hits without a time come last and count in the window that is open."""
    times = [0, 30, None, 90, None, 100, 500]
    hits = spark.createDataFrame([(u, i, None if t is None else datetime(2024, 1, 1, t // 3600, t // 60 % 60, t % 60)) for u in (None, 1) for i, t in enumerate(times)], "user long, hit_id long, at timestamp")
    found = keyed.rate_limit_batch(hits, "user", "at", 2, 60)
    want = {0: True, 1: True, 3: True, 5: True, 6: True, 2: True, 4: False}
    got = found.collect()
    assert len(got) == 14 and all(r["allowed"] == want[r["hit_id"]] for r in got)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
