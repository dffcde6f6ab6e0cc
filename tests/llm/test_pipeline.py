"""The pipeline's stages, each judged on its own input."""

import sys

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.llm import packing
from vellum.llm.common import stored

from .helpers import documents, odd_texts
from .test_operators import base_rules


def test_stages(spark, tmp_path):
    texts = odd_texts()
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
    assert ids["quality_rules"] <= {i for i, t in enumerate(texts) if not base_rules(t)[5]}
    assert {5, 20} <= ids["exact_dedup"] and not {6, 17, 18} & ids["exact_dedup"]  # of 6 and 20 the longer stays
    assert 19 not in ids["near_dedup"] and 5 in ids["near_dedup"]
    assert ids["packing"] == ids["substring_dedup"] == ids["near_dedup"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_python_gets_few_rows_at_once(spark, tmp_path):
    """Large rows by the ten thousand, in every worker, took more memory than an executor has."""
    documents(spark, ["some words", None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, name = spark.read.parquet(str(tmp_path / "documents.parquet")), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "10000")
            stage(spark, docs, str(tmp_path))
            sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
            assert sizes.agg(F.sum("n"), F.max("n")).first() == (3000, 1000)
    finally:
        spark.conf.set(name, before)


def test_workers_keep_no_ids(spark):
    """A worker lives on when its task has ended; what it keeps stands beside what other stages need."""
    path = public_tokenizers.path("byte_bpe_50k.json")

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(packing.load(path).of_stretch)] * b.num_rows})

    rows = packing.pack(documents(spark, [f"some words {i}" for i in range(64)]).repartition(8), path).collect()
    assert len(rows) == 64
    assert spark.range(0, 64, 1, 8).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0
    ids = packing.FastIds(path).of_stretch
    ids.make = lambda stretch: b""
    for i in range(ids.limit):
        ids[i]
    assert sys.getsizeof(ids) < 16 << 20
