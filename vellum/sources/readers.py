"""Readers of the record formats: streams in JSON, segments in TSV, histories in ndjson."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: The fields of the formats.
ITEM = (
    "struct<id:string,kind:string,lang:string,form:string,norm:string,unchecked:boolean,joinNext:boolean,sep:string,segment:string,"
    "marks:array<struct<kind:string,attrs:map<string,string>,`from`:int,`to`:int>>,"
    "source:struct<kind:string,transcriptionId:string,tokenIds:array<string>,conjectureId:string>,"
    "type:string,pageId:string,label:string,rend:string,lineation:string,attrs:map<string,string>,text:string>"
)
STREAM = f"id string, name string, witnessId string, ownerId string, version int, head string, content struct<items:array<{ITEM}>>"
SEGMENTS = "id string, label string, sort_key string, address string, urn string, created_at timestamp"
CHANGESET = (
    "id string, parentId string, merged array<string>, version int, personId string, at timestamp, message string, "
    "ops array<struct<t:string,after:string,ids:array<string>,id:string,fields:string,at:int,newId:string,`join`:boolean>>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of the streams below path; has_start tells a segment without an id from no segment."""
    docs = spark.read.schema(StructType.fromDDL(STREAM)).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    items = docs.select(F.col("id").alias("doc_id"), "version", F.posexplode("content.items").alias("pos", "i"))
    segment = F.from_json("i.segment", "segmentId string, part int")
    return items.select(
        "doc_id", "version", "pos", F.col("i.id").alias("item_id"), "i.kind", "i.form", F.coalesce("i.norm", "i.form").alias("read_form"), "i.lang",
        F.coalesce("i.joinNext", F.lit(False)).alias("join_next"), "i.sep", F.col("i.segment").isNotNull().alias("has_start"),
        segment["segmentId"].alias("seg_id"), segment["part"].alias("seg_part"), "i.marks", "i.source", "i.type", F.col("i.pageId").alias("page_id"), "i.lineation", "i.attrs", "i.text",
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).option("sep", "\t").option("header", True).csv(path)


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromDDL(CHANGESET)).json(path)
