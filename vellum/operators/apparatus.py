"""What needs review, how witnesses are named, and words that drifted from their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lemma_places(records: DataFrame, units: DataFrame) -> DataFrame:
    """record_id, idx: where the words of each lemma (folded, joined by spaces) stand in the base's units (grp, idx, key)."""
    words = records.select("record_id", "grp", F.posexplode(F.split("lemma", " ")).alias("k", "key"), F.size(F.split("lemma", " ")).alias("n"))
    hits = words.join(units.select("grp", "idx", "key"), ["grp", "key"]).withColumn("start", F.col("idx") - F.col("k"))
    return hits.groupBy("record_id", "start", "n").agg(F.count("*").alias("found")).where("found = n").select("record_id", F.col("start").alias("idx"))


def backlog(readings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Sites with a reading beside the base's that nobody has reviewed."""
    return readings.where("NOT is_base").select("grp", "site").distinct().join(reviewed, ["grp", "site"], "left_anti")


def named(readings: DataFrame, grp: str, key: str, least: int = 3) -> DataFrame:
    """Adds named: codd. where one reading has all witnesses, cett. for the reading that most have (least of them at least, the first by key of several), else the sigla."""
    from pyspark.sql.window import Window

    all_ = Window.partitionBy(grp)
    rank = F.row_number().over(all_.orderBy(F.desc(F.size("texts")), key))
    rows = readings.withColumn("__n", F.count("*").over(all_)).withColumn("__r", rank)
    shown = F.when(F.col("__n") == 1, "codd.").when((F.col("__r") == 1) & (F.size("texts") >= least), "cett.").otherwise(F.array_join(F.array_sort("texts"), " "))
    return rows.withColumn("named", shown).drop("__n", "__r")


def drift(words: DataFrame, witness: DataFrame) -> DataFrame:
    """Words taken from a witness (word_id, form, token_ids) that reads otherwise there now (token_id, form), or no longer has them."""
    source = words.select("word_id", "form", F.posexplode("token_ids").alias("k", "token_id"))
    now = witness.select("token_id", F.col("form").alias("now"))
    read = source.join(now, "token_id", "left").groupBy("word_id", "form").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("now", F.lit("")).alias("f")))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["f"]), "")
    return read.select("word_id", "form", text.alias("reads")).where("form != reads")


def entry_lines(readings: DataFrame, labels: DataFrame) -> DataFrame:
    """Printed entries: label, lemma with its texts, colon, the other readings; labels has grp and label."""
    from .collate import apparatus

    return apparatus(readings).join(labels, "grp").select("grp", "site", "base_from", F.concat_ws(" ", "label", "entry").alias("line"))
