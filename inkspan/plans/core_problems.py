"""Queries of the general problems: timestamps (3) and rows that fail to parse (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import badrows, timestamps
from inkspan.tables import table


def _dates(spark: SparkSession, sf: str, keep_unread: bool) -> DataFrame:
    sources = table(spark, sf, "sources")
    posts = table(spark, sf, "posts").select("post_id", "date", "source")
    human = table(spark, sf, "human_manifest").select("file", "date", "source").withColumn("pos", F.nullif(F.regexp_extract("file", r"__(\d+)", 1), F.lit("")).try_cast("long"))
    both = posts.select(F.lit("posts").alias("tbl"), F.col("post_id").cast("string").alias("rec"), "date", "source", F.col("post_id").alias("pos"))
    both = both.unionByName(human.select(F.lit("human_manifest").alias("tbl"), F.col("file").alias("rec"), "date", "source", "pos"))
    if not keep_unread:
        both = both.where("date is not null")
    return timestamps.normalise(both, ["tbl", "rec"], "date", "source", "pos", sources, keep_unread, "tbl")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The dates that name exactly one time: their only interpretation; a choice between several is no such date."""
    return _dates(spark, sf, False).where("decided = 'only'").select("tbl", "rec", "normal").distinct()


def p3_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Every date with its chosen reading and how it was decided, unread ones included."""
    return _dates(spark, sf, True)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that fail to parse with the first reason that holds."""
    return badrows.read_rows(table(spark, sf, "raw_rows")).where("reason is not null").select("row_id", "reason").distinct()


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that load, with their five typed fields; an id of any length is kept as its digits, words hold up to 38."""
    good = badrows.read_rows(table(spark, sf, "raw_rows")).where("reason is null")
    return good.select("row_id", "file", "line_no", "id", "source", F.to_date("published").alias("published"), F.col("words").try_cast("decimal(38,0)").alias("words"), "text")


def p4_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The records and located errors of the same rows read as running text, where a broken quote is recovered from at the next record start."""
    return badrows.read_streams(badrows.joined(table(spark, sf, "raw_rows")))


QUERIES = {"p3_found": p3_found, "p3_readings": p3_readings, "p4_found": p4_found, "p4_loaded": p4_loaded, "p4_stream": p4_stream}
