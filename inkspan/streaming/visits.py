"""Visits and tells from usage events, in batch and as a stream.

A visit begins with the first event of a user or one more than 30 minutes after the event before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.tables import own_path

GAP, LATE = "30 minutes", "1 day"


def sessions(events: DataFrame) -> DataFrame:
    """user_id, start, events of each visit. Session windows merge map-side, so a busy user is no large group."""
    x = events.groupBy("user_id", F.session_window("ts", GAP).alias("w")).agg(F.count("*").alias("events"))
    return x.select("user_id", F.col("w.start").alias("start"), "events")


def top_tell(checks: DataFrame, days: int = 7, least: int = 50) -> DataFrame:
    """tell, n, checks: the tell that fired most in the last ``days`` days of ``checks`` (ts, tells: map of rule and count), ties by name; how many
    checks there were is told from ``least`` on."""
    last = checks.agg(F.max("ts").alias("_last"))
    x = checks.join(F.broadcast(last), F.col("ts") > F.col("_last") - F.expr(f"interval {days} days"))
    fired = x.select(F.explode("tells").alias("tell", "k")).groupBy("tell").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "tell").limit(1)
    total = x.agg(F.count("*").alias("_checks"))
    return fired.join(F.broadcast(total), how="cross").select("tell", "n", F.when(F.col("_checks") >= least, F.col("_checks")).alias("checks"))


def daily(loads: DataFrame) -> DataFrame:
    """day, referrer, visits, users, tells of ``loads`` (ts, user_id, ref, tells): the referrer is the host of ``ref`` without www, or direct."""
    host = F.regexp_replace(F.lower(F.try_parse_url("ref", F.lit("HOST"))), r"^www\.", "")
    x = loads.select(F.to_date("ts").cast("string").alias("day"), F.coalesce(F.nullif(host, F.lit("")), F.lit("direct")).alias("referrer"), "user_id", F.aggregate(F.map_values("tells"), F.lit(0).cast("long"), lambda a, n: a + n).alias("k"))
    return x.groupBy("day", "referrer").agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"), F.sum("k").alias("tells"))


def stream_sessions(spark: SparkSession, folder: str, schema, closing, name: str = "events.parquet") -> DataFrame:
    """The same visits from a stream of files, read once to its end, in files of the shared folder.

    A visit is written once the watermark, a day behind, has passed its end; its state is dropped then. An event at ``closing`` (later than all
    others by more than that) ends the stream, so that the last visits are written too.
    """
    # as a pattern, since a stream takes a folder or a pattern but no single file
    raw = spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    at, out = own_path(spark, "closing"), own_path(spark, "visits")
    spark.createDataFrame([(closing,)], "ts timestamp").select(F.lit(None).cast(raw.schema["user_id"].dataType).alias("user_id"), "ts").write.parquet(at)
    last = spark.readStream.schema(raw.schema).parquet(at)
    seen = sessions(raw.unionByName(last).withWatermark("ts", LATE))  # the closing visit is dropped on reading: a filter here would be pushed into the source
    run = seen.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(seen.schema).parquet(out).where("user_id is not null")
