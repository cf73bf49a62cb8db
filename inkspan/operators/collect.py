"""Corpus collection: filters with counters, deduplication, a cap a file, provenance, the generation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators.timestamps import instants
from inkspan.tables import cut

MIN_WORDS, MAX_WORDS, PER_FILE = 100, 2500, 2
#: Files that may hold any number of documents.
MANY_PER_FILE = r"\.(csv|jsonl)$"


def considered(raw: DataFrame, before: str | None = None, sources: DataFrame | None = None, text: str = "text", date: str = "date", source: str = "source") -> DataFrame:
    """pos, file, date, words and why: null, or length, date, dupe, the first filter that drops the row.

    Cleaning comes first, then length, date (unreadable or not before the cutoff, a day in UTC) and duplicates; of equal keys the row of the
    smallest ``pos`` (a unique long) stays. Texts are cleaned once and left behind; only thin rows are written and joined, by ``pos``, so a key
    that a third of all rows share is no large group anywhere.
    """
    kept = [c for c in ("file", date) if c in raw.columns]
    x = raw.withColumn("clean", T.clean_text(F.coalesce(F.col(text), F.lit(""))))
    x = x.select("pos", *kept, T.word_count(F.col("clean")).alias("words"), F.md5(T.dedupe_key(F.col("clean"))).alias("_key"))
    thin = cut(x.withColumn("why", F.when(~F.col("words").between(MIN_WORDS, MAX_WORDS), "length")))
    if before:
        at = instants(raw.select("pos", date, source), "pos", date, source, sources)
        early = at.where(F.timestamp_micros("micros") < F.lit(before).cast("timestamp")).select("pos", F.lit(True).alias("_early"))
        thin = thin.join(early, "pos", "left").withColumn("why", F.when(F.col("why").isNull() & F.col("_early").isNull(), "date").otherwise(F.col("why"))).drop("_early")
    first = thin.where("why is null").groupBy("_key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    return thin.join(first, "pos", "left").withColumn("why", F.when(F.col("why").isNull() & F.col("_first").isNull(), "dupe").otherwise(F.col("why"))).drop("_first", "_key")


def per_file_cap(accepted: DataFrame, cap: int = PER_FILE) -> DataFrame:
    """At most ``cap`` accepted rows a file, by pos: the cap smallest of each task's part first, so a hot file is no large group.

    A csv or JSON-lines file may hold a whole corpus, and of a row without a file nothing is known: those are not capped.
    """
    free = F.col("file").isNull() | F.lower("file").rlike(MANY_PER_FILE)
    part = Window.partitionBy("file", "_part").orderBy("pos")
    x = accepted.where(~free).withColumn("_part", F.pmod(F.xxhash64("pos"), F.lit(64)))
    x = x.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= cap)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("_n") <= cap).drop("_n", "_part")
    return accepted.where(free).unionByName(x)


def counters(x: DataFrame) -> DataFrame:
    n = lambda why: F.sum(F.when(F.col("why").eqNullSafe(F.lit(why)), 1).otherwise(0)).cast("long")
    return x.agg(n(None).alias("considered"), n("date").alias("skipped_date"), n("length").alias("skipped_length"), n("dupe").alias("skipped_dupe"))


def summary(x: DataFrame) -> DataFrame:
    """written, words, upper_median: the middle document's words, the later one of two."""
    kept = x.where("why is null").groupBy("words").agg(F.count("*").alias("n"))  # a histogram: few rows, whatever the corpus
    w = Window.orderBy("words").rowsBetween(Window.unboundedPreceding, 0)
    h = kept.withColumn("upto", F.sum("n").over(w))
    total = kept.agg(F.sum("n").alias("written"), F.sum(F.col("n") * F.col("words")).alias("total"))
    mid = h.join(F.broadcast(total), F.col("upto") > F.expr("written div 2")).groupBy("written", "total").agg(F.min("words").alias("upper_median"))
    return mid.select("written", F.col("total").alias("words"), F.col("upper_median").cast("long").alias("upper_median"))


def grid(genres: DataFrame, n: int, model: str) -> DataFrame:
    """file, genre, prompt of the first n prompts of each genre (genre, prompts)."""
    x = genres.select("genre", F.posexplode("prompts").alias("pos", "prompt")).where(F.col("pos") < n)
    return x.select(F.concat_ws("__", F.lit(model), "genre", F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("file"), "genre", "prompt")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left without a partner: what is still to do, or has no provenance."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def corpus_name(label: Column, n: Column) -> Column:
    return F.concat(label, F.lit("__"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit(".txt"))


def write_corpus(docs: DataFrame, folder: str, label: str, why: str, date: str) -> None:
    """Writes a sample (pos, text, date) as a text file a document below ``folder``/texts and appends its manifest in ``folder``/manifest.

    Names are numbered by pos; a name that the manifest has is skipped. Text files end with a line break and have no CR before one.
    ``docs`` is a sample of fixed size: it is numbered in one task.
    """
    spark = docs.sparkSession
    x = docs.withColumn("file", corpus_name(F.lit(label), F.row_number().over(Window.orderBy("pos"))))
    columns = "file string, source string, date string, why_known_human string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        x = missing(x, spark.read.schema(columns).csv(f"{folder}/manifest", sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False), "file")
    x = cut(x.select("file", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"), F.coalesce(F.nullif(F.substring("date", 1, 10), F.lit("")), F.lit(date)).alias("date")))
    x.select("file", "text").write.mode("append").partitionBy("file").text(f"{folder}/texts")
    x.select("file", F.lit(label), "date", F.lit(why)).coalesce(1).write.mode("append").csv(f"{folder}/manifest", sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_corpus(spark, folder: str) -> DataFrame:
    """file, text, date, why_known_human of a written corpus."""
    texts = spark.read.text(f"{folder}/texts", wholetext=True).select(F.col("file").cast("string").alias("file"), F.col("value").alias("text"))
    manifest = spark.read.schema("file string, source string, date string, why_known_human string").csv(f"{folder}/manifest", sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return texts.join(manifest, "file").select("file", "text", "date", "why_known_human")
