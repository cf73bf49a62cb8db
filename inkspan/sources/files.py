"""Reading corpora from files: text, blog XML, mail folders, csv, JSON lines, manifests; text of any of two encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.textfn import WS

# Names of text and date columns, in order of preference.
TEXT_COLUMNS = ["text", "body", "content", "post", "article"]
DATE_COLUMNS = ["timestamp", "date", "published", "published_at", "created_at", "pubdate"]


def walk(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Every file below a folder: path, length, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(folder).select("path", "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are sound UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the .txt and .md files, in any case of the ending."""
    x = walk(spark, folder).where(F.lower("path").rlike(r"\.(txt|md)$"))
    return x.select("path", decoded(F.col("content")).alias("text"))


def blog_posts(xml: Column) -> Column:
    """The bodies of all posts in a blog's file, as an array."""
    return F.regexp_extract_all(xml, F.lit("(?s)<post>(.*?)</post>"), F.lit(1))


def read_blogs(spark: SparkSession, folder: str) -> DataFrame:
    x = walk(spark, folder).where(F.lower("path").endswith(".xml"))
    return x.select("path", F.posexplode(blog_posts(decoded(F.col("content")))).alias("n", "text"))


def mail_body(text: Column) -> Column:
    """After the first empty line, before quoted or forwarded messages, without quoted lines."""
    body = F.substr(text, F.instr(text, "\n\n") + 2)
    for mark in (rf"(?mi)^-+{WS}*Original Message{WS}*-+$", rf"(?mi)^-+{WS}*Forwarded by", rf"(?mi)^{WS}*To:{WS}[^\n\r]*\n{WS}*cc:"):
        body = F.get(F.split(body, "(?d)" + mark, 2), F.lit(0))
    return F.regexp_replace(body, rf"(?d)(?m)^{WS}*>[^\n\r]*", "")


def read_mails(spark: SparkSession, folder: str) -> DataFrame:
    """A mail with CRLF line ends has no empty line as meant here and gives no text."""
    x = walk(spark, folder).select("path", decoded(F.col("content")).alias("t"))
    return x.where(F.col("t").contains("\n\n")).select("path", mail_body(F.col("t")).alias("text"))


_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _picked(x: DataFrame) -> DataFrame:
    pick = lambda known: next((c for c in x.columns if c.strip().lower() in known), None)
    text, date = pick(TEXT_COLUMNS), pick(DATE_COLUMNS)
    if text is None:
        raise ValueError("no text column")
    return x.select(F.replace(F.col(f"`{text}`"), F.lit("\r"), F.lit("")).alias("text"), (F.col(f"`{date}`") if date else F.lit(None).cast("string")).alias("date"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """text, date of a csv with header: the leftmost known column of each kind, without carriage returns."""
    return _picked(spark.read.csv(path, **_CSV))


def stream_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files; the columns are those of the files that are there at the start."""
    return _picked(spark.readStream.schema(spark.read.csv(path, **_CSV).schema).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in _CSV.items()}).csv(path))


def json_text(df: DataFrame, column: str) -> DataFrame:
    """df with text: the first known key, by preference, that holds a string; rows that are no JSON object or have none are skipped."""
    v = F.try_parse_json(F.col(column))
    is_string = lambda k: F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{k}", "variant")) == "STRING"
    x = df.withColumn("_v", v)
    return x.withColumn("text", F.coalesce(*[F.when(is_string(k), F.try_variant_get(F.col("_v"), f"$.{k}", "string")) for k in TEXT_COLUMNS])).drop("_v").where("text is not null")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return json_text(spark.read.text(path).withColumnRenamed("value", "line"), "line")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest with header, every column a string."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def with_fallback(live: dict | None, fallback: dict) -> dict:
    """A snapshot's live keys over the embedded ones."""
    return {**fallback, **(live or {})}
