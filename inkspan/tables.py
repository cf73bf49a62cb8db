"""Reading the project's tables, bounded broadcasts and cutting lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast on purpose.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table of proven size; raises rather than pulling an unbounded one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine without it, one of its own. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="inkspan-"))
    return _LOCAL[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own_path(spark: SparkSession, what: str = "table") -> str:
    """A new path in the shared folder that is deleted when the program ends."""
    path = f"{shared_folder(spark)}/inkspan-{what}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass

    atexit.register(clear)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file to any file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read again: its lineage ends in files every executor sees."""
    spark = df.sparkSession
    path = own_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over every core if its files make fewer partitions than there are cores; as it is otherwise, so never a shuffle on large input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
