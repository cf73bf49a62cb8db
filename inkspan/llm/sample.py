"""A uniform sample of fixed size from data of unknown length that arrives in pieces.

Each record gets an independent uniform key, a digest of the seed and its identity, so a recomputed task or a piece read
again gives the same key. Each partition keeps its k smallest keys in a bounded heap; the heaps are merged by keeping
the k smallest of all. Samples of pieces merge the same way, so the sample never depends on how the data came.

Defined results: k or fewer records give all of them; null ids share the key of the empty string and tie-break by nothing else, so give
every record an id; equal keys are ordered by id; k below 1 gives no row.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.tables import cut, small_side


def uniform_key(seed: int, identity: Column) -> Column:
    """60 uniform bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def heaps(keyed: DataFrame, k: int) -> DataFrame:
    """The k smallest (key, id) of each partition."""

    def run(batches):
        heap: list[tuple[int, int]] = []  # negated, so that the largest kept key is on top
        for b in batches:
            for key, i in zip(b["sample_key"].tolist(), b["id"].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (-key, -i))
                elif heap and (-key, -i) > heap[0]:
                    heapq.heapreplace(heap, (-key, -i))
        yield pd.DataFrame({"sample_key": [-a for a, _ in heap], "id": [-b for _, b in heap]}, dtype="int64")

    return keyed.mapInPandas(run, "sample_key long, id long")


def merge(parts: DataFrame, k: int) -> DataFrame:
    """The k smallest of several heaps."""
    return parts.orderBy("sample_key", "id").limit(max(0, k))


def draw(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows of df, each set of k equally likely, with their ``sample_key``. ``id_col``: a unique long."""
    keyed = df.select(uniform_key(seed, F.col(id_col)).alias("sample_key"), F.col(id_col).cast("long").alias("id"))
    won = cut(merge(heaps(keyed, max(0, k)), k).withColumnRenamed("id", "_won"))  # written, so that the heaps are filled once
    return df.join(small_side(won), df[id_col] == F.col("_won")).drop("_won")
