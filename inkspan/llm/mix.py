"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. Each source gets its share of the budget; a source that would have to repeat a document more
than ``max_repeats`` times is clamped there and its excess is spread over the others in proportion to their weights, until
nothing exceeds. A source used r times has each document floor(r) times and a seeded fraction of them once more.

Defined results: null texts and sources without a target are left out; a document of no token may be used but adds nothing; a
source without documents cannot be filled and its share goes to the others; an empty corpus gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.tables import bounded_rows, cut, small_side

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Most sources a mix may have.
SOURCES = 100_000


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs without ``text`` and with n_tokens. tokenizer: the path of a .tiktoken file; pattern: how it splits a text. Without them, those of the public vocabulary."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        import base64

        import tiktoken

        path, split = tokenizer, pattern
        if path is None or split is None:
            import public_tokenizers as public

            path, split = path or public.path(TOKENIZER), split or public.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = b[keep].copy()
            out["n_tokens"] = pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b[text]], index=b.index, dtype="int64")
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInPandas(run, f"{schema}, n_tokens long")


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int], budget: float | None = None) -> dict[str, float]:
    """How often each source is used: the shares of the budget approach the weights within the caps."""
    live = {s for s in weights if sizes.get(s, 0) > 0 and weights[s] > 0 and caps[s] > 0}
    budget = float(sum(sizes[s] for s in live)) if budget is None else budget
    used: dict[str, float] = {}
    while live:
        total = sum(weights[s] for s in live)
        over = {s for s in live if budget * weights[s] / total >= caps[s] * sizes[s]}
        if not over:
            return used | {s: budget * weights[s] / total / sizes[s] for s in live}
        for s in over:
            used[s] = float(caps[s])
            budget -= caps[s] * sizes[s]
        live -= over
    return used


def plan(counted: DataFrame, targets: DataFrame, budget: float | None = None) -> dict[str, float]:
    t = bounded_rows(targets.where("source is not null").select("source", "target_share", "max_repeats"), SOURCES, "mix targets")
    totals = counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(targets.select("source").distinct(), "source", "left_semi")
    sizes = {r.source: int(r.n or 0) for r in bounded_rows(totals, SOURCES, "sources")}
    return water_fill(sizes, {r.source: float(r.target_share or 0) for r in t}, {r.source: int(r.max_repeats or 0) for r in t}, budget)


def counted_documents(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents that can be mixed, written once."""
    with_target = docs.where("text is not null and source is not null").select("doc_id", "source", "text").join(small_side(targets.select("source").distinct()), "source", "left_semi")
    return cut(token_counts(with_target, "text", tokenizer))


def mix(counted: DataFrame, targets: DataFrame, seed: int = 42, budget: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, uses (at least 1) of the chosen documents."""
    uses = plan(counted, targets, budget)
    spark = counted.sparkSession
    rates = spark.createDataFrame([(s, int(r + 1e-12), r - int(r + 1e-12)) for s, r in sorted(uses.items())], "source string, whole int, part double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    x = counted.join(small_side(rates), "source")
    x = x.withColumn("uses", F.col("whole") + F.when(draw < F.col("part"), 1).otherwise(0))
    return x.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of the targets really reached."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("_all"))
    x = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(total), how="cross")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return x.select("source", "target_share", "max_repeats", zero("documents"), zero("uses"), zero("tokens"), F.when(F.col("_all") > 0, F.coalesce("tokens", F.lit(0)) / F.col("_all")).otherwise(F.lit(0.0)).alias("actual_share"))
