"""The corpus study: document measures, rates by arm, bootstrap intervals, separation of two arms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators import rules as R
from inkspan.tables import bounded_rows

MIN_WORDS, MIN_DOCS, REPLICATES = 100, 20, 2000
RULE_IDS = [r.id for r in R.RULES] + ["em_dash"]


def dedupe(docs: DataFrame, keep: list[str], arm: str = "arm", name: str = "doc_id", text: str = "text") -> DataFrame:
    """arm, name and the numeric columns ``keep`` of the first by name of each text within an arm, texts compared without case and blanks.

    One scan and one shuffle of thin rows: the smallest name of a text and its columns are combined before it, however many copies there are.
    """
    keyed = docs.select(arm, name, *keep, T.norm_hash(F.col(text)).alias("_h"))
    return keyed.groupBy(arm, "_h").agg(F.min(name).alias(name), *[F.min_by(c, name).alias(c) for c in keep]).select(arm, name, *keep)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, one count a rule, sentences, mean_sentence, cv."""
    x = docs.withColumn("straight", T.straighten(F.col(text)))
    x = x.withColumns({"words": T.word_count(F.col(text)), **{f"n_{r.id}": R.count(r, F.col("straight")) for r in R.RULES}, "n_em_dash": T.em_dash_count(F.col("straight")), "_l": T.sentence_lengths(F.col("straight"))})
    x = x.withColumn("_c", T.cadence(F.col("_l")))
    return x.withColumns({"sentences": F.col("_c.sentences"), "mean_sentence": F.col("_c.mean"), "cv": F.col("_c.cv")}).drop("straight", "_l", "_c")


def long(measured: DataFrame, *keys: str) -> DataFrame:
    """keys, words, rule_id, n: a row for each rule."""
    pairs = ", ".join(f"'{r}', cast(n_{r} as bigint)" for r in RULE_IDS)
    return measured.select(*keys, "words", F.expr(f"stack({len(RULE_IDS)}, {pairs}) as (rule_id, n)"))


def totals(measured: DataFrame) -> DataFrame:
    sums = {f"n_{r}": F.sum(f"n_{r}").alias(f"n_{r}") for r in RULE_IDS}
    return measured.groupBy("arm").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), *sums.values())


def rates(measured: DataFrame) -> DataFrame:
    """arm, rule_id, n, words, rate: matches a thousand words, a ratio of sums. Summed before it is unpivoted."""
    return long(totals(measured), "arm").withColumn("rate", F.when(F.col("words") > 0, F.col("n") / F.col("words") * 1000).otherwise(F.lit(0.0)))


#: Chances that a document is drawn at least once, twice and so on, in steps of 2^-31 (Poisson with mean 1).
_DRAWN = [round((1 - sum(math.exp(-1) / math.factorial(i) for i in range(k))) * 2147483647) for k in range(1, 10)]


def draws(name: str, rep: str) -> str:
    """SQL of how often a replicate draws a document: Poisson by a seeded number of both."""
    first = f"(({name} * 48271 + {rep} * 69621 + 12345) % 2147483647) * 16807 % 2147483647"
    x = f"((({first}) + {rep} * 7919) * 48271 % 2147483647)"
    return "(" + " + ".join(f"CASE WHEN {x} < {p} THEN 1 ELSE 0 END" for p in _DRAWN) + ")"


def bootstrap(measured: DataFrame, name: str = "doc_id", replicates: int = REPLICATES) -> DataFrame:
    """arm, rule_id, lo, hi: the 51st and the 1951st of the sorted rates of resampled documents (of 2,000).

    A document's draws are independent Poisson numbers with mean 1, the limit of drawing as many documents as there are with replacement: each row knows
    its own, so nothing is joined or placed, and sums are combined before the shuffle, to one row an arm and replicate a task.
    """
    cols = [f"n_{r}" for r in RULE_IDS]
    x = measured.select("arm", name, "words", *cols).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    x = x.withColumn("k", F.expr(draws(name, "rep"))).where("k > 0")
    summed = x.groupBy("arm", "rep").agg(F.sum(F.col("k") * F.col("words")).alias("words"), *[F.sum(F.col("k") * F.col(c)).alias(c) for c in cols])
    each = long(summed, "arm", "rep").withColumn("rate", F.when(F.col("words") > 0, F.col("n") / F.col("words") * 1000).otherwise(F.lit(0.0)))
    lo, hi = int(replicates * 0.025), int(replicates * 0.975)
    sorted_ = F.sort_array(F.collect_list("rate"))
    return each.groupBy("arm", "rule_id").agg(F.get(sorted_, F.lit(lo)).alias("lo"), F.get(sorted_, F.lit(hi)).alias("hi"))


def empty_arms(arms: DataFrame, kept: DataFrame) -> DataFrame:
    """arm, advice of each of ``arms`` of which no document is left."""
    return arms.select("arm").distinct().join(kept.select("arm").distinct(), "arm", "left_anti").select("arm", F.lit("no document left: lower the word limit or add texts").alias("advice"))


def require_arms(arms: DataFrame, kept: DataFrame) -> None:
    """Stops if an arm is empty."""
    empty = sorted(r.arm for r in bounded_rows(empty_arms(arms, kept), 10_000, "empty arms"))
    if empty:
        raise ValueError(f"no document left in {', '.join(empty)}: lower the word limit or add texts")


def separation(rated: DataFrame, first: str, second: str) -> DataFrame:
    """rule_id, verdict of two arms: separated if their intervals do not meet, suppressed if an arm is too thin."""
    a = rated.where(F.col("arm") == first).select("rule_id", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("documents").alias("d1"))
    b = rated.where(F.col("arm") == second).select("rule_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("documents").alias("d2"))
    thin = (F.col("d1") < MIN_DOCS) | (F.col("d2") < MIN_DOCS)
    apart = (F.col("lo1") > F.col("hi2")) | (F.col("lo2") > F.col("hi1"))
    return a.join(b, "rule_id").select("rule_id", F.when(thin, "suppressed").when(apart, "separated").otherwise("none").alias("verdict"))
