"""Text quality: per-text statistics and a learned, ordered rule list that tells prose from lists, tables and junk.

The statistics are native expressions over the whole text. The rules are induced by incremental reduced-error pruning
on labelled documents made here: sentences of a bounded sample of clean texts (``SAMPLE_TEXTS``) laid out as prose in
many shapes, as lists, as tables and as junk. The thresholds become one SQL CASE, so the corpus never leaves the JVM.

Defined results: null and blank texts have zero words and no kind; ties between rules go to the earlier rule; repeated rows are
each judged; a text of any length is judged whole.
"""

from __future__ import annotations

import base64
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.tables import bounded_rows

SAMPLE_TEXTS = 300
DOCS_PER_KIND = 600
KINDS = ("table", "list", "junk")

FEATURES = (
    "n_words", "mean_word", "max_word", "distinct", "letters", "symbols", "digits", "end_punct", "bullets", "open_bullets", "cells", "line_words", "items",
    "common", "commas", "segment", "single", "stops", "n_lines", "lower_start", "open_end",
)
COUNTS = ("n_words", "max_word", "n_lines")
#: What a line of a list begins with, and what the cells of a row stand between.
BULLET = r"^(\[.?\]|[-*•·–—►✓+]|\d{1,3}[.)]|[a-zA-Z][.)])\s"
CELLS = r"\t|^\|.*\||;\S.*;\S|\S\s{3,}\S.*\S\s{2,}\S|\.{4,}.*\.{3,}|: [\d.,]+ / [\d.,]+|\S,[\d.]+,[\d.]+"
_SYMBOLS = r"<>|{}\/=+#_*&^%$@~;`[]"


def word_count(text: Column) -> Column:
    """Runs of non-whitespace; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def with_statistics(df: DataFrame, text: str, common: list[str]) -> DataFrame:
    """Adds the per-text statistics named in FEATURES. ``common``: lower-case common words."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<br\s*/?>|\r", "\n"))
    x = df.withColumn("_t", t)
    x = x.withColumn("_lines", F.expr(r"filter(transform(split(_t, '\n'), l -> trim(l)), l -> l <> '')")).withColumn("_words", F.expr(r"filter(split(_t, '\\s+'), w -> w <> '')"))
    known = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(set(common)))
    x = x.withColumn("n_words", F.size("_words")).withColumn("n_lines", F.size("_lines"))
    x = x.withColumn("_solid", F.greatest(F.length(F.regexp_replace("_t", r"\s+", "")), F.lit(1))).withColumn("_n", F.greatest("n_words", F.lit(1))).withColumn("_m", F.greatest("n_lines", F.lit(1)))
    lines = lambda pattern: F.expr(f"size(filter(_lines, l -> l rlike r'{pattern}'))") / F.col("_m")
    gone = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, "")))
    return x.withColumns({
        "mean_word": F.col("_solid") / F.col("_n"),
        "max_word": F.coalesce(F.expr("array_max(transform(_words, w -> length(w)))"), F.lit(0)),
        "distinct": F.size(F.array_distinct("_words")) / F.col("_n"),
        "letters": F.length(F.regexp_replace("_t", r"\P{L}+", "")) / F.col("_solid"),
        "symbols": gone(_SYMBOLS) / F.col("_solid"),
        "digits": gone("0123456789") / F.col("_solid"),
        "end_punct": lines(r"""[.!?…"”»)]$"""),
        "bullets": lines(BULLET),
        "open_bullets": lines(BULLET + r".*[^.!?…]$"),
        "cells": lines(CELLS),
        "line_words": F.col("n_words") / F.col("_m"),
        "items": lines(r"^[^\p{Ll}\W]\S*(\s+\S+){0,6}(?<![.!?…:,;])$"),
        "common": F.expr(f"size(filter(_words, w -> lower(w) in ({known})))") / F.col("_n") if known else F.lit(0.0),
        "lower_start": lines(r"^\p{Ll}"),
        "open_end": lines(r"[;,]$"),
        "commas": gone(",") / F.col("_n"),
        "segment": F.col("_n") / (gone(",;\n") + 1),
        "single": F.expr("size(filter(_words, w -> length(w) = 1))") / F.col("_n"),
        "stops": F.regexp_count("_t", F.lit(r"[.!?…][\"”»)]*(\s|$)")) / F.col("_n"),
    }).drop("_t", "_lines", "_words", "_solid", "_n", "_m")


# --- labelled documents ------------------------------------------------------------------------------------


def _phrases(rng: random.Random, sentences: list[str]) -> list[str]:
    out = []
    while len(out) < 12:
        ws = re.sub(r"[^\w\s'’-]", "", rng.choice(sentences)).split()
        if len(ws) > 5:
            k, n = rng.randrange(len(ws) - 4), rng.choice([2, 3, 3, 4, 4, 5, 6])
            part = ws[k : k + n]
            long = [w for w in part if len(w) > 4]  # half of the phrases without function words
            out.append(" ".join(long if long and rng.random() < 0.5 else part))
    return out


def _prose(rng: random.Random, sentences: list[str]) -> str:
    n = rng.choice([1, 1, 2, 3, 5, 8, 12])
    ss = [rng.choice(sentences) for _ in range(n)]
    shape = rng.randrange(16)
    if shape == 0:
        return "\n".join(s.rstrip(".!?") for s in ss)
    if shape in (1, 13, 14, 15):  # verse
        width, lines = rng.randrange(14, 34), []
        for s in ss:
            cur = ""
            for w in s.rstrip(".!?").split():
                if cur and len(cur) + len(w) > width:
                    lines.append(cur)
                    cur = w
                else:
                    cur = f"{cur} {w}".strip()
            lines.append(cur)
        return "\n".join(lines)
    if shape == 2:
        return "\n".join(rng.choice(["- ", "— ", "– "]) + s for s in ss)
    if shape == 3:
        return "\n".join(rng.choice(["a: ", "me: ", "ok ", "<mia> ", ""]) + s.lower().rstrip(".") for s in ss)
    if shape == 4:
        return " ".join(ss).upper()
    if shape == 5:
        return " ".join(ss) + "\n\n" + "\n".join("- " + p for p in _phrases(rng, sentences)[: rng.randrange(2, 4)]) + "\n\n" + " ".join(rng.choice(sentences) for _ in range(3))
    if shape == 6:
        return re.sub(r"[^\w\s'’-]", "", " ".join(ss)).lower()
    if shape == 7:
        return " ".join(s[:-1] + f" ({rng.randrange(900)} of {rng.randrange(9999)}, or {rng.random() * 100:.1f}%)." for s in ss)
    if shape == 8:
        return "<br /><br />".join(ss)
    if shape == 9:
        return " ".join(ss).replace(" ", "  ", 3) + rng.choice(["", "\n*** end ***", "\n\n\n", " urlLink", " &nbsp; ok."])
    if shape == 10:
        return "# " + rng.choice(_phrases(rng, sentences)) + "\n\n" + "\n\n".join(ss)
    return rng.choice([" ", "\n\n", "\n"]).join(ss)


def _list(rng: random.Random, sentences: list[str]) -> str:
    items = (_phrases(rng, sentences) * 2)[: rng.randrange(5, 20)]
    shape = rng.randrange(8)
    if shape == 0:
        return ", ".join(items)
    if shape in (1, 2):
        end = rng.choice(["", "", "", ";", ","])
        return "\n".join((x[:1].upper() + x[1:] if not end or rng.random() < 0.3 else x) + end for x in items)
    if shape == 3:
        return "\n".join(f"[{rng.choice('x  ')}] {x}" for x in items)
    if shape == 4:
        return "\n".join(f"{i}{rng.choice('.)')} {x}" for i, x in enumerate(items, 1))
    if shape == 5:
        m = rng.choice(["- ", "  a. ", "1. "])
        return rng.choice(sentences) + "\n" + "\n".join((m if m != "  a. " else f"  {chr(97 + i % 26)}. ") + x for i, x in enumerate(items))
    if shape == 6:
        return "; ".join(items)
    b = rng.choice(["- ", "* ", "• ", "· ", "– ", "+ "])
    return "\n".join(b + x for x in items)


def _table(rng: random.Random, sentences: list[str]) -> str:
    rows = [[p if rng.random() < 0.6 else p + " " + rng.choice(sentences)[:40].rstrip(".,!? "), f"{rng.random() * 900:.{rng.randrange(3)}f}", str(rng.randrange(5000)), f"20{rng.randrange(5, 22):02d}-{rng.randrange(1, 13):02d}"][: rng.randrange(3, 5)] for p in (_phrases(rng, sentences) * 2)[: rng.randrange(3, 16)]]
    shape = rng.randrange(8)
    head = [["item", "rate", "n", "month"]] if rng.random() < 0.5 else []
    if shape == 0:
        return "\n".join("| " + " | ".join(r) + " |" for r in [*head, ["---"] * 4, *rows])
    if shape == 1:
        return "\n".join("\t".join(r) for r in head + rows)
    if shape == 2:
        return "\n".join(";".join(r) for r in head + rows)
    if shape == 3:
        return "\n".join(f"{r[0]:<44}{r[1]:>8}{r[2]:>7}" + (f"  {r[3]}" if len(r) > 3 else "") for r in rows)
    if shape == 4:
        return "\n".join(" .......... ".join(r[:1] + r[2:3]) + " .... " + r[1] for r in rows)
    if shape == 5:
        return "\n".join(f"{r[0]}: {r[1]} / {r[2]}" + (f" ({r[3]})" if len(r) > 3 else "") for r in rows)
    if shape == 6:
        return "\n".join(",".join(r) for r in head + rows)
    return "\n".join(" | ".join(r) for r in head + rows)


def _junk(rng: random.Random, sentences: list[str]) -> str:
    shape = rng.randrange(10)
    n = rng.randrange(20, 160)
    if shape == 0:
        return " ".join([rng.choice(["test", "click here", "urlLink", "lorem", "null", "aaa", "undefined", "READ MORE", "SHARE", rng.choice(_phrases(rng, sentences)).split()[0]])] * n)
    if shape == 1:
        s = list(rng.choice(sentences).replace(" ", "") * 3)
        rng.shuffle(s)
        return "".join(s)
    if shape == 2:
        s = list(rng.choice(sentences).replace(" ", "") * 2)
        rng.shuffle(s)
        return " ".join(s)
    if shape == 3:
        return base64.b64encode(rng.randbytes(rng.randrange(60, 500))).decode()
    if shape == 4:
        return "".join(f'<{x} class="c{rng.randrange(99)}"></{x}>' for x in (rng.choice(["div", "span", "td", "br", "font", "p"]) for _ in range(n // 4)))
    if shape == 5:
        return "".join(rng.choice("!?/*<>#$%^&_+=|\\~@ \n") for _ in range(n * 2))
    if shape == 6:
        return " ".join(str(rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(n // 2 + 8))
    if shape == 7:
        return "\n".join(f"{rng.randrange(10**9):09d} 0x{rng.randrange(16**8):08x} ERR_{rng.randrange(99)} rc={rng.randrange(9)}" for _ in range(rng.randrange(3, 16)))
    if shape == 8:
        return rng.randbytes(rng.randrange(40, 300)).hex()
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(1, 14))) for _ in range(n // 2 + 8))


def made_documents(sentences: list[str], seed: int = 5, per_kind: int = DOCS_PER_KIND) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    makers = {"prose": _prose, "list": _list, "table": _table, "junk": _junk}
    return [(make(rng, sentences), kind) for kind, make in makers.items() for _ in range(per_kind * (3 if kind == "prose" else 1))]


# --- incremental reduced-error pruning ---------------------------------------------------------------------

Condition = tuple[int, str, float]


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), dtype=bool)
    for j, op, v in rule:
        m &= (x[:, j] <= v) if op == "<=" else (x[:, j] > v)
    return m


def _grow(x: np.ndarray, y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    m = np.ones(len(x), dtype=bool)
    while (~y[m]).any() and len(rule) < 5:
        p0, n0 = y[m].sum(), (~y[m]).sum()
        best, gain0 = None, 0.0
        for j in range(x.shape[1]):
            values = np.unique(x[m, j])
            if len(values) < 2:
                continue
            mids = (values[1:] + values[:-1]) / 2
            if len(mids) > 40:
                mids = np.quantile(mids, np.linspace(0, 1, 40))
            for v in mids:
                for op in ("<=", ">"):
                    k = m & ((x[:, j] <= v) if op == "<=" else (x[:, j] > v))
                    p, n = y[k].sum(), (~y[k]).sum()
                    if p == 0:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > gain0 + 1e-9:
                        best, gain0 = (j, op, float(v)), gain
        if best is None:
            break
        rule.append(best)
        m &= (x[:, best[0]] <= best[2]) if best[1] == "<=" else (x[:, best[0]] > best[2])
    return rule


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> tuple[list[Condition], float]:
    def worth(r: list[Condition]) -> float:
        m = _covers(r, x)
        p, n = y[m].sum(), (~y[m]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best, worth(best)


def induce(x: np.ndarray, labels: np.ndarray, seed: int = 1) -> list[tuple[str, list[Condition]]]:
    """An ordered rule list for KINDS; what no rule covers is prose."""
    rng = np.random.default_rng(seed)
    rules, left = [], np.ones(len(x), dtype=bool)
    for kind in KINDS:
        misses = 0
        while (labels[left] == kind).sum() >= 4 and misses < 6:
            idx = rng.permutation(np.flatnonzero(left))
            cut = len(idx) * 2 // 3
            grow, prune = idx[:cut], idx[cut:]
            rule, worth = _prune(_grow(x[grow], labels[grow] == kind), x[prune], labels[prune] == kind) if (labels[grow] == kind).any() else ([], -1.0)
            if not rule or worth < 0.8:  # another split of what is left may do better
                misses += 1
                continue
            rules.append((kind, rule))
            left &= ~_covers(rule, x)
        left &= labels != kind
    return rules


def as_case(rules: list[tuple[str, list[Condition]]]) -> str:
    """The rule list as a SQL CASE over the statistics."""
    if not rules:
        return "cast(null as string)"
    when = [f"when {' and '.join(f'{FEATURES[j]} {op} {v!r}D' for j, op, v in rule)} then '{kind}'" for kind, rule in rules]
    return "case when n_words = 0 then null " + " ".join(when) + " end"


def learn(spark: SparkSession, texts: DataFrame, key: str, text: str, common: list[str], sample: int = SAMPLE_TEXTS) -> str:
    """Learns the rule list on documents made from a bounded sample of clean texts; returns its CASE."""
    rows = texts.where(F.length(text) > 200).orderBy(F.xxhash64(key, F.lit(9)), key).limit(sample).select(text).collect()
    sentences = [s.strip() for r in rows for s in re.split(r"(?<=[.!?])\s+", r[0]) if 5 < len(s.split()) < 40 and "\n" not in s.strip() and s.strip()[-1] in ".!?"]
    docs = made_documents(sentences or ["We moved the second chapter to the end and nobody noticed it.", "The printer was out of paper again on Monday morning."])
    made = with_statistics(spark.createDataFrame(docs, "text string, kind string").repartition(4), "text", common).select("kind", *FEATURES).toPandas()
    return as_case(induce(made[list(FEATURES)].to_numpy(dtype=float), made["kind"].to_numpy()))


def common_list(common_words: DataFrame) -> list[str]:
    return [r.word for r in bounded_rows(common_words.where("word is not null").select("word").distinct(), 10_000, "common words")]


def kinds(df: DataFrame, text: str, case: str, common: list[str]) -> DataFrame:
    """df's statistics with ``kind``: list, table, junk, or null for prose and blank texts."""
    x = with_statistics(df, text, common).withColumn("kind", F.expr(case))
    # exact check: a list has three items, a table two rows
    few = (F.col("n_lines") < 3) & (F.col("commas") * F.col("n_words") < 3) & (F.col("segment") > F.col("n_words") / 3)
    flat = (F.col("n_lines") < 2) & (F.col("kind") == "table")
    return x.withColumn("kind", F.when((F.col("kind") == "list") & few, None).when(flat, F.when(F.col("letters") < 0.2, "junk")).otherwise(F.col("kind")))
