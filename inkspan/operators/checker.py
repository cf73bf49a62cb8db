"""The draft checker: spans of every rule, em dashes beyond the allowance, overlap resolution, ranking.

All of it is one narrow projection a document: spans are folded from the pieces between matches, so a text is
never shuffled; only the ranking of fired rules groups rows, and by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators.rules import EM_DASH_RULE, RULES, needed

HIT_CAP, DASH_WORDS = 400, 200
#: Spans are gathered in blocks of so many, as each step of an aggregate copies all that it has gathered.
BLOCK = 64
#: Stands around matches; no rule tells it from OTHER, which takes its place in a text that has it.
MARK, OTHER = "\x01", "\x02"
SPAN = "struct<start:int,end:int,ord:int,rule_id:string,sev:int>"


def lengths(t: Column, pattern: str) -> Column:
    """Lengths of what is before the first match, of that match, of what is between it and the next, and so on; t: without MARK. One scan."""
    return F.transform(F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1), F.length)


def found(lens: Column) -> Column:
    """How many matches there are in ``lengths``."""
    return F.shiftright(F.size(lens), 1)


def spans(lens: Column, most: Column, ord_: int, rule_id: str, sev: int) -> Column:
    """Array of spans [start, end) of the first ``most`` matches in ``lengths``."""
    n, none = F.least(found(lens), most), F.expr(f"cast(array() as array<{SPAN}>)")
    ks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    block = lambda k: F.slice(lens, 2 * BLOCK * k + 1, F.least(F.lit(2 * BLOCK), 2 * n - 2 * BLOCK * k))
    ats = F.aggregate(ks, F.array(F.lit(0)), lambda acc, k: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(block(k), F.lit(0), lambda x, y: x + y)))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["part"]
        b = a + p["hit"]
        one = F.struct(a.alias("start"), b.alias("end"), F.lit(ord_).alias("ord"), F.lit(rule_id).alias("rule_id"), F.lit(sev).alias("sev"))
        return F.struct(b.alias("at"), F.array_append(acc["out"], one).alias("out"))

    def of_block(z: Column) -> Column:
        pairs = F.arrays_zip(F.filter(block(z["k"]), lambda _, i: i % 2 == 0).alias("part"), F.filter(block(z["k"]), lambda _, i: i % 2 == 1).alias("hit"))
        return F.aggregate(pairs, F.struct(z["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    whole = F.flatten(F.transform(F.arrays_zip(ks.alias("k"), F.slice(ats, F.lit(1), F.size(ks)).alias("at")), of_block))
    return F.when(n == 0, none).otherwise(whole)


def too_many(dashes: Column, words: Column) -> Column:
    return dashes > F.greatest(F.lit(1), F.floor(words / DASH_WORDS))


def dash_flag(t: Column, words: Column) -> Column:
    """Whether a text has more em dashes than one in DASH_WORDS words, and than one at all."""
    return too_many(T.em_dash_count(t), words)


def with_hits(drafts: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, straight and hits: the spans of every rule within the cap, and of all dashes once there are too many."""
    x = drafts.withColumn("_t", T.plain_spaces(F.col(text), MARK, OTHER)).withColumn("words", F.regexp_count("_t", F.lit(r"\S++"))).withColumn("straight", T.straighten(F.col(text)))
    t, whole = F.col("_t"), F.array(F.length("_t"))
    x = x.withColumns({f"_m{i}": needed(r, t, lengths(t, r.java(True)), whole, True) for i, r in enumerate(RULES)} | {"_md": lengths(t, T.EM_DASH)})
    before, hits = F.lit(0), []
    for i, r in enumerate(RULES):
        m = F.col(f"_m{i}")
        # the cap comes before the places: a rule may match a repetitive text thousands of times
        room = F.when(before <= HIT_CAP, F.lit(HIT_CAP + 1) - before).otherwise(F.lit(1))
        hits.append(spans(m, room, i, r.id, r.sev))
        before = before + found(m)
    n, md = len(RULES), F.col("_md")
    dashes = F.when(too_many(found(md), F.col("words")), spans(md, found(md), n, EM_DASH_RULE[0], EM_DASH_RULE[2])).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))
    return x.withColumn("hits", F.concat(*hits, dashes)).drop("_t", "_md", *[f"_m{i}" for i in range(n)])


def kept(hits: Column) -> Column:
    """Spans left after overlaps: by start, the longer first, then rule order; each must begin at or after the last kept end."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["ord"].alias("ord"), h["rule_id"].alias("rule_id"), h["sev"].alias("sev"))))
    start = F.struct(F.lit(-1).alias("last"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        one = F.struct(h["start"].alias("start"), (-h["back"]).alias("end"), h["ord"].alias("ord"), h["rule_id"].alias("rule_id"), h["sev"].alias("sev"))
        more = F.struct((-h["back"]).alias("last"), F.array_append(acc["out"], one).alias("out"))
        return F.when(h["start"] >= acc["last"], more).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def checked(drafts: DataFrame, text: str = "text") -> DataFrame:
    """drafts with words, hits, kept and the cadence finding. Cut a long draft with ``textfn.draft_truncate`` first."""
    x = with_hits(drafts, text)
    x = x.withColumn("kept", kept(F.col("hits"))).withColumn("_l", T.sentence_lengths(F.col(text)))
    return x.withColumn("cadence", T.even_cadence(F.col("_l"), F.col("words"))).drop("_l", "straight")


def mark_text(t: Column, spans_: Column) -> Column:
    """The text escaped, kept spans in <mark>, line ends as <br>."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        plain = T.html_escape(F.substr(t, acc["at"] + 1, h["start"] - acc["at"]))
        inside = T.html_escape(F.substr(t, h["start"] + 1, h["end"] - h["start"]))
        return F.struct(h["end"].alias("at"), F.concat(acc["out"], plain, F.lit("<mark>"), inside, F.lit("</mark>")).alias("out"))

    whole = F.aggregate(spans_, start, step, lambda acc: F.concat(acc["out"], T.html_escape(F.substr(t, acc["at"] + 1))))
    return F.replace(whole, F.lit("\n"), F.lit("<br>"))


def fired_groups(found: DataFrame, key: str) -> DataFrame:
    """key, rule_id, sev, n, rank: fired rules by severity, count, first place; the cadence last."""
    # explode_outer: plain explode adds a filter on the array's size, and the optimiser writes its whole computation out again below
    x = found.select(key, F.explode_outer("kept").alias("h")).where("h is not null").groupBy(key, F.col("h.rule_id").alias("rule_id"), F.col("h.sev").alias("sev"))
    x = x.agg(F.count("*").alias("n"), F.min("h.start").alias("_first")).withColumn("_late", F.lit(0))
    c = found.select(key, F.explode_outer(F.array("cadence")).alias("_said")).where("_said is not null").select(key, F.lit("even_cadence").alias("rule_id"), F.lit(2).alias("sev"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("_first"), F.lit(1).alias("_late"))
    w = Window.partitionBy(key).orderBy("_late", F.desc("sev"), F.desc("n"), "_first")
    return x.unionByName(c).withColumn("rank", F.row_number().over(w)).drop("_first", "_late")


def tells_map(found: DataFrame) -> Column:
    """rule -> count of a checked draft, the cadence as 1."""
    ids = F.array_distinct(F.transform("kept", lambda h: h["rule_id"]))
    counts = F.transform(ids, lambda i: F.struct(i.alias("k"), F.size(F.filter("kept", lambda h: h["rule_id"] == i)).alias("v")))
    return F.map_from_entries(F.concat(counts, F.when(F.col("cadence").isNotNull(), F.array(F.struct(F.lit("even_cadence").alias("k"), F.lit(1).alias("v")))).otherwise(F.expr("cast(array() as array<struct<k:string,v:int>>)"))))


def summary(found: DataFrame, text: str = "text") -> DataFrame:
    """Adds tells, the number of kept spans, and message. A cadence that runs too evenly is no tell but is spoken of; so is a draft that was cut."""
    x = found.withColumn("tells", F.size("kept"))
    plural = lambda c, word: F.concat(c.cast("string"), F.lit(" " + word), F.when(c == 1, "").otherwise("s"))
    n, even = plural(F.col("words"), "word"), F.col("cadence").isNotNull()
    some = F.concat(plural(F.col("tells"), "tell"), F.lit(" in "), n, F.lit("."), F.when(even, " The sentences are of nearly one length.").otherwise(""))
    none = F.when(even, F.concat(F.lit("No phrase stands out in "), n, F.lit(", but the cadence does."))).otherwise(F.concat(F.lit(f"Clean: none of {len(RULES) + 2} tells in "), n, F.lit(".")))
    cut = F.when(F.length(F.col(text)) > T.DRAFT_CHARS, F.concat(F.lit(" Only the first "), n, F.lit(" of a long draft were read."))).otherwise("")
    return x.withColumn("message", F.concat(F.when(F.col("tells") > 0, some).otherwise(none), cut))
