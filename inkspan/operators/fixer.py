"""Mechanical rewrites: phrase cuts, word swaps, dash surgery, cleanup, with the number of changes.

A swap's replacement depends on the ending of what it matched and on its first letter. Each form is therefore a literal
replacement of its own; forms of one swap never overlap, so they can be applied one after the other.
A word is only rewritten in texts that hold it, by native expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.textfn import EM_DASH, WS, dialect

# Phrases that are cut.
PHRASE_CUTS = [
    r"\bIt(?:'|’)s (?:important|worth) (?:to note|noting)(?: that)?[,:]?\s*",
    r"\bIn (?:conclusion|summary),?\s*",
    r"\bLet(?:'|’)s dive in[.!]?\s*",
    r"\bIn today(?:'|’)s (?:fast-paced|ever-changing|digital|modern)[^,.]{0,30},?\s*",
    r"\bNeedless to say,?\s*",
]
# Words that are swapped, in order: (stem, endings, replacement by base|s|ing|ed), or (word, replacement).
SWAPS = [
    ("delv", ("e into", "es into", "ing into"), ("dig into", "digs into", "digging into", "dig into")),
    ("delve", "dig"), ("tapestry", "mix"), ("meticulously", "carefully"), ("meticulous", "careful"), ("pivotal", "key"), ("crucial", "key"), ("seamlessly", "smoothly"), ("seamless", "smooth"),
    ("leverag", ("e", "es", "ing", "ed"), ("use", "uses", "using", "used")),
    ("harness", ("", "es", "ing", "ed"), ("use", "uses", "using", "used")),
    ("foster", ("", "s", "ing", "ed"), ("support", "supports", "supporting", "supported")),
    ("facilitat", ("e", "es", "ing", "ed"), ("help", "helps", "helping", "helped")),
    ("streamlin", ("e", "es", "ing", "ed"), ("simplify", "simplifies", "simplifying", "simplified")),
    ("bolster", ("", "s", "ing", "ed"), ("support", "supports", "supporting", "supported")),
    ("elevat", ("e", "es", "ing", "ed"), ("raise", "raises", "raising", "raised")),
    ("empower", ("", "s", "ing", "ed"), ("help", "helps", "helping", "helped")),
    ("unlock", ("", "s", "ing", "ed"), ("open up", "opens up", "opening up", "opened up")),
    ("transformative", "major"), ("groundbreaking", "new"), ("cutting-edge", "new"), ("unprecedented", "new"), ("ever-evolving", "changing"), ("multifaceted", "varied"), ("nuanced", "subtle"), ("holistic", "complete"),
    ("myriad of", "many"), ("myriad", "many"), ("a plethora of", "plenty of"), ("robust", "solid"),
    ("showcas", ("e", "es", "ed", "ing"), ("show", "shows", "showing", "showed")),
    ("underscor", ("e", "es", "ed", "ing"), ("show", "shows", "showing", "showed")),
    ("boasts", "has"),
    ("garner", ("", "ed", "s", "ing"), ("get", "gets", "getting", "got")),
    ("vibrant", "lively"), ("breathtaking", "striking"), ("stunning", "striking"), ("intricate", "detailed"), ("game-changer", "big deal"), ("game-changing", "big deal"), ("paradigm shift", "big change"),
    ("a testament to", "a sign of"), ("the testament to", "a sign of"), ("synergy", "teamwork"), ("synergies", "teamwork"),
]


def forms() -> list[tuple[str, str]]:
    """(matched form, replacement) in lower case, in order."""
    out = []
    for s in SWAPS:
        if len(s) == 2:
            out.append(s)
            continue
        stem, endings, (base, es, ing, ed) = s
        for e in endings:
            w = stem + e
            out.append((w, ing if w.endswith("ing") else ed if w.endswith("ed") else es if w.endswith("s") else base))
    return out


def _steps(java: bool) -> list[tuple[str, str]]:
    b = dialect(r"\b", java)
    out = []
    for word, to in forms():
        rest = "(?i:" + word[1:] + ")"
        out.append((f"{b}{word[0]}{rest}{b}", to))
        out.append((f"{b}{word[0].upper()}{rest}{b}", to[0].upper() + to[1:]))
    return out


def cut_phrases(df: DataFrame, text: str) -> DataFrame:
    """df with ``text`` cut and n_cuts."""
    x, total = df.withColumn("_t0", F.col(text)), F.lit(0)
    for i, p in enumerate(PHRASE_CUTS):
        j = "(?i)" + dialect(p, True)
        total = total + F.regexp_count(f"_t{i}", F.lit(j))
        x = x.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", j, ""))
    n = len(PHRASE_CUTS)
    return x.withColumn("n_cuts", total).withColumn(text, F.col(f"_t{n}")).drop(*[f"_t{i}" for i in range(n + 1)])


def swap_words(df: DataFrame, text: str) -> DataFrame:
    """df with the words of ``text`` swapped and n_swaps. Texts without any listed word pass by."""
    steps = _steps(True)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(w.lower()).alias("w")) for (p, r), w in zip(steps, [w for w, _ in forms() for _ in (0, 1)])])
    low = F.lower(F.col(text))
    mine = F.filter(table, lambda s: F.contains(low, s["w"]))
    start = F.struct(F.col(text).alias("o"), F.lit(0).alias("n"))
    fold = F.aggregate(F.col("_mine"), start, lambda a, s: F.struct(F.regexp_replace(a["o"], s["p"], s["r"]).alias("o"), (a["n"] + F.regexp_count(a["o"], s["p"])).alias("n")))
    x = df.withColumn("_mine", mine).withColumn("_f", fold)
    return x.withColumn("n_swaps", F.col("_f.n")).withColumn(text, F.col("_f.o")).drop("_mine", "_f")


def fix_dashes(df: DataFrame, text: str) -> DataFrame:
    """Dashes with the blanks around them made commas, and n_dashes."""
    return df.withColumn("n_dashes", F.regexp_count(text, F.lit(EM_DASH))).withColumn(text, F.regexp_replace(text, f"{WS}*(?:{EM_DASH}){WS}*", ", "))


def cleanup(t: Column) -> Column:
    """Doubled commas, commas after a sentence, runs of blanks; then a capital at the start of each sentence."""
    t = F.regexp_replace(t, f",{WS}*,", ",")
    t = F.regexp_replace(t, rf"([.!?]){WS}*,{WS}*", "$1 ")
    t = F.regexp_replace(t, f"{WS}{{2,}}", " ")
    pieces = F.split(t, rf"(?<=[.!?]{WS})(?!{WS})", -1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


def apply_fixes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``text`` rewritten and n_changes."""
    x = fix_dashes(swap_words(cut_phrases(df, text), text), text)
    return x.withColumn("n_changes", F.col("n_cuts") + F.col("n_swaps") + F.col("n_dashes")).withColumn(text, cleanup(F.col(text))).drop("n_cuts", "n_swaps", "n_dashes")
