"""Text functions with the whitespace, boundary and rounding rules of the browser the measurements come from.

Every function takes and gives a Column. Lengths and offsets are code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as the browser sees it, for use inside and outside a bracket; Java and RE2 read it alike.
WS_SET = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS, NOT_WS = f"[{WS_SET}]", f"[^{WS_SET}]"
#: An ASCII word boundary: Java's own knows other letters too, its \\w does not.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
EM_DASH = r"—|(?<!-)--(?!-)"
SENTENCE_END = f"[.!?]+[{WS_SET}\"')\\]]*"
DRAFT_CHARS = 60_000


def dialect(pattern: str, java: bool, plain: bool = False) -> str:
    """A browser pattern for Java or RE2: its whitespace class in both, its word boundary in Java. plain: for Java over ``plain_spaces``."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e == "s":
                out.append("\\s" if plain else WS_SET if depth else WS)
            elif e == "b" and not depth and java:
                before, after = pattern[:i], pattern[i + 2 :]
                if re.match(r"(?:\(\?:)?(?:[A-Za-z]|\\w|\[A-Z\])", after) and not re.match(r"\(\?:[^()]*\)\?", after):
                    out.append("(?<!\\w)")  # a letter follows, so one side is enough
                elif re.search(r"(?:[A-Za-z]|[a-z]\)|[a-z]\)\?\))$", before) and not before.endswith("?s?)"):
                    out.append("(?!\\w)")
                else:
                    out.append(BOUNDARY)
            else:
                out.append(c + e)
            i += 2
            continue
        depth += (c == "[" and not depth) - (c == "]" and depth > 0)
        out.append(c)
        i += 1
    return "".join(out)


_BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def plain_blanks(t: Column) -> Column:
    """All whitespace that is not ASCII as blanks, one for one: Java's own class of it then says the same and is several times as fast."""
    return F.translate(t, _BLANKS, " " * len(_BLANKS))


def word_count(t: Column) -> Column:
    return F.regexp_count(plain_blanks(t), F.lit(r"\S++"))


_CURLY, _STRAIGHT = "‘’‛“”‟", "'''\"\"\""


def straighten(t: Column) -> Column:
    """Curly quotes made straight, one character for one."""
    return F.translate(t, _CURLY, _STRAIGHT)


def plain_spaces(t: Column, more: str = "", to: str = "") -> Column:
    """Straightened, and all whitespace that is not ASCII as a vertical tab, or as a line feed where it ends a line; so no blank that a pattern spells out
    comes to be. One character for one; those of ``more`` become those of ``to``."""
    return F.translate(t, _CURLY + _BLANKS + more, _STRAIGHT + "".join("\n" if c in "\u2028\u2029" else "\v" for c in _BLANKS) + to)


def draft_truncate(t: Column, most: int = DRAFT_CHARS) -> Column:
    """A long draft cut at its last space at or before ``most``, or right there if it has none."""
    head = F.substring(t, 1, most + 1)
    cut = F.lit(most + 1) - F.locate(" ", F.reverse(head))
    has = F.locate(" ", F.reverse(head)) > 0
    return F.when(F.length(t) <= most, t).when(has & (cut > 0), F.substr(t, F.lit(1), cut)).otherwise(F.substring(t, 1, most))


def em_dash_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(EM_DASH))


def sentence_lengths(t: Column) -> Column:
    """Words of each sentence; empty pieces are left out."""
    return F.filter(F.transform(F.split(plain_blanks(t), r"[.!?]++[\s\"')\]]*+"), lambda s: F.regexp_count(s, F.lit(r"\S++"))), lambda n: n > 0)


def cadence(lengths: Column) -> Column:
    """struct(sentences, mean, sd, cv) of sentence lengths, with the population's deviation; cv 0 without words."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    square = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sd = F.when(n > 0, F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.struct(n.alias("sentences"), mean.alias("mean"), sd.alias("sd"), F.when(mean > 0, sd / mean).otherwise(F.lit(0.0)).alias("cv"))


def even_cadence(lengths: Column, words: Column) -> Column:
    """The finding's text if sentences run too evenly, else null."""
    c = cadence(lengths)
    even = (c["sentences"] >= 5) & (words >= 80) & (c["mean"] >= 5) & (c["cv"] < 0.35)
    said = F.format_string("%d sentences, %d to %d words, mean %d", c["sentences"], F.array_min(lengths), F.array_max(lengths), F.floor(c["mean"] + 0.5).cast("int"))
    return F.when(even, said)


def collapse(t: Column) -> Column:
    return F.regexp_replace(t, WS + "+", " ")


def js_trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def norm_hash(t: Column) -> Column:
    return F.md5(F.lower(js_trim(collapse(t))))


def dedupe_key(t: Column) -> Column:
    """The first 300 characters, lower case, blanks squeezed: cut first."""
    return collapse(F.lower(F.substring(t, 1, 300)))


_LEAD = "Ã[\u0080-¿]|â\u0080"


def demojibake(t: Column) -> Column:
    """UTF-8 read as Latin-1, read again if its signature is there and all of it is sound; else unchanged. Of a character beyond Latin-1 the low byte counts."""
    low = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c == "", "").when(F.ascii(c) > 65535, F.char(F.shiftright(F.ascii(c) - 65536, 10))).otherwise(F.char(F.ascii(c)))), "")
    again = F.encode(F.when(t.rlike(r"^[\x{0}-\x{ff}]*+$"), t).otherwise(low), "ISO-8859-1").cast("string")
    return F.when(t.rlike(_LEAD), F.when(F.is_valid_utf8(again), again).otherwise(t)).otherwise(t)


def clean_text(t: Column) -> Column:
    """Collected text, repaired, without entities, placeholders, rulers and legal tails, with blanks squeezed."""
    t = demojibake(t)
    t = F.regexp_replace(t, r"&(nbsp|amp|lt|gt|quot|#\d+);", " ")
    t = F.regexp_replace(t, BOUNDARY + "urlLink" + BOUNDARY, "")
    t = F.regexp_replace(t, rf"(?m)^{WS}*(?:\*{{3,}}|={{3,}}|_{{3,}}).*$", "")
    t = F.regexp_replace(t, r"(?i)This (?:e-?mail|message)[\s\S]{0,400}?(?:confidential|privileged)[\s\S]{0,400}$", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return js_trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def html_escape(t: Column) -> Column:
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attr_escape(t: Column) -> Column:
    return F.replace(html_escape(t), F.lit('"'), F.lit("&quot;"))


def sanitize_html(t: Column) -> Column:
    """Only links survive, rebuilt with an allowed address or none."""
    bare = F.regexp_replace(t, r"<(?!/?a(" + WS + r"|>))[^>]*>", "")
    tag = rf"(?i)<a({WS}[^>]*)?>"
    pieces, tags = F.split(bare, tag), F.regexp_extract_all(bare, F.lit(rf"(?i)(<a(?:{WS}[^>]*)?>)"), F.lit(1))

    def rebuilt(x: Column) -> Column:
        href = js_trim(F.regexp_extract(x, rf"(?i)href{WS}*={WS}*(?:\"([^\"]*)\"|'([^']*)'|([^{WS_SET}>]+))", 0))
        value = js_trim(F.regexp_replace(F.regexp_replace(href, rf"(?i)^href{WS}*={WS}*", ""), "^[\"']|[\"']$", ""))
        good = value.rlike(r"(?i)^(https?://|mailto:|/|#)")
        return F.when(good, F.concat(F.lit('<a href="'), attr_escape(value), F.lit('" rel="noopener">'))).otherwise("<a>")

    both = F.zip_with(pieces, F.transform(tags, rebuilt), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    return F.array_join(both, "")


def json_extract(t: Column) -> Column:
    """From the first opening brace to the last closing one; '' without."""
    return F.regexp_extract(t, r"(?s)\{.*\}", 0)
