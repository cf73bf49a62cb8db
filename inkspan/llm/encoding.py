"""Garbled text from wrong character encodings: noisy-channel decoding under corpus word frequencies.

Every distinct word with a non-ASCII character is taken back to bytes by each wrong decoder; a lost character is a wildcard. The bytes form
a lattice whose edges are the characters that the right encoding may hold there, and a Viterbi search gives the cheapest reading, a "*" standing for
what is lost. An edge costs what its character is rare in the words of the whole corpus (a bounded table of characters). Readings compete with the word itself under the counts of words in the whole corpus. Candidates and counts are
joined as tables: no vocabulary is held in memory, and texts are only scanned natively.

A reading of multi-byte UTF-8 needs no known word, since such byte patterns do not come about by chance; a reading that stands
alone (a quoted "Ã©", a list of glyphs) or comes from a single-byte mix-up must be a far more frequent word than what is written; four bytes that make an emoji are evidence enough.

Defined results: null and empty texts are no case; U+FFFD in a text is always a case; lost characters are restored by the most frequent
word of that shape, ties by the word itself, and stay where no word fits; repeated rows are each judged.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.tables import bounded_rows, cut

LOST = "�"
WRONG = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859-15")
#: How many times more frequent a reading must be that has no other evidence, and its least count.
RATIO, LEAST = 20, 5  # a word with three plain letters is evidence enough for 4 and 3
# Characters that texts in English, French, German and Spanish hold.
NORMAL = frozenset("áéíóúñüÁÉÍÓÚÑÜäößÄÖẞàâæçèéêëîïôœùûÿÀÂÆÇÈÉÊËÎÏÔŒÙÛŸ’‘“”„‚‹›«»—–…€£°·•¿¡ºª§©®™×½¼²³\u00a0\u202f\u00ad\u200b")

_ENCODE: dict[str, dict[str, int]] = {}
for _codec in WRONG:
    _table: dict[str, int] = {}
    for _b in range(256):
        try:
            _table[bytes([_b]).decode(_codec)] = _b
        except UnicodeDecodeError:
            _table[chr(_b)] = _b
    for _b in range(0x80, 0xA0):  # undefined bytes are often kept as control characters
        _table.setdefault(chr(_b), _b)
    _ENCODE[_codec] = _table


def to_bytes(word: str, codec: str) -> list[int | None] | None:
    """The bytes of a word under a decoder, None for a lost one; None if the decoder cannot have produced the word."""
    table = _ENCODE[codec]
    out: list[int | None] = []
    for c in word:
        if c == LOST:
            out.append(None)
        elif c in table:
            out.append(table[c])
        else:
            return None
    return out


#: Costs of a character that no word holds, of one beyond these languages on top, and of a lost one by whether bytes of it are left.
UNSEEN, STRANGE, LOST_ONE, LOST_PART = 24.0, 30.0, 80.0, 60.0
#: Most characters whose counts are held.
CHARACTERS = 200_000


def _edges(b: list[int | None], i: int, costs: dict[str, float]) -> Iterator[tuple[int, str, float]]:
    """(next position, character, cost) of the UTF-8 characters that may start at i; '*' for one with lost bytes."""
    x = b[i]
    if x is not None and x < 0x80:
        yield i + 1, chr(x), 0.0
        return
    if x is None:
        yield i + 1, "*", LOST_ONE
    for n, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        part = b[i : i + n]
        if len(part) < n or not (x is None or low <= x <= high) or not all(y is None or 0x80 <= y <= 0xBF for y in part[1:]):
            continue
        if None in part:
            if not all(y is None for y in part):
                yield i + n, "*", LOST_PART
            continue
        try:
            c = bytes(part).decode("utf-8")
        except UnicodeDecodeError:
            continue
        usual = c in NORMAL or ord(c) in _C1 or c in _HALF
        if usual or (n > 2 and unicodedata.category(c)[0] in "SPLMN"):
            yield i + n, c, costs.get(c, UNSEEN) + (0.0 if usual else STRANGE)


_C1 = frozenset(range(0x80, 0xA0))
#: Characters that a word read wrongly twice holds after the first step back.
_HALF = frozenset("ÃÂâƒ€™œžŸšŠ¢†‡ˆ‰‹Œ˜¬¤¦¨¯´¸¹¶±µþðÐÞå¥ãÅ")


def viterbi(b: list[int | None], costs: dict[str, float] | None = None) -> str | None:
    """The cheapest UTF-8 reading of a byte lattice. costs: of characters, by their counts in the corpus."""
    costs = costs or {}
    best: list[tuple[float, int, str] | None] = [None] * (len(b) + 1)
    best[0] = (0.0, -1, "")
    for i in range(len(b)):
        if best[i] is None:
            continue
        for j, c, cost in _edges(b, i, costs):
            total = best[i][0] + cost
            if best[j] is None or total < best[j][0]:
                best[j] = (total, i, c)
    if best[-1] is None:
        return None
    out, i = [], len(b)
    while i > 0:
        out.append(best[i][2])
        i = best[i][1]
    return "".join(reversed(out))


def _plausible(s: str) -> bool:
    """Only characters of these languages, or others that take three bytes and more, which do not come about by chance."""
    return all(c.isascii() or c in NORMAL or (ord(c) > 0x7FF and c not in _HALF and unicodedata.category(c)[0] in "SPLMN") for c in s)


def _run(run: str, codec: str, costs: dict[str, float]) -> str:
    for _ in range(3):
        b = to_bytes(run, codec)
        got = None if b is None or None in b else viterbi(b, costs)
        if got is None or got == run:
            break
        run = got
    return run


def readings(word: str, costs: dict[str, float] | None = None) -> set[tuple[str, str]]:
    """(reading, kind) of a word: kind utf8, bytes (one single-byte code read as another) or lost."""
    out: set[tuple[str, str]] = set()
    costs = costs or {}
    for codec in WRONG:
        seen, now = 0, word
        while seen < 3:
            b = to_bytes(now, codec)
            if b is None or all(x is not None and x < 0x80 for x in b):
                break
            got = viterbi(b, costs)
            if got is None or got == now:
                break
            seen, now = seen + 1, got
            if "*" in got:
                out.add((got, "lost"))
                break
            if _plausible(got):
                out.add((got, "utf8"))
        # runs of other characters one by one: parts of a word may be sound
        mixed = re.sub(r"[^\x00-\x7f]+", lambda m, c=codec: _run(m.group(), c, costs), word)
        if mixed != word and _plausible(mixed):
            out.add((mixed, "utf8"))
        if LOST not in word and codec not in ("cp1252", "latin-1", "iso8859-15"):
            b = to_bytes(word, codec)
            if b is not None:
                got = bytes(b).decode("cp1252", "replace")
                if LOST not in got and got != word and all(c.isascii() or c in NORMAL for c in got):
                    out.add((got, "bytes"))
    if "??" in word and word.isascii():  # each lost byte was written as a question mark
        out.add((re.sub(r"\?{2,3}", "*", word), "lost"))
    if LOST in word:
        out.add((re.sub(LOST, "*", word), "lost"))
    if len(word) > 2 and word.endswith("Ã"):  # its second byte was a no-break space and got lost
        out.add((word[:-1] + "à", "bytes"))
    return out


_EDGE = r"""^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$"""


#: A word in which question marks stand for lost bytes.
_MARKED = r"((?<![^\x00-\x20(\"'])[A-Za-z0-9'-]*\?{2,3}[A-Za-z0-9'?-]*[A-Za-z0-9?])"
_MARKS = r"[A-Za-z0-9]\?{2,3}|\?{2,3}[A-Za-z0-9]"


def tokens(text: Column) -> Column:
    """The words with a non-ASCII character, or with question marks for one: without ASCII marks around them, digits as 0."""
    found = F.regexp_extract_all(text, F.lit(r"([^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*)"), F.lit(1))
    plain = F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, _EDGE, ""), r"\d", "0"))
    marked = F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1))
    marked = F.filter(F.transform(marked, lambda w: F.regexp_replace(w, r"\d", "0")), lambda w: w.rlike(_MARKS))
    return F.array_distinct(F.when(F.contains(text, F.lit("??")), F.concat(plain, marked)).otherwise(plain))


def _shape(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\*|[^\x00-\x7f]+", "*")


def character_costs(words: DataFrame) -> dict[str, float]:
    """What each non-ASCII character of the corpus costs: the binary logarithm of how many of all it is one of."""
    letters = words.where(~F.col("token").contains(LOST)).select("n", F.explode(F.split(F.regexp_replace("token", r"[\x00-\x7f]+", ""), "")).alias("c")).where("c <> ''")
    rows = bounded_rows(letters.groupBy("c").agg(F.sum("n").alias("n")), CHARACTERS, "characters")
    total = sum(r.n for r in rows)
    return {r.c: math.log2(total / r.n) for r in rows}


def fixes(words: DataFrame) -> DataFrame:
    """token, fixed (null: lost for good) of the garbled ones among ``words`` (token, n: how many records hold it)."""
    costs = words.sparkSession.sparkContext.broadcast(character_costs(words))

    def run(batches):
        for b in batches:
            out = [(t, r, k) for t in b.token for r, k in readings(t, costs.value)]
            yield pd.DataFrame(out, columns=["token", "reading", "kind"])

    cands = words.select("token").mapInPandas(run, "token string, reading string, kind string")
    alone = F.col("token").rlike(r"^[^A-Za-z0]*$")
    known = words.where(~F.col("token").contains(LOST)).groupBy(F.lower("token").alias("_low")).agg(F.sum("n").alias("m"))
    own = words.select("token", "n")
    exact = cands.where("kind <> 'lost'").withColumn("_low", F.lower("reading")).join(known, "_low", "left").join(own, "token")
    much = F.coalesce("m", F.lit(0))
    # a reading of only ASCII characters needs no word: it is what the bytes hold
    strong = (F.col("kind") == "utf8") & (~alone | F.col("reading").rlike(r"[\x{10000}-\x{10ffff}]"))
    letters = F.length(F.regexp_replace("token", "[^A-Za-z]", "")) >= 3
    sure = exact.where(strong | (letters & (much >= 3) & (much >= 4 * F.col("n"))) | ((much >= LEAST) & (much >= RATIO * F.col("n"))))
    best = sure.groupBy("token").agg(F.max_by("reading", F.struct(F.when(F.col("kind") == "utf8", 1).otherwise(0), much, F.col("reading"))).alias("fixed"))
    sound = words.where(~F.col("token").contains(LOST)).join(best.select("token"), "token", "left_anti")  # what is garbled itself restores nothing
    forms = sound.groupBy(F.lower("token").alias("_low")).agg(F.sum("n").alias("m"), F.max_by("token", F.struct("n", "token")).alias("_form")).where(F.length("_low") > 1)
    # one word a shape, combined before the shuffle: many words share one, and only the most frequent can win
    shapes = forms.groupBy(_shape(F.col("_low")).alias("_shape")).agg(F.max(F.struct("m", "_low", "_form")).alias("_b")).select("_shape", "_b.m", "_b._low", "_b._form")
    lost = cands.where("kind = 'lost'").withColumn("_shape", _shape(F.col("reading"))).join(shapes, "_shape", "left")
    lost = lost.where(F.col("token").contains(LOST) | ~F.col("token").contains("??") | (F.col("m") >= 3))
    # a reading that holds a sound non-ASCII character is restored by no word, but stays a case
    fits = F.lower("reading").rlike(r"^[\x00-\x7f]*$") & F.col("reading").rlike("[A-Za-z0-9]")  # a lost character alone tells nothing
    lost = lost.withColumns({c: F.when(fits, F.col(c)) for c in ("_low", "_form", "m")}).groupBy("token").agg(F.max_by(F.struct("_low", "_form"), F.struct(F.coalesce("m", F.lit(0)), F.coalesce("_low", F.lit("")))).alias("_w"), F.coalesce(F.max(F.when(fits, F.col("reading"))), F.max("reading")).alias("reading"))
    lost = lost.withColumn("fixed", F.when(F.col("reading").startswith("*"), F.col("_w._form")).otherwise(_cased(F.col("reading"), F.col("_w._low")))).where(F.col("token").contains(LOST) | F.col("fixed").isNotNull())
    lost = lost.join(best.select("token"), "token", "left_anti").select("token", "fixed")
    return best.unionByName(lost)


def _cased(pattern: Column, word: Column) -> Column:
    """``word`` in the case of ``pattern``."""
    upper = (F.upper(pattern) == pattern) & (F.length(F.regexp_replace(pattern, r"[^A-Z]", "")) > 1)
    first = pattern.rlike(r"^[^A-Za-z]*[A-Z]")
    return F.when(upper, F.upper(word)).when(first, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))).otherwise(word)


def garbled(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record, token, fixed) of the garbled words of ``records`` (tbl, rec, field, body), and all their words."""
    words = records.where(F.col("body").rlike(r"[^\x00-\x7f]") | F.contains("body", F.lit("??"))).select("tbl", "rec", "field", F.explode(tokens(F.col("body"))).alias("token")).where("token <> ''")
    counts = cut(words.groupBy("token").agg(F.count("*").alias("n")))
    bad = cut(fixes(counts))
    return words.join(bad, "token"), bad


def restore(records: DataFrame) -> DataFrame:
    """tbl, rec, field, body, restored, whole (false: something stays lost) of each affected record."""
    found, _ = garbled(records)
    pairs = found.groupBy("tbl", "rec", "field").agg(F.collect_set(F.struct("token", "fixed")).alias("_p"))
    x = records.join(pairs, ["tbl", "rec", "field"])
    # word by word, so that a fix never touches another word; the digits that were masked come back in their order
    known = F.map_from_entries(F.filter("_p", lambda p: p["fixed"].isNotNull()))
    x = x.withColumn("_k", known)

    def back(fixed: Column, word: Column) -> Column:
        digits = F.regexp_extract_all(word, F.lit(r"(\d)"), F.lit(1))
        return F.array_join(F.zip_with(F.split(fixed, "0", -1), digits, lambda a, d: F.concat(F.coalesce(a, F.lit("")), F.coalesce(d, F.lit("")))), "")

    def mend(w: Column) -> Column:
        core, lead = F.regexp_replace(w, _EDGE, ""), F.regexp_extract(w, r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*", 0)
        whole = F.try_element_at("_k", F.regexp_replace(core, r"\d", "0"))
        tail = F.substr(w, F.length(lead) + F.length(core) + 1)
        mark = F.regexp_extract(w, _MARKED, 1)
        part = F.try_element_at("_k", F.regexp_replace(mark, r"\d", "0"))
        at = F.instr(w, mark)
        marked = F.concat(F.substr(w, F.lit(1), at - 1), back(part, mark), F.substr(w, at + F.length(mark)))
        return F.when(whole.isNotNull(), F.concat(lead, back(whole, core), tail)).when(F.contains(w, F.lit("??")) & part.isNotNull(), marked).otherwise(w)

    words = F.transform(F.regexp_extract_all("body", F.lit(r"([^\x00-\x20]+)"), F.lit(1)), lambda w: F.when(w.rlike(r"[^\x00-\x7f]|\?\?"), mend(w)).otherwise(w))
    gaps = F.split("body", r"[^\x00-\x20]+", -1)
    fixed = F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return x.select("tbl", "rec", "field", "body", fixed.alias("restored"), F.forall("_p", lambda p: p["fixed"].isNotNull()).alias("whole"))
