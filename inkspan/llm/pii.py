"""Personal information in free text: offset-preserving deobfuscation, detection, typed placeholders.

A chain of small transducers rewrites a text to a normal form (full-width and look-alike characters, invisible characters, spelled
digits, "(at)" and "(dot)" disguises) and keeps for every character the place it came from. Detectors read the
normal form; their spans are mapped back, so what is reported and replaced are source characters.

Names are a given and a family name together. Family names are learnt from the whole corpus: capitalised words that
follow a listed given name in a fair share of their uses, more often as persons are named than as things are ("Frank Talk is a column",
"Dawn Street Choir"); given names that mostly precede learnt family names are added, since the list is incomplete. Every
limit is a ratio, so one mention is enough and a larger corpus changes no document's result by its size.

Defined results: null and empty texts have no finding and stay as they are; a longer finding wins over one it overlaps, then the earlier
type; a string found twice is reported once a document but replaced everywhere; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.tables import bounded_rows, cut, small_side

TYPES = ("email", "phone", "id_number", "address", "name")
#: Most listed given names, and most names of each kind held in memory (more are joined); of so many capitalised uses of a family name, one at least follows a given name.
NAMES, NAME_LIKE = 200_000, 5

# Look-alikes of Latin letters, and digits as words.
_ALIKE = dict(zip("аеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХ", "aeopcyxijsdhqwABEZHIKMNOPTYXABEKMHOPCTYX"))
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?:[ ,-]+(?:{_DIGIT})){{6,}}(?!\w)")
_SPELLED_ONE = re.compile(rf"(?i){_DIGIT}")
_INVISIBLE = set("\u00ad\u200b\u200c\u200d\u2060\ufeff")

_SPECIAL = re.compile("[" + "".join(_ALIKE) + "".join(_INVISIBLE) + "\u00a0\u202f\u2000-\u200a\uff01-\uff5e\u2010-\u2013\u2212]")

_TLD = r"(?:example|test|invalid|localhost|com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us|ch|at|be|it|nl)"
_AT = r"\s?(?:[(\[{<]\s?(?:at|@|arobase|arroba|ät|a)\s?[)\]}>])\s?"
_DOT = r"\s?(?:[(\[{<]\s?(?:dot|punkt|point|punto|\.)\s?[)\]}>])\s?"
_DISGUISED = re.compile(rf"(?i)(?<![\w.+-])[\w.+-]{{1,64}}{_AT}[\w-]+(?:(?:{_DOT}|\.)[\w-]+)+|(?<![\w.+-])[\w.+-]{{1,64}} (?-i:AT|aROBASE|AROBASE|ARROBA) [\w-]+(?:(?: (?-i:DOT|PUNKT|POINT|PUNTO) |\.)[\w-]+)+|(?<![\w.+-])[\w.+-]{{1,64}} (?:at|arobase|arroba) [\w-]+(?: (?:dot|punkt|point|punto) [\w-]+)* (?:dot|punkt|point|punto) {_TLD}(?!\w)|(?<![\w.+-])[\w.+-]{{1,64}} ?@ ?[\w-]+(?: ?\. ?[\w-]+)*? ?\. ?{_TLD}(?!\w)")
#: Without any of these no address is in disguise; they are looked for first, since the pattern above is slow.
_HINT = re.compile(r"[(\[{<]\s?(?:[Aa][Tt]|[Aa]|[Ää][Tt]|[Aa]robase|[Aa]rroba|AROBASE|ARROBA)\s?[)\]}>]| (?:AT|AROBASE|ARROBA|[Dd]ot|DOT|[Pp]unkt|[Pp]unto|[Pp]oint) ")
_PART = re.compile(rf"(?i)(?P<at>{_AT}| (?:at|arobase|arroba) | ?@ ?)|(?P<dot>{_DOT}| (?:dot|punkt|point|punto) | ?\. ?)")

_EMAIL = re.compile(r"(?i)(?<![\w.+%-])[a-z0-9À-ÿ_](?:[\w.+%-]{0,62}[\wÀ-ÿ+-])?@(?:[a-z0-9À-ÿ](?:[\w-]*[a-z0-9À-ÿ])?\.)+[a-z]{2,18}(?![\w@])")
_L, _R = r"(?<![\w#@/+])(?<!\d[.,-])(?<![A-Z]-)", r"(?![\w@]|[-./,]\d|-[A-Z])"
_PHONES = [
    r"(?:\+|00)1[ .-]?\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]?\d{4}", r"1[.-][2-9]\d\d[.-]\d{3}[.-]\d{4}", r"\([2-9]\d\d\) ?\d{3}[ .-]\d{4}", r"[2-9]\d\d([.-])\d{3}\1\d{4}", r"[2-9]\d\d \d{3} \d{4}", r"[2-9]\d\d\d{3}\d{4}",
    r"(?:\+|00)44 ?(?:\(0\) ?)?\d{2,5}(?:[ -]?\d{2,4}){1,3}", r"0\d{2,4} \d{3,4} \d{3,4}", r"07\d{3} ?\d{6}", r"\(0\d{2,4}\) ?\d{3,4} ?\d{3,4}",
    r"(?:\+|00)33 ?(?:\(0\) ?)?[1-9](?:[ .-]?\d\d){4}", r"0[1-9]([ .-])\d\d(?:\2\d\d){3}", r"0[1-79]\d{8}",
    r"(?:\+|00)49 ?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,8}(?:[ -]\d{1,5})?", r"0\d{2,5}[ /-]\d{4,8}(?:[ -]\d{1,5})?", r"01[567]\d{8,9}", r"030\d{7,8}",
    r"(?:\+|00)34 ?[6-9]\d\d([ .-]?)\d{3}\3\d{3}", r"[6-9]\d\d([ .-])\d{3}\4\d{3}", r"[6-9]\d{8}",
]


def _numbered(patterns: list[str]) -> re.Pattern:
    """One alternation; back references are renumbered to their own group."""
    out, groups = [], 0
    for p in patterns:
        n = len(re.findall(r"(?<!\\)\((?!\?)", p))
        out.append(re.sub(r"\\[1-9]", lambda _, g=groups: f"\\{g + 1}", p) if n else p)
        groups += n
    return re.compile(_L + "(?:" + "|".join(out) + ")" + _R)


_PHONE = _numbered(_PHONES)
_IDS = [
    r"\d{3}-\d\d-\d{4}", r"\d{3} \d\d \d{4}", r"9\d{8}", r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]", r"[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d", r"\d\d ?\d{3} ?\d{3} ?\d{3}", r"[A-Z]\d[A-Z]\d{5,6}", r"[0-9]{8}[ -]?[A-Z]", r"\d\d\.\d{3}\.\d{3}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]",
    r"\d{2}[A-Z]{2}\d{5}",
]
_ID = re.compile(_L + "(?:" + "|".join(_IDS) + ")" + _R)
_PHONE_CUE = re.compile(r"(?i)(tel|phone|fax|call|ruf|appel|llam|móvil|mobile|handy|line|nummer ist|numéro est|número es|number is|text me|reach|ring|☎|(?-i:\bT\b)|\bm:)[^.\n]{0,24}$")
_ID_CUE = re.compile(r"(?i)(\bid|ssn|social|insurance|tax|steuer|ausweis|passe?port|pasaporte|dni|nif|nie|identi\w+|sécurité|documento|carnet|licen[cs]e)\b[^\n]{0,24}$")
_ID_AFTER = re.compile(r"(?i)^,? ?(?:(?:has|had|is|was|ist|war|est|a|était|ha|está|fue) )?(?:expired?|expires|issued|revoked|abgelaufen|ausgestellt|gültig|périmée?|expirée?|délivrée?|caduc\w+|vencid\w+|expedid\w+)")
#: Words of Spanish, whose country writes its phone numbers with nine digits, and of the other languages.
_OTHERS = re.compile(r"(?i)(?<!\w)(?:the|and|of|to|is|was|it|der|die|das|und|ist|nicht|le|les|et|est|une|dans|pour)(?!\w)")
_SPANISH = re.compile(r"(?i)(?<!\w)(?:el|los|las|que|una|por|con|para|del|como|pero|muy|está)(?!\w)")
_PHONE_11 = re.compile(r"07\d{9}|01[567]\d{8}|030\d{8}|020\d{8}")

_CAP = r"[A-ZÀ-ÖØ-Þ][\wà-öø-ÿ’'-]*"
_EN = r"(?:Street|Road|Lane|Avenue|Drive|Crescent|Hill|Row|Close|Court|Place|Square|Terrace|Way|Walk|Gardens|Grove|Mews|Parade|Boulevard|Alley|Quay|Yard|Rise|Green|View|Bank|Hollow|St\.|Rd\.?|Ave\.?|Ln\.?|Dr\.|Blvd\.?)"
# What bears a street's name and is no address.
_THINGS = r"(?:Festival|Choir|Press|Books|School|Academy|Club|Band|Gallery|Theatre|Cinema|Hotel|Inn|Café|Bakery|Library|Museum|Society|Association|Group|Project|Station|Church|Records|Review|Quartet|Orchestra|Company|Hospital|Surgery|Stadium)"
_ADDRESS = re.compile(
    rf"(?<![\w#/.,-])\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,3}}{_EN}(?![\w-])(?! {_THINGS}(?!\w))"
    rf"|(?<![\w#/.,-])\d{{1,5}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:[Rr]ue|[Aa]venue|[Cc]hemin|[Ii]mpasse|[Pp]lace|[Bb]oulevard|[Qq]uai|[Aa]llée|[Rr]oute|[Pp]assage|[Cc]ours|[Ss]quare)(?: (?:de la |de l['’]|du |des |de |d['’]|la |le |les )?{_CAP})(?:(?! (?:Tél|Tel|Mail|Courriel|Fax|Adresse)) {_CAP}(?=[.,;:!?\n)]|$))?"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Callejón|Carrera|Glorieta|C/|Avda\.?)(?: (?:de la|de las|de los|del|de))?(?: {_CAP}){{1,3}},? (?:n\.?º ?)?\d{{1,5}}(?: ?(?:bis|[A-D]))?(?![\w/.-]\d|\w)"
    rf"|(?<!\w){_CAP}(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm|ring|steig|pfad|markt|chaussee|hof|graben|stieg) \d{{1,5}} ?[a-dA-D]?(?![\w/.-]\d|\w)"
    rf"|(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Zum|Zur|Im|In der|Unter den|Alte|Alter|Neue|Neuer|Lange|Kleine|Große|Obere|Untere) (?:{_CAP}[ -]){{0,2}}{_CAP} \d{{1,5}} ?[a-dA-D]?(?![\w/.-]\d|\w)"
)
_PARTICLE = r"(?:Van der|Von der|Van|Von|De la|De|de la|de los|de las|de|del|von der|von|van der|van|zu|di|da|du|la|le)"
_GIVEN = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_FAMILY = rf"(?:{_PARTICLE} )?(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_NAME = re.compile(rf"(?=(?<![\w’'-])({_GIVEN}) (?:[A-ZÀ-ÖØ-Þ]\. )?({_FAMILY})(?![\w-]))")
_SHOUT = re.compile(r"(?=(?<![\w’'-])([A-ZÀ-ÖØ-Þ]{2,}(?:-[A-ZÀ-ÖØ-Þ]+)?) (?:[A-ZÀ-ÖØ-Þ]\. )?((?:(?:DE LA|DE|VON DER|VAN DER|VON|VAN|DEL) )?(?:O['’])?[A-ZÀ-ÖØ-Þ]{2,}(?:-[A-ZÀ-ÖØ-Þ]+)?)(?![\w-]))")
# Titles, which are no given names.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "frau", "herr", "mme", "m", "mlle", "madame", "monsieur", "señor", "señora", "sr", "sra", "don", "doña", "dear", "hi", "hello", "liebe", "lieber", "chère", "cher", "querida", "querido", "contact", "photo", "merci", "danke", "thanks", "gracias"}


def _emit(text: str, at: list[int], spans: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """text with each span rewritten; a rewritten character comes from the first place of its span."""
    out, where, i = [], [], 0
    for a, b, new in spans:
        out.append(text[i:a])
        where += at[i:a]
        out.append(new)
        where += [at[a]] * len(new)
        i = b
    out.append(text[i:])
    where += at[i:]
    return "".join(out), where


def normalise(text: str) -> tuple[str, list[int]]:
    """The normal form and the source offset of each of its characters, with the source length at the end."""
    if text.isascii() or not _SPECIAL.search(text):
        s, at = text, list(range(len(text) + 1))
    else:
        chars, at = [], []
        for i, c in enumerate(text):
            if c in _INVISIBLE:
                continue
            if c in "\u00a0\u202f" or "\u2000" <= c <= "\u200a":
                c = " "
            elif c in _ALIKE:
                c = _ALIKE[c]
            elif "！" <= c <= "～":
                c = unicodedata.normalize("NFKC", c)
            elif c in "‐‑‒–−":
                c = "-"
            chars.append(c)
            at.append(i)
        s = "".join(chars)
        at.append(len(text))
    few = sum(w in _SPELLED for w in re.split(r"[\s,-]+", s.lower())) < 7
    spans = [] if few else [(m.start() + k.start(), m.start() + k.end(), str(_SPELLED[k.group().lower()])) for m in _SPELLED_RUN.finditer(s) for k in _SPELLED_ONE.finditer(m.group())]
    if spans:  # drop what stands between spelled digits, too
        joined: list[tuple[int, int, str]] = []
        for a, b, d in spans:
            if joined and a - joined[-1][1] <= 2:
                a = joined[-1][1]
            joined.append((a, b, d))
        s, at = _emit(s, at, joined)
    if "@" in s or _HINT.search(s):
        spans = []
        for m in _DISGUISED.finditer(s):
            for k in _PART.finditer(m.group()):
                new = "@" if k.group("at") else "."
                if k.group() != new:
                    spans.append((m.start() + k.start(), m.start() + k.end(), new))
        if spans:
            s, at = _emit(s, at, spans)
    return s, at


Named = Callable[[str, str], bool]


def name_pairs(s: str) -> list[tuple[int, int, str, str]]:
    """(start, end, given, family) of all places of a normal form where a name may stand."""
    out = [(m.start(1), m.end(2), m.group(1), m.group(2).replace("’", "'")) for m in _NAME.finditer(s)]
    if re.search(r"[A-ZÀ-Þ]{3}", s):
        out += [(m.start(1), m.end(2), _title(m.group(1)), _title(m.group(2)).replace("’", "'")) for m in _SHOUT.finditer(s)]
    return out


def find(text: str, named: Named) -> list[tuple[int, int, str]]:
    """(start, end, type) in source offsets, in order, without overlaps. named: whether a given and a family name are a person's."""
    s, at = normalise(text)
    got: list[tuple[int, int, str]] = []
    for m in _EMAIL.finditer(s):
        got.append((m.start(), m.end(), "email"))
    if re.search(r"\d", s):
        for m in _PHONE.finditer(s):
            got.append((m.start(), m.end(), _number_type(s, m.start(), m.end(), "phone")))
        for m in _ID.finditer(s):
            got.append((m.start(), m.end(), _number_type(s, m.start(), m.end(), "id_number")))
        for m in _ADDRESS.finditer(s):
            end = m.end()
            got.append((m.start(), end, "address"))
    got += [(a, b, "name") for a, b, g, f in name_pairs(s) if named(g, f)]
    got.sort(key=lambda x: (x[0] - x[1], x[0], TYPES.index(x[2])))
    taken, out = [], []
    for a, b, kind in got:
        if all(b <= c or a >= d for c, d in taken):
            taken.append((a, b))
            out.append((at[a], at[b - 1] + 1 if at[b] - at[b - 1] >= 1 and s[b - 1 : b] == text[at[b - 1] : at[b - 1] + 1] else at[b], kind))
    return sorted(out)


def _title(s: str) -> str:
    return re.sub(r"\b(De La|De|Del)\b|(?<=Van )Der|(?<=Von )Der", lambda m: m.group().lower(), re.sub(r"[^\W\d_]+", lambda m: m.group().capitalize(), s))


def _number_type(s: str, a: int, b: int, kind: str) -> str:
    """phone or id_number for a string of digits that could be either: by its shape, then by the words around it."""
    n = s[a:b]
    digits = re.sub(r"\D", "", n)
    if re.search(r"[A-Z]", n) or re.fullmatch(r"\d{3}([ -])\d\d\1\d{4}|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d", n):
        return "id_number"
    if n[0] in "+(" or n.startswith("00") and len(digits) > 11:
        return "phone"
    plain = len(digits) in (9, 11) and re.fullmatch(r"\d{9}|\d{11}|\d\d \d{3} \d{3} \d{3}", n)
    if not plain:
        return kind
    before, after = s[max(0, a - 48) : a], s[b : b + 24]
    if _ID_AFTER.match(after) or (_ID_CUE.search(before) and not _PHONE_CUE.search(before[-14:])):
        return "id_number"
    if _PHONE_CUE.search(before):
        return "phone"
    if len(digits) == 11:
        return "phone" if _PHONE_11.fullmatch(digits) and " " not in n else "id_number"
    if digits[0] in "678":
        return "phone"
    around = s[max(0, a - 300) : b + 100]
    return "phone" if digits[0] == "9" and len(_SPANISH.findall(around)) > len(_OTHERS.findall(around)) else "id_number"


#: What stands before a name and not before a sentence's first words: a word in lower case, a comma, a label, a title with a point.
_INSIDE = re.compile(r"(?:[a-zß-öø-ÿ]|[,;:]|\b(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra)\.)\s?$")
_ARTICLE = re.compile(r"(?i)(?<!\w)(?:the|an?|der|die|das|den|dem|ein|eine|la|le|les|une?|el|los|las|una)\s$")
#: What follows a title or a thing: a further capitalised word, or what it is.
_THING = re.compile(r" [A-ZÀ-ÖØ-Þ]| (?:is|was|ist|war|est|était|es|era) (?:an?|the|eine?|der|die|das|une?|le|la|el|una?)\b")
_INITIAL = re.compile(r" [A-ZÀ-ÖØ-Þ]\. ")
_TRIM = re.compile(r"^[^\w]+|(?:['’]s)?[^\w]+$|['’]s$")


def _evidence(text: str, listed: frozenset[str]) -> tuple[set[tuple[str, str, int]], set[tuple[str, int]]]:
    """(given, family, 1: inside a sentence, 0: elsewhere, -1: as a thing is named) of the pairs of a text, and (word, 1: capitalised, 0: lower case) of its words outside names."""
    text = text.replace("\u00a0", " ").replace("\u202f", " ").replace("’", "'")
    pairs = set()
    for m in _NAME.finditer(text):
        a, e = m.start(1), m.end(2)
        before, after = text[max(0, a - 12) : a], text[e : e + 24]
        the = _ARTICLE.search(before) is not None
        inside = _INITIAL.search(text[a:e]) is not None or (_INSIDE.search(before) is not None and not the)
        pairs.add((m.group(1), m.group(2), 1 if inside else -1 if the or _THING.match(after) else 0))
    words, raw = set(), text.split()
    bare = [w if w.isalpha() else "" if "@" in w else _TRIM.sub("", w) for w in raw]
    for k, w in enumerate(bare):
        if not w or (k and bare[k - 1].lower() in TITLES) or (raw[k][-1] == "," and k + 1 < len(bare) and bare[k + 1] in listed):
            continue  # "Mrs Harrowgill" and "Harrowgill, Rafe" are uses of a name
        words.add((w, 1) if w[0].isupper() else (w[:1].upper() + w[1:], 0))
    return pairs, words


def learn_names(docs: DataFrame, given_names: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Given (g) and family names (f): the listed ones, and those that the whole corpus shows beside each other.

    All evidence is a ratio of documents, so it does not depend on how many there are.
    """
    listed = [r[0] for r in bounded_rows(given_names.where("given_name is not null").select("given_name").distinct(), NAMES, "given names")]
    some = frozenset(listed)

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.t:
                pairs, words = _evidence(t, some)
                n.update((g, f, at) for g, f, at in pairs)
                n.update((w, None, up) for w, up in words)
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["a", "f", "at", "n"])

    seen = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "a string, f string, at int, n long")
    seen = cut(seen.groupBy("a", "f", "at").agg(F.sum("n").alias("n")))
    both = seen.where("f is not null").groupBy(F.col("a").alias("g"), "f").agg(*[F.sum(F.when(F.col("at") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "inside"), (0, "open"), (-1, "thing"))])
    both = cut(both.withColumn("last", F.regexp_extract("f", r"([^ ]+)$", 1)))
    uses = seen.where("f is null").groupBy(F.col("a").alias("w")).agg(*[F.sum(F.when(F.col("at") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "cap"), (0, "low"))])
    near = both.select(F.explode(F.array("g", "last")).alias("w")).distinct()
    uses = cut(uses.join(near, "w", "left_semi"))
    first = known = docs.sparkSession.createDataFrame([(g,) for g in listed] or [("",)], "g string")
    for _ in range(2):
        shown = both.join(small_side(known), "g", "left_semi").groupBy("f", "last").agg(F.sum("inside").alias("inside"), F.sum(F.col("inside") + F.col("open")).alias("like"), F.sum("thing").alias("thing"))
        shown = shown.join(uses.withColumnRenamed("w", "last"), "last", "left").na.fill(0, ["cap", "low"])
        plain = (F.col("low") <= F.col("like")) | (2 * F.col("inside") >= F.col("like"))  # an ordinary word needs a place inside a sentence
        families = shown.where((F.col("like") > F.col("thing")) & (NAME_LIKE * F.col("like") >= F.col("cap")) & plain & ~F.lower("f").isin(*TITLES)).select("f")
        before = both.join(families, "f", "left_semi").groupBy("g").agg(F.sum(F.col("inside") + F.col("open")).alias("like"))
        before = before.join(uses.withColumnRenamed("w", "g"), "g", "left").na.fill(0, ["cap", "low"])
        more = before.where((2 * F.col("like") >= F.col("cap")) & (F.col("low") <= F.col("like")) & (F.col("like") > 0) & ~F.lower("g").isin(*TITLES)).select("g")
        known = cut(more.unionByName(first).distinct())
    return known, cut(families.distinct())


def _judged(docs: DataFrame, names: tuple[DataFrame, DataFrame], run: Callable, schema: str) -> DataFrame:
    """``run(batch, judges)`` over docs, with a judge of names for each row. Names are held in memory while they are few and joined to each document's pairs beyond."""
    known, families = names
    if all(x.limit(NAMES + 1).count() <= NAMES for x in names):
        shared = docs.sparkSession.sparkContext.broadcast((frozenset(r.g for r in known.collect()), frozenset(r.f for r in families.collect())))

        def few(batches):
            g, f = shared.value
            for b in batches:
                yield run(b, [lambda x, y: x in g and y in f] * len(b))

        return docs.select("doc_id", "text").mapInPandas(few, schema)

    def pairs(batches):
        for b in batches:
            out = {(i, g, f) for i, t in zip(b["_row"], b["text"]) if isinstance(t, str) for _, _, g, f in name_pairs(normalise(t)[0])}
            yield pd.DataFrame(list(out), columns=["_row", "g", "f"])

    def many(batches):
        for b in batches:
            sets = [frozenset(map(tuple, p)) if p is not None else frozenset() for p in b["_pairs"]]
            yield run(b, [lambda x, y, s=s: (x, y) in s for s in sets])

    rows = cut(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
    met = rows.select("_row", "text").mapInPandas(pairs, "_row long, g string, f string").join(known, "g", "left_semi").join(families, "f", "left_semi")
    met = met.groupBy("_row").agg(F.collect_list(F.array("g", "f")).alias("_pairs"))
    return rows.join(met, "_row", "left").select("doc_id", "text", "_pairs").mapInPandas(many, schema)


def findings(docs: DataFrame, names: tuple[DataFrame, DataFrame]) -> DataFrame:
    """doc_id, pii_type, found: each exact string once a document."""

    def run(b: pd.DataFrame, judges: list[Named]) -> pd.DataFrame:
        out = [(d, k, f) for d, t, named in zip(b["doc_id"], b["text"], judges) if isinstance(t, str) for k, f in sorted({(k, t[a:e]) for a, e, k in find(t, named)})]
        return pd.DataFrame(out, columns=["doc_id", "pii_type", "found"])

    return _judged(docs, names, run, "doc_id long, pii_type string, found string")


def redacted(docs: DataFrame, names: tuple[DataFrame, DataFrame]) -> DataFrame:
    """doc_id, text, n_replaced: each finding replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]."""

    def run(b: pd.DataFrame, judges: list[Named]) -> pd.DataFrame:
        texts, counts = [], []
        for t, named in zip(b["text"], judges):
            spans = find(t, named) if isinstance(t, str) else []
            out, at = [], 0
            for a, e, k in spans:
                out += [t[at:a], f"[{k.upper()}]"]
                at = e
            texts.append("".join([*out, t[at:]]) if isinstance(t, str) else None)
            counts.append(len(spans))
        return pd.DataFrame({"doc_id": b["doc_id"], "text": pd.Series(texts, dtype=object, index=b.index), "n_replaced": pd.Series(counts, dtype="int32", index=b.index)})

    return _judged(docs, names, run, "doc_id long, text string, n_replaced int")
