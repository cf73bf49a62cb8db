"""Mixed timestamp formats and zones: every valid reading of a value, then the best chain of readings.

Each value becomes an array of all its interpretations (native expressions, no Python). What the row's source says about its
order of day and month is a cost on the readings that contradict it. Every row's reading is chosen by a Viterbi pass over the
source's record order that also penalises a change of format, a step back in time and a change of the order of day and month since
the last date in numbers, however long ago that was. The pass is exact and runs in blocks of
the record order: each block gives the cheapest cost between its first and last readings and the path for each, those small matrices
are chained per source, and each block's path is then known. No task ever holds a whole source, and rows cross one shuffle.

Defined results: null, empty and unreadable values have no interpretation; a local time without any known
zone has none; one that the zone skips or has twice has none; ties go to the earlier interpretation; a row without a place in
the order takes its cheapest reading; repeated rows are each read; a place should hold few rows.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.tables import cut, small_side

# Month names of the four languages.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
# Minutes east of UTC of zone abbreviations; the second list holds their less usual meanings.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "HST": -600,
}
OTHER_MEANINGS = {"CST": 480, "IST": 60, "BST": 360, "AST": 180}

_T = r"(\d\d):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|[+-]\d\d(?::?\d\d)?|\[?[A-Z][A-Za-z]*(?:/[A-Za-z_]+)+\]?|\[?[A-Z]{2,5}\]?))?"
_W = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)"
_L = r"([^\W\d_]+)"
#: (kind, pattern, replacement to year|month|day|hour|minute|second|fraction|half|zone). A numeric day and month are p|q.
FORMS = [
    ("iso", rf"^(\d{{4}})-(\d\d)-(\d\d)(?:[T ]{_T}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("num", r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d\d)(?:,?\s+(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*(Z|[+-]\d\d:?\d\d|[A-Z]{3,5}))?)?$", "$4|$3|$1|$5|$6|$7|$8|$9|$10"),
    ("rfc", rf"^{_W}?(\d{{1,2}})\s+{_L}\.?\s+(\d{{4}})\s+{_T}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("comma", rf"^(\d{{1,2}}),\s*{_L},\s*(\d{{4}})$", "$3|$2|$1||||||"),
    ("us", rf"^{_W}?{_L}\.?\s+(\d{{1,2}}),\s+(\d{{4}})(?:,?\s+(?:at\s+)?(\d{{1,2}}):(\d\d)(?::(\d\d))?(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$", "$3|$1|$2|$4|$5|$6||$7|$8"),
    ("ctime", rf"^{_W}{_L}\s+(\d{{1,2}})\s+{_T}(?:\s+([A-Z]{{2,5}}|[+-]\d\d:?\d\d))?\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    ("compact", r"^(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)?(Z|[+-]\d{4})?)?$", "$1|$2|$3|$4|$5|$6|||$7"),
    ("ymd", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:\s+{_T}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("long", rf"^(\d{{1,2}})(?:\.|er)?\s+(?:de\s+)?{_L}\.?\s+(?:de\s+)?(\d{{4}})(?:,?\s+(?:à\s+|um\s+|a\s+las\s+)?(\d{{1,2}})[:h](\d\d)(?::(\d\d))?(?:\s+Uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|||$7"),
    ("month", rf"^{_L}\.?\s+(?:de\s+)?(\d{{4}})$", "$2|$1|||||||"),
    ("ym", r"^(\d{4})[-/](\d\d)$", "$1|$2|||||||"),
    ("year", r"^(\d{4})$", "$1||||||||"),
]

INTERPRETATION = "struct<fmt:string,normal:string,micros:bigint,cost:double>"
SWITCH_COST, BACK_COST, ORDER_COST = 1.0, 2.0, 3.0
#: Cost of a reading that contradicts what its source says: more than any step of the chain can save.
AGAINST = 100.0
#: Width of a block of the record order.
BLOCK = 65_536


def _lookup(d: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in d.items()) + ")")


def _int(c: Column) -> Column:
    return F.expr("cast(null as int)") if c is None else F.nullif(c, F.lit("")).try_cast("int")


def interpretations(df: DataFrame, value: str, tz: str, day_first: str, out: str = "reading") -> DataFrame:
    """One row an interpretation of ``value`` with it in ``out`` (null: it has none), the array of all of them unfolded; tz and day_first may be null per row."""
    s = F.trim(F.col(value))
    kind, flat = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, to in reversed(FORMS):
        hit = s.rlike("(?U)" + pattern if name in ("rfc", "comma", "us", "ctime", "long", "month") else pattern)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        flat = F.when(hit, F.regexp_replace(s, ("(?U)" if name in ("rfc", "comma", "us", "ctime", "long", "month") else "") + pattern, to)).otherwise(flat)
    names = [n for n in df.columns]
    x = df.withColumn("_s", s)
    x = x.withColumn("_k", kind).withColumn("_p", F.split(flat, r"\|"))
    p = lambda i: F.get("_p", F.lit(i))
    month_name = F.lower(p(1))
    year = F.when(F.length(p(0)) == 2, F.lit(2000) + _int(p(0))).otherwise(_int(p(0)))
    hour = _int(p(3))
    half = F.lower(p(7))
    hour = F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(hour)
    zone = F.regexp_replace(p(8), r"[\[\]]", "")
    x = x.withColumns({
        "_y": year, "_m": F.coalesce(_int(p(1)), F.try_element_at(_lookup(MONTHS), month_name)), "_d": _int(p(2)),
        "_timed": (p(3) != "") & p(3).isNotNull(), "_h": hour, "_mi": _int(p(4)),
        "_sec": F.concat(F.when(p(5) == "", "0").otherwise(p(5)), F.lit("."), F.rpad(F.substring(p(6), 1, 6), 6, "0")).try_cast("decimal(16,6)"),
        "_zone": F.nullif(zone, F.lit("")),
    })
    off = F.when(F.col("_zone").rlike(r"^[+-]"), F.concat(F.substring("_zone", 1, 1), F.lit("1")).cast("int") * (F.substring("_zone", 2, 2).cast("int") * 60 + F.coalesce(F.nullif(F.regexp_replace(F.substring("_zone", 4, 3), ":", ""), F.lit("")).cast("int"), F.lit(0))))
    off = off.otherwise(F.try_element_at(_lookup(ABBREVIATIONS), F.col("_zone")))
    named = F.when(F.expr("_zone in (" + ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()) if "/" in z) + ")"), F.col("_zone"))
    x = x.withColumn("_off", F.when(F.abs(off) <= 18 * 60, off)).withColumn("_tz", F.when(F.col("_zone").isNotNull(), named).otherwise(F.col(tz)))
    x = x.withColumn("_iso", F.when(F.col("_s").rlike(r"^\d{4}-W\d\d-\d$"), _iso_week(F.col("_s"))).when(F.col("_s").rlike(r"^\d{4}-\d{3}$"), _ordinal(F.col("_s"))))
    x = x.withColumn("_epoch", F.when(F.col("_s").rlike(r"^\d{10}(\d{3}|\d{6})?(\.\d{1,6})?$"), _epoch(F.col("_s"))))
    known, numeric = F.col(day_first), (F.col("_k") == "num") & (F.col("_m") != F.col("_d"))
    no_int = F.lit(None).cast("int")
    one = lambda fmt, m, d, off, cost: F.struct(fmt.alias("fmt"), m.alias("m"), d.alias("d"), off.cast("int").alias("off"), cost.cast("double").alias("cost"))
    m, d, zero = F.col("_m"), F.col("_d"), F.lit(0.0)
    # day and month as numbers may come in either order, and an abbreviation may mean another zone
    name = F.when((F.col("_k") == "num") & (m == d), "num_same").otherwise(F.col("_k"))
    first = F.when(F.col("_k").isNotNull(), one(name, m, d, F.col("_off"), F.when(numeric & ~known, AGAINST).otherwise(zero)))
    first = first.when(F.col("_iso").isNotNull(), one(F.lit("iso_day"), no_int, no_int, no_int, zero)).when(F.col("_epoch").isNotNull(), one(F.lit("epoch"), no_int, no_int, no_int, zero))
    swapped = F.when(numeric, one(F.lit("num_mdy"), d, m, F.col("_off"), F.when(known, AGAINST).otherwise(zero)))
    other = F.when(F.col("_zone").isin(*OTHER_MEANINGS), one(F.concat("_k", F.lit("_alt")), m, d, F.try_element_at(_lookup(OTHER_MEANINGS), F.col("_zone")), F.when(F.col(tz).isNotNull() | (numeric & ~known), AGAINST).otherwise(4.0)))
    x = x.withColumn("_c", F.explode_outer(F.array_compact(F.array(first, swapped, other))))
    return _read(x, out).select(*names, out)


def _struct(fmt, normal, micros, cost) -> Column:
    return F.struct(fmt.alias("fmt"), normal.alias("normal"), micros.cast("long").alias("micros"), cost.alias("cost"))


def _epoch(s: Column) -> Column:
    whole, fraction = F.regexp_extract(s, r"^(\d+)", 1), F.regexp_extract(s, r"\.(\d+)$", 1)
    unit = F.when(F.length(whole) == 10, F.lit(1_000_000)).when(F.length(whole) == 13, F.lit(1000)).otherwise(F.lit(1))
    part = F.when(fraction == "", F.lit(0)).otherwise(F.concat(F.lit("0."), fraction).try_cast("decimal(16,6)") * unit)
    return whole.try_cast("long") * unit + part.cast("long")


def _iso_week(s: Column) -> Column:
    year, week, day = F.substring(s, 1, 4).cast("int"), F.substring(s, 7, 2).cast("int"), F.substring(s, 10, 1).cast("int")
    fourth = F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(4))
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    return F.when(week.between(1, 53) & day.between(1, 7) & (year >= 1) & (F.weekofyear(date) == week), date)


def _ordinal(s: Column) -> Column:
    year, day = F.substring(s, 1, 4).cast("int"), F.substring(s, 6, 3).cast("int")
    date = F.date_add(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1)), day - 1)
    return F.when((day >= 1) & (year >= 1) & (F.year(date) == year), date)


_DAY = 86_400_000_000


def _utc_text(micros: Column) -> Column:
    day, rest = F.floor(micros / F.lit(_DAY).cast("decimal(20,0)")).cast("int"), F.pmod(micros, F.lit(_DAY))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    div = lambda c, n: F.expr("0") if c is None else F.floor(c / n).cast("int")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(div(rest, 3_600_000_000)), F.lit(":"), two(div(rest, 60_000_000) % 60), F.lit(":"),
        two(div(rest, 1_000_000) % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def _read(x: DataFrame, out: str) -> DataFrame:
    """The interpretation of candidate ``_c``: each step a column of its own, so that no step is written out twice."""
    y, c = F.col("_y"), F.col("_c")
    no_month, no_day = F.get("_p", F.lit(1)) == "", F.get("_p", F.lit(2)) == ""
    x = x.withColumn("_first", F.make_date(F.when(y.between(1, 9999), y), F.when(no_month, 1).when(c["m"].between(1, 12), c["m"]), F.lit(1)))
    x = x.withColumn("_dd", F.when(no_day | no_month, 1).otherwise(c["d"]))
    x = x.withColumn("_date", F.when(F.col("_dd").between(1, F.dayofmonth(F.last_day("_first"))), F.date_add("_first", F.col("_dd") - 1)))
    sane = (F.col("_h") <= 23) & (F.col("_mi") <= 59) & (F.col("_sec") < 60)
    x = x.withColumn("_at", F.when(F.col("_timed") & sane, F.unix_date("_date").cast("long") * _DAY + (F.col("_h") * 60 + F.col("_mi")).cast("long") * 60_000_000 + (F.col("_sec") * 1_000_000).cast("long")))
    zoned = c["off"].isNull() & F.col("_tz").isNotNull() & F.col("_at").isNotNull()
    offset = lambda at: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), F.col("_tz"))) - at
    # the offsets in force a day before and after: where they are one, so is the instant
    x = x.withColumn("_o1", F.when(zoned, offset(F.col("_at") - _DAY))).withColumn("_o2", F.when(zoned, offset(F.col("_at") + _DAY)))
    x = x.withColumn("_v1", F.when(F.col("_o1") != F.col("_o2"), offset(F.col("_at") - F.col("_o1")) == F.col("_o1")))
    x = x.withColumn("_v2", F.when(F.col("_o1") != F.col("_o2"), offset(F.col("_at") - F.col("_o2")) == F.col("_o2")))
    u = F.when(c["off"].isNotNull(), F.col("_at") - c["off"].cast("long") * 60_000_000).when(F.col("_o1") == F.col("_o2"), F.col("_at") - F.col("_o1"))
    u = u.when(F.col("_v1") & ~F.col("_v2"), F.col("_at") - F.col("_o1")).when(F.col("_v2") & ~F.col("_v1"), F.col("_at") - F.col("_o2"))
    fmt = c["fmt"]
    x = x.withColumn("_u", F.when(fmt == "epoch", F.col("_epoch")).when(fmt != "iso_day", F.when(F.col("_timed"), u)))
    x = x.withColumn("_on", F.when(fmt == "iso_day", F.col("_iso")).when(fmt != "epoch", F.when(~F.col("_timed"), F.col("_date"))))
    text = F.col("_on").cast("string")
    text = F.when(F.col("_u").isNotNull(), _utc_text(F.col("_u"))).when(fmt == "iso_day", text).when(no_month, F.substring(text, 1, 4)).when(no_day, F.substring(text, 1, 7)).otherwise(text)
    reading = F.when(F.col("_u").isNotNull() | F.col("_on").isNotNull(), _struct(fmt, text, F.coalesce("_u", F.unix_date("_on").cast("long") * _DAY), c["cost"]))
    return x.withColumn(out, reading)


# --- choosing one reading a record ------------------------------------------------------------------------


def _edge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cost of going from each node in a to each in b; a node: format, time, order of day and month."""
    return SWITCH_COST * (a[:, None, 0] != b[None, :, 0]) + BACK_COST * (b[None, :, 1] < a[:, None, 1]) + ORDER_COST * (a[:, None, 2] != b[None, :, 2])


def _walk(at: np.ndarray, nodes: np.ndarray, own: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest cost between each first and each last node of a block, and for each such pair (row by row) the nodes on the way.

    at: where each record's nodes begin (and all end); free: whether a record has one reading that says nothing on the order, so its two nodes
    differ in the remembered order only. A step between two such records costs the same on every way and is left out.
    """
    rows = len(at) - 1
    of = lambda i: slice(at[i], at[i + 1])
    first, last = int(at[1] - at[0]), int(at[-1] - at[-2])
    best = np.where(np.eye(first) > 0, own[of(0)][:, None], np.inf)
    busy = np.flatnonzero(~free)
    steps = np.unique(np.concatenate([busy, busy + 1]))
    steps = steps[(steps > 0) & (steps < rows)].tolist()
    back = []
    for i in steps:
        way = best[:, :, None] + _edge(nodes[of(i - 1)], nodes[of(i)])[None]
        back.append(way.argmin(axis=1))
        best = way.min(axis=1) + own[of(i)][None]
    picks = np.zeros((rows, first * last), dtype=np.uint8)
    ends = [*steps[1:], rows]
    for a in range(first):
        for z in range(last):
            k, node = a * last + z, z
            for j in range(len(steps) - 1, -1, -1):
                picks[steps[j] : ends[j], k] = node  # the records up to the next step keep the order
                node = int(back[j][a, node])
            picks[: steps[0] if steps else rows, k] = node if steps else a
    return best, picks


def _block(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The records of a block with their readings and those on each way through it; the first one also says what each way costs and where it begins and ends."""
    pdf = pdf.sort_values(["_ord", "_tie", "_rid", "cost", "fmt"], kind="stable").reset_index(drop=True)
    starts = np.flatnonzero(np.r_[True, pdf["_rid"].to_numpy()[1:] != pdf["_rid"].to_numpy()[:-1]])
    n = np.diff(np.r_[starts, len(pdf)])
    row, slot = np.repeat(np.arange(len(n)), n), np.arange(len(pdf)) - np.repeat(starts, n)
    width = int(n.max())

    def spread(values, empty):
        out = np.full((len(n), width), empty, dtype=object if isinstance(empty, str) else type(empty))
        out[row, slot] = values
        return out

    # a reading in numbers has an order; any other is two nodes, one for each order that may have been the last
    fmt = pdf["fmt"].to_numpy(dtype=object)
    told = np.array([f in ("num", "num_alt", "num_mdy") for f in fmt])
    twice = np.repeat(np.arange(len(pdf)), np.where(told, 1, 2))
    second = np.r_[False, twice[1:] == twice[:-1]]
    order = np.where(told[twice], (fmt[twice] == "num_mdy").astype(np.int64), second.astype(np.int64))
    nodes = np.stack([pdf["_format"].to_numpy(dtype=np.int64)[twice], pdf["micros"].to_numpy(dtype=np.int64)[twice], order], axis=1)
    owner = row[twice]
    at = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]
    m, picks = _walk(at, nodes, pdf["cost"].to_numpy(dtype=float)[twice], (n == 1) & ~told[starts])
    reading = slot[twice][at[:-1][:, None] + picks].astype(np.uint8)
    ways, digits = picks.shape[1], (reading + 48).tobytes().decode()
    out = pdf[[*keys, "_chain", "_block"]].iloc[starts].reset_index(drop=True)
    out["ways"] = [digits[i : i + ways] for i in range(0, len(digits), ways)]
    for name, values in (("normals", spread(pdf["normal"].to_numpy(), "")), ("fmts", spread(fmt, "")), ("costs", spread(pdf["cost"].to_numpy(), 0.0))):
        out[name] = pd.Series([v[:k] for v, k in zip(values.tolist(), n.tolist())], dtype=object)
    for name, values in (("first", nodes[at[0] : at[1]].ravel()), ("last", nodes[at[-2] : at[-1]].ravel()), ("m", m.ravel())):
        out[name] = pd.Series([values.tolist(), *[None] * (len(out) - 1)], dtype=object)
    return out


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The way through each block on the cheapest path of a chain."""
    pdf = pdf.sort_values("_block")
    best, back, before = None, [], None
    for first, last, m in zip(*[[np.array(v) for v in pdf[k]] for k in ("first", "last", "m")]):
        first, last = first.reshape(-1, 3), last.reshape(-1, 3)
        m = m.reshape(len(first), len(last))
        way = np.zeros((1, len(first))) if best is None else best[:, None] + _edge(before, first)
        total = way.min(axis=0)[:, None] + m
        back.append((None if best is None else way.argmin(axis=0), total.argmin(axis=0), len(last)))
        best, before = total.min(axis=0), last
    out, z = [], int(best.argmin())
    for block, (came, entry, width) in zip(reversed(list(pdf["_block"])), reversed(back)):
        a = int(entry[z])
        out.append((pdf["_chain"].iloc[0], block, a * width + z))
        z = 0 if came is None else int(came[a])
    return pd.DataFrame(out, columns=["_chain", "_block", "_way"])


def choose_readings(read: DataFrame, keys: list[str], chain: str, order: str, block: int = BLOCK) -> DataFrame:
    """keys, normals, fmts, costs, picked: a row a record, with its readings, the cheaper first, and the index (from 0) of the chosen one.

    read: a row a reading, with the record's number in ``_rid`` and the struct ``reading``. chain, order: the columns of a source and of the record
    order in it (a long; ties by the keys). Exact for any number of records a chain. A record without a place takes its cheapest reading.
    """
    r = F.col("reading")
    x = read.where("reading is not null").select(*keys, "_rid", F.coalesce(F.col(chain), F.lit("")).alias("_chain"), F.col(order).cast("long").alias("_ord"), r["fmt"].alias("fmt"), r["normal"].alias("normal"), r["micros"].alias("micros"), r["cost"].alias("cost"))
    first = F.sort_array(F.collect_list(F.struct("cost", "fmt", "normal")))
    alone = x.where("_ord is null").groupBy("_rid").agg(*[F.any_value(k).alias(k) for k in keys], first.alias("_all"))
    alone = alone.select(*keys, *[F.col(f"_all.{c}").alias(f"{c}s") for c in ("normal", "fmt", "cost")], F.lit(0).alias("picked"))
    x = x.where("_ord is not null").withColumn("_block", F.floor(F.col("_ord") / block).cast("long")).withColumn("_tie", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).withColumn("_format", F.xxhash64("fmt"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name in keys)
    ways = "first array<long>, last array<long>, m array<double>"
    parts = cut(x.groupBy("_chain", "_block").applyInPandas(lambda pdf: _block(pdf, keys), f"{kinds}, _chain string, _block long, ways string, normals array<string>, fmts array<string>, costs array<double>, {ways}"))
    ends = parts.where("m is not null").select("_chain", "_block", "first", "last", "m").groupBy("_chain").applyInPandas(_ends, "_chain string, _block long, _way int")
    chosen = parts.join(small_side(cut(ends)), ["_chain", "_block"])
    return chosen.select(*keys, "normals", "fmts", "costs", F.substr("ways", F.col("_way") + 1, F.lit(1)).cast("int").alias("picked")).unionByName(alone)


def ascii_key(c: Column) -> Column:
    """A name without its non-ASCII and lost characters: equal for a name and its garbled forms."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^\x21-\x7e]|\?", "")


def normalise(df: DataFrame, keys: list[str], value: str, source: str, order: str, sources: DataFrame, keep_unread: bool = False, chain: str | None = None) -> DataFrame:
    """One row a row of df: keys, raw, normal, fmt, n (readings that contradict nothing and have no cost), decided.

    decided: 'only' (nothing else can be meant), 'chain' (the best of several), 'none' (unread; such rows are kept if asked for). Rows of one
    ``source``, and of one ``chain`` if that column is given, are read in ``order``. ``sources`` (source, tz_name, day_first) may hold the
    source under its clean name; a garbled one in df finds it by its ASCII letters. The interpretations are checkpointed:
    the optimiser derives constraints through every step of that long projection otherwise, and takes minutes.
    """
    known = sources.select(ascii_key(F.col("source")).alias("_skey"), F.col("tz_name").alias("_tzname"), F.col("day_first").alias("_df")).dropDuplicates(["_skey"])
    x = df.select(*keys, F.col(value).alias("_raw"), F.col(order).cast("long").alias("_pos"), ascii_key(F.col(source)).alias("_skey"), (F.col(chain) if chain else F.lit("")).alias("_part"))
    x = x.join(small_side(known), "_skey", "left")
    x = interpretations(x.withColumn("_rid", F.monotonically_increasing_id()), "_raw", "_tzname", "_df")
    x = x.select(*keys, "_raw", "_pos", "_rid", F.concat_ws("|", "_part", F.coalesce("_skey", F.lit(""))).alias("_src"), "reading")
    read = cut(x)  # no filter before it: the optimiser would write the whole projection out once more to push it down
    x = choose_readings(read, [*keys, "_raw"], "_src", "_pos").withColumn("_cost", F.get("costs", "picked"))
    free, allowed = (F.size(F.filter("costs", test)) for test in (lambda c: c == 0, lambda c: c < AGAINST))
    only = (allowed == 1) | ((free == 1) & (F.col("_cost") == 0))
    stands = lambda c: F.when(F.col("_cost") < AGAINST, c)
    x = x.select(
        *keys, F.col("_raw").alias("raw"), stands(F.get("normals", "picked")).alias("normal"), stands(F.get("fmts", "picked")).alias("fmt"), F.coalesce(stands(free), F.lit(0)).alias("n"),
        F.when(F.col("_cost") >= AGAINST, "none").when(only, "only").otherwise("chain").alias("decided"),
    )
    if not keep_unread:
        return x.where("decided <> 'none'")
    none = read.groupBy("_rid").agg(*[F.any_value(k).alias(k) for k in [*keys, "_raw"]], F.count("reading").alias("_n")).where("_n = 0")
    return x.unionByName(none.select(*keys, F.col("_raw").alias("raw"), F.lit(None).cast("string").alias("normal"), F.lit(None).cast("string").alias("fmt"), F.lit(0).alias("n"), F.lit("none").alias("decided")))


def instants(df: DataFrame, key: str, value: str, source: str, sources: DataFrame) -> DataFrame:
    """key, micros: the instant each readable value begins at. A row of an unknown source counts as UTC with the month first."""
    known = sources.select(ascii_key(F.col("source")).alias("_skey"), F.col("tz_name").alias("_tzname"), F.col("day_first").alias("_df")).dropDuplicates(["_skey"])
    x = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("_raw"), ascii_key(F.col(source)).alias("_skey")).join(small_side(known), "_skey", "left")
    x = x.withColumns({"_tzname": F.coalesce("_tzname", F.lit("UTC")), "_df": F.coalesce("_df", F.lit(False))})
    read = cut(interpretations(x, "_raw", "_tzname", "_df").select(key, F.col("reading.micros").alias("micros"), F.col("reading.cost").alias("_cost")))
    return read.where((F.col("_cost") < AGAINST) & F.col("micros").isNotNull()).groupBy(key).agg(F.min_by("micros", "_cost").alias("micros"))
