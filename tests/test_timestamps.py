import datetime as dt
import itertools
import random
import zoneinfo

import numpy as np
from pyspark.sql import functions as F

from inkspan.operators import timestamps as T

SOURCES = [("us", "America/New_York", False), ("uk", "Europe/London", True), ("café", "Europe/Paris", True)]


def run(spark, rows, keep=True):
    df = spark.createDataFrame([(i, v, s, i) for i, (v, s) in enumerate(rows)], "id long, date string, source string, pos long")
    src = spark.createDataFrame(SOURCES, "source string, tz_name string, day_first boolean")
    return {r.id: r for r in T.normalise(df, ["id"], "date", "source", "pos", src, keep).collect()}


def test_forms(spark):
    cases = [
        ("2015-07-04", "us", "2015-07-04"), ("07/04/15", "us", "2015-07-04"), ("04/07/2015 09:30", "uk", "2015-07-04T08:30:00.000000Z"), ("2015", "us", "2015"), ("2015-07", "us", "2015-07"), ("July 2015", "us", "2015-07"),
        ("2015-07-04T12:00:00.5+02:00", "us", "2015-07-04T10:00:00.500000Z"), ("Sat, 04 Jul 2015 12:00:00 -0400", None, "2015-07-04T16:00:00.000000Z"), ("Sat Jul  4 12:00:00 EDT 2015", "us", "2015-07-04T16:00:00.000000Z"),
        ("1436025600", None, "2015-07-04T16:00:00.000000Z"), ("1436025600123", "us", "2015-07-04T16:00:00.123000Z"), ("4 juillet 2015 à 12h05", "café", "2015-07-04T10:05:00.000000Z"), ("4 juillet 2015 à 12h05", "cafÃ©", "2015-07-04T10:05:00.000000Z"),
        ("20150704T120000Z", "us", "2015-07-04T12:00:00.000000Z"), ("2015-W27-6", "us", "2015-07-04"), ("2015-185", "us", "2015-07-04"), ("4,July,2015", "us", "2015-07-04"), ("7/4/2015 12:05 AM", "us", "2015-07-04T04:05:00.000000Z"),
        ("2015-07-04T12:00:00[Europe/Paris]", "us", "2015-07-04T10:00:00.000000Z"),
    ]
    got = run(spark, [(v, s) for v, s, _ in cases])
    assert [(got[i].normal, v) for i, (v, _, _) in enumerate(cases)] == [(n, v) for v, _, n in cases]


def test_no_single_time(spark):
    bad = [(None, "us"), ("", "us"), ("yesterday", "us"), ("2015-02-30", "us"), ("2015-13-01", "us"), ("31/04/2015", "uk"), ("2015-03-08T02:30:00", "us"), ("2015-11-01T01:30:00", "us"), ("10:45", "us"), ("2015-07-04T12:00:00", None), ("0000-00-00", "us"), ("2015-07-04T25:00:00Z", "us"), ("x" * 100_000, "us")]
    got = run(spark, bad)
    assert all(got[i].normal is None and got[i].decided == "none" for i in range(len(bad)))
    assert run(spark, [("2015-11-01T01:30:00-05:00", "us")])[0].normal == "2015-11-01T06:30:00.000000Z"
    assert run(spark, bad, keep=False) == {}


def test_empty_table(spark):
    assert run(spark, [("x", "us")], keep=False) == {}
    df = spark.createDataFrame([], "id long, date string, source string, pos long")
    src = spark.createDataFrame([], "source string, tz_name string, day_first boolean")
    assert T.normalise(df, ["id"], "date", "source", "pos", src).count() == 0


def test_zones_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(dt.datetime(2014, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 700)), rng.choice(SOURCES)) for _ in range(300)]
    rows += [(dt.datetime(2015, 3, 8, 1) + dt.timedelta(minutes=15 * k), SOURCES[0]) for k in range(16)] + [(dt.datetime(2015, 11, 1, 0) + dt.timedelta(minutes=15 * k), SOURCES[0]) for k in range(16)]
    got = run(spark, [(t.strftime("%Y-%m-%d %H:%M:%S"), s[0]) for t, s in rows])
    for i, (t, s) in enumerate(rows):
        z = zoneinfo.ZoneInfo(s[1])
        utc = {t.replace(tzinfo=z, fold=f).astimezone(dt.UTC) for f in (0, 1)}
        real = {u for u in utc if u.astimezone(z).replace(tzinfo=None) == t}
        want = next(iter(real)).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(real) == 1 else None
        assert got[i].normal == want, (t, s)


def test_chain_is_the_best_path(spark):
    """Ambiguous days and months of an unknown source: blocks give the same cost as trying every path."""
    rng = random.Random(5)
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(350)) for _ in range(11)]
    forms = ["%m/%d/%Y", "%d.%m.%Y", "%Y-%m-%d", "%m/%d/%Y"]
    df = spark.createDataFrame([(i, d.strftime(forms[i % 4]), i) for i, d in enumerate(days)], "id long, date string, pos long").withColumns({"tz": F.lit(None).cast("string"), "df": F.lit(None).cast("boolean")})
    read = T.interpretations(df.withColumn("_rid", F.col("id")), "date", "tz", "df").withColumn("chain", F.lit("a"))
    nodes = [[r.reading for r in read.where(F.col("id") == i).collect() if r.reading] for i in range(len(days))]

    def cost(path):
        pairs = list(zip(path, path[1:]))
        orders = [p.fmt == "num_mdy" for p in path if p.fmt in ("num", "num_mdy")]
        turns = sum(a != b for a, b in zip(orders, orders[1:]))
        return sum(p.cost for p in path) + sum(T.SWITCH_COST * (a.fmt != b.fmt) + T.BACK_COST * (b.micros < a.micros) for a, b in pairs) + T.ORDER_COST * turns

    best = min(cost(p) for p in itertools.product(*nodes))
    for block in (1, 2, 3, 1000):
        got = {r.id: r.normals[r.picked] for r in T.choose_readings(read, ["id"], "chain", "pos", block).collect()}
        assert np.isclose(cost([next(n for n in ns if n.normal == got[i]) for i, ns in enumerate(nodes)]), best)


def test_a_source_outweighs_the_chain(spark):
    """Every row goes through the chain; a known order of day and month is never given up for it."""
    rows = [("12/25/2015", "us"), ("01/02/2016", "us"), ("12/26/2015", "us"), ("13/14/2015", "us"), ("25/12/2015", "us")]
    got = run(spark, rows)
    assert [got[i].normal for i in range(5)] == ["2015-12-25", "2016-01-02", "2015-12-26", None, None]
    assert [got[i].decided for i in range(5)] == ["only", "only", "only", "none", "none"]
    same = spark.createDataFrame([(1, "2015-07-04", "us", None), (1, "2015-07-04", "us", None), (2, "04.05.2015", None, None)], "id long, date string, source string, pos long")
    src = spark.createDataFrame(SOURCES, "source string, tz_name string, day_first boolean")
    assert sorted(r.decided for r in T.normalise(same, ["id"], "date", "source", "pos", src).collect()) == ["chain", "only", "only"]


def test_the_order_is_remembered(spark):
    rows = [("25/12/2015", None), ("2015-12-26", None), ("December 27, 2015", None), ("2015-12-28", None), ("03/04/2016", None), ("2016-04-05", None)] * 2 + [("12/25/2016", "z"), ("2016", "z"), ("03/04/2017", "z")]
    got = run(spark, rows)
    assert got[4].normal == got[10].normal == "2016-04-03" and got[14].normal == "2017-03-04"
