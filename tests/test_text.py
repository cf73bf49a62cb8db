import time

import pytest
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators import checker, collect, fixer, study
from inkspan.operators import rules as R
from inkspan.sources import files



def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_primitives(spark):
    assert one(spark, "a b c", T.word_count) == 3
    assert one(spark, "‘a’ “b”", T.straighten) == "'a' \"b\""
    assert one(spark, "one — two -- three --- four", T.em_dash_count) == 2
    raw = "He said “stop.” Then he left. “Go!” she said."
    assert one(spark, raw, T.sentence_lengths) == [3, 4, 1, 3]
    assert one(spark, raw, lambda c: T.sentence_lengths(T.straighten(c))) == [3, 3, 1, 2]
    assert one(spark, "x" * 60_001, lambda c: F.length(T.draft_truncate(c))) == 60_000
    assert one(spark, "y " + "x" * 60_001, lambda c: F.length(T.draft_truncate(c))) == 1
    assert one(spark, "Ã© lÃ ", T.demojibake) == "Ã© lÃ " and one(spark, "cafÃ©", T.demojibake) == "café"
    assert one(spark, None, T.word_count) is None
    assert one(spark, "été", lambda c: F.regexp_count(c, F.lit(T.dialect(r"\bt", True)))) == 1


def test_checker_golden(spark):
    rows = [(1, "It isn't just a tool, it's a mindset."), (2, "It isn’t just a tool, it’s a mindset."), (3, "one — two -- three --- four"), (4, ""), (5, "plain " * 300 + "—")]
    got = {r.id: [(h.rule_id, h.start, h.end) for h in r.kept] for r in checker.checked(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: [("negative_parallelism", 0, 26)], 2: [("negative_parallelism", 0, 26)], 3: [("em_dash", 4, 5), ("em_dash", 10, 12)], 4: [], 5: []}


def test_very_repetitive_drafts_end_soon(spark):
    """The cap's hits and all dashes, in time that grows as the text: each hit copied all before it, also those beyond the cap."""
    rows = [(1, "delve " * 12_000 + "let that sink in. let that sink in. "), (2, "— " * 12_000)]
    began = time.monotonic()
    x = checker.with_hits(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "hits").collect()
    assert time.monotonic() - began < 20
    got = {r.doc_id: [(h.rule_id, h.start, h.end) for h in r.hits] for r in x}
    assert got[1] == [("slop_words", 6 * i, 6 * i + 5) for i in range(checker.HIT_CAP + 1)] + [("bot_scaffolding", 72_000, 72_016)]
    assert got[2] == [("em_dash", 2 * i, 2 * i + 1) for i in range(12_000)]


def test_odd_blanks_and_marks_in_drafts(spark):
    """Blanks beyond ASCII count as blanks but not as one that a pattern spells out; a text may hold the mark itself."""
    rows = [(1, "in\u00a0conclusion \x01 delve\x01"), (2, "here's\u00a0the kicker, here's the kicker"), (3, "no discussion of a\u2028b complete without, no discussion of a\u00a0b complete without"), (4, None)]
    x = checker.with_hits(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "hits").collect()
    got = {r.doc_id: r.hits and [(h.rule_id, h.start, h.end) for h in r.hits] for r in x}
    assert got == {1: [("slop_words", 16, 21), ("summary_ending", 0, 13)], 2: [("stock_openers", 19, 36)], 3: [("editorializing", 39, 76)], 4: None}


def test_kept_is_disjoint_and_sorted(spark):
    text = "In today's digital age we delve into a tapestry, highlighting the need for holistic, seamless, and robust plans. Not a plan, but a wish. It isn't a map. It's a mirror."
    kept = checker.checked(spark.createDataFrame([(1, text)], "id long, text string")).first().kept
    assert kept and all(a.end <= b.start for a, b in zip(kept, kept[1:]))


@pytest.mark.parametrize(("text", "out", "n"), [
    ("We harness power. They delved; delving into it. He delves into myriad of ideas.", "We uses power. They delved; dig into it. He dig into many ideas.", 4),
    ("one — two -- three --- four", "One, two, three --- four", 2), ("Para one.\n\npara two — end", "Para one. Para two, end", 1), ("", "", 0),
])
def test_fixer_golden(spark, text, out, n):
    r = fixer.apply_fixes(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert (r.text, r.n_changes) == (out, n)


def test_rules_are_shared():
    assert len(R.RULES) == 14 and len({r.id for r in R.RULES}) == 14 and R.RETIRED.id not in study.RULE_IDS


def test_collector(spark):
    body = " ".join(f"w{i}" for i in range(120))
    rows = [(1, "f", "2015-01-01", body), (2, "f", "2015-01-01", body.upper()), (3, "f", "2020-01-01", body + " x"), (4, "f", None, body), (5, "f", "2015-01-01", "short"), (6, "f", "2015-01-01", None), (7, "f", "2018-01-01", "edge " + body)]
    raw = spark.createDataFrame(rows, "pos long, file string, date string, text string").withColumn("source", F.lit("x"))
    none = spark.createDataFrame([], "source string, tz_name string, day_first boolean")
    got = {r.pos: r.why for r in collect.considered(raw, "2018-01-01", none).collect()}
    assert got == {1: None, 2: "dupe", 3: "date", 4: "date", 5: "length", 6: "length", 7: "date"}


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "b.md").write_text("naïve", encoding="utf-8")
    (tmp_path / "c.xml").write_text("<Blog><post>one</post><post>two\nlines</post></Blog>")
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"naïve"}
    assert [r.text for r in files.read_blogs(spark, str(tmp_path)).orderBy("n").collect()] == ["one", "two\nlines"]
    p = tmp_path / "d.csv"
    p.write_text('id,Post,text\n1,"a ""q""\nb",other\n')
    assert [r.text for r in files.read_csv(spark, str(p)).collect()] == ['a "q"\nb']
    p = tmp_path / "e.jsonl"
    p.write_text('{"text": 3, "body": "b"}\nnot json\n\n{"body": "x", "text": "t"}\n{"other": 1}\n')
    assert sorted(r.text for r in files.read_jsonl(spark, str(p)).collect()) == ["b", "t"]
    d = tmp_path / "mail"
    d.mkdir()
    (d / "1.").write_bytes(b"From: a\n\nown\n> quoted\n-----Original Message-----\nold")
    (d / "2.").write_bytes(b"From: a\r\n\r\nbody")
    assert [r.text.strip() for r in files.read_mails(spark, str(d)).collect()] == ["own"]
