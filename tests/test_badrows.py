import csv
import io
import json
import random

from inkspan.operators.badrows import parse, read_rows


def one(s, fmt):
    return next(parse(s, fmt, one=True))


def test_reasons():
    good = "1,a,2015-02-03,4,some text"
    assert one(good, "csv").reason is None and one(good + "\r", "csv").values["text"] == "some text"
    assert one('1,a,2015-02-03,4,"two\nlines, ""quoted"""', "csv").values["text"] == 'two\nlines, "quoted"'
    for s in ('1,a,2015-02-03,4,a "b" c', '1,a,2015-02-03,4,"open', '1,a,2015-02-03,4,"x" y', "1,a,2015-02-03,4,b\nc"):
        assert one(s, "csv").reason == "quoting", s
    for s in ("1,a,2015-02-03,4", "1,a,2015-02-03,4,b,c", ""):
        assert one(s, "csv").reason == "columns", s
    for s in ("x,a,2015-02-03,4,b", "1,,2015-02-03,4,b", "1,a,2015-02-30,4,b", "1,a,2015-02-03,4.5,b", "1,a,2015-02-03,4,", "1,a,2015-2-3,4,b", "-1,a,2015-02-03,4,b"):
        assert one(s, "csv").reason == "value", s
    assert one('1\ta\t2015-02-03\t4\tsay "x', "tsv").reason is None and one("1\ta", "tsv").reason == "columns"


def test_json():
    row = {"id": 1, "source": "a", "published": "2015-02-03", "words": 4, "text": "é\n\"q\""}
    assert one(" " + json.dumps(row) + "\n", "jsonl").values["text"] == row["text"]
    assert one(json.dumps(row, ensure_ascii=False), "jsonl").reason is None
    for s in ("{", "", "{'id': 1}", json.dumps(row) + "x", '{"id": NaN}', '{"a": "tab\there"}', '{"a": 01}', "[1,]"):
        assert one(s, "jsonl").reason == "quoting", s
    for s in ("[]", "3", "{}", json.dumps(row | {"x": 1}), json.dumps(row)[:-1] + ', "id": 2}'):
        assert one(s, "jsonl").reason == "columns", s
    for k, v in (("id", "1"), ("id", -1), ("id", 1.5), ("id", True), ("words", None), ("text", ""), ("text", 3), ("source", None), ("published", "2015-02-31")):
        assert one(json.dumps(row | {k: v}), "jsonl").reason == "value", (k, v)


def test_round_trip_and_recovery():
    rng = random.Random(1)
    rows = [[str(i), rng.choice(["a", "b,c", 'd"e']), "2015-02-03", "7", "".join(rng.choice('ab ",\n') for _ in range(20)) + "z"] for i in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    got = list(parse(out.getvalue(), "csv"))
    assert [[g.values[k] for k in ("id", "source", "published", "words", "text")] for g in got] == rows
    lines = ["1,a,2015-02-03,4,fine", '2,a,2015-02-03,4,"never closed', "3,a,2015-02-03,4,after", "4,a,2015-02-03,4,last"]
    got = list(parse("\n".join(lines), "csv"))
    assert [g.reason for g in got] == [None, "quoting", None, None] and got[1].at == len(lines[0]) + 1 + lines[1].index('"')
    assert [g.values.get("id") for g in got] == ["1", None, "3", "4"]


def test_table(spark):
    df = spark.createDataFrame([(1, "f", "csv", 1, "1,a,2015-02-03,4,b", "x"), (2, "f", "csv", 2, None, "x"), (2, "f", "csv", 2, None, "x"), (3, None, "csv", 3, '"' * 100_001, "x"), (4, "f", "csv", 4, "9" * 50 + ",a,2015-02-03,4,b", "x")], "row_id long, file string, fmt string, line_no long, raw_row string, reason string")
    got = [(r.row_id, r.reason) for r in read_rows(df).orderBy("row_id").collect()]
    assert got == [(1, None), (2, "quoting"), (2, "quoting"), (3, "quoting"), (4, None)]
    assert read_rows(df.where("row_id = 99")).count() == 0
