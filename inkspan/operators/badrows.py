"""Rows that fail to parse: an error-recovering recursive-descent reader of csv, tsv and jsonl text.

``parse(text, fmt)`` reads a stream of records and yields typed records and located errors in order. After a broken
quote it goes on at the next validated record start: a line that begins a record of the schema (an id and a
separator, or an opening brace) and parses. A row that holds one record is a stream of length one.

Defined results: a null row has the reason ``quoting`` (there is nothing to read); an empty csv row is one empty field, so
``columns``; an empty jsonl row is not JSON, so ``quoting``. Repeated rows are each read. Rows are never dropped.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "source", "published", "words", "text")
_DAY = re.compile(r"\d{4}-\d\d-\d\d", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)
_WS = " \t\n\r"
_CSV_START = re.compile(r'^(?:"\d+"|\d+),', re.ASCII | re.M)
_JSON_START = re.compile(r"^[ \t]*\{", re.M)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class Broken(Exception):
    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


@dataclass
class Parsed:
    start: int
    end: int
    reason: str | None = None
    at: int | None = None
    what: str | None = None
    values: dict = field(default_factory=dict)


# --- csv: record = field ("," field)* end; field = quoted / plain ------------------------------------------


def _csv_field(s: str, i: int) -> tuple[str, int]:
    if i < len(s) and s[i] == '"':
        out, j = [], i + 1
        while True:
            k = s.find('"', j)
            if k < 0:
                raise Broken(i, "quote never closed")
            out.append(s[j:k])
            if s[k + 1 : k + 2] == '"':
                out.append('"')
                j = k + 2
                continue
            if k + 1 < len(s) and s[k + 1] not in ",\r\n":
                raise Broken(k + 1, "text after a closing quote")
            return "".join(out), k + 1
    j = i
    while j < len(s) and s[j] not in ",\n":
        if s[j] == '"':
            raise Broken(j, "quote inside an unquoted field")
        j += 1
    return s[i:j], j


def _csv_record(s: str, i: int) -> tuple[list[str], int]:
    fields = []
    while True:
        value, i = _csv_field(s, i)
        fields.append(value)
        if s.startswith(",", i):
            i += 1
            continue
        if s.startswith("\r\n", i):
            return fields, i + 2
        if s.startswith("\r", i) and i + 1 == len(s):
            return fields, i + 1
        if i >= len(s) or s[i] == "\n":
            if fields[-1].endswith("\r"):
                fields[-1] = fields[-1][:-1]
            return fields, min(i + 1, len(s))
        raise Broken(i, "bare carriage return")


# --- json ------------------------------------------------------------------------------------------------


def _blank(s: str, i: int) -> int:
    while i < len(s) and s[i] in _WS:
        i += 1
    return i


def _string(s: str, i: int) -> tuple[str, int]:
    out, i = [], i + 1
    while True:
        if i >= len(s):
            raise Broken(i, "string never closed")
        c = s[i]
        if c == '"':
            return "".join(out), i + 1
        if c < " ":
            raise Broken(i, "control character in a string")
        if c != "\\":
            k = i
            while k < len(s) and s[k] not in '"\\' and s[k] >= " ":
                k += 1
            out.append(s[i:k])
            i = k
            continue
        e = s[i + 1 : i + 2]
        if e in _ESCAPES and e:
            out.append(_ESCAPES[e])
            i += 2
        elif e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", s[i + 2 : i + 6]):
            out.append(chr(int(s[i + 2 : i + 6], 16)))
            i += 6
        else:
            raise Broken(i, "bad escape")


def _value(s: str, i: int, depth: int = 0):
    if depth > 200:
        raise Broken(i, "nested too deeply")
    i = _blank(s, i)
    c = s[i : i + 1]
    if c == "{":
        pairs, i = [], _blank(s, i + 1)
        if s.startswith("}", i):
            return pairs_of(pairs), i + 1
        while True:
            i = _blank(s, i)
            if not s.startswith('"', i):
                raise Broken(i, "key expected")
            key, i = _string(s, i)
            i = _blank(s, i)
            if not s.startswith(":", i):
                raise Broken(i, "colon expected")
            value, i = _value(s, i + 1, depth + 1)
            pairs.append((key, value))
            i = _blank(s, i)
            if s.startswith("}", i):
                return pairs_of(pairs), i + 1
            if not s.startswith(",", i):
                raise Broken(i, "comma expected")
            i += 1
    if c == "[":
        items, i = [], _blank(s, i + 1)
        if s.startswith("]", i):
            return items, i + 1
        while True:
            value, i = _value(s, i, depth + 1)
            items.append(value)
            i = _blank(s, i)
            if s.startswith("]", i):
                return items, i + 1
            if not s.startswith(",", i):
                raise Broken(i, "comma expected")
            i += 1
    if c == '"':
        return _string(s, i)
    for word, value in (("true", True), ("false", False), ("null", None)):
        if s.startswith(word, i):
            return value, i + len(word)
    if m := _NUMBER.match(s, i):
        number = m.group()
        return (int(number) if len(number) < 400 and not re.search(r"[.eE]", number) else float(number)), m.end()
    raise Broken(i, "value expected")


class pairs_of(list):
    """An object as its pairs, repeated keys kept."""


# --- the schema --------------------------------------------------------------------------------------------


def _day(s: str) -> bool:
    if not _DAY.fullmatch(s):
        return False
    try:
        dt.date.fromisoformat(s)
    except ValueError:
        return False
    return True


def _typed(values: dict) -> dict:
    return values | {k: str(values[k]).lstrip("0") or "0" for k in ("id", "words")} if isinstance(values["id"], str) else values | {k: int(values[k]) for k in ("id", "words")}


def _check_text(fields: list[str]) -> tuple[str | None, str | None, dict]:
    if len(fields) != len(FIELDS):
        return "columns", f"{len(fields)} fields", {}
    v = dict(zip(FIELDS, fields))
    for k in ("id", "words"):
        if not _DIGITS.fullmatch(v[k]):
            return "value", k, {}
    if not _day(v["published"]):
        return "value", "published", {}
    for k in ("source", "text"):
        if not v[k]:
            return "value", k, {}
    return None, None, _typed(v)


def _check_json(value) -> tuple[str | None, str | None, dict]:
    if not isinstance(value, pairs_of) or sorted(k for k, _ in value) != sorted(FIELDS):
        return "columns", "keys", {}
    v = dict(value)
    for k in ("id", "words"):
        whole = isinstance(v[k], int) or (isinstance(v[k], float) and v[k].is_integer())
        if isinstance(v[k], bool) or not whole or v[k] < 0:
            return "value", k, {}
    for k in ("source", "published", "text"):
        if not isinstance(v[k], str) or not v[k]:
            return "value", k, {}
    if not _day(v["published"]):
        return "value", "published", {}
    return None, None, _typed(v)


def _resume(s: str, start: int, at: int, fmt: str) -> int:
    """The next validated record start from the error ``at`` on, after ``start``: a line that looks like one and whose record parses whole."""
    for m in (_CSV_START if fmt == "csv" else _JSON_START).finditer(s, at):
        if m.start() <= start:
            continue
        try:
            if fmt == "csv":
                ok = len(_csv_record(s, m.start())[0]) == len(FIELDS)
            else:
                ok = isinstance(_value(s, m.start())[0], pairs_of)
        except Broken:
            continue
        if ok:
            return m.start()
    return len(s)


def parse(s: str, fmt: str, one: bool = False) -> Iterator[Parsed]:
    """The records and errors of a text in order. one: the text is a single record, so anything left over is an error."""
    i = 0
    while i < len(s) or i == 0:
        start = i
        try:
            if fmt == "tsv":
                end = len(s) if one or (k := s.find("\n", i)) < 0 else k
                reason, what, values = _check_text(s[i:end].split("\t"))
                i = end + 1
            elif fmt == "csv":
                fields, i = _csv_record(s, i)
                if one and i < len(s):
                    raise Broken(i, "line break outside quotes")
                reason, what, values = _check_text(fields)
            else:
                value, i = _value(s, i)
                k = _blank(s, i)
                if k < len(s) and (one or "\n" not in s[i:k]):
                    raise Broken(k, "text after the value")
                i = max(k, 1)
                reason, what, values = _check_json(value)
            yield Parsed(start, i, reason, start if reason else None, what, values)
        except Broken as e:
            i = len(s) if one else _resume(s, start, max(e.at, start), fmt)
            yield Parsed(start, i, "quoting", e.at, e.what)
            i = max(i, start + 1)
        if one:
            return


SCHEMA = "row_id long, file string, line_no long, reason string, error_at int, error string, id string, source string, published string, words string, text string"


def read_rows(rows: DataFrame) -> DataFrame:
    """One row for each row of ``rows`` (row_id, file, fmt, line_no, raw_row): its five fields, or the reason it fails."""

    def run(batches):
        for b in batches:
            out = []
            for row_id, file, fmt, line_no, raw in zip(b.row_id, b.file, b.fmt, b.line_no, b.raw_row):
                r = Parsed(0, 0, "quoting", 0, "no text") if not isinstance(raw, str) else next(parse(raw, fmt, one=True))
                v = r.values
                out.append((row_id, file, line_no, r.reason, r.at, r.what, *[None if v.get(k) is None else str(v[k]) for k in FIELDS]))
            yield pd.DataFrame(out, columns=["row_id", "file", "line_no", "reason", "error_at", "error", *FIELDS]).astype({"error_at": "Int32"})

    return rows.select("row_id", "file", "fmt", "line_no", "raw_row").mapInPandas(run, SCHEMA)


#: Records of a file that are joined to one text.
STREAM_ROWS = 200


def joined(rows: DataFrame, many: int = STREAM_ROWS) -> DataFrame:
    """file, fmt, block, raw: runs of ``many`` record numbers of each file as one text, in their order. A hot file is many texts."""
    x = rows.where("raw_row is not null").select("file", "fmt", F.floor(F.col("line_no") / many).cast("long").alias("block"), F.struct("line_no", "row_id", "raw_row").alias("r"))
    lines = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["raw_row"])
    return x.groupBy("file", "fmt", "block").agg(F.array_join(lines, "\n").alias("raw"))


STREAM_SCHEMA = "file string, fmt string, block long, start int, end int, reason string, error_at int, error string, id string, source string, published string, words string, text string"


def read_streams(texts: DataFrame) -> DataFrame:
    """A row for each record or error of ``texts`` (file, fmt, block, raw) with its place; after an error it goes on at the next record start."""

    def run(batches):
        for b in batches:
            out = []
            for file, fmt, block, raw in zip(b.file, b.fmt, b.block, b.raw):
                for r in parse(raw, fmt) if isinstance(raw, str) else ():
                    out.append((file, fmt, block, r.start, r.end, r.reason, r.at, r.what, *[None if r.values.get(k) is None else str(r.values[k]) for k in FIELDS]))
            yield pd.DataFrame(out, columns=["file", "fmt", "block", "start", "end", "reason", "error_at", "error", *FIELDS]).astype({"error_at": "Int32"})

    return texts.select("file", "fmt", "block", "raw").mapInPandas(run, STREAM_SCHEMA)
