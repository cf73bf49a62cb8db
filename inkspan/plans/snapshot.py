"""The weekly snapshot as tables: validation, folds of history and log, published outputs; and the board's queries.

A snapshot is a handful of rows; its operators keep array order in an ``ord`` column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.plans.drafts import q, s_escape
from inkspan.tables import own_path

Q: dict = {}
S: dict = {}


def add(name, fn, sql):
    Q[name] = fn
    if sql:
        S[name] = sql


# A made snapshot: trends (ord, tell, evidence, dir, label), numbers, a year of history, a log, proposed changes.
TRENDS = [
    (0, "Em dash pile-up", "Two a paragraph in drafts", "falling", "easing"), (1, "Even cadence", "Sentences of one length", "rising", "rising"), (2, "Delve and kin", "Word lists", "stable", None),
    (3, "Markdown bold in prose", "Bullets everywhere", "rising", "climbing fast"), (4, "Vague attribution", "Experts say", "stable", ""), (5, "Opener with a hook", "A question first", "rising", "up"), (6, "Semicolon thinning", "Fewer than before", "falling", "down"),
]
PHRASES = [(0, "a testament to", 182.0), (1, "let that sink in", 120.0), (2, "rich tapestry", 50.5), (3, "in conclusion", 16.0)]
HISTORY = [("Em dash pile-up", ["rising"] * 13), ("Even cadence", ["stable", "rising", "odd", "rising"]), ("Gone tell", ["falling"] * 3), ("Delve and kin", ["falling", "stable"] * 6)]
LOG = [(i, f"2026-{8 - i // 4:02d}-{28 - 7 * (i % 4):02d}", f"Week {40 - i}", f"week-{40 - i}" if i % 3 else None, f"Title {i}" if i % 3 else None, f"Deck of {i}" if i % 2 else None, [f"item {i}a", f"item {i}b", f"item {i}c", f"item {i}d"][: i % 5]) for i in range(13)]
ENTRY = ("2026-08-21", "Week 41", "week-41", "Newest title", "Newest deck", ["one", "two"])
CHANGES = ["too short", "A change that is long enough to stay", "x" * 221, "Second change, also fine", "Third & last <change>", "Fourth change is here", "Fifth change is here", "Sixth change is too many"]
COLUMNS = [(1, "Good title", "A deck that is long enough", ["<b>First</b> paragraph, which is surely longer than thirty characters.", "Second <a href='https://x.example'>paragraph</a>, also longer than thirty."], None), (2, "Bad", "short", ["x"], None), (3, "Another title", "A deck that is long enough", ["Only one paragraph that is longer than thirty characters."], "note")]
SPECIMENS = [(1, [("It is ", None), (None, "not just"), (" late.", None)], 2), (2, [("both", "set")], 1), (3, [("only one", None)], 1), (4, [("a" * 141, None), (None, "b")], 3)]
POSTS = [("week-41", "week"), ("how-to-check", "guide"), ("week-40", "week"), ("about-dashes", "guide")]
DIRS = ("rising", "falling", "stable")


def _trends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRENDS, "ord int, tell string, evidence string, dir string, label string")


def _history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(HISTORY)], "ord int, tell string, dirs array<string>")


def _log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOG, "ord int, iso string, week string, slug string, title string, deck string, items array<string>")


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return q(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]" if isinstance(v, list) else "(" + ", ".join(lit(x) for x in v) + ")"
    return str(v)


def values(rows: list, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS v({names}))"


_T = f"trends AS {values(TRENDS, 'ord, tell, evidence, dir, label')}"
_H = f"history AS {values([(i, t, d) for i, (t, d) in enumerate(HISTORY)], 'ord, tell, dirs')}"
_LOGS = f"log AS {values(LOG, 'ord, iso, week, slug, title, deck, items')}"
_LABEL = "coalesce(nullif(label, ''), dir)"


def label() -> F.Column:
    return F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("dir"))


SNAPSHOT = "id long, updated string, note string, phrase_src string, dash_src string, phrases array<struct<label:string,v:double>>, dashes array<struct<label:string,v:double>>, trends array<struct<tell:string,evidence:string,dir:string,label:string>>"


def _snapshots() -> list[tuple]:
    """A sound snapshot and broken ones."""
    phrases, trends = [(label, v) for _, label, v in PHRASES], [t[1:] for t in TRENDS]
    good = (1, "2026-08-21", None, "a list of phrases", "a count of dashes", phrases, [("one", 0.0), ("two", 10.6), ("three", 100.0)], trends)
    change = lambda i, **new: tuple(new.get(k, v) for k, v in zip(("id", "updated", "note", "phrase_src", "dash_src", "phrases", "dashes", "trends"), (i, *good[1:])))
    return [
        good, change(2, updated="2026"), change(3, note="n" * 201), change(4, phrase_src=None), change(5, dash_src="s" * 161), change(6, phrases=phrases[:2]), change(7, phrases=[*phrases, ("x" * 121, 1.0)]),
        change(8, phrases=[*phrases, ("too much", 10001.0)]), change(9, dashes=[("d", 1.0)] * 13), change(10, dashes=[("d", -0.5), *good[6]]), change(11, trends=trends[:5]), change(12, trends=[*trends, ("t" * 121, "e", "stable", None)]),
        change(13, trends=[*trends, ("t", "e", "sideways", None)]), change(14, trends=[*trends, ("t", "e" * 300, "stable", "l" * 81)]), change(15, phrases=[("p", 0.0)] * 12),
    ]


def checks() -> F.Column:
    """The checks of a snapshot as an array of (name, ok), in order."""
    short = lambda c, most: F.coalesce(F.length(c) <= most, F.lit(False))
    value = lambda c, most: F.coalesce(c.between(0, most), F.lit(False))
    several = lambda c, least, most: F.coalesce(F.size(c).between(least, most), F.lit(False))
    every = lambda c, test: F.coalesce(F.forall(c, test), F.lit(False))
    found = {
        "updated": F.coalesce(F.length("updated").between(8, 40), F.lit(False)), "note": F.length(F.coalesce("note", F.lit(""))) <= 200, "sources": short("phrase_src", 160) & short("dash_src", 160),
        "phrases": several("phrases", 3, 12), "phrase rows": every("phrases", lambda r: short(r["label"], 120) & value(r["v"], 10000)), "dashes": several("dashes", 3, 12), "dash rows": every("dashes", lambda r: short(r["label"], 60) & value(r["v"], 100)),
        "trends": several("trends", 6, 20), "trend rows": every("trends", lambda r: short(r["tell"], 120) & short(r["evidence"], 300) & (F.length(F.coalesce(r["label"], F.lit(""))) <= 80)),
        "directions": every("trends", lambda r: F.coalesce(r["dir"].isin(*DIRS), F.lit(False))),
    }
    return F.array(*[F.struct(F.lit(k).alias("name"), v.alias("ok")) for k, v in found.items()])


def validated(snapshot: DataFrame) -> DataFrame:
    """The snapshot of one row if every check holds; raises otherwise, so that nothing is changed."""
    bad = [r.name for r in snapshot.limit(1).select(F.explode_outer(checks()).alias("c")).where("not c.ok").select("c.name").collect()]
    if bad:
        raise ValueError(f"the snapshot fails: {', '.join(bad)}")
    return snapshot


def validate(spark: SparkSession) -> DataFrame:
    """A row a snapshot and check with whether it holds."""
    return spark.createDataFrame(_snapshots(), SNAPSHOT).select("id", F.explode_outer(checks()).alias("c")).select("id", "c.name", "c.ok")


def _structs(rows: list, names: tuple[str, ...]) -> str:
    return "[" + ", ".join("{" + ", ".join(f"'{k}': {lit(v)}" for k, v in zip(names, r)) + "}" for r in rows) + "]"


_SNAPS = "snaps AS (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS id, CAST({lit(u)} AS VARCHAR) AS updated, CAST({lit(n)} AS VARCHAR) AS note, CAST({lit(ps)} AS VARCHAR) AS phrase_src, CAST({lit(ds)} AS VARCHAR) AS dash_src, "
    f"CAST({_structs(p, ('label', 'v'))} AS STRUCT(label VARCHAR, v DOUBLE)[]) AS phrases, CAST({_structs(d, ('label', 'v'))} AS STRUCT(label VARCHAR, v DOUBLE)[]) AS dashes, CAST({_structs(t, ('tell', 'evidence', 'dir', 'label'))} AS STRUCT(tell VARCHAR, evidence VARCHAR, dir VARCHAR, label VARCHAR)[]) AS trends"
    for i, u, n, ps, ds, p, d, t in _snapshots()
) + ")"
_ALL = lambda c, bad: f"len(list_filter({c}, lambda r: {bad})) = 0"
_CHECKS = {
    "updated": "coalesce(length(updated) BETWEEN 8 AND 40, false)", "note": "length(coalesce(note, '')) <= 200", "sources": "coalesce(length(phrase_src) <= 160, false) AND coalesce(length(dash_src) <= 160, false)",
    "phrases": "len(phrases) BETWEEN 3 AND 12", "phrase rows": _ALL("phrases", "length(r.label) > 120 OR r.v < 0 OR r.v > 10000"), "dashes": "len(dashes) BETWEEN 3 AND 12", "dash rows": _ALL("dashes", "length(r.label) > 60 OR r.v < 0 OR r.v > 100"),
    "trends": "len(trends) BETWEEN 6 AND 20", "trend rows": _ALL("trends", "length(r.tell) > 120 OR length(r.evidence) > 300 OR length(coalesce(r.label, '')) > 80"), "directions": _ALL("trends", "r.dir NOT IN ('rising', 'falling', 'stable')"),
}
add("validate_snapshot", lambda s, sf: validate(s), f"WITH {_SNAPS} " + " UNION ALL ".join(f"SELECT id, '{k}' AS name, {v} AS ok FROM snaps" for k, v in _CHECKS.items()))


def changes(spark: SparkSession) -> DataFrame:
    """The first five changes of a fair length; a default sentence if there is none."""
    x = spark.createDataFrame([(CHANGES,)], "c array<string>")
    kept = F.slice(F.filter("c", lambda s: F.length(s).between(11, 220)), 1, 5)
    return x.select(F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("No material changes this week.")))).alias("ord", "change")).select(F.col("ord").cast("long").alias("ord"), "change")


add("changes_norm", lambda s, sf: changes(s), f"SELECT rn - 1 AS ord, c AS change FROM (SELECT c, row_number() OVER (ORDER BY i) AS rn FROM (SELECT unnest({lit(CHANGES)}) AS c, unnest(range(1, {len(CHANGES) + 1})) AS i) WHERE length(c) BETWEEN 11 AND 220) WHERE rn <= 5")


def columns(spark: SparkSession) -> DataFrame:
    """A valid column cleaned; an invalid one replaced by the quiet week built from the changes."""
    x = spark.createDataFrame(COLUMNS, "id int, title string, deck string, paragraphs array<string>, note string")
    ok = F.length("title").between(5, 90) & F.length("deck").between(11, 200) & F.size("paragraphs").between(2, 5) & F.forall("paragraphs", lambda p: F.length(p).between(31, 1200)) & (F.length(F.coalesce("note", F.lit(""))) <= 200)
    first = F.lit(CHANGES[1])
    quiet = F.array(*[F.lit(c) for c in CHANGES if 11 <= len(c) <= 220][:5])
    said = F.when(ok, F.array_join(F.transform("paragraphs", T.sanitize_html), "|")).otherwise(F.array_join(F.transform(quiet, T.html_escape), "|"))
    return x.select(F.col("id").cast("long").alias("id"), F.when(ok, F.col("title")).otherwise("Quiet week; nothing material changed").alias("title"), F.when(ok, F.col("deck")).otherwise(F.substring(first, 1, 190)).alias("deck"), said.alias("paragraphs"), F.when(ok, F.coalesce(F.nullif("note", F.lit("")), F.lit("No site changes this week."))).otherwise("No site changes this week.").alias("note"))


_OK = "(length(title) BETWEEN 5 AND 90 AND length(deck) BETWEEN 11 AND 200 AND len(paragraphs) BETWEEN 2 AND 5 AND len(list_filter(paragraphs, lambda p: length(p) NOT BETWEEN 31 AND 1200)) = 0)"
_QUIET = "|".join(c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for c in [c for c in CHANGES if 11 <= len(c) <= 220][:5])
add("column_fallback", lambda s, sf: columns(s), f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN {_OK} THEN title ELSE 'Quiet week; nothing material changed' END AS title, CASE WHEN {_OK} THEN deck ELSE {q(CHANGES[1])} END AS deck, CASE WHEN {_OK} THEN regexp_replace(replace(replace(array_to_string(paragraphs, '|'), '<b>', ''), '</b>', ''), '<a href=''([^'']*)''>', '<a href=\"\\1\" rel=\"noopener\">', 'g') ELSE {q(_QUIET)} END AS paragraphs, 'No site changes this week.' AS note FROM {values([(a, b, c, d, None) for a, b, c, d, _ in COLUMNS], 'id, title, deck, paragraphs, note')}")


def specimens(spark: SparkSession) -> DataFrame:
    """Whether a specimen stands: two to six segments, each of exactly one kind and short."""
    x = spark.createDataFrame(SPECIMENS, "id long, segments array<struct<t:string,m:string>>, n int")
    good = F.size("segments").between(2, 6) & F.forall("segments", lambda s: (s["t"].isNull() != s["m"].isNull()) & (F.length(F.coalesce(s["t"], s["m"])) <= 140))
    return x.select("id", F.when(good, F.array_join(F.transform("segments", lambda s: F.coalesce(s["t"], s["m"])), "")).otherwise("previous").alias("text"))


add("specimen_fallback", lambda s, sf: specimens(s), "SELECT CAST(id AS BIGINT) AS id, CASE WHEN count(*) BETWEEN 2 AND 6 AND bool_and((t IS NULL) <> (m IS NULL) AND length(coalesce(t, m)) <= 140) THEN string_agg(coalesce(t, m), '' ORDER BY i) ELSE 'previous' END AS text FROM " + values([(a, i, t, m) for a, seg, _ in SPECIMENS for i, (t, m) in enumerate(seg)], "id, i, t, m") + " GROUP BY id")


def folded(spark: SparkSession) -> DataFrame:
    """tell, dirs: each current tell's history with this week's direction, the last twelve."""
    h = _history(spark).select("tell", F.filter("dirs", lambda d: d.isin(*DIRS)).alias("dirs"))
    x = _trends(spark).join(h, "tell", "left")
    every = F.concat(F.coalesce("dirs", F.expr("cast(array() as array<string>)")), F.array("dir"))
    return x.select("ord", "tell", F.slice(every, F.greatest(F.size(every) - 11, F.lit(1)), F.lit(12)).alias("dirs"))


_FOLD = f"{_T}, {_H}, folded AS (SELECT ord, tell, d[greatest(len(d) - 11, 1):] AS dirs FROM (SELECT t.ord, t.tell, list_concat(coalesce(list_filter(h.dirs, lambda x: x IN ('rising', 'falling', 'stable')), []::VARCHAR[]), [t.dir]) AS d FROM trends t LEFT JOIN history h ON h.tell = t.tell))"
add("history_fold", lambda s, sf: folded(s).select("tell", F.array_join("dirs", ",").alias("dirs")), f"WITH {_FOLD} SELECT tell, array_to_string(dirs, ',') AS dirs FROM folded")


def upserted(spark: SparkSession) -> DataFrame:
    """The log with the new entry first, an entry of the same day replaced, twelve at most."""
    new = spark.createDataFrame([(-1, *ENTRY)], "ord int, iso string, week string, slug string, title string, deck string, items array<string>")
    x = new.unionByName(_log(spark)).withColumn("_n", F.row_number().over(Window.partitionBy("iso").orderBy("ord"))).where("_n = 1").drop("_n")
    return x.withColumn("place", F.row_number().over(Window.orderBy("ord"))).where("place <= 12")


_UP = f"{_LOGS}, entry AS {values([(-1, *ENTRY)], 'ord, iso, week, slug, title, deck, items')}, up AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY ord) AS rn FROM (SELECT * FROM entry UNION ALL SELECT * FROM log)) WHERE rn = 1) WHERE place <= 12)"
add("log_upsert", lambda s, sf: upserted(s).select(F.col("place").cast("long").alias("place"), "iso", "week"), f"WITH {_UP} SELECT place, iso, week FROM up")
add("shape_clean", lambda s, sf: _trends(s).select("tell", "evidence", "dir", label().alias("label")), f"WITH {_T} SELECT tell, evidence, dir, {_LABEL} AS label FROM trends")
add("rising_top10", lambda s, sf: _trends(s).where("dir = 'rising'").orderBy("ord").limit(10).select("tell"), f"WITH {_T} SELECT tell FROM trends WHERE dir = 'rising' ORDER BY ord LIMIT 10")


def trending_text(spark: SparkSession) -> DataFrame:
    """The text output: a line for each rising tell, in order, as one value."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "tell", "evidence").alias("l")))), lambda r: F.concat(F.lit("- "), r["l"]))
    return _trends(spark).where("dir = 'rising'").agg(F.array_join(lines, "\n").alias("text"))


add("trending_text", lambda s, sf: trending_text(s), f"WITH {_T} SELECT string_agg('- ' || tell || ': ' || evidence, chr(10) ORDER BY ord) AS text FROM trends WHERE dir = 'rising'")
_PAGE = "head\n<!-- start -->\nold $1 text\n<!-- end -->\ntail"


def fenced(page: F.Column, text: F.Column, start: str = "<!-- start -->", end: str = "<!-- end -->") -> F.Column:
    """The part between two markers replaced; the page as it is if a marker is missing. ``text`` is taken literally."""
    a, b = F.instr(page, start), F.instr(page, end)
    return F.when((a > 0) & (b > a), F.concat(F.substr(page, F.lit(1), a + len(start) - 1), F.lit("\n"), text, F.lit("\n"), F.substr(page, b))).otherwise(page)


add("skill_section", lambda s, sf: trending_text(s).select(fenced(F.lit(_PAGE), F.col("text")).alias("page")), f"WITH {_T}, x AS (SELECT string_agg('- ' || tell || ': ' || evidence, chr(10) ORDER BY ord) AS text FROM trends WHERE dir = 'rising') SELECT E'head\\n<!-- start -->\\n' || text || E'\\n<!-- end -->\\ntail' AS page FROM x")
add("blog_index", lambda s, sf: upserted(s).where("place = 1 or (slug is not null and title is not null)").select(F.col("place").cast("long").alias("place"), (F.col("place") == 1).alias("featured"), "slug", "title", F.coalesce("deck", F.get("items", F.lit(0))).alias("said")), f"WITH {_UP} SELECT place, place = 1 AS featured, slug, title, coalesce(deck, items[1]) AS said FROM up WHERE place = 1 OR (slug IS NOT NULL AND title IS NOT NULL)")
_ANCHOR = "coalesce('/blog/' || slug, '#' || iso)"
add("changelog", lambda s, sf: upserted(s).select("iso", "week", F.array_join(F.transform("items", T.html_escape), "; ").alias("items"), F.coalesce(F.concat(F.lit("/blog/"), "slug"), F.concat(F.lit("#"), "iso")).alias("link")), f"WITH {_UP} SELECT iso, week, coalesce(array_to_string(items, '; '), '') AS items, {_ANCHOR} AS link FROM up")


def feed(spark: SparkSession) -> DataFrame:
    """The feed's items, newest first, each with its XML."""
    said = F.coalesce("deck", F.array_join("items", " • "))
    x = upserted(spark).select(F.col("place").cast("long").alias("place"), F.coalesce("title", "week").alias("title"), said.alias("description"), F.date_format(F.to_date("iso"), "EEE, dd MMM yyyy '12:00:00 GMT'").alias("published"), F.coalesce(F.concat(F.lit("/blog/"), "slug"), F.concat(F.lit("#"), "iso")).alias("link"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), T.attr_escape(F.col(c)), F.lit(f"</{name}>"))
    return x.withColumn("xml", F.concat(F.lit("<item>"), tag("title", "title"), tag("link", "link"), tag("pubDate", "published"), tag("description", "description"), F.lit("</item>")))


_XML = lambda name, c: f"'<{name}>' || replace({s_escape(c)}, '\"', '&quot;') || '</{name}>'"
add("feed", lambda s, sf: feed(s), f"WITH {_UP}, f AS (SELECT place, coalesce(title, week) AS title, coalesce(deck, array_to_string(items, ' • '), '') AS description, strftime(CAST(iso AS DATE), '%a, %d %b %Y 12:00:00 GMT') AS published, {_ANCHOR} AS link FROM up) SELECT *, '<item>' || {_XML('title', 'title')} || {_XML('link', 'link')} || {_XML('pubDate', 'published')} || {_XML('description', 'description')} || '</item>' AS xml FROM f")
add("prev_next", lambda s, sf: upserted(s).where("slug is not null").select("slug", F.lead("slug").over(Window.orderBy("place")).alias("previous")), f"WITH {_UP} SELECT slug, lead(slug) OVER (ORDER BY place) AS previous FROM up WHERE slug IS NOT NULL")
add("blog_post", lambda s, sf: upserted(s).where("place = 1 and slug is not null and title is not null").select("slug", F.concat(F.lit("<h1>"), T.html_escape(F.col("title")), F.lit("</h1><p>"), T.html_escape(F.col("deck")), F.lit("</p>")).alias("html")), f"WITH {_UP} SELECT slug, '<h1>' || {s_escape('title')} || '</h1><p>' || {s_escape('deck')} || '</p>' AS html FROM up WHERE place = 1 AND slug IS NOT NULL AND title IS NOT NULL")
_LIVE, _FALLBACK = {"updated": "2026-08-21", "note": "live"}, {"updated": "2026-01-01", "note": "old", "source": "embedded"}
add("src_snapshot", lambda s, sf: s.createDataFrame(sorted(_FALLBACK.items()), "k string, f string").join(s.createDataFrame(sorted(_LIVE.items()), "k string, l string"), "k", "full").select("k", F.coalesce("l", "f").alias("v")), f"SELECT coalesce(f.k, l.k) AS k, coalesce(l.v, f.v) AS v FROM {values(sorted(_FALLBACK.items()), 'k, v')} f FULL JOIN {values(sorted(_LIVE.items()), 'k, v')} l ON l.k = f.k")


def snapshot_write(spark: SparkSession, sf: str) -> DataFrame:
    """The one row of a snapshot that passed its checks, written over the row before and read again."""
    path = own_path(spark, "snapshot")
    good = validated(spark.createDataFrame(_snapshots()[:1], SNAPSHOT))
    row = lambda rows: good.select(F.lit(1).cast("long").alias("id"), F.to_json(F.transform(rows, lambda r: F.struct(r["tell"].alias("tell"), r["dir"].alias("dir")))).alias("data"))
    for rows in (F.slice("trends", 1, 2), F.col("trends")):
        row(rows).coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("id long, data string").json(path)


add("snapshot_write", snapshot_write, f"WITH {_T} SELECT CAST(1 AS BIGINT) AS id, CAST(to_json(list({{'tell': tell, 'dir': dir}} ORDER BY ord)) AS VARCHAR) AS data FROM trends")

# --- board -------------------------------------------------------------------------------------------------

# What puts a tell on the punctuation or the structure shelf.
PUNCT = "dash|comma|semicolon|punctuat|parenthes"
STRUCTURE = "cadence|rhythm|rule of three|range|attribution|markdown|bold|bullet|opener|parallelism|sentence"


def category() -> F.Column:
    s = F.lower(F.concat("tell", F.lit(" "), F.coalesce("evidence", F.lit(""))))
    return F.when(s.rlike(PUNCT), "punct").when(s.rlike(STRUCTURE), "structure").otherwise("words")


_CAT = f"CASE WHEN regexp_matches(lower(tell || ' ' || coalesce(evidence, '')), '{PUNCT}') THEN 'punct' WHEN regexp_matches(lower(tell || ' ' || coalesce(evidence, '')), '{STRUCTURE}') THEN 'structure' ELSE 'words' END"
add("tell_category", lambda s, sf: _trends(s).select("tell", category().alias("cat")), f"WITH {_T} SELECT tell, {_CAT} AS cat FROM trends")


def board(trends: DataFrame, cat: str = "all", words: str = "") -> DataFrame:
    """The trends of a shelf whose tell, evidence or label holds the words, as they are."""
    text = F.lower(F.concat_ws(" ", "tell", F.coalesce("evidence", F.lit("")), label()))
    x = trends.where(F.contains(text, F.lit(words.lower().strip())))
    return x if cat == "all" else x.where(category() == cat)


add("board_filter", lambda s, sf: board(_trends(s), "structure", "Climb").select("tell", F.lit("a").alias("q")).unionByName(board(_trends(s), "all", "").select("tell", F.lit("b").alias("q"))), f"WITH {_T} SELECT tell, 'a' AS q FROM trends WHERE {_CAT} = 'structure' AND contains(lower(tell || ' ' || coalesce(evidence, '') || ' ' || {_LABEL}), 'climb') UNION ALL SELECT tell, 'b' FROM trends")
add("bar_share", lambda s, sf: s.createDataFrame(PHRASES, "ord int, label string, v double").select("label", F.round(F.col("v") / F.max("v").over(Window.partitionBy()) * 100, 1).alias("share")), f"SELECT label, round(v / max(v) OVER () * 100, 1) AS share FROM {values(PHRASES, 'ord, label, v')}")


def scores(spark: SparkSession) -> DataFrame:
    """tell, pos, score: a running sum from 50, up and down by 10, shown between 18 and 100; short histories are padded on the left."""
    x = folded(spark).where("ord < 6")
    padded = F.concat(F.array_repeat(F.lit("pad"), F.lit(12) - F.size("dirs")), F.col("dirs"))
    y = x.select("tell", F.posexplode(padded).alias("pos", "dir"))
    step = F.when(F.col("dir") == "rising", 10).when(F.col("dir") == "falling", -10).otherwise(0)
    run = F.lit(50) + F.sum(step).over(Window.partitionBy("tell").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return y.select("tell", F.col("pos").cast("long").alias("pos"), F.least(F.greatest(run, F.lit(18)), F.lit(100)).cast("long").alias("score"))


add("direction_score", lambda s, sf: scores(s), f"WITH {_FOLD}, p AS (SELECT tell, list_concat(list_transform(range(0, 12 - len(dirs)), lambda x: 'pad'), dirs) AS d FROM folded WHERE ord < 6), e AS (SELECT tell, i - 1 AS pos, d[i] AS dir FROM (SELECT tell, d, unnest(range(1, 13)) AS i FROM p)) SELECT tell, pos, CAST(least(greatest(50 + sum(CASE dir WHEN 'rising' THEN 10 WHEN 'falling' THEN -10 ELSE 0 END) OVER (PARTITION BY tell ORDER BY pos), 18), 100) AS BIGINT) AS score FROM e")
add("editions", lambda s, sf: upserted(s).where("place <= 6").select("iso", F.when(F.col("title").isNotNull(), F.concat_ws(" ", "title", "deck")).otherwise(F.array_join(F.slice("items", 1, 3), "; ")).alias("said")), f"WITH {_UP} SELECT iso, CASE WHEN title IS NOT NULL THEN concat_ws(' ', title, deck) ELSE coalesce(array_to_string(items[1:3], '; '), '') END AS said FROM up WHERE place <= 6")
add("home_rising", lambda s, sf: _trends(s).where("dir = 'rising'").orderBy("ord").limit(1).select("tell", F.when(label() != "rising", label()).otherwise(F.col("evidence")).alias("label")), f"WITH {_T} SELECT tell, CASE WHEN {_LABEL} <> 'rising' THEN {_LABEL} ELSE evidence END AS label FROM trends WHERE dir = 'rising' ORDER BY ord LIMIT 1")


def kind(posts: DataFrame, wanted: str) -> DataFrame:
    return posts.where(F.col("kind") == wanted) if wanted in ("week", "guide") else posts


add("kind_filter", lambda s, sf: kind(s.createDataFrame(POSTS, "slug string, kind string"), "guide").withColumn("q", F.lit("guide")).unionByName(kind(s.createDataFrame(POSTS, "slug string, kind string"), "odd").withColumn("q", F.lit("odd"))), f"SELECT slug, kind, 'guide' AS q FROM {values(POSTS, 'slug, kind')} WHERE kind = 'guide' UNION ALL SELECT slug, kind, 'odd' FROM {values(POSTS, 'slug, kind')}")
del dt
