"""Queries over drafts: text functions, rules, checker and fixer, each with the SQL that must agree.

A draft is a document with one of SNIPPETS after it, so that every rule has matches and near misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators import checker, fixer
from inkspan.operators import rules as R
from inkspan.tables import spread, table

SNIPPETS = [
    "It isn't just a chart, it's a habit. She said it’s not merely late, but missing.",
    "In today's fast-paced kitchens we cook. Let's dive into soup. Here's the kicker: salt.",
    "We delve into a tapestry of seamless, holistic plans; they leveraged and harnessed nothing. He delves into myriad of ideas.",
    "The bridge stands as a testament to patience. It plays a crucial role in shaping trade. A watershed moment.",
    "It's important to note that rain fell. Needless to say, we left. No discussion of tea is complete without milk.",
    "Experts say so. Studies show more. Many believe it, and researchers agree.",
    "Sales rose, highlighting the need for boots. Costs fell, underscoring our luck!",
    "In conclusion, we won. Overall, fine. At the end of the day it rained. So. Ultimately, yes.",
    "Great question! You're absolutely right. Would you like me to expand on that? Certainly! I hope this helps.",
    "While challenges remain in the north, both sides strike a balance. Whether you're a cook or not.",
    "It was creative, thoughtful and bold. It was festive, helpful, and famous. Active, vital, and cheerful.",
    "Here's the thing nobody said. Let that sink in. Plot twist: rain. Here's where it gets odd.",
    "Not a plan. Not a plan, but a wish that came true. It was late, not early. It isn't a map. It's a mirror.",
    "Short one. Then two. And three. Done. Gone. Over.",
    "one — two -- three --- four — five — six and — seven",
    "Curly ‘quotes’ and “doubles” — they’re kept. He said “stop.” Then he left. “Go!” she said.",
    "Tags <b>bold</b> & <a href='https://example.org/x?a=1&b=2' onclick=\"x()\">link</a> <A HREF=\"javascript:1\">bad</A> <a href=\"/home\">ok</a> <a>none</a>",
    "before {\"a\": {\"b\": 1}} middle {\"c\": 2} after",
    "From dawn to dusk, from tea to toast. We ran from the hills to the sea.",
    "A robust, vibrant myriad. A plethora of synergies unlock game-changing shifts; crucial, nuanced, stunning.",
    "One two three four five six. One two three four five six. One two three four five six. One two three four five six. One two three four five six. " * 4,
    "urlLink &nbsp; &amp; &#39;x\n***\nend of it\n\n\n\nnext   line\t\ttabbed",
    "This e-mail is for you. It is confidential and short.",
    "",
]
_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SNIPPETS) + "]"


def q(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def snippet(text) -> F.Column:
    """The snippet of a text, by its length: copies of a text get the same."""
    return F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.length(text) % len(SNIPPETS) + 1).cast("int"))


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "arm", "source", "text"))
    return d.select("doc_id", F.coalesce("arm", F.lit("none")).alias("arm"), F.concat("text", F.lit(" "), snippet(F.col("text"))).alias("text"))


_DRAFTS = f"drafts AS (SELECT doc_id, coalesce(arm, 'none') AS arm, text || ' ' || ({_LIST})[CAST(length(text) % {len(SNIPPETS)} + 1 AS INTEGER)] AS text FROM documents WHERE text IS NOT NULL)"
WITH = f"WITH RECURSIVE {_DRAFTS} "


# --- the same functions in SQL -----------------------------------------------------------------------------


def s_words(t: str) -> str:
    return f"len(regexp_extract_all({t}, {q(T.NOT_WS + '+')}))"


def s_straight(t: str) -> str:
    return f"""translate({t}, '‘’‛“”‟', '''''''"\"\"')"""


def s_dashes(t: str) -> str:
    return f"len(list_filter(regexp_extract_all({t}, '—|-+'), lambda m: m = '—' OR m = '--'))"


def s_lengths(t: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, {q(T.SENTENCE_END)}), lambda s: {s_words('s')}), lambda n: n > 0)"


def s_count(rule: R.Rule, t: str) -> str:
    return f"len(regexp_extract_all({t}, {q(rule.re2())}))"


def s_cv(x: str) -> str:
    m = f"list_avg({x})"
    return f"(CASE WHEN len({x}) = 0 THEN 0.0 ELSE sqrt(greatest(list_sum(list_transform({x}, lambda v: CAST(v AS DOUBLE) * v)) / len({x}) - {m} * {m}, 0.0)) / {m} END)"


def s_escape(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def s_collapse(t: str) -> str:
    return f"regexp_replace({t}, {q(T.WS + '+')}, ' ', 'g')"


def s_trim(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def s_even(lengths: str, words: str) -> str:
    return f"""CASE WHEN len({lengths}) >= 5 AND {words} >= 80 AND list_avg({lengths}) >= 5 AND {s_cv(lengths)} < 0.35
        THEN format('{{}} sentences, {{}} to {{}} words, mean {{}}', len({lengths}), list_min({lengths}), list_max({lengths}), CAST(floor(list_avg({lengths}) + 0.5) AS BIGINT)) END"""


def _spans_sql(t: str, pattern: str, i: int, rid: str, sev: int, keep: str = "true") -> str:
    """Spans of a pattern: the pieces between matches and the matches give the offsets."""
    h, p = f"regexp_extract_all({t}, {q(pattern)})", f"string_split_regex({t}, {q(pattern)})"
    return f"""SELECT doc_id, {i} AS ord, '{rid}' AS rule_id, {sev} AS sev, i - 1 AS idx, CAST(a AS BIGINT) AS "start", CAST(a + length(m) AS BIGINT) AS "end" FROM (
        SELECT doc_id, i, h[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS a
        FROM (SELECT doc_id, h, p, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, {h} AS h, {p} AS p FROM base))) WHERE {keep}"""


_BASE = f"base0 AS (SELECT doc_id, text, {s_straight('text')} AS straight, {s_words('text')} AS words, {s_dashes('text')} AS dashes FROM drafts)"
_RULE_SPANS = " UNION ALL ".join(_spans_sql("straight", r.re2(), i, r.id, r.sev).replace("FROM base)", "FROM base0)") for i, r in enumerate(R.RULES))
_DASHES = _spans_sql("text", "—|-+", len(R.RULES), "em_dash", 2, "m = '—' OR m = '--'").replace("FROM base)", "FROM (SELECT * FROM base0 WHERE dashes > greatest(1, words // 200)))")
_HITS = f"{_BASE}, rule_hits AS ({_RULE_SPANS}), hits AS (SELECT doc_id, ord, rule_id, sev, \"start\", \"end\" FROM rule_hits UNION ALL SELECT doc_id, ord, rule_id, sev, \"start\", \"end\" FROM ({_DASHES}))"
_KEPT = f"""{_HITS},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, ord) AS rn FROM hits),
    fold AS (SELECT doc_id, rn, "start", "end", ord, rule_id, sev, true AS keep, "end" AS last FROM ordered WHERE rn = 1
             UNION ALL
             SELECT o.doc_id, o.rn, o."start", o."end", o.ord, o.rule_id, o.sev, o."start" >= f.last, CASE WHEN o."start" >= f.last THEN o."end" ELSE f.last END
             FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1),
    kept AS (SELECT doc_id, "start", "end", ord, rule_id, sev FROM fold WHERE keep),
    cadence AS (SELECT doc_id, {s_even('l', 'words')} AS said FROM (SELECT doc_id, words, {s_lengths('text')} AS l FROM base0))"""


def _d(select):
    """A query that selects from drafts."""
    return lambda spark, sf: select(drafts(spark, sf))


Q: dict = {}
S: dict = {}


def add(name, fn, sql):
    Q[name] = fn
    if sql:
        S[name] = sql


add("word_count", _d(lambda d: d.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))), f"{WITH} SELECT doc_id, CAST({s_words('text')} AS BIGINT) AS words FROM drafts")
add("straighten", _d(lambda d: d.select("doc_id", T.straighten(F.col("text")).alias("straight"))), f"{WITH} SELECT doc_id, {s_straight('text')} AS straight FROM drafts")
_LONG = "repeat(text || ' ', CAST(60001 // (length(text) + 1) + 1 AS INTEGER))"
add("draft_truncate", _d(lambda d: d.select("doc_id", F.md5(T.draft_truncate(F.repeat(F.concat("text", F.lit(" ")), F.floor(F.lit(60001) / (F.length("text") + 1)).cast("int") + 1))).alias("digest"))),
    f"{WITH} SELECT doc_id, md5(CASE WHEN length(x) <= 60000 THEN x WHEN strpos(reverse(substr(x, 1, 60001)), ' ') BETWEEN 1 AND 60000 THEN substr(x, 1, 60001 - strpos(reverse(substr(x, 1, 60001)), ' ')) ELSE substr(x, 1, 60000) END) AS digest FROM (SELECT doc_id, {_LONG} AS x FROM drafts)")
add("em_dash_count", _d(lambda d: d.select("doc_id", T.em_dash_count(F.col("text")).cast("long").alias("dashes"))), f"{WITH} SELECT doc_id, CAST({s_dashes('text')} AS BIGINT) AS dashes FROM drafts")
add("sentence_lengths", _d(lambda d: d.select("doc_id", F.array_join(T.sentence_lengths(F.col("text")), ",").alias("lengths"))), f"{WITH} SELECT doc_id, coalesce(array_to_string({s_lengths('text')}, ','), '') AS lengths FROM drafts")
add("cadence_cv", _d(lambda d: d.withColumn("l", T.sentence_lengths(T.straighten(F.col("text")))).select("doc_id", F.round(T.cadence(F.col("l"))["cv"], 6).alias("cv"))), f"{WITH} SELECT doc_id, round({s_cv('l')}, 6) AS cv FROM (SELECT doc_id, {s_lengths(s_straight('text'))} AS l FROM drafts)")
add("even_cadence", _d(lambda d: d.withColumn("l", T.sentence_lengths(F.col("text"))).select("doc_id", T.even_cadence(F.col("l"), T.word_count(F.col("text"))).alias("said"))), f"{WITH} SELECT doc_id, {s_even('l', 'w')} AS said FROM (SELECT doc_id, {s_lengths('text')} AS l, {s_words('text')} AS w FROM drafts)")
add("norm_hash", _d(lambda d: d.select("doc_id", T.norm_hash(F.col("text")).alias("h"))), f"{WITH} SELECT doc_id, md5(lower({s_trim(s_collapse('text'))})) AS h FROM drafts")
add("dedupe_key", _d(lambda d: d.select("doc_id", T.dedupe_key(F.col("text")).alias("k"))), f"{WITH} SELECT doc_id, {s_collapse('lower(substr(text, 1, 300))')} AS k FROM drafts")


def s_latin(t: str) -> str:
    """The low bytes of a text as a blob."""
    return f"unhex(array_to_string(list_transform(string_split({t}, ''), lambda c: printf('%02x', CASE WHEN unicode(c) > 65535 THEN ((unicode(c) - 65536) >> 10) & 255 ELSE unicode(c) & 255 END)), ''))"


def s_repaired(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, 'Ã[\\x{{80}}-\\x{{bf}}]|â\\x{{80}}') THEN coalesce(TRY(decode({s_latin(t)})), {t}) ELSE {t} END"


def s_clean(t: str) -> str:
    """``t``: a text that is repaired already."""
    g = lambda x, p, to: f"regexp_replace({x}, {q(p)}, {to}, 'g')"
    t = g(t, r"&(nbsp|amp|lt|gt|quot|#\d+);", "' '")
    t = g(t, r"\burlLink\b", "''")
    t = g(t, rf"(?m)^{T.WS}*(?:\*{{3,}}|={{3,}}|_{{3,}})[^\n\r]*", "''")
    legal = r"(?is)This (?:e-?mail|message).{0,400}?(?:confidential|privileged).{0,400}$"
    t = f"regexp_replace({t}, {q(legal)}, '')"
    t = g(t, "[ \\t]+", "' '")
    return s_trim(g(t, "\\n{3,}", "E'\\n\\n'"))


add("clean_text", _d(lambda d: d.select("doc_id", T.clean_text(F.col("text")).alias("clean"))), f"{WITH} SELECT doc_id, {s_clean('t')} AS clean FROM (SELECT doc_id, {s_repaired('text')} AS t FROM drafts)")
add("demojibake", lambda spark, sf: table(spark, sf, "posts").where("text is not null").select("post_id", T.demojibake(F.col("text")).alias("text")), f"SELECT post_id, {s_repaired('text')} AS text FROM posts WHERE text IS NOT NULL")
add("html_escape", _d(lambda d: d.select("doc_id", T.html_escape(F.col("text")).alias("html"), T.attr_escape(F.col("text")).alias("attr"))), f"{WITH} SELECT doc_id, {s_escape('text')} AS html, replace({s_escape('text')}, '\"', '&quot;') AS attr FROM drafts")
add("sanitize_html", _d(lambda d: d.select("doc_id", T.sanitize_html(F.col("text")).alias("html"))), f"""{WITH}, cut AS (
    SELECT doc_id, string_split_regex(text, '<[^>]*>') AS p, regexp_extract_all(text, '<[^>]*>') AS g FROM drafts),
    bare AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(g) AND regexp_matches(g[i], {q(f'^</?a({T.WS}|>)')}) THEN g[i] ELSE '' END), '') AS t FROM cut),
    parts AS (SELECT doc_id, string_split_regex(t, {q(f'(?i)<a({T.WS}[^>]*)?>')}) AS p, regexp_extract_all(t, {q(f'(?i)<a(?:{T.WS}[^>]*)?>')}) AS g FROM bare),
    links AS (SELECT doc_id, p, list_transform(g, lambda x: {s_trim(f"regexp_replace(regexp_replace({s_trim(f'''regexp_extract(x, {q('(?i)href' + T.WS + '*=' + T.WS + '*(?:"[^"]*"|' + chr(39) + '[^' + chr(39) + ']*' + chr(39) + '|[^' + T.WS_SET + '>]+)')})''')}, {q(f'(?i)^href{T.WS}*={T.WS}*')}, ''), {q('^["' + chr(39) + ']|["' + chr(39) + ']$')}, '', 'g')")}) AS h FROM parts)
    SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(h) THEN '' WHEN regexp_matches(h[i], '(?i)^(https?://|mailto:|/|#)') THEN '<a href="' || replace({s_escape('h[i]')}, '"', '&quot;') || '" rel="noopener">' ELSE '<a>' END), '') AS html FROM links""")
add("json_extract", _d(lambda d: d.select("doc_id", T.json_extract(F.col("text")).alias("json"))), f"{WITH} SELECT doc_id, regexp_extract(text, '(?s)\\{{.*\\}}') AS json FROM drafts")
add("date_short", lambda spark, sf: table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct().select(F.col("d").cast("string").alias("d"), F.date_format("d", "MMM d").alias("short"), F.date_format("d", "EEE, dd MMM yyyy '12:00:00 GMT'").alias("rfc")), "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, strftime(CAST(ts AS DATE), '%b %-d') AS short, strftime(CAST(ts AS DATE), '%a, %d %b %Y 12:00:00 GMT') AS rfc FROM events")

for _r in [*R.RULES, R.RETIRED]:
    add(f"rule_{_r.id}", _d(lambda d, r=_r: d.select("doc_id", R.count(r, T.straighten(F.col("text"))).cast("long").alias("n"))), f"{WITH} SELECT doc_id, CAST({s_count(_r, s_straight('text'))} AS BIGINT) AS n FROM drafts")

add("src_rules", lambda spark, sf: R.relation(spark), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(a)}, {q(b)}, {c})" for i, (a, b, c) in enumerate([(r.id, r.label, r.sev) for r in R.RULES] + [R.EM_DASH_RULE, R.CADENCE_RULE])) + ") AS t(ord, rule_id, label, sev)")


def _exploded(col: str):
    def run(d: DataFrame) -> DataFrame:
        x = checker.checked(d).select("doc_id", F.explode_outer(col).alias("h")).where("h is not null")
        return x.select("doc_id", "h.rule_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), "h.sev")

    return _d(run)


add("hit_spans", _exploded("hits"), f'{WITH}, {_HITS} SELECT doc_id, rule_id, "start", "end", sev FROM hits')
add("hits_kept", _exploded("kept"), f'{WITH}, {_KEPT} SELECT doc_id, rule_id, "start", "end", sev FROM kept')


def hit_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each rule that the cap leaves in very repetitive drafts."""
    d = drafts(spark, sf).withColumn("text", F.concat("text", F.repeat(F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int")), 150)))
    x = checker.with_hits(d).select("doc_id", F.explode_outer("hits").alias("h")).where("h.rule_id <> 'em_dash'")
    return x.groupBy("doc_id", F.col("h.rule_id").alias("rule_id")).agg(F.count("*").alias("kept"))


add("hit_cap", hit_cap, f"""{WITH}, rep AS (SELECT doc_id, {s_straight(f"text || repeat(({_LIST})[CAST(doc_id % {len(SNIPPETS)} + 1 AS INTEGER)], 150)")} AS straight FROM drafts),
    c AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{r.id}' AS rule_id, CAST({s_count(r, 'straight')} AS BIGINT) AS n FROM rep" for i, r in enumerate(R.RULES))}),
    b AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM c)
    SELECT doc_id, rule_id, CASE WHEN b <= 400 THEN least(n, 401 - b) ELSE 1 END AS kept FROM b WHERE n > 0""")
add("em_dash_flag", _d(lambda d: d.select("doc_id", checker.dash_flag(F.col("text"), T.word_count(F.col("text"))).alias("flagged"))), f"{WITH}, {_BASE} SELECT doc_id, dashes > greatest(1, words // 200) AS flagged FROM base0")
add("fired_groups", _d(lambda d: checker.fired_groups(checker.checked(d), "doc_id").select("doc_id", "rule_id", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))), f"""{WITH}, {_KEPT},
    g AS (SELECT doc_id, rule_id, sev, count(*) AS n, min("start") AS first, 0 AS late FROM kept GROUP BY ALL UNION ALL SELECT doc_id, 'even_cadence', 2, 1, 0, 1 FROM cadence WHERE said IS NOT NULL)
    SELECT doc_id, rule_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY late, sev DESC, n DESC, first) AS rank FROM g""")
_TELLS = "tells AS (SELECT b.doc_id, b.words, coalesce(k.n, 0) AS tells, c.said IS NOT NULL AS even, length(b.text) > 60000 AS long FROM base0 b LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) k ON k.doc_id = b.doc_id JOIN cadence c ON c.doc_id = b.doc_id)"
_PL = lambda c, w: f"{c} || ' {w}' || CASE WHEN {c} = 1 THEN '' ELSE 's' END"
_SAID = f"""CASE WHEN tells > 0 THEN {_PL('tells', 'tell')} || ' in ' || {_PL('words', 'word')} || '.' || CASE WHEN even THEN ' The sentences are of nearly one length.' ELSE '' END
    WHEN even THEN 'No phrase stands out in ' || {_PL('words', 'word')} || ', but the cadence does.' ELSE 'Clean: none of {len(R.RULES) + 2} tells in ' || {_PL('words', 'word')} || '.' END
    || CASE WHEN long THEN ' Only the first ' || {_PL('words', 'word')} || ' of a long draft were read.' ELSE '' END"""
add("check_summary", _d(lambda d: checker.summary(checker.checked(d)).select("doc_id", F.col("tells").cast("long").alias("tells"), "message")), f"{WITH}, {_KEPT}, {_TELLS} SELECT doc_id, CAST(tells AS BIGINT) AS tells, {_SAID} AS message FROM tells")
add("tells_map", _d(lambda d: checker.checked(d).select("doc_id", F.explode_outer(checker.tells_map(d)).alias("rule_id", "n")).where("rule_id is not null").select("doc_id", "rule_id", F.col("n").cast("long").alias("n"))), f"{WITH}, {_KEPT} SELECT doc_id, rule_id, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT doc_id, 'even_cadence', 1 FROM cadence WHERE said IS NOT NULL")
add("mark_text", _d(lambda d: checker.checked(d).select("doc_id", checker.mark_text(F.col("text"), F.col("kept")).alias("html"))), f"""{WITH}, {_KEPT},
    seq AS (SELECT k.doc_id, k."start" AS a, k."end" AS z, coalesce(lag(k."end") OVER (PARTITION BY k.doc_id ORDER BY k."start"), 0) AS p FROM kept k),
    marked AS (SELECT s.doc_id, string_agg({s_escape('substr(b.text, s.p + 1, s.a - s.p)')} || '<mark>' || {s_escape('substr(b.text, s.a + 1, s.z - s.a)')} || '</mark>', '' ORDER BY s.a) AS m, max(s.z) AS z FROM seq s JOIN base0 b ON b.doc_id = s.doc_id GROUP BY s.doc_id)
    SELECT b.doc_id, replace(coalesce(m.m, '') || {s_escape('substr(b.text, coalesce(m.z, 0) + 1)')}, chr(10), '<br>') AS html FROM base0 b LEFT JOIN marked m ON m.doc_id = b.doc_id""")


# --- fixer -------------------------------------------------------------------------------------------------


def _chain(t0: str, steps: list[tuple[str, str]], source: str, tag: str) -> tuple[str, str, str]:
    """CTEs that apply replacements one after the other with a running count; (ctes, last name, source columns)."""
    ctes, prev = [], source
    for i, (p, to) in enumerate(steps):
        ctes.append(f"{tag}{i} AS MATERIALIZED (SELECT doc_id, regexp_replace(t, {q(p)}, {q(to)}, 'g') AS t, n + len(regexp_extract_all(t, {q(p)})) AS n FROM {prev})")
        prev = f"{tag}{i}"
    return ", ".join(ctes), prev, t0


_CUT, _CUT_LAST, _ = _chain("t", [("(?i)" + fixer.dialect(p, False), "") for p in fixer.PHRASE_CUTS], "start", "c")
_START = "start AS (SELECT doc_id, text AS t, 0 AS n FROM drafts)"


def _swap_sql(source: str) -> tuple[str, str]:
    """All swaps: groups of forms that cannot meet are applied in one statement each, in the listed order."""
    ctes, prev = [], source
    for k, (p, to) in enumerate(fixer._steps(False)):
        ctes.append((p, to, k))
    chunks, out = [ctes[i : i + 8] for i in range(0, len(ctes), 8)], []
    for j, chunk in enumerate(chunks):
        t, n, layers = "t", [], prev
        for p, to, k in chunk:
            layers = f"(SELECT doc_id, regexp_replace(t, {q(p)}, {q(to)}, 'g') AS t, n + len(regexp_extract_all(t, {q(p)})) AS n FROM {layers})"
        out.append(f"w{j} AS MATERIALIZED (SELECT * FROM {layers})")
        prev = f"w{j}"
    return ", ".join(out), prev


_SWAP, _SWAP_LAST = _swap_sql("start")
_SWAP2, _ = _swap_sql(_CUT_LAST)


def s_dashed(source: str) -> str:
    """doc_id, t, n with dashes fixed: matches of '—|-+' with the blanks around them, where '—' and '--' become commas."""
    pat = q(f"{T.WS}*—{T.WS}*|{T.WS}*--+{T.WS}*")
    return f"""(SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(g) THEN '' WHEN regexp_matches(g[i], '---') THEN g[i] ELSE ', ' END), '') AS t,
        n + len(list_filter(g, lambda m: NOT regexp_matches(m, '---'))) AS n FROM (SELECT doc_id, n, string_split_regex(t, {pat}) AS p, regexp_extract_all(t, {pat}) AS g FROM {source}))"""


def s_cleanup(t: str) -> str:
    t = f"regexp_replace({t}, {q(f',{T.WS}*,')}, ',', 'g')"
    t = f"regexp_replace({t}, {q(rf'([.!?]){T.WS}*,{T.WS}*')}, '\\1 ', 'g')"
    return f"regexp_replace({t}, {q(f'{T.WS}{{2,}}')}, ' ', 'g')"


def s_capital(t: str) -> str:
    """A capital at the start of the text and after each sentence."""
    pat = q(f"[.!?]{T.WS}")
    return f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN regexp_matches(p[i], '^[a-z]') THEN upper(p[i][1:1]) || p[i][2:] ELSE p[i] END || CASE WHEN i <= len(g) THEN g[i] ELSE '' END), '') FROM (SELECT string_split_regex({t}, {pat}) AS p, regexp_extract_all({t}, {pat}) AS g))"


add("phrase_cuts", _d(lambda d: fixer.cut_phrases(d, "text").select("doc_id", "text", F.col("n_cuts").cast("long").alias("n"))), f"{WITH}, {_START}, {_CUT} SELECT doc_id, t AS text, CAST(n AS BIGINT) AS n FROM {_CUT_LAST}")
add("word_fixes", _d(lambda d: fixer.swap_words(d, "text").select("doc_id", "text", F.col("n_swaps").cast("long").alias("n"))), f"{WITH}, {_START}, {_SWAP} SELECT doc_id, t AS text, CAST(n AS BIGINT) AS n FROM {_SWAP_LAST}")
add("dash_fix", _d(lambda d: fixer.fix_dashes(d, "text").select("doc_id", "text", F.col("n_dashes").cast("long").alias("n"))), f"{WITH}, {_START} SELECT doc_id, t AS text, CAST(n AS BIGINT) AS n FROM {s_dashed('start')}")
add("fix_cleanup", _d(lambda d: d.select("doc_id", fixer.cleanup(F.col("text")).alias("text"))), f"{WITH}, cleaned AS (SELECT doc_id, {s_cleanup('text')} AS t FROM drafts) SELECT doc_id, {s_capital('t')} AS text FROM cleaned")
add("apply_fixes", _d(lambda d: fixer.apply_fixes(d).select("doc_id", "text", F.col("n_changes").cast("long").alias("n"))), f"{WITH}, {_START}, {_CUT}, {_SWAP2}, cleaned AS (SELECT doc_id, n, {s_cleanup('t')} AS t FROM {s_dashed(_SWAP_LAST)}) SELECT doc_id, {s_capital('t')} AS text, CAST(n AS BIGINT) AS n FROM cleaned")
