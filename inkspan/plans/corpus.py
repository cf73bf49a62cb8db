"""Queries of the corpus study, of collection and generation, and of sources, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions import textfn as T
from inkspan.operators import collect, study
from inkspan.operators import rules as R
from inkspan.plans.drafts import WITH, drafts, q, s_clean, s_collapse, s_count, s_cv, s_dashes, s_latin, s_lengths, s_repaired, s_straight, s_trim, s_words
from inkspan.sources.files import decoded, read_csv, read_texts, stream_csv, walk
from inkspan.tables import bounded_rows, cut, own_path, put, spread, table

Q: dict = {}
S: dict = {}


def add(name, fn, sql):
    Q[name] = fn
    if sql:
        S[name] = sql


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return drafts(spark, sf).where(T.word_count(F.col("text")) >= study.MIN_WORDS)


_MEASURES = ["words", *[f"n_{r}" for r in study.RULE_IDS], "sentences", "mean_sentence", "cv"]


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    """The study's documents, long enough and the first of each text in its arm, measured in one scan and written once."""
    return cut(study.dedupe(study.measure(_long(spark, sf)), _MEASURES))


_NORM = f"md5(lower({s_trim(s_collapse('text'))}))"
_LONG = f"long_docs AS (SELECT * FROM drafts WHERE {s_words('text')} >= 100)"
_KEPT = f"{_LONG}, docs AS (SELECT doc_id, arm, text FROM (SELECT *, row_number() OVER (PARTITION BY arm, {_NORM} ORDER BY doc_id) AS rn FROM long_docs) WHERE rn = 1)"
_MEASURED = f"""{_KEPT}, straight AS (SELECT doc_id, arm, text, {s_straight('text')} AS s FROM docs),
    measured AS (SELECT doc_id, arm, CAST({s_words('text')} AS BIGINT) AS words, {", ".join(f"CAST({s_count(r, 's')} AS BIGINT) AS n_{r.id}" for r in R.RULES)}, CAST({s_dashes('s')} AS BIGINT) AS n_em_dash, {s_lengths('s')} AS l FROM straight)"""
_LONGFORM = "long_counts AS (" + " UNION ALL ".join(f"SELECT doc_id, arm, words, '{r}' AS rule_id, n_{r} AS n FROM measured" for r in study.RULE_IDS) + ")"
_RATES = f"{_MEASURED}, {_LONGFORM}, rates AS (SELECT arm, rule_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS words, CASE WHEN sum(words) > 0 THEN sum(n) / sum(words) * 1000 ELSE 0.0 END AS rate FROM long_counts GROUP BY ALL)"
_BOOT = f"""{_RATES}, summed AS (SELECT arm, rep, sum(k * words) AS words, {", ".join(f"sum(k * n_{r}) AS n_{r}" for r in study.RULE_IDS)} FROM (SELECT arm, rep, {study.draws('doc_id', 'rep')} AS k, words, {", ".join(f"n_{r}" for r in study.RULE_IDS)} FROM measured, range(0, {study.REPLICATES}) AS r(rep)) GROUP BY arm, rep),
    each_rate AS ({" UNION ALL ".join(f"SELECT arm, rep, '{r}' AS rule_id, CASE WHEN words > 0 THEN n_{r} / words * 1000 ELSE 0.0 END AS rate FROM summed" for r in study.RULE_IDS)}),
    ranked AS (SELECT arm, rule_id, rate, row_number() OVER (PARTITION BY arm, rule_id ORDER BY rate) AS rn FROM each_rate),
    ci AS (SELECT arm, rule_id, max(CASE WHEN rn = 51 THEN rate END) AS lo, max(CASE WHEN rn = 1951 THEN rate END) AS hi FROM ranked GROUP BY ALL)"""

add("min_words_filter", lambda s, sf: drafts(s, sf).where(T.word_count(F.col("text")) >= study.MIN_WORDS).select("doc_id"), f"{WITH}, {_LONG} SELECT doc_id FROM long_docs")
add("study_dedupe", lambda s, sf: study.dedupe(_long(s, sf), []).select("doc_id", "arm"), f"{WITH}, {_KEPT} SELECT doc_id, arm FROM docs")
add("doc_measure", lambda s, sf: _measured(s, sf).select("doc_id", F.col("words").cast("long"), *[F.col(f"n_{r}").cast("long").alias(f"n_{r}") for r in study.RULE_IDS], F.col("sentences").cast("long"), F.round("mean_sentence", 6).alias("mean_sentence"), F.round("cv", 6).alias("cv")),
    f"{WITH}, {_MEASURED} SELECT doc_id, words, {', '.join(f'n_{r}' for r in study.RULE_IDS)}, CAST(len(l) AS BIGINT) AS sentences, round(coalesce(list_avg(l), 0), 6) AS mean_sentence, round({s_cv('l')}, 6) AS cv FROM measured")
add("arm_totals", lambda s, sf: study.totals(_measured(s, sf)).select("arm", "documents", "words", (F.col("documents") < study.MIN_DOCS).alias("thin")), f"{WITH}, {_MEASURED} SELECT arm, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, count(*) < 20 AS thin FROM measured GROUP BY arm")
add("rule_rates", lambda s, sf: study.rates(_measured(s, sf)).select("arm", "rule_id", "n", "words", F.round("rate", 6).alias("rate")), f"{WITH}, {_RATES} SELECT arm, rule_id, n, words, round(rate, 6) AS rate FROM rates")
add("bootstrap_ci", lambda s, sf: study.bootstrap(_measured(s, sf)).select("arm", "rule_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")), f"{WITH}, {_BOOT} SELECT arm, rule_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")
add("mean_cadence", lambda s, sf: _measured(s, sf).groupBy("arm").agg(F.round(F.avg("cv"), 6).alias("cv")), f"{WITH}, {_MEASURED} SELECT arm, round(avg({s_cv('l')}), 6) AS cv FROM measured GROUP BY arm")


def separation(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf)
    ci = study.bootstrap(m).join(study.totals(m).select("arm", "documents"), "arm")
    return study.separation(ci, "ai", "human")


add("separation", separation, f"""{WITH}, {_BOOT}, t AS (SELECT arm, count(*) AS documents FROM measured GROUP BY arm)
    SELECT a.rule_id, CASE WHEN ta.documents < 20 OR tb.documents < 20 THEN 'suppressed' WHEN a.lo > b.hi OR b.lo > a.hi THEN 'separated' ELSE 'none' END AS verdict
    FROM ci a JOIN ci b ON a.rule_id = b.rule_id AND a.arm = 'ai' AND b.arm = 'human' JOIN t ta ON ta.arm = 'ai' JOIN t tb ON tb.arm = 'human'""")
#: The arms of the study as they are set up; one has no document yet.
ARMS = ["ai", "human", "medium", "none", "pending"]
add("empty_arm_guard", lambda s, sf: study.empty_arms(s.createDataFrame([(a,) for a in ARMS], "arm string"), _measured(s, sf)),
    f"{WITH}, {_MEASURED} SELECT arm, 'no document left: lower the word limit or add texts' AS advice FROM (SELECT unnest({ARMS}) AS arm) WHERE arm NOT IN (SELECT arm FROM measured)")


def rated(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf)
    return study.rates(m).join(study.bootstrap(m), ["arm", "rule_id"])


def rate_table(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    cell = F.concat(two("rate"), F.lit(" ["), two("lo"), F.lit("-"), two("hi"), F.lit("]"))
    return rated(spark, sf).groupBy("rule_id").pivot("arm", ["ai", "human", "medium"]).agg(F.first(cell))


def study_json(spark: SparkSession, sf: str) -> DataFrame:
    """The study's result as one JSON text: arms with documents, words and the rate and interval of each rule, and the rules."""
    m = _measured(spark, sf)
    r = study.rates(m).join(study.bootstrap(m), ["arm", "rule_id"])
    two = lambda c: F.format_string("%.2f", F.round(c, 2)).alias(c)
    by_arm = r.groupBy("arm").agg(F.sort_array(F.collect_list(F.struct("rule_id", F.struct(two("rate"), two("lo"), two("hi")).alias("v")))).alias("rates"))
    x = study.totals(m).select("arm", "documents", "words").join(by_arm, "arm")
    one = lambda a: F.struct(a["arm"], F.struct(a["documents"].alias("documents"), a["words"].alias("words"), F.map_from_entries(a["rates"]).alias("rates")))
    arms = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("arm", "documents", "words", "rates"))), one))
    return x.agg(arms.alias("arms")).select(F.to_json(F.struct("arms", F.array(*[F.lit(r) for r in study.RULE_IDS]).alias("rules"))).alias("json"))


_CELLS = f"{_BOOT}, cells AS (SELECT r.arm, r.rule_id, printf('%.2f', round(r.rate, 2)) AS rate, printf('%.2f', round(c.lo, 2)) AS lo, printf('%.2f', round(c.hi, 2)) AS hi FROM rates r JOIN ci c ON r.arm = c.arm AND r.rule_id = c.rule_id)"
add("rate_table", rate_table, f"{WITH}, {_CELLS} SELECT rule_id, " + ", ".join(f"max(CASE WHEN arm = '{a}' THEN rate || ' [' || lo || '-' || hi || ']' END) AS {a}" for a in ("ai", "human", "medium")) + " FROM cells GROUP BY rule_id")
_JSON_RATE = """'"' || rule_id || '":{"rate":"' || rate || '","lo":"' || lo || '","hi":"' || hi || '"}'"""
_JSON_ARM = """'"' || t.arm || '":{"documents":' || documents || ',"words":' || words || ',"rates":{' || rates || '}}'"""
_RULES_JSON = "[" + ",".join(f'"{r}"' for r in study.RULE_IDS) + "]"
add("study_json", study_json, f"""{WITH}, {_CELLS}, t AS (SELECT arm, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words FROM measured GROUP BY arm),
    j AS (SELECT arm, string_agg({_JSON_RATE}, ',' ORDER BY rule_id) AS rates FROM cells GROUP BY arm)
    SELECT '{{"arms":{{' || string_agg({_JSON_ARM}, ',' ORDER BY t.arm) || '}},"rules":{_RULES_JSON}}}' AS json FROM t JOIN j ON t.arm = j.arm""")
add("provenance_missing", lambda s, sf: collect.missing(table(s, sf, "documents").where("file is not null").select("file").distinct(), table(s, sf, "human_manifest").where("file is not null"), "file"), "SELECT DISTINCT file FROM documents d WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM human_manifest m WHERE m.file = d.file)")
add("src_manifest", lambda s, sf: collect.missing(table(s, sf, "ai_texts").select("file"), table(s, sf, "ai_manifest").where("file is not null"), "file"), "SELECT file FROM ai_texts t WHERE NOT EXISTS (SELECT 1 FROM ai_manifest m WHERE m.file = t.file)")

# --- collection --------------------------------------------------------------------------------------------

BEFORE = "2018-01-01"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "posts").select(F.col("post_id").alias("pos"), "file", "date", "source", "text"))


def _considered(spark: SparkSession, sf: str) -> DataFrame:
    return collect.considered(_raw(spark, sf))


def _before(spark: SparkSession, sf: str) -> DataFrame:
    return collect.considered(_raw(spark, sf), BEFORE, table(spark, sf, "sources"))


_CONS = f"""raw AS (SELECT post_id AS pos, file, date, {s_clean('t')} AS clean FROM (SELECT *, {s_repaired("coalesce(text, '')")} AS t FROM posts)),
    counted AS (SELECT *, {s_words('clean')} AS words, {s_collapse('lower(substr(clean, 1, 300))')} AS key FROM raw),
    cons AS (SELECT pos, file, date, clean, words, CASE WHEN w0 IS NULL AND row_number() OVER (PARTITION BY key, w0 IS NULL ORDER BY pos) > 1 THEN 'dupe' ELSE w0 END AS why
             FROM (SELECT *, CASE WHEN words NOT BETWEEN 100 AND 2500 THEN 'length' END AS w0 FROM counted))"""

# Dates come in too many forms for SQL: the two queries with a cut-off are held against a plain reading on a small fixture instead.
add("date_cutoff", lambda s, sf: _before(s, sf).where("why = 'date'").select("pos"), None)
add("collect_counters", lambda s, sf: collect.counters(_before(s, sf)), None)
add("collector_dedupe", lambda s, sf: _considered(s, sf).where("why = 'dupe'").select("pos"), f"WITH {_CONS} SELECT pos FROM cons WHERE why = 'dupe'")
add("per_file_cap", lambda s, sf: collect.per_file_cap(_considered(s, sf).where("why is null")).select("pos", "file"), f"WITH {_CONS} SELECT pos, file FROM (SELECT pos, file, row_number() OVER (PARTITION BY file ORDER BY pos) AS rn FROM cons WHERE why IS NULL) WHERE rn <= 2 OR file IS NULL OR regexp_matches(lower(file), '\\.(csv|jsonl)$')")
add("collect_summary", lambda s, sf: collect.summary(_considered(s, sf)), f"WITH {_CONS} SELECT count(*) AS written, CAST(sum(words) AS BIGINT) AS words, list_sort(list(CAST(words AS BIGINT)))[count(*) // 2 + 1] AS upper_median FROM cons WHERE why IS NULL HAVING count(*) > 0")
_DRAW = lambda x: x.where("why is null").withColumn("_k", F.md5(F.concat(F.lit("7:"), F.col("pos").cast("string")))).orderBy("_k").limit(40)
add("reservoir_sample", lambda s, sf: _DRAW(_considered(s, sf)).select("pos"), f"WITH {_CONS} SELECT pos FROM cons WHERE why IS NULL ORDER BY md5('7:' || CAST(pos AS VARCHAR)) LIMIT 40")


def sink_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of the collected posts written as files with a manifest, twice, and read again: what is there is not written again."""
    folder = own_path(spark, "corpus")
    drawn = _DRAW(_considered(spark, sf)).select("pos", "date")
    docs = cut(_raw(spark, sf).select("pos", "text").join(F.broadcast(drawn), "pos").select("pos", T.clean_text(F.col("text")).alias("text"), "date"))
    for _ in range(2):
        collect.write_corpus(docs, folder, "posts", "collected before", "2018")
    return collect.read_corpus(spark, folder)


add("sink_corpus", sink_corpus, f"""WITH {_CONS}, drawn AS (SELECT * FROM cons WHERE why IS NULL ORDER BY md5('7:' || CAST(pos AS VARCHAR)) LIMIT 40)
    SELECT 'posts__' || lpad(CAST(row_number() OVER (ORDER BY pos) AS VARCHAR), 3, '0') || '.txt' AS file, replace(clean, E'\\r\\n', E'\\n') || E'\\n' AS text, coalesce(nullif(substr(date, 1, 10), ''), '2018') AS date, 'collected before' AS why_known_human FROM drawn""")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ai_manifest").where("genre is not null and prompt is not null").groupBy("genre").agg(F.sort_array(F.collect_set("prompt")).alias("prompts"))


_GRID = "grid AS (SELECT 'own__' || genre || '__' || lpad(CAST(i AS VARCHAR), 2, '0') AS file, genre, p[i] AS prompt FROM (SELECT genre, p, unnest(range(1, least(len(p), 8) + 1)) AS i FROM (SELECT genre, list_sort(list(DISTINCT prompt)) AS p FROM ai_manifest WHERE genre IS NOT NULL AND prompt IS NOT NULL GROUP BY genre)))"
add("gen_grid", lambda s, sf: collect.grid(_prompts(s, sf), 8, "own"), f"WITH {_GRID} SELECT file, genre, prompt FROM grid")
add("gen_resume", lambda s, sf: collect.missing(table(s, sf, "ai_manifest").where("file is not null").select("file", "genre").distinct(), table(s, sf, "ai_texts"), "file"), "SELECT DISTINCT file, genre FROM ai_manifest m WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ai_texts t WHERE t.file = m.file)")
add("manifest_profile", lambda s, sf: table(s, sf, "ai_manifest").distinct().groupBy("genre", "model").agg(F.count("*").alias("documents"), F.sum("words").cast("long").alias("words")), "SELECT genre, model, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words FROM (SELECT DISTINCT * FROM ai_manifest) GROUP BY genre, model")

# --- sources -----------------------------------------------------------------------------------------------


def src_maildir(spark: SparkSession, sf: str) -> DataFrame:
    """The body of each mail without quotes and forwarded blocks; a mail without an empty line gives none."""
    from inkspan.sources.files import mail_body

    return table(spark, sf, "mails").where(F.col("text").contains("\n\n")).select("mail_id", mail_body(F.col("text")).alias("body"))


def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Text of the JSON rows, the first known key that holds a string; other rows are skipped."""
    from inkspan.sources.files import json_text

    return json_text(table(spark, sf, "raw_rows").where("fmt = 'jsonl'"), "raw_row").select("row_id", "text")


def src_blogger_xml(spark: SparkSession, sf: str) -> DataFrame:
    from inkspan.sources.files import blog_posts

    d = table(spark, sf, "documents").where("text is not null")
    xml = F.concat(F.lit("<Blog><date>1</date><post>"), F.col("text"), F.lit("</post>\n<date>2</date><post>"), F.coalesce("source", F.lit("")), F.lit("</post></Blog>"))
    return d.select("doc_id", F.posexplode(blog_posts(xml)).alias("n", "post")).select("doc_id", F.col("n").cast("long").alias("n"), "post")


_B = "substr(text, strpos(text, E'\\n\\n') + 2)"
_HEAD = lambda x, p: f"string_split_regex({x}, {q(p)})[1]"
_BODY = _HEAD(_HEAD(_HEAD(_B, rf"(?mi)^-+{T.WS}*Original Message{T.WS}*-+$"), rf"(?mi)^-+{T.WS}*Forwarded by"), rf"(?mi)^{T.WS}*To:{T.WS}[^\n\r]*\n{T.WS}*cc:")
add("src_maildir", src_maildir, f"SELECT mail_id, regexp_replace({_BODY}, {q(rf'(?m)^{T.WS}*>[^\n\r]*')}, '', 'g') AS body FROM mails WHERE strpos(text, E'\\n\\n') > 0")
add("src_jsonl", src_jsonl, "SELECT row_id, text FROM (SELECT row_id, coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN json_extract_string(j, '$.{k}') END" for k in ("text", "body", "content", "post", "article")) + ") AS text FROM (SELECT row_id, CASE WHEN json_valid(raw_row) THEN CAST(raw_row AS JSON) END AS j FROM raw_rows WHERE fmt = 'jsonl')) WHERE text IS NOT NULL")
add("src_blogger_xml", src_blogger_xml, "SELECT doc_id, i - 1 AS n, p[i] AS post FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all('<Blog><date>1</date><post>' || text || E'</post>\\n<date>2</date><post>' || coalesce(source, '') || '</post></Blog>', '(?s)<post>(.*?)</post>', 1) AS p FROM documents WHERE text IS NOT NULL))")


def _items(spark: SparkSession, sf: str, latin: bool = False) -> str:
    """The held-out items (a fixed table) as files of several kinds in nested folders of the shared folder; half of them in Latin-1 if asked for."""
    folder = own_path(spark, "files")
    for r in bounded_rows(table(spark, sf, "eval_items").where("text is not null"), 10_000, "items"):
        kind = (".txt", ".MD", ".log")[r.item_id % 3]
        text = f"été n° {r.item_id}: " + r.text
        put(spark, f"{folder}/{r.item_id % 4}/item{r.item_id:06d}{kind}", text.encode("latin-1", "replace") if latin and r.item_id % 2 else text.encode())
    return folder


_NAME = "'item' || lpad(CAST(item_id AS VARCHAR), 6, '0') || (['.txt', '.MD', '.log'])[CAST(item_id % 3 + 1 AS INTEGER)]"
_TEXT = "'été n° ' || item_id || ': ' || text"
name = lambda: F.element_at(F.split("path", "/"), -1).alias("name")


def src_walk(spark: SparkSession, sf: str) -> DataFrame:
    return walk(spark, _items(spark, sf)).select(name(), "length")


def src_textmd(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, _items(spark, sf)).select(name(), "text")


def src_text(spark: SparkSession, sf: str) -> DataFrame:
    """The .txt files in the order of their names."""
    x = read_texts(spark, _items(spark, sf)).where(F.lower("path").endswith(".txt")).select(name(), "text")
    return x.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long"))


def src_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of two encodings: those that are no sound UTF-8 are Latin-1."""
    latin = (F.col("post_id") % 2 == 1) & F.col("text").rlike(r"^[\x{0}-\x{ff}]*+$")
    x = table(spark, sf, "posts").where("text is not null").select("post_id", F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("b"))
    return x.select("post_id", decoded(F.col("b")).alias("text"))


def _csv_folder(spark: SparkSession, sf: str) -> str:
    """All posts as csv files with a header of which two columns could hold the text."""
    folder = own_path(spark, "csv")
    x = table(spark, sf, "posts").select("post_id", F.col("text").alias(" Body "), F.lit("no text").alias("content"), F.col("date").alias("Published"))
    x.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(folder)
    return folder


def _csv_rows(x: DataFrame) -> DataFrame:
    return x.groupBy("text", "date").agg(F.count("*").alias("n"))


def csv_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from a stream of csv files, appended to files as they come."""
    out = own_path(spark, "rows")
    x = stream_csv(spark, _csv_folder(spark, sf))
    x.writeStream.format("parquet").option("path", out).option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return _csv_rows(spark.read.schema(x.schema).parquet(out))


add("src_walk", src_walk, f"SELECT {_NAME} AS name, CAST(octet_length(encode({_TEXT})) AS BIGINT) AS length FROM eval_items WHERE text IS NOT NULL")
add("src_textmd", src_textmd, f"SELECT {_NAME} AS name, {_TEXT} AS text FROM eval_items WHERE text IS NOT NULL AND item_id % 3 < 2")
add("src_text", src_text, f"SELECT {_NAME} AS name, {_TEXT} AS text, row_number() OVER (ORDER BY {_NAME}) AS place FROM eval_items WHERE text IS NOT NULL AND item_id % 3 = 0")
add("src_decode", src_decode, f"SELECT post_id, CASE WHEN post_id % 2 = 1 AND regexp_full_match(text, '[\\x{{0}}-\\x{{ff}}]*') AND text <> '' THEN coalesce(TRY(decode({s_latin('text')})), text) ELSE text END AS text FROM posts WHERE text IS NOT NULL")
_CSV_SQL = "SELECT nullif(replace(text, chr(13), ''), '') AS text, nullif(date, '') AS date, count(*) AS n FROM posts GROUP BY ALL"
add("src_csv", lambda s, sf: _csv_rows(read_csv(s, _csv_folder(s, sf))), _CSV_SQL)
add("csv_stream", csv_stream, _CSV_SQL)
