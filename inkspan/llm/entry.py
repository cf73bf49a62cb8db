"""The queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import encoding, leak, mail, mix, pairs, pii, quality, sample
from inkspan.tables import table


def _noted(spark: SparkSession, sf: str) -> DataFrame:
    """file, words, n_words of the generated texts with a noted length."""
    noted = table(spark, sf, "ai_manifest").where("words is not null").select("file", "words").distinct()
    return noted.join(table(spark, sf, "ai_texts").select("file", quality.word_count(F.col("text")).alias("n_words")), "file")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that are no natural prose with their kind, and generated texts whose noted length is wrong."""
    common = quality.common_list(table(spark, sf, "common_words"))
    case = quality.learn(spark, table(spark, sf, "ai_texts"), "file", "text", common)
    posts = quality.kinds(table(spark, sf, "posts").select("post_id", "text"), "text", case, common)
    wrong = _noted(spark, sf).where("words <> n_words").select(F.col("file").alias("rec"), F.lit("words").alias("finding"))
    found = posts.select(F.col("post_id").cast("string").alias("rec"), F.explode_outer(F.array("kind")).alias("finding")).where("finding is not null")
    return found.unionByName(wrong.distinct())


def p1_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-post statistics, shares to six places."""
    x = quality.with_statistics(table(spark, sf, "posts").select("post_id", "text"), "text", quality.common_list(table(spark, sf, "common_words")))
    return x.select("post_id", *[F.col(f).cast("long").alias(f) if f in quality.COUNTS else F.round(f, 6).alias(f) for f in quality.FEATURES])


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every post with its kind, null for prose, as the learnt rules say."""
    common = quality.common_list(table(spark, sf, "common_words"))
    case = quality.learn(spark, table(spark, sf, "ai_texts"), "file", "text", common)
    return quality.kinds(table(spark, sf, "posts").select("post_id", "text"), "text", case, common).select("post_id", "kind")


def p1_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Noted and counted words of every generated text."""
    return _noted(spark, sf).select("file", F.col("words").cast("long").alias("noted"), F.col("n_words").cast("long").alias("counted"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    posts = table(spark, sf, "posts").select(F.lit("posts").alias("tbl"), F.col("post_id").cast("string").alias("rec"), F.lit("text").alias("field"), F.col("text").alias("body"))
    human = table(spark, sf, "human_manifest").select("file", "source", "why_known_human").distinct()
    human = human.select(F.lit("human_manifest").alias("tbl"), F.col("file").alias("rec"), F.expr("stack(2, 'source', source, 'why_known_human', why_known_human) as (field, body)"))
    return posts.unionByName(human).where("body is not null")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The records with characters that came out wrong by a wrong decoding."""
    return encoding.garbled(_bodies(spark, sf))[0].select("tbl", "rec").distinct()


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The affected fields as their author wrote them; ``whole`` is false where something stays lost."""
    return encoding.restore(_bodies(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every broken prompt and response pair with its defect."""
    both = table(spark, sf, "ai_manifest").select("file", "prompt").where("file is not null").groupBy("file").agg(F.min("prompt").alias("prompt"))
    return pairs.broken_pairs(both.join(table(spark, sf, "ai_texts").select("file", "text"), "file"), table(spark, sf, "common_words"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lines newly written by each mail's sender."""
    return mail.label_lines(table(spark, sf, "mails")).where("label = 'new'").select("mail_id", "line_no")


def p6_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each mail's newly written text; a mail without any has an empty one."""
    return mail.new_texts(table(spark, sf, "mails"))


#: Size of the sample of posts.
SAMPLE_SIZE = 1000


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SAMPLE_SIZE posts, or all if there are fewer, each with the same chance."""
    posts = table(spark, sf, "posts").select("post_id", "piece", "file", "text")
    return sample.draw(posts, SAMPLE_SIZE, "post_id").select("post_id", "piece", "file", "text", "sample_key")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """How many posts of each piece are in the sample, beside the piece's size."""
    posts = table(spark, sf, "posts").select("post_id", "piece")
    drawn = sample.draw(posts, SAMPLE_SIZE, "post_id").groupBy("piece").agg(F.count("*").alias("sampled"))
    return posts.groupBy("piece").agg(F.count("*").alias("posts")).join(drawn, "piece", "left").select("piece", "posts", F.coalesce("sampled", F.lit(0)).alias("sampled"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that contain held-out passages and the items that leaked into each."""
    found = leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.where(F.col("coverage") >= leak.ENOUGH - 1e-9).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked stretch with its coverage and its place."""
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).drop("run")


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without any leaked stretch."""
    return leak.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents with their number of uses."""
    targets = table(spark, sf, "mix_targets")
    return mix.mix(mix.counted_documents(table(spark, sf, "documents"), targets), targets)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source really reached."""
    targets = table(spark, sf, "mix_targets")
    return mix.shares(mix.mix(mix.counted_documents(table(spark, sf, "documents"), targets), targets), targets)


def _names(spark: SparkSession, sf: str):
    return pii.learn_names(table(spark, sf, "documents").select("text"), table(spark, sf, "given_names"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses, phone and identity numbers, street addresses and names of persons in the documents."""
    return pii.findings(table(spark, sf, "documents"), _names(spark, sf))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with a typed placeholder for each place."""
    return pii.redacted(table(spark, sf, "documents"), _names(spark, sf))


QUERIES = {
    "p1_found": p1_found, "p1_statistics": p1_statistics, "p1_kinds": p1_kinds, "p1_word_counts": p1_word_counts, "p2_found": p2_found, "p2_restored": p2_restored, "p5_found": p5_found, "p6_found": p6_found, "p6_text": p6_text,
    "p7_sample": p7_sample, "p7_pieces": p7_pieces, "p8_found": p8_found, "p8_spans": p8_spans, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_redacted": p10_redacted,
}

_KEYED = "SELECT post_id, piece, file, text, CAST(('0x' || substr(md5('42:' || CAST(post_id AS VARCHAR)), 1, 15)) AS BIGINT) AS sample_key FROM posts"

_LINES = lambda p, more="": f"len(list_filter(ls, lambda l: regexp_matches(l, '{p}'){more})) / m"
_GONE = lambda c: f"(length(t) - length(translate(t, {c}, '')))"
_STATISTICS = rf"""
    WITH base AS (SELECT post_id, trim(regexp_replace(coalesce(text, ''), '<br[\t-\r ]*/?>|\r', chr(10), 'g'), ' ') AS t FROM posts),
    cut AS (SELECT post_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS ls, list_filter(string_split_regex(t, '[\t-\r ]+'), lambda w: w <> '') AS ws FROM base),
    x AS (SELECT *, greatest(length(regexp_replace(t, '[\t-\r ]+', '', 'g')), 1) AS solid, greatest(len(ws), 1) AS n, greatest(len(ls), 1) AS m FROM cut),
    known AS (SELECT list(DISTINCT word) AS ks FROM common_words WHERE word IS NOT NULL)
    SELECT post_id, len(ws) AS n_words, round(solid / n, 6) AS mean_word, coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) AS max_word, round(len(list_distinct(ws)) / n, 6) AS "distinct",
        round(length(regexp_replace(t, '\P{{L}}+', '', 'g')) / solid, 6) AS letters, round({_GONE("'" + quality._SYMBOLS + "'")} / solid, 6) AS symbols, round({_GONE("'0123456789'")} / solid, 6) AS digits,
        round({_LINES('[.!?…"”»)]$')}, 6) AS end_punct, round({_LINES(quality.BULLET)}, 6) AS bullets, round({_LINES(quality.BULLET + '.*[^.!?…]$')}, 6) AS open_bullets, round({_LINES(quality.CELLS)}, 6) AS cells,
        round(len(ws) / m, 6) AS line_words, round({_LINES('^[A-Z0-9_][^\t-\r ]*([\t-\r ]+[^\t-\r ]+){{0,6}}$', " AND NOT regexp_matches(l, '[.!?…:,;]$')")}, 6) AS items,
        round(len(list_filter(ws, lambda w: list_contains(ks, lower(w)))) / n, 6) AS common, round({_GONE("','")} / n, 6) AS commas, round(n / ({_GONE("',;' || chr(10)")} + 1), 6) AS segment,
        round(len(list_filter(ws, lambda w: length(w) = 1)) / n, 6) AS single, round(len(regexp_extract_all(t, '[.!?…]["”»)]*([\t-\r ]|$)')) / n, 6) AS stops, len(ls) AS n_lines,
        round({_LINES('^\p{{Ll}}')}, 6) AS lower_start, round({_LINES('[;,]$')}, 6) AS open_end
    FROM x, known""".replace("{{", "{").replace("}}", "}")

ORACLES = {
    "p1_statistics": _STATISTICS,
    "p7_sample": f"SELECT * FROM ({_KEYED}) ORDER BY sample_key, post_id LIMIT {SAMPLE_SIZE}",
    "p7_pieces": f"""
        SELECT p.piece, p.posts, coalesce(s.sampled, 0) AS sampled
        FROM (SELECT piece, count(*) AS posts FROM posts GROUP BY piece) p
        LEFT JOIN (SELECT piece, count(*) AS sampled FROM (SELECT * FROM ({_KEYED}) ORDER BY sample_key, post_id LIMIT {SAMPLE_SIZE}) GROUP BY piece) s ON p.piece = s.piece""",
    "p1_word_counts": r"""
        SELECT m.file, CAST(m.words AS BIGINT) AS noted,
               CAST(CASE WHEN t.text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(t.text, '[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) END AS BIGINT) AS counted
        FROM (SELECT DISTINCT file, words FROM ai_manifest WHERE words IS NOT NULL) m JOIN ai_texts t ON m.file = t.file""",
}
