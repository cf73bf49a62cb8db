"""Queries over usage events, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.streaming import visits
from inkspan.tables import table

Q: dict = {}
S: dict = {}


def add(name, fn, sql):
    Q[name] = fn
    if sql:
        S[name] = sql


_SESS = "lagged AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM lagged), visits AS (SELECT user_id, min(ts) AS start, count(*) AS events FROM numbered GROUP BY user_id, v)"
_start = lambda: F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start")
add("visit_sessions", lambda s, sf: visits.sessions(table(s, sf, "events")).select("user_id", _start(), "events"), f"WITH {_SESS} SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, events FROM visits")
add("visit_total", lambda s, sf: visits.sessions(table(s, sf, "events")).agg(F.count("*").alias("visits")), f"WITH {_SESS} SELECT count(*) AS visits FROM visits")


def _checks(spark, sf):
    """Events as checks of drafts: the type as the tell that fired, as often as the properties say, and a referring address."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    ref = F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://WWW."), "event_type", F.lit(".example/a/"), F.col("k").cast("string"), F.lit("?q=1")))
    return e.select("ts", "user_id", F.create_map("event_type", F.coalesce("k", F.lit(0))).alias("tells"), ref.alias("ref"))


_CHECKS = "checks AS (SELECT ts, user_id, event_type AS tell, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS raw FROM events)"
add("top_tell_7d", lambda s, sf: visits.top_tell(_checks(s, sf)), f"WITH {_CHECKS}, w AS (SELECT * FROM checks WHERE ts > (SELECT max(ts) FROM checks) - INTERVAL 7 DAY) SELECT tell, CAST(sum(k) AS BIGINT) AS n, (SELECT CASE WHEN count(*) >= 50 THEN count(*) END FROM w) AS checks FROM w GROUP BY tell ORDER BY n DESC, tell LIMIT 1")
add("referrer_daily", lambda s, sf: visits.daily(_checks(s, sf)), f"WITH {_CHECKS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN raw % 5 = 0 OR raw IS NULL THEN 'direct' ELSE lower(tell) || '.example' END AS referrer, count(*) AS visits, count(DISTINCT user_id) AS users, CAST(sum(k) AS BIGINT) AS tells FROM checks GROUP BY ALL")


def _streamed(spark, sf):
    events = table(spark, sf, "events")
    end = events.agg((F.max("ts").cast("timestamp") + F.expr("interval 3 days")).alias("t")).first().t
    return visits.stream_sessions(spark, sf, events.schema, end).select("user_id", _start(), "events") if end else visits.sessions(events).select("user_id", _start(), "events")


add("stream_visits", _streamed, f"WITH {_SESS} SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, events FROM visits")
