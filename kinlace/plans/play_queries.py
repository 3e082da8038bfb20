"""Play history on `events`: an event is a play of its user's entry, its value the seconds heard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlace.functions import values as V
from kinlace.operators import plays, views
from kinlace.plans.registry import query, seconds, t


def _plays(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("play_id"), F.col("user_id").alias("entry_id"), seconds("ts").alias("started_at"), F.col("value").alias("listened_seconds"), "event_type")


def _exports(spark, d) -> DataFrame:
    """Purchases were exported to one target, in part."""
    return t(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("play_id"), F.lit("main").alias("target"), (F.col("value") * 0.5).alias("exported_seconds"))


_P = "plays AS (SELECT event_id AS play_id, user_id AS entry_id, floor(epoch(ts))::BIGINT AS started_at, value AS listened_seconds, event_type FROM events)"
_X = "exports AS (SELECT event_id AS play_id, 'main' AS target, value * 0.5 AS exported_seconds FROM events WHERE event_type = 'purchase')"


@query("SELECT user_id AS entry_id, count(*) AS plays FROM events WHERE value >= 10 GROUP BY user_id")
def counted_plays(spark, d):
    return plays.play_counts(_plays(spark, d))


@query(f"WITH {_P} SELECT entry_id, max(started_at) AS last_played FROM plays WHERE listened_seconds >= 10 AND started_at >= 1704500000 GROUP BY entry_id")
def last_play(spark, d):
    return plays.last_plays(_plays(spark, d), 1_704_500_000)


@query(
    f"""WITH {_P}, {_X} SELECT count(*) AS plays, round(sum(listened_seconds), 2) AS listened,
    round(sum(least(coalesce(exported_seconds, 0), listened_seconds)), 2) AS exported FROM plays LEFT JOIN exports USING (play_id)"""
)
def play_totals(spark, d):
    out = plays.play_totals(_plays(spark, d), _exports(spark, d).drop("target"))
    return out.select("plays", F.round("listened", 2).alias("listened"), F.round("exported", 2).alias("exported"))


@query(
    """WITH most AS (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY ALL)
    SELECT user_id AS play_id, round(least(sum(m), 86400), 4) AS listened_seconds FROM most GROUP BY user_id"""
)
def reporter_rollup(spark, d):
    reports = t(spark, d, "events").select(F.col("user_id").alias("play_id"), F.col("event_type").alias("reporter"), F.col("value").alias("listened_seconds"))
    return plays.rolled_up(reports).select("play_id", F.round("listened_seconds", 4).alias("listened_seconds"))


@query(
    f"""WITH {_P}, {_X} SELECT play_id, entry_id, round(listened_seconds - coalesce(exported_seconds, 0), 4) AS unexported
    FROM plays LEFT JOIN exports USING (play_id) WHERE listened_seconds - coalesce(exported_seconds, 0) > 0"""
)
def pending_export(spark, d):
    return plays.pending_exports(_plays(spark, d), _exports(spark, d), "main").select("play_id", "entry_id", F.round("unexported", 4).alias("unexported"))


@query(f"WITH {_P} SELECT play_id, entry_id FROM plays WHERE listened_seconds > 15 AND play_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))")
def unqueued(spark, d):
    sent = t(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select(F.lit("a").alias("account"), F.col("event_id").alias("play_id"))
    return plays.unqueued(_plays(spark, d), sent, "a").select("play_id", "entry_id")


_STATUS = "CASE WHEN value < 10 THEN 'failed' WHEN value < 60 THEN 'sent' ELSE 'pending' END"


@query(f"SELECT event_type AS account, {_STATUS} AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, d):
    return plays.status_counts(t(spark, d, "events").select(F.col("event_type").alias("account"), F.expr(_STATUS).alias("status")))


@query(
    """WITH x AS (SELECT user_id AS account, event_id AS id, value <= 150 AS due FROM events),
    y AS (SELECT *, bool_and(due) OVER w AS ok, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY account ORDER BY id))
    SELECT account, id FROM y WHERE ok AND n <= 50"""
)
def head_of_line(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("id"), F.col("value").alias("next_attempt_at"))
    return plays.outbox_head(rows, 150).select("account", "id")


@query(
    f"""WITH {_P}, {_X}, u AS (SELECT entry_id, listened_seconds - coalesce(exported_seconds, 0) AS s FROM plays LEFT JOIN exports USING (play_id)
      WHERE listened_seconds - coalesce(exported_seconds, 0) > 0),
    f AS (SELECT c_custkey AS entry_id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS target FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
    SELECT coalesce(target, u.entry_id) AS entry_id, round(sum(s), 3) AS seconds FROM u LEFT JOIN f USING (entry_id) GROUP BY 1"""
)
def rank_targets(spark, d):
    home = t(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    folds = home.join(home.groupBy("c_nationkey").agg(F.min("c_custkey").alias("rank_target")), "c_nationkey").select(F.col("c_custkey").alias("entry_id"), "rank_target")
    out = plays.rank_targets(plays.pending_exports(_plays(spark, d), _exports(spark, d), "main"), folds)
    return out.select("entry_id", F.round("seconds", 3).alias("seconds"))


@query(
    """SELECT c_nationkey AS component, sum(n)::BIGINT AS plays FROM (SELECT user_id, count(*) AS n FROM events WHERE value >= 10 GROUP BY 1)
    JOIN customer ON user_id = c_custkey GROUP BY 1"""
)
def counts_by_component(spark, d):
    comps = t(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("component"))
    return plays.counts_by_component(plays.play_counts(_plays(spark, d)), comps)


@query("SELECT event_id, coalesce(CASE WHEN user_id > 30 THEN value >= least(user_id / 2.0, 240.0) ELSE false END, false) AS scrobbles FROM events")
def scrobble_eligible(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", V.scrobbles(F.col("user_id").cast("double"), F.col("value")).alias("scrobbles"))


@query(
    """SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS created_at FROM orders WHERE epoch(o_orderdate) < 900000000
    ORDER BY created_at DESC, id DESC LIMIT 100"""
)
def keyset_page(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("created_at"))
    return views.keyset_page(rows, 900_000_000, 100)


@query(
    """SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS created_at FROM orders
    WHERE epoch(o_orderdate) >= 1000000000 - 90 * 86400 ORDER BY created_at DESC, id DESC LIMIT 500"""
)
def retention_latest(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("created_at"))
    return views.retained(rows, 1_000_000_000, 500, 90 * 86_400)


@query("SELECT event_id, (timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts))))::DATE::VARCHAR AS day FROM events")
def pacific_days(spark, d):
    return t(spark, d, "events").select("event_id", V.pacific_date(seconds("ts")).cast("string").alias("day"))
