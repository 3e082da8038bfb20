"""Change data, listings, windows, sampling and evaluation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions.values import content_id
from kinlace.operators import evaluation
from kinlace.plans.registry import query, seconds, t
from kinlace.sources import files
from kinlace.streaming import incremental


def _changes(spark, d) -> DataFrame:
    """An event changes its user's row: signups insert, errors delete, others update."""
    e = t(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "d").otherwise("u")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.lit(None).cast("string").alias("gid"), F.concat(F.lit("old-"), "event_type").alias("old_url"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("new_url"))


def _stored(spark, d) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("gid"), F.col("c_name").alias("url"))


@query(
    """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT c_custkey AS id, c_name AS url FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)
    UNION ALL SELECT user_id, event_type || '-' || event_id FROM l WHERE event_type <> 'error'"""
)
def cdc_replay(spark, d):
    return incremental.apply_changes(_stored(spark, d), _changes(spark, d)).select("id", "url")


@query(
    """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
    SELECT c_custkey AS id, c_name AS url FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)
    UNION ALL SELECT user_id, 'old-' || event_type FROM l WHERE event_type <> 'signup'"""
)
def cdc_undo(spark, d):
    return incremental.undo_changes(_stored(spark, d), _changes(spark, d)).select("id", "url")


@query(
    """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END AS op, user_id AS id,
    'http://x/' || event_type AS new_url FROM events WHERE event_type <> 'view'"""
)
def cdc_parse(spark, d):
    e = t(spark, d, "events")
    row = F.to_json(F.struct(F.col("user_id").alias("id"), F.lit("g").alias("gid"), F.concat(F.lit("http://x/"), "event_type").alias("url")))
    op = F.when(F.col("event_type") == "signup", "i").when(F.col("event_type") == "error", "d").otherwise("u")
    name = F.when(F.col("event_type") == "view", "musicbrainz.work").otherwise("musicbrainz.url")
    lines = e.select(F.concat_ws("\t", F.col("event_id").cast("string"), name, op, F.lit("1"), row, row, F.lit(""), F.lit("")).alias("value"))
    return files.parse_changes(lines).select("seq", "op", "id", "new_url")


@query(
    """WITH s AS (SELECT o_custkey AS listing, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders WHERE o_orderdate < '2000-01-01'),
    f AS (SELECT o_custkey AS listing, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders WHERE o_orderdate >= '1999-06-01'),
    b AS (SELECT *, 0 AS k FROM f UNION ALL SELECT s.*, 1 FROM s WHERE (listing, item) NOT IN (SELECT (listing, item) FROM f))
    SELECT listing, item, (row_number() OVER (PARTITION BY listing ORDER BY k, position, item) - 1)::INTEGER AS position FROM b"""
)
def listing_merge(spark, d):
    o = t(spark, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1
    rows = lambda df: df.select(F.col("o_custkey").alias("listing"), F.col("o_orderkey").alias("item"), place.alias("position"))
    return incremental.merge_listing(rows(o.filter("o_orderdate < '2000-01-01'")), rows(o.filter("o_orderdate >= '1999-06-01'")))


@query(
    """WITH p AS (SELECT l_suppkey AS listing, l_linenumber AS page, bool_and(l_returnflag = 'R') AS known FROM lineitem GROUP BY 1, 2),
    q AS (SELECT *, coalesce(bool_or(known) OVER (PARTITION BY listing ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop FROM p)
    SELECT listing, page FROM q WHERE NOT stop"""
)
def listing_pages(spark, d):
    line = t(spark, d, "lineitem").withColumn("item", F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice"))
    pages = line.select(F.col("l_suppkey").alias("listing"), F.col("l_linenumber").alias("page"), "item")
    return incremental.pages_to_fetch(pages, line.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("listing"), "item"))


_MODE = "CASE WHEN value < 20 THEN 'full' WHEN value < 60 THEN 'incremental' ELSE 'cached' END"


@query(
    f"""SELECT event_type AS kind, count(*) AS served, count(*) FILTER ({_MODE} = 'incremental') AS incremental, count(*) FILTER ({_MODE} = 'full') AS "full",
    sum(user_id)::BIGINT AS new_items, count(*) FILTER (value > 150) AS failed FROM events GROUP BY 1"""
)
def listing_stats(spark, d):
    e = t(spark, d, "events")
    return incremental.listing_stats(e.select(F.col("event_type").alias("kind"), F.expr(_MODE).alias("mode"), F.col("user_id").alias("new_items"), (F.col("value") > 150).alias("failed")))


@query("SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    out = incremental.tumbling_counts(t(spark, d, "events"))
    return out.select(seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """SELECT epoch(b)::BIGINT AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS b FROM events) GROUP BY 1"""
)
def sliding(spark, d):
    return incremental.sliding_counts(t(spark, d, "events")).select(seconds("start").alias("start"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 minutes, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 minutes) AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def sessions(spark, d):
    return incremental.sessions(t(spark, d, "events")).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n")


def _judged(spark, d) -> DataFrame:
    long = F.when(F.col("n_chars") > 1200, "good").otherwise("bad")
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", long.alias("predicted"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"))


_J = "j AS (SELECT CASE WHEN n_chars > 1200 THEN 'good' ELSE 'bad' END AS predicted, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_J} SELECT predicted, gold, count(*) AS n FROM j GROUP BY CUBE (predicted, gold)")
def confusion(spark, d):
    return evaluation.confusion(_judged(spark, d))


@query(
    f"""WITH {_J}, c AS (SELECT unnest(['good', 'bad']) AS class), s AS (SELECT class, count(*) FILTER (predicted = class AND gold = class) AS tp,
      count(*) FILTER (predicted = class AND gold <> class) AS fp, count(*) FILTER (predicted <> class AND gold = class) AS fn FROM j, c GROUP BY 1)
    SELECT *, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1 FROM s"""
)
def precision_recall(spark, d):
    return evaluation.class_metrics(_judged(spark, d), ["good", "bad"]).withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query(f"WITH {_J} SELECT count(*) AS n, count(*) FILTER (predicted = gold) AS agree, count(*) FILTER (predicted = gold) / count(*) AS share FROM j")
def agreement(spark, d):
    return evaluation.agreement(_judged(spark, d))


_H = "md5('0:' || doc_id)"


@query(
    f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_H}, doc_id) AS round, count(*) OVER (PARTITION BY lang, source) AS size FROM documents),
    x AS (SELECT * FROM r ORDER BY round, lang, source LIMIT 150)
    SELECT doc_id, lang, source, round(count(*) OVER (PARTITION BY lang, source) / size, 8) AS inclusion FROM x"""
)
def stratified_sample(spark, d):
    """150 documents over languages and sources: the quota is the operator's."""
    rows = t(spark, d, "documents").select("doc_id", "lang", "source")
    return evaluation.stratified(rows, ["lang", "source"], "doc_id", 150).select("doc_id", "lang", "source", F.round("inclusion", 8).alias("inclusion"))


@query("SELECT o_custkey AS grp, o_orderkey AS entry_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) = 1")
def one_per_group(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("entry_id"))
    return evaluation.one_per_group(rows, "grp")


@query(
    """WITH c AS (SELECT l_orderkey AS k, l_partkey AS id, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY id) AS upto, sum(w) OVER (PARTITION BY k) AS total FROM c),
    d AS (SELECT *, (('0x' || md5('0:' || k)[1:12])::BIGINT)::DOUBLE / 281474976710656.0 * total AS draw FROM u)
    SELECT k, id FROM d WHERE upto > draw QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1"""
)
def weighted_pick(spark, d):
    c = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("weight"))
    return evaluation.weighted_pick(c, "k")


@query(
    """WITH k AS (SELECT DISTINCT p_partkey AS id, p_type, p_name FROM part), s AS (SELECT p_type, p_name FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20)
    SELECT x.id AS a, y.id AS b FROM k x JOIN s USING (p_type, p_name) JOIN k y USING (p_type, p_name) WHERE x.id < y.id
    QUALIFY row_number() OVER (PARTITION BY p_type, p_name ORDER BY md5('0:' || x.id || ':' || y.id), x.id, y.id) <= 30"""
)
def confusers(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("entry_type"), F.col("p_name").alias("name"))
    return evaluation.confusers(p).select("a", "b")


@query(
    """SELECT sha256(to_json({'item_id': item_id, 'text': text})::VARCHAR) AS task_id, item_id FROM benchmark"""
)
def content_ids(spark, d):
    return t(spark, d, "benchmark").select(content_id(F.col("item_id"), F.col("text")).alias("task_id"), "item_id")


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark, d):
    e = t(spark, d, "events").withColumn("p", F.from_json("props", "struct<k:bigint>"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))
