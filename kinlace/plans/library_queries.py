"""Joins, roll-ups, rankings and lists on the star schema: an order is a release, a line's part its track, its supplier the artist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions import values as V
from kinlace.operators import graph, resolve, views
from kinlace.plans.registry import query, seconds, t


@query(
    """SELECT l_orderkey AS entry_id, l_suppkey AS artist_id, min(l_linenumber)::INTEGER AS position FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_linestatus = 'F' AND s_acctbal > 0 GROUP BY 1, 2"""
)
def main_credits(spark, d):
    line, supplier = t(spark, d, "lineitem"), t(spark, d, "supplier")
    lands = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = supplier.join(lands, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    works = line.select(F.lit("order").alias("source"), F.col("l_orderkey").cast("string").alias("identifier"), F.col("l_orderkey").alias("entry_id")).distinct()
    artists = placed.select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("string").alias("identifier"), F.col("s_suppkey").alias("entry_id"))
    credits = line.select(
        F.lit("order").alias("source"),
        F.col("l_orderkey").cast("string").alias("identifier"),
        F.lit("supplier").alias("artist_source"),
        F.col("l_suppkey").cast("string").alias("artist_identifier"),
        (F.col("l_linestatus") == "F").alias("main_artist"),
        F.to_json(F.struct(F.col("l_linenumber").alias("position"))).alias("extra"),
    )
    kinds = supplier.select(F.col("s_suppkey").alias("entry_id"), F.when(F.col("s_acctbal") > 0, "artist").otherwise("unknown").alias("entry_type"))
    return views.main_credits(works.unionByName(artists), credits, kinds)


@query("SELECT s_nationkey AS source, arg_min(s_name, (s_acctbal < 0, s_suppkey)) AS name FROM supplier GROUP BY 1")
def first_name_pair(spark, d):
    named = t(spark, d, "supplier").select(F.col("s_nationkey").alias("source"), F.lit("nation").alias("identifier"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("primary"), F.col("s_suppkey").alias("id"))
    return views.pair_titles(named).select("source", "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def orphans(spark, d):
    urgent = t(spark, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entry_id"))
    return resolve.orphans(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), urgent)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def supported(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return views.by_ids(t(spark, d, "customer").select("c_custkey"), big, "c_custkey")


@query(
    """WITH rel AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS entry_a, greatest(l_partkey, l_suppkey) AS entry_b FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey),
    held AS (SELECT l_partkey AS p, l_suppkey AS c FROM lineitem WHERE l_returnflag = 'A')
    SELECT entry_a, entry_b FROM rel WHERE NOT EXISTS (SELECT 1 FROM held WHERE (p = entry_a AND c = entry_b) OR (p = entry_b AND c = entry_a))"""
)
def unsupported_relations(spark, d):
    line = t(spark, d, "lineitem")
    a, b = V.ordered_pair(F.col("l_partkey"), F.col("l_suppkey"))
    rel = line.filter("l_returnflag = 'R' AND l_partkey <> l_suppkey").select(a.alias("entry_a"), b.alias("entry_b"), F.lit("provider").alias("origin")).distinct()
    held = line.filter("l_returnflag = 'A'").select(F.lit("n").alias("parent_source"), F.col("l_partkey").cast("string").alias("parent_identifier"), F.lit("n").alias("child_source"), F.col("l_suppkey").cast("string").alias("child_identifier"))
    ids = line.select(F.col("l_partkey").alias("entry_id")).unionByName(line.select(F.col("l_suppkey").alias("entry_id"))).distinct()
    sources = ids.select(F.lit("n").alias("source"), F.col("entry_id").cast("string").alias("identifier"), "entry_id")
    return resolve.unsupported_relations(rel, held, sources).select("entry_a", "entry_b")


@query("SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text")
def keep_first_dedup(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    kept = resolve.keep_first(docs, ["text"])
    n = docs.groupBy("text").agg(F.count("*").alias("copies"))
    return kept.join(n, kept["text"].eqNullSafe(n["text"])).select("id", "copies")


@query("SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1")
def set_collect(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n, bool_and(l_linenumber <= 5) AS numbered FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey AS release_id, o_orderkey::VARCHAR AS identifier, n FROM n
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, numbered DESC, o_orderkey::VARCHAR) = 1"""
)
def tracklist_argmax(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    lists = j.select(F.col("o_custkey").alias("release_id"), F.lit("order").alias("source"), F.col("o_orderkey").cast("string").alias("identifier"), F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).alias("track_no"))
    return views.provider_tracklist(lists).select("release_id", "identifier", "n")


@query(
    """SELECT o_custkey AS group_id, arg_max(o_orderkey, (n, -o_orderkey)) AS release_id FROM orders
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"""
)
def longest_child(spark, d):
    sizes = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("release_id")).agg(F.count("*").alias("n"))
    groups = t(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("release_id"))
    return views.longest_child(groups, sizes)


@query(
    """WITH p AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS track_no, CASE WHEN l_linestatus = 'F' THEN 2 END AS disc FROM lineitem)
    SELECT l_partkey, disc_no, track_no FROM (SELECT l_partkey, coalesce(disc, 1) AS disc_no, track_no,
      row_number() OVER (PARTITION BY l_partkey ORDER BY track_no IS NULL, coalesce(disc, 1), track_no NULLS FIRST) AS n FROM p) WHERE n = 1"""
)
def earliest_position(spark, d):
    line = t(spark, d, "lineitem")
    rows = line.select("l_partkey", F.when(F.col("l_linestatus") == "F", 2).alias("disc_no"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("track_no"))
    return views.earliest_position(rows, ["l_partkey"], 1)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'live' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' THEN lower(o_orderstatus)
      WHEN o_orderpriority = '2-HIGH' THEN 'playlist' WHEN coalesce(n, 0) = 0 THEN 'other' WHEN n <= 3 THEN 'single' WHEN n <= 6 THEN 'ep' ELSE 'album' END AS kind
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def release_kind(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    primary = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "live"))
    typed = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("playlist"), F.when(F.col("o_orderstatus") != "P", F.lower("o_orderstatus")))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", views.release_kind(primary, typed, F.col("n")).alias("kind"))


@query(
    """SELECT o_custkey AS group_id, min(o_orderdate)::DATE::VARCHAR AS date, max(n) AS track_count, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources, sum(n)::BIGINT AS plays
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"""
)
def discography(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("group_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.col("n").alias("n_tracks"), F.col("o_orderstatus").alias("source"), F.col("n").alias("plays"))
    return views.discography(rows).withColumn("sources", F.array_join("sources", ","))


@query(
    """WITH k AS (SELECT *, replace(lower(p_name), ' ', '') AS key FROM part)
    SELECT arg_max(p_partkey, (p_size, -p_partkey)) AS entry_id, arg_max(p_name, (p_size, -p_partkey)) AS title, p_type AS kind, p_size > 25 AS main,
      min(p_brand) AS date, max(p_size) AS track_count, count(*) AS entries FROM k GROUP BY key, p_type, p_size > 25"""
)
def title_fold(spark, d):
    p = t(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), (F.col("p_size") > 25).alias("main"), F.col("p_size").alias("n_sources"), F.col("p_brand").alias("date"), F.col("p_size").alias("track_count"), F.lit(1).cast("long").alias("entries"))
    return views.fold_titles(rows)


@query(
    """WITH a AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS any_main FROM lineitem GROUP BY 1)
    SELECT l_orderkey AS entry_id, l_suppkey AS artist_id, bool_or(l_linestatus = 'F') OR NOT any_value(any_main) AS main, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles
    FROM lineitem JOIN a USING (l_orderkey) GROUP BY 1, 2"""
)
def credit_verdicts(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("artist_id"), F.col("l_returnflag").alias("role"), (F.col("l_linestatus") == "F").alias("main_artist"))
    return views.credit_verdicts(rows).withColumn("roles", F.array_join("roles", ","))


@query(
    """SELECT p_partkey AS entry_id, length(p_name) AS score FROM part WHERE contains(lower(p_name), 'rin') AND p_type = 'ECONOMY'
    ORDER BY score, entry_id LIMIT 50"""
)
def search(spark, d):
    p = t(spark, d, "part")
    aliases = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"))
    return views.search(aliases, p.select(F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("entry_type")), "RIN", "ECONOMY")


@query(
    """WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS g, arg_max(p_partkey, (p_size, -p_partkey)) OVER (PARTITION BY p_name, p_brand) AS dflt FROM part),
    h AS (SELECT p_partkey AS entry_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ordinal FROM part WHERE p_size < 20)
    SELECT dflt AS entry_id, CASE WHEN dflt <> entry_id THEN entry_id ELSE -1 END AS matched_edition, ordinal::INTEGER AS ordinal FROM h JOIN g ON entry_id = p_partkey
    QUALIFY row_number() OVER (PARTITION BY g.g ORDER BY ordinal) = 1"""
)
def folded_hits(spark, d):
    p = t(spark, d, "part")
    by = Window.partitionBy("p_name", "p_brand")
    whole = by.orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = p.select(F.col("p_partkey").alias("entry_id"), F.min("p_partkey").over(by).alias("group_id"), F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).over(whole).alias("default_id"))
    hits = p.filter("p_size < 20").select(F.col("p_partkey").alias("entry_id"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("ordinal"))
    return views.folded_hits(hits, groups).na.fill(-1, ["matched_edition"])


def _aliases(spark, d) -> DataFrame:
    """A part type is an entry; brands are its sources, of which Brand#2 is a video source."""
    p = t(spark, d, "part")
    return p.select(F.col("p_type").alias("entry_id"), F.when(F.col("p_brand") == "Brand#2", "youtube").otherwise(F.col("p_brand")).alias("source"), F.col("p_name").alias("name"), (F.col("p_size") > 40).alias("primary"))


_ALIASES = "a AS (SELECT p_type AS entry_id, CASE WHEN p_brand = 'Brand#2' THEN 'youtube' ELSE p_brand END AS source, p_name AS name, max(p_size > 40) AS prim FROM part GROUP BY 1, 2, 3)"


@query(
    f"""WITH {_ALIASES}, f AS (SELECT *, row_number() OVER (PARTITION BY entry_id, lower(name) ORDER BY source = 'youtube', source, NOT prim, name) AS n FROM a)
    SELECT entry_id, string_agg(name, '|' ORDER BY source = 'youtube', source, NOT prim, name) AS names FROM f WHERE n = 1 GROUP BY 1"""
)
def alias_list(spark, d):
    return views.alias_list(_aliases(spark, d)).select("entry_id", F.array_join("names", "|").alias("names"))


@query(f"WITH {_ALIASES} SELECT entry_id, name AS title FROM a QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY source = 'youtube', NOT prim, source, name) = 1")
def best_title(spark, d):
    return views.best_title(_aliases(spark, d))


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders)
    SELECT o_custkey AS component, o_orderkey AS release_id FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderdate > '1995-01-01' THEN o_orderdate END NULLS LAST, o_orderkey) = 1"""
)
def covers(spark, d):
    o = t(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("component"), F.when(F.col("o_orderdate") > "1995-01-01", F.col("o_orderdate")).alias("date"), F.col("o_orderkey").alias("release_id"))
    return views.covers(rows).select("component", "release_id")


@query(
    """SELECT s_nationkey AS entry_id, s_name AS identifier FROM supplier
    QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END, s_name) = 1"""
)
def playlist_anchors(spark, d):
    s = t(spark, d, "supplier")
    source = F.when(F.col("s_acctbal") > 5000, "rich").when(F.col("s_acctbal") > 0, "fine").otherwise("zero")
    rows = s.select(F.col("s_nationkey").alias("entry_id"), source.alias("source"), F.col("s_name").alias("identifier"))
    return views.anchors(rows, {"rich": 0, "fine": 1}).select("entry_id", "identifier")


@query(
    """WITH old AS (SELECT o_custkey AS playlist_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F'),
    new AS (SELECT o_custkey AS playlist_id, o_orderkey AS id, coalesce(last, -1) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position
      FROM orders LEFT JOIN (SELECT playlist_id, max(position) AS last FROM old GROUP BY 1) ON playlist_id = o_custkey WHERE o_orderstatus = 'P')
    SELECT playlist_id, id, position::INTEGER AS position FROM old UNION ALL SELECT playlist_id, id, position::INTEGER FROM new"""
)
def playlist_append(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("playlist_id"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    old = o.filter("o_orderstatus = 'F'").select("playlist_id", "id", (F.row_number().over(Window.partitionBy("playlist_id").orderBy("id")) - 1).alias("position"))
    new = o.filter("o_orderstatus = 'P'").select("playlist_id", "id", F.col("id").alias("ordinal"))
    return views.appended(old, new)


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS item_count FROM customer")
def item_counts(spark, d):
    items = t(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("playlist_id"))
    return views.with_counts(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), items)


@query(
    """WITH a AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
    b AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
    SELECT coalesce(x.c, y.c) AS c, count(*) FILTER (x.p IS NOT NULL AND y.p IS NOT NULL) AS shared, count(*) FILTER (y.p IS NULL) AS only_a, count(*) FILTER (x.p IS NULL) AS only_b
    FROM (SELECT DISTINCT * FROM a) x FULL JOIN (SELECT DISTINCT * FROM b) y ON x.c = y.c AND x.p = y.p GROUP BY 1"""
)
def set_operations(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lambda s: F.coalesce(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("l_partkey"))), F.array().cast("array<bigint>"))
    sets = j.filter("o_orderstatus IN ('F', 'P')").groupBy(F.col("o_custkey").alias("c")).agg(parts("F").alias("a"), parts("P").alias("b"))
    size = lambda x: F.size(x).cast("long")
    return sets.select("c", size(F.array_intersect("a", "b")).alias("shared"), size(F.array_except("a", "b")).alias("only_a"), size(F.array_except("b", "a")).alias("only_b"))


@query(
    """SELECT r_name AS region, n_name AS nation, count(DISTINCT s_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)"""
)
def catalogue_rollup(spark, d):
    lands = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(lands, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count_distinct("s_suppkey").alias("suppliers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    """SELECT track_id, CASE min(n) WHEN 1 THEN 'album' ELSE 'artist' END AS via FROM (
      SELECT l_partkey + 10000000 AS track_id, 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9500
      UNION ALL SELECT l_partkey + 10000000, 2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000) GROUP BY 1"""
)
def reached_tracks(spark, d):
    """Rich customers are groups of orders, orders of parts; rich suppliers are artists; ids are apart by millions."""
    o, line = t(spark, d, "orders"), t(spark, d, "lineitem")
    track, release, artist = 10_000_000, 20_000_000, 50_000_000
    edges = o.select(F.col("o_custkey").alias("parent_id"), (F.col("o_orderkey") + release).alias("child_id")).unionByName(line.select((F.col("l_orderkey") + release).alias("parent_id"), (F.col("l_partkey") + track).alias("child_id")).distinct())
    credits = line.select((F.col("l_suppkey") + artist).alias("artist_id"), (F.col("l_partkey") + track).alias("work_id")).distinct()
    entries = t(spark, d, "part").select((F.col("p_partkey") + track).alias("entry_id"), F.lit("track").alias("entry_type"))
    seeds = t(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_custkey").alias("entry_id")).unionByName(t(spark, d, "supplier").filter("s_acctbal > 9000").select((F.col("s_suppkey") + artist).alias("entry_id")))
    return views.reached_tracks(seeds, edges, credits, entries, entries.select("entry_id", F.col("entry_id").alias("rank_target")).limit(0))


@query(
    """SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS other_id, 'contains' AS why FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
    UNION SELECT DISTINCT l_partkey, l_orderkey, 'contained_in' FROM lineitem WHERE l_partkey IN (SELECT o_orderkey FROM orders)"""
)
def suggestions(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("child_id"))
    none = spark.createDataFrame([], "entry_a long, entry_b long, kind string, enabled boolean")
    return views.suggestions(edges, none, t(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id")))


@query("SELECT p_partkey AS entry_id FROM part WHERE p_name NOT LIKE 'small%' OR p_brand <> 'Brand#2'")
def without_prefix(spark, d):
    p = t(spark, d, "part")
    sources = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("source"), F.col("p_name").alias("identifier"))
    return views.without_prefix(sources, p.select(F.col("p_partkey").alias("entry_id")), "Brand#2", "small")


@query(
    """SELECT c_custkey AS entry_id FROM customer LEFT JOIN (SELECT o_custkey, max(epoch(o_orderdate)) AS changed FROM orders GROUP BY 1) ON o_custkey = c_custkey
    WHERE changed IS NOT NULL AND (c_acctbal < 0 OR changed >= 1000000000)"""
)
def incremental_changed(spark, d):
    changed = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("entry_id")).agg(F.max(seconds("o_orderdate")).alias("changed_at"))
    e = t(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.when(F.col("c_acctbal") >= 0, 1_000_000_000).alias("softmatch_checked_at")).join(changed, "entry_id", "left")
    return views.changed_since(e).select("entry_id")


@query("SELECT p_brand AS entry_id, p_type AS kind, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, kind) <= 3")
def top_outgoing(spark, d):
    n = t(spark, d, "part").groupBy(F.col("p_brand").alias("entry_id"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("n"), "kind"))
    return n.withColumn("rank", rank).filter("rank <= 3").drop("rank")


@query(
    """SELECT p_partkey AS entry_id, round(1 - 4 / length(p_name), 6) AS score FROM part WHERE contains(lower(p_name), 'ring')
    ORDER BY score, entry_id LIMIT 50"""
)
def phrase_search(spark, d):
    p = t(spark, d, "part")
    aliases = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"))
    out = views.phrase_search(aliases, aliases.select("entry_id"), "Ring")
    return out.select("entry_id", F.round("score", 6).alias("score"))


@query(
    """SELECT l_orderkey AS entry_id, count(DISTINCT l_returnflag || l_linestatus) AS n FROM lineitem GROUP BY 1 HAVING n > 1"""
)
def multi_song_entries(spark, d):
    """Each line is a song of one work, its flags; lines of one work are one song."""
    songs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.array(F.array(F.concat("l_returnflag", "l_linestatus"))).alias("songs"))
    return views.multi_song_entries(songs).select("entry_id", F.col("n").cast("long").alias("n"))


@query(
    """WITH x AS (SELECT s_nationkey AS e, s_suppkey::VARCHAR AS i, s_acctbal > 0 AS l, s_acctbal < 5000 AS r FROM supplier)
    SELECT i AS identifier, CASE WHEN l AND NOT r THEN 1 WHEN r THEN 2 ELSE 1 END AS fetched_at FROM x WHERE l OR r"""
)
def library_fold_in(spark, d):
    """Two libraries of suppliers, of which many are in both; the right one was fetched later."""
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("string").alias("identifier"), F.col("s_nationkey").cast("long").alias("entry_id"), "s_acctbal")
    left = s.filter("s_acctbal > 0").select("source", "identifier", "entry_id", F.lit(1).alias("fetched_at"))
    right = s.filter("s_acctbal < 5000").select("source", "identifier", "entry_id", F.lit(2).alias("fetched_at"))
    ids = graph.merged_ids(left.drop("fetched_at"), right.drop("fetched_at"))
    return resolve.fold_in(left, right, ids).select("identifier", "fetched_at")


@query(
    """SELECT l_orderkey AS entry_id, l_returnflag AS source, l_suppkey::VARCHAR AS artist_identifier, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS roles FROM lineitem GROUP BY 1, 2, 3"""
)
def source_credits(spark, d):
    line = t(spark, d, "lineitem")
    sources = line.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").cast("string").alias("identifier"), F.col("l_orderkey").alias("entry_id")).distinct()
    rows = line.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").cast("string").alias("identifier"), F.col("l_suppkey").cast("string").alias("artist_identifier"), F.col("l_linestatus").alias("role"))
    return views.source_credits(sources, rows).withColumn("roles", F.array_join("roles", ","))


@query(
    """SELECT DISTINCT o_custkey AS parent_id, l_partkey + 10000000 AS child_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 50 OR o_totalprice > 499000"""
)
def structural_edges(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = j.select(F.col("o_custkey").alias("parent_id"), (F.col("l_partkey") + 10_000_000).alias("child_id"), "o_totalprice")
    sized = t(spark, d, "part").filter("p_size = 50").select((F.col("p_partkey") + 10_000_000).alias("entry_id"))
    return views.structural_edges(edges.drop("o_totalprice"), sized).unionByName(edges.filter("o_totalprice > 499000").drop("o_totalprice")).distinct()


@query()
def edition_facts(spark, d):
    """A JSON document for each order: its tracklist and durations."""
    line = t(spark, d, "lineitem")
    name = lambda c: F.col(c).cast("string")
    sources = t(spark, d, "orders").select(F.lit("order").alias("source"), name("o_orderkey").alias("identifier"), F.floor("o_totalprice").alias("duration_ms"))
    aliases = t(spark, d, "orders").select(F.lit("order").alias("source"), name("o_orderkey").alias("identifier"), F.col("o_orderpriority").alias("name"))
    children = line.select(F.lit("order").alias("parent_source"), name("l_orderkey").alias("parent_identifier"), F.lit("part").alias("child_source"), name("l_partkey").alias("child_identifier"), F.lit(None).cast("int").alias("disc_no"), F.col("l_linenumber").alias("track_no"))
    credits = line.select(F.lit("part").alias("source"), name("l_partkey").alias("identifier"), F.lit("order").alias("artist_source"), name("l_orderkey").alias("artist_identifier"), F.col("l_returnflag").alias("role"))
    return views.pair_facts(sources, aliases, children, credits)
