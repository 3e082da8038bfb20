"""Blocking, vectors, graphs, scoring and maintenance on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions import text, urls
from kinlace.functions import values as V
from kinlace.operators import blocking, graph, knn, match, resolve, rules, scoring
from kinlace.operators.staging import staged
from kinlace.plans.registry import query, t

_NONE = "array<bigint>"


def _entries(df: DataFrame, entry_id: str, entry_type, aliases=None, durations=None, peers=None, children=None) -> DataFrame:
    empty = lambda kind: F.array().cast(kind)
    return df.select(
        F.col(entry_id).alias("entry_id"),
        entry_type.alias("entry_type"),
        (aliases if aliases is not None else empty("array<string>")).alias("aliases"),
        (durations if durations is not None else empty(_NONE)).cast(_NONE).alias("durations"),
        (peers if peers is not None else empty(_NONE)).cast(_NONE).alias("peer_ids"),
        (children if children is not None else empty(_NONE)).cast(_NONE).alias("child_ids"),
    )


# normalised, and without blanks, as the JVM and DuckDB both do
_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _documents(spark, d) -> DataFrame:
    return _entries(t(spark, d, "documents"), "doc_id", F.col("lang"), F.array("text"))


def _items(spark, d) -> DataFrame:
    return _entries(t(spark, d, "benchmark"), "item_id", F.lit("item"), F.array("text"))


@query(
    f"""WITH k AS (SELECT doc_id, lang, replace({_NORM.format('text')}, ' ', '') AS key FROM documents), b AS (SELECT * FROM k WHERE length(key) >= 2),
    s AS (SELECT lang, key FROM b GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50)
    SELECT x.doc_id AS a, y.doc_id AS b FROM b x JOIN s USING (lang, key) JOIN b y USING (lang, key) WHERE x.doc_id < y.doc_id"""
)
def exact_name_blocks(spark, d):
    return blocking.block_pairs(blocking.exact_name_keys(_documents(spark, d)))


@query(
    f"""WITH k AS (SELECT DISTINCT item_id, unnest(string_split({_NORM.format('text')}, ' ')) AS key FROM benchmark), b AS (SELECT * FROM k WHERE length(key) > 1),
    s AS (SELECT key FROM b GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50)
    SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM b x JOIN s USING (key) JOIN b y USING (key) WHERE x.item_id < y.item_id GROUP BY 1, 2"""
)
def token_blocks(spark, d):
    return blocking.shared_counts(blocking.token_keys(_items(spark, d)))


@query(
    f"""WITH n AS (SELECT item_id, replace({_NORM.format('text')}, ' ', '') AS c FROM benchmark),
    k AS (SELECT DISTINCT item_id, unnest(CASE WHEN length(c) <= 3 THEN [c] ELSE list_transform(range(1, length(c) - 1), lambda i: c[i:i+2]) END) AS key FROM n WHERE c <> ''),
    s AS (SELECT key FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
    p AS (SELECT x.item_id AS me, y.item_id AS other, count(*) AS shared FROM k x JOIN s USING (key) JOIN k y USING (key) WHERE x.item_id <> y.item_id GROUP BY 1, 2),
    r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY me ORDER BY shared DESC, other DESC) <= 5)
    SELECT DISTINCT least(me, other) AS a, greatest(me, other) AS b FROM r WHERE shared >= 2"""
)
def trigram_topk(spark, d):
    return blocking.top_neighbours(blocking.shared_counts(blocking.gram_keys(_items(spark, d))), 5)


@query(
    """WITH k AS (SELECT DISTINCT o_orderkey AS id, o_custkey AS p, unnest([x - 1, x, x + 1]) AS b FROM (SELECT *, floor(floor(o_totalprice) / 5000)::BIGINT AS x FROM orders)),
    s AS (SELECT p, b FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50)
    SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN s USING (p, b) JOIN k y USING (p, b) WHERE x.id < y.id"""
)
def band_join(spark, d):
    o = t(spark, d, "orders")
    e = _entries(o, "o_orderkey", F.lit("track"), durations=F.array(F.floor("o_totalprice")), peers=F.array("o_custkey"))
    return blocking.block_pairs(blocking.duration_keys(e)).distinct()


def _orders_as_releases(spark, d) -> DataFrame:
    parts = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return _entries(parts, "l_orderkey", F.lit("release"), children=F.col("parts"))


@query(
    """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS key FROM lineitem GROUP BY 1),
    b AS (SELECT key FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
    SELECT x.l_orderkey AS a, y.l_orderkey AS b FROM s x JOIN b USING (key) JOIN s y USING (key) WHERE x.l_orderkey < y.l_orderkey"""
)
def set_equal(spark, d):
    return blocking.block_pairs(blocking.tracklist_keys(_orders_as_releases(spark, d)))


@query(
    """WITH k AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
    s AS (SELECT p FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
    x AS (SELECT l.id AS a, r.id AS b, count(*) AS shared FROM k l JOIN s USING (p) JOIN k r USING (p) WHERE l.id < r.id GROUP BY 1, 2)
    SELECT a, b FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE shared >= 2 AND shared / (na.n + nb.n - shared) >= 0.18"""
)
def set_overlap(spark, d):
    return blocking.overlapping_sets(_orders_as_releases(spark, d))


@query(
    """WITH exact AS (SELECT DISTINCT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y USING (p_type, p_name) WHERE x.p_partkey < y.p_partkey
      AND (SELECT count(*) FROM part w WHERE w.p_type = x.p_type AND w.p_name = x.p_name) BETWEEN 2 AND 50),
    dk AS (SELECT DISTINCT p_partkey AS id, p_type AS ty, p_size AS p, unnest([v - 1, v, v + 1]) AS b FROM (SELECT *, floor(floor(p_retailprice * 100) / 5000)::BIGINT AS v FROM part)),
    ds AS (SELECT ty, p, b FROM dk GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
    dur AS (SELECT DISTINCT x.id AS a, y.id AS b FROM dk x JOIN ds USING (ty, p, b) JOIN dk y USING (ty, p, b) WHERE x.id < y.id)
    SELECT a, b, bit_or(c)::INTEGER AS channels FROM (SELECT *, 1 AS c FROM exact UNION ALL SELECT *, 8 FROM dur) GROUP BY 1, 2"""
)
def channel_union(spark, d):
    p = t(spark, d, "part")
    e = _entries(p, "p_partkey", F.col("p_type"), F.array("p_name"), F.array(F.floor(F.col("p_retailprice") * 100)), F.array("p_size"))
    exact, dur = blocking.block_pairs(blocking.exact_name_keys(e)), blocking.block_pairs(blocking.duration_keys(e))
    both = exact.withColumn("c", F.lit(blocking.EXACT_NAME)).unionByName(dur.withColumn("c", F.lit(blocking.DURATION_CREDIT)))
    return both.groupBy("a", "b").agg(F.bit_or("c").alias("channels"))


@query(
    f"""WITH n AS (SELECT item_id, {_NORM.format('text')} AS n FROM benchmark), e AS (SELECT item_id, replace(n, ' ', '') AS c, n FROM n),
    k AS (SELECT item_id, 'exact|item|' || c AS block_key FROM e WHERE length(c) >= 2
      UNION SELECT item_id, 'token|item|' || w FROM (SELECT item_id, unnest(string_split(n, ' ')) AS w FROM e) WHERE length(w) > 1
      UNION SELECT item_id, 'gram|item|' || unnest(CASE WHEN length(c) <= 3 THEN [c] ELSE list_transform(range(1, length(c) - 1), lambda i: c[i:i+2]) END) FROM e WHERE c <> '')
    SELECT item_id AS entry_id, block_key FROM k"""
)
def block_keys(spark, d):
    return blocking.block_keys(_items(spark, d))


@query(
    """WITH x AS (SELECT a.vec_id AS entry_id, b.vec_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT entry_id, neighbour_id, round(dist, 4) AS distance, (row_number() OVER w)::INTEGER AS rank FROM x
    WINDOW w AS (PARTITION BY entry_id ORDER BY dist, neighbour_id) QUALIFY row_number() OVER w <= 5"""
)
def knn_topk(spark, d):
    return knn.knn(_vectors(spark, d), 5).withColumn("distance", F.round("distance", 4))


def _vectors(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").cast("string").alias("entry_type"), F.col("embedding").alias("vector"))


@query(
    """WITH x AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) <= 10)
    SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k WHERE dist <= sqrt(2 * (1 - 0.3))"""
)
def semantic_pairs(spark, d):
    return knn.semantic_pairs(_vectors(spark, d), 10, 0.3)


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 5) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def cosine_pairs(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


def _name_pairs(spark, d) -> DataFrame:
    """Each part with the one that follows it: names of which some are equal, some share a word."""
    p = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("x"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return p.join(q, "p_partkey")


_PAIRS = "n AS (SELECT a.p_partkey, a.p_name || ' ' || a.p_brand AS x, b.p_name || ' ' || b.p_brand AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(
    f"""WITH {_PAIRS}, l AS (SELECT *, list_distinct(string_split(x, ' ')) AS s, list_distinct(string_split(y, ' ')) AS u FROM n)
    SELECT p_partkey, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS lev, round(len(list_intersect(s, u)) / len(list_distinct(list_concat(s, u))), 6) AS jac FROM l"""
)
def string_similarities(spark, d):
    n = _name_pairs(spark, d)
    x, y = F.col("x"), F.col("y")
    return n.select("p_partkey", F.round(text.levenshtein_similarity(x, y), 6).alias("lev"), F.round(text.jaccard(text.tokens(x), text.tokens(y)), 6).alias("jac"))


@query(f"WITH {_PAIRS} SELECT p_partkey, round(jaro_winkler_similarity(x, y), 6) AS jw FROM n")
def jaro_winkler(spark, d):
    return _name_pairs(spark, d).select("p_partkey", F.round(text.jaro_winkler("x", "y"), 6).alias("jw"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', '') AS b FROM pages)
    SELECT page_id, regexp_replace(lower(regexp_extract(b, '^[^/]*')), '^(?:www\.|m\.)', '') || regexp_replace(regexp_extract(b, '^[^/]*(.*)$', 1), '/+$', '') AS url_key FROM u"""
)
def url_canonical(spark, d):
    return t(spark, d, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Latin}') THEN 'latin' WHEN trim(text) = '' THEN 'missing' ELSE 'other' END AS script,
    len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'))::INTEGER AS numbers FROM documents""".replace("\\\\", "\\")
)
def script_and_numbers(spark, d):
    return t(spark, d, "documents").select("doc_id", text.script_class(F.col("text")).alias("script"), F.size(text.title_numbers(F.col("text"))).alias("numbers"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(text, '\(([^)]*)\)|\[([^\]]*)\]|（([^）]*)）|〜([^〜]*)〜|～([^～]*)～', '', 'g'), ' '), '[\-– ]+$', ''), ' ')) AS main FROM documents"""
)
def clean_title(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.clean_title_main(F.col("text")).cast("binary")).alias("main"))


def _version_sql() -> str:
    """Macros and lists over whole texts, from the same fixed values."""
    blank = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    strip = lambda x: f"regexp_replace({x}, '^[{blank}]+|[{blank}]+$', '', 'g')"
    inner = "x[2:length(x) - 1]"
    held = ", ".join(f"CASE WHEN contains(low, '{t}') THEN '{m}' END" for t, m in text.VERSION_RULES.items())
    some = lambda items: f"[{strip('x')} FOR x IN {items} IF {strip('x')} <> '']"
    cut = " ".join(f"WHEN len({some(chr(39).join(('string_split(body, ', sep, ')')))}) > 1 THEN {some(chr(39).join(('string_split(body, ', sep, ')')))}" for sep in text.VIDEO_SEPARATORS)
    noise = ", ".join(f"'{w}'" for w in text.VIDEO_NOISE)
    word = r"([\p{L}\p{N}_]+)\s+ver"
    return f"""WITH a AS (
      SELECT doc_id, text, regexp_replace(text, '{text._NOT_LIVE}', '', 'g') AS title, {strip(f"regexp_replace(text, '{text._VIDEO_BRACKETS}', ' ', 'g')")} AS body FROM documents
    ), b AS (
      SELECT *, lower(title) AS low, CASE {cut} ELSE [body] END AS outside,
        [{strip(inner)} FOR x IN regexp_extract_all(text, '{text._VIDEO_BRACKETS}') IF {strip(inner)} <> ''] AS inside FROM a
    ), c AS (
      SELECT *, [x FOR x IN list_concat(outside, inside) IF lower(x) NOT IN ({noise})] AS plain,
        list_concat([{held}],
          [nullif('named:' || regexp_extract(lower({inner}), '{word}(?:sion|\\.)?$', 1), 'named:') FOR x IN regexp_extract_all(title, '{text._IN_BRACKETS}')],
          [coalesce(nullif('named:' || regexp_extract(lower(x), '{word}\\.?$', 1), 'named:'), 'variant') FOR x IN regexp_extract_all(title, '{text._IN_HYPHENS}', 1)]) AS found FROM b
    ) SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN found IF x IS NOT NULL])), ' ') AS versions,
      length(CASE WHEN regexp_extract(text, '{text._CORNERS}', 1) <> '' THEN {strip(f"regexp_extract(text, '{text._CORNERS}', 1)")}
        ELSE coalesce([x FOR x IN plain IF NOT regexp_matches(lower(x), '{text._VIDEO_MODIFIER}') AND NOT regexp_matches(x, '{text._VIDEO_CREDIT}')][1], plain[1], '') END) AS main_chars
    FROM c"""


@query(_version_sql())
def version_markers(spark, d):
    """Version markers and the song's name of every document, read as a video title."""
    docs = t(spark, d, "documents")
    return docs.select("doc_id", text.version_tokens(F.col("text")).alias("versions"), F.length(text.video_title_main(F.col("text"))).alias("main_chars"))


# --- graphs -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def components(spark, d):
    """Each order is joined to its customer's order before it: a path a customer."""
    o = t(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = o.select(F.col("o_orderkey").alias("a"), before.alias("b")).filter("b IS NOT NULL")
    return graph.components(edges, o.select(F.col("o_orderkey").alias("node")))


@query(
    """WITH d1 AS (SELECT 'o' || o_orderkey AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9900),
    s AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 9900),
    d2 AS (SELECT DISTINCT 'p' || l_partkey AS node FROM lineitem JOIN d1 ON d1.node = 'o' || l_orderkey)
    SELECT node, 0 AS hops FROM s UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2"""
)
def region_bfs(spark, d):
    o, line = t(spark, d, "orders"), t(spark, d, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = o.select(name("c", "o_custkey").alias("a"), name("o", "o_orderkey").alias("b")).unionByName(line.select(name("o", "l_orderkey").alias("a"), name("p", "l_partkey").alias("b")))
    seeds = t(spark, d, "customer").filter("c_acctbal > 9900").select(name("c", "c_custkey").alias("node"))
    return graph.region(edges, seeds, 2)


def _relations(spark, d) -> DataFrame:
    """A customer's orders, one after the other, are the same; those of another status are versions, and urgent ones of other songs."""
    o = t(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = o.select(F.lag("o_orderkey").over(w).alias("entry_a"), F.col("o_orderkey").alias("entry_b"), F.lag("o_orderstatus").over(w).alias("s"), "o_orderstatus", "o_orderpriority", "o_totalprice").filter("entry_a IS NOT NULL")
    kind = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "different_song").when(F.col("s") == F.col("o_orderstatus"), "same_identity").when(F.col("o_orderstatus") == "P", "instrumental").otherwise("live")
    extra = F.to_json(F.struct(F.greatest("entry_a", "entry_b").alias("derived_entry"), F.least("entry_a", "entry_b").alias("source_entry")))
    origin = F.when(F.col("o_orderpriority") == "2-HIGH", "provider").when(F.col("o_orderpriority") == "5-LOW", "user").otherwise("heuristic")
    return r.select("entry_a", "entry_b", kind.alias("kind"), F.round(F.col("o_totalprice") / 1e6, 4).alias("confidence"), origin.alias("origin"), (F.col("o_orderpriority") != "3-MEDIUM").alias("enabled"), F.when(kind.isin(*V.EDITION_KINDS), extra).alias("extra"))


def _order_entries(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"))


@query()
def soft_identity(spark, d):
    return graph.identity(_relations(spark, d), _order_entries(spark, d))


@query()
def edition_projection(spark, d):
    rel = _relations(spark, d)
    return graph.editions(rel, graph.identity(rel, _order_entries(spark, d)))


@query()
def constrained_components(spark, d):
    """Documents of one text are joined, but not across languages or labels that differ."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    key = Window.partitionBy("text").orderBy("doc_id")
    edges = docs.select(F.lag("doc_id").over(key).alias("a"), F.col("doc_id").alias("b"), F.col("lang"), F.lag("toxic").over(key).alias("ta"), "toxic").filter("a IS NOT NULL")
    cannot = edges.filter("ta <> toxic").select("a", "b")
    return graph.constrained_components(edges.select("a", "b", "lang"), cannot, ["lang"], docs.select(F.col("doc_id").alias("node")))


@query(
    """WITH r AS (SELECT lag(o_orderkey) OVER w AS s, o_orderkey AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
        QUALIFY s IS NOT NULL AND o_orderpriority = '2-HIGH' AND lag(o_orderstatus) OVER w <> o_orderstatus),
    up AS (SELECT d AS entry_id, string_agg(DISTINCT s::VARCHAR, ',' ORDER BY s::VARCHAR) AS originals FROM r GROUP BY 1),
    down AS (SELECT s AS entry_id, string_agg(DISTINCT d::VARCHAR, ',' ORDER BY d::VARCHAR) AS derivatives FROM r GROUP BY 1)
    SELECT entry_id, coalesce(originals, '') AS originals, coalesce(derivatives, '') AS derivatives FROM up FULL JOIN down USING (entry_id)"""
)
def directed_neighbours(spark, d):
    rel = _relations(spark, d)
    none = _order_entries(spark, d).select("entry_id", F.col("entry_id").alias("component"))
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias(c)
    return graph.directed_neighbours(rel, none).select("entry_id", listed("originals"), listed("derivatives"))


@query(
    """SELECT l_orderkey AS side_id, min(l_partkey) AS first_part, count(DISTINCT l_partkey) AS parts, max(l_partkey) - min(l_partkey) AS spread FROM lineitem GROUP BY 1"""
)
def owned_ids(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("side_id")).agg(F.min("l_partkey").alias("first_part"), F.count_distinct("l_partkey").alias("parts"), (F.max("l_partkey") - F.min("l_partkey")).alias("spread"))


# --- rules and scores -------------------------------------------------------------------------------------

_RULES = [
    ("skip", {"all": [{"entry_type": "P"}, {"duration": [None, 50_000]}]}),
    ("big", {"children": {"count": [6, None], "match": {"duration": [10_000, None]}}}),
    ("mostly_returned", {"children": {"ratio": [0.5, 1.0], "match": {"any": [{"name": "^R$"}, {"index": [7, None]}]}}}),
    ("named", {"not": {"any": [{"name": "LOW|HIGH"}, {"url": "URGENT"}]}}),
]


@query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_extendedprice >= 10000) AS big, count(*) FILTER (l_returnflag = 'R' OR l_linenumber >= 7) AS ret FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS entry_id, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'skip' WHEN coalesce(big, 0) >= 6 THEN 'big'
      WHEN coalesce(n, 0) > 0 AND ret / n BETWEEN 0.5 AND 1.0 THEN 'mostly_returned'
      WHEN NOT (regexp_matches(o_orderpriority, 'LOW|HIGH') OR regexp_matches(o_orderpriority, 'URGENT')) THEN 'named' END AS action
    FROM orders LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def child_rules(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("entry_type"), F.col("o_totalprice").alias("duration_ms"), F.col("o_orderpriority").alias("name"), F.col("o_orderpriority").alias("url"))
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("position"))
    return rules.first_match(o, _RULES, c).select("entry_id", "action")


@query()
def track_verdicts(spark, d):
    """Parts of one name and type are scored as tracks: brands are artists, prices lengths."""
    p = t(spark, d, "part")
    none = F.array().cast("array<struct<release_id:bigint,disc_no:int,track_no:int>>")
    source = F.when(F.col("p_size") > 40, "youtube").otherwise("musicbrainz")
    entries = p.select(
        F.col("p_partkey").alias("entry_id"),
        F.lit("track").alias("entry_type"),
        F.array(F.struct(source.alias("source"), F.col("p_name").alias("name"))).alias("sourced_aliases"),
        F.array(F.struct(source.alias("source"), F.concat_ws("/", "p_name", "p_brand").alias("identifier"))).alias("pairs"),
        F.array(F.floor(F.col("p_retailprice") * 10)).cast(_NONE).alias("durations"),
        F.array(F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")).alias("peer_ids"),
        none.alias("positions"),
    )
    e = _entries(p, "p_partkey", F.concat_ws("|", "p_type", "p_brand"), F.array("p_name"))
    found = blocking.block_pairs(blocking.exact_name_keys(e)).distinct()
    return scoring.decide(scoring.pair_up(found, scoring.prepare(entries)))


@query(
    """SELECT p_type AS entry_type, count(*) FILTER (p_size > 40) AS merge, count(*) FILTER (p_size BETWEEN 31 AND 40) AS relate,
    count(*) FILTER (p_size BETWEEN 11 AND 30) AS "distinct", count(*) FILTER (p_size <= 10) AS defer FROM part GROUP BY 1"""
)
def verdict_stats(spark, d):
    v = F.when(F.col("p_size") > 40, "merge").when(F.col("p_size") > 30, "relate").when(F.col("p_size") > 10, "distinct").otherwise("defer")
    return scoring.verdict_stats(t(spark, d, "part").select(F.col("p_type").alias("entry_type"), v.alias("verdict")))


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A'),
    r AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'N'), x AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    SELECT CASE WHEN a IN (SELECT id FROM x) OR b IN (SELECT id FROM x) THEN 'excluded' WHEN (a, b) IN (SELECT (a, b) FROM k) THEN 'related' WHEN (a, b) IN (SELECT (a, b) FROM r) THEN 'different' END AS skip, count(*) AS n
    FROM p GROUP BY 1"""
)
def skip_counters(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag")
    out = t(spark, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entry_id"))
    ids = spark.createDataFrame([], "entry_id long, component long")
    anchors = spark.createDataFrame([], "entry_id long, anchor string")
    judged = scoring.skip_reason(line.select("a", "b").distinct(), out, ids, line.filter("l_returnflag = 'A'"), line.filter("l_returnflag = 'N'"), anchors)
    return judged.groupBy("skip").agg(F.count("*").alias("n"))


# --- maintenance ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < '1998-01-01' AND NOT (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW')")
def stale_set_diff(spark, d):
    o = t(spark, d, "orders")
    old, new = o.filter("o_orderdate < '1998-01-01'"), o.filter("o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
    return resolve.stale(old.select("o_orderkey"), new.select("o_orderkey"), ["o_orderkey"])


@query(
    """SELECT o_orderkey::VARCHAR AS identifier, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price,
    CASE WHEN o_orderdate < '1998-01-01' THEN 1 ELSE 2 END AS run_id FROM orders WHERE o_orderdate < '1998-01-01' OR o_orderstatus <> 'P'"""
)
def merge_latest(spark, d):
    o = t(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").cast("string").alias("identifier"), F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderstatus")
    old = o.filter("o_orderdate < '1998-01-01'").select("source", "identifier", "price", F.lit(10).alias("fetched_at"), F.lit(1).alias("run_id"))
    new = o.filter("o_orderstatus <> 'P'").select("source", "identifier", F.round(F.col("price") * 2, 2).alias("price"), F.lit(20).alias("fetched_at"), F.lit(2).alias("run_id"))
    return resolve.upsert_pairs(old, new).select("identifier", "price", "run_id")


@query(
    """WITH r AS (SELECT least(l_partkey, l_suppkey) AS entry_a, greatest(l_partkey, l_suppkey) AS entry_b, l_returnflag AS kind, l_discount AS confidence, l_linestatus AS origin, l_tax > 0.02 AS enabled FROM lineitem WHERE l_partkey <> l_suppkey)
    SELECT entry_a, entry_b, kind, max(confidence) AS confidence, arg_max(origin, (confidence, origin, enabled)) AS origin, arg_max(enabled, (confidence, origin, enabled)) AS enabled FROM r GROUP BY 1, 2, 3"""
)
def combine_duplicates(spark, d):
    line = t(spark, d, "lineitem").filter("l_partkey <> l_suppkey")
    a, b = V.ordered_pair(F.col("l_partkey"), F.col("l_suppkey"))
    rows = line.select(a.alias("entry_a"), b.alias("entry_b"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("origin"), (F.col("l_tax") > 0.02).alias("enabled"), F.lit(None).cast("string").alias("extra"))
    return resolve.combine_relations(rows).drop("extra")


@query(
    """WITH o AS (SELECT c_custkey AS identifier, CASE WHEN c_acctbal > 0 THEN 'fetch' ELSE 'listing' END AS origin, 'a' || c_nationkey AS url FROM customer),
    n AS (SELECT c_custkey AS identifier, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'fetch' ELSE 'listing' END AS origin, 'b' || c_nationkey AS url FROM customer WHERE c_acctbal < 5000)
    SELECT identifier, CASE WHEN n.url IS NULL OR (o.origin = 'fetch' AND n.origin = 'listing') THEN o.url ELSE n.url END AS url FROM o LEFT JOIN n USING (identifier)"""
)
def image_priority(spark, d):
    c = t(spark, d, "customer")
    rows = lambda origin, p: c.select(F.lit("c").alias("source"), F.col("c_custkey").alias("identifier"), origin.alias("origin"), F.concat(F.lit(p), F.col("c_nationkey").cast("string")).alias("url"), "c_acctbal")
    old = rows(F.when(F.col("c_acctbal") > 0, "fetch").otherwise("listing"), "a").drop("c_acctbal")
    new = rows(F.when(F.col("c_mktsegment") == "HOUSEHOLD", "fetch").otherwise("listing"), "b").filter("c_acctbal < 5000").drop("c_acctbal")
    return resolve.upsert_images(old, new).select("identifier", "url")


@query(
    """SELECT l_orderkey AS class_id, CASE WHEN min(l_linenumber) FILTER (l_returnflag = 'A') IS NOT NULL THEN 'artist' WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'track'
      WHEN count(DISTINCT l_linestatus) = 1 AND min(l_linestatus) = 'F' THEN 'release' WHEN count(DISTINCT l_linestatus) = 1 THEN 'release_group' ELSE 'unknown' END AS entry_type FROM lineitem GROUP BY 1"""
)
def type_reconcile(spark, d):
    line = t(spark, d, "lineitem")
    stated = line.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("class_id"), F.when(F.col("l_returnflag") == "A", "artist").otherwise("track").alias("entry_type"))
    stubs = line.select(F.col("l_orderkey").alias("class_id"), F.when(F.col("l_linestatus") == "F", "release").otherwise("release_group").alias("entry_type"))
    return resolve.reconciled_types(stated, stubs)


@query(
    """WITH s AS (SELECT l_partkey AS work_id, o_orderkey AS recording_id, o_orderstatus AS title, o_orderdate AS d, l_linenumber AS ordinal, l_returnflag = 'R' AS derived, l_quantity AS len, l_linestatus
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
    a AS (SELECT *, bool_or(NOT derived) OVER (PARTITION BY work_id) AS any_plain FROM s), b AS (SELECT * FROM a WHERE any_plain = NOT derived),
    c AS (SELECT *, bool_or(title = 'O') OVER (PARTITION BY work_id) AS own FROM b), e AS (SELECT * FROM c WHERE own = (title = 'O')),
    r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY d, len > 25 DESC, ordinal, recording_id) AS n FROM e),
    top AS (SELECT work_id, d, len, title FROM r WHERE n = 1)
    SELECT r.work_id, recording_id FROM r JOIN top ON r.work_id = top.work_id WHERE n = 1 OR (r.d = top.d AND abs(r.len - top.len) * 1000 <= 2000 AND r.title = top.title)"""
)
def original_anchors(spark, d):
    j = t(spark, d, "lineitem").filter("l_linestatus = 'F'").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = j.select(
        F.col("l_partkey").alias("work_id"),
        F.lit("O").alias("work_title"),
        F.col("o_orderkey").alias("recording_id"),
        F.col("o_orderstatus").alias("title"),
        F.col("l_linenumber").alias("ordinal"),
        F.array().cast("array<string>").alias("attributes"),
        F.lit(False).alias("video"),
        (F.col("l_returnflag") == "R").alias("derived"),
        F.col("o_orderdate").alias("first_date"),
        (F.col("l_quantity") > 25).alias("has_isrc"),
        (F.col("l_quantity") * 1000).alias("length_ms"),
    )
    return resolve.original_anchors(rows)


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a, b, CASE WHEN b > 10 THEN b ELSE a END AS derived FROM e"""
)
def derived_sides(spark, d):
    e = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    derived, _ = scoring.resolved_side(F.col("a"), F.col("b"), F.when(F.col("b") > 10, "b").otherwise("a"))
    return e.select("a", "b", derived.alias("derived"))


@query()
def resolved_import(spark, d):
    """Suppliers are known pairs of their nation's entry; all lines state links between them and parts."""
    s, line = t(spark, d, "supplier"), t(spark, d, "lineitem")
    name = lambda c: F.col(c).cast("string")
    pairs = s.select(F.lit("supplier").alias("source"), name("s_suppkey").alias("identifier")).unionByName(line.select(F.lit("part").alias("source"), name("l_partkey").alias("identifier"))).distinct()
    links = line.select(F.lit("part").alias("a_source"), name("l_partkey").alias("a_identifier"), F.lit("supplier").alias("b_source"), name("l_suppkey").alias("b_identifier")).distinct()
    existing = s.select(F.lit("supplier").alias("source"), name("s_suppkey").alias("identifier"), F.col("s_nationkey").cast("long").alias("entry_id")).filter("entry_id < 10")
    anchors = s.filter("s_acctbal > 0").select(F.lit("supplier").alias("source"), name("s_suppkey").alias("identifier"), name("s_nationkey").alias("anchor"))
    classes = staged(resolve.labelled_classes(pairs, links, existing, anchors), "classes")
    ids = resolve.assign_entries(classes, existing).select("class_id", "entry_id", F.size("merged").alias("merged"))
    return classes.join(ids, "class_id").select("source", "identifier", "entry_id", "merged")


@query()
def whole_match(spark, d):
    """Suppliers are matched as artists of their nation: candidates, skips, verdicts, and the relations to write."""
    sup = t(spark, d, "supplier")
    name = F.concat_ws(" ", F.lit("The"), F.element_at(F.split("s_name", "#"), 1), F.col("s_nationkey").cast("string"))
    none = F.array().cast(_NONE)
    entries = sup.select(
        F.col("s_suppkey").alias("entry_id"),
        F.lit("artist").alias("entry_type"),
        F.array(F.struct(F.lit("musicbrainz").alias("source"), name.alias("name"))).alias("sourced_aliases"),
        F.array(F.struct(F.lit("musicbrainz").alias("source"), F.col("s_name").alias("identifier"))).alias("pairs"),
        none.alias("durations"),
        F.array(F.col("s_nationkey").cast("bigint")).alias("peer_ids"),
        F.array().cast("array<struct<release_id:bigint,disc_no:int,track_no:int>>").alias("positions"),
        F.array(name).alias("aliases"),
        none.alias("child_ids"),
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    relations = empty("entry_a long, entry_b long, kind string, confidence double, origin string, enabled boolean, extra string")
    out = match.match(entries, relations, empty("a long, b long"), empty("entry_id long, anchor string"), empty("entry_id long"))
    return out.relations
