"""Candidate retrieval: blocking channels over entries.

An entry is a row with entry_id, entry_type, aliases array<string>, durations array<long>, peer_ids array<long>
and child_ids array<long>. A channel gives pairs (a, b) with a < b and a bit; `unknown` entries take no part.
A block of more than `max_block` members is no evidence and is dropped as a whole, before any pairing, which
also bounds the pairs that one key makes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions import text

EXACT_NAME, TOKEN, CHAR_NGRAM, DURATION_CREDIT, TRACKLIST, TRACKLIST_OVERLAP, SEMANTIC = (1 << i for i in range(7))
CHANNELS = {EXACT_NAME: "exact_name", TOKEN: "token", CHAR_NGRAM: "char_ngram", DURATION_CREDIT: "duration_credit", TRACKLIST: "tracklist", TRACKLIST_OVERLAP: "tracklist_overlap", SEMANTIC: "semantic_ann"}
MAX_BLOCK, NGRAM_K, BUCKET_MS = 50, 30, 5_000
OVERLAP_SHARED, OVERLAP_JACCARD = 2, 0.18


def keyed(entries: DataFrame, keys: Column) -> DataFrame:
    """entry_id, entry_type, key: distinct keys of each entry."""
    known = entries.filter(F.coalesce(F.col("entry_type"), F.lit("unknown")) != "unknown")
    return known.select("entry_id", "entry_type", F.explode(keys).alias("key")).filter("key IS NOT NULL").distinct()


def bounded(keys: DataFrame, max_block: int = MAX_BLOCK, by: tuple[str, ...] = ("entry_type", "key")) -> DataFrame:
    """Keys whose blocks have 2 to max_block members; others are dropped whole."""
    sizes = keys.groupBy(*by).agg(F.count("*").alias("size")).filter(F.col("size").between(2, max_block)).drop("size")
    return keys.join(sizes, list(by))


def block_pairs(keys: DataFrame, max_block: int = MAX_BLOCK, by: tuple[str, ...] = ("entry_type", "key")) -> DataFrame:
    """a, b for each block that two entries share, as often as they share one."""
    some = bounded(keys, max_block, by)
    left, right = some.withColumnRenamed("entry_id", "a"), some.withColumnRenamed("entry_id", "b")
    return left.join(right, list(by)).filter("a < b").select("a", "b")


def names(aliases: str = "aliases") -> Column:
    """Normalised aliases, which must be in NFKC form (functions.text.normalize brings them there)."""
    return F.array_distinct(F.transform(aliases, text.normalize_plain))


def exact_name_keys(entries: DataFrame) -> DataFrame:
    return keyed(entries, F.filter(F.transform(names(), text.compact), lambda n: F.length(n) >= 2))


def token_keys(entries: DataFrame) -> DataFrame:
    return keyed(entries, F.filter(F.flatten(F.transform(names(), lambda n: F.split(n, " "))), lambda t: F.length(t) > 1))


def gram_keys(entries: DataFrame) -> DataFrame:
    return keyed(entries, F.flatten(F.transform(F.transform(names(), text.compact), text.trigrams)))


def duration_keys(entries: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """One key for each peer and each of a duration's bucket and its two neighbours."""
    buckets = F.flatten(F.transform("durations", lambda d: F.sequence(F.floor(d / bucket_ms) - 1, F.floor(d / bucket_ms) + 1)))
    return keyed(entries, F.flatten(F.transform("peer_ids", lambda p: F.transform(buckets, lambda b: F.concat_ws("|", p.cast("string"), b.cast("string"))))))


def tracklist_keys(entries: DataFrame) -> DataFrame:
    """The whole sorted list of children is the key."""
    listed = F.array_sort(F.array_distinct("child_ids"))
    return keyed(entries, F.when(F.size("child_ids") > 0, F.array(F.array_join(listed, ","))).otherwise(F.array().cast("array<string>")))


def child_keys(entries: DataFrame) -> DataFrame:
    return keyed(entries, F.transform("child_ids", lambda c: c.cast("string")))


def block_keys(entries: DataFrame) -> DataFrame:
    """entry_id, block_key: the stored index of all channels, the channel in the key's prefix."""
    parts = {"exact": exact_name_keys, "token": token_keys, "gram": gram_keys, "dur": duration_keys, "tracklistfp": tracklist_keys, "trackchild": child_keys}
    return reduce(DataFrame.unionByName, [f(entries).select("entry_id", F.concat_ws("|", F.lit(p), "entry_type", "key").alias("block_key")) for p, f in parts.items()]).distinct()


def shared_counts(keys: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """a, b, shared: how many bounded blocks two entries share."""
    return block_pairs(keys, max_block).groupBy("a", "b").agg(F.count("*").alias("shared"))


def top_neighbours(shared: DataFrame, k: int = NGRAM_K, least: int = 2) -> DataFrame:
    """Pairs that either side ranks among its k best by (shared, id) descending, of those that share enough."""
    sides = shared.select(F.col("a").alias("me"), F.col("b").alias("other"), "shared").unionByName(shared.select(F.col("b").alias("me"), F.col("a").alias("other"), "shared"))
    ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("shared"), F.desc("other"))))
    kept = ranked.filter((F.col("rank") <= k) & (F.col("shared") >= least))
    return kept.select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()


def overlapping_sets(entries: DataFrame, max_block: int = MAX_BLOCK, least: int = OVERLAP_SHARED, jaccard: float = OVERLAP_JACCARD, focus: DataFrame | None = None) -> DataFrame:
    """Pairs whose child sets share enough, counted over bounded children, and by Jaccard similarity of the whole sets."""
    sizes = entries.select("entry_id", F.size(F.array_distinct("child_ids")).alias("n"))
    a, b = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    keys = child_keys(entries) if focus is None else touched(child_keys(entries), focus)
    shared = shared_counts(keys, max_block).filter(F.col("shared") >= least)
    return shared.join(a, "a").join(b, "b").filter(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= jaccard).select("a", "b")


def candidates(entries: DataFrame, max_block: int = MAX_BLOCK, ngram_k: int = NGRAM_K, semantic: DataFrame | None = None, focus: DataFrame | None = None) -> DataFrame:
    """a, b, channels: the union of all channels, their bits joined by OR. semantic: pairs (a, b) of the vector channel.

    focus (entry_id): only pairs that touch these, by way of the blocks that they are in. What a neighbour of theirs ranks
    best takes that neighbour's own blocks too, so grams are counted one step further."""
    near = lambda keys: keys if focus is None else touched(keys, focus)
    grams = gram_keys(entries)
    if focus is not None:
        grams = bounded(grams, max_block)
        grams = touched(grams, touched(grams, focus))
    found = {
        EXACT_NAME: block_pairs(near(exact_name_keys(entries)), max_block),
        TOKEN: block_pairs(near(token_keys(entries)), max_block),
        CHAR_NGRAM: top_neighbours(shared_counts(grams, max_block), ngram_k),
        DURATION_CREDIT: block_pairs(near(duration_keys(entries)), max_block),
        TRACKLIST: block_pairs(near(tracklist_keys(entries)), max_block),
        TRACKLIST_OVERLAP: overlapping_sets(entries, max_block, focus=focus),
    }
    if semantic is not None:
        found[SEMANTIC] = semantic
    union = reduce(DataFrame.unionByName, [df.select("a", "b", F.lit(bit).alias("bit")) for bit, df in found.items()])
    union = union if focus is None else focused(union, focus, distinct=False)
    return union.groupBy("a", "b").agg(F.bit_or("bit").alias("channels"))


def touched(keys: DataFrame, focus: DataFrame) -> DataFrame:
    """The whole blocks of keys (entry_type, key) that an entry of focus is in."""
    mine = keys.join(focus.select("entry_id").distinct(), "entry_id", "left_semi").select("entry_type", "key").distinct()
    return keys.join(mine, ["entry_type", "key"], "left_semi")


def focused(pairs: DataFrame, focus: DataFrame, distinct: bool = True) -> DataFrame:
    """Pairs that touch an entry of focus (entry_id): the incremental form of any channel."""
    ids = focus.select(F.col("entry_id").alias("f")).distinct().withColumn("is", F.lit(True))
    marked = pairs.join(ids.toDF("a", "__a"), "a", "left").join(ids.toDF("b", "__b"), "b", "left").filter("__a OR __b").select(*pairs.columns)
    return marked.distinct() if distinct else marked


def focused_block_pairs(keys: DataFrame, focus: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """block_pairs that touch focus, by way of the blocks that focus is in only."""
    return focused(block_pairs(touched(keys, focus), max_block), focus)


def channel_names(bits: Column) -> Column:
    """Names of a pair's channels, for display."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(b) != 0, n) for b, n in CHANNELS.items()]), lambda x: x.isNotNull())
