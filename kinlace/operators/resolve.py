"""Import resolution and maintenance: new snapshots of a library's tables from what was fetched.

A library is a dict of DataFrames by table name. Tables are keyed by pairs (source, identifier) in two columns;
DML is expressed as a transform from one snapshot to the next, so nothing is changed in place."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions import urls
from kinlace.functions import values as V
from kinlace.operators.graph import components
from kinlace.operators.staging import staged

PAIR = ["source", "identifier"]


# --- keyed merges -----------------------------------------------------------------------------------------


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert_pairs(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """The last observation of a pair stands; run_id stays that of the first insert. Columns: PAIR, fetched_at, run_id, ..."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(observed.withColumn("__new", F.lit(1)))
    first = both.groupBy(*PAIR).agg(F.min_by("run_id", "__new").alias("__run"))
    last = latest(both, PAIR, F.desc("__new"), F.desc_nulls_last("fetched_at"))
    return last.join(first, PAIR).withColumn("run_id", F.col("__run")).drop("__new", "__run")


def upsert_stubs(stored: DataFrame, stubs: DataFrame) -> DataFrame:
    """Stubs (PAIR, duration_ms) add missing pairs, and fill a duration that a stored stub (fetched_at null) lacks."""
    best = stubs.groupBy(*PAIR).agg(F.max("duration_ms").alias("__d"))
    filled = stored.join(best, PAIR, "left").withColumn("duration_ms", F.when(F.col("fetched_at").isNull(), F.coalesce("duration_ms", "__d")).otherwise(F.col("duration_ms"))).drop("__d")
    return filled.unionByName(best.withColumnRenamed("__d", "duration_ms").join(stored, PAIR, "left_anti"), allowMissingColumns=True)


def upsert_images(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """An image from a fetch replaces one from a listing, never the reverse; among equals the newer stands."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(observed.withColumn("__new", F.lit(1)))
    return latest(both, PAIR, F.when(F.col("origin") == "fetch", 0).otherwise(1), F.desc("__new"), F.col("url")).drop("__new")


def upsert_privacy(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """provider and manual are independent: each stays until the other snapshot states it."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(observed.withColumn("__new", F.lit(1)))
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__new"))).alias(c)
    return both.groupBy(*PAIR).agg(pick("provider"), pick("manual"), F.max("checked_at").alias("checked_at"))


def shareable(privacy: DataFrame) -> DataFrame:
    """PAIR, shareable: all but YouTube, and what is effectively public there; a manual setting goes first."""
    public = F.coalesce("manual", "provider") == "public"
    return privacy.select(*PAIR, (F.col("source") != "youtube") | F.coalesce(public, F.lit(False))).toDF(*PAIR, "shareable")


def insert_absent(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored and the rows of new whose key it lacks; nulls are equal."""
    fresh = new.dropDuplicates(key).alias("n")
    same = reduce(lambda x, y: x & y, [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key])
    return stored.unionByName(fresh.join(stored.select(*key).alias("s"), same, "left_anti"), allowMissingColumns=True)


def keep_first(rows: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Rows with the least id of each key; null keys are equal."""
    keep = rows.groupBy(*key).agg(F.min(id_col).alias(id_col)).select(id_col)
    return rows.join(keep, id_col, "left_semi")


def upsert_relations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By (entry_a, entry_b, kind) in order of ids: a conflict takes the new confidence, origin and enabled, and keeps extra."""
    key = ["entry_a", "entry_b", "kind"]
    a, b = V.ordered_pair(F.col("entry_a"), F.col("entry_b"))
    fresh = new.withColumn("__a", a).withColumn("entry_b", b).withColumn("entry_a", F.col("__a")).drop("__a")
    joined = stored.alias("s").join(fresh.alias("n"), key, "full_outer")
    picked = [F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in ("confidence", "origin", "enabled")]
    extra = F.when(F.col("s.confidence").isNotNull(), F.col("s.extra")).otherwise(F.col("n.extra")).alias("extra")
    return joined.select(*key, *picked, extra)


def combine_relations(rows: DataFrame) -> DataFrame:
    """Rows of one (entry_a, entry_b, kind) become one: the scalars of the most confident (then by origin and enabled), and all extras."""
    combine = F.pandas_udf(lambda s: s.map(lambda x: V.combine_extra(list(x))), "string")
    best = F.max(F.struct("confidence", "origin", "enabled")).alias("best")
    out = rows.groupBy("entry_a", "entry_b", "kind").agg(best, F.collect_list(F.coalesce("extra", F.lit("null"))).alias("extras"))
    return out.select("entry_a", "entry_b", "kind", "best.confidence", "best.origin", "best.enabled", combine("extras").alias("extra"))


def remap_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations after entries (old_id) became others (new_id): their ends and extras follow, self-edges go, duplicates combine."""
    wide = relations.join(ids.toDF("entry_a", "na"), "entry_a", "left").join(ids.toDF("entry_b", "nb"), "entry_b", "left")
    wide = wide.withColumn("na", F.coalesce("na", "entry_a")).withColumn("nb", F.coalesce("nb", "entry_b")).filter("na <> nb")

    @F.pandas_udf("string")
    def follow(extra: pd.Series, a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([V.remap_extra(e, {p: q, r: s}) for e, p, q, r, s in zip(extra, a, x, b, y, strict=True)], dtype=object)

    moved = wide.withColumn("extra", F.when(F.col("extra").isNotNull(), follow("extra", "entry_a", "na", "entry_b", "nb")))
    a, b = V.ordered_pair(F.col("na"), F.col("nb"))
    return combine_relations(moved.select(a.alias("entry_a"), b.alias("entry_b"), "kind", "confidence", "origin", "enabled", "extra"))


def merge_entries(library: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table with entry ids after losers (old_id) were merged into winners (new_id)."""
    out = dict(library)
    for name in ("entry_source", "entry_display_name", "credit_display_name", "play_event", "dedup_block_key"):
        if name in out:
            t = out[name]
            moved = t.join(ids.toDF("entry_id", "__to"), "entry_id", "left")
            out[name] = moved.withColumn("entry_id", F.coalesce("__to", "entry_id")).drop("__to").select(*t.columns).distinct()
    if "entry" in out:
        out["entry"] = out["entry"].join(ids.select(F.col("old_id").alias("id")), "id", "left_anti")
    if "entry_relation" in out:
        out["entry_relation"] = remap_relations(out["entry_relation"], ids)
    return out


# --- set differences --------------------------------------------------------------------------------------


def stale(stored: DataFrame, current: DataFrame, key: list[str], owners: DataFrame | None = None, owner: list[str] | None = None) -> DataFrame:
    """Stored rows that current no longer states; only of owners (e.g. re-fetched pairs), if given."""
    mine = stored if owners is None else stored.join(owners.select(*owner).distinct(), owner, "left_semi")
    return mine.join(current.select(*key).distinct(), key, "left_anti")


def replaced(stored: DataFrame, current: DataFrame, key: list[str], owners: DataFrame, owner: list[str]) -> DataFrame:
    """stored without what re-fetched owners no longer state, and with what they state now."""
    kept = stored.join(owners.select(*owner).distinct(), owner, "left_anti")
    mine = current.join(owners.select(*owner).distinct(), owner, "left_semi").dropDuplicates(key)
    return kept.unionByName(mine, allowMissingColumns=True)


def orphans(entries: DataFrame, sources: DataFrame) -> DataFrame:
    return entries.join(sources.select(F.col("entry_id").alias("id")).distinct(), "id", "left_anti")


def unsupported_relations(relations: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Provider relations between entries that no edge joins any more, in either direction. edges: parent and child pairs."""
    of = sources.select("source", "identifier", "entry_id")
    ends = edges.join(of.toDF("parent_source", "parent_identifier", "p"), ["parent_source", "parent_identifier"]).join(of.toDF("child_source", "child_identifier", "c"), ["child_source", "child_identifier"])
    held = ends.select(F.least("p", "c").alias("entry_a"), F.greatest("p", "c").alias("entry_b")).distinct()
    return relations.filter(F.col("origin") == "provider").join(held, ["entry_a", "entry_b"], "left_anti")


def rolled_back(table: DataFrame, run_id: int) -> DataFrame:
    return table.filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that were added, removed or changed between two snapshots: what triggers would have marked."""
    a, b = (t.select(*sorted(t.columns)) for t in (old, new))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(*key).distinct()


# --- resolution -------------------------------------------------------------------------------------------


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with their canonical form, where the identifier is a page of a known kind."""
    found = urls.canonicalize(F.col("identifier"))
    return pairs.withColumn("__c", found).withColumn("source", F.coalesce("__c.source", "source")).withColumn("identifier", F.coalesce("__c.identifier", "identifier")).drop("__c")


def labelled_classes(pairs: DataFrame, links: DataFrame, existing: DataFrame, anchors: DataFrame) -> DataFrame:
    """source, identifier, class_id (the least pair of the class).

    Pairs with one anchor are one class, and classes of different anchors never meet; links unite in sorted order, then
    pairs of one existing entry. A link is refused if both its classes have anchors by then, so what unites is the least spanning
    forest of the links once all anchors are one node; `_least_forest` finds it by joins, however large a component is.
    links: a_source, a_identifier, b_source, b_identifier; existing: PAIR, entry_id; anchors: PAIR, anchor. A link's end that is
    none of pairs unites others, but has no row."""
    key = lambda s, i: F.struct(F.col(s).alias("s"), F.col(i).alias("i"))
    fresh = links.select(key("a_source", "a_identifier").alias("a"), key("b_source", "b_identifier").alias("b")).filter("a <> b")
    fresh = fresh.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("turn"))
    first = existing.groupBy("entry_id").agg(F.min(key("source", "identifier")).alias("a"))
    old = existing.join(first, "entry_id").select("a", key("source", "identifier").alias("b"), F.lit(2).alias("turn")).filter("a <> b")
    edges = staged(fresh.unionByName(old), "links")
    held = anchors.filter("anchor IS NOT NULL").select(key("source", "identifier").alias("node"), "anchor").distinct()
    parts = [pairs.select(key("source", "identifier").alias("node"), F.lit(True).alias("asked")), *(x.withColumn("asked", F.lit(False)) for x in (edges.select(F.col("a").alias("node")), edges.select(F.col("b").alias("node")), held.select("node")))]
    nodes = staged(numbered(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("asked").alias("asked")), "node"), "nodes")
    held = staged(held.join(nodes, "node").select("n", "anchor"), "anchors")
    stars = held.join(held.groupBy("anchor").agg(F.min("n").alias("a")), "anchor").select("a", F.col("n").alias("b"))
    fixed = staged(components(stars, held.select(F.col("n").alias("node"))), "fixed")  # a pair of several anchors makes them one
    nodes = staged(nodes.join(fixed.toDF("n", "home"), "n", "left"), "placed")
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("home").alias(f"h{x}"))
    rows = edges.join(end("a"), "a").join(end("b"), "b").filter("ha IS NULL OR hb IS NULL").select("turn", F.col("na").alias("lo"), F.col("nb").alias("hi"), "ha", "hb")
    free = nodes.filter("home IS NULL").select("n", F.col("n").alias("part"))
    placed = _least_forest(free, staged(rows, "edges")).unionByName(nodes.filter("home IS NOT NULL").select("n", F.col("home").alias("part")))
    placed = staged(placed, "parts")
    least = placed.groupBy("part").agg(F.min("n").alias("n")).join(nodes.select("n", F.col("node").alias("class_id")), "n").select("part", "class_id")
    out = nodes.filter("asked").select("n", "node").join(placed, "n").join(least, "part")
    return out.select("node.s", "node.i", "class_id").toDF("source", "identifier", "class_id")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with n, a long that ascends with the column by: ranks within ranges, and the ranges' offsets."""
    part = staged(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = part.groupBy("__part").agg(F.count("*").alias("__size"))  # a row for each task
    before = sums.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return part.withColumn("__rank", rank).join(before, "__part").withColumn("n", F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before", "__size")


def _least_forest(free: DataFrame, edges: DataFrame) -> DataFrame:
    """n, part: the parts of free nodes (n, part, each its own) that the least spanning forest of edges makes.

    edges: turn, lo, hi (the ends' numbers; edges go in the order of these three), ha, hb (the fixed part that an end is in, or null).
    Each part that isn't fixed takes its least edge that leads out, which the forest has in any case; parts of one chain of such edges
    become one, so their number halves at least with each round. All fixed parts are one node of the forest: of a part's edges to
    them only the least can count, and edges between them go."""
    rank = ["turn", "lo", "hi"]
    least = lambda rows, to: rows.groupBy("u").agg(F.min(F.struct(*rank, *to)).alias("e")).select("u", "e.*")
    rooted = edges.filter("ha IS NOT NULL OR hb IS NOT NULL").select(*rank, F.when(F.col("ha").isNull(), F.col("lo")).otherwise(F.col("hi")).alias("u"), F.coalesce("ha", "hb").alias("v"))
    rooted = staged(least(rooted, ["v"]), "rooted")
    loose = edges.filter("ha IS NULL AND hb IS NULL").select(*rank, F.col("lo").alias("u"), F.col("hi").alias("v"))
    loose = staged(loose, "loose")
    parts = free
    while True:
        out = [rooted.withColumn("fixed", F.lit(True)), *(loose.select(*rank, F.col(x).alias("u"), F.col(y).alias("v"), F.lit(False).alias("fixed")) for x, y in ("uv", "vu"))]
        picks = staged(least(reduce(DataFrame.unionByName, out), ["v", "fixed"]).select("u", "v", "fixed"), "picks")
        if picks.isEmpty():
            return parts
        tops = staged(_tops(picks), "tops")
        parts = staged(parts.join(tops.select(F.col("u").alias("part"), "top"), "part", "left").select("n", F.coalesce("top", "part").alias("part")), "free")
        # a part with an edge has a pick, and so a top
        end = lambda x: tops.select(F.col("u").alias(x), F.col("top").alias(f"t{x}"), F.col("fixed").alias(f"f{x}"))  # noqa: B023, E731
        kept = rooted.join(end("u"), "u").filter("NOT fu").select(*rank, F.col("tu").alias("u"), "v")
        moved = staged(loose.join(end("u"), "u").join(end("v"), "v").filter("tu <> tv AND NOT (fu AND fv)").select(*rank, "tu", "tv", "fu", "fv"), "moved")
        met = moved.filter("fu OR fv").select(*rank, F.when(F.col("fu"), F.col("tv")).otherwise(F.col("tu")).alias("u"), F.when(F.col("fu"), F.col("tu")).otherwise(F.col("tv")).alias("v"))
        rooted = staged(least(kept.unionByName(met), ["v"]), "rooted")
        both = moved.filter("NOT fu AND NOT fv").groupBy(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
        loose = staged(both.agg(F.min(F.struct(*rank)).alias("e")).select("e.*", "u", "v"), "loose")


def _tops(picks: DataFrame) -> DataFrame:
    """u, top, fixed: where the chain of picks (u, v, fixed: v is a fixed part) from u ends. Two parts that pick each other end at the lesser."""
    back = picks.filter("NOT fixed").select(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(True).alias("mutual"))
    ends = F.coalesce("mutual", F.lit(False)) & (F.col("u") < F.col("v"))
    tops = picks.join(back, ["u", "v"], "left").select("u", F.when(ends, F.col("u")).otherwise(F.col("v")).alias("top"), "fixed", (F.col("fixed") | ends).alias("done"))
    tops = staged(tops, "chains")
    while not (going := tops.filter("NOT done")).isEmpty():  # each round doubles the way
        ahead = tops.select(F.col("u").alias("top"), F.col("top").alias("next"), F.col("fixed").alias("f"), F.col("done").alias("d"))
        on = going.join(ahead, "top").select("u", F.col("next").alias("top"), F.col("f").alias("fixed"), F.col("d").alias("done"))
        tops = staged(tops.filter("done").unionByName(on), "chains")
    return tops.select("u", "top", "fixed")


def assign_entries(classes: DataFrame, existing: DataFrame, runs: DataFrame | None = None, preferred: DataFrame | None = None) -> DataFrame:
    """class_id, entry_id, merged (other owned ids, which merge into it).

    An id that several classes hold stays with one: that with a preferred pair, the most pairs of the entry's earliest run
    (none is earliest), the most pairs, the least class. The least owned id is the class's, others merge into it, and a
    class without one gets a fresh id, in order of classes. runs: PAIR, run_id; preferred: PAIR."""
    held = classes.join(existing.select(*PAIR, "entry_id"), PAIR)
    held = held.join(runs.select(*PAIR, "run_id"), PAIR, "left") if runs is not None else held.withColumn("run_id", F.lit(None).cast("long"))
    likes = classes.join(preferred.select(*PAIR).distinct(), PAIR, "left_semi").select("class_id").distinct().withColumn("liked", F.lit(1)) if preferred is not None else None
    early = existing.join(runs.select(*PAIR, "run_id"), PAIR, "left") if runs is not None else existing.withColumn("run_id", F.lit(None).cast("long"))
    early = early.groupBy("entry_id").agg(F.min(F.struct(F.col("run_id").isNotNull().alias("known"), "run_id"))["run_id"].alias("first_run"))
    score = held.join(early, "entry_id").groupBy("entry_id", "class_id").agg(F.sum(F.col("run_id").eqNullSafe(F.col("first_run")).cast("int")).alias("oldest"), F.count("*").alias("total"))
    score = score.join(likes, "class_id", "left") if likes is not None else score.withColumn("liked", F.lit(None).cast("int"))
    keeper = latest(score, ["entry_id"], F.desc(F.coalesce("liked", F.lit(0))), F.desc("oldest"), F.desc("total"), F.asc("class_id"))
    owned = keeper.groupBy("class_id").agg(F.array_sort(F.collect_set("entry_id")).alias("ids"))
    every = classes.select("class_id").distinct().join(owned, "class_id", "left")
    top = existing.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("top"))
    new = staged(every.filter("ids IS NULL").select("class_id"), "new-classes")
    # fresh ids in order of classes: ranks within ranges, and the ranges' offsets
    part = staged(new.repartitionByRange("class_id").withColumn("part", F.spark_partition_id()), "new-parts")
    sums = part.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("class_id"))
    fresh = part.withColumn("rank", rank).join(before, "part").crossJoin(F.broadcast(top)).select("class_id", (F.col("top") + F.col("before") + F.col("rank")).alias("entry_id"), F.slice(F.array("rank"), 2, 1).alias("merged"))  # top: one row
    known = every.filter("ids IS NOT NULL").select("class_id", F.col("ids")[0].alias("entry_id"), F.slice("ids", 2, 1_000_000).alias("merged"))
    kind = known.schema["entry_id"].dataType.simpleString()
    return known.unionByName(fresh.select("class_id", F.col("entry_id").cast(kind), F.transform("merged", lambda x: x.cast(kind)).alias("merged")))


def reconciled_types(stated: DataFrame, stubs: DataFrame) -> DataFrame:
    """class_id, entry_type: the first type that a fetch states; a stub's only where all agree. Both: class_id, entry_type."""
    rank = V.entry_type_rank(F.col("entry_type"))
    fetched = stated.groupBy("class_id").agg(F.min(F.struct(rank.alias("r"), "entry_type"))["entry_type"].alias("stated"))
    hinted = stubs.groupBy("class_id").agg(F.when(F.count_distinct("entry_type") == 1, F.min("entry_type")).alias("hinted"))
    return fetched.join(hinted, "class_id", "full_outer").select("class_id", F.coalesce("stated", "hinted", F.lit("unknown")).alias("entry_type"))


def resolve_import(library: dict[str, DataFrame], landed: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """The next snapshot of a library after an import.

    library: entry_source (PAIR, entry_id, fetched_at, duration_ms, run_id), entry (id, entry_type), entry_alias, entry_child,
    pair_link, contribution, barrier_member (PAIR, anchor). landed: metadata (PAIR, entry_type, fetched_at, duration_ms), stubs
    (PAIR, entry_type, duration_ms), links, aliases, children, credits, and images and privacy if the library has image and privacy.
    Entries that merge take their plays, display names, block keys and relations along, if the library has these tables."""
    canon = {k: canonical_pairs(v) if set(PAIR) <= set(v.columns) else v for k, v in landed.items()}
    known = library["entry_source"]
    link_cols = ["a_source", "a_identifier", "b_source", "b_identifier"]
    links = canon["links"].select(*link_cols)
    ends = links.select(F.col("a_source").alias("source"), F.col("a_identifier").alias("identifier")).unionByName(links.select(F.col("b_source").alias("source"), F.col("b_identifier").alias("identifier")))
    pairs = reduce(DataFrame.unionByName, [canon["metadata"].select(*PAIR), canon["stubs"].select(*PAIR), ends, known.select(*PAIR)]).distinct()
    existing = known.select(*PAIR, "entry_id")
    # a re-fetched pair's stored links that it no longer states are retracted
    owners = canon["metadata"].select(*PAIR).distinct()
    retracted = stale(library["pair_link"], links, link_cols, owners.toDF("a_source", "a_identifier"), ["a_source", "a_identifier"])
    kept_links = library["pair_link"].join(retracted.select(*link_cols), link_cols, "left_anti")
    classes = staged(labelled_classes(pairs, links.unionByName(kept_links.select(*link_cols)), existing, library["barrier_member"]), "classes")
    ids = staged(assign_entries(classes, existing, known.select(*PAIR, "run_id")), "ids")
    placed = classes.join(ids.select("class_id", "entry_id"), "class_id")
    observed = canon["metadata"].select(*PAIR, "fetched_at", "duration_ms").withColumn("run_id", F.lit(run_id).cast("long"))
    stored = known.select(*PAIR, "fetched_at", "duration_ms", "run_id")
    sources = upsert_stubs(upsert_pairs(stored, observed), canon["stubs"].select(*PAIR, "duration_ms"))
    sources = sources.withColumn("run_id", F.coalesce("run_id", F.lit(run_id))).join(placed.select(*PAIR, "entry_id"), PAIR)
    types = reconciled_types(canon["metadata"].select(*PAIR, "entry_type").join(placed, PAIR), canon["stubs"].select(*PAIR, "entry_type").join(placed, PAIR))
    entries = ids.select("class_id", F.col("entry_id").alias("id")).join(types, "class_id", "left").join(library["entry"].withColumnRenamed("entry_type", "__old"), "id", "left")
    entries = entries.select("id", F.when(F.coalesce("entry_type", F.lit("unknown")) != "unknown", F.col("entry_type")).otherwise(F.coalesce("__old", F.lit("unknown"))).alias("entry_type"))
    out = dict(library) | {"entry_source": sources, "entry": entries}
    out["entry_alias"] = replaced(library["entry_alias"], canon["aliases"], [*PAIR, "name", "locale"], owners, PAIR)
    parent = ["parent_source", "parent_identifier"]
    out["entry_child"] = replaced(library["entry_child"], canon["children"], [*parent, "child_source", "child_identifier"], owners.toDF(*parent), parent)
    out["contribution"] = replaced(library["contribution"], canon["credits"], [*PAIR, "artist_source", "artist_identifier", "role"], owners, PAIR)
    out["pair_link"] = insert_absent(kept_links, links, link_cols)
    if "image" in library and "images" in canon:
        out["image"] = upsert_images(library["image"], canon["images"])
    if "privacy" in library and "privacy" in canon:
        out["privacy"] = upsert_privacy(library["privacy"], canon["privacy"])
    # what other entries' tables say of a merged one follows it
    merges = ids.select(F.explode("merged").alias("old_id"), F.col("entry_id").alias("new_id"))
    return merge_entries(out, staged(merges, "merges"))


def regroup(pairs: DataFrame, links: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """PAIR, entry_id, part: the parts of each entry (pairs: PAIR, entry_id) that its remaining links still hold together, by
    falling size; gone pairs (PAIR) belong to the largest part. Only links within an entry count."""
    key = lambda s, i: F.struct(F.col(s).alias("s"), F.col(i).alias("i"))
    of = pairs.select(key("source", "identifier").alias("node"), "entry_id")
    lost = gone.select(key("source", "identifier").alias("node")) if gone is not None else of.select("node").limit(0)
    live = of.join(lost, "node", "left_anti")
    edges = links.select(key("a_source", "a_identifier").alias("a"), key("b_source", "b_identifier").alias("b"))
    inside = edges.join(live.toDF("a", "ea"), "a").join(live.toDF("b", "eb"), "b").filter("ea = eb").select("a", "b")
    comps = staged(components(inside, live.select("node")), "regroup").join(live, "node")
    size = comps.groupBy("entry_id", "component").agg(F.count("*").alias("n"))
    part = size.withColumn("part", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("n"), "component")) - 1)
    out = comps.join(part.select("entry_id", "component", "part"), ["entry_id", "component"]).select("node", "entry_id", "part")
    out = out.unionByName(of.join(lost, "node", "left_semi").select("node", "entry_id", F.lit(0).alias("part")))
    return out.select("node.s", "node.i", "entry_id", "part").toDF("source", "identifier", "entry_id", "part")


def original_anchors(performances: DataFrame, length_tolerance_ms: int = 2_000) -> DataFrame:
    """work_id, recording_id of each work's original recording, and of what looks like its duplicates.

    performances: work_id, work_title, recording_id, title, ordinal, attributes array<string>, video, derived (its note says it is no
    original), first_date, has_isrc, length_ms. Of untagged ones, those not derived if any; then those of the work's own
    title if any; then the earliest date, an ISRC, the given order."""
    fold = lambda c: F.lower(F.trim(c))
    by_work = Window.partitionBy("work_id")
    untagged = performances.filter(F.size("attributes") == 0)
    plain = (~(F.col("video") | F.col("derived"))).cast("int")
    step = untagged.withColumn("p", plain).withColumn("any_p", F.max("p").over(by_work)).filter("p = any_p")
    own = (fold(F.col("title")) == fold(F.col("work_title"))).cast("int")
    step = step.withColumn("t", own).withColumn("any_t", F.max("t").over(by_work)).filter("t = any_t")
    ranked = step.withColumn("rank", F.row_number().over(by_work.orderBy(F.asc_nulls_last("first_date"), F.desc("has_isrc"), "ordinal", "recording_id")))
    top = ranked.filter("rank = 1").select("work_id", F.col("first_date").alias("d"), F.col("length_ms").alias("l"), fold(F.col("title")).alias("f"))
    near = ranked.join(top, "work_id")
    twin = (F.col("first_date") == F.col("d")) & (F.abs(F.col("length_ms") - F.col("l")) <= length_tolerance_ms) & (fold(F.col("title")) == F.col("f"))
    return near.filter((F.col("rank") == 1) | twin).select("work_id", "recording_id")


# --- two libraries, settings ------------------------------------------------------------------------------


def fold_in(left: DataFrame, right: DataFrame, ids: DataFrame) -> DataFrame:
    """entry_source of two libraries as one: ids (side, entry_id, new_id) as graph.merged_ids gives them; of a pair that both have, the
    row that was fetched last stands, the left one among equals."""
    both = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")), allowMissingColumns=True)
    moved = both.join(ids, ["side", "entry_id"]).withColumn("entry_id", F.col("new_id")).drop("new_id")
    return latest(moved, PAIR, F.desc_nulls_last("fetched_at"), F.col("side")).drop("side")


def checked_fold(merged: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """merged, or an error if a pair was lost or stands twice."""
    want = left.select(*PAIR).unionByName(right.select(*PAIR)).distinct()
    if not merged.groupBy(*PAIR).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a pair stands twice")
    if not want.join(merged, PAIR, "left_anti").isEmpty():
        raise ValueError("a pair was lost")
    return merged


def set_preference(stored: DataFrame, components: DataFrame, entry_id: int, weight: float) -> DataFrame:
    """preferred (entry_id, weight) after one was set: one a component, none for a weight of 0."""
    mine = components.join(components.filter(F.col("entry_id") == entry_id).select("component"), "component", "left_semi").select("entry_id")
    kept = stored.join(mine, "entry_id", "left_anti")
    return kept if weight == 0 else kept.unionByName(stored.sparkSession.createDataFrame([(entry_id, float(weight))], stored.select("entry_id", "weight").schema))


def record_feedback(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with new judgments; each supersedes the newest one of its pair. Both have id, entry_a, entry_b, created_at, supersedes_id."""
    newest = latest(ledger, ["entry_a", "entry_b"], F.desc("created_at"), F.desc("id")).select("entry_a", "entry_b", F.col("id").alias("__old"))
    fresh = rows.drop("supersedes_id").join(newest, ["entry_a", "entry_b"], "left").withColumnRenamed("__old", "supersedes_id")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def barrier_violations(members: DataFrame, sources: DataFrame) -> DataFrame:
    """entry_id, anchors: entries that hold pairs of several anchors, which have to be regrouped. members: PAIR, anchor."""
    held = members.join(sources.select(*PAIR, "entry_id"), PAIR).groupBy("entry_id").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    return held.filter(F.size("anchors") > 1)
