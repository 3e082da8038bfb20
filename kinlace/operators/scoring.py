"""Scoring of candidate pairs: features once per entry, rules as expressions over pairs, and applying of verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlace.functions import text
from kinlace.functions import values as V
from kinlace.operators.graph import Blocked

#: What a rule gives: verdict merge, relate, distinct or defer.
VERDICT = "struct<verdict:string,kind:string,confidence:double,reason:string,transformation:string,derived_side:string>"


def verdict(name: str, confidence: Column | float | None = None, reason: str | None = None, kind: str | None = None, transformation: Column | None = None, side: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("verdict"),
        F.lit(kind).cast("string").alias("kind"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        F.lit(reason).cast("string").alias("reason"),
        (transformation if transformation is not None else F.lit(None)).cast("string").alias("transformation"),
        (side if side is not None else F.lit(None)).cast("string").alias("derived_side"),
    )


@dataclass(frozen=True)
class Thresholds:
    track_merge: float = 0.90
    track_relate: float = 0.82
    track_same_slot: float = 0.70
    slot_confidence: float = 0.75
    artist_merge: float = 0.90
    artist_relate: float = 0.87
    release_merge: float = 0.90
    release_relate: float = 0.82
    group_merge: float = 0.85
    duration_ms: int = 2_000
    video_ms: int = 60_000


def prepare(entries: DataFrame) -> DataFrame:
    """Entries with what rules need of one side, computed once per entry.

    entries: entry_id, entry_type, sourced_aliases array<struct<source, name>> in order, pairs array<struct<source,
    identifier>>, durations, peer_ids array<long>, positions array<struct<release_id, disc_no, track_no>>."""
    video = lambda s: s.isin(*V.SCRIPT_VIDEO_SOURCES)
    titled = entries.withColumn("clean_names", F.transform(F.filter("sourced_aliases", lambda a: ~video(a["source"])), lambda a: text.clean_title(a["name"])))
    titled = titled.withColumn("first_video", F.get(F.filter("sourced_aliases", lambda a: video(a["source"])), F.lit(0))["name"])
    titled = titled.withColumn("video_main", text.video_title_main("first_video"))
    names = F.transform("sourced_aliases", lambda a: a["name"])
    out = titled.withColumn("aliases", F.coalesce(names, F.array().cast("array<string>")))
    out = out.withColumn("main", F.coalesce(F.get(F.filter(F.transform("clean_names", lambda t: t["main"]), lambda m: m != ""), F.lit(0)), F.col("video_main"), F.lit("")))
    out = out.withColumn("title", text.normalize("main"))
    out = out.withColumn("markers", F.coalesce(F.get(F.filter(F.transform("clean_names", lambda t: t["markers"]), lambda m: F.size(m) > 0), F.lit(0)), F.array().cast("array<string>")))
    out = out.withColumn("markers", F.transform("markers", text.normalize_plain))
    out = out.withColumn("versions", text.version_tokens(F.array_join("aliases", " ")))
    out = out.withColumn("names", F.array_distinct(F.filter(F.transform("aliases", text.normalize_plain), lambda n: n != "")))
    sources = F.transform("pairs", lambda p: p["source"])
    has_video = F.exists(sources, video)
    out = out.withColumn("is_video", has_video & (F.forall(sources, video) | ~F.array_contains(sources, "isrc")))
    out = out.withColumn("ids", F.array_distinct(F.filter("pairs", lambda p: p["source"].isin(*V.AUTHORITATIVE_SOURCES))))
    return out.select("entry_id", "entry_type", "aliases", "main", "title", "markers", "versions", "names", "is_video", "ids", "durations", "peer_ids", "positions")


def pair_up(candidates: DataFrame, prepared: DataFrame) -> DataFrame:
    """Candidates (a, b, ...) with struct columns x and y of both sides' features."""
    cols = F.struct(*[F.col(c) for c in prepared.columns if c != "entry_id"])
    left = prepared.select(F.col("entry_id").alias("a"), cols.alias("x"))
    right = prepared.select(F.col("entry_id").alias("b"), cols.alias("y"))
    return candidates.join(left, "a").join(right, "b")


def _features(x: Column, y: Column) -> dict[str, Column]:
    both_empty, one_empty = (x["title"] == "") & (y["title"] == ""), (x["title"] == "") | (y["title"] == "")
    gaps = F.flatten(F.transform(x["durations"], lambda d: F.transform(y["durations"], lambda e: F.abs(d - e))))
    shared = F.size(F.array_intersect(x["peer_ids"], y["peer_ids"]))
    all_peers = F.size(x["peer_ids"]) + F.size(y["peer_ids"]) - shared
    releases = lambda s: F.transform(s["positions"], lambda p: p["release_id"])
    slots = lambda s: F.filter(s["positions"], lambda p: p["track_no"].isNotNull())
    return {
        "title_sim": F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(text.string_similarity(x["title"], y["title"])),
        "markers_conflict": (F.size(x["markers"]) > 0) & (F.size(y["markers"]) > 0) & ~F.arrays_overlap(x["markers"], y["markers"]),
        "title_exact": F.coalesce(F.arrays_overlap(x["names"], y["names"]), F.lit(False)),
        # only artists are compared by it, and the UDF is quick on nulls
        "alias_sim": text.alias_similarity(*(F.when(x["entry_type"] == "artist", s["aliases"]) for s in (x, y))),
        "dur_known": (F.size(x["durations"]) > 0) & (F.size(y["durations"]) > 0),
        "dur_gap": F.array_min(gaps),
        "artist_overlap": F.when(all_peers > 0, shared / all_peers).otherwise(0.0),
        "shared_ids": F.size(F.array_intersect(x["ids"], y["ids"])),
        "same_release": F.coalesce(F.arrays_overlap(releases(x), releases(y)), F.lit(False)),
        "same_slot": F.exists(slots(x), lambda p: F.exists(slots(y), lambda q: (p["release_id"] == q["release_id"]) & p["disc_no"].eqNullSafe(q["disc_no"]) & (p["track_no"] == q["track_no"]))),
        "numbers_conflict": text.numbers_conflict(x["main"], y["main"]),
        "versions_differ": x["versions"] != y["versions"],
    }


def decide(paired: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """a, b, entry_type, verdict columns of VERDICT. paired: as pair_up gives it."""
    t = t or Thresholds()
    wide = paired.withColumns(_features(F.col("x"), F.col("y")))
    x, y, c = F.col("x"), F.col("y"), F.col
    distinct = verdict("distinct")
    difference = F.array_join(text.marker_difference(x["versions"], y["versions"]), " ")
    side = text.derived_side(x["versions"], y["versions"])
    derived = lambda confidence, reason: verdict("relate", confidence, reason, "derived_from", difference, side)
    video_pair = x["is_video"] != y["is_video"]
    video_longer = F.exists(
        F.when(x["is_video"], x["durations"]).otherwise(y["durations"]),
        lambda v: F.exists(F.when(x["is_video"], y["durations"]).otherwise(x["durations"]), lambda r: (v >= r) & (v - r <= t.video_ms)),
    )
    dur_ok = c("dur_known") & ((c("dur_gap") <= t.duration_ms) | (video_pair & video_longer))
    authority = (c("shared_ids") > 0) | c("same_release")
    backed = (c("artist_overlap") >= 0.5) | authority
    short = x["versions"].contains("short_ver") | y["versions"].contains("short_ver")
    sim = c("title_sim")
    track = (
        F.when(c("markers_conflict"), distinct)
        .when(c("same_slot") & (sim >= t.track_same_slot) & ~c("versions_differ"), verdict("merge", F.greatest(sim, F.lit(t.track_merge)), "same release position"))
        .when(c("same_slot") & c("versions_differ"), derived(t.slot_confidence, "same release position, other version"))
        .when(c("same_slot") | (sim < t.track_relate), distinct)
        .when(dur_ok & ~c("versions_differ") & (sim >= t.track_merge), verdict("merge", sim, "title and duration"))
        .when(video_pair & short & backed & (sim >= t.track_merge), verdict("merge", sim, "short video of the song"))
        .when(c("title_exact") & ~c("versions_differ") & (sim >= t.track_merge) & authority, verdict("merge", sim, "equal title and shared authority"))
        .when(backed & c("versions_differ"), derived(sim * 0.9, "title, other version"))
        .otherwise(distinct)
    )
    tokens = text.jaccard(text.tokens(x["title"]), text.tokens(y["title"]))
    name_sim = F.greatest(c("alias_sim"), F.when(c("title_exact"), 1.0).otherwise(tokens))
    known = (c("artist_overlap") > 0) | (c("shared_ids") > 0)
    artist = F.when((name_sim >= t.artist_relate) & (name_sim >= t.artist_merge) & (known | c("title_exact")), verdict("merge", name_sim, "alias")).otherwise(distinct)
    release = F.when(~c("numbers_conflict") & (sim >= t.release_relate) & c("title_exact") & (c("shared_ids") > 0), verdict("merge", F.greatest(sim, F.lit(t.release_merge)), "equal title and shared id")).otherwise(distinct)
    group = F.when(~c("numbers_conflict") & (sim >= t.group_merge) & ((c("artist_overlap") >= 0.5) | c("title_exact")), verdict("merge", sim, "title and artists")).otherwise(distinct)
    kind = x["entry_type"]
    chosen = F.when(kind != y["entry_type"], distinct).when(kind == "track", track).when(kind == "artist", artist).when(kind == "release", release).when(kind == "release_group", group).otherwise(distinct)
    return wide.withColumn("v", chosen).select("a", "b", kind.alias("entry_type"), "v.*")


#: Reasons why a candidate is not scored, in the order in which they count.
SKIPS = ("excluded", "same_identity", "related", "different", "barrier")


def skip_reason(pairs: DataFrame, excluded: DataFrame, identities: DataFrame, related: DataFrame, rejected: DataFrame, anchors: DataFrame) -> DataFrame:
    """pairs (a, b) with skip: the first of SKIPS that holds, or null. excluded: entry_id; identities: entry_id,
    component; related, rejected: a, b; anchors: entry_id, anchor (barriers part entries of different anchors)."""
    flag = lambda df, name: df.select("a", "b").distinct().withColumn(name, F.lit(True))
    out = excluded.select("entry_id").distinct()
    ids = identities.select("entry_id", "component")
    first = anchors.groupBy("entry_id").agg(F.min("anchor").alias("anchor"))
    wide = (
        pairs.join(out.toDF("a").withColumn("xa", F.lit(True)), "a", "left")
        .join(out.toDF("b").withColumn("xb", F.lit(True)), "b", "left")
        .join(ids.toDF("a", "ca"), "a", "left")
        .join(ids.toDF("b", "cb"), "b", "left")
        .join(flag(related, "r"), ["a", "b"], "left")
        .join(flag(rejected, "d"), ["a", "b"], "left")
        .join(first.toDF("a", "ba"), "a", "left")
        .join(first.toDF("b", "bb"), "b", "left")
    )
    skip = (
        F.when(F.col("xa").isNotNull() | F.col("xb").isNotNull(), SKIPS[0])
        .when(F.col("ca") == F.col("cb"), SKIPS[1])
        .when(F.col("r").isNotNull(), SKIPS[2])
        .when(F.col("d").isNotNull(), SKIPS[3])
        .when(F.col("ba") != F.col("bb"), SKIPS[4])
    )
    return wide.withColumn("skip", skip).select(*pairs.columns, "skip")


def refine(decided: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A second, slower pass over all that isn't distinct; `second` gives rows of the same columns."""
    return decided.filter("verdict = 'distinct'").unionByName(second(decided.filter("verdict <> 'distinct'")))


def decision_order(decided: DataFrame, originals: DataFrame) -> DataFrame:
    """decided with `place`: merges, editions that touch an original (entry_id), other editions, the rest; then by falling confidence in steps of 1e-6."""
    o = originals.select("entry_id").distinct()
    wide = decided.join(o.toDF("a").withColumn("oa", F.lit(True)), "a", "left").join(o.toDF("b").withColumn("ob", F.lit(True)), "b", "left")
    touches = F.col("oa").isNotNull() | F.col("ob").isNotNull()
    edition = (F.col("verdict") == "relate") & F.col("kind").isin(*V.EDITION_KINDS)
    rank = F.when(F.col("verdict") == "merge", 0).when(edition & touches, 1).when(edition, 2).otherwise(3)
    return wide.withColumn("place", F.struct(rank.alias("rank"), (-F.floor(F.coalesce("confidence", F.lit(0.0)) * 1e6)).alias("c"), F.col("a"), F.col("b"))).drop("oa", "ob")


def apply_merges(ordered: DataFrame, identities: DataFrame, apart: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of decision_order with `applied`. groups: a, component of the pairs' unconstrained components; apart: a, b.

    Merges are taken in order and refused where they would bring a pair of `apart` together; so only the components
    of proposed merges are gone through, each on its own."""
    comp = groups.select("a", "component")
    packed = ordered.join(comp, "a")
    foes = apart.join(comp, "a").groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("foes"))
    rows = packed.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "verdict"))).alias("rows")).join(foes, "component", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for g in pdf.itertuples():
                foe = [(f["a"], f["b"]) for f in (g.foes if g.foes is not None else ())]
                sets = Blocked({r[k] for r in g.rows for k in ("a", "b")}, foe)
                for r in g.rows:
                    fine = sets.find(r["a"]) != sets.find(r["b"]) if r["verdict"] != "merge" else sets.union(r["a"], r["b"]) is None
                    out.append((r["a"], r["b"], r["verdict"] in ("merge", "relate") and fine))
            yield pd.DataFrame(out, columns=["a", "b", "applied"])

    done = rows.mapInPandas(run, "a long, b long, applied boolean")
    return ordered.join(done, ["a", "b"])


def resolved_side(a: Column, b: Column, side: Column) -> tuple[Column, Column]:
    """Derived and source entry of a pair whose derived side is a or b."""
    return F.when(side == "a", a).when(side == "b", b), F.when(side == "a", b).when(side == "b", a)


def verdict_stats(decided: DataFrame) -> DataFrame:
    return decided.groupBy("entry_type").pivot("verdict", ["merge", "relate", "distinct", "defer"]).count().na.fill(0)


def edition_guard(tracks: DataFrame, long_ms: int = 1_200_000) -> DataFrame:
    """entry_id, guarded: tracks of several songs or longer than long_ms take no part in editions. tracks: entry_id, songs, durations."""
    return tracks.select("entry_id", (F.coalesce(F.size("songs"), F.lit(0)) > 1) | F.exists(F.coalesce("durations", F.array().cast("array<bigint>")), lambda d: d > long_ms)).toDF("entry_id", "guarded")


def isrc_guard(a: Column, b: Column, tolerance_ms: int = 5_000) -> Column:
    """An unknown length passes, else any two lengths within tolerance."""
    unknown = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return unknown | F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance_ms))


# --- cleanup ----------------------------------------------------------------------------------------------


def drop_reason(relations: DataFrame, views: DataFrame, least_confidence: float = 0.4) -> DataFrame:
    """relations (a, b, confidence) with reason: why a heuristic relation should go, or null. views: entry_id,
    entry_type, keys array<string>, plain boolean, marker_sets array<array<string>>, placeholder boolean, parents
    array<long>, fetched boolean."""
    cols = F.struct(*[F.col(c) for c in views.columns if c != "entry_id"])
    wide = relations.join(views.select(F.col("entry_id").alias("a"), cols.alias("x")), "a").join(views.select(F.col("entry_id").alias("b"), cols.alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    close = lambda p, q: (F.least(F.length(p), F.length(q)) >= 5) & (p.startswith(q) | q.startswith(p)) & (F.abs(F.length(p) - F.length(q)) <= 2)
    base = F.arrays_overlap(x["keys"], y["keys"]) | F.exists(x["keys"], lambda p: F.exists(y["keys"], lambda q: close(p, q)))
    inside = lambda m, n: (F.size(F.array_except(m, n)) == 0) & (F.size(F.array_except(n, m)) > 0)
    chained = F.exists(x["marker_sets"], lambda m: F.exists(y["marker_sets"], lambda n: inside(m, n) | inside(n, m)))
    kind = x["entry_type"]
    reason = (
        F.when(kind == "artist", "artist")
        .when((kind == "release") & F.arrays_overlap(x["parents"], y["parents"]), "siblings under one parent")
        .when((kind == "release") & ~(x["fetched"] & y["fetched"]), "stub")
        .when(kind != "track", F.lit(None))
        .when(x["placeholder"] | y["placeholder"], "placeholder")
        .when(~base, "no shared title")
        .when(~x["plain"] & ~y["plain"] & ~chained, "both are versions")
        .when(F.col("confidence") < least_confidence, "low confidence")
    )
    return wide.withColumn("entry_type", kind).withColumn("reason", reason).drop("x", "y")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("entry_type", "reason").agg(F.count("*").alias("n"))


def latest_per_pair(feedback: DataFrame) -> DataFrame:
    """The newest judgment of each pair in an append-only ledger, by (created_at, id)."""
    w = Window.partitionBy(F.least("entry_a", "entry_b"), F.greatest("entry_a", "entry_b")).orderBy(F.desc("created_at"), F.desc("id"))
    return feedback.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
