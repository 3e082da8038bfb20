"""Serving views: what a user asks of a library, as frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlace.functions import text, urls
from kinlace.functions import values as V
from kinlace.operators.resolve import PAIR, latest


# --- lookups ----------------------------------------------------------------------------------------------


def by_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    return table.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")


def by_ids(table: DataFrame, ids: DataFrame, column: str = "entry_id") -> DataFrame:
    return table.join(ids.select(column).distinct(), column, "left_semi")


def live_pairs(sources: DataFrame, before: int | None = None) -> DataFrame:
    """Fetched pairs that aren't gone, of before a time if given, oldest first."""
    out = sources.filter("fetched_at IS NOT NULL AND gone_at IS NULL")
    return (out if before is None else out.filter(F.col("fetched_at") < before)).orderBy("fetched_at", *PAIR)


def without_prefix(sources: DataFrame, entries: DataFrame, source: str, prefix: str) -> DataFrame:
    """Entries of which no pair is of that source with an identifier that begins so."""
    out = sources.filter((F.col("source") == source) & F.col("identifier").startswith(prefix))
    return entries.join(out.select("entry_id").distinct(), "entry_id", "left_anti")


def changed_since(entries: DataFrame) -> DataFrame:
    """Entries that changed at or after their last check; a missing check is long ago."""
    return entries.filter("changed_at IS NOT NULL AND (softmatch_checked_at IS NULL OR changed_at >= softmatch_checked_at)")


def prunable(pairs: DataFrame, fetched: DataFrame, listings: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a walk that need no visit: fetched already, no artist, and neither a listing's owner nor a root."""
    met = pairs.filter(F.col("entry_type") != "artist").join(fetched.select(*PAIR), PAIR, "left_semi")
    return met.join(listings.select(*PAIR), PAIR, "left_anti").join(roots.select(*PAIR), PAIR, "left_anti")


def in_mirror(pairs: DataFrame, mirror: DataFrame) -> DataFrame:
    """pairs (url_norm) with the mirror's gids; a page that it lacks needs no request."""
    gids = mirror.groupBy("url_norm").agg(F.array_sort(F.collect_set("gid")).alias("gids"))
    return pairs.join(gids, "url_norm", "left").withColumn("known", F.col("gids").isNotNull())


# --- search -----------------------------------------------------------------------------------------------


def search(aliases: DataFrame, entries: DataFrame, query: str, entry_type: str | None = None, limit: int = 50) -> DataFrame:
    """entry_id, score: entries with an alias that holds the query, shortest alias first. Letters of ASCII match in either case."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = aliases.filter(low(F.col("name")).contains(low(F.lit(query)))).select("entry_id", F.length("name").alias("score"))
    kept = entries if entry_type is None else entries.filter(F.col("entry_type") == entry_type)
    found = hits.join(kept.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.min("score").alias("score"))
    return found.orderBy("score", "entry_id").limit(limit)


def folded_hits(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """One hit for each edition group, in order of first hits (entry_id, ordinal): the group's default is shown, and
    matched_edition is the hit, if another. groups: entry_id, group_id, default_id."""
    wide = hits.join(groups, "entry_id", "left").withColumn("g", F.coalesce("group_id", "entry_id"))
    first = latest(wide, ["g"], F.asc("ordinal"))
    shown = F.coalesce("default_id", "entry_id")
    return first.select(shown.alias("entry_id"), F.when(shown != F.col("entry_id"), F.col("entry_id")).alias("matched_edition"), "ordinal").orderBy("ordinal")


# --- names ------------------------------------------------------------------------------------------------


def _alias_order(video_last: tuple[str, ...]) -> list[Column]:
    return [F.col("source").isin(*video_last), F.col("source"), ~F.col("primary"), F.col("name")]


def alias_list(aliases: DataFrame, video_last: tuple[str, ...] = V.VIDEO_SOURCES) -> DataFrame:
    """entry_id, names: distinct names without regard to case, clean sources first, then by source, primary first."""
    merged = aliases.groupBy("entry_id", "source", "name").agg(F.max("primary").alias("primary"))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_alias_order(video_last))])
    first = latest(merged.withColumn("place", place).withColumn("fold", F.lower("name")), ["entry_id", "fold"], F.asc("place"))
    return first.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def best_title(aliases: DataFrame, video_last: tuple[str, ...] = V.VIDEO_SOURCES) -> DataFrame:
    """entry_id, title: a primary name before others, clean sources before video sources."""
    merged = aliases.groupBy("entry_id", "source", "name").agg(F.max("primary").alias("primary"))
    return latest(merged, ["entry_id"], F.col("source").isin(*video_last), ~F.col("primary"), F.col("source"), F.col("name")).select("entry_id", F.col("name").alias("title"))


def titles_or_key(entries: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """entry_id, title; an entry without a name is called source:identifier."""
    key = sources.groupBy("entry_id").agg(F.min(F.concat_ws(":", *PAIR)).alias("key"))
    return entries.select("entry_id").join(best_title(aliases, ("youtube",)), "entry_id", "left").join(key, "entry_id", "left").select("entry_id", F.coalesce("title", "key").alias("title"))


def pair_titles(aliases: DataFrame) -> DataFrame:
    """PAIR, name: each pair's own best name, a primary one first, then the oldest."""
    return aliases.groupBy(*PAIR).agg(F.min_by("name", F.struct((~F.col("primary")).alias("p"), "id")).alias("name"))


# --- credits ----------------------------------------------------------------------------------------------


def main_credits(sources: DataFrame, contributions: DataFrame, entries: DataFrame) -> DataFrame:
    """entry_id, artist_id, position: main artists of works, from contributions whose target is an artist."""
    artist = sources.select(F.col("source").alias("artist_source"), F.col("identifier").alias("artist_identifier"), F.col("entry_id").alias("artist_id"))
    artists = entries.filter("entry_type = 'artist'").select(F.col("entry_id").alias("artist_id"))
    met = sources.select(*PAIR, "entry_id").join(contributions.filter("main_artist"), PAIR).join(artist, ["artist_source", "artist_identifier"]).join(artists, "artist_id", "left_semi")
    position = F.get_json_object("extra", "$.position").cast("int")
    return met.groupBy("entry_id", "artist_id").agg(F.min(position).alias("position"))


def credit_verdicts(credits: DataFrame) -> DataFrame:
    """entry_id, artist_id, main, roles: an artist is main if credited so, or if nobody is."""
    any_main = credits.groupBy("entry_id").agg(F.bool_or("main_artist").alias("any_main"))
    out = credits.groupBy("entry_id", "artist_id").agg(F.bool_or("main_artist").alias("mine"), F.array_sort(F.collect_set("role")).alias("roles")).join(any_main, "entry_id")
    return out.select("entry_id", "artist_id", (F.col("mine") | ~F.col("any_main")).alias("main"), "roles")


# --- releases ---------------------------------------------------------------------------------------------


def release_kind(primary_types: Column, release_types: Column, n_tracks: Column) -> Column:
    """The first primary type; else the first release type but playlist; else playlist if stated; else by length."""
    known = F.get(F.filter(primary_types, lambda t: t.isNotNull() & (t != "")), F.lit(0))
    stated = F.filter(release_types, lambda t: t.isNotNull() & (t != ""))
    typed = F.get(F.filter(stated, lambda t: t != "playlist"), F.lit(0))
    by_length = F.when(F.coalesce(n_tracks, F.lit(0)) == 0, "other").when(n_tracks <= 3, "single").when(n_tracks <= 6, "ep").otherwise("album")
    return F.coalesce(known, typed, F.when(F.size(stated) > 0, "playlist"), by_length)


def provider_tracklist(children: DataFrame) -> DataFrame:
    """release_id, PAIR, n: of a release's listings, the longest, then a fully numbered one, then the least pair.
    children: release_id, PAIR of the listing, track_no."""
    lists = children.groupBy("release_id", *PAIR).agg(F.count("*").alias("n"), F.bool_and(F.col("track_no").isNotNull()).alias("numbered"))
    return latest(lists, ["release_id"], F.desc("n"), F.desc("numbered"), *[F.asc(c) for c in PAIR]).drop("numbered")


def longest_child(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """group_id, release_id: the release that a group without its own tracks shows. groups: group_id, release_id; sizes: release_id, n."""
    return latest(groups.join(sizes, "release_id"), ["group_id"], F.desc("n"), F.asc("release_id")).select("group_id", "release_id")


def earliest_position(positions: DataFrame, key: list[str], disc_default: int | None = None) -> DataFrame:
    """key, disc_no, track_no of the first position, unnumbered ones last; a missing disc is disc_default, or first."""
    disc = F.col("disc_no") if disc_default is None else F.coalesce("disc_no", F.lit(disc_default))
    place = F.struct(F.col("track_no").isNull().alias("bare"), disc.alias("disc_no"), "track_no")
    return positions.groupBy(*key).agg(F.min(place).alias("p")).select(*key, "p.disc_no", "p.track_no")


def discography(releases: DataFrame) -> DataFrame:
    """One row for each edition group of releases: group_id, date, track_count, sources, plays; latest first, undated last.
    releases: group_id, release_date, n_tracks, source, plays."""
    out = releases.groupBy("group_id").agg(F.min("release_date").alias("date"), F.max("n_tracks").alias("track_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"))
    return out.orderBy(F.desc_nulls_last("date"), "group_id")


def fold_titles(rows: DataFrame) -> DataFrame:
    """Rows (entry_id, title, kind, main, n_sources, date, track_count, entries) of one title, kind and role become one: that with
    the most sources, then the first, with the least date, the largest track count and all entries."""
    keyed = rows.withColumn("title_key", text.title_key("title"))
    key = ["title_key", "kind", "main"]
    head = F.max_by(F.struct("entry_id", "title"), F.struct("n_sources", -F.col("entry_id"))).alias("head")
    out = keyed.groupBy(*key).agg(head, F.min("date").alias("date"), F.max("track_count").alias("track_count"), F.sum("entries").alias("entries"))
    return out.select("head.entry_id", "head.title", "kind", "main", "date", "track_count", "entries")


def appearances(rows: DataFrame) -> DataFrame:
    """Main credits first, then by date, undated last, then by id."""
    return rows.orderBy(F.desc("main"), F.asc_nulls_last("date"), "entry_id")


def covers(releases: DataFrame) -> DataFrame:
    """One release of each soft component, the oldest; undated ones last."""
    return latest(releases, ["component"], F.asc_nulls_last("date"), F.asc("release_id"))


def edition_key(group: Column, edition: Column) -> Column:
    return F.coalesce(F.concat(F.lit("rg:"), group.cast("string")), F.concat(F.lit("ed:"), edition.cast("string")))


# --- relations, pools -------------------------------------------------------------------------------------


def suggestions(edges: DataFrame, relations: DataFrame, entries: DataFrame) -> DataFrame:
    """entry_id, other_id, why: what an entry contains, what contains it, and what was remixed from it."""
    out = edges.select(F.col("parent_id").alias("entry_id"), F.col("child_id").alias("other_id"), F.lit("contains").alias("why"))
    back = edges.select(F.col("child_id").alias("entry_id"), F.col("parent_id").alias("other_id"), F.lit("contained_in").alias("why"))
    remix = relations.filter(F.col("enabled") & (F.col("kind") == "remix")).select(F.col("entry_a").alias("entry_id"), F.col("entry_b").alias("other_id"), F.lit("remixed_as").alias("why"))
    return by_ids(out.unionByName(back).unionByName(remix).distinct(), entries)


def reached_tracks(seeds: DataFrame, edges: DataFrame, credits: DataFrame, entries: DataFrame, folds: DataFrame) -> DataFrame:
    """track_id, via: tracks reached directly, by an album (two steps of containment) or by an artist's credits, folded to their editions;
    the nearest way counts. edges: parent_id, child_id; credits: artist_id, work_id; folds: entry_id, rank_target."""
    kinds = entries.select("entry_id", "entry_type")
    tracks = kinds.filter("entry_type = 'track'").select(F.col("entry_id").alias("track_id"))
    s = seeds.select("entry_id")
    one = s.join(edges, s["entry_id"] == edges["parent_id"]).select(F.col("child_id").alias("entry_id"))
    two = one.join(edges, one["entry_id"] == edges["parent_id"]).select(F.col("child_id").alias("entry_id"))
    by_artist = s.join(credits, s["entry_id"] == credits["artist_id"]).select(F.col("work_id").alias("entry_id"))
    ways = s.withColumn("n", F.lit(0)).unionByName(one.unionByName(two).withColumn("n", F.lit(1))).unionByName(by_artist.withColumn("n", F.lit(2)))
    reached = ways.withColumnRenamed("entry_id", "track_id").join(tracks, "track_id", "left_semi").join(folds.toDF("track_id", "rank_target"), "track_id", "left")
    best = reached.groupBy(F.coalesce("rank_target", "track_id").alias("track_id")).agg(F.min("n").alias("n"))
    return best.select("track_id", F.element_at(F.array(F.lit("direct"), F.lit("album"), F.lit("artist")), F.col("n") + 1).alias("via"))


def pair_facts(sources: DataFrame, aliases: DataFrame, children: DataFrame, credits: DataFrame, cap: int = 500) -> DataFrame:
    """PAIR, facts: a nested JSON document for each pair, with sorted lists; credited works are listed up to `cap`, a limit of the format."""
    named = aliases.groupBy(*PAIR).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    parent = ["parent_source", "parent_identifier"]
    listed = children.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("disc_no", F.lit(1)).alias("disc"), F.coalesce("track_no", F.lit(0)).alias("track"), "child_source", "child_identifier"))).alias("tracklist")).toDF(*PAIR, "tracklist")
    made = credits.groupBy("artist_source", "artist_identifier").agg(F.slice(F.array_sort(F.collect_set(F.struct(*PAIR, "role"))), 1, cap).alias("credited_on")).toDF(*PAIR, "credited_on")
    durations = F.array_sort(F.array_distinct(F.filter(F.array(F.col("duration_ms"), *([F.col("duration_ms_all")] if "duration_ms_all" in sources.columns else [])), lambda d: d.isNotNull() & (d > 0))))
    wide = sources.withColumn("durations", durations).join(named, PAIR, "left").join(listed, PAIR, "left").join(made, PAIR, "left")
    return wide.select(*PAIR, F.to_json(F.struct(F.lit("pair-facts/1").alias("schema"), *PAIR, "aliases", "durations", "tracklist", "credited_on")).alias("facts"))


# --- operational lists ------------------------------------------------------------------------------------


def keyset_page(rows: DataFrame, before: int | Column | None, limit: int, at: str = "created_at", id_col: str = "id") -> DataFrame:
    page = rows if before is None else rows.filter(F.col(at) < before)
    return page.orderBy(F.desc(at), F.desc(id_col)).limit(limit)


def retained(rows: DataFrame, now: int | Column, newest: int, max_age: int, at: str = "created_at", id_col: str = "id") -> DataFrame:
    """At most `newest` of the rows that are no older than max_age."""
    return rows.filter(F.col(at) >= F.lit(now) - max_age).orderBy(F.desc(at), F.desc(id_col)).limit(newest)


def appended(items: DataFrame, new: DataFrame, playlist: str = "playlist_id") -> DataFrame:
    """items with new ones (ordinal) at the end of their playlists."""
    last = items.groupBy(playlist).agg(F.max("position").alias("last"))
    place = F.coalesce(F.col("last"), F.lit(-1)) + F.row_number().over(Window.partitionBy(playlist).orderBy("ordinal"))
    return items.unionByName(new.join(last, playlist, "left").withColumn("position", place).drop("last", "ordinal"), allowMissingColumns=True)


def reordered(items: DataFrame, order: DataFrame) -> DataFrame:
    """items at the positions of order (item_id, position), which must be a permutation of them; else an error."""
    odd = items.select(F.col("id").alias("item_id")).exceptAll(order.select("item_id")).unionByName(order.select("item_id").exceptAll(items.select(F.col("id").alias("item_id"))))
    if not odd.isEmpty():
        raise ValueError("the order isn't a permutation of the items")
    return items.drop("position").join(order.withColumnRenamed("item_id", "id"), "id")


def anchors(pairs: DataFrame, rank: dict[str, int], key: str = "entry_id") -> DataFrame:
    """The pair that stands for each entry in a playlist: by the source's rank, then source and identifier."""
    place = F.lit(len(rank))
    for source, n in rank.items():
        place = F.when(F.col("source") == source, n).otherwise(place)
    return pairs.groupBy(key).agg(F.min(F.struct(place.alias("rank"), *PAIR)).alias("a")).select(key, *[f"a.{c}" for c in PAIR])


def with_counts(playlists: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy(F.col("playlist_id").alias("id")).agg(F.count("*").alias("item_count"))
    return playlists.join(n, "id", "left").na.fill(0, ["item_count"])


# --- composed views ---------------------------------------------------------------------------------------


def phrase_search(aliases: DataFrame, entries: DataFrame, query: str, entry_type: str | None = None, limit: int = 50) -> DataFrame:
    """entry_id, score: entries with an alias that holds a phrase of three characters or more, by the phrase's share of the alias."""
    if len(query) < 3:
        return search(aliases, entries, query, entry_type, limit)
    low = F.lower("name")
    hits = aliases.filter(low.contains(query.lower())).select("entry_id", (1 - F.lit(len(query)) / F.length("name")).alias("score"))
    kept = entries if entry_type is None else entries.filter(F.col("entry_type") == entry_type)
    return hits.join(kept.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.min("score").alias("score")).orderBy("score", "entry_id").limit(limit)


@F.pandas_udf(T.IntegerType())
def _n_songs(songs: pd.Series) -> pd.Series:
    return songs.map(lambda x: len(V.merge_songs([list(s) for s in x])) if x is not None else 0)


def multi_song_entries(sources: DataFrame) -> DataFrame:
    """entry_id, n: entries whose pairs perform more than one song; songs that share a work are one. sources: entry_id, songs."""
    all_songs = sources.filter("songs IS NOT NULL").groupBy("entry_id").agg(F.flatten(F.collect_list("songs")).alias("songs"))
    return all_songs.select("entry_id", _n_songs("songs").alias("n")).filter("n > 1")


def entry_summary(entries: DataFrame, aliases: DataFrame, sources: DataFrame, components: DataFrame, editions: DataFrame, credits: DataFrame) -> DataFrame:
    """One row for each component: title, pairs, member entries, the other editions of its group, and main artists in order.
    components: entry_id, component; editions: entry_id, group_id of identities; credits: entry_id, artist_id, position."""
    of = components.select("entry_id", "component")
    named = aliases.join(of, "entry_id").withColumn("entry_id", F.col("component"))
    titles = best_title(named.select("entry_id", "source", "name", "primary")).withColumnRenamed("entry_id", "component")
    pairs = sources.join(of, "entry_id").groupBy("component").agg(F.array_sort(F.collect_set(F.struct(*PAIR))).alias("pairs"))
    members = of.join(entries.select("entry_id"), "entry_id", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("entry_id")).alias("members"))
    group = editions.select(F.col("entry_id").alias("component"), "group_id")
    others = group.join(group.select(F.col("component").alias("other"), "group_id"), "group_id").filter("component <> other").groupBy("component").agg(F.array_sort(F.collect_set("other")).alias("editions"))
    artists = credits.join(of, "entry_id").groupBy("component").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("position", F.lit(1_000_000)).alias("position"), "artist_id"))).alias("x"))
    artists = artists.select("component", F.transform("x", lambda a: a["artist_id"]).alias("artists"))
    out = members
    for part in (titles, pairs, others, artists):
        out = out.join(part, "component", "left")
    return out


def source_credits(sources: DataFrame, contributions: DataFrame) -> DataFrame:
    """entry_id, source, artist_identifier, roles: credits as each source gives them; nothing is taken over from other releases or editions."""
    met = contributions.join(sources.select(*PAIR, "entry_id"), PAIR)
    return met.groupBy("entry_id", "source", "artist_identifier").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def lookup(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, entry_id: by the canonical pair of a page, else by the raw identifier. wanted: query."""
    asked = wanted.select("query", urls.canonicalize(F.col("query")).alias("c"))
    known = sources.select(F.col("source").alias("s"), F.col("identifier").alias("i"), "entry_id")
    by_page = asked.join(known, (F.col("c.source") == F.col("s")) & (F.col("c.identifier") == F.col("i"))).select("query", "entry_id", F.lit(0).alias("rank"))
    raw = asked.join(known, F.col("query") == F.col("i")).select("query", "entry_id", F.lit(1).alias("rank"))
    return latest(by_page.unionByName(raw), ["query"], F.asc("rank"), F.asc("entry_id")).drop("rank")


def identity_view(sources: DataFrame, links: DataFrame, barriers: DataFrame) -> DataFrame:
    """PAIR, entry_id, links (other pairs of the entry it is linked to), anchor: what an unmerge shows."""
    of = sources.select(*PAIR, "entry_id")
    both = links.select("a_source", "a_identifier", "b_source", "b_identifier").unionByName(links.select(F.col("b_source").alias("a_source"), F.col("b_identifier").alias("a_identifier"), F.col("a_source").alias("b_source"), F.col("a_identifier").alias("b_identifier")))
    mine = both.join(of.toDF("a_source", "a_identifier", "ea"), ["a_source", "a_identifier"]).join(of.toDF("b_source", "b_identifier", "eb"), ["b_source", "b_identifier"]).filter("ea = eb")
    met = mine.groupBy(F.col("a_source").alias("source"), F.col("a_identifier").alias("identifier")).agg(F.array_sort(F.collect_set(F.struct("b_source", "b_identifier"))).alias("links"))
    anchor = barriers.groupBy(*PAIR).agg(F.min("anchor").alias("anchor"))
    return of.join(met, PAIR, "left").join(anchor, PAIR, "left")


def structural_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent_id, child_id: containment one step around nodes (entry_id)."""
    n = nodes.select("entry_id").distinct()
    up = edges.join(n.withColumnRenamed("entry_id", "child_id"), "child_id", "left_semi")
    down = edges.join(n.withColumnRenamed("entry_id", "parent_id"), "parent_id", "left_semi")
    return up.select("parent_id", "child_id").unionByName(down.select("parent_id", "child_id")).distinct()


def roots(update_roots: DataFrame, sources: DataFrame) -> DataFrame:
    """update_roots (PAIR, ...) with the entry that each has become, if any."""
    return update_roots.join(sources.select(*PAIR, "entry_id"), PAIR, "left")
