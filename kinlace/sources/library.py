"""A library as a folder of Parquet tables: opening, writing snapshots, migrations, and the denormalised entry row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.operators.resolve import keep_first
from kinlace.operators.views import alias_list, best_title
from kinlace.sources.schemas import TABLES

#: Transforms from each version of the tables to the next, by the version they lead to.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}


def migration(version: int):
    def add(f):
        MIGRATIONS[version] = f
        return f

    return add


@migration(1)
def _credits_once(library: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Equal credits stand once, under their least id."""
    if "contribution" in library:
        key = ["source", "identifier", "artist_source", "artist_identifier", "role"]
        library = library | {"contribution": keep_first(library["contribution"], key)}
    return library


def read_library(spark: SparkSession, path: str, names: list[str] | None = None, version: int = max(MIGRATIONS)) -> dict[str, DataFrame]:
    """Tables by name with their schemas, moved on from `version` to the newest one."""
    library = {n: spark.read.schema(TABLES[n]).parquet(f"{path}/{n}") for n in names or TABLES}
    for v in sorted(MIGRATIONS):
        if v > version:
            library = MIGRATIONS[v](library)
    return library


def write_library(library: dict[str, DataFrame], path: str) -> None:
    """A snapshot of all tables; a path must be new, as frames may read from the one before."""
    for name, df in library.items():
        df.write.parquet(f"{path}/{name}")


def vectors_of(spark: SparkSession, path: str, entry_type: str) -> DataFrame:
    return spark.read.schema(TABLES["vector"]).parquet(f"{path}/vector").filter(F.col("entry_type") == entry_type)


def entry_infos(library: dict[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """One wide row for each entry, of only (entry_id) if given: the features that blocking and scoring ask for.

    entry_id, entry_type, title, aliases, sourced_aliases, pairs, durations (duration_ms_all replaces duration_ms), dates,
    release_types, peer_ids, positions and child_ids. Edges whose ends have no entry are left out."""
    entries = library["entry"].select(F.col("id").alias("entry_id"), "entry_type")
    sources, pair = library["entry_source"], ["source", "identifier"]
    if only is not None:
        keep = only.select("entry_id").distinct()
        entries, sources_kept = entries.join(keep, "entry_id", "left_semi"), sources.join(keep, "entry_id", "left_semi")
    else:
        sources_kept = sources
    of = sources.select(*pair, "entry_id")
    many = F.from_json("duration_ms_all", "array<bigint>")
    held = sources_kept.withColumn("d", F.coalesce(F.when(F.size(many) > 0, many), F.when(F.col("duration_ms").isNotNull(), F.array("duration_ms")), F.array().cast("array<bigint>")))
    by_source = held.groupBy("entry_id").agg(
        F.array_sort(F.collect_set(F.struct(*pair))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("d")))).alias("durations"),
        F.array_sort(F.collect_set("release_date")).alias("dates"),
        F.array_sort(F.collect_set("release_type")).alias("release_types"),
    )
    named = library["entry_alias"].select(*pair, "name", "primary").join(sources_kept.select(*pair, "entry_id"), pair)
    sourced = named.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct(F.col("source"), (~F.col("primary")).alias("secondary"), "name"))).alias("x"))
    sourced = sourced.select("entry_id", F.transform("x", lambda a: F.struct(a["source"].alias("source"), a["name"].alias("name"))).alias("sourced_aliases"))
    aliases = alias_list(named).withColumnRenamed("names", "aliases")
    credits = library["contribution"]
    artists = credits.join(of, pair).join(of.toDF("artist_source", "artist_identifier", "artist"), ["artist_source", "artist_identifier"]).select(F.col("entry_id"), F.col("artist").alias("peer"))
    peers = artists.unionByName(artists.select(F.col("peer").alias("entry_id"), F.col("entry_id").alias("peer"))).groupBy("entry_id").agg(F.array_sort(F.collect_set("peer")).alias("peer_ids"))
    edges = library["entry_child"].join(of.toDF("parent_source", "parent_identifier", "parent"), ["parent_source", "parent_identifier"]).join(of.toDF("child_source", "child_identifier", "child"), ["child_source", "child_identifier"])
    children = edges.groupBy(F.col("parent").alias("entry_id")).agg(F.array_sort(F.collect_set("child")).alias("child_ids"))
    slots = edges.groupBy(F.col("child").alias("entry_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("parent").alias("release_id"), "disc_no", "track_no"))).alias("positions"))
    out = entries
    for part in (by_source, best_title(named), aliases, sourced, peers, children, slots):
        out = out.join(part, "entry_id", "left")
    empty = {"peer_ids": "array<bigint>", "child_ids": "array<bigint>", "durations": "array<bigint>", "aliases": "array<string>"}
    return out.select(*[F.coalesce(c, F.array().cast(empty[c])).alias(c) if c in empty else c for c in out.columns])
