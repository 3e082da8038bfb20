"""Incremental and streaming mechanisms: reports, change data, listings, watermarks, outboxes, windows.

Streams go through foreachBatch with writes that a repeated batch does not change: a batch's output is a folder of
its own id, and what is read is the newest finished state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlace.operators import plays
from kinlace.operators.resolve import latest


class VersionedState:
    """Snapshots of one table in a shared folder: v0, v1, ...; the newest one that was written whole counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def version(self) -> int:
        """The newest version, -1 for none."""
        return max(self._versions(), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def before(self, version: int) -> DataFrame:
        """The state that a version was or will be made from."""
        old = [v for v in self._versions() if v < version]
        return self.spark.createDataFrame([], self.schema) if not old else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{max(old)}")

    def write(self, df: DataFrame, version: int) -> None:
        """Replaces what a broken attempt at the version left."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")


def into_state(stream: DataFrame, state: VersionedState, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run the stream's available rows into state: version n is merge(version before n, batch n), so a repeated batch makes it again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        state.write(merge(state.before(batch_id), batch), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REPORTS = "play_id bigint, reporter string, listened_seconds double"


def merge_reports(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The most that each reporter said so far: late, repeated and reordered reports change nothing."""
    return state.unionByName(batch.select("play_id", "reporter", "listened_seconds")).groupBy("play_id", "reporter").agg(F.max("listened_seconds").alias("listened_seconds"))


def listened(state: DataFrame) -> DataFrame:
    return plays.rolled_up(state)


MARKS = "play_id bigint, target string, exported_seconds double"


def merge_marks(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Export marks only grow."""
    return state.unionByName(batch.select("play_id", "target", "exported_seconds")).groupBy("play_id", "target").agg(F.max("exported_seconds").alias("exported_seconds"))


def session_starts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """session_key, entry_id: a repeated start is the same session; a start of another entry under a known key is an error."""
    both = state.unionByName(batch.select("session_key", "entry_id")).distinct()
    torn = both.groupBy("session_key").agg(F.count("*").alias("n")).filter("n > 1")
    if not torn.isEmpty():
        raise ValueError("a session key stands for two entries")
    return both


# --- change data ------------------------------------------------------------------------------------------


def check_packet(sequence: int, schema: int, at: int, known_schema: int, undo: bool = False) -> None:
    """A packet is applied right behind the state, and undone from it; schemas must be equal."""
    if schema != known_schema:
        raise ValueError(f"schema {schema}, the state has {known_schema}")
    if sequence != (at if undo else at + 1):
        raise ValueError(f"packet {sequence} doesn't follow state {at}")


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (id, gid, url) after changes (seq, op, id, gid, new_url): each id's last operation stands."""
    last = latest(changes, ["id"], F.desc("seq"))
    kept = table.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.filter("op <> 'd'").select("id", "gid", F.col("new_url").alias("url")))


def undo_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table before changes: each id's first operation tells what stood there."""
    first = latest(changes, ["id"], F.asc("seq"))
    kept = table.join(first.select("id"), "id", "left_anti")
    return kept.unionByName(first.filter("op <> 'i'").select("id", "gid", F.col("old_url").alias("url")))


# --- listings ---------------------------------------------------------------------------------------------


def merge_listing(stored: DataFrame, fetched: DataFrame, key: str = "listing") -> DataFrame:
    """Listings after a fetch of their newest pages (key, item, position): what was fetched stands first, then what was stored and
    isn't among it, in its order. Stored rows of other listings stay."""
    old = stored.join(fetched.select(key, "item").distinct(), [key, "item"], "left_anti")
    both = fetched.withColumn("__old", F.lit(0)).unionByName(old.withColumn("__old", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__old", "position", "item")) - 1
    return both.withColumn("position", place).drop("__old")


def pages_to_fetch(pages: DataFrame, stored: DataFrame, key: str = "listing") -> DataFrame:
    """key, page: pages up to the first whose items are all known (an incremental refresh stops there). pages: key, page, item."""
    known = stored.select(key, "item").distinct().withColumn("known", F.lit(1))
    whole = pages.join(known, [key, "item"], "left").groupBy(key, "page").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known"))
    before = F.max("all_known").over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return whole.withColumn("stop", F.coalesce(before, F.lit(0))).filter("stop = 0").select(key, "page")


def listing_modes(listings: DataFrame, now: int, max_age: int, full_age: int) -> DataFrame:
    """listings (key, checked_at, full_at) with mode: full if never or long ago walked, cached if checked lately, else incremental."""
    mode = F.when(F.col("full_at").isNull() | (F.col("full_at") < now - full_age), "full").when(F.col("checked_at") >= now - max_age, "cached").otherwise("incremental")
    return listings.withColumn("mode", mode)


def listing_stats(runs: DataFrame) -> DataFrame:
    """For each kind: refreshes by mode, new items and failures. runs: kind, mode, new_items, failed."""
    of = lambda m: F.sum((F.col("mode") == m).cast("long"))
    return runs.groupBy("kind").agg(F.count("*").alias("served"), of("incremental").alias("incremental"), of("full").alias("full"), F.sum("new_items").alias("new_items"), F.sum(F.col("failed").cast("long")).alias("failed"))


# --- watermarks and windows -------------------------------------------------------------------------------


def checked(entries: DataFrame, done: DataFrame, started_at: int) -> DataFrame:
    """entries after a run over done (entry_id) that began at started_at: what changed since then is asked for again."""
    mine = done.select(F.col("entry_id").alias("id")).distinct().withColumn("__done", F.lit(started_at).cast("bigint"))
    return entries.join(mine, "id", "left").withColumn("softmatch_checked_at", F.coalesce("__done", "softmatch_checked_at")).drop("__done")


def outbox_sink(send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each account's rows over in order."""

    def step(batch: DataFrame, batch_id: int) -> None:
        send(batch.repartition("account").sortWithinPartitions("account", "id"), batch_id)

    return step


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window; for streams, `late` is the watermark."""
    timed = events if late is None else events.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    timed = events if late is None else events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n of each session; its end is the last event plus the gap."""
    timed = events if late is None else events.withWatermark("ts", late)
    out = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
