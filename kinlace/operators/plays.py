"""Play history: counts, totals, reports of several devices, exports, and outboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in seconds.
MIN_COUNTED_SECONDS = 10.0
MAX_SECONDS = 86_400.0


def counted(plays: DataFrame, since: int | None = None) -> DataFrame:
    """plays (entry_id, started_at, listened_seconds) that count."""
    out = plays.filter(F.col("listened_seconds") >= MIN_COUNTED_SECONDS)
    return out if since is None else out.filter(F.col("started_at") >= since)


def play_counts(plays: DataFrame, since: int | None = None) -> DataFrame:
    return counted(plays, since).groupBy("entry_id").agg(F.count("*").alias("plays"))


def last_plays(plays: DataFrame, since: int | None = None) -> DataFrame:
    return counted(plays, since).groupBy("entry_id").agg(F.max("started_at").alias("last_played"))


def play_totals(plays: DataFrame, exports: DataFrame) -> DataFrame:
    """One row: plays, listened and exported seconds; a play's export never counts for more than was heard. exports: play_id, exported_seconds."""
    joined = plays.join(exports, "play_id", "left")
    return joined.agg(
        F.count("*").alias("plays"),
        F.coalesce(F.sum("listened_seconds"), F.lit(0.0)).alias("listened"),
        F.coalesce(F.sum(F.least(F.coalesce("exported_seconds", F.lit(0.0)), F.col("listened_seconds"))), F.lit(0.0)).alias("exported"),
    )


def rolled_up(reports: DataFrame) -> DataFrame:
    """play_id, listened_seconds: the most that each reporter says, summed, a day at most. Late, repeated and reordered reports change nothing."""
    most = reports.groupBy("play_id", "reporter").agg(F.max("listened_seconds").alias("most"))
    return most.groupBy("play_id").agg(F.least(F.sum("most"), F.lit(MAX_SECONDS)).alias("listened_seconds"))


def grown(old: DataFrame, new: DataFrame) -> DataFrame:
    """play_id, listened_seconds: never less than it was."""
    return old.unionByName(new).groupBy("play_id").agg(F.max("listened_seconds").alias("listened_seconds"))


def pending_exports(plays: DataFrame, exports: DataFrame, target: str) -> DataFrame:
    """Plays of which more was heard than the target has, and how much more. exports: play_id, target, exported_seconds."""
    mine = exports.filter(F.col("target") == target).select("play_id", "exported_seconds")
    more = F.col("listened_seconds") - F.coalesce("exported_seconds", F.lit(0.0))
    return plays.join(mine, "play_id", "left").withColumn("unexported", more).filter("unexported > 0").drop("exported_seconds")


def unqueued(plays: DataFrame, submissions: DataFrame, account: str, least_seconds: float = 15.0) -> DataFrame:
    """Plays heard long enough that the account has no submission of."""
    mine = submissions.filter(F.col("account") == account).select("play_id")
    return plays.filter(F.col("listened_seconds") > least_seconds).join(mine, "play_id", "left_anti")


def status_counts(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy("account", "status").agg(F.count("*").alias("n"))


def outbox_head(pending: DataFrame, now: int | Column, limit: int = 50, account: str = "account") -> DataFrame:
    """The oldest pending rows of each account up to the first that must still wait (next_attempt_at > now)."""
    w = Window.partitionBy(account).orderBy("id")
    due = (F.col("next_attempt_at") <= now).cast("int")
    out = pending.withColumn("__due", F.min(due).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__n", F.row_number().over(w))
    return out.filter((F.col("__due") == 1) & (F.col("__n") <= limit)).drop("__due", "__n")


def rank_targets(unexported: DataFrame, folds: DataFrame) -> DataFrame:
    """entry_id, seconds: what each edition's rank target gets. folds: entry_id, rank_target."""
    met = unexported.join(folds, "entry_id", "left")
    return met.groupBy(F.coalesce("rank_target", "entry_id").alias("entry_id")).agg(F.sum("unexported").alias("seconds"))


def counts_by_component(counts: DataFrame, components: DataFrame) -> DataFrame:
    """component, plays: play counts of all entries of a component (entry_id, component)."""
    return counts.join(components, "entry_id").groupBy("component").agg(F.sum("plays").alias("plays"))
