"""The whole match, as one job: candidates, skips, features, verdicts, a second pass, and relations to write.

A plug-in replaces any step; its methods take and give frames, so that pandas UDFs serve where expressions do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlace.functions import text
from kinlace.operators import blocking, graph, knn, scoring
from kinlace.operators.resolve import upsert_relations
from kinlace.operators.staging import staged


class Plugin:
    """The hooks of a match with their default rules."""

    model_version = "rules-1"
    embedding_model: str | None = None

    def prepare(self, entries: DataFrame) -> DataFrame:
        return scoring.prepare(entries)

    def decide(self, paired: DataFrame) -> DataFrame:
        return scoring.decide(paired)

    def refine(self, decided: DataFrame) -> DataFrame:
        return decided

    def embed_text(self, entries: DataFrame) -> DataFrame:
        """entry_id, entry_type, text: what an entry's vector is of."""
        return entries.filter("size(aliases) > 0").select("entry_id", "entry_type", F.array_join("aliases", " ").alias("text"))

    def embed(self, texts: DataFrame) -> DataFrame:
        """texts with model and vector."""
        return texts.select("entry_id", "entry_type", "text", F.lit(self.embedding_model or "hashed-256").alias("model"), text.embed("text").alias("vector"))


@dataclass(frozen=True)
class Settings:
    max_block: int = blocking.MAX_BLOCK
    ngram_k: int = blocking.NGRAM_K
    embed_k: int = 20
    embed_similarity: float = 0.45
    embed_pages: int = 1


@dataclass(frozen=True)
class Matched:
    """candidates (a, b, channels, skip), decided (verdicts of those not skipped), relations (the next snapshot), feedback (rows to append)."""

    candidates: DataFrame
    decided: DataFrame
    relations: DataFrame
    feedback: DataFrame


def maintain_vectors(stored: DataFrame, entries: DataFrame, plugin: Plugin) -> DataFrame:
    """Vectors after new, changed and missing ones are made; those of entries that are gone go."""
    wanted = plugin.embed_text(entries).withColumn("model", F.lit(plugin.embedding_model or "hashed-256"))
    kept = stored.filter(F.col("vector").isNotNull()).join(wanted.select("entry_id", "text", "model"), ["entry_id", "text", "model"], "left_semi").select("entry_id", "entry_type", "text", "model", "vector")
    return kept.unionByName(plugin.embed(knn.stale(wanted, stored).select("entry_id", "entry_type", "text")))


def match(entries: DataFrame, relations: DataFrame, rejected: DataFrame, anchors: DataFrame, excluded: DataFrame, plugin: Plugin | None = None, vectors: DataFrame | None = None, focus: DataFrame | None = None, settings: Settings | None = None, now: int = 0) -> Matched:
    """entries: as entry_infos gives them; relations: stored ones; rejected: a, b that were judged apart; anchors: entry_id, anchor;
    excluded: entry_id; focus: entry_id of changed entries, for an incremental match: only blocks that these are in are paired, and
    only their own nearest neighbours are asked for."""
    plugin, s = plugin or Plugin(), settings or Settings()
    semantic = None
    if vectors is not None:
        v = vectors.select("entry_id", "entry_type", "vector")
        semantic = knn.semantic_pairs(v, s.embed_k, s.embed_similarity, s.embed_pages, queries=v.join(focus.select("entry_id").distinct(), "entry_id", "left_semi") if focus is not None else None)
    found = blocking.candidates(entries, s.max_block, s.ngram_k, semantic, focus)
    identities = staged(graph.identity(relations, entries), "identities")
    known = relations.filter("enabled").select(F.col("entry_a").alias("a"), F.col("entry_b").alias("b"))
    judged = staged(scoring.skip_reason(found, excluded, identities, known, rejected, anchors), "candidates")
    prepared = staged(plugin.prepare(entries), "prepared")
    first = plugin.decide(scoring.pair_up(judged.filter("skip IS NULL").drop("skip"), prepared))
    decided = staged(scoring.refine(staged(first, "decided"), plugin.refine), "refined")
    originals = graph.directed_neighbours(relations, identities).filter("size(derivatives) > 0").select("entry_id")
    ordered = scoring.decision_order(decided.filter("verdict IN ('merge', 'relate')"), originals)
    groups = graph.components(ordered.select("a", "b")).toDF("a", "component")
    apart = relations.filter("enabled AND kind IN ('different_identity', 'different_song')").select(F.col("entry_a").alias("a"), F.col("entry_b").alias("b")).unionByName(rejected.select("a", "b"))
    applied = staged(scoring.apply_merges(ordered, identities, apart, groups), "applied").filter("applied")
    derived, source = scoring.resolved_side(F.col("a"), F.col("b"), F.col("derived_side"))
    extra = F.when(F.col("verdict") == "relate", F.to_json(F.struct(derived.alias("derived_entry"), source.alias("source_entry"), "transformation")))
    merge = F.col("verdict") == "merge"
    # a merge is certain as a relation; the score itself goes to the ledger
    rows = applied.select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b"), F.when(merge, "same_identity").otherwise(F.col("kind")).alias("kind"), F.when(merge, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.lit("heuristic").alias("origin"), F.lit(True).alias("enabled"), extra.alias("extra"))
    feedback = decided.join(judged.select("a", "b", "channels"), ["a", "b"]).select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b"), F.col("verdict").alias("judgment"), F.lit("heuristic").alias("origin"), F.lit(plugin.model_version).alias("model_version"), F.col("confidence").alias("probability"), F.array_join(blocking.channel_names(F.col("channels")), ",").alias("candidate_channels"), F.col("reason").alias("note"), F.lit(now).cast("bigint").alias("created_at"))
    return Matched(judged, decided, upsert_relations(relations, rows), feedback)
