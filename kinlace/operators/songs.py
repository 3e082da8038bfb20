"""Edits of songs: small transforms of the relation table, each with what it changed, for undo."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlace.functions import values as V

RELATION = ["entry_a", "entry_b", "kind"]


@dataclass(frozen=True)
class Edit:
    """The relations after an edit, and images of the rows that it changed: before, and after."""

    relations: DataFrame
    before: DataFrame
    after: DataFrame

    def undo(self) -> DataFrame:
        """The relations as they were."""
        kept = self.relations.join(self.after.select(*RELATION), RELATION, "left_anti")
        return kept.unionByName(self.before)


def _edit(old: DataFrame, new: DataFrame) -> Edit:
    cols = sorted(old.columns)
    return Edit(new, old.select(*cols).exceptAll(new.select(*cols)), new.select(*cols).exceptAll(old.select(*cols)))


def _touches(entry: int):
    return (F.col("entry_a") == entry) | (F.col("entry_b") == entry)


def set_enabled(relations: DataFrame, a: int, b: int, kind: str, enabled: bool) -> Edit:
    """A disabled row stays as a tombstone."""
    mine = (F.col("entry_a") == min(a, b)) & (F.col("entry_b") == max(a, b)) & (F.col("kind") == kind)
    return _edit(relations, relations.withColumn("enabled", F.when(mine, F.lit(enabled)).otherwise(F.col("enabled"))))


def detach(relations: DataFrame, entry: int, group: list[int]) -> Edit:
    """Take a version out of its group: its edition rows to the group's others are disabled, and it is kept apart from them."""
    others = [g for g in group if g != entry]
    far = _touches(entry) & (F.col("entry_a").isin(*others) | F.col("entry_b").isin(*others))
    off = relations.withColumn("enabled", F.when(far & F.col("kind").isin(*V.EDITION_KINDS), F.lit(False)).otherwise(F.col("enabled")))
    apart = relations.sparkSession.createDataFrame([(min(entry, g), max(entry, g), "different_song", 1.0, "user", True, None) for g in others], relations.select(*RELATION, "confidence", "origin", "enabled", "extra").schema)
    kept = off.join(apart.select(*RELATION), RELATION, "left_anti")
    return _edit(relations, kept.unionByName(apart))


def derive(relations: DataFrame, derived: int, source: int, kind: str = "derived_from", transformation: str | None = None) -> Edit:
    """State that one entry is a version of another."""
    extra = json.dumps({"derived_entry": derived, "source_entry": source} | ({"transformation": transformation} if transformation else {}), sort_keys=True)
    row = relations.sparkSession.createDataFrame([(min(derived, source), max(derived, source), kind, 1.0, "user", True, extra)], relations.select(*RELATION, "confidence", "origin", "enabled", "extra").schema)
    same = (F.col("entry_a") == min(derived, source)) & (F.col("entry_b") == max(derived, source)) & F.col("kind").isin(*V.EDITION_KINDS)
    return _edit(relations, relations.filter(~same).unionByName(row))


def relate(relations: DataFrame, a: int, b: int, kind: str) -> Edit:
    row = relations.sparkSession.createDataFrame([(min(a, b), max(a, b), kind, 1.0, "user", True, None)], relations.select(*RELATION, "confidence", "origin", "enabled", "extra").schema)
    return _edit(relations, relations.join(row.select(*RELATION), RELATION, "left_anti").unionByName(row))


def set_parent(relations: DataFrame, parents: dict[int, int], entry: int, parent: int, original: int | None) -> Edit:
    """Hang a version under another; not under itself or what hangs under it, and not the original. parents: the group's, by entry."""
    at, seen = parent, set()
    while at is not None and at not in seen:
        if at == entry:
            raise ValueError("a version can't hang under itself or its own versions")
        seen.add(at)
        at = parents.get(at)
    if entry == original:
        raise ValueError("the original hangs under nothing")
    return derive(relations, entry, parent)


def set_original(relations: DataFrame, group: list[int], parents: dict[int, int], original: int) -> Edit:
    """Make an entry the original of its group: every version that hangs under nothing else derives from it."""
    out = relations
    for entry in sorted(group):
        if entry != original and entry not in parents:
            out = derive(out, entry, original).relations
    away = _touches(original) & F.col("kind").isin(*V.EDITION_KINDS) & (F.get_json_object("extra", "$.derived_entry").cast("long") == original)
    return _edit(relations, out.filter(~F.coalesce(away, F.lit(False))))
