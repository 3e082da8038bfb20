import pytest

import corpus_pipeline as p
from kinlace.llm.tables import saved, scratch, table, with_stored_order

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in p.STAGES:
        docs = saved(stage(spark, docs, SMALL), scratch(spark, name))
        out.append((name, docs))
    return out


def test_stages(spark, steps):
    columns = table(spark, SMALL, "documents").columns
    assert [n for n, _ in steps] == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "token_store"]
    assert all(df.columns == columns for _, df in steps[:-1])


def test_decisions_take_effect(spark, steps):
    from kinlace.llm import decontaminate, mixing, near_dup, quality_rules

    by = dict(steps)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    docs = table(spark, SMALL, "documents")
    kept = ids(quality_rules.quality_report(docs, quality_rules.CLEAN_BANDS).filter("kept"))
    assert ids(by["quality_rules"]) == kept
    classes = near_dup.near_duplicate_classes(by["quality_rules"])
    assert ids(by["near_duplicates"]) == ids(classes.filter("doc_id = class_id"))
    clean = decontaminate.contamination(by["near_duplicates"], table(spark, SMALL, "benchmark")).filter("n_hit = 0")
    assert ids(by["decontaminate"]) == ids(clean)
    mixed = mixing.mix_sources(by["decontaminate"], mixing.WEIGHTS)
    assert by["mix_sources"].count() == mixed.count()
    assert by["token_store"].count() == by["mix_sources"].count() and by["token_store"].filter("NOT verified").count() == 0


def test_mixed_order_is_stored(spark, steps):
    by = dict(steps)
    mixed = [r["doc_id"] for r in with_stored_order(by["mix_sources"], "n").orderBy("n").collect()]
    assert mixed != sorted(mixed) and [r["doc_id"] for r in by["token_store"].orderBy("start").collect()] == mixed


def test_run(spark, steps):
    assert p.run(spark, SMALL).count() == steps[-1][1].count()


def test_empty(spark):
    empty = table(spark, SMALL, "documents").limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
