"""Semantic cases on small frames, with references in plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinlace.operators import blocking, evaluation, graph, knn, plays, resolve, rules, scoring, songs, views
from kinlace.streaming import incremental

ENTRY = "entry_id long, entry_type string, aliases array<string>, durations array<long>, peer_ids array<long>, child_ids array<long>"


def pairs_of(df):
    return {tuple(r) for r in df.select("a", "b").collect()}


# --- blocking ---------------------------------------------------------------------------------------------


def test_blocks_drop_hubs_whole_and_skip_unknown(spark):
    rows = [(i, "track", ["same"], [], [], []) for i in range(4)] + [(9, "unknown", ["same"], [], [], []), (10, "artist", ["same"], [], [], [])]
    e = spark.createDataFrame(rows, ENTRY)
    assert len(pairs_of(blocking.block_pairs(blocking.exact_name_keys(e), 4))) == 6
    assert pairs_of(blocking.block_pairs(blocking.exact_name_keys(e), 3)) == set()


def test_duration_buckets_meet_at_distance_two(spark):
    rows = [(1, "track", [], [0], [7], []), (2, "track", [], [14_000], [7], []), (3, "track", [], [15_000], [7], []), (4, "track", [], [0], [8], [])]
    got = pairs_of(blocking.block_pairs(blocking.duration_keys(spark.createDataFrame(rows, ENTRY))))
    assert got == {(1, 2), (2, 3)}


def test_top_neighbours_take_k_before_the_threshold(spark):
    shared = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (1, 4, 4)], "a long, b long, shared long")
    assert pairs_of(blocking.top_neighbours(shared, 1)) == {(1, 2), (1, 4)}  # 4 ranks 1 first, though 1 ranks 4 second


def test_all_channels(spark):
    rows = [(1, "release", ["Blue Sky"], [], [], [11, 12, 13]), (2, "release", ["blue-sky!"], [], [], [11, 12, 14]), (3, "release", ["other"], [], [], [11, 12, 13])]
    got = {(r["a"], r["b"]): r["channels"] for r in blocking.candidates(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got[(1, 2)] & blocking.EXACT_NAME and got[(1, 2)] & blocking.TOKEN and got[(1, 2)] & blocking.TRACKLIST_OVERLAP
    assert got[(1, 3)] & blocking.TRACKLIST


def test_focused_pairs_are_those_of_the_full_scan(spark):
    rnd = random.Random(1)
    rows = [(i, "track", [rnd.choice("abcdef") + rnd.choice("xyz")], [], [], []) for i in range(60)]
    keys = blocking.exact_name_keys(spark.createDataFrame(rows, ENTRY))
    focus = spark.createDataFrame([(3,), (17,)], "entry_id long")
    assert pairs_of(blocking.focused_block_pairs(keys, focus)) == {p for p in pairs_of(blocking.block_pairs(keys)) if {3, 17} & set(p)}


def test_knn_over_blocks_is_exact(spark):
    rnd = random.Random(2)
    v = {i: [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)] for i in range(40)}
    df = spark.createDataFrame([(i, "t" if i % 5 else "u", x) for i, x in v.items()], "entry_id long, entry_type string, vector array<float>")
    got = {}
    for r in knn.knn(df, 3, block=7).orderBy("entry_id", "rank").collect():
        got.setdefault(r["entry_id"], []).append(r["neighbour_id"])
    for i, x in v.items():
        others = [j for j in v if j != i and bool(j % 5) == bool(i % 5)]
        dist = lambda j: sum((p - q) ** 2 for p, q in zip(x, v[j], strict=True))  # noqa: B023, E731
        assert got[i] == sorted(others, key=lambda j: (dist(j), j))[:3]


# --- graphs -----------------------------------------------------------------------------------------------


def test_components_of_a_path_a_cycle_and_isolated_nodes(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    cycle = [(100, 101), (101, 102), (102, 100)]
    nodes = [(i,) for i in [*range(1, 41), 100, 101, 102, 500]]
    got = dict(graph.components(spark.createDataFrame(path + cycle, "a long, b long"), spark.createDataFrame(nodes, "node long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and got[102] == 100 and got[500] == 500


def union_in_order(nodes, edges, apart):
    """The plain reference: edges in order, refused if a pair of `apart` would meet."""
    group = {n: {n} for n in nodes}
    for a, b in edges:
        merged = group[a] | group[b]
        if group[a] is not group[b] and not any(x in merged and y in merged for x, y in apart):
            for n in merged:
                group[n] = merged
    return {n: min(g) for n, g in group.items()}


@pytest.mark.parametrize("seed", range(3))
def test_constrained_components(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(30))
    edges = [(rnd.choice(nodes), rnd.choice(nodes), round(rnd.random(), 2)) for _ in range(40)]
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in edges if a != b}.values())
    apart = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(8)]
    apart = [(a, b) for a, b in apart if a != b]
    want = union_in_order(nodes, [(a, b) for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1]))], apart)
    rnd.shuffle(edges)
    got = graph.constrained_components(spark.createDataFrame(edges, "a long, b long, w double").repartition(3), spark.createDataFrame(apart, "a long, b long"), ["w"], spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


RELATION = "entry_a long, entry_b long, kind string, confidence double, origin string, enabled boolean, extra string"


def derived(d, s, t=None):
    import json

    return json.dumps({"derived_entry": d, "source_entry": s} | ({"transformation": t} if t else {}))


def identity(spark, rows, n=10):
    return {r["entry_id"]: r["component"] for r in graph.identity(spark.createDataFrame(rows, RELATION), spark.createDataFrame([(i,) for i in range(1, n)], "entry_id long")).collect()}


def test_identity(spark):
    same = lambda a, b, c=0.9, o="heuristic", on=True: (a, b, "same_identity", c, o, on, None)
    assert identity(spark, [same(1, 2), same(2, 3), same(5, 6, on=False)])[3] == 1
    assert identity(spark, [same(5, 6, on=False)])[6] == 6
    # the user's row goes first, so the heuristic one is what is refused
    got = identity(spark, [same(1, 2, 0.99), same(2, 3, 0.5, "user"), (1, 3, "different_identity", 1.0, "user", True, None)])
    assert got[3] == 2 and got[1] == 1
    # a provider's edition row parts identities, a heuristic one doesn't
    assert identity(spark, [same(1, 2), (1, 2, "live", 0.9, "provider", True, None)])[2] == 2
    assert identity(spark, [same(1, 2), (1, 2, "live", 0.9, "heuristic", True, None)])[2] == 1


def editions(spark, rows, n=10):
    rel = spark.createDataFrame(rows, RELATION)
    ids = spark.createDataFrame([(i, i) for i in range(1, n)], "entry_id long, component long")
    return {r["entry_id"]: r for r in graph.editions(rel, ids).collect()}


def test_editions(spark):
    got = editions(spark, [(1, 2, "instrumental", 0.9, "provider", True, derived(1, 2)), (2, 3, "live", 0.9, "provider", True, derived(3, 2))])
    assert {got[i]["group_id"] for i in (1, 2, 3)} == {1} and got[1]["original_id"] == 2 and got[1]["default_id"] == 2
    assert got[1]["fold_to"] == 2 and got[1]["rank_target"] == 2 and got[3]["fold_to"] is None and got[3]["parent_id"] is None
    # a different song stays apart
    got = editions(spark, [(1, 2, "live", 0.9, "user", True, derived(2, 1)), (1, 2, "different_song", 1.0, "user", True, None)])
    assert got[1]["group_id"] == 1 and got[2]["group_id"] == 2
    # two rows that contradict each other leave no cycle
    got = editions(spark, [(1, 2, "live", 0.9, "user", True, derived(2, 1)), (2, 3, "live", 0.8, "user", True, derived(3, 2)), (1, 3, "live", 0.7, "user", True, derived(1, 3))])
    for start in (1, 2, 3):
        seen, at = set(), start
        while at is not None:
            assert at not in seen
            seen.add(at)
            at = got[at]["parent_id"]


def test_edition_ties_go_by_the_rows_own_entries(spark):
    rel = [(50, 2, "live", 0.9, "user", True, None), (2, 3, "live", 0.9, "user", True, None), (1, 3, "different_song", 1.0, "user", True, None)]
    ids = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (50, 1)], "entry_id long, component long")
    got = {r["entry_id"]: r["group_id"] for r in graph.editions(spark.createDataFrame(rel, RELATION), ids).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_editions_name_any_entry_of_an_identity(spark):
    """The derived side is told by an entry that another row brought into the identity, in a list of extras, with words in a list."""
    extra = '[{"derived_entry": 60, "transformation": ["slow", "tv_size"]}, {"derived_entry": 60}, {"x": 1}]'
    ids = spark.createDataFrame([(1, 1), (2, 2), (60, 2)], "entry_id long, component long")
    got = {r["entry_id"]: r for r in graph.editions(spark.createDataFrame([(1, 2, "live", 0.5, "heuristic", True, extra)], RELATION), ids).collect()}
    assert got[2]["fold_to"] == 1 and got[2]["rank_target"] == 1 and got[1]["original_id"] == 1 and got[2]["parent_id"] is None


def test_folds_that_come_back(spark):
    fold = lambda v, s, a, b: (a, b, "instrumental", 0.9, "provider", True, derived(v, s))
    got = editions(spark, [fold(1, 2, 1, 2), fold(2, 3, 2, 3), fold(3, 1, 1, 3), fold(4, 1, 1, 4), fold(6, 5, 5, 6)])
    assert [got[i]["rank_target"] for i in (1, 2, 3, 4, 5, 6)] == [1, 2, 3, 1, 5, 5]
    # the way from the least version is 1, 2, 3 and back, so the last step of it goes
    assert [got[i]["parent_id"] for i in (1, 2, 3, 4)] == [2, 3, None, 1]


def test_focused_candidates_are_those_of_the_whole_that_touch_focus(spark):
    rng = random.Random(3)
    names = [" ".join(rng.choice(("blue", "red", "night", "light", "song", "river")) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, "track", [n], [1000 * (i % 9)], [i % 5], [i % 4, i % 6, i % 7]) for i, n in enumerate(names)]
    entries = spark.createDataFrame(rows, ENTRY)
    focus = spark.createDataFrame([(3,), (17,)], "entry_id long")
    got = {(r["a"], r["b"]): r["channels"] for r in blocking.candidates(entries, ngram_k=3, focus=focus).collect()}
    whole = {(r["a"], r["b"]): r["channels"] for r in blocking.candidates(entries, ngram_k=3).collect()}
    assert got and got == {p: c for p, c in whole.items() if {3, 17} & set(p)}


def test_editions_of_whole_tables(spark):
    """What the projection says of every group, pair and version, held against the rows themselves."""
    import json

    from comparing import DATA
    from kinlace.functions import values as V
    from kinlace.plans import resolution_queries as q

    rel, ids = q._relations(spark, DATA), graph.identity(q._relations(spark, DATA), q._order_entries(spark, DATA))
    canon = {r["entry_id"]: r["component"] for r in ids.collect()}
    got = {r["entry_id"]: r for r in graph.editions(rel, ids).collect()}
    assert set(got) == set(canon.values())
    live = [r for r in rel.collect() if r["enabled"] and canon[r["entry_a"]] != canon[r["entry_b"]]]
    ends = lambda r: (canon[r["entry_a"]], canon[r["entry_b"]])
    group = {i: r["group_id"] for i, r in got.items()}
    foes = {frozenset((group[a], group[b])) for a, b in map(ends, (r for r in live if r["kind"] == "different_song"))}
    assert all(len(f) == 2 for f in foes)
    rows = [r for r in live if r["kind"] in V.EDITION_KINDS]
    assert rows and foes
    inside = [r for r in rows if group[ends(r)[0]] == group[ends(r)[1]]]
    # a row across groups is one that a foe refused, and groups hang together by the other rows
    assert all(frozenset(group[e] for e in ends(r)) in foes for r in rows if r not in inside)
    linked = components_of(list(got), [ends(r) for r in inside])
    assert linked == group
    rank = {"user": 0, "provider": 1, "heuristic": 2}
    strength = lambda r: (rank[r["origin"]], -r["confidence"], sorted((r["entry_a"], r["entry_b"])), r["kind"])
    told = {}
    for r in sorted(inside, key=strength, reverse=True):
        v = canon[json.loads(r["extra"])["derived_entry"]]
        told[frozenset(ends(r))] = (v, next(e for e in ends(r) if e != v), r)
    of = {}
    for v, s, r in told.values():
        of.setdefault(v, []).append((s, r))
    level = {s: min(rank[r["origin"]] for _, s2, r in told.values() if s2 == s) for _, s, _ in told.values()}
    for i, row in got.items():
        folds = [s for s, r in of.get(i, ()) if r["kind"] == "instrumental"]
        assert row["fold_to"] == min(folds, default=None)
        originals = [(level[m], m) for m in got if group[m] == group[i] and m in level and m not in of]
        assert row["original_id"] == (min(originals)[1] if originals else None)
        assert row["default_id"] == row["original_id"] or not originals
        trusted = [(rank[r["origin"]], -r["confidence"], s) for s, r in of.get(i, ()) if rank[r["origin"]] < 2 or r["kind"] == "instrumental"]
        up = min(trusted)[2] if trusted else None
        assert row["parent_id"] == (None if up == row["original_id"] else up)  # versions have later orders, so nothing comes back
        at = i
        while got[at]["fold_to"] is not None:
            at = got[at]["fold_to"]
        assert row["rank_target"] == at


def components_of(nodes, edges):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            least = min(label[a], label[b])
            moved |= (label[a], label[b]) != (least, least)
            label[a] = label[b] = least
    return label


def test_region_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert dict(graph.region(edges, seeds, 2).collect()) == {1: 0, 2: 1, 3: 2}
    assert dict(graph.region(edges, seeds).collect()) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_merged_ids(spark):
    schema = "source string, identifier string, entry_id long"
    left = spark.createDataFrame([("s", "1", 1), ("s", "2", 2)], schema)
    right = spark.createDataFrame([("s", "2", 1), ("s", "9", 1), ("s", "8", 5)], schema)
    got = {(r["side"], r["entry_id"]): r["new_id"] for r in graph.merged_ids(left, right).collect()}
    assert got[("left", 2)] == got[("right", 1)] == 2 and got[("right", 5)] == 8


# --- plays, streams ---------------------------------------------------------------------------------------


def test_reports(spark):
    schema = "play_id long, reporter string, listened_seconds double"
    rows = [(1, "a", 80.0), (1, "b", 50.0), (1, "a", 90.0), (1, "a", 10.0), (2, "a", 90_000.0)]
    got = dict(plays.rolled_up(spark.createDataFrame(rows, schema)).collect())
    assert got == {1: 140.0, 2: 86_400.0}


def test_stream_is_idempotent(spark, tmp_path):
    state = incremental.VersionedState(spark, f"file://{tmp_path}/state", incremental.REPORTS)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 80.0), (1, "b", 50.0)], incremental.REPORTS).write.parquet(source, mode="append")
    run = lambda: incremental.into_state(spark.readStream.schema(incremental.REPORTS).parquet(source), state, incremental.merge_reports, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(1, "a", 90.0), (1, "a", 5.0)], incremental.REPORTS).write.parquet(source, mode="append")
    run()
    run()
    assert dict(incremental.listened(state.read()).collect()) == {1: 140.0}


def test_changes(spark):
    table = spark.createDataFrame([(1, "g", "a"), (2, "h", "b"), (3, "i", "c")], "id long, gid string, url string")
    schema = "seq long, op string, id long, gid string, old_url string, new_url string"
    changes = spark.createDataFrame([(1, "u", 1, "g", "a", "A"), (2, "d", 2, "h", "b", None), (3, "i", 4, "j", None, "D"), (4, "u", 1, "g", "A", "AA")], schema)
    after = incremental.apply_changes(table, changes)
    assert {(r["id"], r["url"]) for r in after.collect()} == {(1, "AA"), (3, "c"), (4, "D")}
    assert {(r["id"], r["url"]) for r in incremental.undo_changes(after, changes).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    incremental.check_packet(5, 30, 4, 30)
    with pytest.raises(ValueError):
        incremental.check_packet(6, 30, 4, 30)
    with pytest.raises(ValueError):
        incremental.check_packet(5, 29, 4, 30)


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0 AS value, 1L AS user_id UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0, 1L")
    events.write.parquet(str(tmp_path / "e"))
    stream = incremental.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), late="1 hour")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("windows").collect()] == [(2, 3.0)]
    assert incremental.sessions(events).count() == 2


# --- rules, scores ----------------------------------------------------------------------------------------


def test_rules_are_decided_early():
    rule = {"all": [{"entry_type": "track"}, {"any": [{"name": "x"}, {"index": [0, 5]}]}]}
    assert rules.fold(rule, {"entry_type": "artist"}) is False
    assert rules.fold(rule, {"entry_type": "track"}) is None
    assert rules.simplify(rule, {"entry_type": "track"}) == {"any": [{"index": [0, 5]}, {"name": "x"}]}
    assert rules.fold({"not": {"always": False}}, {}) is True
    assert rules.last_index({"all": [{"index": [0, 5]}, {"name": "x"}]}) == 5
    assert rules.last_index({"any": [{"index": [0, 5]}, {"name": "x"}]}) is None


def test_quantifiers_and_bounds(spark):
    entries = spark.createDataFrame([(1, "track", 10), (2, "track", 20), (3, "track", None)], "entry_id long, entry_type string, duration_ms long")
    children = spark.createDataFrame([(1, 5), (1, 15), (2, 15)], "parent_id long, duration_ms long")
    run = lambda rule: {r["entry_id"] for r in rules.first_match(entries, [("hit", rule)], children).filter("action = 'hit'").collect()}
    long = {"duration": [10, None]}
    assert run({"duration": [10, 20]}) == {1}  # the end is exclusive, null never matches
    assert run({"children": {"count": [0, 0], "match": long}}) == {3}
    assert run({"children": {"count": [1, 1], "match": long}}) == {1, 2}
    assert run({"children": {"ratio": [0.5, 0.5], "match": long}}) == {1}
    assert run({"children": {"ratio": [0.0, 1.0], "match": long}}) == {1, 2}  # no children: no ratio


PREPARED = "entry_id long, entry_type string, sourced_aliases array<struct<source:string,name:string>>, pairs array<struct<source:string,identifier:string>>, durations array<long>, peer_ids array<long>, positions array<struct<release_id:long,disc_no:int,track_no:int>>"


def verdicts(spark, rows):
    entries = spark.createDataFrame(rows, PREPARED)
    ids = [r[0] for r in rows]
    found = spark.createDataFrame(list(itertools.combinations(ids, 2)), "a long, b long")
    return {(r["a"], r["b"]): r for r in scoring.decide(scoring.pair_up(found, scoring.prepare(entries))).collect()}


def track(i, name, source="musicbrainz", dur=None, peers=(), slots=(), ids=()):
    return (i, "track", [(source, name)], [(source, str(i)), *ids], [dur] if dur else [], list(peers), list(slots))


def test_track_verdicts(spark):
    got = verdicts(
        spark,
        [
            track(1, "Blue Sky", dur=200_000, peers=[5]),
            track(2, "Blue Sky", "spotify", dur=201_000, peers=[5]),
            track(3, "Blue Sky (Instrumental)", dur=200_000, peers=[5]),
            track(4, "Blue Sky MV", "youtube", dur=230_000, peers=[9]),
            track(5, "Something Else", dur=200_000, peers=[5]),
            track(6, "Blue Sky", "discogs", dur=400_000),
        ],
    )
    assert got[(1, 2)]["verdict"] == "merge"
    assert (got[(1, 3)]["verdict"], got[(1, 3)]["kind"], got[(1, 3)]["transformation"], got[(1, 3)]["derived_side"]) == ("relate", "derived_from", "instrumental", "b")
    assert got[(1, 5)]["verdict"] == "distinct" and got[(1, 6)]["verdict"] == "distinct"


def test_same_slot(spark):
    slot = [(70, 1, 3)]
    got = verdicts(spark, [track(1, "Blue Sky", slots=slot), track(2, "Blue Skies", slots=slot), track(3, "Blue Sky (Live)", slots=slot), track(4, "Unlike", slots=slot)])
    assert got[(1, 2)]["verdict"] == "merge" and got[(1, 2)]["confidence"] >= 0.9
    assert (got[(1, 3)]["verdict"], got[(1, 3)]["confidence"]) == ("relate", 0.75)
    assert got[(1, 4)]["verdict"] == "distinct"


def test_skip_reasons_in_order(spark):
    p = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7), (8, 9), (10, 11)], "a long, b long")
    pair = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    got = scoring.skip_reason(p, spark.createDataFrame([(2,)], "entry_id long"), spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "entry_id long, component long"), pair((4, 5), (1, 3)), pair((6, 7)), spark.createDataFrame([(8, "x"), (9, "y")], "entry_id long, anchor string"))
    assert [r["skip"] for r in got.orderBy("a", "b").collect()] == ["excluded", "same_identity", "related", "different", "barrier", None]


def test_merges_are_applied_in_order(spark):
    schema = "a long, b long, verdict string, kind string, confidence double"
    rows = [(1, 2, "merge", None, 0.9), (2, 3, "merge", None, 0.95), (1, 3, "relate", "live", 0.8)]
    ordered = scoring.decision_order(spark.createDataFrame(rows, schema), spark.createDataFrame([], "entry_id long"))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "a long, component long")
    out = scoring.apply_merges(ordered, None, spark.createDataFrame([(1, 3)], "a long, b long"), groups)
    assert {(r["a"], r["b"]): r["applied"] for r in out.collect()} == {(2, 3): True, (1, 2): False, (1, 3): True}


# --- maintenance ------------------------------------------------------------------------------------------


def test_upserts(spark):
    schema = "source string, identifier string, fetched_at long, duration_ms long, run_id long"
    old = spark.createDataFrame([("s", "1", 5, 10, 1), ("s", "2", None, None, 1), ("s", "3", None, 7, 1)], schema)
    new = spark.createDataFrame([("s", "1", 6, 20, 2)], schema)
    got = {r["identifier"]: r for r in resolve.upsert_pairs(old, new).collect()}
    assert got["1"]["duration_ms"] == 20 and got["1"]["run_id"] == 1
    stubs = spark.createDataFrame([("s", "1", 99), ("s", "2", 99), ("s", "3", 99), ("s", "4", 99)], "source string, identifier string, duration_ms long")
    got = {r["identifier"]: r["duration_ms"] for r in resolve.upsert_stubs(old, stubs).collect()}
    assert got == {"1": 10, "2": 99, "3": 7, "4": 99}


def test_relation_upsert_keeps_extra_and_revives(spark):
    old = spark.createDataFrame([(1, 2, "live", 0.5, "provider", False, "{}")], RELATION)
    new = spark.createDataFrame([(2, 1, "live", 0.9, "user", True, '{"x":1}'), (3, 4, "live", 0.9, "user", True, '{"x":1}')], RELATION)
    got = {r["entry_a"]: r for r in resolve.upsert_relations(old, new).collect()}
    assert (got[1]["confidence"], got[1]["origin"], got[1]["enabled"], got[1]["extra"]) == (0.9, "user", True, "{}")
    assert got[3]["extra"] == '{"x":1}'


def test_remapped_relations(spark):
    rows = [(1, 2, "live", 0.5, "a", True, derived(1, 2)), (1, 3, "live", 0.9, "b", True, derived(1, 3)), (2, 3, "live", 0.4, "c", True, None)]
    got = resolve.remap_relations(spark.createDataFrame(rows, RELATION), spark.createDataFrame([(3, 2)], "old_id long, new_id long")).collect()
    assert len(got) == 1 and (got[0]["confidence"], got[0]["origin"]) == (0.9, "b")
    assert got[0]["extra"].count("derived_entry") == 1


def test_insert_absent_is_null_safe(spark):
    schema = "source string, identifier string, name string, locale string"
    old = spark.createDataFrame([("s", "1", "n", None)], schema)
    new = spark.createDataFrame([("s", "1", "n", None), ("s", "1", "n", "en"), ("s", "1", "n", "en")], schema)
    assert resolve.insert_absent(old, new, ["source", "identifier", "name", "locale"]).count() == 2


def labelled(spark, links, anchors, existing=()):
    p = "source string, identifier string"
    names = sorted({x for l in links for x in l} | {a for a, _ in anchors} | {e for e, _ in existing})
    pairs = spark.createDataFrame([("s", n) for n in names], p)
    l = spark.createDataFrame([("s", a, "s", b) for a, b in links], "a_source string, a_identifier string, b_source string, b_identifier string")
    out = resolve.labelled_classes(pairs, l, spark.createDataFrame([("s", n, i) for n, i in existing], p + ", entry_id long"), spark.createDataFrame([("s", n, a) for n, a in anchors], p + ", anchor string"))
    return {r["identifier"]: r["class_id"]["i"] for r in out.collect()}


def test_labelled_classes(spark):
    assert labelled(spark, [("a", "b"), ("b", "c")], []) == {"a": "a", "b": "a", "c": "a"}
    # anchors x and y never meet; the link that would join them is dropped, the earlier one stands
    got = labelled(spark, [("a", "b"), ("b", "c")], [("a", "x"), ("c", "y")])
    assert got == {"a": "a", "b": "a", "c": "c"}
    # pairs of one anchor meet without a link, and existing entries come last
    assert labelled(spark, [("a", "b")], [("a", "x"), ("d", "x")])["d"] == "a"
    assert labelled(spark, [], [("a", "x"), ("b", "y")], [("a", 1), ("b", 1)]) == {"a": "a", "b": "b"}


def one_by_one(links, anchors, existing):
    """labelled_classes in plain Python: forced unions, then links, then existing entries, each in sorted order."""
    names = {x for l in links for x in l} | {a for a, _ in anchors} | {e for e, _ in existing}
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups, held = {}, {a for a, _ in anchors}
    for x, a in sorted(anchors):
        parent[find(x)] = find(groups.setdefault(a, x))
    old = {}
    for x, e in sorted(existing):
        old.setdefault(e, []).append(x)
    for a, b in [*sorted({(min(l), max(l)) for l in links}), *sorted((xs[0], x) for xs in old.values() for x in xs[1:])]:
        a, b = find(a), find(b)
        if a != b and not ({find(x) for x in held} >= {a, b}):
            parent[a] = b
    least = {}
    for x in sorted(names):
        least.setdefault(find(x), x)
    return {x: least[find(x)] for x in names}


def test_labelled_classes_of_one_component_are_those_of_single_steps(spark):
    rng = random.Random(5)
    for n, m, k in ((12, 14, 3), (60, 70, 4)):
        names = [f"{i:02d}" for i in range(n)]
        rng.shuffle(names)
        links = [(rng.choice(names), rng.choice(names)) for _ in range(m)] + list(itertools.pairwise(sorted(names)[n // 2 :]))
        anchors = [(x, f"x{rng.randrange(k)}") for x in rng.sample(names, k + 3)]
        anchors.append((anchors[0][0], "also"))  # a pair of two anchors
        existing = [(x, rng.randrange(4)) for x in rng.sample(names, n // 3)]
        assert labelled(spark, links, anchors, existing) == one_by_one(links, anchors, existing)


def test_labelled_classes_put_no_component_in_one_row(spark):
    p = "source string, identifier string"
    pairs = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "d")], p)
    # c is a link's end that is none of the pairs
    links = spark.createDataFrame([("s", "a", "s", "c"), ("s", "c", "s", "b"), ("s", "b", "s", "d")], "a_source string, a_identifier string, b_source string, b_identifier string")
    anchors = spark.createDataFrame([("s", "a", "x"), ("s", "d", "y")], p + ", anchor string")
    out = resolve.labelled_classes(pairs, links, spark.createDataFrame([], p + ", entry_id long"), anchors)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInPandas" not in plan
    assert {r["identifier"]: r["class_id"]["i"] for r in out.collect()} == {"a": "a", "b": "a", "d": "d"}


def test_assigned_entries(spark):
    p = "source string, identifier string"
    classes = spark.createDataFrame([("s", "a", ("s", "a")), ("s", "b", ("s", "a")), ("s", "c", ("s", "c")), ("s", "d", ("s", "d"))], p + ", class_id struct<s:string,i:string>")
    existing = spark.createDataFrame([("s", "a", 7), ("s", "b", 5), ("s", "c", 5)], p + ", entry_id long")
    runs = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 1)], p + ", run_id long")
    got = {r["class_id"]["i"]: (r["entry_id"], r["merged"]) for r in resolve.assign_entries(classes, existing, runs).collect()}
    assert got["c"] == (5, []) and got["a"] == (7, []) and got["d"][0] == 8  # entry 5 stays with its earliest run's pair
    got = {r["class_id"]["i"]: (r["entry_id"], r["merged"]) for r in resolve.assign_entries(classes, existing.filter("identifier <> 'c'")).collect()}
    assert got["a"] == (5, [7])


def test_import(spark):
    from kinlace.sources.schemas import TABLES

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    yt, yt2 = "https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk"
    sp = "https://open.spotify.com/track/0123456789abcdefghijAB"
    empty = lambda n: frame([], TABLES[n])
    library = {
        "entry": frame([(1, "track")], "id long, entry_type string"),
        "entry_source": frame([("youtube", yt, 1, 5, 100, 1)], "source string, identifier string, entry_id long, fetched_at long, duration_ms long, run_id long"),
        "entry_alias": frame([("youtube", yt, "old name", None)], "source string, identifier string, name string, locale string"),
        "entry_child": empty("entry_child"),
        "contribution": frame([], "source string, identifier string, artist_source string, artist_identifier string, role string"),
        "pair_link": frame([], "a_source string, a_identifier string, b_source string, b_identifier string"),
        "barrier_member": frame([], "source string, identifier string, anchor string"),
    }
    landed = {
        "metadata": frame([("unknown", yt2, "track", 9, 120)], "source string, identifier string, entry_type string, fetched_at long, duration_ms long"),
        "stubs": frame([("spotify", sp, "track", 119)], "source string, identifier string, entry_type string, duration_ms long"),
        "links": frame([("youtube", yt, "spotify", sp)], "a_source string, a_identifier string, b_source string, b_identifier string"),
        "aliases": frame([("unknown", yt2, "new name", None)], "source string, identifier string, name string, locale string"),
        "children": frame([], "parent_source string, parent_identifier string, child_source string, child_identifier string, disc_no int, track_no int"),
        "credits": frame([], "source string, identifier string, artist_source string, artist_identifier string, role string"),
    }
    out = resolve.resolve_import(library, landed, 2)
    rows = {r["source"]: r for r in out["entry_source"].collect()}
    assert rows["youtube"]["duration_ms"] == 120 and rows["youtube"]["run_id"] == 1 and rows["spotify"]["entry_id"] == 1
    assert [r["name"] for r in out["entry_alias"].collect()] == ["new name"]
    assert out["entry"].count() == 1
    # a link joins two entries: all that was said of the one that goes is said of the other
    more = library | {
        "entry": frame([(1, "track"), (2, "track"), (3, "track")], "id long, entry_type string"),
        "entry_source": library["entry_source"].unionByName(frame([("spotify", sp, 2, 5, 100, 1), ("isrc", "x", 3, 5, 100, 1)], library["entry_source"].schema)),
        "play_event": frame([(10, 2), (11, 1)], "id long, entry_id long"),
        "entry_display_name": frame([(2, "two")], "entry_id long, name string"),
        "dedup_block_key": frame([(2, "k"), (1, "k")], "entry_id long, block_key string"),
        "entry_relation": frame([(1, 2, "live", 0.9, "user", True, None), (2, 3, "live", 0.9, "user", True, derived(2, 3))], RELATION),
        "pair_link": frame([("youtube", yt, "isrc", "x")], "a_source string, a_identifier string, b_source string, b_identifier string"),
        "image": frame([("youtube", yt, "fetch", "a")], "source string, identifier string, origin string, url string"),
        "privacy": frame([("youtube", yt, "private", None, 1)], "source string, identifier string, provider string, manual string, checked_at long"),
    }
    landed |= {
        "images": frame([("youtube", yt, "listing", "b"), ("spotify", sp, "listing", "c")], "source string, identifier string, origin string, url string"),
        "privacy": frame([("youtube", yt, "public", None, 2)], "source string, identifier string, provider string, manual string, checked_at long"),
    }
    out = resolve.resolve_import(more, landed, 2)
    assert {r["source"]: r["entry_id"] for r in out["entry_source"].collect()} == {"youtube": 1, "spotify": 1, "isrc": 3}
    assert {r["id"] for r in out["entry"].collect()} == {1, 3} and {r["entry_id"] for r in out["play_event"].collect()} == {1}
    assert out["entry_display_name"].collect()[0]["entry_id"] == 1 and out["dedup_block_key"].count() == 1
    rel = out["entry_relation"].collect()
    assert [(r["entry_a"], r["entry_b"]) for r in rel] == [(1, 3)] and '"derived_entry":1' in rel[0]["extra"].replace(" ", "")
    assert {r["b_source"] for r in out["pair_link"].collect()} == {"spotify"}  # the video states no other link any more
    assert {(r["source"], r["url"]) for r in out["image"].collect()} == {("youtube", "a"), ("spotify", "c")}
    assert out["privacy"].collect()[0]["provider"] == "public"


def test_regroup(spark):
    p = "source string, identifier string"
    pairs = spark.createDataFrame([("s", x, 1) for x in "abcd"], p + ", entry_id long")
    links = spark.createDataFrame([("s", "a", "s", "b")], "a_source string, a_identifier string, b_source string, b_identifier string")
    got = {r["identifier"]: r["part"] for r in resolve.regroup(pairs, links, spark.createDataFrame([("s", "d")], p)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0}


def test_song_edits(spark):
    rel = spark.createDataFrame([(1, 2, "live", 0.9, "provider", True, derived(2, 1)), (2, 3, "live", 0.9, "provider", True, derived(3, 2))], RELATION)
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    for edit in (songs.detach(rel, 2, [1, 2, 3]), songs.set_enabled(rel, 2, 1, "live", False), songs.derive(rel, 1, 2, transformation="remix"), songs.relate(rel, 1, 3, "variant"), songs.set_original(rel, [1, 2, 3], {3: 2}, 2)):
        assert key(edit.relations) != key(rel) and key(edit.undo()) == key(rel)
    with pytest.raises(ValueError):
        songs.set_parent(rel, {3: 2, 2: 1}, 1, 3, None)
    with pytest.raises(ValueError):
        songs.set_parent(rel, {}, 1, 2, 1)


# --- views, evaluation ------------------------------------------------------------------------------------


def test_views(spark):
    a = spark.createDataFrame([(1, "youtube", "Video", True), (1, "mb", "song", False), (1, "mb", "Song", True), (2, "youtube", "Only", False)], "entry_id long, source string, name string, primary boolean")
    assert {r["entry_id"]: r["names"] for r in views.alias_list(a).collect()} == {1: ["Song", "Video"], 2: ["Only"]}
    assert dict(views.best_title(a).collect()) == {1: "Song", 2: "Only"}
    items = spark.createDataFrame([(1, 0), (2, 1)], "id long, position long")
    order = spark.createDataFrame([(2, 0), (1, 1)], "item_id long, position long")
    assert {r["id"]: r["position"] for r in views.reordered(items, order).collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError):
        views.reordered(items, order.filter("item_id = 1"))
    assert views.search(a, spark.createDataFrame([(1, "t"), (2, "t")], "entry_id long, entry_type string"), "ONG").count() == 1


def test_reconciliation(spark):
    schema = "task_id string, label string"
    f = lambda *rows: spark.createDataFrame(list(rows), schema)
    got = {r["task_id"]: (r["label"], r["how"]) for r in evaluation.reconciled(f(("1", "m"), ("2", "m"), ("3", "m")), f(("1", "m"), ("2", "d"), ("3", "d")), f(("2", "d"), ("3", "x"))).collect()}
    assert got == {"1": ("m", "agreed"), "2": ("d", "adjudicated"), "3": (None, "open")}


def test_annotations(spark):
    tasks = spark.createDataFrame([("1",)], "task_id string")
    rows = spark.createDataFrame([("1", "x", "merge", None), ("9", "x", "merge", None), ("1", "y", "what", None), ("1", "z", "relate", None)], "task_id string, annotator string, label string, kind string")
    got = {r["annotator"] + r["task_id"]: r["problem"] for r in evaluation.invalid_annotations(rows, tasks).collect()}
    assert got == {"x9": "unknown task", "y1": "unknown label", "z1": "relate without kind"}


def test_blind_tasks(spark):
    tasks = spark.createDataFrame([(i, f"l{i}", f"r{i}", "merge") for i in range(30)], "id long, left string, right string, label string")
    out = evaluation.blind(tasks)
    assert "label" not in out.columns and {r["swapped"] for r in out.collect()} == {True, False}


def test_empty_tables(spark):
    e = spark.createDataFrame([], ENTRY)
    assert blocking.candidates(e).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert plays.play_totals(spark.createDataFrame([], "play_id long, listened_seconds double"), spark.createDataFrame([], "play_id long, exported_seconds double")).first()["plays"] == 0
    assert knn.knn(spark.createDataFrame([], "entry_id long, entry_type string, vector array<float>"), 3).count() == 0


def test_original_anchors(spark):
    schema = "work_id long, work_title string, recording_id string, title string, ordinal int, attributes array<string>, video boolean, derived boolean, first_date string, has_isrc boolean, length_ms long"
    row = lambda r, title="W", n=0, at=(), v=False, d=False, date="2000", i=False, l=1000: (1, "W", r, title, n, list(at), v, d, date, i, l)  # noqa: E731, E741
    rows = [row("tagged", at=["live"]), row("video", v=True, date="1990"), row("named", "W (mix)", date="1980"), row("late", date="2001"), row("first", date="1999", n=3), row("twin", date="1999", n=4, l=1500), row("far", date="1999", n=5, l=9000)]
    assert {r["recording_id"] for r in resolve.original_anchors(spark.createDataFrame(rows, schema)).collect()} == {"first", "twin"}


def test_guards(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<long>")
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scoring.isrc_guard(arr(), arr(1))) and one(scoring.isrc_guard(arr(1_000), arr(6_000))) and not one(scoring.isrc_guard(arr(1_000), arr(6_001)))
    t = spark.createDataFrame([(1, [["a"]], [1_200_000]), (2, [["a"], ["b"]], []), (3, None, [1_200_001]), (4, None, None)], "entry_id long, songs array<array<string>>, durations array<long>")
    assert {r["entry_id"]: r["guarded"] for r in scoring.edition_guard(t).collect()} == {1: False, 2: True, 3: True, 4: False}


# --- the whole match, composed views ----------------------------------------------------------------------

INFO = PREPARED + ", aliases array<string>, child_ids array<long>"


def test_whole_match(spark):
    from kinlace.operators import match

    def entry(i, name, source, dur):
        return (i, "track", [(source, name)], [(source, f"{i}")], [dur], [5], [], [name], [])

    rows = [entry(1, "Blue Sky", "musicbrainz", 200_000), entry(2, "Blue Sky", "spotify", 200_500), entry(3, "Blue Sky (Live)", "discogs", 210_000), entry(4, "Far Hill", "spotify", 90_000), entry(5, "Blue Sky", "spotify", 200_100)]
    entries = spark.createDataFrame(rows, INFO)
    none = spark.createDataFrame([], RELATION)
    pair = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    run = lambda **k: match.match(entries, none, pair((1, 5)), spark.createDataFrame([], "entry_id long, anchor string"), spark.createDataFrame([], "entry_id long"), **k)
    out = run(settings=match.Settings(max_block=10))
    rel = {(r["entry_a"], r["entry_b"], r["kind"]): r for r in out.relations.collect()}
    assert rel[(1, 2, "same_identity")]["confidence"] == 1.0 or rel[(2, 5, "same_identity")]["confidence"] == 1.0
    assert not {(1, 2, "same_identity"), (2, 5, "same_identity")} <= set(rel)  # 1 and 5 were judged apart
    assert rel[(1, 3, "derived_from")]["extra"].startswith('{"derived_entry":3')
    assert {r["skip"] for r in out.candidates.filter("a = 1 AND b = 5").collect()} == {"different"}
    assert out.feedback.filter("judgment = 'merge'").count() >= 2
    only = run(focus=spark.createDataFrame([(4,)], "entry_id long"))
    assert only.candidates.count() == 0
    stored = spark.createDataFrame([], "entry_id long, entry_type string, text string, model string, vector array<float>")
    vectors = match.maintain_vectors(stored, entries, match.Plugin())
    assert vectors.count() == 5 and match.maintain_vectors(vectors, entries.filter("entry_id < 3"), match.Plugin()).count() == 2
    near = run(vectors=vectors, settings=match.Settings(max_block=10)).candidates.filter("channels & 64 <> 0")
    assert {(r["a"], r["b"]) for r in near.collect()} >= {(1, 2), (2, 5)}


def test_composed_views(spark):
    p = "source string, identifier string, entry_id long"
    sources = spark.createDataFrame([("youtube", "https://youtu.be/abcdefghijk", 1), ("s", "x", 2), ("s", "y", 2)], p)
    asked = spark.createDataFrame([("https://www.youtube.com/watch?v=abcdefghijk",), ("x",), ("nothing",)], "query string")
    assert dict(views.lookup(sources, asked).collect()) == {asked.collect()[0][0]: 1, "x": 2}
    songs_ = spark.createDataFrame([(1, [["a"], ["b"]]), (2, [["a", "b"]]), (2, [["b", "c"]])], "entry_id long, songs array<array<string>>")
    assert [tuple(r) for r in views.multi_song_entries(songs_).collect()] == [(1, 2)]
    links = spark.createDataFrame([("s", "x", "s", "y")], "a_source string, a_identifier string, b_source string, b_identifier string")
    got = {r["identifier"]: r for r in views.identity_view(sources, links, spark.createDataFrame([("s", "y", "Z")], "source string, identifier string, anchor string")).collect()}
    assert got["x"]["links"][0]["b_identifier"] == "y" and got["y"]["anchor"] == "Z" and got["x"]["anchor"] is None
    entries = spark.createDataFrame([(1,), (2,)], "entry_id long")
    aliases = spark.createDataFrame([(1, "s", "A", True), (2, "s", "B", False)], "entry_id long, source string, name string, primary boolean")
    comps = spark.createDataFrame([(1, 1), (2, 1)], "entry_id long, component long")
    eds = spark.createDataFrame([(1, 1), (9, 1)], "entry_id long, group_id long")
    r = views.entry_summary(entries, aliases, sources, comps, eds, spark.createDataFrame([(2, 7, 1), (1, 8, 0)], "entry_id long, artist_id long, position int")).first()
    assert (r["title"], r["members"], r["editions"], r["artists"], len(r["pairs"])) == ("A", [1, 2], [9], [8, 7], 3)


def test_fold_in_and_settings(spark):
    schema = "source string, identifier string, entry_id long, fetched_at long"
    left = spark.createDataFrame([("s", "1", 1, 5), ("s", "2", 2, None)], schema)
    right = spark.createDataFrame([("s", "2", 1, 3), ("s", "9", 1, 1)], schema)
    ids = graph.merged_ids(left.drop("fetched_at"), right.drop("fetched_at"))
    out = resolve.checked_fold(resolve.fold_in(left, right, ids), left, right)
    assert {r["identifier"]: (r["entry_id"], r["fetched_at"]) for r in out.collect()} == {"1": (1, 5), "2": (2, 3), "9": (2, 1)}
    with pytest.raises(ValueError):
        resolve.checked_fold(left, left, right)
    pref = spark.createDataFrame([(1, 1.0), (5, 2.0)], "entry_id long, weight double")
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "entry_id long, component long")
    assert dict(resolve.set_preference(pref, comps, 2, 3.0).collect()) == {5: 2.0, 2: 3.0}
    assert dict(resolve.set_preference(pref, comps, 2, 0).collect()) == {5: 2.0}
    ledger = spark.createDataFrame([(1, 1, 2, 10, None)], "id long, entry_a long, entry_b long, created_at long, supersedes_id long")
    rows = spark.createDataFrame([(2, 1, 2, 20, None), (3, 4, 5, 20, None)], ledger.schema)
    assert {r["id"]: r["supersedes_id"] for r in resolve.record_feedback(ledger, rows).collect()} == {1: None, 2: 1, 3: None}
    assert resolve.barrier_violations(spark.createDataFrame([("s", "1", "x"), ("s", "2", "y")], "source string, identifier string, anchor string"), spark.createDataFrame([("s", "1", 1), ("s", "2", 1)], "source string, identifier string, entry_id long")).first()["anchors"] == ["x", "y"]
