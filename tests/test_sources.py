import json

from pyspark.sql import functions as F

from kinlace.sources import files, library, providers
from kinlace.sources.schemas import TABLES


def doc(spark, x):
    return spark.createDataFrame([(json.dumps(x),)], "value string")


def test_providers(spark):
    rec = {"id": "r1", "title": "T", "first-release-date": "2022", "length": 1000, "isrcs": ["A"], "artist-credit": [{"name": "N", "joinphrase": "", "artist": {"id": "a1", "name": "N"}}]}
    got = providers.parse(doc(spark, rec), "musicbrainz_recording")
    r = got.first()
    assert (r["identifier"], r["entry_type"], r["duration_ms"], r["isrcs"]) == ("https://musicbrainz.org/recording/r1", "track", 1000, ["A"])
    assert providers.credits(got).first()["artist_identifier"] == "https://musicbrainz.org/artist/a1"
    assert providers.isrc_links(got).first()["b_identifier"] == "A"
    release = {"id": 12, "title": "R", "released": "2001-00-00", "artists": [{"id": 3, "name": "N"}], "tracklist": [{"position": "1", "type_": "track", "title": "x", "duration": "3:05"}, {"position": "A1", "type_": "track", "title": "y", "duration": ""}]}
    got = providers.parse(doc(spark, release), "discogs_release")
    r = got.first()
    assert r["release_date"] == "2001" and [c["duration_ms"] for c in r["children"]] == [185_000, None]
    assert [c["child_identifier"] for c in providers.children(got).collect()] == ["https://www.discogs.com/release/12?track=1", "https://www.discogs.com/release/12?track=S-2"]
    video = {"items": [{"id": "abcdefghijk", "snippet": {"title": "V", "channelId": "UC1", "channelTitle": "C", "publishedAt": "2020-01-02T03:04:05Z"}, "contentDetails": {"duration": "PT1M5S"}}]}
    r = providers.parse(providers.youtube_items(doc(spark, video)), "youtube_video").first()
    assert (r["identifier"], r["release_date"], r["duration_ms"]) == ("https://youtu.be/abcdefghijk", "2020-01-02", 65_000)
    assert providers.parse(spark.createDataFrame([("no json",)], "value string"), "spotify_track").count() == 0
    sp = {"id": "x", "name": "S", "duration_ms": 5, "external_ids": {"isrc": "I"}, "artists": [{"id": "a", "name": "A"}], "album": {"id": "b", "name": "B", "release_date": "2020"}}
    assert providers.parse(doc(spark, sp), "spotify_track").first()["isrcs"] == ["I"]
    sc = {"webpage_url": "https://soundcloud.com/u/s", "title": "S", "uploader": "U", "duration": 1.5}
    assert providers.parse(doc(spark, sc), "soundcloud_track").first()["duration_ms"] == 1500
    nico = {"display_id": "sm9", "title": "N", "uploader": "U", "uploader_id": "7", "upload_date": "20070306", "duration": 319}
    assert providers.parse(doc(spark, nico), "nicovideo_video").first()["release_date"] == "2007-03-06"


def test_copy_text_and_mirror(spark, tmp_path):
    (tmp_path / "url").write_text("1\tg1\thttps://www.A.org/x/\t\\N\n2\tg2\t\\N\n3\tg3\thttp://b.org/a\\\\b?q\n")
    rows = files.read_copy_text(spark, str(tmp_path / "url"), ["id", "gid", "url", "more"]).collect()
    assert rows[0]["more"] is None and rows[1]["url"] is None and rows[2]["url"] == "http://b.org/a\\b?q"
    got = {r["id"]: r["url_norm"] for r in files.read_url_mirror(spark, str(tmp_path / "url")).collect()}
    assert got == {1: "a.org/x", 3: "b.org/a\\b"}


def test_packet(spark, tmp_path):
    row = json.dumps({"id": 1, "gid": "g", "url": "http://x"})
    (tmp_path / "REPLICATION_SEQUENCE").write_text("7\n")
    (tmp_path / "SCHEMA_SEQUENCE").write_text("30\n")
    (tmp_path / "pending_data").write_text("\n".join(["\t".join(["1", "musicbrainz.url", "i", "5", "\\N", row, "", ""]), "\t".join(["2", "musicbrainz.work", "i", "5", "\\N", row, "", ""])]))
    seq, schema, changes = files.read_packet(spark, str(tmp_path))
    assert (seq, schema) == (7, 30)
    assert [(r["op"], r["id"], r["new_url"]) for r in changes.collect()] == [("i", 1, "http://x")]


def test_ledger_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z long, a string")
    files.write_ledger(df, str(tmp_path / "l"))
    text = sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect())
    assert text[0] == '{"a":"b","z":2}'
    assert files.read_ledger(spark, str(tmp_path / "l"), "z long, a string").count() == 2
    files.write_lines(df, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1\t", "2\tb"]


def test_library(spark, tmp_path):
    path = str(tmp_path / "lib")
    empty = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    source = lambda i, e, **k: {"source": "mb", "identifier": i, "entry_id": e} | k
    rows = {
        "entry": [{"id": 1, "entry_type": "track"}, {"id": 2, "entry_type": "artist"}, {"id": 3, "entry_type": "release"}],
        "entry_source": [source("t", 1, duration_ms=5, duration_ms_all="[7,6]"), source("a", 2), source("r", 3)],
        "entry_alias": [{"id": 1, "source": "mb", "identifier": "t", "name": "Song", "primary": True}],
        "entry_child": [{"parent_source": "mb", "parent_identifier": "r", "child_source": "mb", "child_identifier": "t", "disc_no": 1, "track_no": 4}],
        "contribution": [{"id": n, "source": "mb", "identifier": "t", "artist_source": "mb", "artist_identifier": "a", "role": "artist", "main_artist": True} for n in (1, 2)],
    }
    made = {n: spark.createDataFrame([tuple(r.get(f.name) for f in empty[n].schema) for r in rows[n]], TABLES[n]) if n in rows else empty[n] for n in TABLES}
    library.write_library(made, path)
    lib = library.read_library(spark, path, version=0)
    assert lib["contribution"].count() == 1  # migration 1
    info = {r["entry_id"]: r for r in library.entry_infos(lib).collect()}
    assert info[1]["durations"] == [6, 7] and info[1]["peer_ids"] == [2] and info[1]["title"] == "Song" and info[3]["child_ids"] == [1]
    assert info[1]["positions"][0]["track_no"] == 4 and info[2]["peer_ids"] == [1]
    only = library.entry_infos(lib, spark.createDataFrame([(1,)], "entry_id long"))
    assert only.count() == 1 and only.select(F.size("peer_ids")).first()[0] == 1


def test_more_providers(spark):
    work = {"id": "w", "title": "W", "relations": [{"type": "performance", "target-type": "recording", "recording": {"id": "r", "title": "R", "length": 5}}, {"type": "based on", "target-type": "work"}]}
    assert [c["identifier"] for c in providers.parse(doc(spark, work), "musicbrainz_work").first()["children"]] == ["https://musicbrainz.org/recording/r"]
    lists = {"webpage_url": "https://soundcloud.com/u/sets/l", "title": "L", "uploader": "U", "entries": [{"url": "https://soundcloud.com/u/a", "title": "A"}]}
    r = providers.parse(doc(spark, lists), "soundcloud_playlist").first()
    assert (r["entry_type"], r["children"][0]["track_no"]) == ("release", 1)
    page = {"id": "PL1", "snippet": {"title": "P"}, "items": [{"snippet": {"title": "V", "position": 0, "resourceId": {"videoId": "abcdefghijk"}}}]}
    assert providers.parse(doc(spark, page), "youtube_playlist").first()["children"][0]["identifier"] == "https://youtu.be/abcdefghijk"
    for kind in providers.PARSERS:
        assert providers.parse(spark.createDataFrame([("{}",)], "value string"), kind).count() == 0, kind
    master = {"id": 4, "title": "M", "year": 0, "artists": [], "versions": [{"id": 9, "title": "V"}]}
    assert providers.parse(doc(spark, master), "discogs_master").first()["release_date"] is None
