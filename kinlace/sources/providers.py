"""Landed provider JSON to rows: metadata, aliases, credits, links and children, keyed by pairs.

Each provider has a schema and a select; a document is one row of a text column. Fetching is not done here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What every parser gives.
ENTITY = ["source", "identifier", "entry_type", "name", "release_date", "duration_ms", "isrcs", "artists", "children"]


def _entity(source: str, identifier: Column, entry_type: str, name: Column, date: Column | None = None, duration: Column | None = None, isrcs: Column | None = None, artists: Column | None = None, children: Column | None = None) -> list[Column]:
    """artists: array<struct<identifier, name>>; children: array<struct<identifier, name, disc_no, track_no, duration_ms>>."""
    return [
        F.lit(source).alias("source"),
        identifier.alias("identifier"),
        F.lit(entry_type).alias("entry_type"),
        name.alias("name"),
        (date if date is not None else F.lit(None)).cast("string").alias("release_date"),
        (duration if duration is not None else F.lit(None)).cast("bigint").alias("duration_ms"),
        (isrcs if isrcs is not None else F.array()).cast("array<string>").alias("isrcs"),
        (artists if artists is not None else F.array()).cast("array<struct<identifier:string,name:string>>").alias("artists"),
        (children if children is not None else F.array()).cast("array<struct<identifier:string,name:string,disc_no:int,track_no:int,duration_ms:bigint>>").alias("children"),
    ]


def _artists(items: Column, form: str, id_field: str = "id") -> Column:
    return F.transform(items, lambda a: F.struct(F.concat(F.lit(form), a[id_field].cast("string")).alias("identifier"), a["name"].alias("name")))


_NO_CHILD = {"disc_no": "int", "track_no": "int", "duration_ms": "bigint"}


def _child(identifier: Column, name: Column, **rest: Column) -> Column:
    return F.struct(identifier.alias("identifier"), name.alias("name"), *[(rest[k] if k in rest else F.lit(None)).cast(t).alias(k) for k, t in _NO_CHILD.items()])


_MB = "https://musicbrainz.org/"
_MB_CREDIT = "`artist-credit`:array<struct<name:string,joinphrase:string,artist:struct<id:string,name:string>>>"


def _mb_credit(x: Column) -> Column:
    return F.transform(x["artist-credit"], lambda c: F.struct(F.concat(F.lit(f"{_MB}artist/"), c["artist"]["id"]).alias("identifier"), c["name"].alias("name")))


def musicbrainz_recording(x: Column) -> list[Column]:
    return _entity("musicbrainz", F.concat(F.lit(f"{_MB}recording/"), x["id"]), "track", x["title"], x["first-release-date"], x["length"], x["isrcs"], _mb_credit(x))


def musicbrainz_release(x: Column) -> list[Column]:
    tracks = F.flatten(F.transform(x["media"], lambda m: F.transform(m["tracks"], lambda t: _child(F.concat(F.lit(f"{_MB}recording/"), t["recording"]["id"]), t["title"], disc_no=m["position"], track_no=t["position"], duration_ms=t["length"]))))
    return _entity("musicbrainz", F.concat(F.lit(f"{_MB}release/"), x["id"]), "release", x["title"], x["date"], artists=_mb_credit(x), children=tracks)


def musicbrainz_release_group(x: Column) -> list[Column]:
    releases = F.transform(x["releases"], lambda r: _child(F.concat(F.lit(f"{_MB}release/"), r["id"]), r["title"]))
    return _entity("musicbrainz", F.concat(F.lit(f"{_MB}release-group/"), x["id"]), "release_group", x["title"], x["first-release-date"], artists=_mb_credit(x), children=releases)


_SP = "https://open.spotify.com/"


def spotify_track(x: Column) -> list[Column]:
    isrc = F.filter(F.array(x["external_ids"]["isrc"]), lambda i: i.isNotNull())
    return _entity("spotify", F.concat(F.lit(f"{_SP}track/"), x["id"]), "track", x["name"], x["album"]["release_date"], x["duration_ms"], isrc, _artists(x["artists"], f"{_SP}artist/"))


def spotify_album(x: Column) -> list[Column]:
    tracks = F.transform(x["tracks"]["items"], lambda t: _child(F.concat(F.lit(f"{_SP}track/"), t["id"]), t["name"], disc_no=t["disc_number"], track_no=t["track_number"], duration_ms=t["duration_ms"]))
    return _entity("spotify", F.concat(F.lit(f"{_SP}album/"), x["id"]), "release", x["name"], x["release_date"], artists=_artists(x["artists"], f"{_SP}artist/"), children=tracks)


def clock_ms(c: Column) -> Column:
    """"3:05" or "1:02:03" in milliseconds."""
    parts = F.transform(F.split(c, ":"), lambda p: F.try_to_number(p, F.lit("999")).cast("bigint"))
    return F.when(c.rlike(r"^\d+(:\d\d){1,2}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 60 + p) * 1000)


_DC = "https://www.discogs.com/"


def discogs_release(x: Column) -> list[Column]:
    own = F.concat(F.lit(f"{_DC}release/"), x["id"].cast("string"))
    tracks = F.transform(F.filter(x["tracklist"], lambda t: F.coalesce(t["type_"], F.lit("track")) == "track"), lambda t, i: _child(F.concat(own, F.lit("?track="), F.when(t["position"].rlike(r"^\d+(-\d+)?$"), t["position"]).otherwise(F.concat(F.lit("S-"), (i + 1).cast("string")))), t["title"], track_no=i + 1, duration_ms=clock_ms(t["duration"])))
    return _entity("discogs", own, "release", x["title"], F.regexp_replace(x["released"], "(-00)+$", ""), artists=_artists(x["artists"], f"{_DC}artist/"), children=tracks)


def discogs_artist(x: Column) -> list[Column]:
    return _entity("discogs", F.concat(F.lit(f"{_DC}artist/"), x["id"].cast("string")), "artist", x["name"])


def iso_duration_ms(c: Column) -> Column:
    """PT1H2M3S in milliseconds."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(c.startswith("PT"), (part("H") * 3600 + part("M") * 60 + part("S")) * 1000)


def youtube_video(x: Column) -> list[Column]:
    channel = F.array(F.struct(F.concat(F.lit("https://www.youtube.com/channel/"), x["snippet"]["channelId"]).alias("identifier"), x["snippet"]["channelTitle"].alias("name")))
    return _entity("youtube", F.concat(F.lit("https://youtu.be/"), x["id"]), "track", x["snippet"]["title"], F.substring(x["snippet"]["publishedAt"], 1, 10), iso_duration_ms(x["contentDetails"]["duration"]), artists=channel)


def soundcloud_track(x: Column) -> list[Column]:
    artist = F.array(F.struct(F.regexp_extract(x["webpage_url"], r"^(https://soundcloud\.com/[^/]+)", 1).alias("identifier"), x["uploader"].alias("name")))
    return _entity("soundcloud", x["webpage_url"], "track", x["title"], duration=F.round(x["duration"] * 1000), artists=artist)


def nicovideo_video(x: Column) -> list[Column]:
    owner = F.array(F.struct(F.concat(F.lit("https://www.nicovideo.jp/user/"), x["uploader_id"]).alias("identifier"), x["uploader"].alias("name")))
    date = F.regexp_replace(x["upload_date"], r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    return _entity("nicovideo", F.concat(F.lit("https://www.nicovideo.jp/watch/"), x["display_id"]), "track", x["title"], date, x["duration"] * 1000, artists=owner)


def _pages(form: str, items: Column) -> Column:
    return F.transform(items, lambda i: _child(F.concat(F.lit(form), i["id"].cast("string")), i["title"]))


def musicbrainz_artist(x: Column) -> list[Column]:
    return _entity("musicbrainz", F.concat(F.lit(f"{_MB}artist/"), x["id"]), "artist", x["name"], children=_pages(f"{_MB}release-group/", x["release-groups"]))


def musicbrainz_work(x: Column) -> list[Column]:
    """A work's performances, as children; original_anchors tells the original among them."""
    rows = F.filter(x["relations"], lambda r: (r["target-type"] == "recording") & (r["type"] == "performance"))
    return _entity("musicbrainz", F.concat(F.lit(f"{_MB}work/"), x["id"]), "track", x["title"], children=F.transform(rows, lambda r, n: _child(F.concat(F.lit(f"{_MB}recording/"), r["recording"]["id"]), r["recording"]["title"], track_no=n, duration_ms=r["recording"]["length"])))


def spotify_artist(x: Column) -> list[Column]:
    albums = F.transform(x["albums"], lambda i: _child(F.concat(F.lit(f"{_SP}album/"), i["id"]), i["name"]))
    return _entity("spotify", F.concat(F.lit(f"{_SP}artist/"), x["id"]), "artist", x["name"], children=albums)


def spotify_playlist(x: Column) -> list[Column]:
    tracks = F.transform(F.filter(x["tracks"]["items"], lambda i: i["track"]["id"].isNotNull()), lambda i, n: _child(F.concat(F.lit(f"{_SP}track/"), i["track"]["id"]), i["track"]["name"], track_no=n + 1, duration_ms=i["track"]["duration_ms"]))
    return _entity("spotify", F.concat(F.lit(f"{_SP}playlist/"), x["id"]), "release", x["name"], children=tracks)


def discogs_master(x: Column) -> list[Column]:
    own = F.concat(F.lit(f"{_DC}master/"), x["id"].cast("string"))
    return _entity("discogs", own, "release_group", x["title"], F.when(x["year"] > 0, x["year"]), artists=_artists(x["artists"], f"{_DC}artist/"), children=_pages(f"{_DC}release/", x["versions"]))


def youtube_playlist(x: Column) -> list[Column]:
    videos = F.transform(x["items"], lambda i: _child(F.concat(F.lit("https://youtu.be/"), i["snippet"]["resourceId"]["videoId"]), i["snippet"]["title"], track_no=i["snippet"]["position"] + 1))
    return _entity("youtube", F.concat(F.lit("https://www.youtube.com/playlist?list="), x["id"]), "release", x["snippet"]["title"], children=videos)


def youtube_channel(x: Column) -> list[Column]:
    return _entity("youtube", F.concat(F.lit("https://www.youtube.com/channel/"), x["id"]), "artist", x["snippet"]["title"])


def _ytdlp_list(source: str, entry_type: str):
    """A listing as yt-dlp gives it: its entries in order."""

    def columns(x: Column) -> list[Column]:
        items = F.transform(x["entries"], lambda e, n: _child(e["url"], e["title"], track_no=n + 1))
        return _entity(source, x["webpage_url"], entry_type, F.coalesce(x["title"], x["uploader"]), children=items)

    return columns


_YTDLP = "struct<webpage_url:string,title:string,uploader:string,entries:array<struct<url:string,title:string>>>"
_MB_LIST = "array<struct<id:string,title:string>>"
_SP_TRACKS = "struct<items:array<struct<track:struct<id:string,name:string,duration_ms:bigint>>>>"

#: kind -> (schema of a document, columns of ENTITY).
PARSERS: dict[str, tuple[str, Callable[[Column], list[Column]]]] = {
    "musicbrainz_recording": (f"struct<id:string,title:string,`first-release-date`:string,length:bigint,video:boolean,isrcs:array<string>,{_MB_CREDIT}>", musicbrainz_recording),
    "musicbrainz_release": (f"struct<id:string,title:string,date:string,{_MB_CREDIT},media:array<struct<position:int,tracks:array<struct<position:int,title:string,length:bigint,recording:struct<id:string>>>>>>", musicbrainz_release),
    "musicbrainz_release_group": (f"struct<id:string,title:string,`first-release-date`:string,{_MB_CREDIT},releases:array<struct<id:string,title:string>>>", musicbrainz_release_group),
    "spotify_track": ("struct<id:string,name:string,duration_ms:bigint,external_ids:struct<isrc:string>,artists:array<struct<id:string,name:string>>,album:struct<id:string,name:string,release_date:string>>", spotify_track),
    "spotify_album": ("struct<id:string,name:string,release_date:string,artists:array<struct<id:string,name:string>>,tracks:struct<items:array<struct<id:string,name:string,disc_number:int,track_number:int,duration_ms:bigint>>>>", spotify_album),
    "discogs_release": ("struct<id:bigint,title:string,released:string,artists:array<struct<id:bigint,name:string>>,tracklist:array<struct<position:string,type_:string,title:string,duration:string>>>", discogs_release),
    "discogs_artist": ("struct<id:bigint,name:string>", discogs_artist),
    "youtube_video": ("struct<id:string,snippet:struct<title:string,channelId:string,channelTitle:string,publishedAt:string>,contentDetails:struct<duration:string>>", youtube_video),
    "soundcloud_track": ("struct<webpage_url:string,title:string,uploader:string,duration:double>", soundcloud_track),
    "nicovideo_video": ("struct<display_id:string,title:string,uploader:string,uploader_id:string,upload_date:string,duration:bigint>", nicovideo_video),
    "musicbrainz_artist": (f"struct<id:string,name:string,`release-groups`:{_MB_LIST}>", musicbrainz_artist),
    "musicbrainz_work": ("struct<id:string,title:string,relations:array<struct<`type`:string,`target-type`:string,recording:struct<id:string,title:string,length:bigint>>>>", musicbrainz_work),
    "spotify_artist": ("struct<id:string,name:string,albums:array<struct<id:string,name:string>>>", spotify_artist),
    "spotify_playlist": (f"struct<id:string,name:string,tracks:{_SP_TRACKS}>", spotify_playlist),
    "discogs_master": ("struct<id:bigint,title:string,year:int,artists:array<struct<id:bigint,name:string>>,versions:array<struct<id:bigint,title:string>>>", discogs_master),
    "youtube_playlist": ("struct<id:string,snippet:struct<title:string>,items:array<struct<snippet:struct<title:string,position:int,resourceId:struct<videoId:string>>>>>", youtube_playlist),
    "youtube_channel": ("struct<id:string,snippet:struct<title:string>>", youtube_channel),
    "soundcloud_playlist": (_YTDLP, _ytdlp_list("soundcloud", "release")),
    "soundcloud_artist": (_YTDLP, _ytdlp_list("soundcloud", "artist")),
    "nicovideo_series": (_YTDLP, _ytdlp_list("nicovideo", "release")),
    "nicovideo_mylist": (_YTDLP, _ytdlp_list("nicovideo", "release")),
    "nicovideo_user": (_YTDLP, _ytdlp_list("nicovideo", "artist")),
}


def parse(documents: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """ENTITY rows of JSON documents of one kind; what isn't JSON is left out."""
    schema, columns = PARSERS[kind]
    parsed = documents.select(F.from_json(column, schema).alias("x"))
    return parsed.select(*columns(F.col("x"))).filter("identifier IS NOT NULL")


def youtube_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """value: one document for each item of list responses."""
    return pages.select(F.explode(F.from_json(F.get_json_object(column, "$.items"), "array<string>")).alias("value"))


def credits(entities: DataFrame) -> DataFrame:
    one = entities.select("source", "identifier", F.posexplode("artists").alias("n", "a"))
    return one.select("source", "identifier", F.col("source").alias("artist_source"), F.col("a.identifier").alias("artist_identifier"), F.lit("artist").alias("role"), F.lit(True).alias("main_artist"), F.to_json(F.struct(F.col("n").alias("position"))).alias("extra"))


def children(entities: DataFrame) -> DataFrame:
    one = entities.select(F.col("source").alias("parent_source"), F.col("identifier").alias("parent_identifier"), F.explode("children").alias("c"))
    return one.select("parent_source", "parent_identifier", F.col("parent_source").alias("child_source"), F.col("c.identifier").alias("child_identifier"), "c.disc_no", "c.track_no")


def isrc_links(entities: DataFrame) -> DataFrame:
    """Links between pairs and their recordings' ISRCs."""
    code = F.upper(F.regexp_replace(F.col("i"), r"[\s\-]", ""))
    one = entities.select(F.col("source").alias("a_source"), F.col("identifier").alias("a_identifier"), F.explode("isrcs").alias("i"))
    return one.select("a_source", "a_identifier", F.lit("isrc").alias("b_source"), code.alias("b_identifier"))
