"""Canonical identifiers of provider pages, as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids and hosts of the providers' pages.
_END = r"(?:[/?#].*)?$"
_MBID = "([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
_LIST = r"((?:PL|LL|EC|UU|FL|RD|UL|TL|PU|OLAK5uy_)[0-9A-Za-z_\-]{10,}|RDMM|WL|LL|LM)"
_YT = r"^https?://(?:\w+\.)?youtube(?:-nocookie|kids)?\.com/"
_SC = r"^https?://soundcloud\.com/"


@dataclass(frozen=True)
class Shape:
    """Pages of one kind: what they match, and the canonical form ({} are the groups)."""

    source: str
    kind: str
    pattern: str
    form: str


def _spotify(kind: str, entry: str) -> Shape:
    return Shape("spotify", entry, rf"^https?://open\.spotify\.com/(?:intl-[a-z\-]+/)?{kind}/([0-9A-Za-z]{{22}}){_END}", f"https://open.spotify.com/{kind}/{{}}")


def _musicbrainz(kind: str, entry: str) -> Shape:
    return Shape("musicbrainz", entry, rf"^https?://(?:www\.)?musicbrainz\.org/{kind}/{_MBID}{_END}", f"https://musicbrainz.org/{kind}/{{}}")


def _discogs(kind: str, entry: str) -> Shape:
    return Shape("discogs", entry, rf"^https?://(?:www\.)?discogs\.com/{kind}/(\d+)(?:[/?#-].*)?$", f"https://www.discogs.com/{kind}/{{}}")


#: Kinds of pages and their canonical forms. In this order; the first that matches stands.
SHAPES: tuple[Shape, ...] = (
    Shape("youtube", "track", rf"(?i){_YT}(?:(?:v|embed|e|shorts|live)/(?!videoseries|live_stream)|(?:(?:watch|movie)(?:_popup)?(?:\.php)?/?)?(?:\?|#!?)(?:.*?[&;])??v=)([0-9A-Za-z_\-]{{11}})(?:[?#&].*)?$", "https://youtu.be/{}"),
    Shape("youtube", "track", r"(?i)^https?://youtu\.be/([0-9A-Za-z_\-]{11})(?:[?#&].*)?$", "https://youtu.be/{}"),
    Shape("youtube", "release", rf"(?i)^https?://(?:\w+\.)?youtube\.com/(?:playlist|watch)\?(?:.*?[&;])??list={_LIST}(?:[#&].*)?$", "https://www.youtube.com/playlist?list={}"),
    Shape("youtube", "release", rf"^{_LIST}$", "https://www.youtube.com/playlist?list={}"),
    Shape("youtube", "artist", rf"(?i){_YT}channel/([0-9A-Za-z_\-]+){_END}", "https://www.youtube.com/channel/{}"),
    Shape("youtube", "artist", rf"(?i){_YT}c/([^/?#]+){_END}", "https://www.youtube.com/c/{}"),
    Shape("youtube", "artist", rf"(?i){_YT}user/([^/?#]+){_END}", "https://www.youtube.com/user/{}"),
    Shape("youtube", "artist", rf"(?i){_YT}(@[^/?#]+){_END}", "https://www.youtube.com/{}"),
    _spotify("track", "track"),
    _spotify("album", "release"),
    _spotify("playlist", "release"),
    _spotify("artist", "artist"),
    Shape("soundcloud", "release", rf"{_SC}([^/?]+)/sets/([^/?]+)(?:[/?].*)?$", "https://soundcloud.com/{}/sets/{}"),
    Shape("soundcloud", "track", rf"{_SC}([^/?]+)/(?!sets(?:\?|$))([^/?]+)(?:\?.*)?$", "https://soundcloud.com/{}/{}"),
    Shape("soundcloud", "artist", rf"{_SC}([^/?]+)/?(?:\?.*)?$", "https://soundcloud.com/{}"),
    Shape("nicovideo", "track", r"^https://www\.nicovideo\.jp/watch/([^?]+)(?:\?.*)?$", "https://www.nicovideo.jp/watch/{}"),
    Shape("nicovideo", "release", r"^https://www\.nicovideo\.jp/series/([^?#]+)(?:[?#].*)?$", "https://www.nicovideo.jp/series/{}"),
    Shape("nicovideo", "release", r"^https://www\.nicovideo\.jp/user/([^/]+)/mylist/([^?#]+)(?:[?#].*)?$", "https://www.nicovideo.jp/user/{}/mylist/{}"),
    Shape("nicovideo", "artist", r"^https://www\.nicovideo\.jp/user/([^/?#]+)(?:[/?#].*)?$", "https://www.nicovideo.jp/user/{}"),
    Shape("discogs", "track", r"^https?://(?:www\.)?discogs\.com/release/(\d+)\?track=(S-\d+|\d+(?:-\d+)?)$", "https://www.discogs.com/release/{}?track={}"),
    _discogs("release", "release"),
    _discogs("master", "release_group"),
    _discogs("artist", "artist"),
    _musicbrainz("recording", "track"),
    _musicbrainz("release", "release"),
    _musicbrainz("release-group", "release_group"),
    _musicbrainz("artist", "artist"),
)


def _apply(c: Column, shape: Shape) -> Column:
    parts = shape.form.split("{}")
    out = [F.lit(parts[0])]
    for i, tail in enumerate(parts[1:], 1):
        out += [F.regexp_extract(c, shape.pattern, i), F.lit(tail)]
    return F.when(c.rlike(shape.pattern), F.struct(F.lit(shape.source).alias("source"), F.concat(*out).alias("identifier"), F.lit(shape.kind).alias("entry_type")))


def canonicalize(c: Column) -> Column:
    """struct(source, identifier, entry_type), or null for a page of no known kind. Applied to its own identifiers it changes nothing."""
    return F.coalesce(*[_apply(c, s) for s in SHAPES])


def canonical_or_raw(c: Column) -> Column:
    return F.coalesce(canonicalize(c)["identifier"], c)


def playable(c: Column) -> Column:
    """Whether a page can be embedded in a player: tracks of video sources and of streaming services."""
    found = canonicalize(c)
    return F.coalesce((found["entry_type"] == "track") & found["source"].isin("youtube", "nicovideo", "soundcloud", "spotify"), F.lit(False))


def url_key(c: Column) -> Column:
    """A page's key in the mirror: lower-case host without www. or m., no scheme, query, fragment or slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^(?:www\.|m\.)", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(.*)$", 1), r"/+$", ""))
