"""Functions on identifiers, JSON payloads, times and images."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EDITION_KINDS = ("derived_from", "alt_version", "live", "remix", "instrumental", "cover", "arrangement")
DEGENERATE_MARKERS = ("instrumental", "short_ver", "tv_size", "game_ver")
SAME_KINDS = ("same_identity", "variant")
VIDEO_SOURCES = ("youtube", "nicovideo", "soundcloud", "bilibili")
SCRIPT_VIDEO_SOURCES = ("youtube", "nicovideo", "soundcloud")
AUTHORITATIVE_SOURCES = ("musicbrainz", "spotify", "isrc", "discogs")
ENTRY_TYPES = ("artist", "release_group", "release", "track")


def normalize_isrc(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-]", ""))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def origin_priority(origin: Column) -> Column:
    return F.when(origin.isin("user", "manual"), 0).when(origin.isin("imported", "provider"), 1).otherwise(2)


def original_relation_confidence(kind: Column) -> Column:
    return F.when(kind == "cover", 0.85).otherwise(0.9)


def entry_type_rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(ENTRY_TYPES):
        out = F.when(kind == name, i).otherwise(out)
    return out


# --- JSON -------------------------------------------------------------------------------------------------


def extra_objects(raw: str | None) -> list[dict]:
    """A relation's extra: an object, or a list of them."""
    try:
        x = json.loads(raw) if raw else None
    except ValueError:
        return []
    return [x] if isinstance(x, dict) else [o for o in x if isinstance(o, dict)] if isinstance(x, list) else []


def extra_derived(objects: list[dict]) -> int | None:
    """The derived entry, if all objects that name one agree."""
    named = {o["derived_entry"] for o in objects if isinstance(o.get("derived_entry"), int)}
    return named.pop() if len(named) == 1 else None


def extra_transformation(objects: list[dict]) -> str | None:
    for o in objects:
        t = o.get("transformation")
        if isinstance(t, str) and t:
            return t
        if isinstance(t, list) and (words := [w for w in t if isinstance(w, str)]):
            return " ".join(words)
    return None


def combine_extra(raws: list[str | None]) -> str | None:
    """Objects of several extras: distinct, in the order of their text; a single one stays an object."""
    texts = sorted({json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in raws for o in extra_objects(r)})
    return None if not texts else texts[0] if len(texts) == 1 else "[" + ",".join(texts) + "]"


def remap_extra(raw: str | None, ids: dict[int, int]) -> str | None:
    """Ids of entries inside an extra, pointed to what they were merged into."""
    objects = extra_objects(raw)
    moved = [{k: ids.get(v, v) if k.endswith("_entry") and isinstance(v, int) else v for k, v in o.items()} for o in objects]
    return combine_extra([json.dumps(moved)]) if moved else raw


def sha256_value(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def content_id(*columns: Column) -> Column:
    """A content-addressed id: sha256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def base_swap(digest: Column) -> Column:
    """Whether left and right change places: the low bit of the digest's first byte."""
    return F.pmod(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), F.lit(2)) == 1


def request_signature(params: dict[str, str], secret: str, skip: tuple[str, ...] = ("format", "callback", "api_sig")) -> str:
    """md5 of the sorted parameters and the secret."""
    return hashlib.md5(("".join(f"{k}{v}" for k, v in sorted(params.items()) if k not in skip) + secret).encode()).hexdigest()


# --- COPY text --------------------------------------------------------------------------------------------


def unescape_copy(c: Column) -> Column:
    r"""A field of COPY text: \N is null, \t \n \r \\ are what they say."""
    marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.when(c != "\\N", F.replace(marked, F.lit("\x00"), F.lit("\\")))


# --- time -------------------------------------------------------------------------------------------------

_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def parse_duration_ms(text: str) -> int:
    """"1h30m", "250ms", "90" (seconds)."""
    text = text.strip().lower()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return round(float(text) * 1_000)
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])", text)
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])", "", text).strip():
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(n) * _UNITS[u] for n, u in parts))


def pacific_date(epoch_seconds: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), "America/Los_Angeles"))


def scrobbles(duration_s: Column, listened_s: Column) -> Column:
    """Longer than 30 s, and heard for half of it or 240 s."""
    return F.coalesce((duration_s > 30) & (listened_s >= F.least(duration_s / 2, F.lit(240.0))), F.lit(False))


# --- images, songs ----------------------------------------------------------------------------------------


def pick_image(images: Column) -> Column:
    """Of array<struct<url, width, height>>: the smallest with a long side of 300 or more, else the largest, else the first."""
    side = lambda i: F.greatest(F.coalesce(i["width"], F.lit(0)), F.coalesce(i["height"], F.lit(0)))
    ranked = F.transform(images, lambda i, n: F.struct(side(i).alias("side"), n.alias("n"), i.alias("image")))
    enough = F.array_sort(F.filter(ranked, lambda r: r["side"] >= 300))
    largest = F.array_sort(F.transform(F.filter(ranked, lambda r: r["side"] > 0), lambda r: F.struct((-r["side"]).alias("side"), r["n"].alias("n"), r["image"].alias("image"))))
    return F.coalesce(F.get(enough, F.lit(0))["image"], F.get(largest, F.lit(0))["image"], F.get(images, F.lit(0)))


def merge_songs(songs: list[list[str]]) -> list[list[str]]:
    """Songs (sets of works) that share a work become one; works keep the order in which they came."""
    out: list[list[str]] = []
    for song in songs:
        new = list(dict.fromkeys(song))
        rest = []
        for known in out:
            if set(known) & set(new):
                new = list(dict.fromkeys([*known, *new]))
            else:
                rest.append(known)
        out = [*rest, new]
    return out
