"""Readers and writers of files: COPY text, change packets, JSON lines, YAML entries, and whole-line sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.functions import urls
from kinlace.functions.values import unescape_copy


def read_copy_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated COPY text as strings; missing fields and \\N are null."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(*[unescape_copy(F.get(fields, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def read_url_mirror(spark: SparkSession, path: str) -> DataFrame:
    """id, gid, url_norm of a dump of pages (id, gid, url, ...); rows without a page are left out."""
    rows = read_copy_text(spark, path, ["id", "gid", "url"]).filter("url IS NOT NULL")
    return rows.select(F.col("id").cast("bigint"), "gid", urls.url_key(F.col("url")).alias("url_norm"))


def parse_changes(lines: DataFrame, table: str = "musicbrainz.url") -> DataFrame:
    """seq, op, id, old_url, new_url, gid of the changes of one table, from lines (value) of eight tab-separated fields:
    seq, table, op (i, u, d), txn, old row, new row (JSON), and two that aren't used."""
    f = F.split("value", "\t")
    row = "struct<id:bigint,gid:string,url:string>"
    old, new = (F.from_json(unescape_copy(F.get(f, F.lit(i))), row) for i in (4, 5))
    out = lines.filter(F.size(f) >= 6).select(F.get(f, F.lit(0)).cast("bigint").alias("seq"), F.get(f, F.lit(1)).alias("table"), F.get(f, F.lit(2)).alias("op"), old.alias("old"), new.alias("new"))
    kept = out.filter((F.col("table") == table) & F.col("op").isin("i", "u", "d"))
    return kept.select("seq", "op", F.coalesce("new.id", "old.id").alias("id"), F.coalesce("new.gid", "old.gid").alias("gid"), F.col("old.url").alias("old_url"), F.col("new.url").alias("new_url"))


def read_packet(spark: SparkSession, folder: str) -> tuple[int, int, DataFrame]:
    """Sequence, schema and changes of an unpacked packet: files REPLICATION_SEQUENCE, SCHEMA_SEQUENCE, pending_data."""
    number = lambda name: int(spark.read.text(f"{folder}/{name}").first()[0].strip())
    return number("REPLICATION_SEQUENCE"), number("SCHEMA_SEQUENCE"), parse_changes(spark.read.text(f"{folder}/pending_data"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_ledger(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def write_lines(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """Whole lines of text, tab-separated; null is empty."""
    rows.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value")).write.text(path)


YAML_ENTRY = "path string, identifier string, entry_type string, name string, release_date string, duration_ms bigint, children array<string>"


def read_yaml_entries(spark: SparkSession, path: str) -> DataFrame:
    """YAML_ENTRY of local entry files; a file's path is its identifier. Needs a YAML parser on the executors."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for p, text in zip(pdf["path"], pdf["value"], strict=True):
                x = yaml.safe_load(text) or {}
                named = sorted(x.get("aliases") or [], key=lambda a: not a.get("primary"))
                children = [c.get("name") for c in x.get("children") or []]
                out.append((p, p.rsplit("/", 1)[-1].rsplit(".", 1)[0], x.get("type"), named[0]["name"] if named else None, str(x["release_date"]) if x.get("release_date") else None, x.get("duration_ms"), children))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in YAML_ENTRY.split(", ")])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(parse, YAML_ENTRY)
