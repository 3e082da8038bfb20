"""Reading the tables of a directory, and shared folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a session without executors of its own that names none gets a local one (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kinlace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a path that scratch() gave."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it again: the lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_stored_order(df: DataFrame, name: str) -> DataFrame:
    """df with a long column that ascends as its rows lie in the written table that it reads: by part, then row. Rows of a
    frame that reads no files go by the frame's partitions."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        return df.withColumn(name, part * F.lit(1 << 40) + F.col("_metadata.row_index"))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


#: Text of a batch that is worked on, and given back to Spark, together.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some PIECE_BYTES of its column number `text`, so that neither side holds results of the whole."""
    for s in tk.slices(batch.column(text), limit=PIECE_BYTES):
        yield batch.slice(s.rows.start, s.n)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo n; a null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def annotate(df: DataFrame, text_col: str, work: Callable[[pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """df with new columns behind its own, made batch by batch from its text column, without a shuffle.

    schema: "name type, ...". Inside, columns go by position, so names of df can't clash; a column of df
    that has a new column's name is left out of the result."""
    names = df.columns
    fields = [x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", schema)]
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    inner = inner.withColumn(f"c{len(names)}", F.col(f"c{at}").cast("string"))
    outer = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields[:-1])), *(f"n{i} {kind}" for i, (_, kind) in enumerate(fields))])
    labels = [f"c{i}" for i in range(len(names))] + [f"n{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, len(names)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(part.columns[-1])], names=labels)
        tk.release()

    made = inner.mapInArrow(run, outer)
    new = [name for name, _ in fields]
    return made.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in new], *[F.col(f"n{i}").alias(n) for i, n in enumerate(new)])


def filtered(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of df for which keep(text column) is true, with all of df's columns."""
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    plain = inner.schema.fields[at].dataType.simpleString() == "string"
    wide = inner if plain else inner.withColumn("text", F.col(f"c{at}").cast("string"))
    labels = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = at if plain else len(names)
        for batch in batches:
            for part in pieces(batch, text):
                yield part.filter(pa.array(keep(part.column(text)), pa.bool_())).select(labels)
        tk.release()

    return wide.mapInArrow(run, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields))).toDF(*names)


def key_filter(keys: DataFrame) -> tk.KeyFilter:
    """A filter of a frame's one long column: bitmaps of the tasks, joined by OR over chunks. Its size does not depend on the keys."""
    chunk = tk.KeyFilter.CHUNK // 8
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = tk.KeyFilter()
        for batch in batches:
            mine.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts = mine.packed.reshape(-1, chunk)
        live = np.flatnonzero(parts.any(axis=1))
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array([pack(parts[i].tobytes()) for i in live], pa.binary())], names=["chunk", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(unpack(bits), dtype=np.uint8)
                total[c] = total[c] | x if c in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "bits"])

    schema = "chunk long, bits binary"
    out = tk.KeyFilter()
    for r in keys.mapInArrow(mark, schema).repartition(n, "chunk").mapInArrow(join, schema).collect():  # at most the filter's size
        out.packed[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.bits, dtype=np.uint8)
    return out
