"""Shared pieces of the training-data operators: tables, cut points, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an Arrow batch that goes to a Python worker holds at most: rows, and bytes beyond its first row.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be on any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by rows and by bytes.

    All operators ask for the same bounds, so it doesn't matter which frame was built last when one of them runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then freed memory back to the system: a worker lives on and serves other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own may lack it
            if trim:
                trim(0)

    return whole


def free(name: str, taken: Iterable[str]) -> str:
    """name, or with the first number behind it that makes it none of `taken` (in any case, as Spark compares names)."""
    lower, out, k = {t.lower() for t in taken}, name, 0
    while out.lower() in lower:
        k += 1
        out = f"{name}_{k}"
    return out


def quoted(*names: str) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


def extended(df: DataFrame, *new: tuple[str, str]) -> T.StructType:
    """The schema of df and of new columns (name, type)."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in new:
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset (tests), one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        os.makedirs(found.removeprefix("file://"), exist_ok=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors lose nothing.

    Returns the frame and the path, for drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone; it does so when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt_by_id(docs: DataFrame, parts: int) -> DataFrame:
    """docs with __part: consecutive ranges of doc_id with about as many rows each, null ids in the first.

    The bounds come from the ids alone, so no costly frame is computed twice to sample it."""
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    if not bounds:
        return docs.withColumn("__part", F.lit(0))
    # The bounds in groups, so that a row is compared with about twice the square root of their number.
    wide = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    passed = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    group = passed(numbers(g[0] for g in groups[1:])) if len(groups) > 1 else F.lit(0)
    part = group * wide + passed(F.element_at(F.array(*map(numbers, groups)), group + 1))
    return docs.withColumn("__part", F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words and shingles, by column

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; a run ends with its row."""
    solid = np.ones(len(data) + 1, dtype=bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    solid[-1] = False
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    import xxhash

    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _K)
    live = np.flatnonzero(size <= _LONG_WORD)
    step = 0
    while len(live):
        left = np.minimum(size[live] - step, 8)
        h[live] = mix(h[live] * _K ^ (eight[starts[live] + step] & _MASKS[left]))
        step += 8
        live = live[size[live] > step]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of `width` words as sorted 64-bit hashes.

    A-Z are lower-cased, words are runs without ASCII white space. With fewer words than the width the whole
    sequence is one shingle; null, empty and blank texts have none."""
    data, offsets = text_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    starts, ends = word_spans(data, offsets)
    w = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    if len(w) >= width:
        s = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            s = s * _K + w[k : len(w) - width + 1 + k]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    short = short * _M1 + x
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
