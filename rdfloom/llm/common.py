"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words, and the pattern of one word.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch that a Python worker holds at a time; a row is never split.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset, in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rdfloom-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and by bytes: 10,000 long texts at once don't fit a worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (column names are case-insensitive)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


class WordHashes(dict):
    """word -> unsigned 64-bit hash, remembered up to a bound."""

    def __init__(self, seed: int = 0, bound: int = 400_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


#: Bits of a bitmap's index, and bytes of a part of it: 2 MB in 256 parts, whatever is put into it.
BITMAP, PART = 24, 1 << 13


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of a partition's hashes, in the parts that have a bit."""
    bits = np.zeros(1 << BITMAP, dtype=bool)
    for b in batches:
        bits[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)] = True
    if bits.any():
        packed = np.packbits(bits).reshape(-1, PART)
        own = np.nonzero(packed.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([packed[i].tobytes() for i in own], pa.binary())], names=["part", "bits"])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of a column of 64-bit hashes, by their upper bits. Merged by part, so that 2 MB reach the driver; a full one lets everything pass."""

    def either(rows: pa.Table) -> pa.Table:
        merged = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
        return pa.table({"part": rows.column("part")[:1], "bits": pa.array([merged.tobytes()], pa.binary())})

    kind = "part int, bits binary"
    out = np.zeros(((1 << BITMAP) // 8 // PART, PART), dtype=np.uint8)
    for r in hashes.mapInArrow(_parts, kind).groupBy("part").applyInArrow(either, kind).collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash may be in the bitmap."""
    b = hashes >> np.uint64(64 - BITMAP)
    return (bits[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
