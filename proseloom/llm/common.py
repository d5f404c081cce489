"""What the operators of this package share: the shared folder, staged tables, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"


#: Rows and bytes of an Arrow batch at most: what a worker and the JVM hold of a text column at once follows them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH; a session that asks for smaller ones keeps them."""
    for key, most in BATCH.items():
        now = re.fullmatch(r"([1-9]\d*)b?", spark.conf.get(key))
        if not now or int(now[1]) > most:
            spark.conf.set(key, str(most))


@lru_cache(1)
def lean() -> None:
    """In a Python worker: freed memory goes back to the system. Arrow allocates by malloc, large arrays are mapped one by one."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD: fixed, where glibc would let them grow
            ctypes.CDLL("libc.so.6").mallopt(option, 1 << 18)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in bounded batches and lean workers."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)

    bounded(df.sparkSession)
    return df.mapInArrow(worker, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests) a folder is made and set; a cluster without
    one is an error, as every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proseloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's switch for deleting the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # What the writing shuffled is read by nothing else and goes with its end, not with the driver's next collection.
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstaged(df: DataFrame) -> None:
    """Deletes what staged wrote; nothing may read df afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merged(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """a joined with b by sorting both. Staged tables are small files of many rows, which Spark would otherwise
    send through the driver and unpack in it."""
    return a.join(b.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(col: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words' codes in order of appearance, and each row's offsets into the codes."""
    col = pc.fill_null(col, "")
    if lower:
        col = pc.ascii_lower(col)
    lists = pc.ascii_split_whitespace(col)
    off = lists.offsets.to_numpy()
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(full)])
    off = seen[off - off[0]].astype(np.int64)
    enc = flat.filter(pa.array(full)).dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy().astype(np.int64), off


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit SipHash of each word, the same on every machine."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the ascending 64-bit hashes of its distinct n-word shingles (A-Z lower-cased).

    With fewer than n words the whole sequence is one shingle; without words the set is empty.
    """
    words, codes, off = split_words(col)
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for i in range(n):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]) if len(run) else run
        out = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(run[a : b - n + 1]))
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for w in h[a:b]:
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
