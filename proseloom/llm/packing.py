"""Operator 10: conflict-constrained best-fit packing of documents into sequences.

Documents are dealt into shards by a hash of the id; the number of shards follows the number of documents, so a
shard's work is bounded whatever the source or duplicate cluster. In a shard, largest first, a document goes to the
tightest open bin that is compatible: bins are kept ordered by residual, each with bit planes of the sources and
a bitmap of the duplicate clusters it holds (of a shard, so copies in other shards do not conflict); the successor search starts at the document's length and goes on to
the next larger residual until a compatible bin is found, else a bin is opened.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

#: Words in a bin, documents of one source in a bin, documents in a shard about.
CAPACITY, PER_SOURCE, SHARD = 4096, 4, 4096


def best_fit(items: list[tuple[int, str, bytes]], capacity: int, per_source: int) -> list[int]:
    """The bin of each item (length, source, cluster): no bin over capacity, no two items of one cluster in a bin,
    at most per_source of one source. Items come in the order given; each goes to the tightest compatible bin."""
    sources: dict[str, int] = {}
    clusters: dict[bytes, int] = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    planes: list[list[int]] = []
    held: list[int] = []
    out = []
    for n, source, cluster in items:
        s = 1 << sources.setdefault(source, len(sources))
        c = 1 << clusters.setdefault(cluster, len(clusters))
        at = bisect_left(order, (n, -1))
        while at < len(order):
            b = order[at][1]
            if not held[b] & c and not all(p & s for p in planes[b]):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(planes)
            planes.append([0] * per_source)
            held.append(0)
        own = planes[b]
        for k in range(per_source):
            if not own[k] & s:
                own[k] |= s
                break
        held[b] |= c
        if left > n:
            insort(order, (left - n, b))
        out.append(b)
    return out


def cluster_key(text: str) -> bytes:
    """Texts equal but for white space and the case of A-Z are duplicates."""
    return hashlib.blake2b(b" ".join(text.encode().lower().split()), digest_size=16).digest()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([len(t.encode().split()) for t in texts], pa.int64()), pa.array([cluster_key(t) for t in texts], pa.binary()), b.column("shard")], names=["doc_id", "source", "n_words", "cluster", "shard"])


def _packed(capacity: int, per_source: int):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "source", "n_words", "cluster")), strict=True), key=lambda r: (-(r[2] % capacity), r[0] is None, r[0] or 0, r[3]))
        base = t.column("shard")[0].as_py() << 32
        rest = [r for r in rows if r[2] % capacity or not r[2]]
        bins = best_fit([(r[2] % capacity, r[1], r[3]) for r in rest], capacity, per_source)
        out, at, opened = [], {}, max(bins, default=-1) + 1
        for r, b in zip(rest, bins, strict=True):
            start = at.get(b, 0)
            at[b] = start + r[2] % capacity
            out.append((r[0], r[2] // capacity, base + b, start, r[2] - r[2] % capacity, r[2] % capacity))
        for r in rows:
            for piece in range(r[2] // capacity):
                out.append((r[0], piece, base + opened, 0, piece * capacity, capacity))
                opened += 1
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "piece", "bin_id", "bin_start", "doc_start", "length"), cols, strict=True)})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, bin_id, bin_start, doc_start, length: where every word of every row of docs goes.

    docs: doc_id, text, source; other columns are ignored. Lengths are in words (ASCII white space). A document longer
    than capacity is cut into full bins of its own and a rest, which is packed like the others. Texts without words
    are packed with length 0. Null texts count as empty, null sources as a source ''. Rows repeating a doc_id are
    packed each; an exact repeat is a duplicate and goes to another bin. Rows are dealt into shards by id and text, those
    without an id by their place, so that null and repeated ids spread; equal lengths go by id, null ids last, then by
    text. An empty table gives an empty result.
    """
    n = docs.select("doc_id").count()
    shards = max(1, math.ceil(n / shard))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id()), "text"), F.lit(shards)).alias("shard"))
    return mapped(d, _measured, "doc_id bigint, source string, n_words bigint, cluster binary, shard bigint").groupBy("shard").applyInArrow(_packed(capacity, per_source), "doc_id bigint, piece bigint, bin_id bigint, bin_start bigint, doc_start bigint, length bigint")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
