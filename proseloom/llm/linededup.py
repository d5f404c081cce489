"""Operator 7: reversible incremental line dedup: sharded cuckoo filters over exact reference tables.

State, all in the shared folder: postings (key, doc_id), one row for each line key and document that
holds it; refs (key, n_docs, first_doc), its exact reference counts; filters (shard, table), a cuckoo filter
of each shard's keys. The number of shards follows the number of keys, which is counted first. An insertion asks the
filters: keys they do not know are new and skip the exact table, the others are looked up and recounted there; then
the new keys, and only they, enter the filters. A deletion takes the documents' postings away, recounts the
keys concerned and takes keys without holders out of the filters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, mapped, mix, staged, table

#: Code points below which a line is never dropped; keys to a filter shard, about.
LEAST, SHARD_KEYS = 10, 100_000
SLOTS, KICKS = 4, 500
#: Documents with a null doc_id count as one document after all others, with this id, the largest there is.
LAST = 2**63 - 1
#: Into how many insertions the query deals its documents.
BATCHES = 2


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; a power of two of buckets. Fingerprints that found no place
    in KICKS moves are kept with their bucket in a stash, which is searched too, so no insertion fails."""

    def __init__(self, capacity: int, data: bytes | None = None) -> None:
        self.stash: list[tuple[int, int]] = []
        if data is None:
            self.t = np.zeros((1 << max(2, math.ceil(math.log2(max(1, capacity) / SLOTS / 0.85))), SLOTS), np.uint16)
        else:
            n = int.from_bytes(data[:8], "little")
            self.t = np.frombuffer(data, np.uint16, n * SLOTS, 8).reshape(-1, SLOTS).copy()
            self.stash = [tuple(x) for x in np.frombuffer(data, np.int64, offset=8 + n * SLOTS * 2).reshape(-1, 2).tolist()]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: 64-bit hashes. Fingerprints (never 0) and the two buckets of each."""
        mask = np.uint64(len(self.t) - 1)
        with np.errstate(over="ignore"):
            f = (keys >> np.uint64(48)).astype(np.uint16)
            f[f == 0] = 1
            i = mix(keys) & mask
            j = i ^ (mix(f.astype(np.uint64)) & mask)
        return f, i.astype(np.int64), j.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, i, j = self._places(keys)
        found = ((self.t[i] == f[:, None]) | (self.t[j] == f[:, None])).any(axis=1)
        for x, at in self.stash:
            found |= (f == x) & ((i == at) | (j == at))
        return found

    def insert(self, keys: np.ndarray) -> None:
        f, i, j = self._places(keys)
        rng = np.random.default_rng(len(keys))
        n = len(self.t)
        alt = (mix(np.arange(1 << 16, dtype=np.uint64)) & np.uint64(n - 1)).astype(np.int64)
        t = self.t.tolist()
        for x, a, b in zip(f.tolist(), i.tolist(), j.tolist(), strict=True):
            for at in (a, b):
                if 0 in t[at]:
                    t[at][t[at].index(0)] = x
                    break
            else:
                at = a
                for _ in range(KICKS):
                    s = int(rng.integers(SLOTS))
                    t[at][s], x = x, t[at][s]
                    at ^= int(alt[x])
                    if 0 in t[at]:
                        t[at][t[at].index(0)] = x
                        break
                else:
                    self.stash.append((x, at))
        self.t = np.array(t, np.uint16)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for x, a, b in zip(*(v.tolist() for v in self._places(keys)), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.t[at] == x)
                if len(hit):
                    self.t[at, hit[0]] = 0
                    break
            else:
                self.stash.remove((x, a) if (x, a) in self.stash else (x, b))

    def data(self) -> bytes:
        return len(self.t).to_bytes(8, "little") + self.t.tobytes() + np.array(self.stash, np.int64).tobytes()


def line_key(line: str) -> bytes | None:
    """A 128-bit digest of the line stripped of white space, A-Z lower-cased; None under LEAST code points."""
    line = line.strip(WS)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= LEAST else None


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, ids = [], []
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = {k for line in text.split("\n") if (k := line_key(line))}
            keys += own
            ids += [i] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2]


def _probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
    """Of one shard: whether the filter may hold each key."""
    old = filters.column("table").to_pylist()
    h = _hashes(keys.column("key"))
    return keys.append_column("maybe", pa.array(Cuckoo(0, old[0]).contains(h) if old else np.zeros(len(h), bool)))


def _grown(filters: pa.Table, keys: pa.Table) -> pa.Table:
    """Of one shard: its filter with the new keys."""
    old = filters.column("table").to_pylist()
    f = Cuckoo(SHARD_KEYS * 5 // 4, old[0] if old else None)
    if keys.num_rows:
        f.insert(_hashes(keys.column("key")))
    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int64()), "table": pa.array([f.data()], pa.binary())})


def _without(filters: pa.Table, gone: pa.Table) -> pa.Table:
    if not filters.num_rows:
        return filters.select(["shard", "table"])
    f = Cuckoo(0, filters.column("table")[0].as_py())
    if gone.num_rows:
        f.delete(_hashes(gone.column("key")))
    return pa.table({"shard": filters.column("shard").combine_chunks(), "table": pa.array([f.data()], pa.binary())})


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
            lines = text.split("\n")
            gone = set(drop or ())
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            out = "\n".join(kept)
            rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(out.encode()).hexdigest(), out))
        n, d, sha, out = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.string()), b.column("row")], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text", "row"])


class LineDedup:
    """The state of an incremental line dedup. insert and delete take documents in and out in any order;
    apply gives documents without the lines that the state says an earlier document holds."""

    def __init__(self, spark: SparkSession, shards: int = 8) -> None:
        self.shards = shards
        self.postings = spark.createDataFrame([], "key binary, doc_id bigint")
        self.refs = spark.createDataFrame([], "key binary, n_docs bigint, first_doc bigint")
        self.filters = spark.createDataFrame([], "shard bigint, table binary")
        self.n_keys = 0

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("bigint"))

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))

    def _fill(self, filters: DataFrame, keys: DataFrame) -> None:
        self.filters = staged(filters.groupBy("shard").cogroup(self._sharded(keys.select("key")).groupBy("shard")).applyInArrow(_grown, "shard bigint, table binary"), "filters")

    def insert(self, docs: DataFrame) -> None:
        """docs: doc_id, text; other columns are ignored. A document inserted twice counts once."""
        new = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        new = staged(mapped(new, _postings, "key binary, doc_id bigint").distinct(), "postings")
        batch = staged(self._counted(new), "batch")
        n_new = batch.count()
        none = self.filters.limit(0)
        if self.n_keys + n_new > self.shards * SHARD_KEYS:
            # More shards: all filters are dealt anew. Doubling at least keeps this rare.
            self.shards = max(2 * self.shards, math.ceil((self.n_keys + n_new) / SHARD_KEYS))
            if self.n_keys:
                self._fill(none, self.refs)
        if not self.n_keys:
            self.postings, self.refs, self.n_keys = new, batch, n_new
            self._fill(none, batch)
            return
        asked = self._sharded(batch)
        asked = staged(self.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_probe, "key binary, n_docs bigint, first_doc bigint, shard bigint, maybe boolean"), "asked")
        maybe = asked.where("maybe").select("key")
        old = self.postings.join(maybe, "key", "left_semi").select("key", "doc_id")
        both = self._counted(old.unionAll(new.join(maybe, "key", "left_semi").select("key", "doc_id")).distinct())
        fresh = asked.where("NOT maybe").select("key", "n_docs", "first_doc")
        same = self.refs.join(maybe, "key", "left_anti").select("key", "n_docs", "first_doc")
        # Keys that a filter took for known though no document holds them are new as well.
        add = staged(fresh.select("key").unionAll(maybe.join(self.refs.select("key"), "key", "left_anti")), "fresh")
        self.refs = staged(fresh.unionAll(both).unionAll(same), "refs")
        self.postings = staged(self.postings.unionAll(new).distinct(), "postings")
        self.n_keys += add.count()
        self._fill(self.filters, add)

    def delete(self, doc_ids: DataFrame) -> None:
        """doc_ids: doc_id. Unknown ids change nothing."""
        ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id")).distinct()
        gone = self.postings.join(ids, "doc_id", "left_semi").select("key").distinct()
        left = staged(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "postings")
        again = self._counted(left.join(gone, "key", "left_semi"))
        refs = staged(self.refs.join(gone, "key", "left_anti").unionAll(again), "refs")
        lost = self._sharded(staged(self.refs.select("key").join(refs.select("key"), "key", "left_anti"), "lost"))
        self.filters = staged(self.filters.groupBy("shard").cogroup(lost.groupBy("shard")).applyInArrow(_without, "shard bigint, table binary"), "filters")
        self.postings, self.refs, self.n_keys = left, refs, refs.count()

    def apply(self, docs: DataFrame) -> DataFrame:
        """Every row of docs with n_lines, n_dropped, kept_sha256 and kept_text added.

        A line goes if at least two documents of the state hold its key and the smallest of them is not
        the row's. Null or empty text is one empty line. docs must have been inserted. Rows that repeat a doc_id are
        one document of all their lines, and each is returned; null ids, and the id 2^63-1, are one document
        after all others. An empty table gives an empty result.
        """
        many = self.refs.where("n_docs >= 2").select("key", "first_doc")
        drop = self.postings.join(many, "key").where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("drop")).withColumnRenamed("doc_id", "eff")
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        kind = docs.select(row).schema["row"].dataType.simpleString()
        # The row is packed after the join, so that its text is shuffled once.
        d = docs.select(row).withColumn("eff", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(LAST)))
        rows = d.join(drop, "eff", "left").select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), "drop", "row")
        return mapped(rows, _rewrite, f"doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string, row {kind}")


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs inserted in a fresh state in so many batches, by a hash of doc_id, and the state applied to all of them."""
    state = LineDedup(docs.sparkSession)
    for i in range(batches):
        state.insert(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(batches)) == i))
    return state.apply(docs)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that stay of every document; see LineDedup.apply for nulls, repeats, ties and empty tables."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
r AS (SELECT k, min(doc_id) AS first_doc FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > r.first_doc, false) AS gone FROM k LEFT JOIN r ON k.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
