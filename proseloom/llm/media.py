"""Operator 3: media columns stored as content-defined chunks.

A text's payload is kept as a mono 8-bit PCM WAV file. The file is cut where a rolling gear hash of the last 32
bytes has its top bits clear, chunks are known by a 128-bit digest, and Spark joins find which digests
more than one chunk has. Such a chunk is stored once, with the file that owns it, and lent to the others. Every
file keeps its ordered list of digests, by which it is put together again and verified.

Files move in compressed packs, one for each task and target, and equal files of a task only once. A file whose
chunks are all its own is put together where it is read; only lent chunks and their borrowers meet in a join.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mix, staged, table

#: Payloads are padded with spaces to a multiple of UNIT bytes; samples a second of the WAV file.
UNIT, RATE = 192, 8000
#: Chunk sizes in bytes: least, on average (a power of two) and most; files to a pack target, about.
LEAST, MEAN, MOST, PACK = 256, 1024, 8192, 2048
#: Bytes of payloads that a task gathers before it packs them; payloads that it remembers having listed.
GATHERED, LISTED = 20 << 20, 1_000_000
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(32)).astype(np.uint32)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str) -> bytes:
    """The text in UTF-8 and spaces up to a positive multiple of UNIT bytes."""
    data = text.encode()
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def wav(payload: bytes) -> bytes:
    """payload as the samples of an 8-bit mono PCM file."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file; ValueError if it is not one."""
    riff, size, wave, fmt, _, pcm, channels, _, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, data, pcm, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not a mono 8-bit PCM file")
    return media[44:]


def feature(payload: bytes) -> str:
    """Sample count, extremes, sum, crossings of the middle level and the four quarter-range counts."""
    x = np.frombuffer(payload, np.uint8)
    up = x >= 128
    return f"n={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};cross={int((up[1:] != up[:-1]).sum())};hist=" + ",".join(map(str, np.bincount(x >> 6, minlength=4)[:4]))


def cuts(media: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the content-defined chunks of a file, in order; the last is its length."""
    n = len(media)
    h = GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the hash of the last 32 bytes by doubling: h(2k) = h(k) + (h(k), k bytes before) << k
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if n > k else h[k:]
    marks = (np.flatnonzero(h < np.uint32(2**32 // mean)) + 1).tolist()
    out, start, i = [], 0, 0
    while n - start > least:
        while i < len(marks) and marks[i] < start + least:
            i += 1
        end = min(marks[i] if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    if start < n or not out:
        out.append(n)
    return out


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk of a file, in order."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(hashlib.blake2b(p, digest_size=16).digest(), p) for p in parts]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its payload's digest; of each payload that the task has not listed yet the digests of its chunks."""
    seen: set[bytes] = set()
    for b in batches:
        shas, sizes, lists = [], [], []
        if len(seen) > LISTED:
            seen.clear()
        for text in b.column("text").to_pylist():
            p = payload_of(text)
            sha = hashlib.sha256(p).digest()
            shas.append(sha)
            sizes.append(len(text.encode()))
            lists.append(None if sha in seen else [d for d, _ in chunks(wav(p))])
            seen.add(sha)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "sha", "digests"])


def _target(sha: bytes, targets: int) -> int:
    return int.from_bytes(sha[:6], "big") % targets


def _packs(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(target, pack): the distinct payloads of GATHERED bytes by target, compressed together."""
        own: dict[int, dict[bytes, bytes]] = {}
        size = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                p = payload_of(text)
                sha = hashlib.sha256(p).digest()
                to = own.setdefault(_target(sha, targets), {})
                size += 0 if sha in to else len(p)
                to[sha] = p
                if size >= GATHERED:
                    yield _packed(own)
                    own, size = {}, 0
        if own:
            yield _packed(own)

    return run


def _packed(own: dict[int, dict[bytes, bytes]]) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(9)
    packs = [z.compress(b"".join(struct.pack("<I", len(p)) + p for p in x.values())) for x in own.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(packs, pa.binary())], names=["target", "pack"])


def _opened(pack: bytes) -> Iterator[bytes]:
    data, at = zstandard.ZstdDecompressor().decompress(pack), 0
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


STORE = "sha binary, digests array<binary>, lengths array<int>, owned array<boolean>, lent array<boolean>, data binary"
_STORE = pa.schema([("sha", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("owned", pa.list_(pa.bool_())), ("lent", pa.list_(pa.bool_())), ("data", pa.binary())])


def _store(packs: pa.Table, shared: pa.Table) -> pa.Table:
    """Rows of the chunk store: the bytes of the chunks that a file owns, and its list of all chunks."""
    role = {(p[:16], int.from_bytes(p[16:], "big")): own for p, own in zip(shared.column("place").to_pylist(), shared.column("own").to_pylist(), strict=True)}
    rows, seen = [], set()
    for pack in packs.column("pack").to_pylist():
        for p in _opened(pack):
            sha = hashlib.sha256(p).digest()
            if sha in seen:
                continue
            seen.add(sha)
            parts = chunks(wav(p))
            own = [role.get((sha[:16], i), True) for i in range(len(parts))]
            rows.append((sha, [d for d, _ in parts], [len(c) for _, c in parts], own, [(sha[:16], i) in role and o for i, o in enumerate(own)], b"".join(c for (_, c), o in zip(parts, own, strict=True) if o)))
    cols = list(zip(*rows, strict=True)) or [()] * len(_STORE)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _STORE, strict=True)], schema=_STORE)


def _pieces(row: dict) -> list[bytes | None]:
    out, at = [], 0
    for n, own in zip(row["lengths"], row["owned"], strict=True):
        out.append(row["data"][at : at + n] if own else None)
        at += n if own else 0
    return out


READ = "sha binary, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _verified(sha: bytes, parts: list[bytes], digests: list[bytes]) -> tuple:
    """A file put together from its chunks; ValueError if a chunk or the payload is not what the lists say."""
    if any(hashlib.blake2b(p, digest_size=16).digest() != d for p, d in zip(parts, digests, strict=True)):
        raise ValueError("a chunk differs from its digest")
    media = b"".join(parts)
    p = samples(media)
    if hashlib.sha256(p).digest() != sha:
        raise ValueError("a payload differs from its digest")
    return sha, len(p), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)


_READ = pa.schema([("sha", pa.binary()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(_READ), _READ, strict=True)], schema=_READ)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _table([_verified(r["sha"], _pieces(r), r["digests"]) for r in b.to_pylist()]).to_batches()


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(d, p) for r in b.to_pylist() for d, p, lent in zip(r["digests"], _pieces(r), r["lent"], strict=True) if lent]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([p for _, p in out], pa.binary())], names=["digest", "bytes"])


def _joined(rows: pa.Table, borrowed: pa.Table) -> pa.Table:
    got: dict[bytes, dict[bytes, bytes]] = {}
    for s, d, p in zip(*(borrowed.column(c).to_pylist() for c in ("borrower", "digest", "bytes")), strict=True):
        got.setdefault(s, {})[d] = p
    return _table([_verified(r["sha"], [got[r["sha"]][d] if p is None else p for d, p in zip(r["digests"], _pieces(r), strict=True)], r["digests"]) for r in rows.to_pylist()])


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, store) of docs (doc_id, text): rows has doc_id, n_bytes and the payload's digest `sha` of every
    row; store, staged in the shared folder, has one row for each distinct payload with its chunk lists and
    the bytes of the chunks it owns. Null text is empty; other columns are ignored."""
    d = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    index = staged(mapped(d, _index, f"doc_id {kind}, n_bytes bigint, sha binary, digests array<binary>"), "index")
    targets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(index.count() / PACK))
    # Chunks whose digest another chunk has: the one of the smallest payload digest owns the bytes.
    # Here 128 bits of a payload's digest with 32 of the chunk's place name a chunk.
    place = F.concat(F.substring("sha", 1, 16), F.unhex(F.lpad(F.hex("seq"), 8, "0"))).alias("place")
    seqs = index.where("digests IS NOT NULL").select("sha", F.posexplode("digests").alias("seq", "digest")).select("digest", place)
    many = seqs.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("digest", "first")
    shared = seqs.join(many, "digest").select("place", (F.col("place") == F.col("first")).alias("own")).distinct()
    target = F.pmod(F.conv(F.substring(F.hex("place"), 1, 12), 16, 10).cast("bigint"), F.lit(targets))
    packs = mapped(d.select("text"), _packs(targets), "target bigint, pack binary")
    store = packs.groupBy("target").cogroup(shared.withColumn("target", target).groupBy("target")).applyInArrow(_store, STORE)
    return index.select("doc_id", "n_bytes", "sha"), staged(store, "chunks")


def read_media(store: DataFrame) -> DataFrame:
    """sha, payload_bytes, tail_crc32, media_bytes, media_sha256, feature of every file of a store, verified."""
    whole = mapped(store.where(F.forall("owned", lambda x: x)), _whole, READ)
    part = store.where(F.exists("owned", lambda x: ~x))
    lent = mapped(store.where(F.exists("lent", lambda x: x)), _lent, "digest binary, bytes binary")
    need = part.select("sha", F.explode(F.expr("filter(digests, (x, i) -> NOT owned[i])")).alias("digest")).distinct()
    buckets = F.lit(max(1, math.ceil(part.count() / 512)))
    borrowed = need.join(lent, "digest").select(F.pmod(F.xxhash64("sha"), buckets).alias("bucket2"), F.col("sha").alias("borrower"), "digest", "bytes")
    joined = part.withColumn("bucket", F.pmod(F.xxhash64("sha"), buckets)).groupBy("bucket").cogroup(borrowed.groupBy("bucket2")).applyInArrow(_joined, READ)
    return whole.unionAll(joined)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, store = store_media(table(spark, sf_dir, "documents"))
    return rows.join(read_media(store), "sha").select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("sha")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
