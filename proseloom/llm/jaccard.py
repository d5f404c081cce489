"""Operator 8: n-gram Jaccard join by prefix trees, and its connected components.

Routing. Two sets with Jaccard similarity t differ in at most (1-t)/(1+t) of their summed sizes. Hash space is
cut into one range more than that bound; linked sets then agree on all hashes of some range. Sets are
filed under the signatures of their ranges (twice: in their own size class and the next smaller one), and sets
that share a signature form coarse groups. A task keeps one row for a signature it meets often, so a
signature that half of all documents share sends one row a task.

Splitting. Passages that many documents share chain unlike sets into one coarse group. The sets of a group of more than
TILE are put in one order of shingles, rarest first; linked sets share one of the first n - ceil(t n) + 1 shingles of each, so the group
falls apart into the components of sets that share one of those. Holders of a shingle are counted in targets of
bounded size; shingles that a large part of a batch holds stay out of them and stand last in the order.

Joining. Each coarse group comes together once, with one set for each class of equal sets. Its sets are put
in one global order (most frequent shingles first) and stored as a trie, held as the sorted sequences and their common
prefix lengths. The rarest shingles, of which linked sets share one, lead a query to the subtrees that it walks; it keeps
the partial overlap of the prefix that neighbours share, and leaves a subtree as soon as the overlap so far and
the remaining lengths cannot reach the threshold, or when all that is left in it is already in the query's component. Groups of more than TILE sets are cut into tiles, and every
pair of tiles is a task. What comes out is a spanning forest of links, so components only: sets already in a query's component are not compared,
pairs within a component are not listed, links are not counted, and no link that would join two components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, lean, mapped, merged, mix, shingle_sets, staged, table, unstaged
from .components import UnionFind, connected_components

#: Sets that one task joins with as many others, in groups too large for one task.
TILE = 2048
#: Documents to a target of signatures, about: a task holds and sorts one target at a time. An edge may be found in as
#: many targets as its sets share signatures.
PART = 8192
#: Bytes of a signature that travel, besides its target. Signatures that agree in them by chance are candidates, no more.
KEPT = 6
#: Texts whose shingles a worker makes at once.
ROWS = 512
#: Shingles of the sets of large groups to a target in which their holders are counted, about.
COUNTED = 1 << 20
#: Shingles that stand last in the order uncounted, at most; they reach the driver and every task (8 bytes each). Which they are
#: changes the candidates and no result.
FREQUENT = 1 << 16


def size_class(n: int, num: int, den: int) -> int:
    """Classes such that linked sets are of the same or of adjacent classes."""
    return int(math.log(n) / math.log(den / num) + 1e-9)


def ranges(cls: int, num: int, den: int) -> int:
    """Ranges for sets of class cls and cls + 1: one more than the hashes in which linked ones may differ; for small sets
    twice that, so that few of them leave so many ranges empty that nothing but emptiness may agree."""
    top = (den / num) ** (cls + 2)
    k = int(2 * top * (den - num) / (den + num) + 1e-6) + 1
    return 2 * k if k <= 16 else k


@lru_cache(16)
def small(num: int, den: int) -> tuple[int, int]:
    """The largest set that differs from any linked one, no smaller than itself, in at most one hash; and the largest such partner."""
    n = 1
    while (n + 1 + (n + 1) * den // num) * (den - num) < 2 * (den + num):
        n += 1
    return n, n * den // num


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of an ascending set of hashes, for both groups of classes in which it may meet others.

    Small sets file themselves and themselves less each of their hashes: of two that differ in one hash, one is the other
    less a hash. Other sets file their non-empty ranges. If those are more than the hashes in which any partner can differ, one
    of them is the partner's too; a set with too many empty ranges also files one signature for those.
    """
    out, n, grow = [], len(s), den / num
    alone, both = small(num, den)
    with np.errstate(over="ignore"):
        if n <= both:
            x = mix(s)
            out.append(mix(np.concatenate([[x.sum(dtype=np.uint64)], x.sum(dtype=np.uint64) - x])))
        if n <= alone:
            return out[0]
        cls = size_class(n, num, den)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
        for c, partner in ((cls - 1, min(n, grow**cls)), (cls, n * grow)):
            if c < 0:
                continue
            k = ranges(c, num, den)
            at = np.concatenate([[0], np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * np.uint64((2**64 - 1) // k)), [n]])
            full = np.flatnonzero(at[1:] > at[:-1])
            tag = mix(np.arange(k + 1, dtype=np.uint64) + np.uint64(c + 1) * np.uint64(1 << 32))
            out.append(mix(total[at[full + 1]] - total[at[full]] + tag[full]))
            if len(full) <= int((n + partner) * (den - num) / (den + num) + 1e-6):
                out.append(tag[k:])
    return np.concatenate(out)


def _each_set(b: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The shingle sets of a batch's texts in order, made for ROWS texts at a time."""
    for at in range(0, b.num_rows, ROWS):
        yield from shingle_sets(b.column("text").slice(at, ROWS), n)


def _route(n: int, num: int, den: int, parts: int):
    """Of a batch: each row's shingle count and digest, the signatures packed by target, and edges found here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # sets that this task has filed: equal ones are a class, which files once
        for b in batches:
            sizes, digests, sig, who, new = [], [], [], [], []
            ids = b.column("doc_id").to_pylist()
            for i, s in zip(ids, _each_set(b, n), strict=True):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                sizes.append(len(s))
                digests.append(d)
                if i is not None and d is not None and d not in seen:
                    seen.add(d)
                    new.append(s)
                    x = signatures(s, num, den)
                    sig.append(x)
                    who.append(np.full(len(x), i, np.int64))
            yield _row(b.num_rows, doc_id=pa.array(ids, pa.int64()), n_shingles=pa.array(sizes, pa.int64()), digest=pa.array(digests, pa.binary()))
            if not sig:
                continue
            often = _frequent(new)
            yield _row(len(often), token=pa.array(often.view(np.int64)))
            sig, who, edges = _stars(np.concatenate(sig), np.concatenate(who))
            yield _row(len(edges), a=pa.array(edges[:, 0]), b=pa.array(edges[:, 1]))
            yield _dealt(sig, who, parts)

    return run


SCHEMA = "doc_id bigint, n_shingles bigint, digest binary, a bigint, b bigint, part bigint, data binary, token bigint, spare bigint"
_TYPES = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "a": pa.int64(), "b": pa.int64(), "part": pa.int64(), "data": pa.binary(), "token": pa.int64(), "spare": pa.int64()}


def _row(n: int, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n, t)) for c, t in _TYPES.items()], names=list(_TYPES))


def _dealt(sig: np.ndarray, who: np.ndarray, parts: int, **cols: int) -> pa.RecordBatch:
    """Signatures and their holders, a row for each target, which also gets cols."""
    to = (sig % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((who, to))
    full, cut = np.unique(to[order], return_index=True)
    blobs = [_packed(sig[o], who[o]) for o in np.split(order, cut[1:])] if len(full) else []
    return _row(len(full), part=pa.array(full), data=pa.array(blobs, pa.binary()), **{c: pa.array(np.full(len(full), v, np.int64)) for c, v in cols.items()})


def _frequent(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles that at least 8 of the sets and a sixteenth of them hold."""
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    return tokens[n >= max(8, len(sets) / 16)]


def _stars(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a signature, with its smallest holder, and edges from the other holders to that one."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    head = who[new][np.cumsum(new) - 1]
    edges = np.unique(np.stack([who[who != head], head[who != head]], axis=1), axis=0)
    return sig[new], who[new], edges


def _forest(e: np.ndarray) -> np.ndarray:
    """Those of the edges that join what was apart."""
    sets = UnionFind()
    return e[[sets.join(a, b) for a, b in e.tolist()]] if len(e) else e


def _packed(sig: np.ndarray, who: np.ndarray) -> bytes:
    """Signatures and their holders, compressed; holders come in the order of the rows, so their differences are small."""
    low = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :]
    step = np.diff(who, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(1).compress(low.T.tobytes() + step.T.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(KEPT + 8, -1)
    sig = np.zeros((x.shape[1], 8), np.uint8)
    sig[:, 8 - KEPT :] = x[:KEPT].T
    return sig.view("<u8").ravel().astype(np.uint64), np.cumsum(np.ascontiguousarray(x[KEPT:].T).view("<i8").ravel())


def _together(df: DataFrame) -> DataFrame:
    """The rows of each target side by side."""
    return df.repartition("part").sortWithinPartitions("part")


def _by_part(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of one target after the other, of which one is held."""
    at, rows = None, []
    for b in batches:
        cols = [b.column(c) for c in names]
        for i, here in enumerate(b.column("part").to_pylist()):
            if here != at and rows:
                yield rows
                rows = []
            at = here
            rows.append(tuple(c[i].as_py() for c in cols))
    if rows:
        yield rows


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures and holders of one target after the other."""
    for rows in _by_part(batches, ("data",)):
        yield tuple(np.concatenate(x) for x in zip(*(_unpacked(x) for (x,) in rows), strict=True))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each target a forest of edges between holders of equal signatures: those that join what was apart."""
    for sig, who in _targets(batches):
        e = _forest(_stars(sig, who)[2])
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def _leading(words: int, num: int, den: int, parts: int, frequent: np.ndarray):
    """Of sets of large groups (doc_id, grp, many, text): shingles, named apart by group and packed by target; `spare`, which plus the
    number of shingles with several holders says how many of those lead; and frequent shingles that lead, as few others come before them. All shingles of an id of many rows lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sig, who, spare, late, of = b.column("doc_id").to_numpy(), [], [], [], [], []
            for i, g, many, s in zip(ids.tolist(), b.column("grp").to_numpy().astype(np.uint64), b.column("many").to_pylist(), _each_set(b, words), strict=True):
                often = np.zeros(len(s), bool)
                if len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                with np.errstate(over="ignore"):
                    x = mix(s ^ mix(np.array([g]) + np.uint64(1)))
                sig.append(x[~often])
                who.append(np.full(len(sig[-1]), i, np.int64))
                spare.append(1 << 40 if many else len(s) - (len(s) * num + den - 1) // den + 1 - len(sig[-1]))
                if spare[-1] > 0:
                    late.append(np.sort(x[often])[: spare[-1]])
                    of.append(np.full(len(late[-1]), i, np.int64))
            yield _row(len(ids), part=pa.array(_home(ids, parts)), doc_id=pa.array(ids), spare=pa.array(spare, pa.int64()))
            if late:
                yield from _holders(np.concatenate(late), np.concatenate(of), parts)
            if sig:
                yield _dealt(np.concatenate(sig), np.concatenate(who), parts)

    return run


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    """The targets in which documents rank their shingles."""
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _holders(sig: np.ndarray, who: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Of leading shingles one holder of each, dealt by shingle (token 1), and a forest of edges from the other holders."""
    if not len(sig):
        return
    with np.errstate(over="ignore"):
        sig, who, e = _stars(mix(sig), who)  # anew, as of packed ones the low bytes, which deal them, are gone
    e = _forest(e)
    yield _row(len(e), a=pa.array(e[:, 0]), b=pa.array(e[:, 1]))
    yield _dealt(sig, who, parts, token=1)


def _shared(parts: int):
    """Of each target the shingles with several holders, packed by the targets in which the holders rank them; counts are packed alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, who in _targets(batches):
            _, at, n = np.unique(sig, return_inverse=True, return_counts=True)
            n = n[at]
            full = n > 1
            sig, who, n = sig[full], who[full], n[full]
            to = _home(who, parts)
            order = np.lexsort((who, to))
            homes, cut = np.unique(to[order], return_index=True)
            groups = np.split(order, cut[1:]) if len(homes) else []
            data, counts = [_packed(sig[o], who[o]) for o in groups], [zstandard.ZstdCompressor(1).compress(n[o].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for o in groups]
            yield _row(len(homes), part=pa.array(homes), data=pa.array(data, pa.binary()), digest=pa.array(counts, pa.binary()))

    return run


def _ranked(parts: int):
    """Of each target, in which its documents' shared shingles and spares meet, the shingles that lead, as _holders gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ("data", "digest", "doc_id", "spare")):
            blobs = [(_unpacked(x), np.frombuffer(zstandard.ZstdDecompressor().decompress(y), np.uint8).reshape(4, -1)) for x, y, _, _ in rows if x is not None]
            if not blobs:
                continue
            sig, who = (np.concatenate(x) for x in zip(*(x for x, _ in blobs), strict=True))
            n = np.concatenate([np.ascontiguousarray(y.T).view("<u4").ravel() for _, y in blobs])
            docs, first = np.unique(np.array([i for _, _, i, _ in rows if i is not None], np.int64), return_index=True)
            spare = np.array([x for _, _, i, x in rows if i is not None], np.int64)[first]
            order = np.lexsort((sig, n, who))
            sig, who = sig[order], who[order]
            _, start, at, c = np.unique(who, return_index=True, return_inverse=True, return_counts=True)
            lead = np.arange(len(who)) - start[at] < spare[np.searchsorted(docs, who)] + c[at]
            yield from _holders(sig[lead], who[lead], parts)

    return run


def _split(big: DataFrame, routed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, component): big (doc_id, grp, many, text, n_shingles) dealt anew so that linked sets of a grp stay together; sets that cannot link are left out."""
    parts = max(8, math.ceil((big.agg(F.sum("n_shingles")).first()[0] or 0) / COUNTED))
    found = routed.where("token IS NOT NULL").groupBy("token").count().orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").collect()
    frequent = np.sort(np.array([r.token for r in found], np.int64).view(np.uint64))
    led = staged(mapped(big.select("doc_id", "grp", "many", "text"), _leading(words, num, den, parts, frequent), SCHEMA), "leading")
    shared = mapped(_together(led.where("data IS NOT NULL AND token IS NULL").select("part", "data")), _shared(parts), SCHEMA)
    ranks = shared.unionAll(led.where("spare IS NOT NULL")).select("part", "data", "digest", "doc_id", "spare")
    held = staged(mapped(_together(ranks), _ranked(parts), SCHEMA).unionAll(led.where("token IS NOT NULL OR a IS NOT NULL")).select("part", "data", "a", "b"), "held")
    unstaged(led)
    met = mapped(_together(held.where("data IS NOT NULL").select("part", "data")), _meet, "a bigint, b bigint")
    return connected_components(met.unionAll(held.where("a IS NOT NULL").select("a", "b")))


def trie_join(sets: list[np.ndarray], num: int, den: int, split: int = 0) -> list[tuple[int, int]]:
    """(i, j): links between sets, so many that they connect all that linked sets connect.

    Sets i and j link when den * intersection >= num * union. With split, only links between the first split sets and
    the others are looked for, besides those that they need not.
    """
    m = len(sets)
    if m < 2:
        return []
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    cuts = np.cumsum([0, *map(len, sets)])
    seqs = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    order = sorted(range(m), key=lambda i: seqs[i].astype(">u4").tobytes())
    seqs = [seqs[i] for i in order]
    lcp = np.zeros(m, np.int64)
    for i in range(1, m):
        a, b = seqs[i - 1], seqs[i]
        k = min(len(a), len(b))
        d = np.flatnonzero(a[:k] != b[:k])
        lcp[i] = d[0] if len(d) else k
    sizes = np.array([len(x) for x in seqs])
    # A set that links shares one of the rarest tokens, so many that it cannot lack them all: they lead to its subtrees.
    rarest = [x[(len(x) * num + den - 1) // den - 1 :] for x in seqs]
    leaf = np.repeat(np.arange(m), [len(x) for x in rarest])
    token = np.concatenate(rarest)
    leaf, token = leaf[by := np.argsort(token, kind="stable")], token[by]
    at = np.searchsorted(token, np.arange(len(tokens) + 1)).tolist()
    side = np.array([i >= split for i in order]) if split else None
    comp, links = np.arange(m), []
    mark = np.zeros(len(tokens), np.int64)
    path = np.zeros(sizes.max() + 1, np.int64)
    near = np.zeros(m, bool)
    for q in range(1, m):
        nq, seq_q = int(sizes[q]), seqs[q]
        near[:] = False
        for t in rarest[q].tolist():
            near[leaf[at[t] : at[t + 1]]] = True
        near[q:] = False
        near &= (comp != comp[q]) & (sizes * den >= num * nq) & (nq * den >= num * sizes)
        if side is not None:
            near &= side != side[q]
        found = np.flatnonzero(near)
        if not len(found):
            continue
        shared = [0, *(np.minimum.reduceat(lcp[: found[-1] + 1], found[:-1] + 1).tolist() if len(found) > 1 else [])]
        mark[seq_q] = 1
        # A set links only with misses (tokens that the query lacks) up to this bound, which ends subtrees.
        bound = nq * (den - num) // num
        valid, dead = 0, -1
        for i, common in zip(found.tolist(), shared, strict=True):
            valid = min(valid, common)
            if dead >= 0:
                if common > dead:
                    continue
                dead = -1
            if comp[i] == comp[q]:
                continue
            # path[d]: hits among the first d tokens; neighbours share the first `valid` of them.
            n = int(sizes[i])
            path[valid + 1 : n + 1] = path[valid] + np.cumsum(mark[seqs[i][valid:]])
            was, valid = valid, n
            hits = int(path[n])
            if hits * (den + num) >= num * (n + nq):
                comp[comp == comp[i]] = comp[q]
                links.append((order[i], order[q]))
            elif n - hits > bound:
                # The depth at which too much has been missed: no longer set below it has length enough left.
                d = np.searchsorted(np.arange(was + 1, n + 1) - path[was + 1 : n + 1], bound + 1)
                dead = was + int(d)
        mark[seq_q] = 0
    return links


def _join_groups(words: int, num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        lean()
        t = t.sort_by([("grp", "ascending"), ("x", "ascending"), ("y", "ascending"), ("left", "descending"), ("doc_id", "ascending")])
        ids, left = t.column("doc_id").to_numpy(), t.column("left").to_numpy().astype(bool)
        keys = np.stack([t.column(c).to_numpy() for c in ("grp", "x", "y")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            both = not left[a:b].all()
            if both and not left[a:b].any():
                continue
            sets = [s for at in range(a, b, ROWS) for s in shingle_sets(t.column("text").slice(at, min(ROWS, b - at)).combine_chunks(), words)]
            out += [(int(ids[a + i]), int(ids[a + j])) for i, j in trie_join(sets, num, den, int(left[a:b].sum()) if both else 0)]
        return pa.table({"a": pa.array([i for i, _ in out], pa.int64()), "b": pa.array([j for _, j in out], pa.int64())})

    return run


def similar_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are ignored).

    A document's set is its distinct word shingles (A-Z lower-cased, split at ASCII white space; with fewer words the
    whole sequence is one). Documents link when den * intersection >= num * union. component_id is the smallest
    doc_id reachable by links. Null and empty texts have no shingles and are linked with nothing; a null doc_id has
    a null component and links nothing; rows that repeat a doc_id are one node. Shingles count as equal when
    their 64-bit hashes are. No partner or candidate is capped.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounded(docs.sparkSession)
    parts = max(8, math.ceil(d.select("doc_id").count() / PART))
    routed = staged(mapped(d, _route(words, num, den, parts), SCHEMA), "routed")
    rows = staged(routed.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "digest"), "sizes")
    met = mapped(_together(routed.where("part IS NOT NULL").select("part", "data")), _meet, "a bigint, b bigint")
    coarse = staged(connected_components(met.unionAll(routed.where("a IS NOT NULL").select("a", "b"))), "coarse")
    # Equal sets are a class, which its smallest doc_id stands for.
    classes = staged(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    same = merged(rows, classes.where("copies > 1"), "digest").where("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    grouped = staged(merged(merged(coarse.withColumnRenamed("node", "doc_id"), rows, "doc_id"), classes, "digest").groupBy("rep").agg(F.min("component").alias("grp"), F.max("n_shingles").alias("n_shingles")), "grouped")
    groups = grouped.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    many = rows.groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1")
    members = merged(merged(grouped, groups, "grp").withColumnRenamed("rep", "doc_id"), many, "doc_id", "left").withColumn("many", F.col("many").isNotNull())
    # All texts are shuffled once; those of groups are kept by them until the groups are joined.
    texts = staged(merged(members, d, "doc_id").select("doc_id", "grp", "size", "n_shingles", "many", "text"), "texts")
    large = texts.where(F.col("size") > TILE)
    dealt = texts.where(F.col("size") <= TILE).select("doc_id", "grp", "size", "text")
    if not large.isEmpty():
        parted = staged(_split(large, routed, words, num, den), "parted")
        sizes = parted.groupBy("component").agg(F.count("*").alias("size"))
        anew = staged(merged(parted, sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"), "size"), "members")
        dealt = dealt.unionAll(merged(anew, large.select("doc_id", "text"), "doc_id").select("doc_id", "grp", "size", "text"))
    unstaged(routed)
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("doc_id"), tiles).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    # Texts travel, not their hashes, which are longer and do not compress.
    dealt = dealt.select("doc_id", "grp", "text", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), (F.col("t") <= F.col("o")).cast("int").alias("left"))
    buckets = max(parts, math.ceil(texts.count() / 1024))
    links = dealt.groupBy(F.pmod(F.xxhash64("grp", "x", "y"), F.lit(buckets)).alias("bucket")).applyInArrow(_join_groups(words, num, den), "a bigint, b bigint")
    final = connected_components(links.unionAll(same))
    unstaged(texts)
    return merged(rows, final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)
