"""Sets of character runs that share enough with an earlier set: all pairs, two tiles of texts at a time.

Every pair of tiles is one group of rows. In it a matrix product of run counts, folded into few columns, bounds what two sets share from
above; only pairs whose bound suffices are counted, exactly. The work grows with the square of the number of texts, memory with a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts and characters of a tile, at least so many tiles; columns of the product and rows of one step.
TILE, TILE_CHARS, TILES, COLUMNS, STEP = 16_384, 1 << 25, 12, 1024, 512


def run_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each text's runs begin (and the last ends), the distinct runs of n characters as numbers, and how many numbers there are."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    places = max(0, len(chars) - n + 1)
    used = np.zeros(0x110000, bool)
    used[chars] = True
    wide = max(1, int(used.sum()))
    chars = (np.cumsum(used) - 1)[chars]
    code, bound = chars[:places], wide
    for k in range(1, n):
        if bound > (1 << 62) // wide:  # so that no two runs get one number
            code, bound = np.unique(code, return_inverse=True)[1], places
        code, bound = code * wide + chars[k : places + k], bound * wide
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:places] == owner[n - 1 : n - 1 + places]
    runs, code = np.unique(code[inside], return_inverse=True)
    size = max(1, len(runs))
    key = np.unique(owner[:places][inside] * size + code)
    return np.searchsorted(key // size, np.arange(len(texts) + 1)), key % size, size


def _folded(at: np.ndarray, runs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many runs of each row fall into each column."""
    column = ((runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    out = np.zeros((len(rows), COLUMNS + 2), np.float32)
    for k in range(0, len(rows), STEP):
        part = rows[k : k + STEP]
        sizes = at[part + 1] - at[part]
        own = np.repeat(np.arange(len(part)), sizes)
        taken = np.concatenate([column[at[r] : at[r + 1]] for r in part]) if len(part) else column[:0]
        out[k : k + STEP, :COLUMNS] = np.bincount(own * COLUMNS + taken, minlength=len(part) * COLUMNS).reshape(-1, COLUMNS)
    return out


def later(texts: list[str], ranks: np.ndarray, side: np.ndarray, n: int, least: int, share: float) -> np.ndarray:
    """Places of the texts that share `share` of the union with an earlier one of the other side, or of the only side there is."""
    at, runs, size = run_sets(texts, n)
    sizes = np.diff(at)
    big = sizes >= least
    rows = np.flatnonzero(big & ~side)
    cols = np.flatnonzero(big & side) if side.any() else rows
    found, mark = np.zeros(len(texts), bool), np.zeros(size, bool)
    if not len(rows) or not len(cols):
        return np.flatnonzero(found)
    # a shares enough with b only if both >= part * (|a| + |b|); the last two columns subtract that.
    part = share / (1 + share)
    x, y = _folded(at, runs, rows), _folded(at, runs, cols)
    x[:, COLUMNS], x[:, COLUMNS + 1] = -part * sizes[rows], 1
    y[:, COLUMNS], y[:, COLUMNS + 1] = 1, -part * sizes[cols]
    slack = 1 + 1e-4 * float(sizes.max())
    for k in range(0, len(rows), STEP):
        i, j = np.divmod(np.flatnonzero(x[k : k + STEP] @ y.T >= -slack), len(cols))
        a, b = rows[k + i], cols[j]
        few, many = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        fits = (ranks[a] != ranks[b]) & (few >= share * many)
        a, b = a[fits], b[fits]
        late = np.where(ranks[a] > ranks[b], a, b)
        last = -1
        for p, q, z in zip(a.tolist(), b.tolist(), late.tolist(), strict=True):
            if found[z]:
                continue
            if p != last:
                if last >= 0:
                    mark[runs[at[last] : at[last + 1]]] = False
                mark[runs[at[p] : at[p + 1]]] = True
                last = p
            both = int(np.count_nonzero(mark[runs[at[q] : at[q + 1]]]))
            found[z] = both / (int(sizes[p] + sizes[q]) - both) >= share
        if last >= 0:
            mark[runs[at[last] : at[last + 1]]] = False
    return np.flatnonzero(found)


def with_earlier(texts: DataFrame, n: int, least: int, share: float) -> DataFrame:
    """id of the texts (id, rank, low) whose distinct runs of n characters share `share` of the union with those of an earlier rank; both need `least`."""
    g = texts.where(F.col("rank").isNotNull() & (F.length("low") >= least + n - 1))
    count, chars = g.agg(F.count("*"), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    m = max(TILES, math.ceil(count / TILE), math.ceil(chars / TILE_CHARS))
    each = g.withColumn("t", F.pmod(F.xxhash64("id", "rank"), F.lit(m)).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    each = each.select("id", "rank", "low", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), (F.col("t") > F.col("u")).alias("side"))
    kind = texts.select("id").schema

    def run(group: pa.Table) -> pa.Table:
        at = later(group["low"].to_pylist(), group["rank"].to_numpy(), group["side"].to_numpy(), n, least, share)
        return group.select(["id"]).take(pa.array(at))

    return each.repartition(min(m * (m + 1) // 2, 10_000), "a", "b").groupBy("a", "b").applyInArrow(run, kind).distinct()
