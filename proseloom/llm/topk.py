"""Operator 1: exact top-k inner-product search by tiled matrix products.

The corpus is dealt by a hash of the id into tiles and the queries into blocks, whose numbers follow the counted rows;
each (block, tile) pair is one row of a join on its own key, so pairs spread over the cluster and a task holds one tile
and one block. Few queries fill blocks of BLOCK, so the corpus moves once for each BLOCK queries.
A task multiplies the two matrices, keeps the k best of each row, and the per-tile lists are merged
in a tree of DataFrame aggregations with a fixed fan-in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, staged, table

#: Rows of a corpus tile and of a query block, and lists merged at once.
TILE, BLOCK, FAN_IN = 8192, 4096, 16
LIM = 2**63 - 1


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as double, saturated at 9e18.

    Rows take no part whose id is null or whose vector is null or holds a null or non-finite component.
    Of rows with equal ids the one with the smallest vector stands.
    """
    x = F.col(vec_col)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(9e18)), F.lit(-9e18))).cast("bigint"))
    return df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, saturated at the long range."""
    most = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most <= LIM:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -LIM, LIM).astype(np.int64)


def best(s: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
    """For each row of scores its k best columns, best first, ties to smaller ids; the query's own column is none of them.

    ids ascend, so a stable sort of the negated scores settles ties.
    """
    work, n = -s, s.shape[1]
    at = np.searchsorted(ids, own)
    mine = (at < n) & (ids[np.minimum(at, n - 1)] == own)
    # One more than k, as the own column, whatever its score, may be among them.
    edge = np.partition(work, min(k, n - 1), axis=1)[:, min(k, n - 1)] if n > 4 * k else np.full(len(s), LIM)
    picks = []
    for i in range(len(s)):
        cols = np.flatnonzero(work[i] <= edge[i])
        if mine[i]:
            cols = cols[cols != at[i]]
        picks.append(cols[np.argsort(work[i][cols], kind="stable")[:k]])
    return picks


def _tile_top(k: int):
    kind = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))

    def rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
        x = col.flatten()
        ids, v = x.field("id").to_numpy(), x.field("v").flatten().to_numpy()
        order = np.argsort(ids)
        return ids[order], v.reshape(len(ids), dim)[order] if dim else np.zeros((len(ids), 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, tile = b.column("dim")[r].as_py(), b.column("tile")[r].as_py()
                qid, q = rows(b.column("qs").slice(r, 1), dim)
                cid, c = rows(b.column("cs").slice(r, 1), dim)
                for at in range(0, len(qid), 256):
                    own = qid[at : at + 256]
                    s = products(q[at : at + 256], c)
                    picks = best(s, cid, k, own)
                    flat = np.concatenate(picks) if picks else np.zeros(0, np.int64)
                    each = np.array([len(x) for x in picks], np.int64)
                    neg, ids = -s[np.repeat(np.arange(len(picks)), each), flat], cid[flat]
                    tops = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.StructArray.from_arrays([pa.array(neg), pa.array(ids)], ["neg", "id"]))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), tile), pa.int64()), tops.cast(kind)], names=["query_id", "tile", "top"])

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query, ties to smaller ids.

    vectors: any columns beside id and vector are ignored. is_query: a condition on column `id`. A query's
    own id is no candidate; with fewer than k candidates all are returned, with none the query has no row.
    Vectors of different lengths are not compared. Null ids and null, partly null or non-finite vectors take
    no part; rows repeating an id count once (smallest vector). An empty table gives an empty result.
    """
    v = staged(quantised(vectors, id_col, vec_col, scale).withColumn("dim", F.size("v")), "vectors")
    n, asked = v.agg(F.count("*"), F.count_if(is_query)).first()
    tiles, blocks = max(1, math.ceil(n / tile)), max(1, math.ceil(asked / block))
    packed = lambda d, key, num, name: d.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(num)).alias(key)).agg(F.collect_list(F.struct("id", "v")).alias(name))
    cs = packed(v, "tile", tiles, "cs").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    qs = packed(v.where(is_query), "block", blocks, "qs").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))))
    top = mapped(cs.join(qs, ["dim", "block", "tile"]).select("dim", "tile", "qs", "cs"), _tile_top(k), "query_id bigint, tile bigint, top array<struct<neg:bigint,id:bigint>>")
    while True:
        tiles = math.ceil(tiles / FAN_IN)
        top = top.groupBy("query_id", F.floor(F.col("tile") / FAN_IN).alias("tile")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if tiles == 1:
            break
    return top.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 20
"""
