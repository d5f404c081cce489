"""Connected components by large-star and small-star rounds of DataFrame joins.

Every round is staged in the shared folder. A node's neighbours are never gathered in one row. The large star joins
the edges with the smaller neighbour of their lower end, dealt by that end and a salt whose number follows the
largest hub, which is counted; partitions are contracted before the small star, so a node has few edges
left when they come together. Only three numbers a round reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, merged, staged, unstaged


#: Edges that a worker contracts at once.
CHUNK = 1 << 16


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a stretch of CHUNK rows as stars around the smallest node, so memory is bounded."""
    held, kinds = [], None
    for b in batches:
        kinds = kinds or [f.type for f in b.schema]
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield _contracted(held, kinds)
            held = []
    if held:
        yield _contracted(held, kinds)


def _contracted(held: list[pa.RecordBatch], kinds: list) -> pa.RecordBatch:
    sets, loops = UnionFind(), set()
    for b in held:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(x, y)
            if x == y:
                loops.add(x)
    pairs = [(x, r) for x in list(sets.up) if (r := sets.find(x)) != x] + [(x, x) for x in loops]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kinds[0]), pa.array([r for _, r in pairs], kinds[1])], names=["a", "b"])


def _stars(e: DataFrame, salts: int, kind: str) -> DataFrame:
    """One large-star and one small-star round over edges a > b; a hub's edges are dealt over `salts` tasks."""
    low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    big = merged(e.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")), low, ["b", "s"], "left").select("a", F.coalesce("m", "b").alias("b"))
    # Partitions by a serve the distinct rows and the window alike, so this is one shuffle.
    few = mapped(big, _contract, f"a {kind}, b {kind}").repartition("a").dropDuplicates(["a", "b"]).withColumn("m", F.min("b").over(Window.partitionBy("a")))
    ends = F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return few.select(ends.alias("e")).select("e.a", "e.b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    Nulls: an edge with a null end links nothing. Loops and repeated edges change nothing; without
    edges the result is empty. Nodes may be of any one type that sorts.
    """
    kind = edges.schema[a].dataType.simpleString()
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    given = staged(mapped(e, _contract, f"a {kind}, b {kind}"), "edges")  # loops stay in it: they name nodes
    e, before = given.where("a > b"), None
    wide = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        hubs = e.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        after = tuple(hubs.agg(F.sum("n"), F.sum("h"), F.max("n")).first())
        if not after[0] or after == before:
            break
        # A hub may have as many edges as two tasks have on average before it is split.
        salts = max(1, min(wide, after[2] * wide // (2 * after[0])))
        old, before = e, after
        e = staged(_stars(e, salts, kind), "edges")
        if hasattr(old, "staged_path"):
            unstaged(old)
    found = e.groupBy("a").agg(F.min("b").alias("b"))
    roots = e.select(F.col("b").alias("a"), "b")
    return found.unionAll(roots).unionAll(given.where("a = b").select("a", "b")).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
