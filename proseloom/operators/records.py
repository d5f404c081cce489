"""Records of sessions: dedupe, resend suppression, counts, intervals and as-of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.tells import words
from ..functions.text import EDGE, UNIT


def first_copies(records: DataFrame, ident: list[str], order: list[str]) -> DataFrame:
    """The first record of each identity in file order; others go whatever any later filter says."""
    w = Window.partitionBy(*ident).orderBy(*order)
    return records.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def without_resends(records: DataFrame, session: str, text: str, seconds: str, order: list[str], within: int = 3600) -> DataFrame:
    """A record goes if the same text in the same session came at most `within` seconds away just before it, kept or not."""
    w = Window.partitionBy(session, text).orderBy(*order)
    gap = F.abs(F.col(seconds) - F.lag(seconds).over(w))
    return records.withColumn("gap", gap).where("gap IS NULL OR gap > " + str(within)).drop("gap")


def kind_counts(records: DataFrame, kind: str, text: str) -> DataFrame:
    """kind, records, words."""
    return records.groupBy(kind).agg(F.count("*").alias("records"), F.sum(words(F.col(text))).cast("bigint").alias("words"))


def intervals(inputs: DataFrame, session: str, at: str) -> DataFrame:
    """inputs with stop, the earliest input of the session strictly later, and before, the last strictly earlier."""
    w = Window.partitionBy(session).orderBy(at)
    return inputs.withColumn("stop", F.min(at).over(w.rangeBetween(1, Window.unboundedFollowing))).withColumn("before", F.max(at).over(w.rangeBetween(Window.unboundedPreceding, -1)))


def in_interval(inputs: DataFrame, others: DataFrame, session: str, at: str, other_at: str) -> DataFrame:
    """Each input of `intervals` with the others of its session at or after it and before its stop."""
    o = others.withColumnRenamed(session, "other_session")
    return inputs.join(o, (F.col(session) == F.col("other_session")) & (F.col(other_at) >= F.col(at)) & (F.col("stop").isNull() | (F.col(other_at) < F.col("stop"))))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str, strict: bool = False) -> DataFrame:
    """left with the value of the last right row of its key at (strict: before) `at`, else null.

    Both sides go through one window by key, so a key with many rows is sorted and never joined with itself.
    """
    a = left.select(key, F.col(at).alias("t"), F.lit(0 if strict else 1).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(key, F.col(right_at).alias("t"), F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.col(value).alias("v"))
    w = Window.partitionBy(key).orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionAll(b).withColumn("found", F.last("v", ignorenulls=True).over(w)).where("l IS NOT NULL").select("l.*", F.col("found").alias(value))


def first_uses(texts: DataFrame, term_col: str, rank: str, ident: str) -> DataFrame:
    """ident, term of every term that no row of smaller rank uses."""
    t = texts.select(F.col(ident), F.col(rank).alias("r"), F.explode(F.array_distinct(term_col)).alias("term"))
    return t.join(t.groupBy("term").agg(F.min("r").alias("first")), "term").where("r = first").select(ident, "term")


def runs_held(docs: DataFrame, known: list, n: int) -> DataFrame:
    """doc_id, item_id: each distinct run of n normalised words of a text (doc_id, text) that stands in `known` (item_id, run joined by UNIT), once an item."""
    of: dict[tuple[str, ...], list] = {}
    for item, run in known:
        of.setdefault(tuple(run.split(UNIT)), []).append(item)
    first = {run[:2] for run in of}
    doc = docs.select("doc_id").schema

    def held(text: str | None) -> list:
        ws = [w for w in (x.strip(EDGE) for x in (text or "").split()) if w]
        at = [i for i, two in enumerate(zip(ws, ws[1:])) if two in first]  # noqa: B905
        return [x for run in {tuple(ws[i : i + n]) for i in at} for x in of.get(run, ())]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(k, x) for k, t in enumerate(b["t"]) for x in held(t.as_py())]
            if hits:
                at, items = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int32())), pa.array(items, pa.int64())], ["doc_id", "item_id"])

    # Words are folded before they are cut out: white space bounds what their case depends on, and no punctuation has a case.
    low = F.translate(F.lower("text"), "’", "'")
    return docs.select("doc_id", low.alias("t")).mapInArrow(look, StructType([doc["doc_id"], StructField("item_id", LongType())]))
