"""Pattern rates per group: one scan, one row per text and rule with hits, partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tells import RULES, cleaned, java, words


def rates(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """group, rule, hits, words, per_1000 (0.0 without words): a row for each group and rule. Null text counts as empty."""
    wide = texts.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < wide:  # one row group is one task, and the patterns are the work
        texts = texts.repartition(wide)
    base = texts.select(F.col(group), F.coalesce(F.col(text), F.lit("")).alias("raw")).withColumn("prose", cleaned(F.col("raw")))
    sums = base.groupBy(group).agg(F.sum(words(F.col("raw"))).alias("words"), *(F.sum(F.regexp_count("prose", F.lit(java(p)))).alias(i) for i, _, _, p in RULES))
    long = sums.select(group, "words", F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(i).cast("bigint").alias("hits")) for i, *_ in RULES))).alias("r"))
    return long.select(group, "r.rule", "r.hits", "words", F.when(F.col("words") > 0, 1000.0 * F.col("r.hits") / F.col("words")).otherwise(0.0).alias("per_1000"))


def inside(ts, since: str | None = None, until: str | None = None):
    """since <= first ten characters <= until; an empty stamp passes."""
    day = F.substring(ts, 1, 10)
    ok = F.lit(True)
    if since:
        ok = ok & (day >= since)
    if until:
        ok = ok & (day <= until)
    return (ts == "") | ok


def half_open(ts, since: str | None = None, until: str | None = None):
    """since <= stamp < until as strings; an empty stamp fails since and passes until."""
    ok = F.lit(True)
    if since:
        ok = ok & (ts >= since)
    if until:
        ok = ok & (ts < until)
    return ok
