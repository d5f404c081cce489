"""Packets for readers: repeated messages once, best pairs, closest rules, shares."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udf import arrow_udf

# Qualities of pairs, best first; how many pairs and rules a packet shows.
QUALITIES = ("exact", "literal", "commit", "final", "label-only")
PAIRS, RULES = 3, 3
# End of fixed values.


def repeats(candidates: DataFrame) -> DataFrame:
    """The first unsuggested candidate of each normalised text, with `repeats`, the later ids in order.

    candidates: id, rank (unique), suggested, words. Texts without words go. Only ids are gathered, by text.
    """
    c = candidates.where("NOT coalesce(suggested, false)").withColumn("key", T.norm_packet(F.col("words"))).where("key <> ''")
    later = c.groupBy("key").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("all"))
    kept = c.join(later, (c["key"] == later["key"]) & (c["rank"] == later["first"])).select(*candidates.columns, F.expr("transform(slice(all, 2, greatest(size(all) - 1, 1)), x -> x.id)").alias("repeats"))
    return kept


def best_pairs(pairs: Column, n: int = PAIRS) -> Column:
    """The n best of an array of struct(quality, before, after), by quality, then in the order given; unknown qualities last."""
    tier = lambda p: F.when(F.array_position(F.array(*map(F.lit, QUALITIES)), p["quality"]) > 0, F.array_position(F.array(*map(F.lit, QUALITIES)), p["quality"])).otherwise(9)
    keyed = F.transform(pairs, lambda p, i: F.struct(tier(p).alias("t"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["p"])


@arrow_udf("double")
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def closest_rules(packets: DataFrame, rules: DataFrame, n: int = RULES) -> DataFrame:
    """id, place, rule: the n rules nearest to a packet's words: shared words over the rule's, plus a quarter of the characters' ratio.

    packets: id, words. rules: rule, pos, text; a rule base is for people, so every packet meets every rule. Ties in the order of pos.
    """
    p = packets.select("id", T.norm_packet(F.col("words")).alias("w"))
    r = rules.select("rule", "pos", T.norm_packet(F.col("text")).alias("t"))
    x, y = F.array_distinct(T.split_words(F.col("w"))), F.array_distinct(T.split_words(F.col("t")))
    score = F.size(F.array_intersect(x, y)) / F.greatest(F.size(y), F.lit(1)) + _ratio("w", "t") / 4
    ranked = p.crossJoin(r).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(score.desc(), "pos")))
    return ranked.where(F.col("place") <= n).select("id", "place", "rule")


def label_text(label: Column, source: Column) -> Column:
    """A fix label with where it came from."""
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.coalesce(label, F.lit("")), F.lit(" ("), source, F.lit(")"))).otherwise(F.coalesce(label, F.lit("")))


def shares(packets: DataFrame, order: str, readers: int) -> DataFrame:
    """packets with `reader` from 0 on, dealt in turn in the given order; the order is one range sort, not one task."""
    d = packets.select("*", F.lit(1).alias("one")).repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("part").agg(F.count("*").alias("n")).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return d.withColumn("place", place).join(F.broadcast(sizes.select("part", "off")), "part").withColumn("reader", F.pmod(F.col("off") + F.col("place"), F.lit(readers)).cast("int")).drop("part", "off", "place", "one")
