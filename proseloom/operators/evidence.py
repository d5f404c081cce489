"""Agreement of readers and runs, decision summaries, runs of units, budgets, pairing and quote checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_packet, slug

#: Verdicts that put a claim back.
REVERT = ("FALSE", "UNVERIFIABLE")
#: Qualities of a pair, best first.
QUALITIES = ("exact", "literal", "commit", "final", "label-only", "none")


def stability(verdicts: DataFrame, doc: str, run: str, claim: str, verdict: str) -> DataFrame:
    """doc, runs, claims, always, sometimes, never, reverted_slots, slots: how often the runs of a document put a claim back.

    A claim that a run of its document does not name was not put back by it. A run that names a claim twice counts once.
    """
    one = verdicts.groupBy(doc, claim).agg(F.count_distinct(F.when(F.col(verdict).isin(*REVERT), F.col(run))).alias("k"))
    runs = verdicts.groupBy(doc).agg(F.count_distinct(run).alias("runs"))
    x = one.join(runs, doc)
    return x.groupBy(doc).agg(F.max("runs").alias("runs"), F.count("*").alias("claims"), F.count_if(F.expr("k = runs")).alias("always"), F.count_if(F.expr("k > 0 AND k < runs")).alias("sometimes"), F.count_if(F.expr("k = 0")).alias("never"), F.sum("k").alias("reverted_slots"), F.sum("runs").alias("slots"))


def reader_agreement(packets: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """packets, found_agree, both_found, entity_overlap, key_overlap, only_first, only_second (counts) of two readers.

    packets: episode, each once. first, second: episode, entity, key; points of other episodes do not count.
    Overlaps are means of shared over union where both readers found something, else null.
    """
    held = lambda d, i: d.groupBy("episode").agg(F.collect_set("entity").alias(f"e{i}"), F.collect_set("key").alias(f"k{i}"))
    x = packets.select("episode").join(held(first, 1), "episode", "left").join(held(second, 2), "episode", "left")
    a, b = F.col("e1").isNotNull(), F.col("e2").isNotNull()
    share = lambda c: F.round(F.avg(F.when(a & b, F.size(F.array_intersect(f"{c}1", f"{c}2")) / F.size(F.array_union(f"{c}1", f"{c}2")))), 3)
    return x.agg(F.count("*").alias("packets"), F.count_if(a == b).alias("found_agree"), F.count_if(a & b).alias("both_found"), share("e").alias("entity_overlap"), share("k").alias("key_overlap"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))


def reason_counts(results: DataFrame, reason: str = "reason") -> DataFrame:
    """reason (what stands before the first colon), records."""
    return results.groupBy(F.substring_index(reason, ":", 1).alias("reason")).agg(F.count("*").alias("records"))


def signal_counts(results: DataFrame, signals: list[str], candidate: str) -> DataFrame:
    """signal, episodes, candidates: how many rows have each boolean signal, over all and over candidates; null is false."""
    on = lambda s: F.coalesce(F.col(s), F.lit(False))
    sums = results.agg(*(F.struct(F.count_if(on(s)).alias("episodes"), F.count_if(on(s) & on(candidate)).alias("candidates")).alias(s) for s in signals))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(f"{s}.episodes"), F.col(f"{s}.candidates")) for s in signals))))


def pair_quality(candidates: DataFrame, pairs: str = "pairs") -> DataFrame:
    """pair_quality, best, every: rows by their first pair's quality ('none' without pairs), and all pairs by quality."""
    q = F.coalesce(F.col(pairs), F.expr("cast(array() AS array<string>)"))
    best = F.when(F.size(q) > 0, F.get(q, F.lit(0))).otherwise("none")
    hits = candidates.select(F.explode(F.concat(F.array(F.struct(best.alias("q"), F.lit(1).alias("b"))), F.transform(q, lambda x: F.struct(x.alias("q"), F.lit(0).alias("b"))))).alias("h"))
    n = hits.groupBy("h.q").agg(F.count_if(F.expr("h.b = 1")).alias("best"), F.count_if(F.expr("h.b = 0")).alias("every"))
    order = candidates.sparkSession.createDataFrame([(x,) for x in QUALITIES], "pair_quality string")
    return order.join(n, order.pair_quality == n.q, "left").select("pair_quality", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("every", F.lit(0)).alias("every"))


def repeated_sentences(sentences: DataFrame, rule: str, pos: str, sentence: str) -> DataFrame:
    """rule, sentence, owner: sentences that another rule, the owner, holds earlier in reading order `pos`.

    The owner is a minimum, so hot sentences pre-aggregate.
    """
    first = sentences.groupBy(sentence).agg(F.min_by(rule, pos).alias("owner"))
    return sentences.select(rule, sentence).distinct().join(first, sentence).where(F.col("owner") != F.col(rule)).select(rule, sentence, "owner")


def passage_runs(units: DataFrame, block: list[str], pos: str, new: str, words: str, least: int = 8) -> DataFrame:
    """block, start, stop, units, words: unbroken runs of new units within a block that hold at least `least` words."""
    gaps = F.sum(F.when(F.coalesce(F.col(new), F.lit(False)), 0).otherwise(1)).over(Window.partitionBy(*block).orderBy(pos))
    runs = units.withColumn("run", gaps).where(F.col(new)).groupBy(*block, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("units"), F.sum(words).cast("bigint").alias("words"))
    return runs.where(F.col("words") >= least).drop("run")


def within_budget(sources: DataFrame, group: str, order: str, size: str, cap: int, budget: int) -> DataFrame:
    """sources with `sent`: each at most cap characters, in order, until the group's budget is used up; later ones go."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.least(F.col(size), F.lit(cap))
    d = sources.withColumn("used", F.coalesce(F.sum(own).over(w), F.lit(0)))
    return d.where(F.col("used") < budget).withColumn("sent", F.least(own, F.lit(budget) - F.col("used")).cast("bigint")).drop("used")


def anchors(headings: DataFrame, doc: str, pos: str, title: str) -> DataFrame:
    """headings with `anchor`: the slug, and -1, -2 and so on for later headings of the same slug in a document."""
    d = headings.withColumn("slug", slug(F.col(title)))
    n = F.row_number().over(Window.partitionBy(doc, "slug").orderBy(pos)) - 1
    return d.withColumn("n", n).withColumn("anchor", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string")))).drop("slug", "n")


def exact_pairs(old: DataFrame, new: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """doc, old_pos, new_pos: the k-th unit of a key in the old text with the k-th in the new one, one to one."""
    ranked = lambda d, name: d.select(doc, key, F.col(pos).alias(name), F.row_number().over(Window.partitionBy(doc, key).orderBy(pos)).alias("k"))
    return ranked(old, "old_pos").join(ranked(new, "new_pos"), [doc, key, "k"]).select(doc, "old_pos", "new_pos")


def commits_with_slack(inputs: DataFrame, commits: DataFrame, start: str, end: str, at: str, slack: int = 1800, width: int = 3600) -> DataFrame:
    """Each input with the commits at or after its start and before its end plus the slack, in any session.

    A range join by bins: an input goes to each bin of `width` seconds that its interval touches, a commit to its own,
    so both sides meet by an equal key and no pair is compared outside its bin.
    """
    stop = F.col(end) + slack
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((stop - 1) / width))
    i = inputs.where(stop > F.col(start)).withColumn("bin", F.explode(bins))
    return i.join(commits.withColumn("bin", F.floor(F.col(at) / width)), "bin").where((F.col(at) >= F.col(start)) & (F.col(at) < stop)).drop("bin")


def checked_points(points: DataFrame, packets: DataFrame) -> DataFrame:
    """points with `why`, '' for those that hold: no packet, then a quote not in its words, then a quote from what was
    seen or pasted, then a pair that the packet lacks.

    points: episode, quote, before_ref, after_ref. packets: episode, words, seen, pasted, pairs (their ids). Case, white
    space, apostrophes and punctuation do not count; nulls are empty.
    """
    none = F.expr("cast(array() AS array<string>)")
    seen = F.concat(norm_packet(F.col("seen")), F.lit(" "), F.array_join(F.transform(F.coalesce("pasted", none), norm_packet), " "))
    p = packets.select("episode", norm_packet(F.col("words")).alias("w"), seen.alias("s"), F.coalesce("pairs", none).alias("ids"), F.lit(True).alias("known"))
    d = points.join(p, "episode", "left").withColumn("q", norm_packet(F.col("quote")))
    lost = lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.array_contains("ids", F.col(c))
    why = F.when(F.col("known").isNull(), "packet").when((F.col("q") == "") | ~F.contains("w", "q"), "words").when(F.contains("s", "q"), "seen").when(lost("before_ref") | lost("after_ref"), "pair").otherwise("")
    return d.withColumn("why", why).select(*points.columns, "why")
