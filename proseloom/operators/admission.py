"""Votes for candidate rules, decisions, agreement between assigners, verdict records and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct sessions that a rule needs.
SESSIONS = 2
# What a public rule line may not hold.
LINT = [
    ("an em or en dash", r"[–—]|(?<!-)--(?!-)"),
    ("a code identifier", r"`[^`]*`|\b[a-z]+_[a-z0-9_]+\b|\b[a-z]+[A-Z][A-Za-z0-9]*\b"),
    ("a date", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"),
]
# End of fixed values.


def lint(text):
    """The problems of a rule line, in order; private names are joined by the caller."""
    bare = F.regexp_replace(F.regexp_replace(text, LINT[1][1], ""), LINT[2][1], "")
    found = [F.when(text.rlike(p), F.lit(n)) for n, p in LINT] + [F.when(bare.rlike(r"\d"), F.lit("a number from the work"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def decisions(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """id, verdict, sessions, points, one_project, one_day: refuse, then ledger (conflict), then ledger (few sessions), then admit.

    candidates: id, keys, text. points: key, is_writing, session, project, day, relation, episode. A point counts if its
    key is one of the candidate's and it is about writing; flags are set from two sessions on and never block.
    """
    p = points.where(F.col("is_writing").isin("yes", "partly"))
    c = candidates.select("id", "text", F.explode("keys").alias("key"))
    mine = c.join(p, "key").groupBy("id").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("points"), F.count_if(F.col("relation") == "conflict").alias("conflicts"), F.count_distinct(F.coalesce("project", "session")).alias("projects"), F.count_distinct("day").alias("days"))
    d = candidates.select("id", "text").join(mine, "id", "left").fillna(0, ["sessions", "points", "conflicts", "projects", "days"])
    verdict = F.when(F.size(lint(F.col("text"))) > 0, "refuse").when((F.col("conflicts") > 0) | (F.col("sessions") < SESSIONS), "ledger").otherwise("admit")
    many = F.col("sessions") >= SESSIONS
    return d.select("id", verdict.alias("verdict"), "sessions", "points", (many & (F.col("projects") == 1)).alias("one_project"), (many & (F.col("days") == 1)).alias("one_day"))


def unclaimed(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """Points about writing whose key no candidate has."""
    return points.where(F.col("is_writing").isin("yes", "partly")).join(candidates.select(F.explode("keys").alias("key")), "key", "left_anti")


def agreement(first: DataFrame, second: DataFrame, ident: str, items: str) -> DataFrame:
    """points, identical, overlap: equal item sets and mean Jaccard of two assigners; two empty sets agree fully."""
    b = second.select(ident, F.array_sort(F.array_distinct(items)).alias("b"))
    x = first.select(ident, F.array_sort(F.array_distinct(items)).alias("a")).join(b, ident, "left").withColumn("b", F.coalesce("b", F.expr("slice(a, 1, 0)")))
    both = F.size(F.array_union("a", "b"))
    return x.agg(F.count("*").alias("points"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.round(F.avg(F.when(both > 0, F.size(F.array_intersect("a", "b")) / both).otherwise(1.0)), 3).alias("overlap"))


def refusals(verdicts: DataFrame, run: str) -> DataFrame:
    """run, sent, omitted, looked, reason: why a run's verdicts are not used, the first that applies, else ''.

    verdicts: verdict (as given; OMITTED: none), effective, reason_code, probe (a definition put in to see whether the
    checker looks), turns. Sent are all but probes; looked at is what is sent less SAME, ORIGINAL and NOT_A_FACT.
    """
    real = ~F.coalesce(F.col("probe"), F.lit(False))
    lazy = real & (F.col("verdict") == "UNVERIFIABLE") & ~F.col("reason_code").eqNullSafe("outside_repo")
    s = verdicts.groupBy(run).agg(F.count_if(real).alias("sent"), F.count_if(real & (F.col("verdict") == "OMITTED")).alias("omitted"), F.count_if(lazy).alias("lazy"), F.count_if(~real & ~F.col("effective").eqNullSafe("TRUE")).alias("unconfirmed"), F.count_if(real & ~F.col("effective").isin("SAME", "ORIGINAL", "NOT_A_FACT")).alias("looked"), F.max("turns").alias("turns"))
    why = F.when(F.col("omitted") > 0, "omitted").when((F.col("lazy") >= 2) & (F.col("lazy") > 0.3 * F.col("sent")), "lazy").when(F.col("unconfirmed") > 0, "probes").when((F.col("looked") >= 6) & (F.col("turns") <= 2), "turns").otherwise("")
    return s.select(run, "sent", "omitted", "looked", why.alias("reason"))


def shares(metrics: DataFrame, group: str, changed: str, sent: str) -> DataFrame:
    """group, sent, changed, share in percent (0.0 when nothing was sent)."""
    s = metrics.groupBy(group).agg(F.sum(sent).cast("bigint").alias("sent"), F.sum(changed).cast("bigint").alias("changed"))
    return s.withColumn("share", F.when(F.col("sent") > 0, 100.0 * F.col("changed") / F.col("sent")).otherwise(0.0))


def revert_cap(blocks):
    """How many of the changed blocks may go back: max(8, a quarter rounded up); of three or more, half at most."""
    cap = F.greatest(F.lit(8), F.ceil(blocks / 4))
    return F.when(blocks >= 3, F.least(cap, F.floor(blocks / 2))).otherwise(cap).cast("bigint")


def votes(points: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """points with `votes`, the rules that each of two assigners gave a point, a rule once or twice.

    points: episode, point; first and second: id (episode#point), supports.
    """
    none = F.expr("cast(array() AS array<string>)")
    held = lambda d, i: d.select(F.col("id").alias("pid"), F.array_distinct("supports").alias(f"s{i}"))
    x = points.withColumn("pid", F.concat_ws("#", "episode", "point")).join(held(first, 1), "pid", "left").join(held(second, 2), "pid", "left")
    return x.withColumn("votes", F.concat(F.coalesce("s1", none), F.coalesce("s2", none))).drop("pid", "s1", "s2")


def counts(rule, keys):
    """Whether two of three readings give a voted point to a rule: its key and each assigner."""
    return F.size(F.filter("votes", lambda v: v == rule)) + F.array_contains(keys, F.col("key")).cast("int") >= 2


def existing(points: DataFrame, rules: DataFrame, since: str) -> DataFrame:
    """id, sessions, points, breached_after, extensions, conflicts: fresh evidence for rules that exist already.

    points: key, relation, date, session, is_writing and votes; rules: id. A conflict counts by the point's key alone and
    is no support. Breaches and extensions are those of the key too; rules without any point have no row.
    """
    p = points.where(F.col("is_writing").isin("yes", "partly"))
    named = p.withColumn("id", F.explode(F.array_distinct(F.concat(F.array("key"), "votes")))).join(rules.select("id"), "id")
    own = F.col("key") == F.col("id")
    conflict = own & (F.col("relation") == "conflict")
    named = named.withColumn("conflict", F.coalesce(conflict, F.lit(False))).where(F.col("conflict") | counts(F.col("id"), F.array("id")))
    good = ~F.col("conflict")
    return named.groupBy("id").agg(F.array_sort(F.collect_set(F.when(good, F.col("session")))).alias("sessions"), F.count_if(good).alias("points"), F.count_if(good & own & (F.col("relation") == "violation") & (F.coalesce("date", F.lit("")) >= since)).alias("breached_after"), F.count_if(good & own & (F.col("relation") == "extension")).alias("extensions"), F.count_if("conflict").alias("conflicts"))


def recommended(verdict, why, points):
    """What to do with a ledger item: reject what lint refused, decide a conflict, accept three points, else hold."""
    return F.when(verdict == "refuse", "reject").when(F.contains(why, F.lit("conflict")), "decide").when(points >= 3, "accept").otherwise("hold")
