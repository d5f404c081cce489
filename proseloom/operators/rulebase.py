"""A rule base as tables: rules of marker lines, sentences, and the checks between rules and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# A rule's marker, a list marker, the words of a sentence.
MARK = r"\{#([^\s}]+)(?:\s+refines=([^\s}]+))?\}"
LIST = r"^\s*(?:[-*+]|\d+\.)\s+"
WORDS = r"[a-z0-9']+"
# End of fixed values.


def rules_in(files: DataFrame) -> DataFrame:
    """id, refines, path, line (from 1), text, position: the rules of marker lines of files (path, pos in the base's order, text).

    A line may hold several rules; a title line and blank lines hold none.
    """
    lines = files.select("path", F.col("pos").alias("p"), F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    body = F.ltrim(F.regexp_replace("raw", LIST, ""))
    d = lines.withColumn("body", body).where(F.col("body").startswith("{#"))
    marks = F.regexp_extract_all("body", F.lit(MARK), 0)
    # The text of the k-th marker is what stands between it and the next one.
    texts = F.slice(F.split("body", MARK), 2, 1_000_000)
    d = d.select("path", "p", (F.col("n") + 1).cast("bigint").alias("line"), F.posexplode(F.arrays_zip(marks.alias("mark"), texts.alias("text"))).alias("k", "r"))
    # Positions count over the whole base, which is written by people: one small window.
    position = F.row_number().over(Window.orderBy("p", "line", "k")) - 1
    refines = F.filter(F.split(F.regexp_extract("r.mark", MARK, 2), ","), lambda x: x != "")
    return d.select(F.regexp_extract("r.mark", MARK, 1).alias("id"), refines.alias("refines"), "path", "line", F.trim("r.text").alias("text"), position.cast("bigint").alias("position"))


def bad_lines(files: DataFrame) -> DataFrame:
    """path, line of lines that are neither title, blank nor rule."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    ok = (T.stripped(F.col("raw")) == "") | ((F.col("n") == 0) & F.col("raw").startswith("# ")) | F.ltrim(F.regexp_replace("raw", LIST, "")).startswith("{#")
    return lines.where(~ok).select("path", (F.col("n") + 1).cast("bigint").alias("line"))


def sentences(text: Column) -> Column:
    """The sentences of three words or more, as lower-case words with single spaces."""
    parts = F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + T.UNIT), T.UNIT), lambda s: F.regexp_extract_all(F.lower(s), F.lit(WORDS), 0))
    return F.transform(F.filter(parts, lambda w: F.size(w) >= 3), lambda w: F.array_join(w, " "))


def unknown_refs(rules: DataFrame, retired: DataFrame) -> DataFrame:
    """id, ref: references to rules that are neither there nor retired (id)."""
    refs = rules.select("id", F.explode("refines").alias("ref"))
    known = rules.select(F.col("id").alias("ref")).unionAll(retired.select(F.col("id").alias("ref")))
    return refs.join(known.distinct(), "ref", "left_anti").select("id", "ref")


def duplicate_ids(rules: DataFrame) -> DataFrame:
    """id, times of ids that stand more than once."""
    return rules.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


def trigrams(text: Column, stop: Column) -> Column:
    """Runs of three content words."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0), lambda w: ~F.array_contains(stop, w))
    return T.shingles(kept, 3)


def overlapping(rules: DataFrame, stop: list[str]) -> DataFrame:
    """id, other, trigram: pairs of rules, the earlier first, that share a run of three content words, with the first such run; pairs that refine
    one another are left out. Pairs meet by their runs, so only those that share one are made."""
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    g = rules.select("id", "position", "refines", F.explode(trigrams(F.col("text"), words)).alias("g"))
    a, b = g.alias("a"), g.alias("b")
    x = a.join(b, F.col("a.g") == F.col("b.g")).where("a.position < b.position").where(~F.array_contains("a.refines", F.col("b.id")) & ~F.array_contains("b.refines", F.col("a.id")))
    return x.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("other")).agg(F.translate(F.min("a.g"), T.UNIT, " ").alias("trigram"))


def latest_evidence(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """rule, newest, decided, fresh: the newest date of a rule's evidence beside its decision; fresh if it is later. Dates are strings."""
    e = evidence.groupBy("rule").agg(F.max("date").alias("newest"))
    d = decisions.groupBy("rule").agg(F.max("decided").alias("decided"))
    return e.join(d, "rule", "left").withColumn("fresh", F.coalesce(F.col("newest") > F.col("decided"), F.lit(True)))


def core(rules: DataFrame, budget: int) -> DataFrame:
    """core, chars, over: the rules' texts in order, one a line, and whether they exceed the budget."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    return rules.agg(joined.alias("core")).withColumn("chars", F.length("core").cast("bigint")).withColumn("over", F.col("chars") > budget)
