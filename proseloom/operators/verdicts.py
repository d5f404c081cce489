"""Rules over verdict records: what a checker's answer is worth, by its quotes, its citation and its searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Least characters of a quoted span, lines around a cited one, most searches a verdict may name; suffixes of documents.
SPAN, WINDOW, SEARCHES = 8, 3, 20
DOCUMENTS = (".md", ".markdown", ".mdx", ".rst", ".txt", ".adoc", ".asciidoc", ".org", ".tex", ".pdf", ".docx", ".odt", ".rtf")
# End of fixed values.


def cited(verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """verdicts with `citation_ok`: the cited span, white space collapsed, stands within three lines of the cited one.

    verdicts: run, number, claim_type, cite_path, cite_line, cite_span. lines: path, line (from 1), text. A claim about a
    mechanism may not cite a document. Only cited windows meet the lines: by path and line, never whole files.
    """
    from .triage import suffix

    at = verdicts.where((F.length(T.flat(F.col("cite_span"))) >= SPAN) & (F.col("cite_line") >= 1) & ~((F.col("claim_type") == "mechanism") & suffix(F.col("cite_path")).isin(*DOCUMENTS)))
    need = at.select("run", "number", "cite_span", F.col("cite_path").alias("path"), "cite_line", F.explode(F.sequence(F.col("cite_line") - WINDOW, F.col("cite_line") + WINDOW)).alias("line"))
    near = need.join(lines.select("path", F.col("line").cast("int").alias("line"), "text"), ["path", "line"]).groupBy("run", "number", "cite_span", "cite_line").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("w"))
    good = near.where(F.exists("w", lambda x: x["line"] == F.col("cite_line")) & F.contains(T.flat(F.array_join(F.transform("w", lambda x: x["text"]), " ")), T.flat(F.col("cite_span"))))
    return verdicts.join(good.select("run", "number", F.lit(True).alias("citation_ok")), ["run", "number"], "left").withColumn("citation_ok", F.coalesce("citation_ok", F.lit(False)))


def judged(verdicts: DataFrame, stop: list[str]) -> DataFrame:
    """verdicts with `effective`, by ordered rules.

    verdicts: verdict (null: none was given), kind (added or changed), old, new, delta, quotes (of the original), original,
    citation_ok, found (whether a search said to find nothing finds something), n_searches. SAME holds for changed
    sentences only; ORIGINAL if all quotes stand in the original; FALSE of a changed sentence must name a word that the new one adds, or a
    negation must differ, else it is SAME; TRUE and FALSE need a citation and searches that find nothing.
    """
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    tokens = lambda c: T.claim_tokens(F.col(c), words)
    v, changed = F.upper("verdict"), F.col("kind") == "changed"
    quotes = F.transform(F.coalesce("quotes", F.expr("cast(array() AS array<string>)")), T.flat)
    whole = T.flat(F.col("original"))
    held = (F.size(quotes) > 0) & F.forall(quotes, lambda q: (F.length(q) >= SPAN) & F.contains(whole, q))
    differ = F.array_union(F.array_except(tokens("new"), tokens("old")), F.array_except(tokens("old"), tokens("new")))
    negated = F.arrays_overlap(differ, F.array(*map(F.lit, T.NEGATIONS)))
    named = F.arrays_overlap(tokens("delta"), F.array_except(tokens("new"), tokens("old")))
    bad = F.coalesce("found", F.lit(False)) | (F.coalesce("n_searches", F.lit(0)) > SEARCHES)
    effective = (
        F.when(v.isNull(), "UNVERIFIABLE")
        .when(v == "SAME", F.when(changed, "SAME").otherwise("UNVERIFIABLE"))
        .when(v == "NOT_A_FACT", "NOT_A_FACT")
        .when(v == "ORIGINAL", F.when(held, "ORIGINAL").otherwise("UNVERIFIABLE"))
        .when(~v.isin("TRUE", "FALSE"), "UNVERIFIABLE")
        .when((v == "FALSE") & changed & ~negated & ~named, "SAME")
        .when(~F.coalesce("citation_ok", F.lit(False)) | bad, "UNVERIFIABLE")
        .otherwise(v)
    )
    return verdicts.withColumn("effective", effective)


def failing(verdicts: DataFrame) -> DataFrame:
    """The verdicts that put a claim back."""
    return verdicts.where(F.col("effective").isin("FALSE", "UNVERIFIABLE"))


def parsed(replies: DataFrame) -> DataFrame:
    """run, problem, verdicts: a checker's replies (run, reply: JSON) as arrays of verdicts, or what is wrong with them.

    The first of: not an object, no verdicts, a verdict without an id, an id answered twice; then verdicts is null.
    """
    cite = "struct<path:string,line:int,span:string>"
    item = f"struct<id:int,verdict:string,claim_type:string,effect:{cite},reason_code:string,delta:string,original:array<string>,reason:string>"
    x = replies.withColumn("p", F.from_json("reply", f"verdicts array<{item}>"))
    ids = F.transform("p.verdicts", lambda v: v["id"])
    problem = F.when(F.col("p").isNull() | ~F.coalesce(F.ltrim("reply").startswith("{"), F.lit(False)), "not an object").when(F.col("p.verdicts").isNull(), "no verdicts").when(F.exists(ids, lambda i: i.isNull()), "a verdict without an id").when(F.size(F.array_distinct(ids)) < F.size(ids), "an id answered twice").otherwise("")
    return x.select("run", problem.alias("problem"), F.when(problem == "", F.col("p.verdicts")).alias("verdicts"))
