"""Triage of episodes: signals, decision, recall against quotes. Everything is columns; earlier messages meet by joins.

episodes: id, rank (place in time, unique), channel, suggested, words, seen, pasted array, edit_paths array, published
(whether a publish went through), labels array of struct(label, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .alike import with_earlier

# Patterns of the signals, the suffixes of prose, the thresholds of repetition.
QUESTION = r"\bwhat\s+is\b|\bwhat's\b|\bwhats\b|\bwhat\s+are\b|\bwhich\b|\?\?\?|\bi\s+don'?t\s+understand\b|\bi\s+do\s+not\s+understand\b|\bwhat\s+does\b|\bwhat\s+do\s+you\s+mean\b|\bwhy\b|\bmeaning\s+of\b"
EVALUATIVE = r"\b(unclear|confusing|confused|confuses|rewrite|rewritten|re-write|simpler|simplify|explain|explained|explaining|define|defined|clarify|clarified|jargon|too\s+dense|too\s+long|not\s+clear|isn'?t\s+clear|readable|unreadable|readability|wording|reword|phrasing|out\s+of\s+the\s+blue|robotic|verbose|fluff|blob|ai\s+slop|slop|details?|misleading|hard\s+to\s+(?:read|follow|understand)|i\s+don'?t\s+understand|much\s+better|good|very\s+good|i\s+approve|looks\s+good|perfect|nice|well\s+done|love\s+it|great)\b"
DOC_NOUN = r"\b(readme|pages?|sections?|tables?|figures?|legends?|captions?|formulas?|formulae|symbols?|steps?|derivations?|examples?|layouts?|links?|maths?|notations?|plots?|axis|axes|scales?|documents?|docs?|artifacts?|paragraphs?|sentences?|headings?|titles?|charts?|images?|reports?)\b"
WRITING = r"\b(text|texts|write|written|writing|wording|prose|sentence|sentences|paragraph|doc|docs|document|readme|page|style|reads|tone|llm|ai|generated|copy|card)\b"
KEYWORDS = ["wording", "explain", "unclear", "confusing", "rewrite", "simpler", "math", "formula", "equation", "step", "derivation", "notation", "symbol", "define", "clarify", "reader", "document", "artifact", "too dense", "too long", "jargon", "not clear", "i dont understand", "why", "what does"]
QUOTED = r'["“”]([^"“”\n]{3,200})["“”]'
PROSE_SUFFIXES = (".md", ".markdown", ".html", ".htm", ".txt", ".rst")
SHARED, GRAMS = 0.3, 20
WEAK = ["response_edits_prose", "evaluative", "document_noun", "repetition", "label_link", "commit_link"]
# End of fixed values.
#: Characters of a quote by which it meets texts, and quotes that are broadcast.
ANCHOR, QUOTES = 8, 500_000


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, '' without one; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def is_prose(path: Column) -> Column:
    return F.coalesce(suffix(path).isin(*PROSE_SUFFIXES), F.lit(False))


def apply_slips(text: Column, slips: list[tuple[str, str, bool]]) -> Column:
    """Text with each (heard, meant, only in a writing context) replaced as whole words, in order; the context is looked at anew each time."""
    for heard, meant, context in slips:
        put = F.regexp_replace(text, rf"(?iu)(?<!{T.WORD})\Q{heard}\E(?!{T.WORD})", meant.replace("\\", "\\\\").replace("$", "\\$"))
        text = F.when(F.lower(text).rlike(WRITING), put).otherwise(text) if context else put
    return text


def quote_overlap(words: Column, seen: Column, pasted: Column) -> Column:
    """Whether something was pasted, or a quoted phrase of two words or more stands in what was seen."""
    low = F.lower(T.flat(seen))
    phrases = F.transform(F.regexp_extract_all(F.coalesce(words, F.lit("")), F.lit(QUOTED), 1), lambda q: F.btrim(F.lower(T.flat(q)), F.lit(" .,;:")))
    return (F.size(pasted) > 0) | F.exists(phrases, lambda p: F.contains(p, F.lit(" ")) & F.contains(low, p))


def repetition(episodes: DataFrame, text: str) -> DataFrame:
    """id of the unsuggested episodes whose five-character runs share 0.3 of the union with an earlier unsuggested one's.

    Both sides need 20 runs. All pairs are bounded by matrix products over tiles, and what the bound leaves is counted exactly.
    """
    e = episodes.where("NOT coalesce(suggested, false)").select("id", "rank", F.lower(T.flat(F.col(text))).alias("low"))
    return with_earlier(e, 5, GRAMS, SHARED)


def features(episodes: DataFrame, stop: list[str], slips: list[tuple[str, str, bool]] = ()) -> DataFrame:
    """episodes with matched (the words after slips), the eight signals and new_terms.

    stop: words that are no content terms. A term is new if no earlier unsuggested episode used it; the question signal needs a new
    term that stands in what was seen.
    """
    none = F.expr("cast(array() AS array<string>)")
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    e = episodes.withColumn("matched", apply_slips(F.coalesce("words", F.lit("")), list(slips))).withColumn("pasted", F.coalesce("pasted", none))
    own = e.select("id", "rank", "suggested", F.explode(F.array_distinct(T.terms(F.col("matched")))).alias("term"))
    first = own.where("NOT coalesce(suggested, false)").groupBy("term").agg(F.min("rank").alias("first"))
    held = e.select("id", "rank", F.explode(F.array_distinct(F.array_intersect(T.content_terms(F.col("matched"), words, T.upper_terms(F.col("seen"))), T.terms(F.col("seen"))))).alias("term"))
    new = held.join(first, "term", "left").where("first IS NULL OR first >= rank").groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("new"))
    again = repetition(e, "matched").select("id", F.lit(True).alias("again"))
    low = F.lower("matched")
    source = lambda s: F.coalesce(F.exists("labels", lambda x: x["source"] == s), F.lit(False))
    x = e.join(new, "id", "left").join(again, "id", "left").withColumn("new", F.coalesce("new", none))
    x = x.withColumn("term_question", low.rlike(QUESTION) & (F.size("new") > 0))
    return x.select(
        *e.columns,
        (F.coalesce(F.exists("edit_paths", is_prose), F.lit(False)) | F.coalesce("published", F.lit(False))).alias("response_edits_prose"),
        quote_overlap(F.col("words"), F.col("seen"), F.col("pasted")).alias("quote_overlap"),
        "term_question",
        low.rlike(EVALUATIVE).alias("evaluative"),
        low.rlike(DOC_NOUN).alias("document_noun"),
        F.coalesce("again", F.lit(False)).alias("repetition"),
        source("publish").alias("label_link"),
        source("commit").alias("commit_link"),
        F.when(F.col("term_question"), F.col("new")).otherwise(none).alias("new_terms"),
    )


def decided(f: DataFrame) -> DataFrame:
    """f, the rows of features, with candidate and reason: the first of suggested, comment or answer, strong, two weak signals, one, none."""
    named = lambda names: F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    link = (F.col("label_link") | F.col("commit_link")) & (F.col("evaluative") | F.col("document_noun"))
    wording = F.concat(F.lit("link with "), F.when(F.col("evaluative"), "evaluative wording").otherwise("a document noun"))
    strong = F.concat(named(["quote_overlap", "term_question"]), F.filter(F.array(F.when(link, wording)), lambda x: x.isNotNull()))
    weak = named(WEAK)
    out = f.withColumn("strong", strong).withColumn("weak", weak)
    sug, made = F.coalesce("suggested", F.lit(False)), F.col("channel").isin("comment", "answer")
    reason = F.when(sug, "suggested prompt").when(made, F.concat("channel", F.lit(" (by construction)"))).when(F.size("strong") > 0, F.concat(F.lit("strong: "), F.array_join("strong", ", "))).when(F.size("weak") >= 2, F.concat(F.lit("two weak signals: "), F.array_join("weak", ", "))).when(F.size("weak") == 1, F.concat(F.lit("one weak signal: "), F.element_at("weak", 1))).otherwise("no signal")
    return out.withColumn("reason", reason).withColumn("candidate", ~sug & (made | (F.size("strong") > 0) | (F.size("weak") >= 2))).drop("strong", "weak")


def keyword_gold(episodes: DataFrame, text: str = "text") -> DataFrame:
    """Typed and queued, unsuggested episodes whose text holds a keyword as whole words."""
    alike = r"\b(" + "|".join(k.replace(" ", r"\s+") for k in KEYWORDS) + r")\b"
    return episodes.where(F.col("channel").isin("typed", "queued") & ~F.coalesce("suggested", F.lit(False)) & F.lower(F.col(text)).rlike(alike))


def quoted_in(quotes: DataFrame, episodes: DataFrame) -> DataFrame:
    """quote_id, id: unsuggested episodes whose text holds the pieces of a quote one after another.

    Case, white space and apostrophes do not count; a bracketed gap stands for anything. quotes: quote_id, quote; a quote of gaps only is
    found nowhere. A quote meets only texts that hold the first ANCHOR characters of its longest piece: an equi-join on runs of
    characters, to the texts' side while quotes are few. id is unique where they are not.
    """
    q = quotes.select("quote_id", F.transform(T.pieces(F.col("quote")), T.plain).alias("p")).where(F.size("p") > 0)
    longest = F.array_max(F.transform("p", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    q = q.withColumn("anchor", F.substring(longest, 1, ANCHOR))
    many = {n: k for n, k in q.groupBy(F.length("anchor")).count().collect()}
    e = episodes.where("NOT coalesce(suggested, false)").select("id", T.plain(F.col("text")).alias("t"))
    held = e.select("id", "t", F.explode(T.text_runs(F.col("t"), sorted(many))).alias("anchor"))
    step = lambda rest, p: F.when(rest.isNotNull() & F.contains(rest, p), F.substr(rest, F.instr(rest, p) + F.length(p)))
    both = held.join(F.broadcast(q), "anchor") if sum(many.values()) <= QUOTES else held.drop("t").join(q, "anchor").join(e, "id")
    return both.where(F.aggregate("p", F.col("t"), step).isNotNull()).select("quote_id", "id")


def recall(quotes: DataFrame, episodes: DataFrame, results: DataFrame) -> DataFrame:
    """quotes, short, absent, found, missed, recalled: how many quotes of three words or more the candidates cover.

    A quote counts as missed if an episode that holds it is no candidate. results: id, candidate.
    """
    long = F.size(T.split_words(F.array_join(T.pieces(F.col("quote")), " "))) >= 3
    q = quotes.withColumn("long", long)
    hits = quoted_in(q.where("long"), episodes).join(results.select("id", "candidate"), "id")
    per = hits.groupBy("quote_id").agg(F.bool_and("candidate").alias("all"))
    x = q.join(per, "quote_id", "left").withColumn("found", F.col("all").isNotNull())
    return x.agg(F.count("*").alias("quotes"), F.count_if(~F.col("long")).alias("short"), F.count_if(F.col("long") & ~F.col("found")).alias("absent"), F.count_if("found").alias("found"), F.count_if(F.col("found") & ~F.col("all")).alias("missed"), F.count_if(F.col("found") & F.col("all")).alias("recalled"))


def self_initiated(results: DataFrame, stop: list[str]) -> DataFrame:
    """id, label, why: published labels that no input explains. results: the rows of decided."""
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    x = results.select("*", F.explode("labels").alias("l")).where("l.source = 'publish'")
    shared = F.arrays_overlap(T.stems(F.col("l.label"), words), T.stems(F.col("words"), words))
    why = F.when(F.coalesce("suggested", F.lit(False)), "follows a suggested prompt").when(~F.col("candidate") & ~F.coalesce(shared, F.lit(False)), F.concat(F.lit("the input asks for nothing about the text: "), "reason"))
    return x.select("id", F.col("l.label").alias("label"), why.alias("why")).where("why IS NOT NULL")
