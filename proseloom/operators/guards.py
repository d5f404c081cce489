"""Guards of a rewrite: the first reason why a new text must not replace an old one, and the smaller checks beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The least share of the old length by kind of text, a message's most characters, a conventional prefix.
FLOORS = {"document": 0.5, "commit": 0.25, "pull request": 0.25, "passage": 0.25}
DISCORD = 2000
PREFIX = r"^([a-z]+(?:\([^)]*\))?!?: )"
# End of fixed values.


def minus(a: Column, b: Column) -> Column:
    """What an array holds more often than another, as often as it does, sorted."""
    more = lambda p, x: F.size(F.filter(p["a"], lambda y: y == x)) - F.size(F.filter(p["b"], lambda y: y == x))
    kept = lambda p: F.transform(F.array_distinct(p["a"]), lambda x: F.array_repeat(x, F.greatest(more(p, x), F.lit(0))))
    return T.let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.array_sort(F.flatten(kept(p))))


def together(span: Column, text: Column) -> Column:
    """Whether one paragraph outside fences holds every word of a span."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(rf"{T.WORD}+"), 0)
    paras = F.split(F.regexp_replace(text, T.FENCE, ""), r"\n\s*\n")
    return (F.size(words(span)) > 0) & F.exists(paras, lambda p: F.size(F.array_except(words(span), words(p))) == 0)


def heading_slugs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), 1), T.slug)


def reasons(pairs: DataFrame, floor: float = FLOORS["document"]) -> DataFrame:
    """pairs with `reason`, the first of: empty, short, fence, code lost, code invented, link lost, link added, number; '' for none.

    pairs: old, new, sources (text that a new name or number may come from; null is none). A code span counts as kept if its name, or its
    words in one paragraph, still stand in the new text. A new link may point at a heading of the new text only.
    """
    d = pairs.withColumn("__s", F.coalesce("sources", F.lit("")))
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    known, flat_new = T.flat(F.concat(old, F.lit("\n"), F.col("__s"))), T.flat(new)
    before, after = T.inline_spans(old), T.inline_spans(new)
    lost = T.let(flat_new, lambda t: F.exists(minus(before, after), lambda s: ~F.contains(t, s) & ~together(s, new)))
    invented = T.let(known, lambda t: F.exists(minus(after, before), lambda s: ~F.contains(t, s)))
    links = (T.link_targets(old), T.link_targets(new))
    inside = lambda t: t.startswith("#") & F.array_contains(heading_slugs(new), F.substr(t, F.lit(2)))
    fences = lambda c: F.regexp_extract_all(c, F.lit(T.FENCE), 0)
    numbers = T.invented_numbers(new, F.concat(old, F.lit("\n"), F.col("__s")))
    why = (
        F.when(T.stripped(new) == "", "empty")
        .when(F.length(new) < F.length(old) * floor, "short")
        .when(fences(old) != fences(new), "fence")
        .when(lost, "code lost")
        .when(invented, "code invented")
        .when(F.size(minus(links[0], links[1])) > 0, "link lost")
        .when(F.exists(minus(links[1], links[0]), lambda t: ~inside(t)), "link added")
        .when(F.size(numbers) > 0, "number")
        .otherwise("")
    )
    return d.withColumn("reason", why).drop("__s")


def trailer(message: Column) -> Column:
    """The lines after a message's last blank line if each is `Key: value`, with a line feed; else ''."""
    tail = F.regexp_extract(F.regexp_replace(message, r"\n+\z", ""), r"(?s)\A.+?\n[ \t]*\n((?:[A-Za-z][A-Za-z0-9-]*: [^\s\n][^\n]*(?:\n|\z))+)\z", 1)
    return F.when(tail != "", F.concat(tail, F.lit("\n"))).otherwise("")


def without_footer(body: Column, mark: str) -> Column:
    """A description up to a generated footer that begins with mark, without line feeds at its end."""
    return F.regexp_replace(F.substring_index(body, mark, 1), r"\n+\z", "")


def markup(text: Column) -> Column:
    """The tags and attribute blocks of a text, sorted, as often as they stand."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"<[^<>\n]+>|\{[^{}\n]*=[^{}\n]*\}"), 0))


def keeps_prefix(old: Column, new: Column) -> Column:
    """Whether a conventional prefix of the old message starts the new one too."""
    prefix = F.regexp_extract(old, PREFIX, 1)
    return (prefix == "") | new.startswith(prefix)


def within_limit(old: Column, new: Column, most: int = DISCORD) -> Column:
    """Whether a message is no longer than allowed, unless the old one was longer already."""
    return (F.length(new) <= most) | (F.length(old) > most)
