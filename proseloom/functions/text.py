"""Text columns: white space, words, shingles, paragraphs, similarity, normal forms and small parsers.

White space is Unicode's, as a split without arguments divides at: tab to carriage return, the four information
separators, next line and all separators of class Z. Patterns spell it out, so that every engine reads them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class of white space, and of word characters.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
WS, NWS = f"[{SPACE}]", f"[^{SPACE}]"
WORD = r"[\p{L}\p{N}_]"
# Punctuation at the edges of a word, the separator of joined runs, and patterns of scalars.
EDGE = "\"'`’‘“”()[]{}<>.,;:!?*_-—–"
TERM = rf"[A-Za-z0-9](?:{WORD}|[.\-])*{WORD}|{WORD}"
NUMBER = r"\d[\d.,]*"
LINK = r"\]\(([^)\x09-\x0d\x20]+)\)"
FENCE = r"(?ms)^```.*?^```"
SPAN = r"(?s)(?<!`)(`+)(?!`)((?:(?!\n\s*\n).)+?)(?<!`)\1(?!`)"
NEGATIONS = ("not", "no", "never", "none", "nothing", "nobody", "cannot", "without", "neither", "nor")
# End of fixed values.
UNIT = "\x1f"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, where a lambda would compute the expression again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def flat(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def split_words(text: Column) -> Column:
    """The runs between white space; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{NWS}+"), 0)


def word_list(text: Column) -> Column:
    """Lower-case words: letters, digits and underscores, with inner apostrophes, curly ones straightened."""
    return F.regexp_extract_all(F.translate(F.lower(text), "’", "'"), F.lit(rf"{WORD}+(?:'{WORD}+)*"), 0)


def norm_tokens(text: Column) -> Column:
    """Runs between white space without punctuation at their edges, lower-cased, curly apostrophes straightened; empty ones left out."""
    bare = F.transform(split_words(text), lambda w: F.translate(F.lower(F.btrim(w, F.lit(EDGE))), "’", "'"))
    return F.filter(bare, lambda w: w != "")


def norm_packet(text: Column) -> Column:
    """Lower case, apostrophes dropped, all but word characters and white space blanked, collapsed."""
    return flat(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "’'", ""), rf"[^\p{{L}}\p{{N}}_{SPACE}]", " "))


def plain(text: Column) -> Column:
    """Lower case, collapsed, apostrophes dropped."""
    return F.translate(F.lower(flat(text)), "'’", "")


def terms(text: Column) -> Column:
    """Lower-case terms: word characters with inner dots and hyphens."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), 0), F.lower)


def content_terms(text: Column, stop: Column, seen_upper: Column) -> Column:
    """Terms that are no stop words and have three characters, a digit, or were seen with a capital."""
    return let(seen_upper, lambda up: F.filter(terms(text), lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 3) | t.rlike(r"\p{Nd}") | F.array_contains(up, t))))


def upper_terms(text: Column) -> Column:
    """The lower-case forms of terms that stand somewhere with a capital."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), 0), lambda t: t.rlike(r"\p{Lu}"))
    return F.array_distinct(F.transform(found, F.lower))


def stems(text: Column, stop: Column) -> Column:
    """The first five characters of terms of four or more that are no stop words, each once."""
    kept = F.filter(terms(text), lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))
    return F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, 5)))


def _none() -> Column:
    return F.expr("cast(array() AS array<string>)")


def _runs(x: Column, n: int, sep: str) -> Column:
    """The runs of n neighbours of an array, by n - 1 passes over it: a slice for each run would copy the array each time."""
    out = x
    for k in range(1, n):
        out = F.zip_with(out, F.slice(x, k + 1, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.concat(a, F.lit(sep), b))
    return F.array_distinct(F.filter(out, lambda r: r.isNotNull()))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by a unit separator; shorter lists have none."""
    return let(words, lambda w: _runs(w, n, UNIT))


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct runs of n characters of the lower-case flat text; shorter texts have none."""
    return let(F.regexp_extract_all(F.lower(flat(text)), F.lit("(?s)."), 0), lambda x: _runs(x, n, ""))


def text_runs(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of each of the sizes of characters; of none, one empty run."""
    return let(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda x: F.flatten(F.array(_none(), *(_runs(x, n, "") if n else F.array(F.lit("")) for n in sizes))))


def paragraphs(text: Column, sep: str = r"\n[ \t]*\n") -> Column:
    """Stripped parts between separators, blank lines unless told otherwise, empty ones left out."""
    return F.filter(F.transform(F.split(text, sep), stripped), lambda x: x != "")


def removed(old: Column, new: Column) -> Column:
    """Parts of old that new lacks, each once, in order; the other way round they are the added ones."""
    return F.array_except(old, new)


def similarity(a: Column, b: Column) -> Column:
    """Shared words over the smaller set, times the root of the size ratio; 0.0 when either is empty."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    low, high = F.least(x, y), F.greatest(x, y)
    return F.when(low > 0, F.size(F.array_intersect(a, b)) / low * F.sqrt(low / high)).otherwise(0.0)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared over union of two arrays as sets; two empty ones give `empty`."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(empty)


def overlaps(added: Column, edits: Column, run: int = 6) -> Column:
    """Whether a paragraph shares a run of words with an edit, or a shorter one stands whole in an edit."""
    edit_words = F.transform(F.filter(edits, lambda e: e.isNotNull() & (e != "")), word_list)
    around = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    known = F.struct(F.flatten(F.transform(edit_words, lambda w: shingles(w, run))).alias("runs"), F.transform(edit_words, around).alias("whole"))
    found = lambda k, w: F.when(F.size(w) >= run, F.arrays_overlap(shingles(w, run), k["runs"])).otherwise((F.size(w) > 0) & F.exists(k["whole"], lambda j: F.contains(j, around(w))))
    return let(known, lambda k: F.exists(F.transform(added, word_list), lambda w: found(k, w)))


def cut(text: Column, spans: Column) -> Column:
    """The first place of each span, in order, becomes [pasted]."""
    at = lambda t, s: F.instr(t, s)
    put = lambda t, s: F.when((s != "") & (at(t, s) > 0), F.concat(F.substr(t, F.lit(1), at(t, s) - 1), F.lit("[pasted]"), F.substr(t, at(t, s) + F.length(s)))).otherwise(t)
    return F.aggregate(spans, text, put)


def last_words(text: Column, n: int) -> Column:
    """The last n words with single spaces between them."""
    w = split_words(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def first_words(text: Column, n: int) -> Column:
    """The first n words with single spaces between them; more follow where [...] stands."""
    w = split_words(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " [...]").otherwise(""))


def cap_words(text: Column, n: int) -> Column:
    """The last n words with the white space between them, none at the ends."""
    return F.regexp_extract(stripped(F.coalesce(text, F.lit(""))), rf"(?s)(?:{NWS}+{WS}+){{0,{n - 1}}}{NWS}*\z", 0)


def value(number: Column) -> Column:
    """A number without thousands separators and without a decimal part of zeros; otherwise as written."""
    bare = F.when(number.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(number, F.lit(","), F.lit(""))).otherwise(number)
    return F.when(bare.rlike(r"^\d+\.0*$"), F.substring_index(bare, ".", 1)).otherwise(bare)


def numbers(text: Column) -> Column:
    """The numbers of a text without dots and commas at their ends."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda n: F.regexp_replace(n, r"[.,]+$", ""))


def invented_numbers(new: Column, source: Column) -> Column:
    """The numbers of new whose value source does not hold; link targets do not count."""
    own = numbers(F.regexp_replace(new, r"\]\([^)]*\)", "]()"))
    return let(F.transform(numbers(source), value), lambda known: F.filter(own, lambda n: ~F.array_contains(known, value(n))))


def inline_spans(text: Column) -> Column:
    """The contents of inline code outside fences, white space collapsed, in order."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, FENCE, ""), F.lit(SPAN), 2), flat)


def link_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), 1)


def slug(title: Column) -> Column:
    """Lower-case letters, digits, underscores and hyphens; what else there is goes, then white space at the ends; spaces become hyphens."""
    return F.translate(F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\- ]", "")), " ", "-")


def pieces(quote: Column) -> Column:
    """The parts of a quote between bracketed gaps, empty ones left out."""
    return F.filter(F.transform(F.split(flat(quote), r"\[[^\]]*\]"), F.trim), lambda p: p != "")


def claim_tokens(text: Column, stop: Column) -> Column:
    """Distinct lower-case words and numbers, n't as not, without stop words but with negations."""
    found = F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("n't"), F.lit(" not")), F.lit(r"[a-z0-9][a-z0-9_'-]*"), 0)
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w) | w.isin(*NEGATIONS)))


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def uses_crlf(text: Column) -> Column:
    """Whether more lines end in CRLF than in LF alone."""
    both = F.regexp_count(text, F.lit("\r\n"))
    return both > F.regexp_count(text, F.lit("\n")) - both
