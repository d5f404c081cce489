"""Prose pattern rules: hits are counted on cleaned text, words on raw text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NWS, SPACE, WORD, WS

# Id, name, strength and pattern of each rule; results depend on every character of them.
RULES = [
    ("s1", "not X but Y", "strong", r"\bnot (?:just|only|merely|simply)\b[^.!?\n]{0,70}?,\s*but\b"),
    ("s1b", "it's not X, it's Y", "strong", r"\b(?:it's|it is|this isn't|these aren't)\b[^.!?\n]{0,50},\s*(?:it's|it is|they're)\b"),
    ("s2", "one-line closer", "strong", r"(?i)\b(?:that is the real win|read that again|let that sink in|and that'?s the point|that'?s the whole point|therein lies)\b"),
    ("s3", "saying that sounds deep", "strong", r"(?i)\b(?:at its core|the beauty of|the magic of|speaks volumes|lies at the heart)\b"),
    ("s4", "staged run-up", "strong", r"(?im)^\s*(?:here'?s the thing|let'?s be clear|make no mistake|the truth is|what'?s really)\b"),
    ("s5", "arguing with no one", "strong", r"(?im)^\s*(?:it'?s not that|this isn'?t about|nobody is saying|no one is claiming)\b"),
    ("s6", "forced triad", "weak", r"\b\w+, \w+,? and \w+\b"),
    ("s8", "em or en dash", "weak", r"[—–]"),
    ("s9", "stacked qualifier", "weak", r"(?i)\b(?:quite possibly|arguably one of|perhaps the most|one of the most)\b"),
    ("s12", "stock AI word", "strong", r"(?i)\b(?:delve|tapestry|testament|meticulous(?:ly)?|pivotal|showcase[sd]?|vibrant|interplay|intricate|intricacies|garner(?:ed|s)?|fostering|bolster(?:ed|s)?|deep dive|realm of)\b"),
    ("s13", "inflated significance", "strong", r"(?i)\b(?:plays? a (?:crucial|vital|key|pivotal) role|game.changer|stands? as a testament|cannot be overstated)\b"),
    ("s15", "shallow -ing rider", "strong", r",\s+(?:highlighting|underscoring|emphasi[sz]ing|reflecting|symboli[sz]ing|showcasing|fostering|cultivating|encompassing)\b"),
    ("s16", "sales language", "strong", r"(?i)\b(?:unlock(?:s|ing)? the|supercharge|effortless(?:ly)?|seamless(?:ly)?|next level|best-in-class|cutting.edge)\b"),
    ("s17", "borrowed authority", "strong", r"(?i)\b(?:experts? (?:say|argue|agree)|studies show|industry reports|it is widely (?:known|believed)|observers have)\b"),
    ("s18", "avoiding is and has", "weak", r"(?i)\b(?:serves as|stands as|functions as|boasts)\b"),
    ("s21", "curly quotes", "weak", r"[“”‘’]"),
    ("s22", "chatbot residue", "strong", r"(?i)\b(?:i hope this helps|great question|certainly!|feel free to|let me know if you)\b"),
    ("s23", "knowledge-limit disclaimer", "strong", r"(?i)\b(?:as of my (?:last|knowledge)|in the provided sources|it is believed that|while specific details)\b"),
    ("v1", "vague reference", "strong", r"(?i)\b(?:see (?:below|above)|as (?:described|discussed|mentioned|noted) (?:above|below|earlier|previously)|the (?:above|following)\b)"),
    ("v2", "named reference", "strong", r"(?i)\b(?:section|step|table|figure|line)s?\s+\d"),
    ("v3", "back-referring opener", "weak", r"(?m)^\s*(?:This|That|These|Those|It)\s+(?:is|was|means|gives|makes|shows|allows)\b"),
    ("v4", "additive connective", "weak", r"(?i)\b(?:also|additionally|moreover|furthermore|in addition)\b"),
    ("v5", "journey words", "strong", r"(?i)\b(?:we (?:found|fixed|solved|discovered)|turned out|it turns out|initially|previously|as it happens)\b"),
    ("v6", "hedge", "weak", r"(?i)\b(?:might|could potentially|perhaps|it seems|appears to be|likely that)\b"),
    ("v7", "note that", "strong", r"(?i)\b(?:note that|it'?s worth noting|importantly|keep in mind that)\b"),
    ("v8", "parenthetical gloss", "weak", r"\([^)]{12,}\)"),
    ("v9", "process vocabulary", "strong", r"(?i)\b(?:leverage[sd]?|utilize[sd]?|facilitate[sd]?|robust(?:ness)?|comprehensive|holistic|streamlin\w+)\b"),
    ("v10", "bold label opener", "weak", r"(?m)^\s*[-*]\s+\*\*[^*]{1,40}[.:]\*\*"),
]
# What is blanked before rules are counted: fenced code, inline code, link targets; and what stands in their place.
BLANKED = [(r"(?ms)^```.*?^```\s*?$", "\n"), (r"`[^`\n]+`", "`x`"), (r"\]\([^)\s]+\)", "](x)")]
# End of fixed values.

EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def portable(pattern: str) -> str:
    """The pattern with Unicode word characters, digits and white space spelled out; only its \b is left to the engine."""
    spaced = pattern.replace(r")\s]", f"){SPACE}]").replace(r"\s", WS)
    return spaced.replace(r"\w", WORD).replace(r"\d", r"\p{Nd}")


def _starts(alternatives: str) -> str | None:
    """The first characters of a pattern's alternatives, each in both cases; None if one does not begin with a letter."""
    depth, first, begins = 0, "", True
    for c in alternatives:
        if begins and not depth:
            if not c.isalpha():
                return None
            first, begins = first + c.lower() + c.upper(), False
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        begins = c == "|" and not depth
    return "".join(sorted(set(first)))


def _quick(pattern: str) -> str:
    r"""The pattern with a cheap test before each costly one: an edge before a letter is looked at only where one of the first letters
    stands, and runs of word characters that something else must follow do not give back what they took."""
    flags, edge, rest = re.match(r"(\(\?\w+\))?(\\b)?(.*)", pattern, re.S).groups()
    if not edge:
        return pattern
    if rest.startswith(r"\w+"):
        return (flags or "") + rf"(?<!{WORD})" + re.sub(r"\\w\+(?=, |,\?|\\b)", r"\\w++", rest)
    body = rest.removeprefix("(?:")
    first = _starts(body) if body != rest else _starts(rest[:1])
    return (flags or "") + (rf"(?=[{first}])(?<!{WORD})" if first else edge) + rest


def java(pattern: str) -> str:
    """The same for Spark: lines end at line feeds only, and a word's edge is stated, as it differs between Java versions."""
    return "(?d)" + portable(_quick(pattern)).replace(r"\b", EDGE)


def cleaned(text: Column) -> Column:
    """Text with code fences, inline code and link targets blanked out."""
    for pattern, put in BLANKED:
        text = F.regexp_replace(text, java(pattern), put)
    return text


def words(text: Column) -> Column:
    """Runs between white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NWS}+")), F.lit(0))
