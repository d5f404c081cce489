"""Steps whose rows once grew faster than the input, held against brute force on small odd inputs."""

import hmac
import os
import random
import re
import sys
import time

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from proseloom.functions import markdown, tells  # noqa: E402
from proseloom.functions import text as T  # noqa: E402
from proseloom.operators import alike, records, scrub, triage  # noqa: E402


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_repetition_equals_brute_force_without_joins(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdeéß𝒳", k=r.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(3, 30))) for _ in range(150)]
    texts += [t + " once " + r.choice(words) for t in texts[:30]] + [" ".join(t.split()[::-1]) for t in texts[30:60]] + ["", "short"]
    rows = [(str(i), None if i == 7 else i // 2 if i < 20 else i, i % 13 == 5, t) for i, t in enumerate(texts)] + [("none", 9_000, None, None)]
    sets = [(i, k, {t[x : x + 5] for x in range(len(t) - 4)}) for i, k, s, t in ((i, k, s, " ".join((t or "").split()).lower()) for i, k, s, t in rows) if not s and k is not None]
    sets = [x for x in sets if len(x[2]) >= triage.GRAMS]
    want = {a[0] for a in sets for b in sets if b[1] < a[1] and len(a[2] & b[2]) / len(a[2] | b[2]) >= triage.SHARED}
    got = triage.repetition(spark.createDataFrame(rows, "id string, rank long, suggested boolean, words string"), "words")
    assert {x.id for x in got.collect()} == want and 20 < len(want) < len(sets)
    assert "Join" not in plan(got)


def test_runs_of_large_alphabets_are_exact():
    """More characters than five of them fit a 64-bit number with."""
    texts = ["".join(map(chr, range(0x4E00 + i, 0x4E00 + i + 9_000))) for i in range(3)] + ["abc", ""]
    at, runs, _ = alike.run_sets(texts, 5)
    assert np.diff(at).tolist() == [8_996, 8_996, 8_996, 0, 0]
    assert len(set(runs[: at[1]]) & set(runs[at[1] : at[2]])) == 8_995


def test_scrub_finds_runs_and_pieces_without_dealing_out_words(spark):
    texts = [("a", "Ünder\nThe hood_under  the\u200b"), ("b", "x\n\nthe HOOD; hoodwinked unhood"), ("c", None), ("d", ""), ("e", "e\u0301a one two three four five"), ("f", "İx hoodhood")]
    files = spark.createDataFrame(texts, "path string, text string")
    terms = ["ünder the", "under the", "hood", "the hood", "éa one two three", "one two three four five", "hood", None, "two  three"]
    got = scrub.term_findings(files, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = [("a", 1, "ünder the"), ("a", 2, "hood"), ("a", 2, "hood"), ("a", 2, "the hood"), ("a", 2, "under the"), ("b", 3, "hood"), ("b", 3, "hood"), ("b", 3, "the hood"), ("e", 1, "éa one two three")]
    assert sorted((r.path, r.line, r.ident) for r in got.collect()) == want
    listed = [("ünder the", False), ("hood", True), ("hood", False), ("win", True), ("éa one two three", False), ("ho", True)]
    for key in (b"key", b"k" * 80):
        known = spark.createDataFrame([(hmac.new(key, g.encode(), "sha256").hexdigest(), g + "!" * i, i) for g, i in listed], "digest string, id string, inside boolean")
        got = scrub.digest_findings(files, known, key)
        want = [("a", 1, "ünder the"), ("a", 2, "hood"), ("a", 2, "hood!"), ("b", 3, "hood"), ("b", 3, "hood!"), ("b", 3, "hood!"), ("b", 3, "hood!"), ("b", 3, "win!"), ("e", 1, "éa one two three"), ("f", 1, "hood!")]
        assert sorted((r.path, r.line, r.ident) for r in got.collect()) == want
        assert "Exchange" not in plan(got) and "Window" not in plan(got)


def test_rules_look_at_edges_only_where_a_first_letter_stands(spark):
    odd = ["it's\nIT'S énot just x, but y", "not just a, but b; _not only c, but d", "a, b, and c, d, and e", "ab, cd and ef, g and hi’s", "Énote that NOTE THAT notes that", "step 3 steps 4 tables٣ line\t5", "(?) the above see BELOW, see belows", "serves as boasts, xboasts boastsx", "", "𝒳not merely z, but a_b, c, and d"]
    d = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = lambda p: "(?d)" + tells.portable(p).replace(r"\b", tells.EDGE)
    for i, _, _, p in tells.RULES:
        bad = d.where(F.regexp_extract_all("t", F.lit(tells.java(p)), F.lit(0)) != F.regexp_extract_all("t", F.lit(plain(p)), F.lit(0)))
        assert bad.count() == 0, i
        assert not tells.java(p).replace("(?d)", "").replace("(?i)", "").startswith(tells.EDGE), i


def test_sentences_of_a_long_paragraph_in_time_and_as_before():
    def before(text):
        words = text.rstrip(markdown.CLOSERS).split()
        last = words[-1].lower() if words else ""
        return last not in markdown.ABBREVIATIONS and not re.fullmatch(r"[a-z]\.", last)

    r = random.Random(3)
    for _ in range(3_000):
        t = "".join(r.choices(["e.g.", "approx.", "xapprox.", "K.", "a.", " ", "\n", '"', ")", "’", "word.", "i.e.", "!", "İ."], k=r.randint(0, 6)))
        assert markdown._ends_sentence(t + "tail", len(t)) == before(t), t
    long = "One sentence. " * 20_000
    began = time.time()
    assert len(markdown.units(markdown.blocks(long)[0])) == 20_000 and time.time() - began < 5


def test_rows_of_markdown_leave_python_a_few_texts_at_a_time(spark):
    many = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("Say it. No "), F.col("id").cast("string"), F.lit(".\n\n- a | b\n- c"))).alias("t"))
    got = many.select(F.size(markdown.unit_rows("t")).alias("n"), F.size(markdown.change_rows("t", F.lit("Say it.\n\n- c"))).alias("c"), F.size(markdown.block_rows("t")).alias("b")).groupBy("n", "c", "b").count()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2, 0, 43), (4, 4, 2, 257)]
    assert "ArrowEvalPython" in plan(got) and "pandas" not in markdown._rows_of.__code__.co_names


def test_runs_held_equal_a_join_of_runs_without_dealing_out(spark):
    r = random.Random(8)
    make = lambda k: " ".join(r.choices(["It’s", "it's", "(ab", "AB)", "ΑΣ.", "ας", "—", "x-y", "\u00a0z", "q\u2003q"], k=k))
    docs = spark.createDataFrame([(i % 30, make(r.randint(0, 60)) if i != 3 else None) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, make(r.randint(0, 40))) for i in range(30)], "item_id long, text string")
    runs = lambda d, i: d.select(i, F.explode(T.shingles(T.norm_tokens(F.col("text")), 3)).alias("s"))
    bench = runs(items, "item_id")
    got = records.runs_held(docs, bench.collect(), 3)
    assert "Exchange" not in plan(got)
    want = sorted(tuple(x) for x in runs(docs, "doc_id").join(bench, "s").select("doc_id", "item_id").collect())
    assert sorted(tuple(x) for x in got.collect()) == want and want


def test_quotes_meet_texts_by_a_run_of_characters(spark, monkeypatch):
    texts = ["The pump's start at   noon and stop", "stop the pumps start 𝒳𝒳 at noon", "", None, "ab", "the pumps START [x] at noon", "ba ab"]
    quotes = ["The pump’s start [...] noon", "at noon [..] stop", "AB", "[...]", "'", "a [...] b", "𝒳𝒳 at", None, "nobody said it"]
    e = spark.createDataFrame([(i, i == 5, t) for i, t in enumerate(texts)], "id int, suggested boolean, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    want = [(0, 0), (0, 1), (1, 0), (2, 4), (2, 6), (4, 0), (4, 1), (4, 2), (4, 3), (4, 4), (4, 6), (5, 4), (5, 6), (6, 1)]
    for most in (100, 0):
        monkeypatch.setattr(triage, "QUOTES", most)
        got = triage.quoted_in(q, e)
        assert "NestedLoop" not in plan(got)
        assert sorted(tuple(r) for r in got.collect()) == want
