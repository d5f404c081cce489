"""Operators that SQL does not express, and rules whose outcome is known by hand."""

import json
import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from proseloom.functions import html, markdown  # noqa: E402
from proseloom.functions import text as T  # noqa: E402
from proseloom.operators import admission, guards, packets, rulebase, triage, verdicts  # noqa: E402
from proseloom.sources import transcripts  # noqa: E402
from proseloom.streaming import edits  # noqa: E402

DOC = "---\ntitle: x\n---\n\n# Head\n\nOne sentence here. Two e.g. this. `a. b` three!\nstill para\n\n- item one\n- item two\n  goes on\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n\nmore\n```\n\n> quote\n\nSet\n===\n\n<div>\nx\n</div>\n\n    deep\n\n---\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_blocks_and_units():
    assert [b.kind for b in markdown.blocks(DOC)] == ["other", "heading", "paragraph", "list", "table", "code", "quote", "heading", "html", "code", "rule"]
    assert all(DOC[b.start : b.end] == b.text for b in markdown.blocks(DOC))
    us = [u for b in markdown.blocks(DOC) if b.kind in markdown.PROSE for u in markdown.units(b)]
    assert [u.key for u in us] == ["One sentence here.", "Two e.g. this.", "`a. b` three! still para"[:13], "still para", "item one", "item two goes on"] and all(DOC[u.start : u.end] for u in us)


def test_changes_and_passages():
    old = "The pump starts at noon and stops at one.\n\nMoved text stays.\n\nIt is old."
    new = "Moved text stays.\n\nThe pump starts at noon and stops at two.\n\nA whole new sentence with at least eight words in it."
    kinds = {(c["kind"], c["number"]) for c in markdown.changes(old, new)}
    assert kinds == {("same", 0), ("added", 1), ("added", 2), ("removed", 0)}  # rewordings pair within their own region
    there = [(c["kind"], c["old"]) for c in markdown.changes("One. The pump starts at noon.", "One. The pump starts at two.")]
    assert there == [("same", "One."), ("changed", "The pump starts at noon.")]
    assert [p["text"] for p in markdown.changed_passages(old, new)] == ["The pump starts at noon and stops at two.", "A whole new sentence with at least eight words in it."]
    assert markdown.changed_passages(new, new) == [] and markdown.splice("abcd", [(0, 1), (2, 3)], ["X", "YY"]) == "XbYYd"


def test_edit_state(spark):
    added = "Nine new words that one edit put into this file."
    rows = [("s", "f", 1.0, 0, "pre", "Old text.", None, None, None), ("s", "f", 2.0, 0, "post", f"Old text.\n\n{added}", None, None, None), ("s", "f", 3.0, 0, "stop", f"Old text.\n\n{added}", None, None, None)]
    rows += [("s", "f", 4.0 + i, 0, "settle", f"Old text.\n\n{added}", [added], "retry", 1.5) for i in range(3)] + [("s", "f", 90_000.0, 0, "settle", "", None, "done", 1.0)]
    df = spark.createDataFrame(rows, "session string, file string, at double, seq int, event string, text string, keys array<string>, outcome string, since double")
    got = [(r.units, r.passages, r.edited) for r in edits.replayed(df).orderBy("at").collect()]
    assert got == [(1, [added], False), (1, [], True), (1, [], True), (0, [], True), (0, [], False)]


def test_html_paragraphs():
    page = "<title>T</title><p>a <b>b</b>&amp;<br>c<script>var x='<p>'</script> d<svg><p>no</p></svg></p><div>e\n f</div>"
    assert html.paragraphs_of(page) == ["T", "a b&", "c d", "e f"]


def test_transcript_records(spark, tmp_path):
    def line(**k):
        return json.dumps(k)

    base = {"uuid": "u1", "sessionId": "s1", "timestamp": "2026-08-01T09:00:00.000Z"}
    call = {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "a/B.MD", "old_string": "x", "new_string": "y"}}
    publish = {"type": "tool_use", "id": "t2", "name": "Artifact", "input": {"label": "v1", "file_path": "p.html"}}
    lost = {"type": "tool_use", "id": "t3", "name": "Artifact", "input": {"label": "v2"}}
    rows = [line(type="user", message={"role": "user", "content": "typed é"}, promptSource="typed", origin={"kind": "human"}, **base), line(type="assistant", message={"content": [{"type": "text", "text": "a reply"}, {"type": "text", "text": " "}, call, publish, lost]}, **{**base, "uuid": "u2"}), line(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t2", "content": "done at https://h/x (Version 2)"}]}, **{**base, "uuid": "u3"}), line(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "no. the user said:\nnot like this"}], "is_error": True}]}, **{**base, "uuid": "u4"}), '{"type": "user", "half']
    os.makedirs(tmp_path / "p" / "s2")
    (tmp_path / "p" / "s1.jsonl").write_text("\n".join(rows))
    (tmp_path / "p" / "s2.jsonl").write_text(line(type="user", message={"content": "typed é"}, promptSource="typed", origin={"kind": "human"}, forkedFrom={"sessionId": "s1", "messageUuid": "u1"}, uuid="v1", sessionId="s2", timestamp="2026-08-01T09:00:00.000Z") + "\n")
    found = transcripts.parsed(transcripts.lines(spark, str(tmp_path)))
    assert [r.bad for r in transcripts.bad_lines(found).orderBy("bad").collect()] == [0, 1]
    b = transcripts.based(found)
    people = transcripts.humans(b)
    assert people.count() == 2 and {r.origin_uuid for r in people.collect()} == {"u1"}
    assert [(r.session, r.text) for r in transcripts.extracted(people).collect()] == [("s1", "typed é")]
    assert [r.text for r in transcripts.replies(b).collect()] == ["a reply"]
    c, came = transcripts.calls(b), transcripts.results(b)
    assert [(r.kind, r.text) for r in transcripts.written(c).collect()] == [("markdown", "y")]
    assert [(r.method, r.old, r.new) for r in transcripts.edits(c).collect()] == [("Edit", "x", "y")]
    assert {(r.text, r.url, r.refused) for r in transcripts.publishes(c, came).collect()} == {("v1", "https://h/x", False), ("v2", "", None)}
    assert [(r.text, r.tool) for r in transcripts.rejections(c, came).collect()] == [("not like this", "Edit")]


def test_scalars(spark):
    assert one(spark, admission.revert_cap(F.lit(63))) == 16 and one(spark, admission.revert_cap(F.lit(6))) == 3 and one(spark, admission.revert_cap(F.lit(2))) == 8
    assert one(spark, T.slug(F.lit("Set up: it? (*)"))) == "set-up-it"
    assert one(spark, F.size(T.split_words(F.lit("a b c d")))) == 4
    assert one(spark, T.norm_tokens(F.lit("“It’s” (well-known) — x."))) == ["it's", "well-known", "x"]
    assert one(spark, T.cap_words(F.lit("a b\nc  d "), 2)) == "c  d" and one(spark, T.cut(F.lit("a b a"), F.array(F.lit("a")))) == "[pasted] b a"
    assert one(spark, T.overlaps(F.array(F.lit("two words")), F.array(F.lit("here are two words now")))) is True
    assert one(spark, guards.trailer(F.lit("Fix\n\nbody\n\nSigned-off-by: x\nKey: y\n"))) == "Signed-off-by: x\nKey: y\n"
    assert one(spark, triage.apply_slips(F.lit("the reed me file"), [("reed me", "readme", False), ("file", "text", True)])) == "the readme text"
    pairs = spark.createDataFrame([([("final", "1"), ("exact", "2"), ("odd", "3"), ("exact", "4")],)], "p array<struct<quality:string,before:string>>")
    assert [x.before for x in pairs.select(packets.best_pairs(F.col("p")).alias("p")).first().p] == ["2", "4", "1"]
    reply = spark.createDataFrame([(1, '{"verdicts": [{"id": 1, "verdict": "TRUE"}]}'), (2, '{"verdicts": [{"id": 1}, {"id": 1}]}'), (3, "[]"), (4, "{}")], "run int, reply string")
    assert {r.run: r.problem for r in verdicts.parsed(reply).collect()} == {1: "", 2: "an id answered twice", 3: "not an object", 4: "no verdicts"}
    base = spark.createDataFrame([("a.md", 0, "# T\n- {#a.b refines=c.d} One. {#c.d} Two words.\nloose")], "path string, pos int, text string")
    assert [(r.id, r.refines, r.line, r.text, r.position) for r in rulebase.rules_in(base).orderBy("position").collect()] == [("a.b", ["c.d"], 2, "One.", 0), ("c.d", [], 2, "Two words.", 1)]
    assert [r.line for r in rulebase.bad_lines(base).collect()] == [3]
