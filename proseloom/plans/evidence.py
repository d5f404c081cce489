"""Queries of operators.evidence over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NWS, SPACE, WS, flat, split_words
from ..operators import evidence as E

STAMP = "((turn - turn % 3) * 1500 + conv_id % 7)"
_RUNS = "SELECT user_id, event_id % 4 AS run, event_type AS claim, CASE WHEN event_id % 3 = 0 THEN 'FALSE' WHEN event_id % 5 = 0 THEN 'UNVERIFIABLE' ELSE 'TRUE' END AS verdict FROM events"
_READ = "SELECT doc_id % 60 AS episode, lang AS entity, source AS key FROM documents WHERE doc_id % 60 {}"
_DECIDED = "SELECT CASE WHEN n_chars > 1500 THEN 'long' WHEN doc_id % 3 = 0 THEN lang ELSE 'kept' END || ':' || source AS reason, n_chars > 800 AS lengthy, lang = 'en' AS english, doc_id % 7 = 0 AS seventh, doc_id % 3 = 0 AS candidate FROM documents"
_PAIRS = "SELECT CASE doc_id % 5 WHEN 0 THEN {0}('exact', 'commit'{1} WHEN 1 THEN {0}('literal'{1} WHEN 2 THEN {0}('final', 'final', 'label-only'{1} WHEN 3 THEN {0}('commit'{1} END AS pairs FROM documents"
_QUOTES = "SELECT doc_id AS episode, CASE doc_id % 4 WHEN 0 THEN '  ' || substring(text, 30, 40) || '!' WHEN 1 THEN 'no such words zz' WHEN 2 THEN '' ELSE substring(text, 1, 60) END AS quote, CASE WHEN doc_id % 8 = 0 THEN 'p1' WHEN doc_id % 16 = 4 THEN 'p9' END AS before_ref, '' AS after_ref FROM documents"
_PACKETS = "SELECT CASE WHEN lang = 'fr' AND doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS episode, text AS words, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS seen, {0}(CASE WHEN doc_id % 7 = 3 THEN text ELSE 'other' END{1} AS pasted, {0}('p1', 'p2'{1} AS pairs FROM documents"


def _on(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {d}"), d=spark.read.parquet(f"{sf}/{name}.parquet"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def verdict_stability(spark: SparkSession, sf: str) -> DataFrame:
    return E.stability(_on(spark, sf, _RUNS, "events"), "user_id", "run", "claim", "verdict")


def reader_agreement(spark: SparkSession, sf: str) -> DataFrame:
    ids = _on(spark, sf, "SELECT DISTINCT doc_id % 70 AS episode FROM documents", "documents")
    return E.reader_agreement(ids, *(_on(spark, sf, _READ.format(x), "documents") for x in ("NOT IN (7, 8)", "<> 9 AND doc_id % 3 <> 0")))


def decision_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return E.reason_counts(_on(spark, sf, _DECIDED, "documents"))


def signal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.signal_counts(_on(spark, sf, _DECIDED, "documents"), ["lengthy", "english", "seventh"], "candidate")


def pair_quality(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_quality(_on(spark, sf, _PAIRS.format("array", ")"), "documents"))


def repeated_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The reading order runs backwards through the ids, so the owner is not the smallest."""
    s = _lines(spark, sf).select("doc_id", (-F.col("doc_id") * 100_000 + F.col("pos")).alias("place"), F.lower(flat(F.col("line"))).alias("s")).where(F.size(split_words(F.col("s"))) >= 3)
    return E.repeated_sentences(s, "doc_id", "place", "s").select("doc_id", "owner", F.md5("s").alias("sentence"))


def passage_runs(spark: SparkSession, sf: str) -> DataFrame:
    u = _lines(spark, sf).select("doc_id", "pos", (F.length("line") % 3 != 0).alias("new"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    return E.passage_runs(u, ["doc_id"], "pos", "new", "words")


def source_budget(spark: SparkSession, sf: str) -> DataFrame:
    s = _on(spark, sf, "SELECT user_id, event_id, event_id % 5000 AS size FROM events", "events")
    return E.within_budget(s, "user_id", "event_id", "size", 3000, 20000)


def heading_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return E.anchors(_lines(spark, sf).select("doc_id", "pos", F.concat("line", F.when(F.col("pos") % 3 == 0, " (*)").otherwise("")).alias("title")), "doc_id", "pos", "title").select("doc_id", "pos", "anchor")


def exact_unit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The new text is the old one backwards, less each fourth line."""
    u = _lines(spark, sf)
    return E.exact_pairs(u, u.where("pos % 4 <> 2").withColumn("pos", -F.col("pos")), "doc_id", "line", "pos")


def commit_slack(spark: SparkSession, sf: str) -> DataFrame:
    i = _on(spark, sf, f"SELECT conv_id, turn, {STAMP} AS begin_at, {STAMP} + 1500 AS end_at FROM conversations WHERE role = 'user'", "conversations")
    c = _on(spark, sf, "SELECT event_id * 7 AS commit_at FROM events WHERE event_type = 'purchase'", "events")
    return E.commits_with_slack(i, c, "begin_at", "end_at", "commit_at").groupBy("conv_id", "turn").agg(F.count("*").alias("commits"), F.min("commit_at").alias("first_at"), F.max("commit_at").alias("last_at"))


def checked_points(spark: SparkSession, sf: str) -> DataFrame:
    return E.checked_points(_on(spark, sf, _QUOTES, "documents"), _on(spark, sf, _PACKETS.format("array", ")"), "documents")).select("episode", "why")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (verdict_stability, reader_agreement, decision_reasons, signal_counts, pair_quality, repeated_sentences, passage_runs, source_budget, heading_anchors, exact_unit_pairs, commit_slack, checked_points)}

_L = "(SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_WS, _IN = WS.replace("{", "{{").replace("}", "}}"), SPACE.replace("{", "{{").replace("}", "}}")
_FLAT = "trim(regexp_replace(coalesce({}, ''), '" + _WS + "+', ' ', 'g'))"
_NORM = r"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce({}, '')), '’', ''), '''', ''), '[^\p{{L}}\p{{N}}_" + _IN + "]', ' ', 'g'), '" + _WS + "+', ' ', 'g'))"
_HELD = "(SELECT episode, list(DISTINCT entity) AS e, list(DISTINCT key) AS k FROM ({}) GROUP BY episode)"
_SHARE = "round(avg(CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN len(list_intersect(a.{0}, b.{0})) / len(list_distinct(list_concat(a.{0}, b.{0}))) END), 3)"
SQL: dict[str, str] = {
    "verdict_stability": f"WITH v AS ({_RUNS}), n AS (SELECT user_id, count(DISTINCT run) AS runs FROM v GROUP BY 1), o AS (SELECT user_id, claim, count(DISTINCT CASE WHEN verdict <> 'TRUE' THEN run END) AS k FROM v GROUP BY ALL) SELECT user_id, max(runs) AS runs, count(*) AS claims, count(*) FILTER (k = runs) AS always, count(*) FILTER (k > 0 AND k < runs) AS sometimes, count(*) FILTER (k = 0) AS never, CAST(sum(k) AS BIGINT) AS reverted_slots, CAST(sum(runs) AS BIGINT) AS slots FROM o JOIN n USING (user_id) GROUP BY user_id",
    "reader_agreement": f"""SELECT count(*) AS packets, count(*) FILTER ((a.e IS NULL) = (b.e IS NULL)) AS found_agree, count(*) FILTER (a.e IS NOT NULL AND b.e IS NOT NULL) AS both_found, {_SHARE.format('e')} AS entity_overlap, {_SHARE.format('k')} AS key_overlap,
count(*) FILTER (a.e IS NOT NULL AND b.e IS NULL) AS only_first, count(*) FILTER (a.e IS NULL AND b.e IS NOT NULL) AS only_second FROM (SELECT DISTINCT doc_id % 70 AS episode FROM documents) p LEFT JOIN {_HELD.format(_READ.format('NOT IN (7, 8)'))} a USING (episode) LEFT JOIN {_HELD.format(_READ.format('<> 9 AND doc_id % 3 <> 0'))} b USING (episode)""",
    "decision_reasons": f"SELECT split_part(reason, ':', 1) AS reason, count(*) AS records FROM ({_DECIDED}) GROUP BY 1",
    "signal_counts": " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER ({s}) AS episodes, count(*) FILTER ({s} AND candidate) AS candidates FROM ({_DECIDED})" for s in ("lengthy", "english", "seventh")),
    "pair_quality": f"""WITH d AS ({_PAIRS.format("list_value", ")")}), b AS (SELECT coalesce(pairs[1], 'none') AS q, count(*) AS n FROM d GROUP BY 1), e AS (SELECT q, count(*) AS n FROM (SELECT unnest(pairs) AS q FROM d) GROUP BY 1)
SELECT o.q AS pair_quality, coalesce(b.n, 0) AS best, coalesce(e.n, 0) AS every FROM (VALUES {', '.join(f"('{q}')" for q in E.QUALITIES)}) o(q) LEFT JOIN b USING (q) LEFT JOIN e USING (q)""",
    "repeated_sentences": f"WITH s AS (SELECT DISTINCT doc_id, lower({_FLAT.format('line')}) AS s FROM {_L} WHERE len(regexp_extract_all(line, '{NWS}+')) >= 3), o AS (SELECT s, max(doc_id) AS owner FROM s GROUP BY s) SELECT doc_id, owner, md5(s) AS sentence FROM s JOIN o USING (s) WHERE owner <> doc_id",
    "passage_runs": rf"WITH u AS (SELECT doc_id, pos, length(line) % 3 <> 0 AS new, len(regexp_extract_all(line, '\S+')) AS words FROM {_L}), r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, new ORDER BY pos) AS run FROM u) SELECT doc_id, min(pos) AS start, max(pos) AS stop, count(*) AS units, CAST(sum(words) AS BIGINT) AS words FROM r WHERE new GROUP BY doc_id, run HAVING sum(words) >= 8",
    "source_budget": "WITH s AS (SELECT user_id, event_id, event_id % 5000 AS size, least(event_id % 5000, 3000) AS own FROM events), r AS (SELECT *, sum(own) OVER (PARTITION BY user_id ORDER BY event_id) - own AS used FROM s) SELECT user_id, event_id, size, CAST(least(own, 20000 - used) AS BIGINT) AS sent FROM r WHERE used < 20000",
    "heading_anchors": rf"WITH h AS (SELECT doc_id, pos, replace(trim(regexp_replace(lower(line || CASE WHEN pos % 3 = 0 THEN ' (*)' ELSE '' END), '[^\p{{L}}\p{{N}}_\- ]', '', 'g')), ' ', '-') AS s FROM {_L}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) - 1 AS n FROM h) SELECT doc_id, pos, CASE WHEN n = 0 THEN s ELSE s || '-' || n END AS anchor FROM n",
    "exact_unit_pairs": f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM {_L}), n AS (SELECT doc_id, line, -pos AS pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY -pos) AS k FROM {_L} WHERE pos % 4 <> 2) SELECT o.doc_id, o.pos AS old_pos, n.pos AS new_pos FROM o JOIN n USING (doc_id, line, k)",
    "commit_slack": f"SELECT conv_id, turn, count(*) AS commits, min(event_id * 7) AS first_at, max(event_id * 7) AS last_at FROM conversations c JOIN events e ON e.event_id * 7 >= {STAMP} AND e.event_id * 7 < {STAMP} + 3300 WHERE role = 'user' AND event_type = 'purchase' GROUP BY conv_id, turn",
    "checked_points": f"""WITH p AS (SELECT episode, {_NORM.format('words')} AS w, {_NORM.format('seen')} || ' ' || array_to_string(list_transform(pasted, lambda x: {_NORM.format('x')}), ' ') AS s, pairs FROM ({_PACKETS.format('list_value', ')')})), q AS (SELECT *, {_NORM.format('quote')} AS n FROM ({_QUOTES}))
SELECT episode, CASE WHEN w IS NULL THEN 'packet' WHEN n = '' OR NOT contains(w, n) THEN 'words' WHEN contains(s, n) THEN 'seen' WHEN coalesce(before_ref, '') <> '' AND NOT list_contains(pairs, before_ref) THEN 'pair' ELSE '' END AS why FROM q LEFT JOIN p USING (episode)""",
}
