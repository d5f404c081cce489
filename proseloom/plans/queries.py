"""The registered queries over the driver's tables, each with the SQL that states what it must return.

Both sides derive their inputs from the same columns: documents get sentences that fire the rules, conversations
stand for sessions (conv_id the session, turn the order, a stamp of 25 minutes a turn with ties).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tells import RULES, portable
from ..operators import admission as A
from ..operators import rates as R
from ..operators import records as S
from . import evidence, prose

Query = Callable[[SparkSession, str], DataFrame]

SPIKED = """CASE WHEN doc_id % 7 = 0 THEN text || ' It plays a pivotal role — seamlessly. Note that this might help (an aside of some length).'
 WHEN doc_id % 11 = 0 THEN text || chr(10) || 'This is not just slow, but wrong. Here''s a list: red, green, and blue. See below.'
 WHEN doc_id % 13 = 0 THEN text || chr(10) || '- **Label:** as described above, step 3 serves as proof; we found `code — x` in [link](http://a—b).'
 WHEN doc_id % 17 = 0 THEN text || chr(10) || '```' || chr(10) || 'delve — into' || chr(10) || '```' || chr(10) || 'Moreover, studies show it.' ELSE text END"""
STAMP = "((turn - turn % 3) * 1500 + conv_id % 7)"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spiked(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "lang", F.expr(SPIKED).alias("text"))


# RE2, the SQL engine's, knows word edges between ASCII letters only: accented ones become z where rules are counted. Spark states the edge.
_RATE_SQL = """WITH t AS ({base}), p AS (SELECT g, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?ms)^```.*?^```\\s*?$', chr(10), 'g'), '`[^`\\n]+`', '`x`', 'g'), '\\]\\([^)\\s]+\\)', '](x)', 'g'), '[À-ÖØ-öø-ÿĀ-ɏ]', 'z', 'g') AS prose FROM t),
s AS (SELECT g, sum(len(regexp_extract_all(text, '{nws}+'))) AS words, {sums} FROM p GROUP BY g),
u AS (SELECT g, words, unnest([{rows}]) AS r FROM s)
SELECT g AS {group}, r.rule AS rule, CAST(r.hits AS BIGINT) AS hits, CAST(words AS BIGINT) AS words, CASE WHEN words > 0 THEN 1000.0::DOUBLE * r.hits / words ELSE 0.0 END AS per_1000 FROM u"""


def _rate_sql(base: str, group: str) -> str:
    quoted = [(i, portable(p).replace("'", "''")) for i, _, _, p in RULES]
    sums = ", ".join(f"sum(len(regexp_extract_all(prose, '{p}'))) AS {i}" for i, p in quoted)
    rows = ", ".join(f"{{'rule': '{i}', 'hits': {i}}}" for i, *_ in RULES)
    return _RATE_SQL.format(nws=T.NWS, base=base, sums=sums, rows=rows, group=group)


def tell_rates_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return R.rates(_spiked(spark, sf), "lang")


def tell_rates_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return R.rates(_t(spark, sf, "conversations"), "role")


def tell_rates_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the texts of one half-open window; the stamp is made of the id, and empty for some."""
    stamp = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-01T00:00:00Z")))
    return R.rates(_spiked(spark, sf).where(R.half_open(stamp, "2024-03-01", "2024-07-01")), "lang")


def tell_rates_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the texts of one window of days, both ends included; an empty stamp passes."""
    stamp = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-01T00:00:00Z")))
    return R.rates(_spiked(spark, sf).where(R.inside(stamp, "2024-03-01", "2024-07-01")), "lang")


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.kind_counts(_t(spark, sf, "documents"), "lang", "text")


def paragraph_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as paragraphs; the new text moves the first to the end, drops one and adds one."""
    old = T.paragraphs(F.col("text"), "\n")
    d = _t(spark, sf, "documents").select("doc_id", old.alias("old"))
    d = d.withColumn("new", F.concat(F.expr("filter(old, (x, i) -> i > 0 AND i <> 2)"), F.expr("slice(old, 1, 1)"), F.array(F.concat(F.lit("added "), F.col("doc_id").cast("string")))))
    return d.select("doc_id", F.size(T.removed(F.col("old"), F.col("new"))).cast("bigint").alias("n_removed"), F.size(T.removed(F.col("new"), F.col("old"))).cast("bigint").alias("n_added"), F.array_join(T.removed(F.col("old"), F.col("new")), "|").alias("removed"))


#: Runs of the benchmark that every task holds; more are joined by shuffles.
BENCHMARK_RUNS = 1_000_000


def shingle_overlap_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct six-word runs that each document shares with each benchmark item: looked up where the document is, joined by the run where the benchmark is large."""
    runs = lambda d, i: d.select(i, T.norm_tokens(F.col("text")).alias("w")).select(i, F.explode(T.shingles(F.col("w"), 6)).alias("s"))
    bench = runs(_t(spark, sf, "benchmark"), "item_id")
    few = bench.limit(BENCHMARK_RUNS + 1).collect()
    docs = _t(spark, sf, "documents")
    found = S.runs_held(docs, few, 6) if len(few) <= BENCHMARK_RUNS else runs(docs, "doc_id").join(bench, "s").select("doc_id", "item_id")
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each reply's word similarity to the turn before it in its conversation."""
    from pyspark.sql import Window

    c = _t(spark, sf, "conversations").select("conv_id", "turn", T.norm_tokens(F.col("text")).alias("w"))
    c = c.withColumn("prev", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev IS NOT NULL")
    return c.select("conv_id", "turn", F.round(T.similarity(F.col("w"), F.col("prev")), 9).alias("similarity"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn twice in some conversations, as a forked copy in a later file."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.expr(STAMP).alias("at"))
    return c.withColumn("file", F.lit(0)).unionAll(c.where("conv_id % 3 = 0").withColumn("file", F.lit(1)))


def records_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return S.kind_counts(_records(spark, sf), "role", "text")


def record_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_copies(_records(spark, sf), ["conv_id", "turn", "role"], ["file"]).select("conv_id", "turn", "role", "file")


_SENT = f"(SELECT conv_id, turn, text, {STAMP} AS sent FROM conversations UNION ALL SELECT conv_id, turn + 1000, text, {STAMP} + turn * 900 FROM conversations WHERE conv_id % 2 = 0)"


def resend_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts; every second conversation's turns are sent again, some of them within the hour."""
    c = spark.sql(f"SELECT * FROM {_SENT}".replace("FROM conversations", "FROM {d}"), d=_t(spark, sf, "conversations"))
    return S.without_resends(c, "conv_id", "text", "sent", ["turn"]).select("conv_id", "turn", "sent")


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return S.intervals(_t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(STAMP).cast("bigint").alias("at")), "conv_id", "at")


def interval_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Replies at or after each input and before the next distinct input of its session."""
    replies = _t(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", F.expr(STAMP).cast("bigint").alias("reply_at"))
    return S.in_interval(_inputs(spark, sf), replies, "conv_id", "at", "reply_at").groupBy("conv_id", "turn", "at", "stop", "before").agg(F.count("*").alias("replies"))


def asof_publish(spark: SparkSession, sf: str) -> DataFrame:
    """The last successful publish (a reply of an even turn count) at or before each input."""
    inputs = _t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(STAMP).alias("at"))
    pubs = _t(spark, sf, "conversations").where("role = 'assistant' AND length(text) % 3 <> 0").select("conv_id", F.expr(STAMP).alias("pub_at"), F.col("turn").alias("version"))
    return S.as_of(inputs, pubs, "conv_id", "at", "pub_at", "version")


def asof_doc(spark: SparkSession, sf: str) -> DataFrame:
    """The last reply strictly before each input."""
    inputs = _t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(STAMP).alias("at"))
    docs = _t(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", F.expr(STAMP).alias("doc_at"), F.col("turn").alias("version"))
    return S.as_of(inputs, docs, "conv_id", "at", "doc_at", "version", strict=True)


def first_use_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations").where("role = 'user'").select("conv_id", T.word_list(F.col("text")).alias("w"))
    return S.first_uses(c, "w", "conv_id", "conv_id").groupBy("conv_id").agg(F.count_distinct("term").alias("new_terms"))


_POINTS = """SELECT 'k' || CAST(doc_id % 23 AS STRING) AS key, CASE WHEN doc_id % 4 = 0 THEN 'no' WHEN doc_id % 4 = 1 THEN 'partly' ELSE 'yes' END AS is_writing,
 source AS session, lang AS project, CAST(n_chars % 5 AS STRING) AS day, CASE WHEN doc_id % 97 = 3 THEN 'conflict' ELSE 'supports' END AS relation, CAST(doc_id AS STRING) AS episode FROM documents"""
_CANDIDATES = [("r1", ["k1", "k2"], "Say the plain word."), ("r2", ["k3"], "No dash — here."), ("r3", ["k5", "k6"], "Use `code` names."), ("r4", ["k99"], "Nobody asked for this."), ("r5", ["k7"], "Dated 2024-01-02."), ("r6", ["k8"], "Keep 3 of them."), ("r7", ["k11", "k12"], "One idea a sentence.")]
_CANDIDATES_SQL = "(VALUES " + ", ".join("('%s', [%s], '%s')" % (i, ", ".join(f"'{k}'" for k in ks), x) for i, ks, x in _CANDIDATES) + ") c(id, keys, text)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_POINTS.replace("FROM documents", "FROM {d}"), d=_t(spark, sf, "documents"))


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CANDIDATES, "id string, keys array<string>, text string")


def admission_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return A.decisions(_candidates(spark), _points(spark, sf))


def unclaimed_points(spark: SparkSession, sf: str) -> DataFrame:
    return A.unclaimed(_points(spark, sf), _candidates(spark)).select("episode", "key")


def assigner_agreement(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "labels")
    a = d.select("doc_id", F.filter(F.array(F.when(F.col("quality") == 1, "q"), F.when(F.col("toxic") == 1, "t")), lambda x: x.isNotNull()).alias("s"))
    b = d.where("doc_id % 10 <> 0").select("doc_id", F.filter(F.array(F.when(F.col("quality") == 1, "q"), F.when(F.col("doc_id") % 9 == 0, "t")), lambda x: x.isNotNull()).alias("s"))
    return A.agreement(a, b, "doc_id", "s")


_VERDICTS = """SELECT doc_id % 40 AS run, CASE WHEN doc_id % 211 = 0 THEN 'OMITTED' WHEN quality = 0 AND doc_id % 3 = 0 THEN 'UNVERIFIABLE' ELSE 'TRUE' END AS verdict,
 CASE WHEN doc_id % 211 = 0 OR (quality = 0 AND doc_id % 3 = 0) THEN 'UNVERIFIABLE' WHEN toxic = 1 THEN 'FALSE' WHEN doc_id % 7 = 0 THEN 'SAME' WHEN doc_id % 7 = 1 THEN 'ORIGINAL' ELSE 'TRUE' END AS effective,
 CASE WHEN doc_id % 5 = 0 THEN 'outside_repo' WHEN doc_id % 5 = 1 THEN 'not_found' END AS reason_code, doc_id % 53 < 2 AS probe, doc_id % 40 % 4 AS turns FROM labels"""


def run_refusal(spark: SparkSession, sf: str) -> DataFrame:
    return A.refusals(spark.sql(_VERDICTS.replace("FROM labels", "FROM {d}"), d=_t(spark, sf, "labels")), "run")


def metric_shares(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_type", (F.col("event_id") % 50).alias("sent"), (F.col("event_id") % 7).alias("changed"))
    return A.shares(e, "event_type", "changed", "sent")


def revert_caps(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", A.revert_cap(F.col("doc_id") % 125).alias("cap"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (tell_rates_by_lang, tell_rates_by_role, tell_rates_windowed, tell_rates_inclusive, word_counts, paragraph_diff, shingle_overlap_benchmark, token_similarity, records_by_kind, record_dedupe, resend_suppression, interval_episodes, asof_publish, asof_doc, first_use_terms, admission_decisions, unclaimed_points, assigner_agreement, run_refusal, metric_shares, revert_caps)}

_WORDS = r"regexp_extract_all(replace(lower(text), '’', ''''), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*')"
_EDGE = T.EDGE.replace("'", "''")
_TOKENS = f"list_filter(list_transform(regexp_extract_all(text, '{T.NWS}+'), lambda w: replace(lower(trim(w, '{_EDGE}')), '’', '''')), lambda w: w <> '')"
_REC = f"(SELECT conv_id, turn, role, text, {STAMP} AS \"at\", 0 AS file FROM conversations UNION ALL SELECT conv_id, turn, role, text, {STAMP}, 1 FROM conversations WHERE conv_id % 3 = 0)"
_IN = f"(SELECT conv_id, turn, CAST({STAMP} AS BIGINT) AS \"at\" FROM conversations WHERE role = 'user')"


def _runs(i: str, t: str) -> str:
    return f"(SELECT {i}, unnest(list_distinct(list_transform(range(1, len(w) - 4), lambda k: array_to_string(w[k:k + 5], chr(31))))) AS s FROM (SELECT {i}, {_TOKENS} AS w FROM {t}))"


SQL: dict[str, str] = {
    "tell_rates_by_lang": _rate_sql(f"SELECT lang AS g, {SPIKED} AS text FROM documents", "lang"),
    "tell_rates_by_role": _rate_sql("SELECT role AS g, text FROM conversations", "role"),
    "tell_rates_windowed": _rate_sql(f"SELECT lang AS g, {SPIKED} AS text FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 9 + 1 BETWEEN 3 AND 6", "lang"),
    "tell_rates_inclusive": _rate_sql(f"SELECT lang AS g, {SPIKED} AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 9 + 1 BETWEEN 3 AND 7", "lang"),
    "word_counts": rf"SELECT lang, count(*) AS records, CAST(sum(len(regexp_extract_all(text, '{T.NWS}+'))) AS BIGINT) AS words FROM documents GROUP BY lang",
    "paragraph_diff": """WITH o AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS o FROM documents),
n AS (SELECT doc_id, o, list_concat(list_filter(o, lambda x, i: i > 1 AND i <> 3), o[1:1], ['added ' || doc_id]) AS n FROM o),
r AS (SELECT doc_id, list_filter(o, lambda x, i: NOT list_contains(n, x) AND NOT list_contains(o[1:i - 1], x)) AS r, list_filter(n, lambda x, i: NOT list_contains(o, x) AND NOT list_contains(n[1:i - 1], x)) AS a FROM n)
SELECT doc_id, CAST(len(r) AS BIGINT) AS n_removed, CAST(len(a) AS BIGINT) AS n_added, coalesce(array_to_string(r, '|'), '') AS removed FROM r""",
    "shingle_overlap_benchmark": f"SELECT doc_id, item_id, count(*) AS shared FROM {_runs('doc_id', 'documents')} d JOIN {_runs('item_id', 'benchmark')} b USING (s) GROUP BY ALL",
    "token_similarity": rf"""WITH c AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c)
SELECT conv_id, turn, CASE WHEN len(w) = 0 OR len(prev) = 0 THEN 0.0 ELSE round(len(list_intersect(w, prev)) / least(len(w), len(prev)) * sqrt(least(len(w), len(prev)) / greatest(len(w), len(prev))), 9) END AS similarity FROM p WHERE prev IS NOT NULL""",
    "records_by_kind": rf"SELECT role, count(*) AS records, CAST(sum(len(regexp_extract_all(text, '{T.NWS}+'))) AS BIGINT) AS words FROM {_REC} GROUP BY role",
    "record_dedupe": f"SELECT conv_id, turn, role, CAST(min(file) AS INTEGER) AS file FROM {_REC} GROUP BY conv_id, turn, role",
    "resend_suppression": f"WITH c AS (SELECT conv_id, turn, sent, abs(sent - lag(sent) OVER (PARTITION BY conv_id, text ORDER BY turn)) AS gap FROM {_SENT}) SELECT conv_id, turn, sent FROM c WHERE gap IS NULL OR gap > 3600",
    "interval_episodes": f"""WITH i AS (SELECT *, (SELECT min(j."at") FROM {_IN} j WHERE j.conv_id = i.conv_id AND j."at" > i."at") AS stop, (SELECT max(j."at") FROM {_IN} j WHERE j.conv_id = i.conv_id AND j."at" < i."at") AS before FROM {_IN} i)
SELECT i.conv_id, i.turn, i."at", i.stop, i.before, count(*) AS replies FROM i JOIN conversations c ON c.conv_id = i.conv_id AND c.role = 'assistant' AND {STAMP.replace('turn', 'c.turn').replace('conv_id', 'c.conv_id')} >= i."at" AND (i.stop IS NULL OR {STAMP.replace('turn', 'c.turn').replace('conv_id', 'c.conv_id')} < i.stop) GROUP BY ALL""",
    "asof_publish": f"""WITH p AS (SELECT conv_id, {STAMP} AS pub_at, turn AS version FROM conversations WHERE role = 'assistant' AND length(text) % 3 <> 0), u AS (SELECT conv_id, turn, {STAMP} AS "at" FROM conversations WHERE role = 'user')
SELECT u.*, (SELECT p.version FROM p WHERE p.conv_id = u.conv_id AND p.pub_at <= u."at" ORDER BY pub_at DESC, version DESC LIMIT 1) AS version FROM u""",
    "asof_doc": f"""WITH p AS (SELECT conv_id, {STAMP} AS doc_at, turn AS version FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn, {STAMP} AS "at" FROM conversations WHERE role = 'user')
SELECT u.*, (SELECT p.version FROM p WHERE p.conv_id = u.conv_id AND p.doc_at < u."at" ORDER BY doc_at DESC, version DESC LIMIT 1) AS version FROM u""",
    "first_use_terms": f"WITH t AS (SELECT DISTINCT conv_id, unnest({_WORDS}) AS term FROM conversations WHERE role = 'user'), f AS (SELECT term, min(conv_id) AS conv_id FROM t GROUP BY term) SELECT conv_id, count(*) AS new_terms FROM f GROUP BY conv_id",
    "admission_decisions": f"""WITH p AS ({_POINTS}), m AS (SELECT c.id, count(DISTINCT session) AS sessions, count(*) AS points, count(*) FILTER (relation = 'conflict') AS conflicts, count(DISTINCT project) AS projects, count(DISTINCT day) AS days FROM {_CANDIDATES_SQL} JOIN p ON list_contains(c.keys, p.key) WHERE is_writing IN ('yes', 'partly') GROUP BY c.id)
SELECT c.id, CASE WHEN regexp_matches(text, '[–—]|`[^`]*`|\\d') THEN 'refuse' WHEN coalesce(conflicts, 0) > 0 OR coalesce(sessions, 0) < 2 THEN 'ledger' ELSE 'admit' END AS verdict, coalesce(sessions, 0) AS sessions, coalesce(points, 0) AS points, coalesce(sessions >= 2 AND projects = 1, false) AS one_project, coalesce(sessions >= 2 AND days = 1, false) AS one_day FROM {_CANDIDATES_SQL} LEFT JOIN m USING (id)""".replace("\\\\d", "\\d"),
    "unclaimed_points": f"WITH p AS ({_POINTS}) SELECT episode, key FROM p WHERE is_writing IN ('yes', 'partly') AND key NOT IN (SELECT unnest(keys) FROM {_CANDIDATES_SQL})",
    "assigner_agreement": """WITH x AS (SELECT quality = 1 AS aq, toxic = 1 AS at1, quality = 1 AND doc_id % 10 <> 0 AS bq, doc_id % 9 = 0 AND doc_id % 10 <> 0 AS bt FROM labels)
SELECT count(*) AS points, count(*) FILTER (aq = bq AND at1 = bt) AS identical, round(avg(CASE WHEN aq OR at1 OR bq OR bt THEN ((aq AND bq)::INT + (at1 AND bt)::INT) / ((aq OR bq)::INT + (at1 OR bt)::INT) ELSE 1.0 END), 3) AS overlap FROM x""",
    "run_refusal": f"""WITH v AS ({_VERDICTS}), s AS (SELECT run, count(*) FILTER (NOT probe) AS sent, count(*) FILTER (NOT probe AND verdict = 'OMITTED') AS omitted, count(*) FILTER (NOT probe AND verdict = 'UNVERIFIABLE' AND coalesce(reason_code, '') <> 'outside_repo') AS lazy, count(*) FILTER (probe AND effective <> 'TRUE') AS unconfirmed, count(*) FILTER (NOT probe AND effective NOT IN ('SAME', 'ORIGINAL', 'NOT_A_FACT')) AS looked, max(turns) AS turns FROM v GROUP BY run)
SELECT run, sent, omitted, looked, CASE WHEN omitted > 0 THEN 'omitted' WHEN lazy >= 2 AND lazy > 0.3 * sent THEN 'lazy' WHEN unconfirmed > 0 THEN 'probes' WHEN looked >= 6 AND turns <= 2 THEN 'turns' ELSE '' END AS reason FROM s""",
    "metric_shares": "SELECT event_type, CAST(sum(event_id % 50) AS BIGINT) AS sent, CAST(sum(event_id % 7) AS BIGINT) AS changed, CASE WHEN sum(event_id % 50) > 0 THEN 100.0::DOUBLE * sum(event_id % 7) / sum(event_id % 50) ELSE 0.0 END AS share FROM events GROUP BY event_type",
    "revert_caps": "SELECT doc_id, CAST(CASE WHEN doc_id % 125 >= 3 THEN least(greatest(8, ceil(doc_id % 125 / 4)), floor(doc_id % 125 / 2)) ELSE greatest(8, ceil(doc_id % 125 / 4)) END AS BIGINT) AS cap FROM documents",
}
QUERIES |= evidence.QUERIES | prose.QUERIES
SQL |= evidence.SQL | prose.SQL
