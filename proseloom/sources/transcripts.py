"""Transcripts: JSON lines of conversation logs as lines with offsets, then as typed records.

Files are `<root>/<project>/<session>.jsonl` and `<root>/<project>/<session>/subagents/<name>.jsonl`. Lines are read as
text and parsed into variants, whose fields are taken where they have the expected type; nothing fails on odd shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prompt sources that a person typed, suffixes of markdown, tools that write, what precedes a person's words in an error.
TYPED = ("typed", "queued", "suggestion_accepted")
MARKDOWN = (".md", ".markdown")
WRITERS = ("Write", "Edit", "MultiEdit")
SAID = "the user said:\n"
CLARIFY = "The user wants to clarify these questions"
# End of fixed values.


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant, null where it is missing or of another type."""
    return F.try_variant_get(v, path, kind)


def text_at(v: Column, path: str) -> Column:
    """A string field, '' where it is missing, null or no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", get(v, path)).otherwise("")


def lines(spark: SparkSession, root: str) -> DataFrame:
    """file, session, source, file_rank (subagent), offset (in bytes), raw: the lines of all transcripts under root.

    The order (file_rank, file, offset) is the order in which first copies count. Lines end at line feeds alone; a file is one
    row of its lines, split in the engine, so the offset is the sum of the lines before it.
    """
    own = spark.read.text([f"{root}/*/*.jsonl", f"{root}/*/*/subagents/*.jsonl"], wholetext=True) if _any(spark, f"{root}/*/*/subagents/*.jsonl") else spark.read.text(f"{root}/*/*.jsonl", wholetext=True)
    return split_lines(own.select(F.col("_metadata.file_path").alias("file"), "value"))


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def split_lines(files: DataFrame) -> DataFrame:
    """The same of files (file, value: the whole text)."""
    sub = F.col("file").rlike(r"/subagents/[^/]+$")
    parts = F.split("value", "\n")
    d = files.select("file", F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), F.when(sub, "subagent").otherwise("main").alias("source"), sub.cast("int").alias("file_rank"), F.posexplode(parts).alias("n", "raw"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("raw") + 1
    return d.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0))).where("raw <> ''").drop("n")


def parsed(found: DataFrame) -> DataFrame:
    """found with `row`, a variant: lines of users and assistants only; lines that do not parse have a null row, to be counted.

    Lines that name neither are passed over before they are parsed.
    """
    d = found.where(F.col("raw").contains('"user"') | F.col("raw").contains('"assistant"')).withColumn("row", F.try_parse_json("raw")).drop("raw")
    return d.where(F.col("row").isNull() | F.coalesce(get(F.col("row"), "$.type").isin("user", "assistant"), F.lit(False)))


def bad_lines(rows: DataFrame) -> DataFrame:
    """file, bad: how many lines of a file did not parse."""
    return rows.groupBy("file").agg(F.count_if(F.col("row").isNull()).alias("bad"))


def based(rows: DataFrame) -> DataFrame:
    """rows with the columns that every record has: ts, uuid, parent and the identity that a forked copy was first written under."""
    r = F.col("row")
    first = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    d = rows.where(r.isNotNull())
    return d.select("file", "session", "source", "file_rank", "offset", text_at(r, "$.timestamp").alias("ts"), text_at(r, "$.uuid").alias("uuid"), text_at(r, "$.parentUuid").alias("parent"), first(get(r, "$.forkedFrom.sessionId"), get(r, "$.sessionId"), F.col("session")).alias("origin_session"), first(get(r, "$.forkedFrom.messageUuid"), get(r, "$.uuid")).alias("origin_uuid"), "row")


BASE = ("file", "session", "source", "file_rank", "offset", "ts", "uuid", "parent", "origin_session", "origin_uuid")


def blocks(base: DataFrame, role: str) -> DataFrame:
    """base with pos and block (a variant) of each block of a message of that role; messages that are plain strings have none."""
    b = base.where(get(F.col("row"), "$.type") == role).withColumn("content", F.try_variant_get("row", "$.message.content", "array<variant>"))
    return b.select(*BASE, "row", F.posexplode("content").alias("pos", "block"))


def replies(base: DataFrame) -> DataFrame:
    """The text blocks of assistants that hold more than white space."""
    b = blocks(base, "assistant").withColumn("text", text_at(F.col("block"), "$.text"))
    return b.where((get(F.col("block"), "$.type") == "text") & (F.trim(F.regexp_replace("text", r"\s", "")) != "")).select(*BASE, "pos", F.lit("reply").alias("kind"), F.lit("").alias("path"), "text")


def humans(base: DataFrame) -> DataFrame:
    """What a person typed: plain strings of one of the typed prompt sources and a human origin."""
    r = F.col("row")
    h = base.where((get(r, "$.type") == "user") & (F.schema_of_variant(F.try_variant_get(r, "$.message.content", "variant")) == "STRING") & get(r, "$.promptSource").isin(*TYPED) & (get(r, "$.origin.kind") == "human"))
    return h.select(*BASE, F.lit(0).alias("pos"), F.lit("human").alias("kind"), F.lit("").alias("path"), get(r, "$.message.content").alias("text"), get(r, "$.promptSource").alias("prompt_source"), (get(r, "$.promptSource") == "suggestion_accepted").alias("suggested"))


def calls(base: DataFrame) -> DataFrame:
    """The tool calls of assistants: id, name, input (a variant)."""
    b = blocks(base, "assistant").where(get(F.col("block"), "$.type") == "tool_use")
    return b.select(*BASE, "pos", get(F.col("block"), "$.id").alias("call_id"), get(F.col("block"), "$.name").alias("name"), F.try_variant_get("block", "$.input", "variant").alias("input"))


def written(found: DataFrame) -> DataFrame:
    """The texts that write calls were about to put in a file: kind markdown or file by the path's suffix; blank ones left out."""
    i = F.col("input")
    news = F.transform(F.coalesce(F.try_variant_get(i, "$.edits", "array<variant>"), F.expr("cast(array() AS array<variant>)")), lambda e: F.coalesce(get(e, "$.new_string"), F.lit("")))
    text = F.when(F.col("name") == "Write", text_at(i, "$.content")).when(F.col("name") == "Edit", text_at(i, "$.new_string")).otherwise(F.array_join(news, "\n\n"))
    d = found.where(F.col("name").isin(*WRITERS)).withColumn("path", text_at(i, "$.file_path")).withColumn("text", text)
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    return d.where(F.col("text").rlike(r"\S")).select(*BASE, "pos", F.when(suffix.isin(*MARKDOWN), "markdown").otherwise("file").alias("kind"), "path", "text")


def edits(found: DataFrame) -> DataFrame:
    """method, path, old, new of each change of an Edit, MultiEdit or Write call; changes of nothing and of blanks only are left out."""
    i = F.col("input")
    pair = lambda v: F.struct(F.coalesce(get(v, "$.old_string"), F.lit("")).alias("old"), F.coalesce(get(v, "$.new_string"), F.lit("")).alias("new"))
    many = F.transform(F.coalesce(F.try_variant_get(i, "$.edits", "array<variant>"), F.expr("cast(array() AS array<variant>)")), pair)
    one = F.when(F.col("name") == "Edit", F.array(pair(i))).when(F.col("name") == "MultiEdit", many).otherwise(F.array(F.struct(F.lit("").alias("old"), text_at(i, "$.content").alias("new"))))
    d = found.where(F.col("name").isin(*WRITERS)).select(*BASE, "pos", F.lit("edit").alias("kind"), text_at(i, "$.file_path").alias("path"), F.col("name").alias("method"), F.posexplode(one).alias("part", "e"))
    return d.where((F.col("e.old") != F.col("e.new")) & (F.col("e.old").rlike(r"\S") | F.col("e.new").rlike(r"\S"))).select(*BASE, "pos", "part", "kind", "path", "method", F.col("e.old").alias("old"), F.col("e.new").alias("new"), F.col("e.new").alias("text"))


def results(base: DataFrame) -> DataFrame:
    """The tool results of users: call_id, text, is_error, result (the line's own, a variant)."""
    b = blocks(base, "user").where(get(F.col("block"), "$.type") == "tool_result")
    parts = F.transform(F.try_variant_get("block", "$.content", "array<variant>"), lambda c: F.coalesce(get(c, "$.text"), F.lit("")))
    text = F.when(F.schema_of_variant(F.try_variant_get("block", "$.content", "variant")) == "STRING", get(F.col("block"), "$.content")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))
    error = F.coalesce(get(F.col("block"), "$.is_error", "boolean"), F.lit(False)) | F.startswith(text_at(F.col("row"), "$.toolUseResult"), F.lit("Error"))
    return b.select(*BASE, "pos", get(F.col("block"), "$.tool_use_id").alias("call_id"), text.alias("text"), error.alias("is_error"), F.try_variant_get("row", "$.toolUseResult", "variant").alias("result"))


def publishes(found: DataFrame, came: DataFrame) -> DataFrame:
    """Publish calls with what came of them: refused is null where the transcript holds no result."""
    i = F.col("input")
    action = F.coalesce(get(i, "$.action"), F.lit("publish")) == "publish"
    asset = F.coalesce(F.nullif(get(i, "$.asset"), F.lit("")), F.lit("")) == ""
    c = found.where((F.col("name") == "Artifact") & action & asset)
    r = came.groupBy("file", "call_id").agg(F.min_by(F.struct("text", "is_error", F.to_json("result").alias("json")), "offset").alias("r"))
    x = c.join(r, ["file", "call_id"], "left")
    info = F.try_parse_json("r.json")
    url = F.coalesce(F.nullif(get(info, "$.url"), F.lit("")), F.regexp_extract("r.text", r" at (https://\S+) \(Version", 1), F.lit(""))
    return x.select(*BASE, "pos", F.lit("publish").alias("kind"), text_at(i, "$.file_path").alias("path"), text_at(i, "$.label").alias("text"), F.coalesce(get(info, "$.artifact_id"), F.lit("")).alias("artifact_id"), get(info, "$.seq", "bigint").alias("seq"), F.when(F.col("r.is_error"), "").otherwise(url).alias("url"), F.col("r.is_error").alias("refused"), F.when(F.col("r").isNull(), "no result in the transcript").when(F.col("r.is_error"), F.substring(F.trim("r.text"), 1, 300)).otherwise("").alias("error"))


def typed_answer(answer: Column, labels: Column) -> Column:
    """Whether an answer is neither an offered label nor a comma list of them, nor blank."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return (a != "") & ~F.array_contains(labels, a) & ~F.forall(F.split(a, ","), lambda p: F.array_contains(labels, F.trim(p)))


def rejections(found: DataFrame, came: DataFrame) -> DataFrame:
    """What a person wrote when refusing a call; questions to be clarified are no rejections."""
    said = F.trim(F.regexp_extract("text", r"(?s)the user said:\n(.*)", 1))
    r = came.where(F.col("is_error") & F.col("text").contains(SAID)).withColumn("text", said).where((F.col("text") != "") & ~F.col("text").startswith(CLARIFY))
    names = found.groupBy("file", "call_id").agg(F.first("name").alias("tool"))
    return r.join(names, ["file", "call_id"], "left").select(*BASE, "pos", F.lit("rejection").alias("kind"), F.lit("").alias("path"), "text", F.coalesce("tool", F.lit("")).alias("tool"))


def extracted(records: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """records (of several kinds, by union) each once: the first copy of an identity, kind and place among its message's records, then the window.

    A record's identity is the message that it was first written in, or its own file and offset.
    """
    from ..operators.rates import inside

    ident = F.coalesce(F.nullif("origin_uuid", F.lit("")), F.concat_ws(":", "file", "offset"))
    d = records.withColumn("ident", ident)
    n = F.row_number().over(Window.partitionBy("file", "ident", "kind").orderBy("offset", "pos"))
    first = F.row_number().over(Window.partitionBy("ident", "kind", "ordinal").orderBy("file_rank", "file", "offset"))
    return d.withColumn("ordinal", n).withColumn("copy", first).where("copy = 1").where(inside(F.col("ts"), since, until)).drop("copy", "ident")
