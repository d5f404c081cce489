"""Operator 6: an interpolated modified Kneser-Ney n-gram model of trusted text as a quality classifier.

The model's tokens are characters inside words (with a start and an end mark), so that texts of a few words
and of words never seen before are still scored; a document's perplexity is per character. Counts come from
all trusted text. Lower orders use continuation counts, every (language, order) has its own three discounts,
and the tables are sharded by hash of (language, n-gram), where one join an order gives the probabilities of
all distinct n-grams of the documents. Documents add them up: from a broadcast while their number is at most
BROADCAST, which is counted first, and beyond it in compressed blocks that meet their n-grams in a join; both add
the same doubles in the same order, so the choice changes no figure. One trusted document in HELD is left out of
the counts, and the quantiles are those of the documents left out.

Across word boundaries a second model judges repetition, which likelihood alone rewards: each word's class is how far
back the same word stands (1, 2, 3 to 4, 5 to 8, or no nearer), and a bigram of these classes, seen words or not, gives
a perplexity per word. Repeats further back than LAGS words, and the order of words that do not recur, are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mix, split_words, staged, table, unstaged

#: Characters in an n-gram; documents handled at once; bits of the prefilter of trusted ids.
ORDER, SLICE, FILTER_BITS = 5, 1024, 1 << 23
#: Distinct n-grams whose probabilities are broadcast (16 bytes each); beyond that documents travel to them in blocks.
BROADCAST = 4_000_000
#: Keys of n-grams that a task remembers having named; it then starts anew. Languages whose few figures are broadcast.
NAMED, LANGS = 1_000_000, 10_000
#: One trusted document in HELD, by a hash of its id, is for the thresholds and not for the counts.
HELD = 5
#: A document stays if its perplexity is at most MARGIN times the QUANTILE of trusted text in its language, or if all
#: its characters together exceed that by no more than SLACK nats: a few characters are no evidence.
QUANTILE, MARGIN, SLACK = 0.99, 2.0, 12.0
BOS, EOS = "\x01", "\x02"
#: The last distance of each class of recurring words; one more class for the others and one context more for a start.
LAGS = (1, 2, 4, 8)
CLASSES = len(LAGS) + 1


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes, the grams as strings, and for each predicted character its gram's index."""
    text = "".join(BOS * (ORDER - 1) + w + EOS for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, f"U{ORDER}"), np.zeros(0, np.int64)
    ends = np.flatnonzero(codes != ord(BOS))
    key = np.zeros(len(ends), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ORDER - 1, -1, -1):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[ends - i].astype(np.uint64) + np.uint64(1))
    distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
    at = ends[first][:, None] - np.arange(ORDER - 1, -1, -1)[None, :]
    names = np.ascontiguousarray(codes[at]).view(f"<U{ORDER}").ravel() if len(at) else np.zeros(0, f"U{ORDER}")
    return distinct, names, back


def _clean(words: pa.Array) -> list[str]:
    return [w.replace(BOS, "\x03").replace(EOS, "\x03") for w in words.to_pylist()]


def _by_lang(b: pa.Table | pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    lang = np.array([x if x is not None else "" for x in b.column("lang").to_pylist()], object)
    for x in sorted(set(lang)):
        yield x, np.flatnonzero(lang == x)


def _classes(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class before it (CLASSES at a text's start) and its own."""
    own, start = np.full(len(codes), CLASSES - 1), np.repeat(off[:-1], np.diff(off))
    at = np.arange(len(codes)) - start
    for lag in range(LAGS[-1], 0, -1):
        same = np.flatnonzero((codes[lag:] == codes[:-lag]) & (at[lag:] >= lag)) + lag
        own[same] = np.searchsorted(LAGS, lag)
    before = np.concatenate([[CLASSES], own[:-1]]) if len(own) else own
    return np.where(at == 0, CLASSES, before), own


def _class_logs(pairs: DataFrame) -> dict[str, np.ndarray]:
    """By language, log P(class | class before), interpolated with P(class), which adds one to each class.

    All counts are occurrences: with so few classes, numbers of different contexts say nothing.
    """
    n: dict[str, np.ndarray] = {}
    for r in pairs.collect():
        n.setdefault(r.lang, np.zeros((CLASSES + 1, CLASSES)))[ord(r.gram[0]) - 3, ord(r.gram[1]) - 3] = r.n
    out = {}
    for lang, c in n.items():
        low = (c.sum(0) + 1) / (c.sum() + CLASSES)
        kinds, total = (c > 0).sum(1, keepdims=True), c.sum(1, keepdims=True)
        out[lang] = np.log(np.where(total > 0, (np.maximum(c - 0.75, 0) + 0.75 * kinds * low) / np.maximum(total, 1), low))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a batch of trusted text; a gram that ends in BOS holds two classes of words."""
    for b in batches:
        yield from _counted(b)


def _counted(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lang, rows in _by_lang(b):
        words, codes, off = split_words(b.column("text").take(pa.array(rows)), lower=False)
        names = _clean(words)
        if not names:
            continue
        before, own = _classes(codes, off)
        pairs = np.bincount(before * CLASSES + own, minlength=(CLASSES + 1) * CLASSES)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array([chr(3 + x // CLASSES) + chr(3 + x % CLASSES) + BOS for x in seen.tolist()]), pa.array(pairs[seen].astype(np.int64))], names=["lang", "gram", "n"])
        _, grams, back = _grams(names)
        each = np.array([len(w) + 1 for w in names])
        n = np.bincount(back, np.repeat(np.bincount(codes, minlength=len(names)), each), len(grams))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.tolist()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as compressed Arrow files."""
    part, i = TaskContext.get().partitionId(), 0
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + i]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "data"])
        i += 1


def _open(blob: bytes) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(blob)).read_all().combine_chunks()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram): the n-grams of each batch that the task has not named before, as far as it remembers."""
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, rows in _by_lang(b):
            words, _, _ = split_words(b.column("text").take(pa.array(rows)), lower=False)
            keys, grams, _ = _grams(_clean(words))
            known = seen.get(lang, np.zeros(0, np.uint64))
            at = np.searchsorted(known, keys)
            fresh = (at == len(known)) | (known[np.minimum(at, len(known) - 1)] != keys) if len(known) else np.ones(len(keys), bool)
            seen[lang] = np.insert(known, at[fresh], keys[fresh])
            if sum(map(len, seen.values())) > NAMED:
                seen.clear()
            names = grams[fresh].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string())], names=["lang", "gram"])


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each stretch between offsets, the same whatever stands beside it."""
    full = np.flatnonzero(off[1:] > off[:-1])
    out = np.zeros(len(off) - 1, x.dtype)
    if len(full):
        out[full] = np.add.reduceat(x[: off[-1]], off[full])
    return out


def _texts(docs) -> pa.Array:
    """The texts of a table or batch, from the column text or from the rows that it carries."""
    held = docs.column("text" if "text" in docs.schema.names else "row")
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return held if "text" in docs.schema.names else pc.fill_null(pc.struct_field(held, "text"), "")


def _summed(docs, log_of, classes: dict[str, np.ndarray]) -> pa.Table:
    """The columns of _SCORED, and `row` if docs has it, of a table or batch; log_of(lang, keys, grams) gives log probabilities."""
    n, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.float64)
    n_words, again = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.float64)
    texts = _texts(docs)
    for lang, rows in _by_lang(docs):
        words, codes, off = split_words(texts.take(pa.array(rows)), lower=False)
        names = _clean(words)
        keys, grams, back = _grams(names)
        if not len(keys):
            continue
        each = np.array([len(w) + 1 for w in names], np.int64)
        word = _sums(log_of(lang, keys, grams)[back], np.concatenate([[0], np.cumsum(each)]))
        total[rows], n[rows], n_words[rows] = _sums(word[codes], off), _sums(each[codes], off), np.diff(off)
        if lang in classes:
            again[rows] = _sums(classes[lang][_classes(codes, off)], off)
    out = pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_symbols": pa.array(n), "log_prob": pa.array(total), "n_words": pa.array(n_words), "log_again": pa.array(again)}).cast(_SCORED)
    return out.append_column("row", docs.column("row")) if "row" in docs.schema.names else out


_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("log_prob", pa.float64()), ("n_words", pa.int64()), ("log_again", pa.float64())])


def _scorer(shared, classes: dict[str, np.ndarray]):
    """Scores batches by tables of (sorted keys, log probabilities) for each language."""

    def of(lang: str, keys: np.ndarray, grams: np.ndarray) -> np.ndarray:
        known, logp = shared.value[lang]
        return logp[np.searchsorted(known, keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield from _summed(b.slice(at, SLICE), of, classes).combine_chunks().to_batches()

    return run


def _key_of(grams: np.ndarray) -> np.ndarray:
    """The hashes of n-grams given as strings, as _grams has them."""
    codes = grams.astype(f"<U{ORDER}").view(np.uint32).reshape(len(grams), ORDER)
    key = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ORDER):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, i].astype(np.uint64) + np.uint64(1))
    return key


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, gram): the distinct n-grams of each block."""
    for b in batches:
        for block, blob in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            docs = _open(blob)
            texts = _texts(docs)
            for lang, rows in _by_lang(docs):
                words, _, _ = split_words(texts.take(pa.array(rows)), lower=False)
                _, grams, _ = _grams(_clean(words))
                for at in range(0, len(grams), 50_000):
                    part = grams[at : at + 50_000].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array([lang] * len(part)), pa.array(part)], names=["block", "lang", "gram"])


def _score(blobs: pa.Table, logs: pa.Table, classes: dict[str, np.ndarray]) -> pa.Table:
    """The documents of a block scored by the log probabilities that came back to it."""
    known: dict[str, dict[str, float]] = {}
    for a, g, p in zip(*(logs.column(c).to_pylist() for c in ("lang", "gram", "logp")), strict=True):
        known.setdefault(a, {})[g] = p
    of = lambda lang, keys, grams: np.array([known[lang][g] for g in grams.tolist()], np.float64)
    return pa.concat_tables([_summed(_open(blob), of, classes) for blob in blobs.column("data").to_pylist()])


def _all_counts(trusted: DataFrame) -> DataFrame:
    return mapped(trusted, _count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram of the highest order occurs in (lang, text) rows."""
    return _all_counts(trusted).where(~F.col("gram").endswith(BOS))


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Tables of each order k = 1..ORDER: (lang, gram, alpha) and, by context, (lang, ctx, gamma).

    Below the highest order a gram's count is the number of characters seen before it; grams that start a
    word have none before them and keep their number of occurrences.
    """
    tables, c = [], counts.withColumnRenamed("n", "c")
    for k in range(ORDER, 0, -1):
        many = c.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        cut = lambda i: F.least(F.lit(i * 0.95), F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))))
        d = many.select("lang", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3"))
        ctx = F.substring("gram", 1, k - 1)
        held = c.withColumn("ctx", ctx).groupBy("lang", "ctx").agg(F.sum("c").alias("all"), *(F.sum((F.col("c") == i).cast("bigint")).alias(f"m{i}") for i in (1, 2)), F.sum((F.col("c") >= 3).cast("bigint")).alias("m3"))
        back = held.join(F.broadcast(d), "lang").select("lang", "ctx", "all", "d1", "d2", "d3", ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("all")).alias("gamma"))
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        alpha = c.withColumn("ctx", ctx).join(back, ["lang", "ctx"]).select("lang", "gram", ((F.col("c") - less) / F.col("all")).alias("alpha"))
        tables.insert(0, (staged(alpha, f"alpha{k}"), staged(back.select("lang", "ctx", "gamma"), f"gamma{k}")))
        if k > 1:
            low = F.substring("gram", 2, k - 1)
            c = staged(c.groupBy("lang", low.alias("gram")).agg(F.sum(F.when(F.substring(low, 1, 1) == BOS, F.col("c")).otherwise(1)).alias("c")), f"count{k - 1}")
    return tables


def log_probs(grams: DataFrame, tables: list) -> DataFrame:
    """(lang, gram, logp) of distinct n-grams: from the uniform floor up, one count join per order."""
    p = grams.withColumn("p", F.lit(1.0 / 65536))
    for k, (alpha, gamma) in enumerate(tables, 1):
        p = p.withColumn("g", F.substring("gram", ORDER - k + 1, k)).withColumn("ctx", F.substring("gram", ORDER - k + 1, k - 1))
        p = p.join(gamma, ["lang", "ctx"], "left").join(alpha.withColumnRenamed("gram", "g"), ["lang", "g"], "left")
        p = p.select("lang", "gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return p.select("lang", "gram", F.log("p").alias("logp"))


def _maybe(trusted_ids: DataFrame):
    """A one-hash Bloom filter of FILTER_BITS bits: what passes is joined exactly, so it only saves shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = trusted_ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 AS int))) AS bits"))
    bits = np.zeros(FILTER_BITS // 32, np.int64)
    for r in words.toLocalIterator():
        bits[r.w] = r.bits
    bits = bits.astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("slot").to_numpy()
            yield b.filter(pa.array((bits[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1)).drop_columns(["slot"])

    return slot, run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, logp): n-grams by their hashes, so that the driver sees no strings."""
    for b in batches:
        keys = _key_of(np.array(b.column("gram").to_pylist(), f"<U{ORDER}"))
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(keys.view(np.int64)), b.column("logp")], names=["lang", "key", "logp"])


def _tables(logs: DataFrame):
    """A broadcast of log probabilities, 16 bytes an n-gram, whose number the caller has checked."""
    out = {}
    for lang in [r.lang for r in logs.select("lang").distinct().collect()]:
        got = mapped(logs.where(F.col("lang") == lang), _keyed, "lang string, key bigint, logp double").select("key", "logp").toArrow()
        keys, logp = got.column("key").to_numpy().view(np.uint64), got.column("logp").to_numpy()
        order = np.argsort(keys)
        out[lang] = keys[order], logp[order]
    return logs.sparkSession.sparkContext.broadcast(out)


def perplexities(docs: DataFrame, trusted_ids: DataFrame, most: int = BROADCAST, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, n_words, repetition for every row of docs (doc_id, text, lang; other columns
    ignored, or with carry the whole row as `row`).

    perplexity is per character, repetition the perplexity per word of the classes of recurring words.

    trusted_ids: doc_id of the rows whose text trains the model. Null texts count as empty, null languages
    as a language ''. Without words perplexity is null; likewise in a language without trusted text.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    ids = trusted_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    slot, keep = _maybe(ids)
    some = mapped(d.where("doc_id IS NOT NULL").withColumn("slot", slot), keep, d.schema)
    both = staged(_all_counts(some.join(ids, "doc_id", "left_semi")), "counts")
    counts, classes = both.where(~F.col("gram").endswith(BOS)), _class_logs(both.where(F.col("gram").endswith(BOS)))
    tables = kneser_ney(counts)
    logs = staged(log_probs(mapped(d.select("lang", "text"), _distinct, "lang string, gram string").distinct(), tables), "logs")
    for pair in tables:
        for t in pair:
            unstaged(t)
    schema = "doc_id bigint, lang string, n_symbols bigint, log_prob double, n_words bigint, log_again double"
    if carry:
        d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        schema += f", row {d.schema['row'].dataType.simpleString()}"
    if logs.count() <= most:
        scored = mapped(d, _scorer(_tables(logs), classes), schema)
    else:
        blocks = staged(mapped(d, _pack, "block bigint, data binary"), "blocks", "none")
        named = mapped(blocks, _named, "block bigint, lang string, gram string").join(logs, ["lang", "gram"])
        scored = blocks.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(lambda blobs, known: _score(blobs, known, classes), schema)
    langs = counts.groupBy("lang").agg(F.lit(True).alias("has_model"))
    per = lambda total, n: F.when((F.col(n) > 0) & F.col("has_model"), F.exp(-F.col(total) / F.col(n)))
    return scored.join(few(langs), "lang", "left").select("doc_id", "lang", "n_symbols", per("log_prob", "n_symbols").alias("perplexity"), "n_words", per("log_again", "n_words").alias("repetition"), *(["row"] if carry else []))


def few(per_lang: DataFrame) -> DataFrame:
    """One row a language, marked for a broadcast where there are at most LANGS."""
    return F.broadcast(per_lang) if per_lang.limit(LANGS + 1).count() <= LANGS else per_lang


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, slack: float = SLACK, trusted: Column | None = None, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, n_words, repetition, repetition_threshold, keep: one row for each row of docs.

    A text stays if both perplexities allow it, that of characters and that of recurring words. Trusted text is every
    document that labels marks quality 1 (and, if given, for which the condition `trusted` on doc_id holds). The
    thresholds of a language are margin times the given quantile of the perplexities of its trusted documents that
    are held out of the counts, or of all its trusted ones where none is; slack is how many nats a text may exceed it,
    and exactly that much is kept. Texts without words go; texts in a language without trusted documents stay, as
    nothing is known against them. With carry the whole row of docs is returned as `row`. A null doc_id is scored and never trusted; rows that repeat a doc_id are judged
    each, and an id is trusted if any label says so. An empty table gives an empty result; other columns are ignored.
    """
    ids = labels.where("quality = 1").where(F.lit(True) if trusted is None else trusted).select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD)) == 0
    p = staged(perplexities(docs, ids.where(~held), carry=carry), "perplexity")
    named = (("perplexity", "threshold"), ("repetition", "repetition_threshold"))
    of = lambda c, when: F.percentile_approx(F.when(when, F.col(c)), quantile, 10_000)
    cut = p.join(ids, "doc_id", "left_semi").groupBy("lang").agg(*((F.coalesce(of(c, held), of(c, F.lit(True))) * margin).alias(to) for c, to in named))
    fits = lambda n, x, most: F.coalesce(F.col(n) * F.log(F.col(x) / F.col(most)) <= slack, F.lit(True))
    keep = (F.col("n_symbols") > 0) & fits("n_symbols", "perplexity", "threshold") & fits("n_words", "repetition", "repetition_threshold")
    return p.join(few(staged(cut, "thresholds")), "lang", "left").select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "n_words", "repetition", "repetition_threshold", keep.alias("keep"), *(["row"] if carry else []))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
