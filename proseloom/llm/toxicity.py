"""Operator 4: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows (SAMPLE, by hash of the id) is dealt into three parts: one for the lexicon
of word beginnings, counted by DataFrame aggregation; one for the trees; one for the calibration. The model is
a few kB; every document is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, staged, table

#: Labelled rows used at most; lengths of word beginnings that may enter the lexicon.
SAMPLE, PREFIXES = 30_000, (4, 5, 6, 7, 8)
#: A beginning enters if it is in this share of toxic rows (and in 2), and there this many times as often.
SHARE, RATIO = 0.006, 15.0
THRESHOLD = 0.3
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros", "vuestro")
NAMES = ("hits_per_word", "hits", "weight_per_word", "weight", "strongest", "kinds", "you_near_hit", "you_per_word", "capitals", "punctuation", "obfuscated", "stretched", "log_words")
PERSONS = frozenset(SECOND_PERSON)
YOU = re.compile(r"(?<![^\W_])(?:" + "|".join(SECOND_PERSON) + r")(?![^\W_])")
#: Signs that stand for letters in disguised words.
SIGNS = "0123456789@$*!|"
#: Classes of code points, as bits.
UPPER, PUNCTUATION, LETTER, WORD, SIGN = 1, 2, 4, 8, 16
#: Characters between a word of address and a lexicon hit that still count as near.
NEAR = 40


def automaton(lexicon: dict[str, float]):
    a = ahocorasick.Automaton()
    for w, weight in lexicon.items():
        a.add_word(w, (len(w), weight))
    if lexicon:
        a.make_automaton()
    return a


@lru_cache(1)
def classes() -> np.ndarray:
    """The classes of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = (UPPER if kind == "Lu" else 0) | (PUNCTUATION if kind[0] in "PS" else 0) | (LETTER if c.isalpha() else 0) | (WORD if c.isalnum() else 0) | (SIGN if c in SIGNS else 0)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def disguised(codes: np.ndarray, kind: np.ndarray) -> int:
    """Runs of signs that stand between two letters."""
    sign = np.flatnonzero(kind & SIGN)
    if not len(sign):
        return 0
    new = np.concatenate([[True], np.diff(sign) > 1])
    first, last = sign[new], sign[np.concatenate([new[1:], [True]])]
    inner = (first > 0) & (last < len(codes) - 1)
    return int(((kind[first[inner] - 1] & LETTER) & (kind[last[inner] + 1] & LETTER) > 0).sum())


def stretched(codes: np.ndarray, kind: np.ndarray) -> int:
    """How often a letter stands three times in a row, each letter counted once."""
    if len(codes) < 3 or not ((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])).any():
        return 0
    ends = np.flatnonzero(np.concatenate([codes[1:] != codes[:-1], [True]]))
    size = np.diff(np.concatenate([[-1], ends]))
    return int((size // 3)[(kind[ends] & LETTER) > 0].sum())


def features(text: str, lexicon) -> list[float]:
    """The dense features of one whole text, in the order of NAMES; an empty text gives zeros."""
    low = text.lower()
    at: dict[int, float] = {}
    kinds = set()
    if len(lexicon):
        for end, (size, weight) in lexicon.iter(low):
            start = end - size + 1
            if not start or not low[start - 1].isalnum():
                at[start] = max(weight, at.get(start, 0.0))
                kinds.add(low[start : start + PREFIXES[0]])
    hits, weight = sorted(at), sum(at.values())
    raw, codes = _codes(text), _codes(low)
    kind, upper = classes()[codes], classes()[raw]
    # Words are what white space or any sign but letters and digits divides.
    n_you = sum(map(PERSONS.__contains__, np.where(kind & WORD, codes, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()))
    near, k = 0, 0
    for y in (m.start() for m in YOU.finditer(low)) if hits and n_you else ():
        while k < len(hits) and hits[k] < y - NEAR:
            k += 1
        near += k < len(hits) and hits[k] <= y + NEAR
    words = low.count(" ") + low.count("\n") + 1 if low.strip() else 0
    n, c = max(words, 1), max(len(text), 1)
    share = lambda bit: int(np.count_nonzero(upper & bit)) / c
    return [len(hits) / n, float(len(hits)), weight / n, weight, max(at.values(), default=0.0), float(len(kinds)), near / n, n_you / n, share(UPPER), share(PUNCTUATION), disguised(codes, kind) / n, stretched(codes, kind) / n, float(np.log1p(words))]


@dataclass
class Trees:
    """Boosted regression trees of log odds, each a list of (feature, cut, left, right) and leaf values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feat, cut, kids, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feat[at] >= 0).any():
                rows = np.flatnonzero(inner)
                i = at[rows]
                at[rows] = kids[i, (x[rows, feat[i]] > cut[i]).astype(int)]
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, leaf: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over quantile histograms."""
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feat, cut, kids, value = [-1], [0.0], [[0, 0]], [0.0]
        level = [(0, np.arange(len(y)), 0)]
        while level:
            node, rows, d = level.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + ridge)
            if d == depth or hs < 2 * leaf:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < leaf) | (hs - hl < leaf)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] < 0:
                continue
            _, j, k = best
            feat[node], cut[node], kids[node] = j, float(cuts[j][k]), [len(feat), len(feat) + 1]
            right = code[rows, j] > k
            for part in (rows[~right], rows[right]):
                level.append((len(feat), part, d + 1))
                feat.append(-1)
                cut.append(0.0)
                kids.append([0, 0])
                value.append(0.0)
        tree = (np.array(feat), np.array(cut), np.array(kids), np.array(value))
        model.trees.append(tree)
        f = f + Trees(0.0, [tree])(x)
    return model


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing map from score to share of positives (pool adjacent violators, smoothed a little)."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(s[order], y[order], strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [(b[0] + 0.02) / (b[1] + 0.2) for b in blocks for _ in (0, 1)]
    return np.array(xs or [0.0]), np.maximum.accumulate(np.array(ys or [0.0]))


def held_out(c):
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(c.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        a = automaton(self.lexicon)
        raw = self.trees(np.array([features(t, a) for t in texts]))
        # Within a calibrated step the raw score still orders texts, by an amount that changes no step.
        return np.clip(np.interp(raw, *self.knots) + 1e-4 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic. Rows with a null in either are left out; so are held-out rows, by the caller's filter.

    An id with several labels is toxic if one of them says so; rows of docs that repeat an id are used each. Without
    rows, or with one class only, every text gets the same score. The lexicon holds every beginning that SHARE and RATIO admit.
    """
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)))
    rows = staged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id"), "labelled")
    first = rows.where("part < 4").select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("words"))
    starts = F.array_distinct(F.flatten(F.transform("words", lambda w: F.filter(F.array(*(F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in PREFIXES)), lambda x: x.isNotNull()))))
    total = first.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).first()
    t, n = float(total.t or 0), float(total.n or 0)
    seen = first.select("toxic", F.explode(starts).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    ratio = ((F.col("t") + 0.1) / (t + 1)) / ((F.col("n") + 0.1) / (n + 1))
    found = seen.where((F.col("t") >= max(2.0, SHARE * t)) & (ratio >= RATIO))
    lexicon = {r.w: r.weight for r in found.select("w", (F.log(ratio) * F.col("t") / (F.col("t") + 3)).alias("weight")).collect()}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon)
        for b in batches:
            x = [features(s, a) for s in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic").cast(pa.int32()), b.column("part").cast(pa.int64()), b.column("doc_id")], names=["x", "toxic", "part", "doc_id"])

    kind = dict(rows.dtypes)["doc_id"]
    got = mapped(rows.where("part >= 4"), numbers, f"x array<double>, toxic int, part bigint, doc_id {kind}").toPandas().sort_values("doc_id")
    x = np.array(got.x.tolist(), np.float64).reshape(len(got), len(NAMES))
    y, grow = got.toxic.to_numpy(np.float64), (got.part < 8).to_numpy(bool)
    trees = boost(x[grow], y[grow])
    return Model(lexicon, trees, isotonic(trees(x[~grow]), y[~grow]) if (~grow).any() else isotonic(trees(x), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """__row (all of docs' columns as a struct) and __score of every row of docs, repeated and null ids too.

    docs: text and any others, whatever their names. Null and empty texts are scored as empty; a text's score depends
    on nothing but the text. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores([t or "" for t in b.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(s, pa.float64())], names=["__row", "__score"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("__text"))
    kind = packed.schema["__row"].dataType.simpleString()
    scored = mapped(packed, run, f"__row {kind}, __score double")
    return scored


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = score(docs, model).select(F.col("__row.doc_id").alias("doc_id"), F.col("__score").alias("score"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
