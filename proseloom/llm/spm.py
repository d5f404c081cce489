"""Operator 9: SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file gives three machines. The normaliser reads the longest source of the model's character map, or one
character, and writes its target, spaces as the mark; its states know whether a space was written last. The pieces
are a trie of arcs that read a piece's characters and write its id. Byte fallback reads one character that is no
piece and writes its bytes. Composed with an input, arc by arc as they are reached, they make a lattice whose states are
positions with the pieces' state; the encoding is its shortest path in the tropical semiring (costs add
along a path, the least is kept). A unigram model has one state and weighs an arc by minus the piece's score. A BPE
model's state is the piece last written, and an arc after another weighs 0 where merging by rank would leave the
two pieces as they are, else infinity: a segmentation is what merging yields exactly when all its adjacent pairs are, so one path is finite.
Where arcs weigh 0 or infinitely any finite path is shortest, so that of a BPE model is searched in depth and not over the whole lattice.
Where no piece spans a boundary the shortest paths on both sides are joined; a task keeps the paths of words it has seen.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose paths a task keeps, and the longest word kept.
KEPT, LONG = 500_000, 48
INF = float("inf")


def default_model() -> str:
    """The public 32k BPE model on this machine; every function takes another path."""
    return os.environ.get("PROSELOOM_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = 8 if kind == 1 else 4 if kind == 5 else varint()
            yield key >> 3, data[i : i + n]
            i += n


class Paths(dict):
    """The paths of words seen so far, as bytes; it starts anew at KEPT of them. Long words are not kept."""

    def __init__(self, of: Transducer, before: str) -> None:
        self.of, self.before = of, before

    def __missing__(self, word: str) -> bytes:
        t = self.of
        ids = t._segments(self.before + word) if t.special.search(word) else t.ids_of(t.shortest(self.before + word))
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


class Normaliser:
    """The normaliser's transducer. charsmap: the model's compiled map, a double array over the sources' UTF-8 bytes
    whose leaves point at null-terminated targets; without one every character is its own target."""

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, escape: bool) -> None:
        self.prefix, self.squeeze, self.escape = prefix, squeeze, escape
        size = int.from_bytes(charsmap[:4], "little")
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist() if charsmap else []
        self.targets = charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[str, int]:
        """What the longest source at a place of data becomes, and where it ends; a character of no source is itself."""
        units, node, value, end = self.units, 0, -1, at
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= (units[node] >> 10) << ((units[node] & 512) >> 6)
            if leaf:
                value, end = units[node] & 0x7FFFFFFF, i + 1
        if value < 0:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            return data[at:end].decode("utf-8", "replace"), end
        return self.targets[value : self.targets.index(0, value)].decode(), end

    def mapped(self, text: str) -> str:
        if not self.units:
            return text
        data, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(data):
            target, at = self.longest(data, at)
            out.append(target)
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Transducer:
    """The compiled machines of a model file's bytes."""

    def __init__(self, model: bytes) -> None:
        pieces, self.kind = [], UNIGRAM
        self.prefix = self.squeeze = self.escape = True
        charsmap = b""
        for f, v in _fields(model):
            if f == 1:
                p = dict(_fields(v))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif f == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                n = dict(_fields(v))
                charsmap = n.get(2, b"")
                self.prefix, self.squeeze, self.escape = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        self.normalise = Normaliser(charsmap, self.prefix, self.squeeze, self.escape)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("word and character models have no pieces to compose")
        self.pieces = [p for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        # Two characters meet at a boundary that no piece spans if no piece holds them side by side.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.solid = all(MARK not in p.strip(MARK) or not p.strip(MARK) for p in self.ids) and not any(p[0] != MARK and p[1] == MARK for p in self.pairs)
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in {b for p in self.pairs for b in p})
        cls = re.escape(alone)
        self.cut = re.compile(rf"{MARK}*[^{MARK}{cls}]+|{MARK}+" + (rf"|[{cls}]" if alone else "")) if self.solid else None
        normal = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.low, self.high = min(normal, default=0.0) - 10.0, max(normal, default=0.0)
        self.quick = self.cut is not None and "\n" in alone and self.escape and not self.squeeze and not charsmap and bool(self.bytes)
        self.special = re.compile(f"[{MARK}{cls}]")
        self.word, self.line = Paths(self, MARK), Paths(self, "\n")
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.fits: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[0] = i
        self.packed = [struct.pack("<i", i) for i in range(len(pieces))]
        self.size = [len(p) for p in self.pieces]
        self.plain = [self._bytes_of(i) for i in range(len(pieces))]

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def _merge(self, chars: list[str]) -> list[str]:
        """What merging the best-scored adjacent pair, leftmost first, leaves of some characters."""
        rank = self.rank
        while True:
            best, at = None, 0
            for i in range(len(chars) - 1):
                r = rank.get(chars[i] + chars[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return chars
            chars[at : at + 2] = [chars[at] + chars[at + 1]]

    def _pair(self, a: int, b: int) -> bool:
        """Whether a BPE path may go from piece a (-1: none, or byte fallback) to piece b."""
        x = [self.pieces[i] for i in (a, b) if i >= 0]
        ok = self.fits[a][b] = self._merge(list("".join(x))) == x
        return ok

    def _fallback(self, c: str) -> list[int]:
        data = c.encode("utf-8", "replace")
        return [self.bytes[x] for x in data] if all(x in self.bytes for x in data) else [self.unk]

    def weight(self, before: int, piece: int) -> float:
        """The cost of an arc that writes piece in the state `before`; infinite where the machine has no such arc."""
        if self.kind == UNIGRAM:
            return -self.scores[piece] if self.types[piece] == NORMAL else 0.1 - self.size[piece] * self.high
        ok = self.fits[before].get(piece)
        return 0.0 if (self._pair(before, piece) if ok is None else ok) else INF

    def path(self, s: str) -> list[int]:
        """The ids of the shortest path through the lattice of a normalised text."""
        # best[i]: of each state reached at position i, its cost, and position, state and piece (-1: fallback) of the arc there
        n, ids, bpe, weight = len(s), self.ids, self.kind == BPE, self.weight
        single = np.float32  # unigram costs add in single precision, as ties of equal pieces in another order depend on it
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(n + 1)]
        best[0][-1] = (0.0, 0, 0, 0)
        for i in range(n):
            here, node = best[i], self.trie
            for j in range(i, n):
                if not here or (node := node.get(s[j])) is None:
                    break
                p = node.get(0)
                if p is not None:
                    to, state = best[j + 1], p if bpe else -1
                    for before, (cost, *_) in here.items():
                        w = weight(before, p) if bpe else float(single(cost + weight(before, p)))
                        if w < INF and (state not in to or w < to[state][0]):
                            to[state] = (w, i, before, p)
            if s[i] not in ids:
                for before, (cost, *_) in here.items():
                    w = 0.0 if bpe else float(single(cost - self.low))
                    if -1 not in best[i + 1] or w < best[i + 1][-1][0]:
                        best[i + 1][-1] = (w, i, before, -1)
        out, j = [], n
        state = min(best[n], key=lambda x: best[n][x][0]) if n else -1
        while j > 0:
            _, i, state, p = best[j][state]
            out += [p] if p >= 0 else reversed(self._fallback(s[i:j]))
            j = i
        out.reverse()
        return out

    def shortest(self, s: str) -> list[int]:
        """The same; of long texts part by part: no piece spans the boundary between two characters that none holds side by side."""
        if self.kind != BPE:
            return self.path(s)
        if len(s) <= LONG:
            return self.straight(s)
        pairs = self.pairs
        ends = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in pairs]
        return [x for a, b in zip([0, *ends], [*ends, len(s)], strict=True) for x in self.straight(s[a:b])]

    def _arcs(self, s: str, i: int) -> list[int]:
        """The arcs from position i of a normalised text: byte fallback (-1), if its character is no piece, and pieces, the longest last."""
        node, out = self.trie, [] if s[i] in self.ids else [-1]
        for j in range(i, len(s)):
            if (node := node.get(s[j])) is None:
                break
            if (p := node.get(0)) is not None:
                out.append(p)
        return out

    def straight(self, s: str) -> list[int]:
        """The shortest path of a BPE model, whose arcs weigh 0 or infinitely: the first that a search in depth completes, longest
        pieces first. Arcs of positions that it does not reach are never composed; a state that leads nowhere is left once."""
        n, size, fits, arcs = len(s), self.size, self.fits, self._arcs
        path, at, before = [], 0, -1
        todo: list[list[int]] = [arcs(s, 0)] if n else []
        dead: set[tuple[int, int]] = set()
        while at < n:
            here = todo[-1]
            while here:
                p = here.pop()
                to = at + (size[p] if p >= 0 else 1)
                if dead and (to, p) in dead:
                    continue
                if p < 0 or ((ok := fits[before].get(p)) is None and self._pair(before, p)) or ok:
                    path.append(p)
                    at, before = to, p
                    if to < n:
                        todo.append(arcs(s, to))
                    break
            else:
                dead.add((at, before))
                todo.pop()
                p = path.pop()
                at, before = at - (size[p] if p >= 0 else 1), path[-1] if path else -1
        if -1 not in path:
            return path
        out, at = [], 0
        for p in path:
            out += [p] if p >= 0 else self._fallback(s[at])
            at += size[p] if p >= 0 else 1
        return out

    def ids_of(self, path: list[int]) -> bytes:
        return b"".join(map(self.packed.__getitem__, path))

    def _segments(self, s: str) -> bytes:
        """The path of a normalised text: where no piece spans a boundary, the paths on both sides are joined."""
        ids = [i for x in (self.cut.findall(s) if self.cut else [s]) for i in self.shortest(x)]
        if not self.bytes:  # without byte fallback a run of unknown characters is one id
            ids = [x for k, x in enumerate(ids) if x != self.unk or not k or ids[k - 1] != self.unk]
        return self.ids_of(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if not (self.quick and text) or MARK in text:
            return self._segments(self.normalise(text))
        # Words between single spaces, and line feeds, are segments: their paths are looked up.
        out = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k or not self.prefix:
                out.append(self.line[words[0]] if k else self._segments(words[0]))
                words = words[1:]
            if "" in words:
                out.append(self._segments(MARK + MARK.join(words)))
            else:
                out += map(self.word.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: the inverse transducer, without the dummy prefix."""
        plain = self.plain
        text = b"".join(map(plain.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _batches(model: bytes, row, types: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model)
        for b in batches:
            rows = [row(t, text, t.encode(text)) for text in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, types.values(), strict=True))], names=["doc_id", *types])

    return run


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _load(model: str | None) -> bytes:
    with open(model or default_model(), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of docs (doc_id, text; others ignored).

    Whole texts are encoded; null and empty texts have no ids. Decoding gives the text back exactly if
    the model neither maps characters nor squeezes spaces nor lacks byte fallback, and the text holds no mark. Rows that repeat
    a doc_id are encoded each, null ids too; an empty table gives an empty result. Of equally short paths the first found
    stands. model: path of a .model file on the driver.
    """
    row = lambda t, text, raw: (np.frombuffer(raw, "<i4").tolist(), t.decode(np.frombuffer(raw, "<i4")))
    return mapped(_docs(docs), _batches(_load(model), row, {"ids": pa.list_(pa.int32()), "decoded": pa.string()}), "doc_id bigint, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip for every row of docs, as encode_documents."""
    row = lambda t, text, raw: (len(raw) // 4, hashlib.sha256(raw).hexdigest(), t.decode(np.frombuffer(raw, "<i4")) == text)
    return mapped(_docs(docs), _batches(_load(model), row, {"n_ids": pa.int64(), "ids_sha256": pa.string(), "round_trip": pa.bool_()}), "doc_id bigint, n_ids bigint, ids_sha256 string, round_trip boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
