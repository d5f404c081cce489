"""The pipeline operators against brute force, round trips and small hard inputs."""

import gzip
import hashlib
import io
import os
import re
import random
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
from proseloom.llm import jaccard, linededup, media, packing, quality, spm, topk, toxicity, urlfilter, warc  # noqa: E402
from proseloom.llm.components import UnionFind, connected_components  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, eff string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)


HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A  b\tc"), (None, "a b c"), (6, "word " * 30_000), (6, "again and again"), (7, "again and again"), (7, "again and again"), (8, "é" * 9 + "\n" + "É" * 10), (9, "É" * 10)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, rng.randrange(60)) for a in range(60) for _ in range(rng.randrange(2))] + [(5, 5), (100, 100), (None, 3), (200, 201), (200, 201)]
    sets = UnionFind()
    for a, b in edges:
        if a is not None:
            sets.up.setdefault(a, a), sets.up.setdefault(b, b), sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: sets.find(x) for x in list(sets.up)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_topk_brute_force_and_hard_vectors(spark):
    rng = np.random.default_rng(0)
    v = {i: [float(x) for x in rng.integers(-2, 3, 6) / 8] for i in range(200)}
    rows = [(i, x, "tile") for i, x in v.items()] + [(1000, None, ""), (1001, [1.0, None] + [0.0] * 4, ""), (1020, [float("nan")] * 6, ""), (None, [0.0] * 6, ""), (2000, [1e308, -1e308] + [0.0] * 4, ""), (3000, [], ""), (40, v[40], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, tile string")
    got = {}
    for r in topk.exact_topk(df, F.col("id") % 20 == 0, 5, tile=64, block=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = {i: [int(np.floor(64 * c)) for c in x] for i, x in v.items()}
    q[2000] = [int(9e18), -int(9e18), 0, 0, 0, 0]
    for i in [x for x in q if x % 20 == 0]:
        want = sorted(((-max(-topk.LIM, min(topk.LIM, sum(a * b for a, b in zip(q[i], q[j], strict=True)))), j) for j in q if j != i))[:5]
        assert [(j, -s) for s, j in want] == [(b, c) for _, b, c in sorted(got[i])]
    assert 3000 not in got and 1020 not in got
    assert topk.exact_topk(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_url_filter_propagates_with_allow_first(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [(1, "http://a.net/x", ""), (2, "http://b.com/", link % "http://a.net/x"), (3, "http://c.com/", '<meta http-equiv="refresh" content="0; url=http://b.com/">'), (4, "http://d.com/", link % "http://E.example.NET/en/1"), (5, None, None), (6, "nothing", ""), (7, "http://net", ""), (8, "http://f.com/", ""), (1, "http://a.net/x", "")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, html string, host string, path string")
    moved = spark.createDataFrame([("http://f.com/", "http://d.com/"), ("http://d.com/", "http://g.net/")], "a string, b string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, redirects=moved).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == (None, "block") and got[3][3] == "block"
    assert got[4][3] == "allow" and got[8][3] == "allow" and got[5] == ("", "", None, "allow") and got[7] == ("net", "", None, "allow")
    assert urlfilter.judge(pages, redirects=moved).count() == len(rows) and urlfilter.judge(pages.limit(0)).count() == 0


def test_media_round_trip(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    rows = HARD + [(20 + i, base[:7000] + f"<{i}>" + base[7000:]) for i in range(5)]
    out, store = media.store_media(docs(spark, rows))
    got = {r.sha: r for r in media.read_media(store).collect()}
    for r in out.collect():
        p = media.payload_of(next(t or "" for i, t in rows if i == r.doc_id and hashlib.sha256(media.payload_of(t or "")).digest() == bytes(r.sha)))
        assert got[r.sha].payload_bytes == len(p) and got[r.sha].tail_crc32 == zlib.crc32(p[-16:]) and got[r.sha].feature == media.feature(p)
    assert out.count() == len(rows)
    kept = sum(len(r.data) for r in store.select("data").collect())
    assert kept < sum(len(media.wav(media.payload_of(t or ""))) for _, t in rows) - 60_000
    assert media.read_media(media.store_media(docs(spark, []))[1]).count() == 0


def test_chunks_are_content_defined():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    a, b = {d for d, _ in media.chunks(data)}, {d for d, _ in media.chunks(b"new head" + data)}
    assert b"".join(p for _, p in media.chunks(data)) == data and len(a & b) >= len(a) - 2
    with pytest.raises(ValueError):
        media._verified(hashlib.sha256(b"x").digest(), [b"y"], [b"z" * 16])


def test_warc_round_trip_and_damage(spark):
    rows = [(3, "http://a/\r\nX: y", "é"), (1, None, "é"), (2, "u", None), (4, "u", ""), (None, "u", "é"), (5, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, first string")
    got = {r.page_id: r for r in warc.records(warc.archives(pages)).collect()}
    assert len(got) == 6 and got[1].record_type == "response" and got[3].refers_to == 1 and got[None].refers_to == 1 and got[4].refers_to == 2
    assert got[3].payload_bytes == 2 and got[3].payload_digest == warc.b32("é".encode()) == got[1].payload_digest
    assert all(r.record_type == "response" for r in warc.records(warc.archives(pages, least=3)).collect())
    data = warc.write_archive([(1, "u", b"abc", None, False), (2, "u", b"abc", 1, True)])
    assert [h["WARC-Type"] for h, _ in warc.read_archive(io.BytesIO(data))] == ["response", "revisit"]
    for bad in (data[:-5], data[:40] + b"xx" + data[42:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    assert warc.records(warc.archives(pages.limit(0))).count() == 0
    # An archive of another writer: no digests, no space after the colon, other case, other record types, no HTTP head.
    info = b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nCONTENT-LENGTH:3\r\n\r\nabc\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd\r\n\r\n"
    foreign = gzip.compress(info) + gzip.compress(page)
    assert [(h["WARC-Type"], b[-4:]) for h, b in warc.read_archive(io.BytesIO(foreign))] == [("warcinfo", b"abc"), ("response", b"abcd")]
    got = warc.records(spark.createDataFrame([("a", bytearray(foreign))], "archive string, data binary")).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in got] == [(None, 4, warc.b32(b"abcd"))]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(gzip.compress(page[:-2]))))


def test_line_dedup_inserts_and_deletes(spark):
    a = [(1, "shared line here\nown line of one\nshort"), (2, "  SHARED LINE HERE \nshort\nshared line here"), (3, None), (None, "own line of one")]
    b = [(4, "own line of one\nbrand new line of four"), (5, "brand new line of four")]
    state = linededup.LineDedup(spark, shards=2)
    state.insert(docs(spark, a))
    state.insert(docs(spark, b))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in state.apply(docs(spark, a + b)).collect()}
    assert got == {1: (3, 0, a[0][1]), 2: (3, 2, "short"), 3: (1, 0, ""), None: (1, 1, ""), 4: (2, 1, "brand new line of four"), 5: (1, 1, "")}
    state.delete(spark.createDataFrame([(1,), (77,)], "doc_id bigint"))
    rest = [x for x in a + b if x[0] != 1]
    want = {r.doc_id: r.kept_text for r in linededup.dedup_lines(docs(spark, rest)).collect()}
    assert {r.doc_id: r.kept_text for r in state.apply(docs(spark, rest)).collect()} == want and want[2].count("\n") == 2
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    f = linededup.Cuckoo(20_000)
    f.insert(keys)
    assert f.contains(keys).all()
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    full = linededup.Cuckoo(100)  # far too small: what finds no place is stashed
    full.insert(keys[:2000])
    full = linededup.Cuckoo(0, full.data())
    assert full.stash and full.contains(keys[:2000]).all()
    full.delete(keys[:2000])
    assert not full.stash and not full.contains(keys[:2000]).any()


def test_line_dedup_in_any_order_of_insertions_and_deletions(spark, monkeypatch):
    """The filters decide which keys meet the exact tables; shards grow on the way; rows equal a brute-force count."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 40)
    rng = random.Random(4)
    pool = [f"a line of the pool number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"only in document {i} line {k}" for k in range(rng.randrange(1, 9)))) for i in range(90)]
    state = linededup.LineDedup(spark, shards=2)
    for part in (rows[60:], rows[:40], rows[30:65]):
        state.insert(docs(spark, part))
    state.delete(spark.createDataFrame([(i,) for i in range(0, 90, 4)], "doc_id bigint"))
    state.insert(docs(spark, [r for r in rows if r[0] % 8 == 0]))
    left = [r for r in rows if r[0] % 4 or r[0] % 8 == 0]
    first = {}
    for i, t in left:
        for line in set(t.split("\n")):
            first.setdefault(line, i)
    want = {i: "\n".join(x for x in t.split("\n") if first[x] == i) for i, t in left}
    assert {r.doc_id: r.kept_text for r in state.apply(docs(spark, left)).collect()} == want
    assert state.shards > 2 and state.filters.count() <= state.shards
    keys = state.refs.select("key").collect()
    assert len(keys) == len(first) == state.n_keys


@pytest.mark.parametrize("num", [50, 80, 90])
def test_trie_join_and_routing_lose_no_link(num):
    rng = np.random.default_rng(num)
    for _ in range(10):
        sets = {}
        for _ in range(5):
            base = rng.integers(0, 2**64, int(rng.choice([1, 2, 5, 9, 20, 60, 200])), dtype=np.uint64)
            for _ in range(10):
                k = int(rng.integers(0, len(base) // 3 + 1))
                s = np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 2**64, k // 2, dtype=np.uint64)]))
                sets[s.tobytes()] = s
        sets = list(sets.values())
        want, got = UnionFind(), UnionFind()
        files = [set(jaccard.signatures(s, num, 100).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    want.join(i, j)
                    assert files[i] & files[j]
        for i, j in jaccard.trie_join(sets, num, 100):
            got.join(i, j)
        assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]


def test_similar_documents_hard_rows(spark):
    got = {}
    for r in jaccard.similar_documents(docs(spark, HARD), 3, 90, 100).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got[1] == {(0, 1)} and got[3] == {(0, 3)} and got[5] == {(1, 4)} and got[None] == {(1, None)} and got[6] == {(1, 6)} and got[7] == {(1, 6)} and got[9] == {(1, 9)}
    assert jaccard.similar_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("words", "num", "tile", "targets"), [(5, 80, 2048, 1 << 20), (3, 90, 2048, 1 << 20), (5, 80, 3, 2000), (3, 50, 3, 2000)])
def test_similar_documents_brute_force(spark, monkeypatch, words, num, tile, targets):
    """With small tiles, coarse groups are split by their rare shingles and what remains is dealt over tiles."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "COUNTED", targets)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in d.collect()]
    rows += [(10_000 + i, f"{t} added{i}") for i, t in rows[:60]]
    common = " ".join(f"common{k}" for k in range(40))
    rows += [(20_000 + i, f"{common} " + " ".join(f"own{i}x{k}" for k in range(i % 23))) for i in range(60)]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), words, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), group[i]) for i in sets}
    assert len(set(group.values())) < len(group) - 50


def test_leading_shingles_are_ranked_in_packed_rows():
    """Holders of shared shingles are no rows of their own, and sets meet as by ranking all their shingles."""
    rng, parts = np.random.default_rng(5), 4
    names = rng.permutation(1 << 20)[:300].astype(np.uint64) << np.uint64(16)
    sets = {i: np.unique(rng.choice(names[i % 7 * 40 : i % 7 * 40 + 50], 12)) for i in range(200)}
    n = dict(zip(*np.unique(np.concatenate(list(sets.values())), return_counts=True), strict=True))
    spare = {i: int(rng.integers(-len(s) - 2, 1 - len(s) // 2)) for i, s in sets.items()}
    want, first = UnionFind(), {}
    for i, s in sets.items():
        ranked = sorted((n[x], x) for x in s if n[x] > 1)
        for _, x in ranked[: max(0, spare[i] + len(ranked))]:
            want.join(i, first.setdefault(x, i))
    ids = np.array(list(sets))
    dealt = jaccard._dealt(np.concatenate(list(sets.values())), np.repeat(ids, [len(s) for s in sets.values()]), parts)
    shared = list(jaccard._shared(parts)(iter([dealt])))
    assert sum(b.num_rows for b in shared) <= parts * parts
    spares = jaccard._row(len(ids), part=pa.array(jaccard._home(ids, parts)), doc_id=pa.array(ids), spare=pa.array(list(spare.values())))
    out = pa.Table.from_batches(jaccard._ranked(parts)(iter(pa.Table.from_batches([*shared, spares]).sort_by("part").to_batches())))
    packed = out.filter(pc.is_valid(out["data"])).sort_by("part").to_batches()
    got = UnionFind()
    for b in [*out.filter(pc.is_valid(out["a"])).to_batches(), *jaccard._meet(iter(packed))]:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            got.join(x, y)
    assert [want.find(i) for i in sets] == [got.find(i) for i in sets] and 7 < len({want.find(i) for i in sets}) < 150


def test_near_duplicates_send_no_table_through_the_driver(spark, monkeypatch):
    """Broadcasts of any row fail here; large groups are split too."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = docs(spark, [(i, f"{'alike ' * 9}{' '.join(f'w{i // 5}x{k}' for k in range(30))} {i}") for i in range(60)])
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        kept = corpus_pipeline.near_duplicate_stage(spark, rows, DIR).collect()
        groups = jaccard.similar_documents(rows, 3, 90, 100).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(r.doc_id for r in kept) == list(range(0, 60, 5))
    assert {r.doc_id: r.component_id for r in groups} == {i: i // 5 * 5 for i in range(60)}


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    lib, t, rng = sentencepiece.SentencePieceProcessor(model_file=spm.default_model()), spm.compiled(spm._load(None)), random.Random(2)
    texts = ["", " ", "  a  b ", "\n\n x", "a\r\nb", "日本語🙂", "▁x", "\x00", "x" * 500] + ["".join(rng.choice("ab \nthe▁\r;)é🙂 ") for _ in range(40)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<i4").tolist() == lib.encode(x)
        assert "▁" in x or t.decode(np.frombuffer(t.encode(x), "<i4")) == x
    assert {r.doc_id: r.n_ids for r in spm.digest_documents(docs(spark, HARD)).collect()}[1] == 0


def test_search_in_depth_finds_the_shortest_path(spark, monkeypatch):
    """It equals the path through the whole lattice and composes arcs at less than two thirds of the positions."""
    t = spm.Transducer(spm._load(None))
    texts = [r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").limit(60).collect()]
    words = sorted({spm.MARK + w for x in texts for w in x.split()}) + ["", "a", "aaaaaaaaaaaaa", "ééé☃☃x", "☃", "x" * 300 + "☃y"]
    composed, arcs = [], spm.Transducer._arcs
    monkeypatch.setattr(spm.Transducer, "_arcs", lambda self, s, i: composed.append(i) or arcs(self, s, i))
    assert len(words) > 1000
    for w in words:
        assert t.shortest(w) == t.path(w) == t.straight(w)
    assert len(composed) < 2 * sum(map(len, words)) * 2 / 3


def _field(number, value):
    def varint(v):
        out = b""
        while True:
            out, v = out + bytes([v & 127 | (128 if v > 127 else 0)]), v >> 7
            if not v:
                return out

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def _unigram_model(charsmap=b"", squeeze=0, fallback=True):
    rng = random.Random(8)
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    chars = "▁abcdeé日"
    pieces = {c: -8.0 - rng.random() for c in chars} | {"".join(rng.choice(chars) for _ in range(rng.randrange(2, 6))): -3.0 - 6 * rng.random() for _ in range(300)}
    names += [(p, s, 1) for p, s in pieces.items()]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in names)
    trainer = _field(2, _field(3, 1) + (_field(35, 1) if fallback else b""))
    normal = _field(3, _field(1, b"x") + (_field(2, charsmap) if charsmap else b"") + _field(3, 1) + _field(4, squeeze) + _field(5, 1))
    return data + trainer + normal


@pytest.mark.parametrize(("mapped", "squeeze", "fallback"), [(False, 0, True), (True, 1, True), (True, 0, False)])
def test_unigram_and_character_map_equal_the_library(mapped, squeeze, fallback):
    """A model put together here, not trained; the character map is the library's own rule."""
    import sentencepiece

    charsmap = b""
    if mapped:
        rule = dict(spm._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))
        charsmap = dict(spm._fields(rule[3]))[2]
    model = _unigram_model(charsmap, squeeze, fallback)
    lib, t, rng = sentencepiece.SentencePieceProcessor(model_proto=model), spm.Transducer(model), random.Random(3)
    texts = ["", " ", "  a  b ", "ﬁ ① Ａ", "e\u0301 e\u0301"] + ["".join(rng.choice("abcde é日xyz ①ﬁ\t　") for _ in range(rng.randrange(60))) for _ in range(300)]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<i4").tolist() == lib.encode(x), x


def test_long_words_without_spaces(spark):
    import sentencepiece

    lib, t = sentencepiece.SentencePieceProcessor(model_file=spm.default_model()), spm.compiled(spm._load(None))
    texts = ["语" * 10_000, "一二" * 5000, "☃" * 10_000, "a ☃☃ " + "é" * 10_000, "日本語のテキスト" * 1500, "ab" * 5000]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<i4").tolist() == lib.encode(x)
    got = {r.doc_id: (r.n_ids, r.round_trip) for r in spm.digest_documents(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: (len(lib.encode(x)), True) for i, x in enumerate(texts)} and max(map(len, t.word), default=0) <= spm.LONG


def test_packing_invariants(spark):
    rows = HARD + [(100 + i, f"w{i} " * (i % 40 + 1)) for i in range(300)] + [(500 + i, "same text here") for i in range(20)]
    out = packing.pack(docs(spark, rows), capacity=50, per_source=3, shard=100).toPandas()
    words = sum(len((t or "").encode().split()) for _, t in rows)
    assert out.length.sum() == words and out.groupby("bin_id").length.sum().max() <= 50
    rest = out[out.length < 50]
    assert rest.groupby("bin_id").size().max() <= 3 and rest[rest.doc_id.between(500, 520)].groupby("bin_id").size().max() == 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    items = sorted(((rng.randrange(1, 40), rng.choice("abc"), bytes([rng.randrange(30)])) for _ in range(200)), reverse=True)
    bins, want = [], []
    for n, s, c in items:
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and c not in b[2] and b[1].count(s) < 2]
        k = min(fit)[1] if fit else len(bins)
        if k == len(bins):
            bins.append([100, "", set()])
        bins[k][0] -= n
        bins[k][1] += s
        bins[k][2].add(c)
        want.append(k)
    assert packing.best_fit(items, 100, 2) == want


def test_quality_model_sums_to_one_and_both_paths_agree(spark):
    d, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    ids = labels.where("quality = 1").select("doc_id")
    counts = quality.gram_counts(d.join(ids, "doc_id", "left_semi").select(F.lit("x").alias("lang"), "text"))
    chars = sorted({r.gram[-1] for r in counts.select("gram").collect()})
    grams = spark.createDataFrame([("x", quality.BOS * 2 + "th" + c) for c in chars], "lang string, gram string")
    total = sum(np.exp(r.logp) for r in quality.log_probs(grams, quality.kneser_ney(counts)).collect())
    assert 0.97 < total <= 1.0 + 1e-6
    a, b = (quality.perplexities(d, ids, most).toPandas().sort_values("doc_id").reset_index(drop=True) for most in (quality.BROADCAST, 0))
    assert a.equals(b)  # the choice by size changes no figure
    hard = quality.classify(docs(spark, HARD).unionByName(d.limit(80), allowMissingColumns=True), labels)
    assert hard.count() == len(HARD) + 80 and not hard.where("doc_id = 1 AND n_symbols = 0").first().keep


def test_toxicity_on_hard_rows_and_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(d, labels.where(~toxicity.held_out(F.col("doc_id"))))
    hard = toxicity.score(docs(spark, HARD), model).collect()
    assert len(hard) == len(HARD) and all(0 <= r["__score"] <= 1 for r in hard)
    test = d.join(labels.where(toxicity.held_out(F.col("doc_id"))), "doc_id").select("text", "toxic").toPandas()
    s = model.scores(test.text.tolist())
    assert np.mean([(x > y) + 0.5 * (x == y) for x in s[test.toxic == 1] for y in s[test.toxic == 0]]) > 0.8
    empty = toxicity.fit(d.limit(0), labels.limit(0))
    assert empty.scores(["", "x"]).shape == (2,)


def test_pipeline_stages_on_hard_rows(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in HARD[:10]], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, d, DIR), name)
        assert out.count() > 0 and (name == "packing" or out.columns == d.columns)
        d = out


@pytest.mark.parametrize("most", [quality.BROADCAST, 0])
def test_quality_drops_texts_of_repeated_words(spark, monkeypatch, most):
    perplexities = quality.perplexities
    monkeypatch.setattr(quality, "perplexities", lambda docs, ids, carry: perplexities(docs, ids, most, carry))
    d, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    runs = ["The " * 200, "to " * 40 + "ening " * 40 + "the " * 40, "Thsh " * 30 + "of " * 30, "the of " * 100, "Und\n" * 5 + "Zqx " * 60]
    few = ["The the.", "of of the", "the"]
    more = spark.createDataFrame([(10_000 + i, t, "en") for i, t in enumerate(runs + few)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.keep for r in quality.classify(d.select("doc_id", "text", "lang").unionByName(more), labels).collect()}
    assert [got[10_000 + i] for i in range(len(runs + few))] == [False] * len(runs) + [True] * len(few)
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert np.mean([got[i] for i in good]) > 0.98


def test_word_classes_do_not_cross_texts():
    before, own = quality._classes(np.array([0, 0, 1, 0, 0, 2, 3, 4, 5, 6, 7, 8, 9, 2]), np.array([0, 4, 4, 14]))
    assert own.tolist() == [4, 0, 4, 1, 4, 4, 4, 4, 4, 4, 4, 4, 4, 3]
    assert before.tolist() == [5, 4, 0, 4, 5] + [4] * 9


def test_url_filter_resolves_links_and_lower_cases_hosts(spark):
    link, moved = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [(1, "http://d.com/a/2", link % "//Example.NET/en/1"), (2, "http://d.com/b/3?q=1", moved % "../a/2"), (3, "HTTP://D.com/b/3?q=1", ""), (4, "http://e.com/p", '<base href="http://b.net/q/">' + link % "r"), (5, "http://f.com/p", '<base href="/s/">' + link % " t "), (6, "http://F.com/s/t", moved % "//x.net/y"), (7, "http://g.com/x", link % "http://[bad/"), (8, "http://h.com/x", link % "mailto:a@b.net"), (9, "nothing", link % "/rel"), (10, "http://U@I.com/X", link % "?z"), (11, "http://u@i.com/X", ""), (12, None, link % "/x"), (13, "http://j.com/x", link % "//[bad/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.verdict, r.component) for r in urlfilter.judge(pages, rules=[("allow", "example.net/en/"), ("block", "net/")], default="none").collect()}
    assert len(got) == len(rows) and [got[i][0] for i in range(1, 7)] == ["allow"] * 3 + ["block"] * 3
    assert got[2] == got[3] == got[1] and got[5][1] == got[6][1] and got[4][1] == "http://b.net/q/r"
    assert [got[i][0] for i in range(7, 14)] == ["none"] * 7 and got[10][1] == "http://U@i.com/X" and got[11][1] == "http://u@i.com/X"
    links = spark.createDataFrame([("http://K.com/", "http://z.NET/")], "a string, b string")
    two = spark.createDataFrame([(1, "http://k.com/", ""), (2, "HTTP://K.COM/", "")], "page_id bigint, url string, html string")
    assert [r.verdict for r in urlfilter.judge(two, redirects=links).collect()] == ["block", "block"]
