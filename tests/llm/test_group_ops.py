"""Near duplicates, substrings, top-k, archives and the pipeline against plain restatements."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
import zstandard

from pointloom.llm import minhash, mixing, queries, secrets, substrings, topk, warc

SCHEMA = "doc_id long, text string"


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


# ---- near duplicates


def near_copies(seed, n=40, length=60):
    """A chain of drifting copies, straddling the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(r.choice(out) if out and r.random() < 0.7 else base)
        for _ in range(r.randrange(4)):
            w[r.randrange(length)] = f"n{r.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("k", "seed"), [(4, 1), (5, 2), (4, 3)])
def test_groups_of_drifting_copies(spark, k, seed):
    r = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(near_copies(seed) + near_copies(seed + 10, 15) + near_copies(seed, 5))]
    r.shuffle(rows)
    want = brute.groups(rows, k)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k).collect()
    same([(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got], [(i, n, c, i == c) for i, (sizes, c) in want.items() for n in sizes])


def test_groups_edges(edge_docs, edge_rows, no_docs):
    got = minhash.near_duplicates(edge_docs, k=4).collect()
    want = brute.groups([(i, t) for i, t, _ in edge_rows if i is not None], 4)
    same([(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None], [(i, want[i][1], i == want[i][1]) for i, _, _ in edge_rows if i is not None])
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert minhash.near_duplicates(no_docs).count() == 0


def test_groups_query(spark, sf_dir, real_docs):
    want = brute.groups([(r["doc_id"], r["text"]) for r in real_docs.collect()], 4)
    assert {r["doc_id"]: ([r["n_shingles"]], r["component_id"]) for r in queries.op7_minhash(spark, sf_dir).collect()} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (np.concatenate((common, rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
    s = minhash.signatures(np.concatenate((a, b, a)), np.array([0, 400, 800, 1200]), 200)
    assert (s != minhash._NONE).all()
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


@pytest.mark.parametrize("n", [1, 2, 7, 40, 3000])
def test_signatures_stop_early_without_a_difference(n):
    """A step-by-step restatement with whole permutations gives the same places."""
    h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    m = 24
    want = [minhash._NONE] * m
    for x in h[:3000]:
        p = list(range(m))
        for j in range(m):
            with np.errstate(over="ignore"):
                u = int(minhash._text.mix64(np.array([x + np.uint64(j + 1) * minhash._STEP]))[0])
            k = j + ((u & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(want[p[j]], np.uint64(j << 32 | u >> 32))
    assert minhash.signatures(h, np.array([0, n]), m)[0].tolist() == [int(x) for x in want]


def test_blocks_find_a_link_for_each_pair_of_components():
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 2, 50, 52, 100)]
    part = pd.DataFrame({"doc": range(6), "comp": [0, 0, 2, 3, 4, 5], "query": [True, False, True, True, False, True], "shingles": [s.tobytes() for s in sets]})
    u, v = minhash.compare_block(part, 80)
    assert {tuple(sorted(x)) for x in zip(u, v, strict=True)} >= {(0, 2), (3, 4)}
    assert all(5 not in x for x in zip(u, v, strict=True))


# ---- substrings


def passages(seed):
    r = random.Random(seed)
    shared = [[f"p{i}x{r.randrange(99)}" for _ in range(r.choice((19, 20, 21, 60)))] for i in range(6)]
    out = []
    for _ in range(30):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(shared) if r.random() < 0.6 else [f"u{r.randrange(10**6)}" for _ in range(r.randrange(40))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("window", "anchor", "cells"), [(20, 10, 1 << 12), (20, 20, 1 << 12), (20, 1, 1 << 12), (7, 3, 1 << 20)])
def test_substrings(spark, window, anchor, cells):
    rows = [(i * 3, t) for i, t in enumerate(passages(window + anchor))]
    got = substrings.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), window, anchor, cells).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute.substrings(rows, window)


def test_substrings_flush_often(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 50)
    rows = [(i, t) for i, t in enumerate(passages(4))]
    got = substrings.dedup(spark.createDataFrame(rows, SCHEMA).repartition(2), cells=1 << 12).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute.substrings(rows)


def test_substrings_edges(edge_docs, edge_rows, no_docs):
    rows = [(i if i is not None else 10**6, t) for i, t, _ in edge_rows]
    want = brute.substrings([(i, t) for i, t in rows if t != "no id here at all"])
    got = substrings.dedup(edge_docs, cells=1 << 16).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
    assert substrings.dedup(no_docs, cells=1 << 12).count() == 0
    long_ = 2**60 + 1
    t = passages(9)[0] + " " + " ".join(map(str, range(30)))
    big = no_docs.sparkSession.createDataFrame([(long_, t), (long_ + 1, t)], SCHEMA)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup(big, cells=1 << 12).collect()} == {long_: brute.substrings([(0, t)])[0][1], long_ + 1: len(t.split())}


def test_sketch_never_counts_too_little(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(passages(2) * 2)], "doc long, text string").repartition(5)
    planes = substrings.sketch(rows, 20, 10, 1 << 10)
    import pyarrow as pa

    t = rows.toPandas()
    seen = Counter()
    for _, first, h in substrings._words_of(iter([pa.RecordBatch.from_pandas(t, preserve_index=False)])):
        starts, at, a = substrings._anchors(h, first, 20, 10)
        seen.update(a[np.unique(at)].tolist())
    v = np.array([x for x, n in seen.items() if n > 1], np.uint64)
    assert len(v)
    for row, cell in enumerate(substrings._cells(v, 1 << 10)):
        assert substrings._bit(planes[row, 1], cell).all()


# ---- top-k


def vectors(n, dim, seed, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) if levels is None else rng.integers(-levels, levels, (n, dim)) / 256
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "dim", "levels"), [(300, 8, None), (300, 4, 2), (3, 5, None), (120, 1, 1)])
def test_top_k(spark, n, dim, levels, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rows = vectors(n, dim, n + dim, levels)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5, every=10).collect()
    q = {i: np.floor(np.array(v) * 256) for i, v in rows}
    want = []
    for i in range(0, n, 10):
        best = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i))[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    same(map(tuple, got), want)


def test_top_k_stops_early():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 3))
    v[0] = (9, 9, 9)
    lists = topk.Lists(np.arange(4000), v)
    i, s, depth = lists.top(np.array([1.0, 1.0, 1.0]), own=77, k=1)
    assert (i.tolist(), round(float(s[0]), 6)) == ([0], 27.0)
    assert depth < 200


def test_top_k_edges(spark):
    rows = [(0, [1.0, 1.0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0]), (3, []), (4, [0.0, 0.0]), (250, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as vec", "3 as score", "4 as rank")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 4, 0), (0, 4, 250, 0), (250, 1, 0, 0), (250, 2, 1, 0), (250, 3, 1, 0), (250, 4, 4, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


# ---- archives


def wanted(rows, least=0):
    top = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = top.get(p) if top.get(p) != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>page {i % 40} é</p>" * 30) for i in range(90)] + [(200, None, None), (201, "u", ""), (None, "u", "<p>x</p>"), (None, None, None), (7, "again", "<p>page 7 é</p>" * 30), (-3, "u", "a\r\n\r\nb"), (300, "u", "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as size", "3 as first").repartition(3)
    manifest = warc.write(df, least=least, roll=20_000)
    got = warc.read(manifest).collect()
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], wanted(rows, least))
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in rows}
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_archives_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same([tuple(r)[:5] for r in queries.op4_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], wanted(rows))


def archive(dictionary=True):
    rows = [warc.record(i, "http://x", f"<html>{i} some words again and again {i}</html>".encode() * 5, None, "2020-01-01T00:00:00Z") for i in range(50)]
    d = warc.train(rows) if dictionary else b""
    return rows, d, warc.pack(rows, d)


def test_dictionary_in_the_leading_frame():
    rows, d, data = archive()
    assert d and data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.unpack(data)) == rows
    n = int.from_bytes(data[4:8], "little")
    plain = data[:4] + len(d).to_bytes(4, "little") + d + data[8 + n :]
    assert list(warc.unpack(plain)) == rows
    with pytest.raises(ValueError):
        list(warc.unpack(data[8 + n :]))
    rows, _, data = archive(False)
    assert list(warc.unpack(data)) == rows
    skip = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    assert list(warc.unpack(data + skip)) == rows
    assert list(warc.unpack(b"")) == []


@pytest.mark.parametrize("harm", ["cut", "garbage", "dictionary", "flip"])
def test_broken_archives_raise(harm):
    _, _, data = archive()
    bad = {"cut": data[:-3], "garbage": data + b"garbage!", "dictionary": data[:4] + (4).to_bytes(4, "little") + b"none" + data[8:], "flip": data[:-20] + bytes([data[-20] ^ 255]) + data[-19:]}[harm]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.unpack(bad))


def test_broken_records_raise():
    good = warc.record(1, "http://x", b"abc", None, "2020-01-01T00:00:00Z")
    fields, block = warc.parse(good)
    assert warc.payload_of(fields, block) == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc.payload_of(*warc.parse(good.replace(b"abc", b"abd")))


# ---- pipeline


def restated(docs):
    """Ids after the first two stages, by the plain restatements."""
    rows = [(i, t) for (i, t, _), kept in zip(docs, brute.verdicts(docs), strict=True) if kept]
    groups = brute.groups(rows, 5)
    return {i for i, (_, c) in groups.items() if i == c}


def test_pipeline(spark, sf_dir, real_docs):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in real_docs.collect()]
    staged = real_docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        staged = stage(spark, staged, sf_dir)
        assert staged.columns == real_docs.columns, name
    texts = {r["doc_id"]: r["text"] for r in staged.collect()}
    assert texts.keys() == restated(docs)
    original = {i: t for i, t, _ in docs}
    for i, t in texts.items():
        assert "[REDACTED]" in t if brute.secrets(original[i]) else t == original[i] or "eyJ" in original[i] or "gh" in original[i] or "-----BEGIN" in original[i]
    copies = defaultdict(int)
    for r in mixing.mix(staged).collect():
        copies[r["doc_id"]] += r["copies"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_pipeline_stages_take_edges(spark, edge_docs, no_docs, sf_dir):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == edge_docs.schema
            assert stage(spark, docs, sf_dir).count() == out.count()
            docs = out
    assert corpus_pipeline.near_duplicates(spark, edge_docs, sf_dir).where("doc_id = 14").count() <= 1
    assert secrets.redact(edge_docs).count() == edge_docs.count()


def test_sketch_merged_in_two_steps_is_the_same(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(passages(3) * 2)], "doc long, text string").repartition(9)
    one = substrings.sketch(rows, 20, 10, 1 << 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * substrings.SHARDS))
        two = substrings.sketch(rows, 20, 10, 1 << 12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (one == two).all()
    assert one[:, 1].any()


def test_sketch_is_sized_to_the_input():
    assert substrings.plan(0) == (1 << 12, 1)
    for size in (10**6, 10**8, 3 * 10**9):
        cells, ranges = substrings.plan(size)
        assert ranges == 1
        assert 0.3 * substrings.LOAD < size / substrings.ANCHOR_BYTES / cells <= substrings.LOAD
    cells, ranges = substrings.plan(80 * 10**9)
    assert cells == substrings.CELLS
    assert size / substrings.ANCHOR_BYTES / cells / ranges <= substrings.LOAD
    assert substrings.plan(10**15) == (substrings.CELLS, substrings.RANGES)


def test_ranges_find_what_one_sketch_finds(spark, monkeypatch):
    monkeypatch.setattr(substrings, "plan", lambda size, cells=None: (1 << 12, 4))
    rows = [(i * 3, t) for i, t in enumerate(passages(12) + passages(13))]
    got = substrings.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute.substrings(rows)


def let_through(texts, cells):
    """(anchors a counter, share of windows that the merged sketch lets pass)."""
    import pyarrow as pa

    from pointloom.llm import _text

    col = pa.array(texts)
    anchors, places = [], []
    for buf, off, _, _ in _text.chunks(col, col):
        starts, ends, first = _text.words(buf, off)
        _, at, a = substrings._anchors(_text.span_hashes(buf, starts, ends), first, 20, 10)
        anchors.append(a[at[np.append(True, at[1:] != at[:-1])]])
        places.append(a[at])
    v, all_ = np.concatenate(anchors), np.concatenate(places)
    above = []
    for c in substrings._cells(v, cells):
        above.append(np.bincount(c, minlength=cells) > 1)
    passes = np.logical_and(*(x[c] for x, c in zip(above, substrings._cells(all_, cells), strict=True)))
    return len(v) / cells, passes.mean()


def test_load_decides_how_many_windows_pass(real_docs):
    texts = [r["text"] or "" for r in real_docs.collect()]
    size = sum(len(t.encode()) for t in texts)
    planned, _ = substrings.plan(size)
    load, share = let_through(texts, planned)
    _, least = let_through(texts, 1 << 22)
    full_load, full = let_through(texts, 1 << 10)
    assert load <= 1
    assert share - least < 0.35
    assert full_load > 5
    assert full > 0.95
