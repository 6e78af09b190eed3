"""Centroid clustering, conversation prefix tries and packing against restatements in plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import clustering, packing, prefix_trie, queries

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

# ---- clustering


def lloyd(rows, k=8, rounds=10, dim=64, scale=1024, salt="3:"):
    """(id, list) -> rows of (id, cluster, distance, cluster inertia, inertia, centroid), in whole numbers throughout."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d2(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if j in of else m for j, m in enumerate(c)]
    last = [(i, *near(v)) for i, v in kept]
    own = defaultdict(int)
    for _, d, j in last:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), c[j]) for i, d, j in last), key=repr)


def clusters(spark, rows, more="", **options):
    df = spark.createDataFrame([(i, v, *([None] * len(more.split(",")) if more else [])) for i, v in rows], "vec_id long, embedding array<double>" + (", " + more if more else "")).repartition(3)
    return sorted((tuple(r) for r in clustering.cluster(df, **options).collect()), key=repr)


def test_rounds_equal_plain_ones(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(400)]
    for k, rounds in ((4, 10), (9, 3), (1, 2), (3, 0)):
        assert clusters(spark, rows, k=k, rounds=rounds, dim=5) == lloyd(rows, k, rounds, 5)


def test_odd_vectors_and_clashing_columns(spark):
    r = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(3)]) for i in range(60)]  # ties in plenty
    rows += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]), (64, [nan, 0.0, 0.0]), (65, [0.0, inf, 0.0]), (66, [1.0] * 4)]
    rows += [(5, [0.5, 0.5, 0.5])] * 4 + [(None, [-0.25, 1e-9, -1e-9])] * 2 + [(-7, [0.0, 0.0, 0.0])]
    assert clusters(spark, rows, "cluster int, h string, kind string, data binary", k=8, dim=3) == lloyd(rows, 8, 10, 3)


@pytest.mark.parametrize("size", [1e3, 3e4])
def test_magnitudes_beyond_exact_doubles(spark, size):
    """Rows whose distances doubles cannot hold exactly go another way, beside rows that stay in doubles."""
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * (size if i % 3 == 0 else 1) for _ in range(64)]) for i in range(50)]
    assert clusters(spark, rows, k=3, rounds=4) == lloyd(rows, 3, 4)


def test_distances_by_all_ways():
    r = np.random.default_rng(6)
    for size in (10, 2**24, 2**29, 2**40):
        x = np.floor(r.uniform(-size, size, (20, 7)))
        x[0] = 1
        c = [[int(v) for v in row] for row in np.floor(r.uniform(-size, size, (3, 7)))]
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, m, strict=True)) for m in c] for row in x]
        got = [None] * 20
        for rows, d in clustering.distances(x, c):
            for i, v in zip(rows.tolist(), d.tolist(), strict=True):
                got[i] = [int(y) for y in v]
        assert got == want


def test_what_does_not_fit_fails(spark):
    with pytest.raises(Exception, match="does not fit"):
        clusters(spark, [(0, [1e30]), (1, [-1e30])], k=1, dim=1)
    with pytest.raises(Exception, match="too large"):
        clusters(spark, [(0, [1e308])], k=1, dim=1)


def test_few_or_no_vectors(spark):
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []
    assert clusters(spark, [(1, [1.0, 2.0])], dim=2) == [(1, 0, 0, 0, 0, [1024, 2048])]


# ---- prefix tries


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    return out


def plain_trie(rows):
    convs = rebuilt(rows)
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + (len(members[p]) - 1) * (len(brute.words(p[-1][1])) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def tried(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, depth int, label string, f1 long").repartition(3)
    return sorted(tuple(r) for r in prefix_trie.trie(df).collect())


def talks(n, seed, words=3, most=7, first=-40):
    r = random.Random(seed)
    return [(c, t, r.choice(("user", "assistant")), " ".join(r.choice("ab") for _ in range(r.randrange(words)))) for c in range(first, n + first) for t in range(r.randrange(1, most))]


def test_trie_equals_a_plain_one(spark):
    rows = talks(150, 1)
    assert tried(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("shard", [1, 7])
def test_heavy_levels_are_merged_apart(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "FEW", shard)
    monkeypatch.setattr(prefix_trie, "WAYS", 1)
    rows = talks(60, 2, most=5) + [(1000 + c, t, "user", "the same") for c in range(30) for t in range(4)]
    assert tried(spark, rows) == plain_trie(rows)


def test_deep_heavy_prefixes_beyond_the_cuts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 3)
    monkeypatch.setattr(prefix_trie, "FEW", 3)
    monkeypatch.setattr(prefix_trie, "WAYS", 1)
    monkeypatch.setattr(prefix_trie, "CUTS", (1, 2))
    rows = [(20 * c, t, "user", "same" if t < 5 else f"own {c}") for c in range(8) for t in range(9)]
    assert tried(spark, rows) == plain_trie(rows)


def test_long_conversations_and_late_branches_take_few_rounds(spark, monkeypatch):
    """400 turns by themselves, and 30 branches behind 150 common turns: no level of them is a round of its own."""
    rounds = []
    real = prefix_trie._upper
    monkeypatch.setattr(prefix_trie, "_upper", lambda nodes, tops: rounds.append(nodes.agg(F.max("depth")).first()[0]) or real(nodes, tops))
    rows = [(20, t, "user", f"t{t}") for t in range(400)] + [(20 * c, t, "user", "same" if t < 150 else f"own {c}") for c in range(2, 32) for t in range(152)]
    assert tried(spark, rows) == plain_trie(rows)
    assert rounds[0] <= 6


def test_odd_turns(spark):
    rows = [(0, None, None, "x y"), (0, None, None, "x y"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "", "user"), (3, 0, "a", ""), (None, 1, "user", "no conversation"), (40, 5, "r", "one " * 30_000)]
    rows += [(c, 0, "user", "x y") for c in (7, 8, 9, -3, -25, 2**62)] + [(41, t, "user", f"t{t}") for t in range(90)]
    assert tried(spark, rows) == plain_trie(rows)
    assert tried(spark, []) == [] and tried(spark, [(None, 1, "a", "b")]) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert tried(spark, rows) == plain_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_bit_string_of_a_level_order_trie():
    #     0 -> 1, 2; 1 -> 3; 2 -> 4, 5
    t = prefix_trie.Louds(np.array([2, 0, 1, 1, 2, 2]), np.array([3, 0, 1, 2, 4, 5]), np.array([1, -1, 0, 0, 2, 2]))
    assert "".join(str(int(b)) for b in t.bits) == "11010110" + "000" and t.children.tolist() == [2, 1, 2, 0, 0, 0]
    assert t.rollup(np.ones(6, int)).tolist() == [6, 2, 3, 1, 1, 1]


def test_ends_of_many_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 60)
    rows = [(20 * c, 0, "user", "hello") for c in range(500)]
    assert tried(spark, rows) == plain_trie(rows)


# ---- packing


@pytest.fixture(scope="module")
def encoder():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(rows, docs, encoder, room, end=0):
    """Every id once and in its place, sequences gapless and padded nowhere."""
    want, got = defaultdict(int), defaultdict(list)
    for i, text in docs:
        want[i, np.append(np.array(encoder.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(end)).astype("<u4").tobytes()] += 1
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i in {i for i, _ in want}:
        ids = defaultdict(int)
        for (j, x), n in want.items():
            if i == j:
                ids[x] += n
        if sum(ids.values()) == 1:
            mine = sorted(got[i], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in mine) == next(iter(ids))
            assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()]
        assert sum(r["length"] for r in got[i]) == sum(n * len(x) // 4 for x, n in ids.items())
    assert got.keys() == {i for i, _ in want}
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1].tolist()]
        assert 0 < size <= room and size & (size - 1) == 0
        assert all(4 * r["length"] == len(r["ids"]) > 0 for r in s)
    return sequences


@pytest.mark.parametrize("room, group", [(1024, 4096), (64, 3), (1, 5), (8, 1)])
def test_all_ids_in_full_sequences(edge_docs, edge_rows, encoder, room, group):
    rows = packing.pack(edge_docs, P.path("byte_bpe_50k.json"), room=room, group=group).collect()
    check_packing(rows, [(i, t) for i, t, _ in edge_rows], encoder, room)


def test_no_documents(no_docs):
    assert packing.pack(no_docs, P.path("byte_bpe_50k.json")).collect() == []


def test_packing_query(spark, sf_dir, real_docs, encoder):
    docs = [tuple(r) for r in real_docs.select("doc_id", "text").collect()]
    ids = {i: np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    rows = queries.op13_packing(spark, sf_dir).collect()
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert len({r["sequence_id"] for r in rows}) <= sum(map(len, ids.values())) / 1024 + 11


def test_first_fit_decreasing_by_the_tree():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 257):
        sizes = r.integers(1, 65, n)
        want, room = np.zeros(n, np.int64), []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, left in enumerate(room) if left >= sizes[i]), len(room))
            room += [64] * (b == len(room))
            room[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes, 64).tolist() == want.tolist()


def test_stretches_encode_like_the_whole(encoder):
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", " ", " ", "  ", "\n", "1", "é", "'s", ".", "　", " ", "<|endoftext|>", "\U0001f600"]) for _ in range(r.randrange(300)))
        cut = packing.pieces(t, 16)
        assert "".join(cut) == t
        assert [i for x in cut for i in encoder.encode(x, add_special_tokens=False).ids] == encoder.encode(t, add_special_tokens=False).ids


def test_ids_by_rank_are_the_tokenizers(encoder, edge_rows, real_docs):
    fast, r = packing.Encoder(P.path("byte_bpe_50k.json")), random.Random(9)
    assert fast.fast is not None
    signs = ["a", "b", "th", "e", "E", " ", "  ", "\n", "12", "é", "e\u0301", "'s", "'S", ".", "!!", "\u3000", "\u0085", "\x1c", "<|endoftext|>", "\U0001f600", "中文", "ß", "\x00", "x" * 30, " " * 1500, "\n " * 900]
    texts = [t or "" for _, t, _ in edge_rows] + [r_["text"] or "" for r_ in real_docs.select("text").collect()]
    texts += ["".join(r.choice(signs[:-2] if k % 10 else signs) for _ in range(r.randrange(400))) for k in range(600)]
    texts += list(encoder.get_vocab())[::7] + [" ".join(list(encoder.get_vocab())[k::50]) for k in range(50)]
    for t in texts:
        assert fast(t).tolist() == encoder.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_go_through_the_library():
    path = P.path("word_bpe_49k.json")
    e, t = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert e.fast is None and e("Hello there, World").tolist() == t.encode("Hello there, World", add_special_tokens=False).ids


def test_crc_of_ids(spark):
    row = spark.range(1).select(packing.ids_crc32(F.lit(np.array([7, 70000], "<u4").tobytes())).alias("c")).first()
    assert row["c"] == zlib.crc32(np.array([7, 70000], "<u4").tobytes())
