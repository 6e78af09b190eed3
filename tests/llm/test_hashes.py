"""Words, lines and sequences that arithmetic hashes confuse stay apart."""

import brute
import numpy as np

from pointloom.llm import _text, minhash, quality_rules, substrings

SCHEMA = "doc_id long, text string, source string"
#: A Thue-Morse word and its complement: sums of bytes times powers of any odd base agree on them modulo 2**64.
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = ONE.translate({97: 98, 98: 97})


def hashes(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return _text.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def test_spans_of_all_lengths_differ_and_places_do_not_count():
    words = [ONE[:n] for n in range(600)] + [OTHER[:n] for n in range(1, 600)] + [ONE, OTHER, "a\0", "a", "a\0\0"]
    seen = dict(zip(words, hashes(words).tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
    assert hashes(words[::-1]).tolist() == [seen[w] for w in words[::-1]]


def test_windows_and_sequences_differ():
    pair = hashes(["x", "y"])
    bits = np.array([bin(i).count("1") % 2 for i in range(2048)])
    a, b = pair[bits], pair[1 - bits]
    for k in (2, 4, 5, 16, 20, 1024, 2048):
        assert _text.window_hashes(a, k)[0] != _text.window_hashes(b, k)[0]
    assert _text.window_hashes(np.tile(pair, 30), 20)[0] == _text.window_hashes(np.tile(pair, 30), 20)[2]
    keys = _text.digests(np.concatenate((a, b, a)), np.array([0, 2048, 4096, 4096, 6144]))
    assert (keys[:, 0] == keys[:, 3]).all()
    assert len(set(keys[0].tolist())) == len(set(keys[1].tolist())) == 3


def test_lines(spark):
    rows = [(1, f"{ONE}\n{OTHER}", "s"), (2, f"{ONE}\n{ONE}", "s")]
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: brute.measures(t)[3] for i, t, _ in rows} == {1: 0, 2: 1}


def test_windows_of_documents(spark):
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{ONE} {tail}", "s"), (2, f"{OTHER} {tail}", "s"), (3, f"{ONE} {tail}", "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA), cells=1 << 12).collect()}
    assert got == brute.substrings([r[:2] for r in rows])


def test_groups(spark):
    rows = [(3, ONE, "s"), (4, OTHER, "s"), (5, ONE, "s"), (6, "x", "s")]
    words = ("red", "green")
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows += [(10, " ".join(words[b] for b in bits), "s"), (11, " ".join(words[1 - b] for b in bits), "s")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4).collect()}
    assert got == {i: c for i, (_, c) in brute.groups([r[:2] for r in rows], 4).items()}
    assert got[3] != got[4]
