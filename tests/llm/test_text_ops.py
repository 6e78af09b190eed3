"""Encoding, rules, secrets, licences, mixture and quality model against plain restatements."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import _text, bpe, licenses, mixing, quality_model, quality_rules, queries, secrets

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
FORMER = "doc_id"


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys_and_comes_back(edge_docs, edge_rows, library):
    path = queries.vocabulary()
    back = bpe.decode(bpe.encode(edge_docs, path), path)
    same([(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in back.collect()], [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in edge_rows])


def test_bpe_offsets(edge_docs, edge_rows, library):
    texts = Counter((t or "").encode() for _, t, _ in edge_rows)
    for r in bpe.encode(edge_docs.where("length(text) < 5000"), queries.vocabulary()).collect():
        cuts = [0, *r["ends"]]
        pieces = [library.decode_single_token_bytes(i) for i in r["ids"]]
        assert [b - a for a, b in zip(cuts, cuts[1:], strict=False)] == [len(x) for x in pieces]
        assert b"".join(pieces) in texts


def test_bpe_random_signs(library):
    r = random.Random(5)
    codec = bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), bpe.code_classes())
    texts = ["".join(r.choice("ab's'tvreldm  \n\t 12é,.!́\U0001f600中\0\r ") for _ in range(r.randrange(50))) for _ in range(3000)]
    ids, counts = codec.encode(texts)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode_ordinary(t)


def test_bpe_merges_in_order_of_rank():
    m = bpe.Merger({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6})
    cases = {b"abc": (5,), b"aaab": (6, 3), b"aaa": (6, 0), b"": (), b"c": (2,), b"cab" * 40: (2,) + (5,) * 39 + (3,)}
    assert dict(zip(cases, m.merge_all(list(cases)), strict=True)) == cases
    r = random.Random(7)
    some = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 60))) for _ in range(500)]
    assert m.merge_all(some) == [m.merge_long(x) for x in some]


def test_bpe_query_and_empty(spark, sf_dir, real_docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in real_docs.collect()}
    for r in queries.op1_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(texts[r["doc_id"]]))
    assert bpe.encode(no_docs, queries.vocabulary()).count() == 0


def test_bpe_decodes_spans_by_the_retained_ends(edge_docs, edge_rows):
    encoded = bpe.encode(edge_docs, queries.vocabulary())
    texts = [(i, (t or "").encode()) for i, t, _ in edge_rows]
    for start, end in ((0, 1), (3, 11), (5, 5), (100, 163), (0, 10**6), (150_000, 150_040)):
        got = bpe.decode_span(encoded, queries.vocabulary(), start, end).collect()
        same([(r["doc_id"], bytes(r["decoded"])) for r in got], [(i, t[start:end]) for i, t in texts])
    moved = encoded.withColumn("ends", F.transform("ends", lambda e: e + 1))
    assert [bytes(r["decoded"]) for r in bpe.decode_span(moved.where("doc_id = 8"), queries.vocabulary(), 3, 11).collect()] != [t[3:11] for i, t in texts if i == 8]


# ---- quality rules


def test_word_kernels_on_chunks():
    import pyarrow as pa

    texts = ["", "a bb  ccc", None, " x ", "é y\n", "z" * 50]
    seen = []
    for buf, off, a, n in _text.chunks(pa.array(range(6)), pa.array(texts), most=10):
        starts, ends, first = _text.words(buf, off)
        for d in range(n):
            seen.append([bytes(buf[s:e]).decode() for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]], strict=True)])
    assert seen == [brute.words(t) for t in texts]


def test_rules(edge_docs, edge_rows, no_docs):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.judge(edge_docs).collect()
    same([(r["doc_id"], *(r[c] for c in cols)) for r in got], [(i, *brute.measures(t)) for i, t, _ in edge_rows])
    assert all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.judge(no_docs).count() == 0
    want = Counter(zip([i for i, _, _ in edge_rows], brute.verdicts(edge_rows), strict=True))
    assert Counter((r["doc_id"], r["kept"]) for r in got) == want
    assert Counter(r["doc_id"] for r in quality_rules.keep(edge_docs).collect()) == Counter(i for i, kept in want.elements() if kept)


def test_rules_query(spark, sf_dir, real_docs):
    texts = {r["doc_id"]: r["text"] for r in real_docs.collect()}
    for r in queries.op9_quality_rules(spark, sf_dir).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.measures(texts[r["doc_id"]])
        assert r["kept"] or r["base_failed"] or r["soft_failed"]


def test_verdict_decides_beside_the_base_rules(spark):
    """On the given tables documents fail by the verdict alone, others that fail a soft rule stay, and all that fail none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judge(docs).collect()
    out = [r for r in got if not r["kept"] and not r["base_failed"]]
    assert out and all(r["soft_failed"] for r in out)
    assert any(r["kept"] and r["soft_failed"] for r in got)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert {r["doc_id"]: r["kept"] for r in got} == {i: k for (i, _, _), k in zip(rows, brute.verdicts(rows), strict=True)}
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_bad_host_counts_only_against_failing_documents(spark):
    good, loud = " ".join(f"word{i}" for i in range(40)), " ".join(f"word{i} ###" for i in range(40))
    rows = [(i, loud if i < 95 else good, "bad") for i in range(100)] + [(100 + i, loud if i == 0 else good, f"h{i % 5}") for i in range(100)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(95))
    assert all(got[i]["kept"] for i in range(95, 200))
    assert 0.5 < got[0]["host_rate"] < 0.95


# ---- secrets


def test_secrets(edge_docs, edge_rows, no_docs):
    extra = [" secret=token: abcdefgh", "passwd='a.b' API_KEY : zzzzzzzz", "AKIA" * 6, "0" * 23 + " " + "f" * 24 + "g", "TOKEN==abcdef", "é token=ééabcdefgh token=abcdef", "\U0001f600password:\U0001f600 password: 123456"]
    docs = edge_docs.select("doc_id", "text").unionByName(edge_docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = [(i, t) for i, t, _ in edge_rows] + [(1000 + i, t) for i, t in enumerate(extra)]
    base = [r.kind for r in secrets.BASE]
    got = [(r["doc_id"], [tuple(s) for s in r["spans"] if s["kind"] in base]) for r in secrets.scan(docs).collect()]
    same(got, [(i, brute.secrets(t)) for i, t in rows])
    assert secrets.scan(no_docs).count() == 0
    assert secrets.redact(no_docs).count() == 0


def test_ledger_scans_new_blobs_only(spark):
    a = spark.createDataFrame([(1, "token=abcdef1"), (2, "clean"), (3, "token=abcdef1")], "doc_id long, text string")
    ledger = secrets.extend(a)
    assert {(r["blob_id"], len(r["spans"])) for r in ledger.collect()} == {(brute.sha("token=abcdef1"), 1), (brute.sha("clean"), 0)}
    poisoned = ledger.withColumn("spans", F.expr("transform(spans, s -> named_struct('start', 77L, 'rank', 0, 'end', 88L, 'kind', 'assign'))"))
    b = a.unionByName(spark.createDataFrame([(4, "token=new12345")], a.schema))
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"]] for r in secrets.scan(b, poisoned).collect()}
    assert got == {1: [(77, 0, 88)], 2: [], 3: [(77, 0, 88)], 4: [(0, 0, 14)]}
    assert {r["blob_id"] for r in secrets.unseen(b, ledger, secrets.RULES_VERSION, "doc_id", "text").collect()} == {brute.sha("token=new12345")}
    assert secrets.unseen(b, ledger, "2", "doc_id", "text").count() == 3
    assert secrets.extend(b, ledger).count() == 3


def test_redaction_replaces_the_spans(edge_docs, edge_rows):
    out = secrets.redact(edge_docs)
    assert out.columns == edge_docs.columns
    want = []
    for i, t, _ in edge_rows:
        at, new, spans = 0, "", brute.secrets(t)
        for s, _, e, _ in spans:
            if s > at or (s == 0 and not new):
                new += t[at:s] + "[REDACTED]"
            at = max(at, e)
        want.append((i, t if not spans else new + t[at:]))
    same([(r["doc_id"], r["text"]) for r in out.collect()], want)


# ---- licences


def test_licenses(spark, edge_docs, no_docs):
    s = licenses.SENTENCES
    mit = f"MIT License\n\nCopyright (c) X\n\n{s['mit_grant']}:\n\n{s['mit_notice']}.\n\n{s['mit_warranty']}. IN NO EVENT."
    apache = f"{s['apache_header']};\n{s['apache_comply']}.\n {s['apache_obtain']}\n\n   http://x/y\n\n{s['apache_basis']}."
    bsd2 = f"{s['bsd_redistribution']}:\n\n1. {s['bsd_source']}.\n2. {s['bsd_binary']}."
    cases = [(mit, ["MIT"]), (mit.replace(" ", "\n", 30).upper(), ["MIT"]), (apache, ["Apache-2.0"]), ("Licensed under the Apache License, Version 2.0.\nText", ["Apache-2.0"]), (bsd2, ["BSD-2-Clause"]), (bsd2 + " " + s["bsd_endorse"] + ".", ["BSD-3-Clause"]), ("Text.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["MIT", "CC-BY-NC-4.0"]), ("I lost my license", []), (s["mit_notice"] + ".", []), (None, []), ("", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()} == {i: x for i, (_, x) in enumerate(cases)}
    assert licenses.scan(edge_docs).count() == edge_docs.count()
    assert licenses.scan(no_docs).count() == 0


def test_short_notices(spark):
    cases = [("This project is licensed under the MIT License.", ["MIT"]), ("MIT License, see the file.", ["MIT"]), ("// SPDX-License-Identifier: MIT", ["MIT"]), ("Licensed under the Apache License 2.0", ["Apache-2.0"])]
    cases += [("# SPDX-License-Identifier: Apache-2.0\nimport os", ["Apache-2.0"]), ("Some words. Released under the BSD 3-Clause License.\nMore words", ["BSD-3-Clause"]), ("MIT.", []), ("SPDX-License-Identifier: none", []), ("Unlicensed under the MIT License agreement of 1999", [])]
    got = licenses.scan(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == dict(enumerate(x for _, x in cases))


def test_license_versions_in_divided_sentences(spark):
    grant = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} {}."
    later, only = "either version {} of the License, or (at your option) any later version", "version {} of the License"
    cases = [(grant.format(kind, sign, form.format(v)), [f"{name}-{end}"]) for kind, v, name in (("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")) for sign in ",;" for form, end in ((later, "or-later"), (only, "only"))]
    cases += [(grant.format("", ";", later.format(2)).replace(" ", "\n") + "\nOther text.", ["GPL-2.0-or-later"]), (grant.format("", ";", later.format(4)), [])]
    cases += [(f"{licenses.SENTENCES['mpl_notice']}.", ["MPL-2.0"]), (licenses.SENTENCES["mpl_notice"].replace("2.0", "1.1") + ".", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for lines in (True, False):
        assert {r["doc_id"]: r["licenses"] for r in licenses.scan(df, lines=lines).collect()} == {i: x for i, (_, x) in enumerate(cases)}


def test_licenses_on_lines_of_their_own(spark):
    s = licenses.SENTENCES
    cases = [("of%%% thonhare.***\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("nttint |\nAll rights reserved.", ["proprietary"]), ("a line\n * All rights\n * reserved\nanother", ["proprietary"]), (f"MIT License\nCopyright (c) X\n{s['mit_grant']}:\n{s['mit_notice']}\nend", ["MIT"]), ("Text. All rights reserved\nmore", ["proprietary"]), ("all\nAll rights reserved\nLicensed under CC BY 4.0\nend", ["CC-BY-4.0", "proprietary"]), ("not All rights reserved\nhere", []), ("Here\nAll rights reserved by X", []), ("\n \n" * 100_000 + "! " * 100_000 + "license", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()} == {i: x for i, (_, x) in enumerate(cases)}


# ---- mixture


def test_targets(spark):
    r = random.Random(2)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i}é"[i % 2 :]: r.choice((0, r.randrange(1, 50), r.randrange(1000))) for i in range(n)}
        if n > 2:
            sizes[None] = 40
        sizes = {k: v for k, v in sizes.items()}
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_mix(edge_docs, edge_rows, no_docs):
    got = mixing.mix(edge_docs).collect()
    size = defaultdict(int)
    for _, t, s in edge_rows:
        size[s] += len(brute.words(t))
    same([(r["doc_id"], r["size"], r["source_size"]) for r in got], [(i, len(brute.words(t)), size[s]) for i, t, s in edge_rows])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.take(no_docs).count() == 0


def test_mix_comes_near_and_reruns_agree(spark, real_docs):
    a, b = (sorted(map(tuple, mixing.mix(real_docs.repartition(n)).collect())) for n in (2, 5))
    assert a == b
    by = defaultdict(lambda: [0, 0, 0])
    for _, source, size, _, target, _, taken in a:
        by[source][0] += taken
        by[source][1] = target
        by[source][2] = max(by[source][2], size)
    assert all(abs(taken - target) <= most for taken, target, most in by.values())
    copies = sum(r[5] for r in a)
    out = mixing.take(real_docs)
    assert out.columns == real_docs.columns
    assert out.count() == copies


def test_mix_larger_budget_takes_more(real_docs):
    small = {r["doc_id"]: r["copies"] for r in mixing.mix(real_docs, weights=(1.0, 9.0)).collect()}
    large = {r["doc_id"]: (r["copies"], r["source"]) for r in mixing.mix(real_docs, weights=(2.0, 9.0)).collect()}
    first = min(s for _, s in large.values())
    assert all(small[i] <= c for i, (c, s) in large.items() if s == first)


# ---- quality model


def test_quality_model_on_held_out_labels(spark, real_docs, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_model.classify(docs, labels.where("doc_id % 3 <> 0"))
    held = out.join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").select(F.avg(((F.col("posterior") >= 0.5) == (F.col("quality") > 0)).cast("double"))).first()[0]
    assert held > 0.95
    assert out.count() == docs.count()


def test_toxic_stems_on_held_out_labels_by_language(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_model.classify(docs, labels.where("doc_id % 3 <> 0")).select("doc_id", (F.col("toxic") > 0).cast("double").alias("hit"))
    held = out.join(labels.where("doc_id % 3 = 0 and toxic is not null").select("doc_id", F.col("toxic").alias("told")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rates = {(r["lang"], r["told"]): r["rate"] for r in held.groupBy("lang", "told").agg(F.avg("hit").alias("rate")).collect()}
    assert {x for x, _ in rates} == {"en", "de", "fr", "es"}
    assert all(rate > 0.85 if told else rate < 0.04 for (_, told), rate in rates.items())


def test_only_the_sign_words_themselves_are_signs():
    import pyarrow as pa

    def chunk(text):
        return next(_text.chunks(pa.array([0]), pa.array([text]), most=1 << 30))[:2]

    def hashes(text):
        buf, off = chunk(text)
        return np.unique(quality_model._hashes(buf, *_text.words(buf, off)[:2]))

    mark = " ".join(f"mark{i}" for i in range(20))
    toxic = np.array([True] * 100 + [False] * 100)
    signs, odds = quality_model.fit_signs([hashes(f"word{i % 50} both {mark if t else 'clean'}") for i, t in enumerate(toxic)], toxic)
    model = quality_model.Model(np.zeros(22), np.ones(22), np.zeros(23), signs, odds)
    assert signs.keys.tolist() == hashes(mark).tolist()
    assert model.toxic(*chunk("none here but Mark3, in the end")).tolist() == [odds[0]]
    unseen = " ".join(f"unseen{i}" for i in range(300_000))
    low = {h & 0xFFFFF for h in hashes(unseen).tolist()}
    assert any(h & 0xFFFFF in low for h in signs.keys.tolist())
    assert model.toxic(*chunk(unseen)).tolist() == [0.0]


def test_quality_model_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_model.classify(edge_docs, none)
    assert out.count() == edge_docs.count()
    assert out.where("kept").count() == edge_docs.count()
    one = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (3, None, None)], none.schema)
    assert quality_model.classify(edge_docs, one).where("posterior is null or kept is null").count() == 0
    assert quality_model.classify(no_docs, one).count() == 0


def test_sparse_paths_shrink(spark):
    rows = [("h1", "p1", 1.0)] * 500 + [("h1", "p2", 0.0)] + [("h2", "p1", 0.0)] * 300 + [("h2", "p2", 1.0)] * 100 + [("h3", None, 1.0)]
    got = {(r["host"], r["path"]): r for r in quality_model.site_rates(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert got["h1", "p2"]["path_rate"] > 0.2
    assert got["h2", "p1"]["path_rate"] < 0.1
    assert got["h1", "p1"]["host_rate"] > 0.9
    assert got["h3", None]["host_rate"] < 1


def test_digest_of_spans():
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
