"""The queries over the driver's tables: op<N>_<name>, one an operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, clustering, licenses, minhash, mixing, packing, prefix_trie, quality_model, quality_rules, secrets, substrings, topk, warc
from pointloom.plans.storage import scratch_path


def small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers in batches of about 8 MB, unless the session sets a size itself: what lies between
    JVM and worker counts in an executor's memory for each of its tasks."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The rank file that op1 and the pipeline encode by; the split that bpe makes must be the one it comes with."""
    import public_tokenizers

    if public_tokenizers.PATTERN != packing.SPLIT:
        raise ValueError("the vocabulary comes with another pattern than the one that bpe splits by")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: number of ids, digests of the ids and of the decoded bytes."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    back = bpe.decode(encoded, vocabulary(), ends_col="ends")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth embedding."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by evidence, host (source) and path (language within the source)."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, copies as revisits, and the archives read back."""
    manifest = warc.write(table(spark, sf_dir, "pages"), least=0)
    return warc.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by sentence rules; a known sentence may also stand on lines of its own."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: sources weigh 5, 2, 1 in turn, at most three copies of a document."""
    m = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_repeat=3.0)
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that windows of 20 words repeat from an earlier place."""
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents measured and judged, with the verdict of their source."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "soft_failed", F.round("host_rate", 6).alias("host_rate"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by a ledger begun for them: counts and digest of the base kinds, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"), scratch_path(spark, "secrets-ledger"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in eight clusters after ten rounds, with distances and inertias."""
    out = clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, salt="3:")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of all rebuilt conversations with their rollups."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), group=20, heads=4)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 1024: place, length and checksum of each piece."""
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), room=1024, end=0)
    return out.select("doc_id", "start", "length", packing.ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _oracle_op10() -> str:
    """Places by cumulated lengths of pieces and matches, per kind."""

    def one(rank: int, r: secrets.Rule) -> str:
        pat = r.pattern.replace("'", "''")
        return f"""select doc_id, {rank} as rank, '{r.kind}' as kind, unnest(range(1, len(ms) + 1)) as i, ms, gs, own from (
            select doc_id, regexp_extract_all(t, '{pat}') ms, string_split_regex(t, '{pat}') gs, regexp_extract_all(t, '{pat}', {r.group}) own from d)"""

    rules = " union all ".join(f"select doc_id, rank, kind, i, length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i-1], '')) as s, length(ms[i]) as m, length(own[i]) >= {r.least} as ok from ({one(k, r)})" for k, r in enumerate(secrets.RULES))
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
        f as (select doc_id, rank, kind, cast(s as bigint) as s, cast(s + m as bigint) as e from ({rules}) where ok),
        g as (select doc_id, count(*) filter (rank = 0) n_assign, count(*) filter (rank = 1) n_access, count(*) filter (rank = 2) n_hex,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as b, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from f group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join g using (doc_id)"""


_ORACLE_OP2 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5"""

def _oracle_op5() -> str:
    """Sentences looked up in a list, identifiers joined, then the rules one after the other.

    Lines that make a known sentence are cut off first. There is no looking around in this dialect, so ends of lines and of
    sentences get marks on either side (characters 1 to 3, which are noise), of which a match takes one each.
    """
    known = ", ".join(f"('{k}', '{v}')" for k, v in licenses.known().items())
    white = r"[ \t\n\x0b\f\r]"
    words = "|".join("[^a-z0-9]+".join(x.split()) for x in sorted(licenses.known(), key=len, reverse=True))
    line = rf"(?:(?:\A|\x02)[^a-z0-9\n\x02]*|\x03\x02?{white}\x02?[^a-z0-9\n.!?;:\x01\x02\x03]*)(?:{words})[^a-z0-9\n\x01\x02]*?(?:\x02|\z|\x01)"
    marked = rf"replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{licenses.TAG}', '\1 ', 'g'), '[\x01-\x03]', chr(127), 'g'), '([.!?;:])({white})', '\1' || chr(1) || chr(3) || '\2', 'g'), chr(10), chr(2) || chr(10) || chr(2))"
    cut = rf"regexp_replace(regexp_replace({marked}, '{line}', chr(10) || chr(10) || '\0' || chr(10) || chr(10), 'g'), '[\x01-\x03]', '', 'g')"
    sql = f"""with k(sentence, name) as (values {known}), c as (select doc_id, string_split_regex({cut}, '{licenses.ENDS}') as ss from documents),
        s as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as i from c),
        n as (select doc_id, i, coalesce(k.name, '_') as name from s left join k on k.sentence = trim(regexp_replace(s.sentence, '{licenses.NOISE}', ' ', 'g'))),
        f as (select doc_id, ',' || string_agg(name, ',' order by i) || ',' as found, coalesce(string_agg(name, ',' order by i) filter (name <> '_'), '') as sentences, count(*) filter (name <> '_') as n_sentences from n group by doc_id),
        t0 as (select doc_id, n_sentences, sentences, regexp_replace(found, ',(?:_,)+', ',_,', 'g') as rest, cast([] as varchar[]) as got from f)"""
    for k, (name, ids) in enumerate(licenses.RULES):
        pat = licenses.rule_pattern(ids)
        sql += f""", t{k + 1} as (select doc_id, n_sentences, sentences, case when regexp_matches(rest, '{pat}') then regexp_replace(rest, '{pat}', ',_,', 'g') else rest end as rest, case when regexp_matches(rest, '{pat}') and not list_contains(got, '{name}') then list_append(got, '{name}') else got end as got from t{k})"""
    return sql + f" select doc_id, n_sentences, sentences, array_to_string(got, ',') as licenses from t{len(licenses.RULES)}"


_ORACLE_OP4 = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, h, strlen(h) as n, sha1(h) as x from p),
    t as (select h, max(page_id) as first from p group by h),
    b as (select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> sh) & 31 as integer) + 1, 1), '' order by g, sh desc) as digest
        from (select page_id, g, cast('0x' || substr(x, cast(5 * g + 1 as integer), 5) as bigint) as v, unnest([15, 10, 5, 0]) as sh from (select page_id, x, unnest(range(8)) as g from d)) group by page_id)
    select d.page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when first = d.page_id then 'response' else 'revisit' end as record_type, case when first <> d.page_id then first end as refers_to
    from d join t using (h) join b using (page_id)"""

def _oracle_op11(k: int = 8, rounds: int = 10) -> str:
    """Round after round: distances to all centroids, the nearest, floors of the means."""

    def near(r: int) -> str:
        return f"""a{r} as materialized (select vec_id, e, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from (
            select vec_id, e, c, list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v cross join c{r}) group by vec_id, e)"""

    sql = f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as c, e as m from v order by sha256('3:' || vec_id) limit {k})"""
    for r in range(rounds):
        sql += f""", {near(r)}, s{r} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(e) as x, generate_subscripts(e, 1) as i from a{r}) group by c, i),
        m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{r} group by c),
        c{r + 1} as materialized (select c, coalesce(m{r}.m, c{r}.m) as m from c{r} left join m{r} using (c))"""
    return sql + f""", {near(rounds)}, t as (select c, sum(d) as own from a{rounds} group by c)
        select vec_id, a{rounds}.c as cluster, cast(d as bigint) as distance, cast(own as bigint) as cluster_inertia, cast((select sum(d) from a{rounds}) as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
        from a{rounds} join t using (c) join c{rounds} using (c)"""


#: A CRC-32 bit by bit: each byte is mixed in and followed by eight shifts (-1).
_CRC = "list_reduce(flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, 3988292384 * (a & 1)) end, cast(4294967295 as bigint))"

_ORACLE_OP12 = rf"""with recursive t as (select conv_id as c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w from conversations where conv_id is not null),
    o as (select c, list(k order by turn nulls first, k) as ks, list(w order by turn nulls first, k) as ws from t group by c),
    h as (select c, ks, ws, cast(xor({_CRC}, 4294967295) % 4 as bigint) as h from o),
    r as (select h.c, list_concat(coalesce(o.ks, [])[:h], h.ks[h+1:]) as ks, list_concat(coalesce(o.ws, [])[:h], h.ws[h+1:]) as ws from h left join o on o.c = h.c - h.c % 20),
    p as (select c, d, md5(array_to_string(ks[:d], ',')) as k, case when d > 0 then md5(array_to_string(ks[:d-1], ',')) end as pk, case when d > 0 then ws[d] else 0 end as w, len(ks) = d as ends from (select *, unnest(range(0, len(ks) + 1)) as d from r)),
    n as (select d, k, min(pk) as pk, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * max(w) as saved, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256 from p group by d, k),
    q as (select pk, count(*) as n_children from n where pk is not null group by pk),
    s as (select p.d, p.k, sum(n.saved) as saved_tokens, count(*) filter (q.pk is null) as n_leaves from n left join q on q.pk = n.k join p on p.c = n.conv_id and p.d <= n.d group by p.d, p.k)
    select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
    from n join s on s.d = n.d and s.k = n.k left join q on q.pk = n.k left join n u on u.k = n.pk and u.d = n.d - 1"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_ORACLE_OP7 = f"""with recursive d as (select doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ws from documents),
    s as (select distinct doc_id, md5(array_to_string(ws[i:i+3], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from d where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
    e as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 80 * (a.n + b.n - c)),
    r(doc_id, x) as (select u, v from e union select r.doc_id, e.v from r join e on e.u = r.x),
    m as (select doc_id, min(x) as low from r group by doc_id)
    select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id as kept from d left join n using (doc_id) left join m using (doc_id)"""

_ORACLE_OP9 = rf"""with d as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as ws from documents),
    l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
    w as (select doc_id, i, count(*) over (partition by doc_id, k) as n from (select doc_id, i, array_to_string(ws[i:i+4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) > 4))),
    r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as j from w where n > 1) group by doc_id),
    m as (select d.doc_id, source as host, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join l using (doc_id) left join r using (doc_id)),
    f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as soft_failed from m),
    h as (select host, count(*) as n_docs, count(*) filter (base_failed or soft_failed) as n_failed from f group by host),
    p as (select avg(n_failed / n_docs) as mean, var_pop(n_failed / n_docs) as var from h),
    q as (select mean, least(1000, greatest(2, case when var > 0 then mean * (1 - mean) / var - 1 else 1000 end)) as weight from p),
    k as (select host, (n_failed + mean * weight) / (n_docs + weight) as rate from h, q)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and not (soft_failed and rate * pow(greatest(10 * n_symbols / n_words, 10 * n_dup_lines / nullif(3 * n_lines, 0), 2 * n_words / word_chars, word_chars / (15 * n_words)), 2) > 1 - rate) as kept, f.host, soft_failed, round(rate, 6) as host_rate from f join k on k.host is not distinct from f.host"""

_ORACLE_OP8 = r"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    w as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from d where len(ws) >= 20),
    k as (select doc_id, s, md5(array_to_string(ws[s:s+19], ' ')) as h from w),
    g as (select doc_id, s, row_number() over (partition by h order by doc_id, s) as n from k),
    c as (select distinct doc_id, unnest(range(s, s + 20)) as i from g where n > 1),
    r as (select doc_id, list(i) as gone from c group by doc_id)
    select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
        sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
    from d left join r using (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_topk": op2_topk,
        "op3_quality_model": op3_quality_model,
        "op4_warc": op4_warc,
        "op5_license_scans": op5_license_scans,
        "op6_mixing": op6_mixing,
        "op7_minhash": op7_minhash,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_secret_scans": op10_secret_scans,
        "op11_clustering": op11_clustering,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": _ORACLE_OP2, "op4_warc": _ORACLE_OP4, "op7_minhash": _ORACLE_OP7, "op9_quality_rules": _ORACLE_OP9, "op5_license_scans": _oracle_op5(), "op8_substring_dedup": _ORACLE_OP8, "op10_secret_scans": _oracle_op10(), "op11_clustering": _oracle_op11(), "op12_prefix_trie": _ORACLE_OP12}
