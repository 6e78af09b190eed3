"""Packing token ids of documents into sequences of bounded length, with nothing left to pad.

Documents are encoded where they are read. Whole sequences of a document are cut off at once; only its rest, shorter than a
sequence, goes to one of many randomised groups of rests. A group is packed by itself: first-fit decreasing, the first
sequence with room found in a tournament tree of the sequences' room. Sequences that are then the least full are taken
apart to fill the gaps of the others, cut where needed; what stays in the last one is cut into lengths that are powers of
two, which need no padding either.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

#: Fixed value: the pattern by which byte-level tokenizers split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text may be cut, white space that is too much for that pattern, and characters that are encoded at once.
CUT, RUN, PIECE = re.compile(r"\s(?=\S)"), re.compile(r"\s{1000}"), 1 << 16
#: Bytes of ids in a batch, and rests in a group, on average.
BATCH, GROUP = 1 << 22, 4096
#: Sequence numbers: those of a task's whole sequences, and of a group, are this far apart.
APART = 1 << 32


def pieces(text: str, most: int = PIECE) -> list[str]:
    """text in stretches of about most characters that encode, one after the other, like the whole.

    The tokenizer's own split has a boundary before every white space character that something else follows, since a run of
    white space leaves its last character to what comes next. Without one the stretch goes on.
    """
    out, a = [], 0
    while len(text) - a > most and (m := CUT.search(text, a + most)):
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


def _bytes_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as characters: printable ones as themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The ranks of a tokenizer file whose merges come in the order of their ids, so that merging by rank gives its ids.

    None for any other kind of tokenizer.
    """
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    own, special = _bytes_of(), {t["content"] for t in spec["added_tokens"] if t["special"]}
    ranks = {bytes(own[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return ranks if merged == sorted(merged) and len(merged) + 256 == len(ranks) else None


class Encoder:
    """Token ids of texts by a tokenizer file; special tokens' strings in a text are ordinary text, none are added.

    Where merging by rank gives the same ids, a library does it that takes a fraction of the time; its pattern fails on
    very long runs of white space, which go to the tokenizer itself, as does all text of other kinds of tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = None
        with open(path, encoding="utf-8") as f:
            ranks = ranks_of(json.load(f))
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        out = []
        for x in pieces(text):
            quick = self.fast is not None and not RUN.search(x)
            out.append(np.array(self.fast.encode_ordinary(x) if quick else self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item, all at most room: largest first, each into the first bin that has room for it.

    The bins' room stands at the leaves of a tournament tree, of which every inner node holds the larger of its two; the
    first bin with enough is found by going down to the left wherever the left one wins enough.
    """
    n = len(sizes)
    leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
    tree = [room] * (2 * leaves)
    out = np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[i] = at - leaves
        left = tree[at] - size
        tree[at] = left
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] > tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
    return out


def fill(sizes: np.ndarray, bins: np.ndarray, room: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of all pieces after the gaps are filled; lengths that stay are powers of two.

    Bins give up their items from the least full one on, each to the fullest that still has a gap, cut where a gap ends.
    """
    n = int(bins.max(initial=-1)) + 1
    load = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    order = np.argsort(-load, kind="stable")
    held = [[] for _ in range(n)]
    for i in np.argsort(bins, kind="stable").tolist():
        if sizes[i]:
            held[bins[i]].append((i, 0, int(sizes[i])))
    full, gap = [held[b] for b in order.tolist()], [room - int(x) for x in load[order]]
    a, z = 0, n - 1
    while a < z:
        if not gap[a]:
            a += 1
        elif not full[z]:
            z -= 1
        else:
            item, start, length = full[z].pop()
            take = min(length, gap[a])
            full[a].append((item, start + length - take, take))
            gap[a] -= take
            gap[z] += take
            if take < length:
                full[z].append((item, start, length - take))
    out, number = [], 0
    for b in range(z + 1):
        used, ends = 0, [room]
        if gap[b]:  # the last one: its length as a sum of powers of two
            have = room - gap[b]
            ends = [have & ~((1 << k) - 1) for k in range(have.bit_length() - 1, -1, -1) if have >> k & 1]
        base = 0
        for item, start, length in full[b]:
            while length:
                if used == ends[0]:
                    base, ends, number = used, ends[1:], number + 1
                take = min(length, ends[0] - used)
                out.append((item, start, take, number, used - base))
                used, start, length = used + take, start + take, length - take
        number += bool(full[b])
    return out


PIECES = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset: a row a piece.

    A document's ids are those of its text by the tokenizer file, and then end; a null or empty text is the end alone. Each
    id lies in exactly one piece; a sequence's pieces follow one another without a gap from offset 0. Sequences hold room
    ids (a power of two), but for a few of each group with shorter lengths that are powers of two. Nulls: a null id is
    kept. Rows that share an id, or all of their content, are documents of their own. An empty table gives no rows. Other
    columns are not looked at. group: rests that are packed together, on average. Which documents share a sequence depends
    on how the table is read.
    """
    if room < 1 or room & (room - 1):
        raise ValueError("room must be a power of two")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, count, names = Encoder(tokenizer), 0, ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "draw"]
        number = TaskContext.get().partitionId() * APART
        deal = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            own, texts = batch.column(0), batch.column(1).fill_null("").to_pylist()
            held, size = [], 0
            for i, text in enumerate(texts):
                ids = np.append(encoder(text), np.uint32(end)).astype("<u4")
                draw = int(deal.integers(1 << 62))
                for at in range(0, len(ids), room):
                    part = ids[at : at + room]
                    whole = len(part) == room
                    held.append((i, at, len(part), part.tobytes(), len(ids), number + count if whole else None, draw))
                    count += whole
                size += ids.nbytes
                if size >= BATCH or i + 1 == len(texts):
                    at, *cols = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(at)), *(pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names[1:], cols, strict=True))], names=names)
                    held, size = [], 0

    def rests(part: pa.Table) -> pa.Table:
        first = (1 << 62) + part["group"][0].as_py() * APART
        sizes = part["length"].to_numpy()
        got = fill(sizes, first_fit_decreasing(sizes, room), room)
        item, start, length, number, offset = (np.array(x, np.int64) for x in zip(*got, strict=True))
        data = part["ids"].combine_chunks().to_pylist()
        ids = [data[i][4 * s : 4 * (s + n)] for i, s, n in zip(item.tolist(), start.tolist(), length.tolist(), strict=True)]
        at = pa.array(item)
        return pa.table([part["doc"].take(at), pa.array(part["start"].to_numpy()[item] + start), pa.array(length), pa.array(ids, pa.binary()), part["doc_tokens"].take(at), pa.array(first + number), pa.array(offset)], schema=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    cut = materialize(rows.mapInArrow(encode, "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, draw long"), "packing-cut")
    left = cut.where("sequence_id is null")
    groups = max(1, -(-left.count() // group))
    left = left.withColumn("group", F.pmod("draw", F.lit(groups)))
    packed = left.select("doc", "start", "length", "ids", "doc_tokens", "group").groupBy("group").applyInArrow(rests, "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    out = cut.where("sequence_id is not null").select("doc", "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")).unionByName(packed)
    return out.withColumnRenamed("doc", "doc_id")


def ids_crc32(ids: str | Column) -> Column:
    """Unsigned CRC-32 of a piece's ids as little-endian unsigned 32-bit numbers."""
    return F.crc32(ids)
