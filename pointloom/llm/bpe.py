"""Byte-level BPE: pre-tokenisation by automaton scans over arrays, cached pair merging, decoding by ids or by places.

The split pattern is the one that public byte-level vocabularies share: contractions, letters, numbers and other signs with
one space before them, white space without its last character before text. It needs no regular expression: each code point
becomes one of a few symbols (its class, and for apostrophes and white space what follows), and each symbol is a function
from state to state of a small automaton. Function composition is associative, so all states are found by a blocked prefix
scan over tables instead of a walk; a slice starts wherever a state and symbol say so.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import _text

#: Bytes of text handled at once; a longer document goes in pieces of this size, the automaton's state carried over.
CHUNK = 1 << 18
#: Bytes that each of the cache's two generations may take, what an entry takes besides its slice, the longest slice it holds.
CACHE, ENTRY, CACHED = 16 << 20, 150, 48
#: Slices merged together at most; bytes from which on a slice is merged alone.
ROWS, LONG = 1 << 12, 64
NO_RANK = (1 << 31) - 1

LETTER, NUMBER, OTHER, APO2, APO3, GAP, SPACE_END, GAP_END, BREAK = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_SPACE, LAST_OF_SHORT, TWO_OF_SHORT = range(8)
#: White space by Unicode's White_Space property.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def code_classes() -> np.ndarray:
    """The class of each code point: LETTER, NUMBER, OTHER or GAP.

    Which code points are letters or numbers depends on the Unicode version, and that of the public tokenizer library is
    newer than Python's. Where the library is installed, its own classes are read off once, on the driver: a vocabulary of
    the 256 bytes encodes just what a one-class pattern matches. Without it Python's older tables serve, with a warning, since
    texts with newer letters may then have other ids.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    try:
        import tiktoken
    except ImportError:
        warnings.warn("tiktoken is not installed: letters and numbers are those of Python's Unicode tables", stacklevel=2)
        by = {"L": LETTER, "N": NUMBER}
        out[:] = [by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    else:
        everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for name, kind in (("L", LETTER), ("N", NUMBER)):
            probe = tiktoken.Encoding(f"class-{name}", pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found = bytes(probe.encode_ordinary(everything)).decode()
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[list(WHITE)] = GAP
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and starts[state, symbol]: whether the symbol begins a slice."""
    nxt, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    plain = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, GAP: IN_GAP, SPACE_END: AFTER_SPACE, GAP_END: IN_GAP, APO2: LAST_OF_SHORT, APO3: TWO_OF_SHORT, BREAK: FRESH}
    for s in range(8):
        for symbol, to in plain.items():
            nxt[s, symbol] = to
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (APO2, IN_OTHERS), (APO3, IN_OTHERS)):
        for s in (run, AFTER_SPACE):
            nxt[s, symbol], starts[s, symbol] = run, False
    starts[IN_GAP, GAP] = False
    nxt[LAST_OF_SHORT, LETTER], starts[LAST_OF_SHORT, LETTER] = FRESH, False
    nxt[TWO_OF_SHORT, LETTER], starts[TWO_OF_SHORT, LETTER] = LAST_OF_SHORT, False
    return nxt, starts


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that runs of symbols make: maps[f, state], compose[f, g] (f first), and the function of each symbol."""
    maps = [tuple(range(8))]
    index = {maps[0]: 0}
    gens = [tuple(int(x) for x in nxt[:, k]) for k in range(nxt.shape[1])]
    for f in maps:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(maps)
                maps.append(h)
    compose = np.array([[index[tuple(g[x] for x in f)] for g in maps] for f in maps], np.uint16)
    return np.array(maps, np.uint8), compose, np.array([index[g] for g in gens], np.uint16)


class Splitter:
    """Finds where the slices of texts begin."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        self.next, self.starts = _automaton()
        self.maps, self.compose, self.of_symbol = _monoid(self.next)

    def symbols(self, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """breaks: places of the separators between documents, which end each document."""
        sym = self.classes[np.minimum(codes, 0x10FFFF)].copy()
        sym[breaks] = BREAK
        after = np.append(sym[1:], np.uint8(BREAK))
        last = (sym == GAP) & (after != GAP) & (after != BREAK)
        sym[last] = np.where(codes[last] == 32, SPACE_END, GAP_END)
        apo = np.flatnonzero(codes == 39)
        if len(apo):
            c1, c2 = (codes[np.minimum(apo + k, len(codes) - 1)] * (apo + k < len(codes)) for k in (1, 2))
            sym[apo[np.isin(c1, [ord(x) for x in "stmd"])]] = APO2
            for a, b in ("re", "ve", "ll"):
                sym[apo[(c1 == ord(a)) & (c2 == ord(b))]] = APO3
            sym[breaks] = BREAK
        return sym

    def states(self, sym: np.ndarray, state: int = FRESH, width: int = 256) -> np.ndarray:
        """The state before each symbol, by a blocked scan: compose within all blocks at once, then over block totals.

        state: that before the first symbol.
        """
        n = len(sym)
        f = np.zeros((-(-n // width)) * width, np.uint16)
        f[:n] = self.of_symbol[sym]
        f = np.ascontiguousarray(f.reshape(-1, width).T)
        for k in range(1, width):
            f[k] = self.compose[f[k - 1], f[k]]
        total = f[-1].copy()
        step = 1
        while step < len(total):
            total[step:] = self.compose[total[:-step], total[step:]]
            step *= 2
        before = np.concatenate((np.zeros(1, np.uint16), total[:-1]))
        entry = self.maps[before, state]
        out = np.empty(f.shape, np.uint8)
        out[0] = entry
        out[1:] = self.maps[f[:-1], entry[None, :]]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def split(self, codes: np.ndarray, breaks: np.ndarray, upto: int | None = None, state: int = FRESH) -> tuple[np.ndarray, np.ndarray]:
        """(where slices begin, the state before each of them) among the first upto codes; the rest is only looked at.

        Two codes more than upto are enough to look at.
        """
        sym = self.symbols(codes, breaks)[:upto]
        before = self.states(sym, state)
        at = np.flatnonzero(self.starts[before, sym])
        return at, before[at]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, the byte at which each begins) of UTF-8. Bytes that are none go with the code point before them."""
    lead = (buf & 0xC0) != 0x80
    lead[:1] = True
    at = np.flatnonzero(lead)
    codes = buf[at].astype(np.uint32)
    if len(at) == len(buf):
        return codes, at
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        where = np.flatnonzero((codes >= low) & (codes < high) & (buf[at] >= low))
        c = codes[where] & keep
        for k in range(1, more + 1):
            c = c << 6 | (buf[np.minimum(at[where] + k, len(buf) - 1)] & 0x3F)
        codes[where] = c
    return codes, at


class Merger:
    """Pair merging by rank, the lowest first and the leftmost of equals, with a cache of slices.

    Slices that the cache does not know are merged together: a row of a matrix each, one merge a row and step, by array
    operations over all rows that still have a pair to merge. Long slices use a heap of pairs each.
    The cache has two generations of bounded size, so slices that keep coming stay and others go: place and number of a
    slice's ids among the generation's ids, in one number. A generation that is full becomes the former one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[bytes, int] = {}
        self.former: dict[bytes, int] = {}
        self.store, self.former_store = np.zeros(1 << 16, np.int32), np.zeros(0, np.int32)
        self.stored = self.taken = 0
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        keys, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (x := ranks.get(token[:cut])) is not None and (y := ranks.get(token[cut:])) is not None:
                    keys.append(x << 32 | y)
                    to.append(rank)
        self._index(np.array(keys, np.int64), np.array(to, np.int64))
        self.first = self._pair(self.byte.repeat(256), np.tile(self.byte, 256)).reshape(256, 256)

    def _index(self, keys: np.ndarray, to: np.ndarray) -> None:
        """A hash table of pairs in arrays: all keys try their places at once, those that found one taken try the next."""
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NO_RANK, np.int64)
        at, self.probes = self._place(keys), 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.to[at[won]] = to[won]
            keys, to, at = keys[~won], to[~won], (at[~won] + 1) & self.mask
            self.probes += bool(len(keys))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(40)).astype(np.int64) & self.mask

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbouring ids, NO_RANK where they do not merge or one is missing (-1)."""
        key = np.where((x >= 0) & (y >= 0), x << 32 | y, -2)
        at, out, look = self._place(key), np.full(len(key), NO_RANK, np.int64), np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[look]
            out[look[hit]] = self.to[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            look, at = look[more], (at[more] + 1) & self.mask
        return out

    def _rows(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges of slices of at most width bytes: ids in a row, and how many each slice has."""
        n = len(raws)
        size = np.fromiter(map(len, raws), np.int64, n)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        there = np.arange(width) < size[:, None]
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][there] = self.byte[raw]
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int8), (n, 1))
        rank = np.full((n, width), NO_RANK, np.int32)
        rank[there] = self.first[raw, np.append(raw[1:], np.uint8(0))]
        rank[np.arange(n), size - 1] = NO_RANK
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            live = best < NO_RANK
            rows, at, best = rows[live], at[live], best[live].astype(np.int64)
            if not len(rows):
                break
            gone = after[rows, at].astype(np.int64)
            nxt = after[rows, gone].astype(np.int64)
            ids[rows, at], ids[rows, gone] = best, -1
            after[rows, at] = nxt
            inside = nxt <= width
            before[rows[inside], nxt[inside]] = at[inside]
            on_right = gone < width
            rank[rows[on_right], gone[on_right]] = NO_RANK
            rank[rows, at] = np.where(inside, self._pair(best, ids[rows, np.minimum(nxt, width)].astype(np.int64)), NO_RANK)
            left = before[rows, at].astype(np.int64)
            some = left >= 0
            rank[rows[some], left[some]] = self._pair(ids[rows[some], left[some]].astype(np.int64), best[some])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _merged(self, raws: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(slices in the order in which they were merged, their ids in a row, how many each has)."""
        whole = list(map(self.ranks.get, raws))
        order = [k for k, x in enumerate(whole) if x is not None]
        ids, sizes = [np.array([whole[k] for k in order], np.int32)], [np.ones(len(order), np.int64)]
        by: dict[int, list[int]] = {}
        for k in (k for k, x in enumerate(whole) if x is None):
            n = len(raws[k])
            if n > LONG or not n:
                order.append(k)
                ids.append(np.array(self.merge_long(raws[k]), np.int32))
                sizes.append(np.array([len(ids[-1])]))
            else:
                by.setdefault(max(4, 1 << (n - 1).bit_length()), []).append(k)
        for width, at in by.items():
            for a in range(0, len(at), ROWS):
                order += at[a : a + ROWS]
                for to, x in zip((ids, sizes), self._rows([raws[k] for k in at[a : a + ROWS]], width), strict=True):
                    to.append(x)
        return order, np.concatenate(ids), np.concatenate(sizes)

    def merge_all(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each slice."""
        order, ids, sizes = self._merged(raws)
        out: list = [()] * len(raws)
        for k, x in zip(order, np.split(ids, np.cumsum(sizes)[:-1]), strict=True) if order else ():
            out[k] = tuple(x.tolist())
        return out

    def merge_long(self, raw: bytes) -> tuple[int, ...]:
        """One long slice, by a heap of pairs; an entry counts while both of its parts still stand."""
        n = len(raw)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != upto:
                continue
            alive[j] = 0
            end[i] = upto
            if upto < n:
                prev[upto] = i
                if (r := get(raw[i : end[upto]])) is not None:
                    heapq.heappush(heap, (r, i, end[upto]))
            if (p := prev[i]) >= 0 and (r := get(raw[p:upto])) is not None:
                heapq.heappush(heap, (r, p, upto))
        return tuple(self.ranks[raw[i : end[i]]] for i in range(n) if alive[i])

    def _put(self, ids: np.ndarray, sizes: np.ndarray, at: int) -> list[int]:
        """Slices' ids put into the store from a place on; place and number of each slice's ids in one number."""
        if at + len(ids) > len(self.store):
            self.store = np.concatenate((self.store[:at], np.zeros(max(len(self.store), len(ids)), np.int32)))
        self.store[at : at + len(ids)] = ids
        return ((at + np.cumsum(sizes) - sizes) << 32 | sizes).tolist()

    def _new(self, miss: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """What the cache lacks, from the former generation or merged; all but long slices go into the cache."""
        former = list(map(self.former.get, miss))
        old = [k for k, x in enumerate(former) if x is not None]
        v = np.array([former[k] for k in old], np.int64)
        fresh = [p for p, x in zip(miss, former, strict=True) if x is None]
        order, ids, sizes = self._merged(fresh)
        long_ = np.array([len(fresh[k]) > CACHED for k in order], bool)
        of = np.repeat(long_, sizes)
        for names, flat, n, keep in (
            ([miss[k] for k in old], _taken(self.former_store, v >> 32, v & 0xFFFFFFFF), v & 0xFFFFFFFF, True),
            ([fresh[k] for k, x in zip(order, long_, strict=True) if not x], ids[~of], sizes[~long_], True),
            ([fresh[k] for k, x in zip(order, long_, strict=True) if x], ids[of], sizes[long_], False),
        ):
            put = list(zip(names, self._put(flat, n, self.stored), strict=True))
            yield from put
            if keep:
                self.cache.update(put)
                self.stored += len(flat)
                self.taken += ENTRY * len(names) + sum(map(len, names)) + 4 * len(flat)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in a row, and how many each has."""
        if self.taken > CACHE:
            self.former, self.former_store = self.cache, self.store[: self.stored].copy()
            self.cache, self.store, self.stored, self.taken = {}, np.zeros(1 << 16, np.int32), 0, 0
        got = list(map(self.cache.get, pieces))
        lost = [i for i, x in enumerate(got) if x is None]
        if lost:
            new = dict(self._new(list({pieces[i]: None for i in lost})))
            for i in lost:
                got[i] = new[pieces[i]]
        v = np.array(got, np.int64)
        out = _taken(self.store, v >> 32, v & 0xFFFFFFFF)
        if len(self.store) > 4 * max(self.stored, 1 << 16):  # a long slice was here
            self.store = self.store[: max(self.stored, 1 << 16)].copy()
        return out, v & 0xFFFFFFFF


def _taken(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at some places, one after the other."""
    return values[np.arange(int(sizes.sum())) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)]


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Splitter and merger of one vocabulary, made once a worker."""

    made: dict[str, Codec] = {}

    def __init__(self, data: bytes, classes: np.ndarray):
        self.splitter, ranks = Splitter(classes), load_ranks(data)
        self.merger = Merger(ranks)
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for k, v in ranks.items():
            self.lengths[v] = len(k)
        self.place = np.concatenate(([0], np.cumsum(self.lengths)))
        by = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.bytes = np.frombuffer(b"".join(by.get(i, b"") for i in range(len(self.lengths))), np.uint8)

    @classmethod
    def of(cls, key: str, data: bytes, classes: np.ndarray) -> Codec:
        """The codec of a vocabulary, by the digest of its file; a worker keeps the last one."""
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = cls(data, classes)
        return cls.made[key]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each text has."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))))

    def encode_bytes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the UTF-8 bytes of all texts in a row and where each begins."""
        if len(off) == 2 and len(buf) > CHUNK:
            ids = np.concatenate(list(self._pieces(buf)))
            return ids, np.array([len(ids)])
        buf = np.insert(buf, off[1:], 0)
        codes, place = code_points(buf)
        seps = np.searchsorted(place, off[1:] + np.arange(len(off) - 1))
        at, _ = self.splitter.split(codes, seps)
        sep = np.searchsorted(at, seps)  # each separator is a slice of its own
        cuts = [*place[at].tolist(), len(buf)]
        blob = buf.tobytes()
        pieces = [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in sep.tolist():
            pieces[k] = b""
        ids, sizes = self.merger.ids(pieces)
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)[sep]))).astype(np.int64)

    def _pieces(self, buf: np.ndarray) -> Iterator[np.ndarray]:
        """ids of one long text, piece by piece. A piece ends where its last slice begins, which the next one takes up."""
        none, at, state, step = np.zeros(0, np.int64), 0, FRESH, CHUNK
        while at < len(buf):
            codes, place = code_points(buf[at : at + step + 16])
            last = at + step + 16 >= len(buf)
            n = len(codes) if last else int(np.searchsorted(place, step))
            starts, states = self.splitter.split(codes, none, n, state)
            cuts = place[starts].tolist()
            if last:
                cuts.append(len(buf) - at)
            elif len(cuts) < 2:  # one slice fills the piece
                step *= 2
                continue
            blob = buf[at : at + cuts[-1]].tobytes()
            yield self.merger.ids([blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])[0]
            at, state, step = at + cuts[-1], int(states[-1]), CHUNK

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte of its document at which each id's bytes end."""
        upto = np.cumsum(self.lengths[ids])
        base = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)[:-1]))] if len(counts) else upto
        return (upto - np.repeat(base, counts)).astype(np.int32 if not len(upto) or upto[-1] < 2**31 else np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        size = self.lengths[ids]
        upto = np.cumsum(size)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.place[ids] - upto + size, size)
        return self.bytes[at], upto


def _shared(spark: SparkSession, path: str):
    """The vocabulary file, which has a fixed size, its digest, and the class table (1.1 MB), sent to the executors once."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data, code_classes()))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(values))


def _again(texts: pa.Array) -> np.ndarray:
    """Whether each text equals the one before it."""
    out = np.zeros(len(texts), bool)
    if len(texts) > 1:
        out[1:] = pc.equal(pc.cast(texts.slice(1), pa.binary()), pc.cast(texts.slice(0, len(texts) - 1), pa.binary())).to_numpy(zero_copy_only=False)
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """Per row of docs: doc_id, ids (array of int) and, if asked for, ends (array of long: the byte at which each id's text ends).

    Whole texts, no special tokens. A null text is empty and has no ids; a null id stays null. Repeated rows give equal
    rows, an empty table none; of rows with the same text that follow each other only the first is encoded. A row needs no
    other row, so there is no shuffle and a lost task is simply run again. Besides its batch a worker holds CHUNK bytes of
    text and a bounded cache; only the ids of one text, and one slice, can be longer. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("ends", T.ArrayType(T.LongType(), False))] * ends])
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*shared.value)
        for batch in batches:
            again = _again(batch.column(1))
            first = np.flatnonzero(~again)
            texts = batch.column(1) if len(first) == len(again) else batch.column(1).take(pa.array(first))
            upto = np.append(first, len(again))
            for buf, off, a, n in _text.chunks(texts, texts, CHUNK):
                ids, counts = codec.encode_bytes(buf, off)
                own = [ids, codec.ends(ids, counts).astype(np.int64)] if ends else [ids]
                times = np.diff(upto[a : a + n + 1])
                if (times > 1).any():
                    begin, counts = np.repeat(np.cumsum(counts) - counts, times), np.repeat(counts, times)
                    own = [_taken(x, begin, counts) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(upto[a]), int(times.sum())), *(_lists(x, counts) for x in own)], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", ends_col: str | None = None) -> DataFrame:
    """Per row: doc_id, ids, decoded (binary). Null ids decode to no bytes; an id outside the vocabulary raises.

    ends_col: the retained ends. The bytes are then cut into documents by them, and ends that do not fit the ids raise.
    """
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")
    end = F.lit(None).cast("long") if ends_col is None else F.when(F.size(ids) == 0, F.lit(0).cast("long")).otherwise(F.element_at(F.col(ends_col), -1))
    rows = encoded.select(F.col(id_col).alias("doc_id"), ids, end.alias("end"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    shared = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*shared.value)
        for batch in batches:
            lists = batch.column(1)
            a = 0
            sizes = np.diff(lists.offsets.to_numpy())
            upto = np.cumsum(sizes, dtype=np.int64)
            while a < len(lists):
                b = max(a + 1, int(np.searchsorted(upto, CHUNK // 4 + (upto[a - 1] if a else 0), side="right")))
                out, places = codec.decode(lists.slice(a, b - a).flatten().to_numpy())
                cuts = np.concatenate(([0], places))[np.concatenate(([0], np.cumsum(sizes[a:b])))]
                if ends_col is not None:
                    retained = np.concatenate(([0], np.cumsum(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False))))
                    if not (retained == cuts).all():
                        raise ValueError("the retained ends do not fit the ids")
                    cuts = retained
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.slice(a, b - a), blob], names=["doc_id", "ids", "decoded"])
                a = b

    return rows.mapInArrow(run, schema)


def decode_span(encoded: DataFrame, path: str, start: int, end: int, id_col: str = "doc_id", ids_col: str = "ids", ends_col: str = "ends") -> DataFrame:
    """Per row: doc_id, decoded (binary): the bytes of the text from start to end, without the byte at end.

    Only the ids whose bytes lie there by the retained ends are decoded. Past a text's end there are no bytes.
    """
    if not 0 <= start <= end:
        raise ValueError("a span starts at 0 or later and ends at its start or later")
    ids, ends = F.col(ids_col), F.col(ends_col)
    first = F.size(F.filter(ends, lambda e: e <= start))
    last = F.size(F.filter(ends, lambda e: e < end))  # this id, counted from 0, holds the last byte
    at = F.struct(F.col(id_col).alias("id"), F.when(first > 0, F.element_at(ends, F.greatest(first, F.lit(1)))).otherwise(F.lit(0)).cast("long").alias("base"))
    own = encoded.select(at.alias("doc_id"), F.slice(ids, first + 1, F.greatest(last - first + 1, F.lit(0))).alias("ids"))
    return decode(own, path).select(F.col("doc_id.id").alias("doc_id"), F.substring("decoded", (start + 1 - F.col("doc_id.base")).cast("int"), F.lit(end - start)).alias("decoded"))


def ids_text(ids: str | Column = "ids") -> Column:
    """Decimal ids joined by one space."""
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), " ")
