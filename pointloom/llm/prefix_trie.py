"""Tries of conversation prefixes: each distinct beginning of a conversation is a node, with rollups over its subtree.

A turn shrinks to a digest and a number of words where it is read. A prefix is known by its depth and the exclusive or of
128-bit hashes of (place, turn), which running windows give without gathering a conversation; equal prefixes meet in one
combining aggregate, so copies cost a row each before the shuffle and none after. The nodes are then dealt by prefix: a
shard is a subtree that holds few distinct nodes, at whatever depth that is. Shards are laid out in numpy as level-order
tries (a LOUDS bit string and label arrays), many together, and summed up from the last node to the first. The nodes above
the shards, whose subtrees are heavy, are merged level by level by combining aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.plans.storage import materialize

#: Distinct nodes that a task lays out at once, and depths at which subtrees may become shards.
TOGETHER, CUTS = 1 << 16, (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: A subtree that begins at a depth of up to NEAR is heavy with more nodes than FEW and more distinct ends than WAYS, so that
#: wide ones are spread thin; further down, where each level above shards is one more round, with more nodes than SHARD.
NEAR, FEW, WAYS, SHARD = 4, 100, 16, 20_000
#: Bytes of listed ids in one row.
LISTED = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ("depth", "f1", "f2")


def digest(role: Column, text: Column) -> Column:
    """A turn's digest, 32 hexadecimal digits. Null counts as empty; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, label, words) in the order of turn, nulls first, equal turns by their digest."""
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.col("role"), F.col("text")).alias("label"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "label"))
    return t.select("conv_id", place.alias("place"), "label", "words")


def rebuilt(t: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns after the rebuild, conversations): the first h turns come from the first conversation of the group.

    h is the CRC-32 of the decimal id modulo heads; the conversation's own turns follow after its first h. Heads are at
    most heads - 1 turns, and a group has at most 2 * group - 1 members, so the join stays small a conversation.
    """
    first = F.col("conv_id") - F.col("conv_id") % F.lit(group)
    convs = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"base": first, "h": F.crc32(F.col("conv_id").cast("string")) % F.lit(heads)})
    lead = t.where(F.col("conv_id") == first).where(F.col("place") < heads).groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "label", "words"))).alias("lead"))  # at most heads - 1 rows each
    convs = convs.join(lead, F.col("base") == F.col("of"), "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast("array<struct<place:int,label:string,words:int>>")), F.lit(1), F.col("h").cast("int")))
    convs = materialize(convs.select("conv_id", "h", "lead", (F.size("lead") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("turns")), "trie-convs")
    head = convs.select("conv_id", "turns", F.explode("lead").alias("x")).select("conv_id", "turns", F.col("x.place").alias("depth"), "x.label", "x.words")
    by = convs.select(F.col("conv_id").alias("cid"), "h", F.size("lead").alias("n"), "turns")
    tail = t.join(by, F.col("conv_id") == F.col("cid")).where(F.col("place") > F.col("h")).select("conv_id", "turns", (F.col("place") - F.col("h") + F.col("n")).cast("int").alias("depth"), "label", "words")
    return head.unionByName(tail), convs.select("conv_id", "turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the fingerprint (f1, f2) of the prefix that it ends, the parent's, and those of its ancestors at CUTS."""
    seq = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    half = {"g1": F.xxhash64("label", "depth"), "g2": F.xxhash64("depth", F.reverse("label"))}
    out = rows.withColumns(half).withColumns({f"f{k}": F.bit_xor(f"g{k}").over(seq) for k in (1, 2)})
    out = out.withColumns({f"p{k}": F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}")) for k in (1, 2)})
    return out.withColumns({f"a{d}": F.nth_value("f1", d).over(seq) for d in CUTS}).drop("label", "g1", "g2")


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of (depth, f1, f2, conv_id): ids sorted over all tasks, listed in chunks, hashed chunk by chunk."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
            ids = b.column(3).to_pylist()
            new = np.append(True, (np.diff(key) != 0).any(axis=0))
            new[np.arange(0, len(new), LISTED // 20)] = True
            at = np.append(np.flatnonzero(new), len(ids)).tolist()
            start = np.array(at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[0][start].astype(np.int32)), pa.array(key[1][start]), pa.array(key[2][start]), pa.array([ids[a] for a in at[:-1]], pa.int64()), pa.array([",".join(map(str, ids[a:z])) for a, z in zip(at, at[1:], strict=False)])], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        schema = pa.schema([("depth", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key == last:
                    h.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, h.hexdigest()))
                last, h = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, h.hexdigest()), schema, strict=True)], schema=schema)

    order = [*KEY, "conv_id"]
    part = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth int, f1 long, f2 long, first long, ids string")
    return part.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth int, f1 long, f2 long, ends_sha256 string")


def _dealt(nodes: DataFrame) -> DataFrame:
    """nodes with cut: the depth at which a node's shard begins, null for the nodes above the shards.

    At each depth in turn, the prefixes whose subtrees are not heavy are shards; only what lies under the others is looked
    at again.
    """
    left, done = nodes, []
    for d in CUTS:
        per = left.where(F.col(f"a{d}").isNotNull()).groupBy(F.col(f"a{d}").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ended").alias("ways"))
        heavy = (F.col("n") > FEW) & (F.col("ways") > WAYS) if d <= NEAR else F.col("n") > SHARD
        heavy = materialize(per.where(heavy).select("a"), "trie-heavy")
        if heavy.isEmpty():
            done.append(left.withColumn("cut", F.when(F.col(f"a{d}").isNotNull(), F.lit(d))))
            left = None
            break
        under = left.where(F.col(f"a{d}").isNotNull())
        done.append(under.join(heavy, F.col(f"a{d}") == F.col("a"), "left_anti").withColumn("cut", F.lit(d)))
        done.append(left.where(F.col(f"a{d}").isNull()).withColumn("cut", F.lit(None).cast("int")))
        left = under.join(heavy, F.col(f"a{d}") == F.col("a"), "left_semi")
    if left is not None:
        done.append(left.withColumn("cut", F.lit(None).cast("int")))
    return reduce(DataFrame.unionByName, done)


class Louds:
    """Nodes of one or more tries in level order: a bit string with a 1 a child and a 0 after each node's children.

    up: each node's parent in this order, -1 for the tops. labels and values are arrays beside it, in the same order.
    """

    def __init__(self, depth: np.ndarray, own: np.ndarray, parent: np.ndarray):
        """own, parent: a key of each node and of its parent (structured or whole numbers); parents not here are none."""
        n = len(depth)
        sort = np.argsort(own, kind="stable")
        at = np.minimum(np.searchsorted(own[sort], parent), n - 1)
        up = np.where(own[sort][at] == parent, sort[at], -1)
        order, begin, high = np.zeros(n, np.int64), np.zeros(n, np.int64), int(depth.max(initial=0))
        by = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by], np.arange(int(depth.min(initial=0)), high + 2))
        place, done = np.zeros(n, np.int64), 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # level by level, siblings side by side in their parents' order
            level = by[a:b]
            level = level[np.argsort(np.where(up[level] >= 0, place[up[level]], -1), kind="stable")]
            order[done : done + len(level)], place[level] = level, np.arange(done, done + len(level))
            done += len(level)
        self.order, self.depth = order, depth[order]
        self.up = np.where(up[order] >= 0, place[up[order]], -1)
        self.children = np.bincount(self.up[self.up >= 0], minlength=n)
        self.bits = np.ones(n + int(self.children.sum()), bool)
        self.bits[np.cumsum(self.children + 1) - 1] = False
        begin[:] = np.cumsum(self.children + 1) - self.children - 1
        self.begin = begin

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtrees, from the last level to the first."""
        total = values.copy()
        edges = np.append(np.flatnonzero(np.diff(self.depth, prepend=self.depth[:1] - 1)), len(self.depth))
        for a, b in zip(edges[-2::-1].tolist(), edges[:0:-1].tolist(), strict=True):
            up = self.up[a:b]
            np.add.at(total, up[up >= 0], total[a:b][up >= 0])
        return total


NODE = "depth int, f1 long, f2 long, p1 long, p2 long, conv_id long, n_convs long, saved long"
SUMMED = "depth int, f1 long, f2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _shards(nodes: DataFrame) -> DataFrame:
    """SUMMED of the nodes in shards; top: whether a node begins its shard, whose parent then lies above."""

    def lay(b: pa.Table) -> pa.RecordBatch:
        depth, f1, f2, p1, p2, conv, n, saved = (b.column(k).to_numpy() for k in range(8))
        key = lambda d, x, y: np.rec.fromarrays([d.astype(np.int64), x, y])
        names = np.unique(np.concatenate([key(depth, f1, f2), key(depth - 1, p1, p2)]), return_inverse=True)[1]
        trie = Louds(depth, names[: len(depth)], names[len(depth) :])
        o, up = trie.order, trie.up
        leaves, total = trie.rollup((trie.children == 0).astype(np.int64)), trie.rollup(saved[o])
        above = pa.array(np.where(up >= 0, conv[o][up], 0), mask=up < 0)
        cols = [pa.array(x) for x in (depth[o], f1[o], f2[o], p1[o], p2[o], conv[o])]
        return pa.RecordBatch.from_arrays([*cols, above, *(pa.array(x) for x in (n[o], trie.children.astype(np.int64), leaves, total, up < 0))], names=[x.split()[0] for x in SUMMED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < TOGETHER:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut, top = t["cut"].to_numpy(), t["shard"].to_numpy()
            new = np.flatnonzero((np.diff(cut) != 0) | (np.diff(top) != 0))
            if len(new):  # all but the last shard, which may go on
                end = int(new[-1]) + 1
                yield lay(t.slice(0, end))
                rest = t.slice(end)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield lay(pa.Table.from_batches(held))

    shard = F.coalesce(*[F.when(F.col("cut") == d, F.col(f"a{d}")) for d in CUTS])
    rows = nodes.where("cut is not null").select(*[x.split()[0] for x in NODE.split(", ")], "cut", shard.alias("shard"))
    return rows.repartition("cut", "shard").sortWithinPartitions("cut", "shard").mapInArrow(run, SUMMED)


def _to_parents(rows: DataFrame) -> DataFrame:
    """What the parents of rows get of them: combined before the shuffle."""
    return rows.groupBy((F.col("depth") - 1).alias("udepth"), F.col("p1").alias("u1"), F.col("p2").alias("u2")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))


def _upper(nodes: DataFrame, tops: DataFrame) -> list[DataFrame]:
    """SUMMED of the nodes above the shards, the deepest level first; tops: the shards' first nodes."""
    levels = sorted((r["depth"] for r in nodes.select("depth").distinct().collect()), reverse=True)  # a number a level
    out, below = [], tops
    for d in levels:
        got = _to_parents(below.where(F.col("depth") == d + 1))
        here = nodes.where(F.col("depth") == d).join(got, (F.col("depth") == F.col("udepth")) & (F.col("f1") == F.col("u1")) & (F.col("f2") == F.col("u2")), "left")
        here = here.select("depth", "f1", "f2", "p1", "p2", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("saved") + F.coalesce("tokens", F.lit(0))).cast("long").alias("saved_tokens"), F.lit(True).alias("top"))
        out.append(materialize(here, "trie-upper"))
        below = tops.where(F.col("depth") <= d).unionByName(out[-1])
    return out


def trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a distinct prefix.

    conversations: (conv_id, turn, role, text), ordered by turn, nulls first, equal turns by a digest of role and text; a
    null role or text is empty; rows with a null conv_id belong to no conversation. Every conversation is rebuilt first
    (see rebuilt), also to no turns. A node is known by its smallest member and depth; the root (depth 0) has no parent.
    n_leaves counts the subtree's nodes without children, itself included; saved_tokens sums (members - 1) times the words
    of the last turn over the subtree; ends_sha256 is the SHA-256 of the ascending ids of the members that end here,
    joined by commas. Repeated rows are turns of their own. An empty table gives no rows. Other columns are not looked at.
    """
    all_rows, convs = rebuilt(materialize(turns(conversations), "trie-turns"), group, heads)
    rows = materialize(prefixes(all_rows), "trie-prefixes")
    ancestors = [F.first(f"a{d}").alias(f"a{d}") for d in CUTS]
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").cast("long").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max(F.col("depth") == F.col("turns")).alias("ended"), *ancestors)
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "trie-nodes")
    dealt = _dealt(nodes)
    below = materialize(_shards(dealt), "trie-shards")
    tops = below.where("top")
    above = materialize(dealt.where("cut is null").select(*[x.split()[0] for x in NODE.split(", ")]), "trie-above")
    upper = _upper(above, tops)
    ends = rows.where(F.col("depth") == F.col("turns")).select(*KEY, "conv_id")
    ends = ends.unionByName(convs.where("turns = 0").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), "conv_id"))
    ends = materialize(_listed(materialize(ends, "trie-ends")), "trie-listed")

    high = reduce(DataFrame.unionByName, upper) if upper else None
    firsts = tops if high is None else tops.unionByName(high)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    first = firsts.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
    low = convs.agg(F.min("conv_id").alias("low"))
    root = root.withColumns({c: first.select(c).scalar() for c in ("n_children", "leaves", "tokens")})
    root = root.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("tokens", F.lit(0)).cast("long").alias("saved_tokens"))
    inner = below.where("not top")
    if high is None:
        linked = firsts.withColumn("parent_conv_id", low.select("low").scalar())
    else:
        over = high.select((F.col("depth") + 1).alias("d"), F.col("f1").alias("o1"), F.col("f2").alias("o2"), F.col("conv_id").alias("above"))
        linked = firsts.where("depth > 1").join(over, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("o1")) & (F.col("p2") == F.col("o2"))).withColumn("parent_conv_id", F.col("above"))
        linked = linked.select(firsts.columns).unionByName(firsts.where("depth = 1").withColumn("parent_conv_id", low.select("low").scalar()))
    all_ = inner.unionByName(linked).drop("p1", "p2", "top").unionByName(root)
    e = ends.select(F.col("depth").alias("ed"), F.col("f1").alias("e1"), F.col("f2").alias("e2"), "ends_sha256")
    out = all_.join(e, (F.col("depth") == F.col("ed")) & (F.col("f1") == F.col("e1")) & (F.col("f2") == F.col("e2")), "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
