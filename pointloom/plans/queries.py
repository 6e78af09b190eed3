"""One query an operator over the driver's tables, each with SQL for an independent engine where SQL can say the same.

Clouds are the first three coordinates of embeddings; meshes are a lattice over part, 20 points wide. Doubles are rounded
to six places at the very end; adding zero turns -0.0 into 0.0.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import cloud, egg, graph, knn, mesh, normals, order, smoothing
from pointloom.operators.components import components
from pointloom.plans import pipeline
from pointloom.plans.storage import materialize, scratch_path
from pointloom.sources import ply, xyz

WIDTH = 20
ALPHA = 0.65
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k % WIDTH).cast("double").alias("x"), F.floor(k / WIDTH).cast("double").alias("y"), (F.col("p_size") / 50.0).alias("z"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    top = p.select((F.col("a") - WIDTH).alias("below")).hint("merge")  # as many rows as p, in a small file
    cells = p.where(F.col("a") % WIDTH < WIDTH - 1).join(top, F.col("a") == F.col("below"), "left_semi")
    a = F.col("a")
    return cells.select(a.alias("face_id"), F.array(a, a + 1, a + WIDTH + 1, a + WIDTH).alias("vertex_indices"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("vertex_indices")
    tri = lambda t, a, b, c: F.struct((2 * F.col("face_id") + t).alias("face_id"), q[a].alias("v0"), q[b].alias("v1"), q[c].alias("v2"))
    return quads(spark, sf_dir).select(F.inline(F.array(tri(0, 0, 1, 3), tri(1, 1, 2, 3))))


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(cloud.normalise(points(spark, sf_dir)), "unit")


def near(u: DataFrame, k: int) -> DataFrame:
    return materialize(knn.knn_join(u, u, k, exclude_self=True, strict=False), "near")


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or c)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[r6(c) if c in cols else F.col(c) for c in df.columns])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL pieces

PTS = "pts as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
EXT = "ext as (select least(min(x), min(y), min(z)) - 1e-6 as lo, greatest(max(x), max(y), max(z)) + 1e-6 as hi from pts)"
UNIT = f"{PTS}, {EXT}, unit as (select id, (x - lo) / (hi - lo) as x, (y - lo) / (hi - lo) as y, (z - lo) / (hi - lo) as z from pts, ext)"
MESH = f"""cells as (select p_partkey as a from part where p_partkey % {WIDTH} < {WIDTH - 1} and p_partkey + {WIDTH} in (select p_partkey from part)),
    mpts as (select p_partkey as id, cast(p_partkey % {WIDTH} as double) as x, cast(p_partkey // {WIDTH} as double) as y, p_size / 50.0e0 as z from part),
    tri as (select 2 * a as face_id, a as v0, a + 1 as v1, a + {WIDTH} as v2 from cells union all select 2 * a + 1, a + 1, a + {WIDTH + 1}, a + {WIDTH} from cells),
    dedge as (select distinct id, nid from (select v0 as id, v1 as nid from tri union all select v1, v0 from tri union all select v1, v2 from tri union all select v2, v1 from tri union all select v2, v0 from tri union all select v0, v2 from tri)),
    uedge as (select u, v, count(*) as n from (select least(v0, v1) as u, greatest(v0, v1) as v from tri union all select least(v1, v2), greatest(v1, v2) from tri union all select least(v2, v0), greatest(v2, v0) from tri) group by u, v)"""


def d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"


def near_sql(k: int, a: str = "unit", b: str = "unit", on: str = "a.id <> b.id", name: str = "near") -> str:
    return f"{name} as (select id, nid, d2, rank from (select a.id, b.id as nid, {d2('a', 'b')} as d2, row_number() over (partition by a.id order by {d2('a', 'b')}, b.id) as rank from {a} a join {b} b on {on}) where rank <= {k})"


def egg_sql(alpha: float = ALPHA, pts: str = "unit", edges: str = "near") -> str:
    inv = repr(1.0 / (alpha * alpha))
    dot = " + ".join(f"(u.{c} - (p.{c} + c.{c}) / 2) * (c.{c} - p.{c})" for c in "xyz")
    off = " + ".join(f"(u.{c} - (p.{c} + c.{c}) / 2) * (u.{c} - (p.{c} + c.{c}) / 2)" for c in "xyz")
    return f"""blocked as (select distinct e.id, e.nid from {edges} e join {edges} q on q.id = e.id and q.rank < e.rank join {pts} p on p.id = e.id join {pts} c on c.id = e.nid join {pts} u on u.id = q.nid
        where sqrt({d2('p', 'c')}) / 2 >= 1e-6 and ({dot}) * ({dot}) / {d2('c', 'p')} * (1 - {inv}) + ({off}) * {inv} < {d2('c', 'p')} / 4),
    egg as (select e.* from {edges} e left join blocked b on b.id = e.id and b.nid = e.nid where b.id is null)"""


def pass_sql(name: str, src: str, edges: str, scale: float, weight: str = "exp(-(d2))") -> str:
    w = weight.replace("d2", d2("c", "p"))
    sums = ", ".join(f"sum({w} * (c.{a} - p.{a})) as s{a}" for a in "xyz")
    move = ", ".join(f"p.{a} + {scale} * coalesce(s{a} / (case when w = 0 then 1e-8 else w end), 0) as {a}" for a in "xyz")
    return f"{name} as (select p.id, {move} from {src} p left join (select e.id as sid, sum({w}) as w, {sums} from {edges} e join {src} c on c.id = e.nid join {src} p on p.id = e.id group by e.id) on sid = p.id)"


def scatter_sql(pts: str, edges: str) -> str:
    sums = ", ".join(f"sum((c.{t[0]} - g{t[0]}) * (c.{t[1]} - g{t[1]})) as {t}" for t in normals.TERMS)
    return f"""cent as (select p.id, coalesce(m, 0) as n, {", ".join(f"(p.{a} + coalesce(s{a}, 0)) / (coalesce(m, 0) + 1) as g{a}" for a in "xyz")} from {pts} p left join
        (select e.id as sid, count(*) as m, {", ".join(f"sum(c.{a}) as s{a}" for a in "xyz")} from {edges} e join {pts} c on c.id = e.nid group by e.id) on sid = p.id),
    scat as (select e.id, count(*) as n, {sums} from {edges} e join {pts} c on c.id = e.nid join cent g on g.id = e.id group by e.id)"""


EIGEN = """e1 as (select *, (xx + yy + zz) / 3 as q from scat), e2 as (select *, xx - q as a, yy - q as b, zz - q as c from e1),
    e3 as (select *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as p, a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) as det from e2),
    e4 as (select *, acos(greatest(-1.0, least(1.0, coalesce(det / nullif(2 * p * p * p, 0), 0)))) / 3 as phi from e3),
    e5 as (select *, q + 2 * p * cos(phi) as high, q + 2 * p * cos(phi + 2 * 3.141592653589793 / 3) as low from e4),
    eig as (select *, 3 * q - high - low as mid from e5)"""
NORMALS = """k1 as (select id, xx - low as r00, xy as r01, xz as r02, yy - low as r11, yz as r12, zz - low as r22 from eig where n >= 2),
    k2 as (select id, r01 * r12 - r02 * r11 as ax, r02 * r01 - r00 * r12 as ay, r00 * r11 - r01 * r01 as az,
        r01 * r22 - r02 * r12 as bx, r02 * r02 - r00 * r22 as by_, r00 * r12 - r01 * r02 as bz,
        r11 * r22 - r12 * r12 as cx, r12 * r02 - r01 * r22 as cy, r01 * r12 - r11 * r02 as cz from k1),
    k3 as (select *, ax * ax + ay * ay + az * az as na, bx * bx + by_ * by_ + bz * bz as nb, cx * cx + cy * cy + cz * cz as nc from k2),
    k4 as (select id, case when na >= nb and na >= nc then ax when nb >= nc then bx else cx end as x, case when na >= nb and na >= nc then ay when nb >= nc then by_ else cy end as y, case when na >= nb and na >= nc then az when nb >= nc then bz else cz end as z from k3),
    k5 as (select id, x / sqrt(x * x + y * y + z * z) as x, y / sqrt(x * x + y * y + z * z) as y, z / sqrt(x * x + y * y + z * z) as z from k4),
    nor as (select id, x * g as nx, y * g as ny, z * g as nz from (select *, case when (case when abs(x) >= abs(y) and abs(x) >= abs(z) then x when abs(y) >= abs(z) then y else z end) < 0 then -1.0 else 1.0 end as g from k5))"""
GRAPH_K = 8
PRUNED = f"{UNIT}, {near_sql(GRAPH_K)}, {egg_sql()}"
WEIGHTED = f"""{PRUNED}, {scatter_sql("unit", "egg")}, {EIGEN}, {NORMALS},
    und as (select *, row_number() over (order by w, u, v) as i from (select e.u, e.v, round(greatest(0, 1 - abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)), 12) as w, case when a.nx * b.nx + a.ny * b.ny + a.nz * b.nz < 0 then -1 else 1 end as s
        from (select distinct least(id, nid) as u, greatest(id, nid) as v from egg) e join nor a on a.id = e.u join nor b on b.id = e.v)),
    dir as (select i, u as a, v as b, s from und union all select i, v, u, s from und)"""
FOREST = f"""with recursive {WEIGHTED},
    reach(i, x) as (select i, u from und union select r.i, d.b from reach r join dir d on d.a = r.x and d.i < r.i),
    mst as (select u, v, w, s from und where not exists (select 1 from reach r where r.i = und.i and r.x = und.v)),
    tree as (select u as a, v as b, s from mst union all select v, u, s from mst)"""


def weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges of the pruned graph, normals, undirected weighted edges)."""
    u = unit(spark, sf_dir)
    e = materialize(egg.elliptic_gabriel(u, near(u, GRAPH_K), ALPHA), "egg")
    n = materialize(normals.pca_normals(u, e), "normals")
    return e, n, materialize(graph.undirected(e, n), "undirected")


# ---- coordinates and grids


@query(f"with {PTS}, {EXT} select {', '.join(f'round({f}({a}), 6) + 0.0 as {f}_{a}' for a in 'xyz' for f in ('min', 'max'))}, round(any_value(lo), 6) + 0.0 as lo, round(any_value(hi), 6) + 0.0 as hi from pts, ext")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cloud.extent(points(spark, sf_dir))
    return e.select(*[r6(c) for c in e.columns])


@query(f"with {UNIT} select id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from unit")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cloud.normalise(points(spark, sf_dir)), *"xyz")


@query(f"with {PTS} select id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from pts")
def denormalise_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    b = cloud.extent(p)
    return rounded(cloud.denormalise(cloud.normalise(p, b), b), *"xyz")


def cells_sql(b: int) -> str:
    return f"{UNIT}, cell as (select id, {', '.join(f'greatest(0, least({b - 1}, cast(trunc({a} * {b}) as integer))) as c{a}' for a in 'xyz')} from unit)"


@query(f"with {cells_sql(16)} select id, cx, cy, cz, cast(cx + cy * 16 + cz * 256 as bigint) as cell from cell")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.index_of_cells(cloud.normalise(points(spark, sf_dir)), 16).select("id", "cx", "cy", "cz", "cell")


@query(f"with {cells_sql(16)} select cast(cx + cy * 16 + cz * 256 as bigint) as cell, cx, cy, cz, count(*) as n, min(id) as first_id from cell group by cx, cy, cz")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.occupancy(cloud.normalise(points(spark, sf_dir)), 16)


@query(f"""with {UNIT}, lv as (select unnest([1024, 512, 256, 128, 64, 32, 16, 8]) as b),
    c as (select b, {', '.join(f'cast(trunc({a} * b) as integer) as c{a}' for a in 'xyz')} from unit, lv), n as (select b, count(*) as n from c group by b, cx, cy, cz)
    select b, count(*) as occupied, max(n) as max_n, cast(sum(n) as bigint) as points from n group by b""")
def grid_max_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.pyramid(cloud.normalise(points(spark, sf_dir)))


@query(f"with {cells_sql(4)}, n as (select cx, cy, cz, count(*) as n from cell group by cx, cy, cz) select id, cast(cx + cy * 4 + cz * 16 as bigint) as cell, n from cell join n using (cx, cy, cz) where n >= 10")
def grid_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.crowded(cloud.normalise(points(spark, sf_dir)), 4, 10)


# ---- neighbours

EDGES = "id, nid, round(d2, 6) + 0.0 as d2, rank"


@query(f"with {UNIT}, {near_sql(8)} select {EDGES} from near")
def knn_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_bruteforce(points(spark, sf_dir), 8), "d2")


@query(f"with {UNIT}, {near_sql(12)} select {EDGES} from near")
def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_self(points(spark, sf_dir), 12), "d2")


@query(f"""with lab as (select vec_id as id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings),
    pts as (select * from lab where label % 2 = 0), {EXT}, qs as (select id, (x - lo) / (hi - lo) as x, (y - lo) / (hi - lo) as y, (z - lo) / (hi - lo) as z from lab, ext where label % 2 = 1),
    rs as (select id, (x - lo) / (hi - lo) as x, (y - lo) / (hi - lo) as y, (z - lo) / (hi - lo) as z from pts, ext), {near_sql(5, "qs", "rs", "true")} select {EDGES} from near""")
def knn_query_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return rounded(knn.knn_query(e.where("label % 2 = 1").drop("label"), e.where("label % 2 = 0").drop("label"), 5), "d2")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud of all orders: price, date and customer, each axis in its own unit interval."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("y"), F.col("o_custkey").cast("double").alias("z"))
    ends = o.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {a: (F.col(a) - ends.select(f"lo{a}").scalar()) / (ends.select(f"hi{a}").scalar() - ends.select(f"lo{a}").scalar()) for a in "xyz"}
    return o.withColumns(scaled)


ORDER_PTS = """o as (select o_orderkey as id, o_totalprice as x, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as double) as y, cast(o_custkey as double) as z from orders),
    ends as (select min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy, min(z) as loz, max(z) as hiz from o),
    pts as (select id, (x - lox) / (hix - lox) as x, (y - loy) / (hiy - loy) as y, (z - loz) / (hiz - loz) as z from o, ends)"""


@query(f"""with {ORDER_PTS}, {EXT}, unit as (select id, (x - lo) / (hi - lo) as x, (y - lo) / (hi - lo) as y, (z - lo) / (hi - lo) as z from pts, ext),
    near as (select a.id, min(struct_pack(d2 := {d2('a', 'b')}, nid := b.id), 12) as n from unit a join unit b on a.id <> b.id group by a.id),
    flat as (select id, unnest(n) as e, generate_subscripts(n, 1) as rank from near) select id, e.nid as nid, round(e.d2, 6) + 0.0 as d2, rank from flat""")
def knn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest cloud of these tables."""
    return rounded(knn.knn_self(order_points(spark, sf_dir), 12), "d2")


@query(f"with {UNIT} select a.id, b.id as nid, round({d2('a', 'b')}, 6) + 0.0 as d2 from unit a join unit b on a.id <> b.id, ext where {d2('a', 'b')} <= (0.05 / (hi - lo)) * (0.05 / (hi - lo))")
def knn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.radius_join(points(spark, sf_dir), 0.05), "d2")


@query(f"with {UNIT}, {near_sql(4)} select {EDGES} from near, ext where d2 <= (0.06 / (hi - lo)) * (0.06 / (hi - lo))")
def knn_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_self(points(spark, sf_dir), 4, max_radius=0.06), "d2")


@query(f"with {UNIT}, {near_sql(1)} select id, nid, round(d2, 6) + 0.0 as d2 from near")
def knn_nearest1(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    even, odd = (u.where(f"id % 2 = {k}") for k in (0, 1))
    return rounded(knn.elementwise_nearest(*[knn.knn_join(u, part, 1, exclude_self=True).select("id", "nid", "d2") for part in (even, odd)]), "d2")


@query(f"with {UNIT}, {near_sql(6)} select {EDGES} from near")
def knn_topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    parts = [knn.knn_join(u, u.where(f"id % 3 <> {k}"), 6, exclude_self=True) for k in (0, 1)]
    return rounded(knn.merge_top_k(*parts, 6), "d2")


@query(f"with {UNIT}, {near_sql(40)} select id, nid, round(d2, 6) + 0.0 as d2 from near where id = 7")
def knn_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.nearest_to(points(spark, sf_dir), 7, 40), "d2")


@query(f"with {UNIT}, {near_sql(40)} select nid, round(d2, 6) + 0.0 as d2, rank from near where id = 7")
def knn_of_one_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_of_one, from a cloud laid out along a curve: the search opens the row groups around the place only."""
    laid = knn.lay_out(points(spark, sf_dir), scratch_path(spark, "laid-out"))
    at = unit(spark, sf_dir).where("id = 7").first()
    return rounded(knn.nearest_in(laid, (at["x"], at["y"], at["z"]), 40, but=7), "d2")


@query(f"with {UNIT}, {near_sql(12)} select id, count(*) as n, round(max(d2), 6) + 0.0 as max_d2 from near group by id")
def knn_kth_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(knn.kth_radius(near(u, 12)), "max_d2")


@query(f"""with {UNIT}, {near_sql(8)}, c as (select count(*) as n from unit), e as (select least(3, id // greatest(1, n // 4)) as part, least(3, nid // greatest(1, n // 4)) as from_part, nid from near, c)
    select part, from_part, count(distinct nid) as halo from e where part <> from_part group by part, from_part""")
def edge_cut_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return knn.edge_cut(near(u, 8), u.count(), 4)


@query(f"with {UNIT}, {near_sql(12)} select {EDGES} from near")
def knn_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_grid, with every query down the tree."""
    u = unit(spark, sf_dir)
    return rounded(knn.knn_join(u, u, 12, exclude_self=True, strict=False, cells=1), "d2")


@query(f"with {UNIT}, {near_sql(20)} select {EDGES} from near")
def knn_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.first_neighbours(near(unit(spark, sf_dir), 24), 20), "d2")


@query(f"""with {PTS}, {EXT}, sized as (select (hi - lo) / 4 as w from ext) select id, not ((x - lo - w) / (2 * w) >= 0 and (x - lo - w) / (2 * w) < 1 and (y - lo - w) / (2 * w) >= 0 and (y - lo - w) / (2 * w) < 1 and (z - lo - w) / (2 * w) >= 0 and (z - lo - w) / (2 * w) < 1) as out from pts, ext, sized""")
def grid_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points outside the middle half of the cloud's cube."""
    p = points(spark, sf_dir)
    w = (F.col("hi") - F.col("lo")) / 4
    middle = cloud.extent(p).select((F.col("lo") + w).alias("lo"), (F.col("hi") - w).alias("hi"))
    return cloud.outside(cloud.normalise(p, middle)).select("id", "out")


@query(f"with {PTS} select id, row_number() over (order by id) - 1 as place from pts where id >= 100")
def split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.split_queries(points(spark, sf_dir), 100)


@query(f"with {cells_sql(8)} select id, row_number() over (order by id) - 1 as old_pos, row_number() over (order by cx + cy * 8 + cz * 64, id) - 1 as new_pos from cell")
def spatial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.spatial_order(cloud.normalise(points(spark, sf_dir)), 8)


@query(f"with {cells_sql(4)} select cast(cx + cy * 4 + cz * 16 as bigint) as cell, bit_or(cast(1 as bigint) << cast(id % 16 as bigint)) as mask from cell group by all")
def cell_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cloud.index_of_cells(cloud.normalise(points(spark, sf_dir)), 4)
    return order.mask_or(c.select("cell", F.expr("shiftleft(1L, cast(id % 16 as int))").alias("mask")), "cell", "mask")


@query(f"with {UNIT}, {near_sql(6)} select cast(rank - 1 as bigint) as row, id as col, nid as value from near")
def neighbour_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour table, a row a point, turned: a row a rank."""
    e = near(unit(spark, sf_dir), 6).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nid"))).alias("n"))
    t = order.transpose(e.select("id", F.transform("n", lambda x: x["nid"]).alias("n")), "id", "n")
    return t.select(F.col("row").cast("long").alias("row"), "col", "value")


@query(f"with {UNIT}, {near_sql(12)}, {egg_sql()} select {EDGES} from egg")
def egg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(egg.elliptic_gabriel(u, near(u, 12), ALPHA), "d2")


@query(f"with {UNIT}, {near_sql(12)}, {egg_sql()} select {EDGES} from egg")
def egg_edges_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(egg.elliptic_gabriel_join(u, near(u, 12), ALPHA), "d2")


@query(f"with {UNIT}, {near_sql(12)}, {egg_sql()} select id, count(*) as degree from egg group by id")
def egg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return egg.degree(egg.elliptic_gabriel(u, near(u, 12), ALPHA))


# ---- geometry


@query(f"""with {PTS}, p as (select id, x, y, z, abs(x) >= abs(y) and abs(x) >= abs(z) as on_x, abs(y) >= abs(x) and abs(y) >= abs(z) as on_y from pts),
    q as (select id, x, y, z, case when on_x then -(y + z) / nullif(x, 0) else 1 end as px, case when not on_x and on_y then -(x + z) / nullif(y, 0) else 1 end as py, case when not on_x and not on_y then -(x + y) / nullif(z, 0) else 1 end as pz from p),
    r as (select id, x / sqrt(x * x + y * y + z * z) as ax, y / sqrt(x * x + y * y + z * z) as ay, z / sqrt(x * x + y * y + z * z) as az, px / sqrt(px * px + py * py + pz * pz) as px, py / sqrt(px * px + py * py + pz * pz) as py, pz / sqrt(px * px + py * py + pz * pz) as pz, x, y, z from q)
    select id, round(px, 6) + 0.0 as px, round(py, 6) + 0.0 as py, round(pz, 6) + 0.0 as pz, round(ax * (1 - x) + ay * (2 - y) + az * (3 - z), 6) + 0.0 as along, round(px * (1 - x) + py * (2 - y) + pz * (3 - z), 6) + 0.0 as across,
        round((ay * pz - az * py) * (1 - x) + (az * px - ax * pz) * (2 - y) + (ax * py - ay * px) * (3 - z), 6) + 0.0 as up from r""")
def local_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point (1, 2, 3) in the frame at each point whose first axis is the point's own direction, and the frame's second axis."""
    p = points(spark, sf_dir)
    rows = G.frame(G.vec())
    there = G.to_frame(rows, G.vec(), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(p.select("id", *[c.alias(f"p{a}") for a, c in zip("xyz", rows[1], strict=True)], *[c.alias(n) for n, c in zip(("along", "across", "up"), there, strict=True)]), "px", "py", "pz", "along", "across", "up")


# ---- meshes


@query(f"with {MESH} select a as face_id, cast(4 as bigint) as vertex_indices_count, a as vertex_indices_0, a + 1 as vertex_indices_1, a + {WIDTH + 1} as vertex_indices_2 from cells")
def mesh_fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.fixed_columns(quads(spark, sf_dir), "vertex_indices", 3)


@query(f"with {MESH} select face_id, v0, v1, v2 from tri where face_id % 5 not in (0, 1, 2)")
def mesh_valid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces left when some have a vertex that is null, negative or the mark of a missing one."""
    f, kind = faces(spark, sf_dir), F.col("face_id") % 5
    return mesh.valid_faces(f.withColumn("v1", F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(-1)).when(kind == 2, F.lit(mesh.NO_VERTEX)).otherwise(F.col("v1"))))


@query(f"with {MESH} select d.id, d.nid, round({d2('a', 'b')}, 6) + 0.0 as d2 from dedge d join mpts a on a.id = d.id join mpts b on b.id = d.nid")
def mesh_one_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.one_ring(lattice(spark, sf_dir), faces(spark, sf_dir)).drop("rank"), "d2")


@query(f"with {MESH} select id, count(*) as degree from dedge group by id")
def mesh_vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_degree(faces(spark, sf_dir))


@query(f"with {MESH} select u, v from uedge where n = 1")
def mesh_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary_edges(faces(spark, sf_dir))


@query(f"with {MESH} select *, vertices - edges + faces as euler from (select (select count(*) from mpts) as vertices, (select count(*) from uedge) as edges, (select count(*) from tri) as faces)")
def mesh_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.euler(lattice(spark, sf_dir), faces(spark, sf_dir))


@query(f"with {MESH} select a as face_id, cast(0 as bigint) as t, a as v0, a + 1 as v1, a + {WIDTH} as v2 from cells union all select a, 1, a + {WIDTH + 1}, a + {WIDTH}, a + 1 from cells")
def mesh_triangulate_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangulate(lattice(spark, sf_dir), quads(spark, sf_dir))


@query(f"with {MESH} select cast(2 * count(*) as bigint) as triangles, true as requires_triangulation from cells")
def mesh_triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangle_count(quads(spark, sf_dir))


@query(f"with {MESH} select count(*) as lists, cast(4 * count(*) as bigint) as entries, cast(4 as bigint) as shortest, cast(4 as bigint) as longest from cells")
def mesh_list_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.list_statistics(quads(spark, sf_dir))


@query(f"with {MESH}, c as (select a, row_number() over (order by a) - 1 as i from cells) select 4 * i + j as slot, a as face_id, cast(j as bigint) as pos, a + [0, 1, {WIDTH + 1}, {WIDTH}][j + 1] as value from c, range(4) t(j)")
def mesh_list_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order.flatten_lists(quads(spark, sf_dir), "face_id", "vertex_indices")
    return f.select(F.col("slot").cast("long").alias("slot"), "face_id", F.col("at").cast("long").alias("pos"), "value")


@query(f"with {MESH}, p as (select *, row_number() over (order by id) - 1 as i from mpts) select 4 * i + j as slot, round([x, y, z][j + 1], 6) + 0.0 as value from p, range(3) t(j)")
def strided_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, four places apart."""
    v = order.strided(lattice(spark, sf_dir), "id", ["x", "y", "z"], 4)
    return rounded(v.withColumn("slot", F.col("slot").cast("long")), "value")


@query(f"""with {MESH}, hex as (select a from cells where a % {WIDTH} < {WIDTH - 2})
    select a as face_id, cast(4 as bigint) as triangles, cast(6 as bigint) as corners, 2.0 as area from hex""")
def mesh_triangulate_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-cornered faces, two cells of the lattice laid flat: each gives four triangles that cover it."""
    a, flat = F.col("vertex_indices")[0], lattice(spark, sf_dir).withColumn("z", F.lit(0.0))
    faces6 = quads(spark, sf_dir).where(a % WIDTH < WIDTH - 2).select("face_id", F.array(a, a + 1, a + 2, a + WIDTH + 2, a + WIDTH + 1, a + WIDTH).alias("vertex_indices"))
    t = materialize(mesh.triangulate(flat, faces6), "triangles")
    areas = mesh.face_areas(flat, t.withColumn("face_id", F.col("face_id") * 4 + F.col("t"))).groupBy(F.floor(F.col("face_id") / 4).alias("of")).agg(F.sum("area").alias("area"))
    got = t.groupBy("face_id").agg(F.count(F.lit(1)).alias("triangles"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("v0", "v1", "v2"))))).cast("long").alias("corners"))
    return rounded(got.join(areas.hint("merge"), F.col("face_id") == F.col("of")).drop("of"), "area")


@query(f"""with {MESH}, e as (select face_id, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz from tri join mpts a on a.id = v0 join mpts b on b.id = v1 join mpts c on c.id = v2)
    select face_id, round(sqrt((uy * vz - uz * vy) * (uy * vz - uz * vy) + (uz * vx - ux * vz) * (uz * vx - ux * vz) + (ux * vy - uy * vx) * (ux * vy - uy * vx)) / 2, 6) + 0.0 as area from e""")
def mesh_face_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.face_areas(lattice(spark, sf_dir), faces(spark, sf_dir)), "area")


# ---- smoothing

XYZ = "id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z"


def taubin_sql(base: str, src: str, edges: str, iterations: int) -> str:
    parts, now = [base], src
    for i in range(iterations):
        parts += [pass_sql(f"l{i}", now, edges, smoothing.LAMBDA), pass_sql(f"m{i}", f"l{i}", edges, smoothing.MU)]
        now = f"m{i}"
    return f"with {', '.join(parts)} select {XYZ} from {now}"


@query(f"with {UNIT}, {near_sql(12)}, {pass_sql('l0', 'unit', 'near', smoothing.LAMBDA)} select {XYZ} from l0")
def taubin_lambda_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin_pass(u, near(u, 12), smoothing.LAMBDA), *"xyz")


@query(taubin_sql(f"{UNIT}, {near_sql(12)}", "unit", "near", 1))
def taubin_iteration_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin(u, near(u, 12), 1), *"xyz")


@query(taubin_sql(f"{UNIT}, {near_sql(12)}", "unit", "near", 2))
def taubin_iteration_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin(u, near(u, 12), 2), *"xyz")


@query(taubin_sql(f"{UNIT}, {near_sql(12)}", "unit", "near", 2))
def taubin_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin_many(u, near(u, 12), 2), *"xyz")


@query(taubin_sql(f"{UNIT}, {near_sql(12)}", "unit", "near", 10))
def taubin_iteration_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin_many(u, near(u, 12), 10), *"xyz")


@query(f"with {UNIT}, {near_sql(12)}, {pass_sql('l0', 'unit', 'near', smoothing.LAMBDA, '1')}, {pass_sql('m0', 'l0', 'near', smoothing.MU, '(1 / (d2 + 1e-8))')} select {XYZ} from m0")
def taubin_regularised(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(smoothing.taubin(u, near(u, 12), 1, regularised=True), *"xyz")


@query(taubin_sql(MESH, "mpts", "dedge", 1))
def taubin_mesh_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(smoothing.taubin(lattice(spark, sf_dir), mesh.directed_edges(faces(spark, sf_dir)), 1), *"xyz")


# ---- normals


@query(f"with {PRUNED}, {scatter_sql('unit', 'egg')} select id, n, round(gx, 6) + 0.0 as gx, round(gy, 6) + 0.0 as gy, round(gz, 6) + 0.0 as gz from cent")
def nbr_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(normals.centroids(u, egg.elliptic_gabriel(u, near(u, GRAPH_K), ALPHA)), "gx", "gy", "gz")


@query(f"with {PRUNED}, {scatter_sql('unit', 'egg')} select id, n, {', '.join(f'round({t}, 6) + 0.0 as {t}' for t in normals.TERMS)} from scat")
def nbr_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(normals.scatter(u, materialize(egg.elliptic_gabriel(u, near(u, GRAPH_K), ALPHA), "egg")), *normals.TERMS)


@query(f"with {UNIT}, {near_sql(12)}, {scatter_sql('unit', 'near')}, {EIGEN} select id, round(low, 6) + 0.0 as e0, round(mid, 6) + 0.0 as e1, round(high, 6) + 0.0 as e2 from eig")
def nbr_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(normals.eigenvalues(u, near(u, 12)), "e0", "e1", "e2")


PCA = f"with {UNIT}, {near_sql(12)}, {scatter_sql('unit', 'near')}, {EIGEN}, {NORMALS} select u.id, round(nx, 6) + 0.0 as nx, round(ny, 6) + 0.0 as ny, round(nz, 6) + 0.0 as nz from unit u left join nor on nor.id = u.id"


@query(PCA)
def pca_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(normals.pca_normals(u, near(u, 12)), "nx", "ny", "nz")


@query(PCA)
def pca_normals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(normals.pca_normals(u, near(u, 12), exact=True), "nx", "ny", "nz")


@query(f"""with {UNIT}, {near_sql(12)}, {scatter_sql('unit', 'near')}, {EIGEN}, {NORMALS}
    select eig.id, round(low, 6) + 0.0 as e0, round(mid, 6) + 0.0 as e1, round(high, 6) + 0.0 as e2, round(nx, 6) + 0.0 as nx, round(ny, 6) + 0.0 as ny, round(nz, 6) + 0.0 as nz, 0.0::double as off, 1.0::double as hand from eig join nor using (id)""")
def eigen_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full bases: the largest miss of A v = e v and of right angles in any of the three orders, and the handedness."""
    u = unit(spark, sf_dir)
    e = near(u, 12)
    s = materialize(normals.scatter(u, e), "scatter").withColumnRenamed("id", "sid").drop("n")
    out = None
    for k, order_ in enumerate((normals.ASCENDING, normals.DESCENDING, normals.BY_AXIS)):
        b = normals.eigen_bases(u, e, order_).join(s, F.col("id") == F.col("sid"))
        v = [G.vec(f"v{i}") for i in range(3)]
        rows = [(F.col("xx"), F.col("xy"), F.col("xz")), (F.col("xy"), F.col("yy"), F.col("yz")), (F.col("xz"), F.col("yz"), F.col("zz"))]
        misses = [F.abs(G.dot(rows[j], v[i]) - F.col(f"e{i}") * v[i][j]) for i in range(3) for j in range(3)]
        misses += [F.abs(G.dot(v[i], v[j]) - F.lit(1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
        one = b.select(F.col("id").alias(f"id{k}"), F.greatest(*misses).alias(f"off{k}"), G.dot(v[0], G.cross(v[1], v[2])).alias(f"hand{k}"), *([] if k else ["e0", "e1", "e2", *[v[0][i].alias(f"n{a}") for i, a in enumerate("xyz")]]))
        out = one if out is None else out.join(one, F.col("id0") == F.col(f"id{k}"))
    worst = F.greatest(*[F.col(f"off{k}") for k in range(3)])
    return rounded(out.select(F.col("id0").alias("id"), "e0", "e1", "e2", "nx", "ny", "nz", worst.alias("off"), F.least(*[F.col(f"hand{k}") for k in range(3)]).alias("hand")), "e0", "e1", "e2", "nx", "ny", "nz", "off", "hand")


# ---- graphs


@query(f"with {WEIGHTED} select u, v, round(w, 6) + 0.0 as w, s from und")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weighted(spark, sf_dir)[2], "w")


@query(f"{FOREST} select u, v, round(w, 6) + 0.0 as w from mst")
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.spanning_forest(weighted(spark, sf_dir)[2])[0], "w")


@query(f"{FOREST} select u, v, round(w, 6) + 0.0 as w from mst")
def mst_edges_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.spanning_forest(weighted(spark, sf_dir)[2], task=100)[0], "w")


@query(f"{FOREST} select count(*) as edges, round(sum(w), 6) + 0.0 as weight from mst")
def mst_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graph.spanning_forest(weighted(spark, sf_dir)[2])[0]
    return f.agg(F.count(F.lit(1)).alias("edges"), r6(F.sum("w"), "weight"))


@query(f"{FOREST} select a as id, count(*) as degree from tree group by a")
def mst_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forest_degree(graph.spanning_forest(weighted(spark, sf_dir)[2])[0])


DIST = f"""with recursive {UNIT}, {near_sql(GRAPH_K)}, und as (select *, row_number() over (order by w, u, v) as i from (select least(id, nid) as u, greatest(id, nid) as v, round(min(d2), 12) as w from near group by 1, 2)),
    dir as (select i, u as a, v as b from und union all select i, v, u from und), reach(i, x) as (select i, u from und union select r.i, d.b from reach r join dir d on d.a = r.x and d.i < r.i)"""


@query(f"with {UNIT}, {near_sql(20)}, {scatter_sql('unit', 'near')}, {EIGEN}, {NORMALS} select u.id, round(nx, 6) + 0.0 as nx, round(ny, 6) + 0.0 as ny, round(nz, 6) + 0.0 as nz from unit u left join nor on nor.id = u.id")
def unoriented_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipeline.unoriented_normals(points(spark, sf_dir), 24, 20), "nx", "ny", "nz")


@query(f"{DIST} select u, v, round(w, 6) + 0.0 as w from und where not exists (select 1 from reach r where r.i = und.i and r.x = und.v)")
def mst_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.spanning_forest(graph.distance_edges(near(unit(spark, sf_dir), GRAPH_K)))[0], "w")


COMPONENTS = f"with recursive {UNIT}, {near_sql(2)}, d as (select id as a, nid as b from near union select nid, id from near), reach(id, x) as (select a, b from d union select r.id, d.b from reach r join d on d.a = r.x), comp as (select id, min(x) as comp from reach group by id)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return components(near(u, 2).select(F.col("id").alias("u"), F.col("nid").alias("v")))


@query(f"{COMPONENTS} select id, comp from comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


@query(f"{COMPONENTS} select id, comp from comp")
def connected_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of edges dealt out to many tasks, which contract little."""
    u = unit(spark, sf_dir)
    return components(near(u, 2).select(F.col("id").alias("u"), F.col("nid").alias("v")).repartition(32))


@query(f"{COMPONENTS} select comp, count(*) as n from comp group by comp")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{FOREST}, cr(id, x) as (select a, b from tree union select r.id, t.b from cr r join tree t on t.a = r.x), cmp as (select id, least(id, min(x)) as comp from cr group by id),
    o(id, parent, s, comp) as (select id, cast(null as bigint), 1, comp from cmp where id = comp union all select t.b, o.id, o.s * t.s, o.comp from o join tree t on t.a = o.id where o.parent is null or t.b <> o.parent)
    select u.id, round(nx * coalesce(s, 1), 6) + 0.0 as nx, round(ny * coalesce(s, 1), 6) + 0.0 as ny, round(nz * coalesce(s, 1), 6) + 0.0 as nz, coalesce(comp, u.id) as comp from unit u left join nor on nor.id = u.id left join o on o.id = u.id""")
def orient_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n, e = weighted(spark, sf_dir)
    return rounded(graph.orient(n, graph.spanning_forest(e)[1]), "nx", "ny", "nz")


@query(f"""with {WEIGHTED}, v as (select least(e.id % 3, e.nid % 3) as c1, greatest(e.id % 3, e.nid % 3) as c2, case when a.nx * b.nx + a.ny * b.ny + a.nz * b.nz > 0 then 1 else -1 end as vote from egg e join nor a on a.id = e.id join nor b on b.id = e.nid where e.id % 3 <> e.nid % 3)
    select c1, c2, cast(sum(vote) as bigint) as votes, cast(sign(sum(vote)) as integer) as sign from v group by c1, c2 having sum(vote) <> 0""")
def component_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, _ = weighted(spark, sf_dir)
    return graph.component_votes(e, n.withColumn("comp", F.col("id") % 3))


@query(f"""with recursive {WEIGHTED}, vt as (select least(e.id % 3, e.nid % 3) as c1, greatest(e.id % 3, e.nid % 3) as c2, sum(case when a.nx * b.nx + a.ny * b.ny + a.nz * b.nz > 0 then 1 else -1 end) as votes
        from egg e join nor a on a.id = e.id join nor b on b.id = e.nid where e.id % 3 <> e.nid % 3 group by 1, 2 having votes <> 0),
    vn as (select *, row_number() over (order by -abs(votes), c1, c2) as i from vt), vd as (select i, c1 as a, c2 as b from vn union all select i, c2, c1 from vn),
    vr(i, x) as (select i, c1 from vn union select r.i, d.b from vr r join vd d on d.a = r.x and d.i < r.i),
    vm as (select c1, c2, cast(sign(votes) as integer) as s from vn where not exists (select 1 from vr r where r.i = vn.i and r.x = vn.c2)),
    vtree as (select c1 as a, c2 as b, s from vm union all select c2, c1, s from vm),
    va(id, x) as (select a, b from vtree union select r.id, t.b from va r join vtree t on t.a = r.x), vl as (select id, least(id, min(x)) as low from va group by id),
    vo(id, parent, s) as (select id, cast(null as bigint), 1 from vl where id = low union all select t.b, o.id, o.s * t.s from vo o join vtree t on t.a = o.id where o.parent is null or t.b <> o.parent)
    select u.id, round(nx * coalesce(s, 1), 6) + 0.0 as nx, round(ny * coalesce(s, 1), 6) + 0.0 as ny, round(nz * coalesce(s, 1), 6) + 0.0 as nz, u.id % 3 as comp from unit u left join nor on nor.id = u.id left join vo on vo.id = u.id % 3""")
def component_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, _ = weighted(spark, sf_dir)
    n = n.withColumn("comp", F.col("id") % 3)
    return rounded(graph.flip_components(n, graph.component_votes(e, n)), "nx", "ny", "nz")


#: Orientation along a sparse forest of many components, then votes over all neighbours between them.
SPARSE = FOREST.replace(PRUNED, f"{UNIT}, {near_sql(GRAPH_K)}, egg as (select id, nid from near where rank <= 2)").replace(scatter_sql("unit", "egg"), scatter_sql("unit", "near"))


@query(f"""{SPARSE}, cr(id, x) as (select a, b from tree union select r.id, t.b from cr r join tree t on t.a = r.x), cmp as (select id, least(id, min(x)) as comp from cr group by id),
    o(id, parent, s, comp) as (select id, cast(null as bigint), 1, comp from cmp where id = comp union all select t.b, o.id, o.s * t.s, o.comp from o join tree t on t.a = o.id where o.parent is null or t.b <> o.parent),
    ori as (select u.id, nx * coalesce(s, 1) as nx, ny * coalesce(s, 1) as ny, nz * coalesce(s, 1) as nz, coalesce(comp, u.id) as comp from unit u left join nor on nor.id = u.id left join o on o.id = u.id),
    vt as (select least(a.comp, b.comp) as c1, greatest(a.comp, b.comp) as c2, sum(case when a.nx * b.nx + a.ny * b.ny + a.nz * b.nz > 0 then 1 else -1 end) as votes
        from near e join ori a on a.id = e.id join ori b on b.id = e.nid where a.comp <> b.comp and a.nx is not null and b.nx is not null group by 1, 2 having votes <> 0),
    vn as (select *, row_number() over (order by -abs(votes), c1, c2) as i from vt), vd as (select i, c1 as a, c2 as b from vn union all select i, c2, c1 from vn),
    vr(i, x) as (select i, c1 from vn union select r.i, d.b from vr r join vd d on d.a = r.x and d.i < r.i),
    vm as (select c1, c2, cast(sign(votes) as integer) as s from vn where not exists (select 1 from vr r where r.i = vn.i and r.x = vn.c2)),
    vtree as (select c1 as a, c2 as b, s from vm union all select c2, c1, s from vm),
    va(id, x) as (select a, b from vtree union select r.id, t.b from va r join vtree t on t.a = r.x), vl as (select id, least(id, min(x)) as low from va group by id),
    vo(id, parent, s) as (select id, cast(null as bigint), 1 from vl where id = low union all select t.b, o.id, o.s * t.s from vo o join vtree t on t.a = o.id where o.parent is null or t.b <> o.parent)
    select ori.id, round(nx * coalesce(s, 1), 6) + 0.0 as nx, round(ny * coalesce(s, 1), 6) + 0.0 as ny, round(nz * coalesce(s, 1), 6) + 0.0 as nz, comp from ori left join vo on vo.id = ori.comp""")
def agreed_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals that agree along a sparse forest, whose components then vote on each other over all neighbours and flip."""
    u = unit(spark, sf_dir)
    all_ = near(u, GRAPH_K)
    n = materialize(normals.pca_normals(u, all_), "normals")
    _, labels = graph.spanning_forest(graph.undirected(knn.first_neighbours(all_, 2), n))
    return rounded(pipeline.agreed(graph.orient(n, labels), all_), "nx", "ny", "nz")


# ---- order


@query("select o_orderkey as id, cast(row_number() over (order by o_orderkey) - 1 as bigint) as place from orders where o_orderstatus = 'F'")
def prefix_sum_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return order.compact(o, "id", F.col("o_orderstatus") == "F").select("id", F.col("place").cast("long"))


@query("select l_orderkey as id, cast(sum(n) over (order by l_orderkey) as bigint) as inclusive, cast(sum(n) over (order by l_orderkey) - n as bigint) as exclusive from (select l_orderkey, count(*) as n from lineitem group by l_orderkey)")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return order.prefix_sum(n, "id", "n").select("id", F.col("inclusive").cast("long"), F.col("exclusive").cast("long"))


@query(f"with {PTS} select id, row_number() over (order by id) - 1 as old_pos, row_number() over (order by x, id) - 1 as new_pos from pts")
def inverse_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.permutation(points(spark, sf_dir), "x")


@query(f"with {PTS} select id, round(abs(lead(x) over (order by x, id) - x), 6) + 0.0 as gap from pts qualify lead(x) over (order by x, id) is not null")
def axis_gap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cloud.gap_density(points(spark, sf_dir)).select("id", "gap"), "gap")


@query("select l_orderkey as k, max(l_linenumber) as at from lineitem group by l_orderkey")
def segment_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.segment_ends(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("at")), "k", "at")


@query("""select k, line, quantity, part from (select l_orderkey as k, l_linenumber as line, round(l_quantity, 6) + 0.0 as quantity, l_partkey as part, row_number() over (partition by l_orderkey order by l_linenumber desc, l_quantity desc, l_partkey desc) as back from lineitem) where back = 1""")
def segment_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part"))
    return rounded(order.segment_ends(rows, "k", "line"), "quantity")


# ---- files and whole pipelines


@query(f"with {PTS} select row_number() over (order by id) - 1 as id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from pts")
def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cloud")
    ply.write_mesh(path, points(spark, sf_dir))
    return rounded(ply.load_mesh(spark, path)[0], *"xyz")


@query(f"with {MESH} select a as corner, cast([a, a + 1, a + {WIDTH + 1}, a + {WIDTH}] as bigint[])::varchar as indices from cells")
def ply_faces_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "mesh")
    ply.write_mesh(path, lattice(spark, sf_dir), quads(spark, sf_dir))
    f = ply.load_mesh(spark, path)[1]
    return f.select(F.col("vertex_indices")[0].alias("corner"), F.concat(F.lit("["), F.array_join(F.col("vertex_indices").cast("array<string>"), ", "), F.lit("]")).alias("indices"))


@query(f"with {PTS} select row_number() over (order by id) - 1 as id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from pts")
def ply_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file read whole into a binary column and taken apart there."""
    path = scratch_path(spark, "cloud")
    ply.write_mesh(path, points(spark, sf_dir))
    return rounded(ply.load_bytes(spark.read.format("binaryFile").load(path), "x float, y float, z float").select("id", *[F.col(a).cast("double").alias(a) for a in "xyz"]), *"xyz")


FILES = f"{PTS}, numbered as (select id % 7 as file, row_number() over (partition by id % 7 order by id) - 1 as id, x, y, z from pts) select cast(file as varchar) as file, id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from numbered"


@query(f"with {PTS} select id, x, y, z from pts where id % 3 <> 1")
def ply_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by tasks as a folder of files, appended to once, and read back with a filter."""
    path = scratch_path(spark, "ply-folder")
    ply.register(spark)
    p = points(spark, sf_dir).withColumn("number", F.col("id").cast("int")).drop("id").repartition(3)
    p.where("number % 3 = 0").write.format("ply").mode("append").save(path)
    p.where("number % 3 > 0").write.format("ply").mode("append").save(path)
    return ply.load(spark, path).where("number % 3 <> 1").select(F.col("number").cast("long").alias("id"), "x", "y", "z")


@query(f"with {PTS}, few as (select * from pts where id >= 40 and id < 340) select id, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from few")
def ply_pushed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows of one file: their range is all that is read."""
    path = scratch_path(spark, "ply") + ".ply"
    ply.write_mesh(path, points(spark, sf_dir))
    return rounded(ply.load(spark, path).where("id >= 40 and id < 340").select("id", *[F.col(a).cast("double").alias(a) for a in "xyz"]), *"xyz")


@query(f"with {PTS} select id, x, y, z from pts")
def ply_text_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of all points, read in splits."""
    path, p = scratch_path(spark, "ply-text"), points(spark, sf_dir)
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), p.agg(F.count(F.lit(1)).alias("n")).select("n").scalar().cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nend_header"))
    lines = spark.range(1).select(F.lit(-1).cast("long").alias("id"), head.alias("value")).unionByName(p.select("id", F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"]).alias("value")))
    lines.coalesce(1).sortWithinPartitions("id").select("value").write.text(path)
    (name, _), *_ = ply.files(f"{path}/part-*")[0]
    return ply.load(spark, name, split=1 << 13)


@query("select 2 * p_partkey + t as face_id, case when t = 0 then [p_partkey, p_partkey + 1, p_partkey + 2] else [p_partkey, p_partkey + 2, p_partkey + 1, p_partkey + 3] end as vertex_indices from part, (select unnest([0, 1]) as t) where p_partkey < (select max(p_partkey) from part) - 2")
def ply_lists_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of three and four corners in turn, one behind the other in a binary file, read in splits."""
    path, p = scratch_path(spark, "ply") + ".ply", lattice(spark, sf_dir)
    k = F.col("id")
    last = p.agg(F.max("id").alias("last")).select("last").scalar()
    some = p.where(k < last - 2).select(F.inline(F.array(F.struct((2 * k).alias("face_id"), F.array(k, k + 1, k + 2).alias("vertex_indices")), F.struct((2 * k + 1).alias("face_id"), F.array(k, k + 2, k + 1, k + 3).alias("vertex_indices")))))
    ply.write_mesh(path, p, some)
    f = ply.load(spark, path, "face", split=1 << 12)
    return f.select(F.col("id").alias("face_id"), F.col("vertex_indices").cast("array<long>").alias("vertex_indices"))


def _ply_files(spark: SparkSession, sf_dir: str, encoding: str) -> DataFrame:
    """(path, content): seven small files in memory, each with an element of lists before the vertices."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        head = f"ply\nformat {encoding} 1.0\ncomment made here\nelement part 2\nproperty list uchar short of\nelement vertex {len(part)}\nproperty int id\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
        if encoding == "ascii":
            body = "2 7 -8\n0\n" + "".join(f"{i} {x!r} {y!r}\n{z!r}\n" for i, x, y, z in zip(part["id"].tolist(), *(part[a].tolist() for a in "xyz"), strict=True))
            data = (head + body).encode()
        else:
            order = ply.ORDER[encoding]
            rows = np.zeros(len(part), [("id", order + "i4"), *[(a, order + "f8") for a in "xyz"]])
            for a in rows.dtype.names:
                rows[a] = part[a]
            data = head.encode() + struct.pack(order + "BhhB", 2, 7, -8, 0) + rows.tobytes()
        return pd.DataFrame({"path": [str(int(part["file"].iloc[0]))], "content": [data]})

    return points(spark, sf_dir).withColumn("file", F.col("id") % 7).groupBy("file").applyInPandas(pack, "path string, content binary")


@query(f"with {FILES}")
def ply_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files whose rows run over line ends."""
    return rounded(ply.load_bytes(_ply_files(spark, sf_dir, "ascii"), "x double, y double, z double"), *"xyz")


@query(f"with {FILES}")
def ply_big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ply.load_bytes(_ply_files(spark, sf_dir, "binary_big_endian"), "x double, y double, z double"), *"xyz")


@query("select cast(id % 7 as varchar) as file, 2 as lists, 2 as entries from (select distinct vec_id % 7 as id from embeddings)")
def ply_lists_of_two_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ply.load_bytes(_ply_files(spark, sf_dir, "binary_little_endian"), "of array<short>", "part")
    return found.groupBy("file").agg(F.count("of").cast("int").alias("lists"), F.sum(F.size("of")).cast("int").alias("entries"))


@query(f"with {PTS} select round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from pts")
def xyz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cloud-xyz")
    xyz.write_xyz(points(spark, sf_dir), path)
    return rounded(xyz.read_xyz(spark, path), *"xyz")


def _smooth_cloud_sql(k: int, iterations: int) -> str:
    """The whole pipeline: neighbours, pruning, passes, normals on the smoothed positions, the forest and the signs along it."""
    parts, now = [UNIT, near_sql(k), egg_sql()], "unit"
    for i in range(iterations):
        parts += [pass_sql(f"l{i}", now, "egg", smoothing.LAMBDA), pass_sql(f"m{i}", f"l{i}", "egg", smoothing.MU)]
        now = f"m{i}"
    rest = FOREST[len(f"with recursive {PRUNED}, ") :].replace(scatter_sql("unit", "egg"), scatter_sql(now, "egg"))
    signs = """cr(id, x) as (select a, b from tree union select r.id, t.b from cr r join tree t on t.a = r.x), cmp as (select id, least(id, min(x)) as comp from cr group by id),
        o(id, parent, s) as (select id, cast(null as bigint), 1 from cmp where id = comp union all select t.b, o.id, o.s * t.s from o join tree t on t.a = o.id where o.parent is null or t.b <> o.parent)"""
    at = ", ".join(f"round(p.{c} * (hi - lo) + lo, 6) + 0.0 as {c}" for c in "xyz")
    to = ", ".join(f"round(n{c} * coalesce(s, 1), 6) + 0.0 as n{c}" for c in "xyz")
    return f"with recursive {', '.join(parts)}, {rest}, {signs} select p.id, {at}, {to} from {now} p cross join ext left join nor on nor.id = p.id left join o on o.id = p.id"


@query(_smooth_cloud_sql(12, 2))
def smooth_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipeline.smooth_cloud(points(spark, sf_dir), k=12, iterations=2, alpha=ALPHA, exact=False), "x", "y", "z", "nx", "ny", "nz")


@query(_smooth_cloud_sql(40, 150))
def smooth_cloud_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline as it is meant to run: 40 neighbours, 150 iterations."""
    return rounded(pipeline.smooth_cloud(points(spark, sf_dir), k=40, iterations=150, alpha=ALPHA, exact=False), "x", "y", "z", "nx", "ny", "nz")


@query(taubin_sql(f"""{MESH}, {EXT.replace('pts', 'mpts')}, unit as (select id, {', '.join(f'({c} - lo) / (hi - lo) as {c}' for c in 'xyz')} from mpts, ext),
    near as (select id, nid, d2, row_number() over (partition by id order by d2, nid) as rank from (select d.id, d.nid, {d2('a', 'b')} as d2 from dedge d join unit a on a.id = d.id join unit b on b.id = d.nid)), {egg_sql(1e-8)}""", "unit", "egg", 2).replace(f"select {XYZ} from m1", f"select id, {', '.join(f'round({c} * (hi - lo) + lo, 6) + 0.0 as {c}' for c in 'xyz')} from m1, ext"))
def smooth_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipeline.smooth_mesh(lattice(spark, sf_dir), faces(spark, sf_dir), k=40, iterations=2), *"xyz")


# ---- larger graphs, timed only: no SQL walks them in reasonable time


def _order_edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return materialize(knn.knn_self(order_points(spark, sf_dir), k), "order-edges")


def components_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all orders' three nearest neighbours."""
    return components(_order_edges(spark, sf_dir, 3).select(F.col("id").alias("u"), F.col("nid").alias("v")))


def forest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest of all orders' eight nearest neighbours by distance, in rounds."""
    return graph.spanning_forest(graph.distance_edges(_order_edges(spark, sf_dir, 8)))[0]


def smooth_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten iterations over all orders' eight nearest neighbours, in blocks with halos."""
    p = materialize(cloud.normalise(order_points(spark, sf_dir)), "unit")
    return smoothing.taubin_many(p, _order_edges(spark, sf_dir, 8), 10, most=20_000)


TIMED: dict[str, Query] = {f.__name__: f for f in (components_orders, forest_orders, smooth_orders)}
