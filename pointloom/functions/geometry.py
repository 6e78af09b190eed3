"""Geometry as Column expressions: everything here stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    """Three columns by name: vec('n') is nx, ny, nz."""
    return tuple(F.col(prefix + a) for a in names)


def normalised(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo), one extent for all axes."""
    return (v - lo) / (hi - lo)


def denormalised(v: Column, lo: Column, hi: Column) -> Column:
    return v * (hi - lo) + lo


def cell_coordinate(v: Column, lo: Column | float, hi: Column | float, b: Column | int) -> Column:
    """Cell of a coordinate among b cells between lo and hi, truncated toward zero and held inside the grid.

    However far outside, a coordinate has the nearest cell; NaN and infinity have the last one, as Spark orders them.
    """
    lo, hi, b = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi, b))
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least((b - 1).cast("double"), (v - lo) / (hi - lo) * b)).cast("int"))


def linear_cell(cx: Column, cy: Column, cz: Column, b: int) -> Column:
    return cx.cast("long") + cy.cast("long") * b + cz.cast("long") * (b * b)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def squared_distance(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def unit(a: Vec) -> Vec:
    """a over its length; null for the zero vector."""
    length = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return tuple(c / length for c in a)


def perpendicular(a: Vec) -> Vec:
    """A unit vector at right angles to a: the component with the largest absolute value balances the other two."""
    ax, ay, az = (F.abs(c) for c in a)
    one = F.lit(1.0)
    on_x, on_y = (ax >= ay) & (ax >= az), (ay >= ax) & (ay >= az)
    safe = lambda c: F.nullif(c, F.lit(0.0))
    return unit(
        (
            F.when(on_x, -(a[1] + a[2]) / safe(a[0])).otherwise(one),
            F.when(~on_x & on_y, -(a[0] + a[2]) / safe(a[1])).otherwise(one),
            F.when(~on_x & ~on_y, -(a[0] + a[1]) / safe(a[2])).otherwise(one),
        )
    )


def frame(axis: Vec) -> tuple[Vec, Vec, Vec]:
    """An orthonormal frame whose first row is the direction of axis."""
    first = unit(axis)
    second = perpendicular(first)
    return first, second, cross(first, second)


def to_frame(rows: tuple[Vec, Vec, Vec], origin: Vec, p: Vec) -> Vec:
    """p in the frame's coordinates around origin."""
    d = sub(p, origin)
    return tuple(dot(r, d) for r in rows)


def in_ellipsoid(p: Vec, c: Vec, q: Vec, alpha: float) -> Column:
    """Whether q lies strictly inside the spheroid around the segment pc whose other half axes are alpha times its own.

    With t the coordinate along the segment from its middle, X^2 + (Y^2 + Z^2) / alpha^2 < (L/2)^2 needs no rotation:
    t^2 (1 - 1/alpha^2) + |q - m|^2 / alpha^2 < L^2 / 4.
    """
    inv = 1.0 / (alpha * alpha)
    axis = sub(c, p)
    length2 = dot(axis, axis)
    off = sub(q, tuple((a + b) / 2 for a, b in zip(p, c, strict=True)))
    along = dot(off, axis)
    return along * along / F.nullif(length2, F.lit(0.0)) * (1 - inv) + dot(off, off) * inv < length2 / 4


def smoothing_weight(d2: Column, scale: float, regularised: bool = False) -> Column:
    """exp(-d2); regularised: 1 / (d2 + 1e-8) where scale is negative, else 1."""
    if not regularised:
        return F.exp(-d2)
    return 1 / (d2 + 1e-8) if scale < 0 else F.lit(1.0)


def mst_weight(a: Vec, b: Vec) -> Column:
    """max(0, 1 - |a.b|), to 12 decimals so that every engine orders near ties alike."""
    return F.round(F.greatest(F.lit(0.0), 1 - F.abs(dot(a, b))), 12)


def in_bounds(c: Column, lo: int, hi: Column | int) -> Column:
    return (c >= lo) & (c < hi)


def partition_of(pos: Column, n: Column | int, parts: int) -> Column:
    """The contiguous part of a position; the last takes the remainder."""
    size = F.greatest(F.lit(1), F.floor((n if isinstance(n, Column) else F.lit(n)) / F.lit(parts)))
    return F.least(F.lit(parts - 1), F.floor(pos / size)).cast("long")


#: The terms of a symmetric 3x3 matrix, row by row.
TERMS = ("xx", "xy", "xz", "yy", "yz", "zz")


def with_eigenvalues(rows: DataFrame) -> DataFrame:
    """rows (with columns TERMS) and e0 <= e1 <= e2, the matrix's eigenvalues by the trigonometric form.

    In steps: what later steps use more than once stays a column, so no expression is spelled out again and again.
    """
    c = F.col
    out = rows.withColumn("q", (c("xx") + c("yy") + c("zz")) / 3)
    out = out.withColumns({"a": c("xx") - c("q"), "b": c("yy") - c("q"), "c": c("zz") - c("q")})
    squares = c("a") * c("a") + c("b") * c("b") + c("c") * c("c") + 2 * (c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz"))
    det = c("a") * (c("b") * c("c") - c("yz") * c("yz")) - c("xy") * (c("xy") * c("c") - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - c("b") * c("xz"))
    out = out.withColumns({"p": F.sqrt(squares / 6), "det": det})
    r = F.coalesce(c("det") / F.nullif(2 * c("p") * c("p") * c("p"), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3)
    third = 2 * 3.141592653589793 / 3
    out = out.withColumns({"e2": c("q") + 2 * c("p") * F.cos(c("phi")), "e0": c("q") + 2 * c("p") * F.cos(c("phi") + third)})
    return out.withColumn("e1", 3 * c("q") - c("e2") - c("e0")).select(*rows.columns, "e0", "e1", "e2")


def with_smallest_vector(rows: DataFrame) -> DataFrame:
    """rows (with columns TERMS and e0) and nx, ny, nz, the unit eigenvector of e0 with its largest component positive.

    It is the longest cross product of two rows of A - e0 I. Nearly isotropic matrices lose accuracy in it;
    normals.pca_normals(exact=True) has an iterative solver for those.
    """
    c = F.col
    m = rows.withColumns({"d0": c("xx") - c("e0"), "d1": c("yy") - c("e0"), "d2_": c("zz") - c("e0")})
    lines = ((c("d0"), c("xy"), c("xz")), (c("xy"), c("d1"), c("yz")), (c("xz"), c("yz"), c("d2_")))
    m = m.withColumns({f"k{n}{a}": v for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))) for a, v in zip("xyz", cross(lines[i], lines[j]), strict=True)})
    m = m.withColumns({f"l{n}": dot(vec(f"k{n}"), vec(f"k{n}")) for n in range(3)})
    pick = lambda a: F.when((c("l0") >= c("l1")) & (c("l0") >= c("l2")), c(f"k0{a}")).when(c("l1") >= c("l2"), c(f"k1{a}")).otherwise(c(f"k2{a}"))
    m = m.withColumns({f"v{a}": pick(a) for a in "xyz"})
    m = m.withColumns({f"w{a}": v for a, v in zip("xyz", unit(vec("v")), strict=True)})
    return m.withColumns({f"n{a}": v for a, v in zip("xyz", largest_positive(vec("w")), strict=True)}).select(*rows.columns, "nx", "ny", "nz")


def largest_positive(a: Vec) -> Vec:
    """a or -a, so that its component with the largest absolute value (the first of equals) is positive."""
    ax, ay, az = (F.abs(c) for c in a)
    lead = F.when((ax >= ay) & (ax >= az), a[0]).when(ay >= az, a[1]).otherwise(a[2])
    s = F.when(lead < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(c * s for c in a)
