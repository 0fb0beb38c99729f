"""Unit cells, plane projections and pixel grids as column expressions.

An orientation matrix is given as nine columns, row by row; its columns are the
reciprocal axes times the wavelength.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of the orientation matrix that span each plane type.
PLANES = {"HK": (0, 1), "HL": (0, 2), "KL": (1, 2)}


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def axis_vector(ub: Sequence[Column], i: int, wavelength: Column) -> list[Column]:
    return [ub[3 * r + i] / wavelength for r in range(3)]


def cell_from_ub(ub: Sequence[Column], wavelength: Column) -> dict[str, Column]:
    """Cell lengths and angles (degrees) from the orientation matrix.

    Direct axes are cross products of the reciprocal ones over their volume.
    """
    r = [axis_vector(ub, i, wavelength) for i in range(3)]
    volume = dot(r[0], cross(r[1], r[2]))
    real = [[x / volume for x in cross(r[(i + 1) % 3], r[(i + 2) % 3])] for i in range(3)]
    size = [F.sqrt(dot(v, v)) for v in real]

    def angle(i: int, j: int) -> Column:
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(real[i], real[j]) / (size[i] * size[j])))))

    return {"a": size[0], "b": size[1], "c": size[2], "alpha": angle(1, 2), "beta": angle(0, 2), "gamma": angle(0, 1)}


def plane_inverse(ub: Sequence[Column], wavelength: Column, plane: str) -> dict[str, Column]:
    """The 2x2 map from Cartesian plane coordinates to Miller indices (upper triangular)."""
    i, j = PLANES[plane]
    u, v = axis_vector(ub, i, wavelength), axis_vector(ub, j, wavelength)
    m11 = F.sqrt(dot(u, u))
    m12 = dot(u, v) / m11
    m22 = F.sqrt(dot(v, v) - m12 * m12)
    return {"i00": 1 / m11, "i01": -m12 / (m11 * m22), "i10": F.lit(0.0), "i11": 1 / m22}


def pixel_scale(d_min: Column, nx: Column) -> Column:
    """Reciprocal length of a pixel."""
    return 2 / (d_min * nx)


def centre(n: Column) -> Column:
    """The 1-based pixel coordinate of the origin."""
    return F.floor((n + 1) / 2) + 0.5


def pixel_indices(inv: dict[str, Column], scale: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Miller indices at pixel offsets (x, y) from the centre."""
    return scale * (inv["i00"] * x + inv["i01"] * y), scale * (inv["i10"] * x + inv["i11"] * y)


def axis_value(inv_diagonal: Column, scale: Column, i: Column, n: Column) -> Column:
    """The diagonal-only axis value of the 1-based pixel ``i``."""
    return inv_diagonal * (i - centre(n)) * scale


def to_cartesian(inv: dict[str, Column], i1: Column, i2: Column) -> tuple[Column, Column]:
    """Plane coordinates of Miller indices: the inverse of ``inv`` applied."""
    det = inv["i00"] * inv["i11"] - inv["i01"] * inv["i10"]
    return (inv["i11"] * i1 - inv["i01"] * i2) / det, (inv["i00"] * i2 - inv["i10"] * i1) / det


def to_miller(inv: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return inv["i00"] * x + inv["i01"] * y, inv["i10"] * x + inv["i11"] * y


def extent(n: Column, scale: Column) -> tuple[Column, Column]:
    """Plane coordinates of the outer pixel edges."""
    return (F.lit(0.5) - centre(n)) * scale, (n + 0.5 - centre(n)) * scale


def corner_range(inv: dict[str, Column], r1: Column, r2: Column) -> tuple[Column, Column, Column, Column]:
    """x and y limits of the plane region with index limits +-r1 and +-r2."""
    corners = [to_cartesian(inv, a * r1, b * r2) for a in (-1, 1) for b in (-1, 1)]
    xs, ys = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def integer_ticks(low: Column, high: Column) -> Column:
    """The integers from ``low`` to ``high`` as an array (empty if there is none)."""
    a, b = F.ceil(low), F.floor(high)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def floor_mean(total: Column, n: Column | int) -> Column:
    """floor(total / n) in exact integers, also for negative totals."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", total - F.pmod(total, n), n)


def log_norm(v: Column, low: Column, high: Column) -> Column:
    """Logarithmic display value; limits as a viewer would mend them."""
    hi = F.when(high <= low, low + 1).otherwise(high)
    lo = F.greatest(low, F.lit(0.1))
    return F.when(v > 0, F.ln(v / lo) / F.ln(hi / lo))
