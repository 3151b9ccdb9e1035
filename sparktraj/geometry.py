"""Geometry of simulation cells as column expressions.  The cell's columns (see ``dataset.CELL``) must stand in the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def _vector(name: str) -> Vector:
    return tuple(F.col(f"{name}{k}") for k in "xyz")  # type: ignore[return-value]


def edges() -> tuple[Vector, Vector, Vector]:
    return _vector("a"), _vector("b"), _vector("c")


def origin() -> Vector:
    return _vector("o")


def periodic() -> Vector:
    return F.col("px"), F.col("py"), F.col("pz") & ~F.col("is2d")


def cross(u: Vector, v: Vector) -> Vector:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def dot(u: Vector, v: Vector) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def norm(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def plus(u: Vector, v: Vector) -> Vector:
    return u[0] + v[0], u[1] + v[1], u[2] + v[2]


def minus(u: Vector, v: Vector) -> Vector:
    return u[0] - v[0], u[1] - v[1], u[2] - v[2]


def times(u: Vector, k: Column | float) -> Vector:
    return u[0] * k, u[1] * k, u[2] * k


def determinant() -> Column:
    a, b, c = edges()
    return dot(a, cross(b, c))


def volume() -> Column:
    """Of a three-dimensional cell; the area of a two-dimensional one."""
    a, b, _ = edges()
    return F.when(F.col("is2d"), norm(cross(a, b))).otherwise(F.abs(determinant()))


def reduced_vector(v: Vector) -> Vector:
    """The vector in units of the cell's edges.  In a two-dimensional cell only x and y are turned and z stays."""
    a, b, c = edges()
    det, flat = determinant(), a[0] * b[1] - a[1] * b[0]
    solid = tuple(dot(v, n) / det for n in (cross(b, c), cross(c, a), cross(a, b)))
    plane = ((v[0] * b[1] - v[1] * b[0]) / flat, (v[1] * a[0] - v[0] * a[1]) / flat, v[2])
    return tuple(F.when(F.col("is2d"), p).otherwise(s) for p, s in zip(plane, solid))  # type: ignore[return-value]


def prepared(cells: DataFrame) -> DataFrame:
    """Cells with what ``reduced_here`` needs of them, so that it isn't worked out for every particle."""
    a, b, c = edges()
    normals = {f"_n{k}{x}": v for k, n in zip("abc", (cross(b, c), cross(c, a), cross(a, b))) for x, v in zip("xyz", n)}
    return cells.withColumns(normals | {"_det": determinant(), "_flat": a[0] * b[1] - a[1] * b[0]})


def reduced_here(p: Vector) -> Vector:
    """As ``reduced``, to the last digit, beside cells that are ``prepared``."""
    a, b, _ = edges()
    v = minus(p, origin())
    solid = tuple(dot(v, tuple(F.col(f"_n{k}{x}") for x in "xyz")) / F.col("_det") for k in "abc")  # type: ignore[arg-type]
    plane = ((v[0] * b[1] - v[1] * b[0]) / F.col("_flat"), (v[1] * a[0] - v[0] * a[1]) / F.col("_flat"), v[2])
    return tuple(F.when(F.col("is2d"), p).otherwise(s) for p, s in zip(plane, solid))  # type: ignore[return-value]


def reduced(p: Vector) -> Vector:
    """The point in units of the cell's edges, from the origin."""
    return reduced_vector(minus(p, origin()))


def absolute_vector(s: Vector) -> Vector:
    a, b, c = edges()
    return plus(plus(times(a, s[0]), times(b, s[1])), times(c, s[2]))


def absolute(s: Vector) -> Vector:
    return plus(absolute_vector(s), origin())


def images(s: Vector) -> Vector:
    """How many cells a reduced point lies outside, by periodic dimension; 0 in the others."""
    return tuple(F.when(p, F.floor(x)).otherwise(F.lit(0)).cast("int") for p, x in zip(periodic(), s))  # type: ignore[return-value]


def wrapped(p: Vector) -> Vector:
    return minus(p, absolute_vector(images(reduced(p))))


def nearest_image(v: Vector) -> Vector:
    """The vector less whole periods, its reduced components in [-0.5, 0.5)."""
    s = reduced_vector(v)
    return minus(v, absolute_vector(images(tuple(x + 0.5 for x in s))))  # type: ignore[arg-type]


def thickness() -> Vector:
    """Distances of the cell's opposite faces."""
    a, b, c = edges()
    det = F.abs(determinant())
    flat = F.abs(a[0] * b[1] - a[1] * b[0])
    x = F.when(F.col("is2d"), flat / norm((b[0], b[1], F.lit(0.0)))).otherwise(det / norm(cross(b, c)))
    y = F.when(F.col("is2d"), flat / norm((a[0], a[1], F.lit(0.0)))).otherwise(det / norm(cross(c, a)))
    return x, y, det / norm(cross(a, b))
