"""Triangle meshes as tables: vertices (frame, v, x, y, z) and faces (frame, f, v1, v2, v3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import number, stage


#: Offsets of a face's second and third corner, in meshes that go over periodic borders.
_OFFSETS = [f"o{k}{c}" for k in (2, 3) for c in "xyz"]


def _offset(faces: DataFrame, k: int) -> list[F.Column]:
    return [F.col(f"o{k}{c}") if k > 1 and _OFFSETS[0] in faces.columns else F.lit(0.0) for c in "xyz"]


def edges(faces: DataFrame) -> DataFrame:
    """Each edge of the mesh in both directions, once: frame, v, w, and the offset of w (gx, gy, gz), which is 0 where no periodic border is crossed."""
    both = []
    for a, b in ((1, 2), (2, 3), (3, 1)):
        for p, q in ((a, b), (b, a)):
            # Rounded, so that the offset is the same from both faces of an edge.
            apart = [F.round(y - x, 9) + 0.0 for x, y in zip(_offset(faces, p), _offset(faces, q))]
            both.append(F.struct(F.col(f"v{p}").alias("v"), F.col(f"v{q}").alias("w"), *(x.alias(f"g{c}") for x, c in zip(apart, "xyz"))))
    return faces.select("frame", F.explode(F.array(*both)).alias("e")).select("frame", "e.*").distinct()


def smooth(vertices: DataFrame, faces: DataFrame, passes: int = 8, pass_band: float = 0.1, strength: float = 0.5) -> DataFrame:
    """Each pass moves vertices towards the mean of their neighbours by ``strength``, and then back by the factor that keeps the volume for a pass band."""
    back = 1 / (pass_band - 1 / strength)
    e = stage(edges(faces), "edges")
    for k in range(passes):
        for factor in (strength, back):
            near = e.join(vertices.withColumnRenamed("v", "w"), ["frame", "w"]).groupBy("frame", "v").agg(*(F.avg(F.col(c) + F.col(f"g{c}")).alias(f"m{c}") for c in "xyz"))
            vertices = vertices.join(near, ["frame", "v"], "left").select("frame", "v", *((F.col(c) + factor * F.coalesce(F.col(f"m{c}") - F.col(c), F.lit(0.0))).alias(c) for c in "xyz"))
        if k % 4 == 3:
            vertices = stage(vertices, "vertices")
    return vertices


def _corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    d = faces
    for k in (1, 2, 3):
        d = d.join(vertices.select("frame", F.col("v").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")), ["frame", f"v{k}"])
    return d.withColumns({f"{c}{k}": F.col(f"{c}{k}") + x for k in (2, 3) for c, x in zip("xyz", _offset(faces, k))})


def area_and_volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """frame, area and the volume inside a closed mesh whose faces turn the same way (of meshes that go over periodic borders only the area means something)."""
    p = [tuple(F.col(f"{c}{k}") for c in "xyz") for k in (1, 2, 3)]
    normal = g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))
    d = _corners(vertices, faces)
    return d.groupBy("frame").agg((F.sum(g.norm(normal)) / 2).alias("area"), F.abs(F.sum(g.dot(p[0], g.cross(p[1], p[2]))) / 6).alias("volume"))


def slice_mesh(vertices: DataFrame, faces: DataFrame, normal: tuple[float, float, float], distance: float) -> DataFrame:
    """The faces that lie wholly on the inner side of a plane."""
    size = math.sqrt(sum(x * x for x in normal))
    inner = vertices.where((F.col("x") * (normal[0] / size) + F.col("y") * (normal[1] / size) + F.col("z") * (normal[2] / size)) <= distance).select("frame", "v")
    d = faces
    for k in (1, 2, 3):
        d = d.join(inner.withColumnRenamed("v", f"v{k}"), ["frame", f"v{k}"], "left_semi")
    return d


def cut_mesh(vertices: DataFrame, faces: DataFrame, normal: tuple[float, float, float], distance: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces on the inner side of a plane; what crosses it is cut and left open there.

    Each crossed edge gets one vertex, numbered behind the frame's others, which both of its faces share.  Faces keep their turn; of one
    that is cut into two the second is numbered behind the frame's others.  Vertices on the plane are inner ones, and faces that only touch it go.
    """
    size = math.sqrt(sum(x * x for x in normal))
    above = F.col("x") * (normal[0] / size) + F.col("y") * (normal[1] / size) + F.col("z") * (normal[2] / size) - distance
    points = vertices.select("frame", "v", "x", "y", "z", above.alias("s"))
    d = faces.select("frame", "f", "v1", "v2", "v3")
    for k in (1, 2, 3):
        d = d.join(points.select("frame", F.col("v").alias(f"v{k}"), F.col("s").alias(f"s{k}")), ["frame", f"v{k}"])
    d = d.withColumn("inner", sum((F.col(f"s{k}") <= 0).cast("int") for k in (1, 2, 3))).where("inner > 0")
    # A face is turned until the corner that is alone on its side comes first.
    lone = F.when(F.col("inner") == 3, 0).when((F.col("s1") <= 0) == (F.col("inner") == 1), 0).when((F.col("s2") <= 0) == (F.col("inner") == 1), 1).otherwise(2)
    corners = [F.struct(F.col(f"v{k}").alias("v"), F.col(f"s{k}").alias("s")) for k in (1, 2, 3)]
    turned = F.array(*corners, *corners)
    d = d.withColumns({"_lone": lone, "_all": turned}).select("frame", "f", "inner", *(F.element_at("_all", F.col("_lone") + k).alias(c) for k, c in zip((1, 2, 3), "pqr")))

    def at(c: str):
        return F.struct(F.col(f"{c}.v").alias("lo"), F.col(f"{c}.v").alias("hi"))

    def between(a: str, b: str):
        least, most = F.least(f"{a}.v", f"{b}.v").alias("lo"), F.greatest(f"{a}.v", f"{b}.v").alias("hi")
        return F.when(F.col(f"{a}.s") == 0, at(a)).when(F.col(f"{b}.s") == 0, at(b)).otherwise(F.struct(least, most))

    def triangle(*corner):
        return F.struct(*(c.alias(f"c{k}") for k, c in zip((1, 2, 3), corner)))

    whole, tip = F.array(triangle(*map(at, "pqr"))), F.array(triangle(at("p"), between("p", "q"), between("p", "r")))
    rest = F.array(triangle(between("p", "q"), at("q"), at("r")), triangle(between("p", "q"), at("r"), between("r", "p")))
    d = d.select("frame", "f", F.posexplode(F.when(F.col("inner") == 3, whole).when(F.col("inner") == 1, tip).otherwise(rest)).alias("part", "t")).select("frame", "f", "part", "t.*")
    d = stage(d.where("c1 <> c2 AND c2 <> c3 AND c3 <> c1"), "cut")
    used = d.select("frame", F.explode(F.array("c1", "c2", "c3")).alias("c")).select("frame", "c.lo", "c.hi").distinct()
    last = vertices.groupBy("frame").agg(F.max("v").alias("_v"))
    added = number(used.where("lo <> hi"), ["lo", "hi"], "_n").join(last, "frame").select("frame", "lo", "hi", (F.col("_v") + F.col("_n") + 1).alias("v"))
    names = used.where("lo = hi").select("frame", "lo", "hi", F.col("lo").cast("long").alias("v")).unionByName(added)
    ends = added
    for end, mark in (("lo", "a"), ("hi", "b")):
        ends = ends.join(points.select("frame", F.col("v").alias(end), *(F.col(c).alias(f"{mark}{c}") for c in "xyzs")), ["frame", end])
    part = F.col("as") / (F.col("as") - F.col("bs"))
    new = ends.select("frame", "v", *((F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * part).alias(c) for c in "xyz"))
    old = vertices.select("frame", F.col("v").cast("long").alias("v"), "x", "y", "z").join(names.where("lo = hi").select("frame", "v"), ["frame", "v"], "left_semi")
    for k in (1, 2, 3):
        d = d.withColumns({"lo": F.col(f"c{k}.lo"), "hi": F.col(f"c{k}.hi")}).join(names.withColumnRenamed("v", f"v{k}"), ["frame", "lo", "hi"]).drop("lo", "hi")
    behind = faces.groupBy("frame").agg(F.max("f").alias("_f"))
    d = d.join(behind, "frame").select("frame", F.when(F.col("part") == 0, F.col("f")).otherwise(F.col("f") + F.col("_f") + 1).alias("f"), "v1", "v2", "v3")
    return old.unionByName(new), d
