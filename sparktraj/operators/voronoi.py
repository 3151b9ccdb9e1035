"""Voronoi cells: what the planes half-way to a particle's neighbours leave of space, and in directions that aren't periodic the box's walls.

A cell is right when no plane of a particle beyond the cutoff can reach it, so when the cutoff is twice the distance of its farthest corner.  Particles
whose cells aren't sure are tried again with a longer cutoff, so results don't depend on it.  Plain cells come from ``polyhedra``, many at a time; those of
power diagrams are clipped from a box one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import POSITION, Dataset, col, on_workers, stage
from sparktraj.operators import polyhedra
from sparktraj.operators.analyze import add_bonds
from sparktraj.operators.neighbors import pairs, within

#: Faces are counted by their number of edges, up to this one; those with more count here.
MOST_EDGES = 12
#: Particles whose neighbourhoods are worked on at a time; a batch from Spark has more.
AT_ONCE = 1024


def _clip(faces: list[tuple[int, np.ndarray]], normal: np.ndarray, limit: float, number: int, eps: float) -> list[tuple[int, np.ndarray]]:
    """The part of a convex body with normal.x <= limit; faces are (neighbour, corners in order)."""
    out, rim = [], []
    for of, p in faces:
        above = p @ normal - limit
        if (above <= eps).all():
            out.append((of, p))
            rim += list(p[np.abs(above) <= eps])
            continue
        kept = []
        for k in range(len(p)):
            a, b, x, y = above[k - 1], above[k], p[k - 1], p[k]
            if (a > eps) != (b > eps) and abs(a) > eps and abs(b) > eps:
                cross = x + (y - x) * (a / (a - b))
                kept.append(cross)
                rim.append(cross)
            if b <= eps:
                kept.append(y)
                if b >= -eps:
                    rim.append(y)
        if len(kept) >= 3:
            out.append((of, np.array(kept)))
    if len(out) == len(faces) and all(a[1] is b[1] for a, b in zip(out, faces)):
        return faces
    points: list[np.ndarray] = []
    for r in rim:
        if all(np.abs(r - q).max() > 10 * eps for q in points):
            points.append(r)
    if len(points) >= 3:
        q = np.array(points)
        u = q[0] - q.mean(axis=0)
        u = u / np.linalg.norm(u)
        v = np.cross(normal / np.linalg.norm(normal), u)
        around = q - q.mean(axis=0)
        out.append((number, q[np.argsort(np.arctan2(around @ v, around @ u))]))
    return out


def cell(vectors: np.ndarray, reach: float, radius: float, others: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], bool]:
    """A power diagram's cell: its faces about the origin, and whether it is closed by neighbours alone."""
    corners = np.array([(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float) * reach
    faces = [(-1, corners[list(f)]) for f in ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))]
    for k, v in enumerate(vectors):
        size = float(np.linalg.norm(v))  # a wall that a particle lies on is next to nothing away
        faces = _clip(faces, v / size, (size**2 + radius**2 - others[k] ** 2) / 2 / size, k, 1e-9 * reach)
    return faces, all(of >= 0 for of, _ in faces)


def _area(p: np.ndarray) -> float:
    return float(np.linalg.norm(np.cross(p[1:-1] - p[0], p[2:] - p[0]).sum(axis=0)) / 2)


def _volume(faces: list[tuple[int, np.ndarray]]) -> float:
    """From a point inside: with radii the origin may lie outside its cell."""
    inside = np.concatenate([p for _, p in faces]).mean(axis=0) if faces else 0.0
    centred = [p - inside for _, p in faces]
    return sum(abs(float(np.einsum("ij,ij->i", np.cross(p[1:-1], p[2:]), np.broadcast_to(p[0], p[1:-1].shape)).sum())) for p in centred) / 6


def _walls(ds: Dataset) -> F.Column:
    """The particle's mirror images at the walls of directions that aren't periodic, as neighbours without number; a flat cell's walls are half a unit away.  Null outside of the walls."""
    s, walls = g.reduced(tuple(F.col(k) for k in "xyz")), []
    a, b, c = g.edges()
    for k, (normal, along, periodic, thick) in enumerate(zip((g.cross(b, c), g.cross(c, a), g.cross(a, b)), (a, b, c), g.periodic(), g.thickness())):
        flat = F.col("is2d") & F.lit(k == 2)
        unit = g.times(normal, F.signum(g.dot(normal, along)) / g.norm(normal))
        for side, part in ((-1.0, s[k]), (1.0, 1 - s[k])):
            away = F.when(flat, 0.5).when(part >= 0, F.greatest(part, F.lit(1e-9)) * thick)
            walls.append(F.when(~periodic, F.struct(F.lit(None).cast("long").alias("j"), *((x * away * (2 * side)).alias(f"d{n}") for n, x in zip("xyz", unit)), *(F.lit(0).alias(f"s{n}") for n in "xyz"), F.col("r"))))
    return F.filter(F.array(*walls), lambda x: x.isNotNull())


def _plain(near: pa.ListArray, idx: np.ndarray, cutoff: float, scale: float, least_area: float, least_edge: float):
    """Of each particle: volume, faces by number of edges, largest number of edges, whether the cell is sure; and the rows of ``near`` behind faces with their particle."""
    n = len(idx)
    vectors, ends = polyhedra.neighbour_vectors(near, idx, scale, by_image=True)
    volume, index, most, sure = np.zeros(n), np.zeros((n, MOST_EDGES + 1), int), np.zeros(n, int), np.zeros(n, bool)
    far, behind, at = np.zeros(n), [], 0
    for cells, planes, points, open_ in polyhedra.corners(vectors, ends):
        sure[at : at + len(open_)] = ~open_
        at += len(open_)
        np.maximum.at(far, cells, np.einsum("nk,nk->n", points, points))
        of, plane, area, away, edges = polyhedra.faces(cells, planes, points, vectors, least_edge)
        np.add.at(volume, of, area * away / 3)
        real = (edges >= 3) & (area > least_area)
        behind.append((of[real], plane[real]))
        np.maximum.at(most, of[real], edges[real])
        np.add.at(index, (of[real], np.minimum(edges[real], MOST_EDGES + 1) - 1), 1)
    return volume, index[:, :MOST_EDGES], most, sure & (4 * far <= cutoff**2), np.concatenate([b[0] for b in behind]), np.concatenate([b[1] for b in behind])


def _power(near: pa.ListArray, own: np.ndarray, largest: float, cutoff: float, reach: float, least_area: float, least_edge: float):
    """The same for a power diagram."""
    n, ends = len(own), near.offsets.to_numpy().astype(int) - near.offsets[0].as_py()
    inner = near.values.slice(near.offsets[0].as_py(), ends[-1])
    xyz, others = np.stack([inner.field(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "dz")], axis=1), inner.field("r").to_numpy(zero_copy_only=False)
    volume, index, most, sure, of_, planes = np.zeros(n), np.zeros((n, MOST_EDGES), int), np.zeros(n, int), np.zeros(n, bool), [], []
    for k, (a, e) in enumerate(zip(ends[:-1], ends[1:])):
        order = a + np.argsort(np.einsum("nk,nk->n", xyz[a:e], xyz[a:e]), kind="stable")
        faces, closed = cell(xyz[order], reach, own[k], others[order])
        far = max((np.einsum("ij,ij->i", p, p).max() for _, p in faces), default=0.0)
        sure[k] = closed and (cutoff**2 + own[k] ** 2 - largest**2) / (2 * cutoff) >= far**0.5
        volume[k] = _volume(faces)
        for of, p in faces:
            edges = int((np.linalg.norm(p - np.roll(p, 1, axis=0), axis=1) > least_edge).sum())
            if of < 0 or edges < 3 or _area(p) <= least_area:
                continue
            of_.append(k)
            planes.append(order[of])
            most[k] = max(most[k], edges)
            if edges <= MOST_EDGES:
                index[k, edges - 1] += 1
    return volume, index, most, sure, np.array(of_, int), np.array(planes, int)


def voronoi(ds: Dataset, cutoff: float, least_area: float = 0.0, least_edge: float = 1e-6, radii: str | None = None, bonds: bool = False) -> Dataset:
    """``Atomic Volume``, ``Coordination`` and ``Voronoi Index.1`` to ``.12`` (faces by number of edges; those of more are in none), ``Max Face Order`` (edges of the
    largest face), and the frame's ``Voronoi.max_face_order``, ``Voronoi.volume_sum`` and ``Voronoi.volume_missing`` (of the box).

    ``cutoff`` is where the search for neighbours starts.  In directions that aren't periodic cells end at the box's walls, which are no faces; a particle
    outside of them has no cell, so volume 0.  Edges up to ``least_edge`` aren't counted, and faces with fewer than three longer ones, or of no more than ``least_area``, are none.
    ``radii`` names a property (null: 0) whose power diagram is taken.  A cell that larger ones swallow has volume 0 and no faces.  ``bonds`` adds a
    half-bond to the particle behind each face.
    """
    names = ["frame", "idx", "Atomic Volume", "Coordination", *(f"Voronoi Index.{k}" for k in range(1, MOST_EDGES + 1)), "Max Face Order"]
    of_size = F.lit(0.0) if radii is None else F.coalesce(col(radii).cast("double"), F.lit(0.0))
    size = ds.particles.select("frame", F.col("idx").alias("j"), of_size.alias("r"))
    largest = size.agg(F.max("r")).first()[0] or 0.0 if radii is not None else 0.0
    fields = ["j", "dx", "dy", "dz", "sx", "sy", "sz", *(["r"] if radii is not None else [])]
    n_faces = "touched array<struct<j: bigint, sx: int, sy: int, sz: int>>"
    schema = "frame int, idx long, `Atomic Volume` double, Coordination int, " + ", ".join(f"`{n}` int" for n in names[4:]) + f", sure boolean, {n_faces}, x double, y double, z double, r double"
    scale = polyhedra.NUDGE * cutoff
    on_workers(ds.spark)

    def run_at(reach: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, len(whole), AT_ONCE)):
                near, idx, inside = b.column("near"), b.column("idx").to_numpy(), b.column("inside").to_numpy(zero_copy_only=False)
                if radii is None:
                    volume, index, most, sure, of, plane = _plain(near, idx, reach, scale, least_area, least_edge)
                else:
                    volume, index, most, sure, of, plane = _power(near, b.column("r").to_numpy(), largest, reach, 4 * reach, least_area, least_edge)
                inner = near.values.slice(near.offsets[0].as_py(), near.offsets[-1].as_py() - near.offsets[0].as_py())
                wall = inner.field("j").is_null().to_numpy(zero_copy_only=False)
                real = ~wall[plane] & inside[of]
                of, plane = of[real], plane[real]
                order = np.lexsort((plane, of))
                count = np.bincount(of, minlength=len(idx))
                index[~inside], most[~inside] = 0, 0
                touched = pa.StructArray.from_arrays([inner.field(c) for c in ("j", "sx", "sy", "sz")], ["j", "sx", "sy", "sz"]).take(pa.array(plane[order]))
                cols = [np.where(inside, volume, 0.0), *(x.astype(np.int32) for x in (count, *index.T, most)), sure | ~inside]
                yield pa.record_batch([b.column("frame"), b.column("idx"), *map(pa.array, cols), pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), touched), *map(b.column, "xyzr")], names=[*names, "sure", "touched", *"xyzr"])

        return run

    def with_walls(d: DataFrame) -> DataFrame:
        """frame, idx, x, y, z, r with the cell's walls, and whether the particle lies inside of them."""
        d = d.join(ds.cells, "frame").withColumn("walls", F.transform(_walls(ds), lambda w: F.struct(*(w[c].alias(c) for c in fields))))
        d = d.withColumn("inside", ~F.exists("walls", lambda w: w["dx"].isNull() | w["dy"].isNull() | w["dz"].isNull()))
        return d.select("frame", "idx", *"xyzr", "inside", F.when(F.col("inside"), F.col("walls")).otherwise(F.slice("walls", 1, 0)).alias("walls"))

    def places(d: DataFrame) -> DataFrame:
        return d.select("frame", "idx", *(F.col(k).alias(c) for c, k in zip(POSITION, "xyz")))

    own = with_walls(ds.particles.select("frame", "idx", *(col(c).cast("double").alias(k) for c, k in zip(POSITION, "xyz")), of_size.alias("r")))
    # What lies outside of the walls cuts no cells either.
    others = ds.having(particles=places(own.where("inside")))
    a, b, c = g.edges()
    widest = ds.cells.agg(F.max(g.norm(a) + g.norm(b) + g.norm(c))).first()[0] or 0.0
    again, reach, parts = None, cutoff, []
    while True:
        around = pairs(others, reach) if again is None else within(others, reach, sources=places(again)).where("i <> j OR sx <> 0 OR sy <> 0 OR sz <> 0")
        around = around if radii is None else around.join(size, ["frame", "j"])
        near = around.groupBy("frame", F.col("i").alias("idx")).agg(F.collect_list(F.struct(*fields)).alias("near"))
        rows = (own if again is None else with_walls(again)).hint("merge").join(near, ["frame", "idx"], "left")
        rows = rows.select("frame", "idx", *"xyzr", "inside", F.when(F.col("near").isNull(), F.col("walls")).otherwise(F.concat("near", "walls")).alias("near"))
        found = stage(rows.mapInArrow(run_at(reach), schema), "voronoi")
        parts.append(found.where("sure"))
        # Places come back from the kernel, so that nothing is joined to find what is unsure.
        again = found.where("NOT sure").select("frame", "idx", *"xyzr")
        if again.isEmpty():
            break
        if reach > 4 * (widest + cutoff):
            raise ValueError("a Voronoi cell doesn't close")
        reach = 1.5 * reach
    found = functools.reduce(lambda a, b: a.unionByName(b), parts)
    if bonds:
        ds = add_bonds(ds, found.select("frame", F.col("idx").alias("i"), F.explode("touched").alias("t")).select("frame", "i", "t.j", "t.sx", "t.sy", "t.sz"))
    out = ds.having(particles=ds.particles.drop(*names[2:]).join(found.drop("touched", "sure", *"xyzr").hint("merge"), ["frame", "idx"], "left"))
    sums = found.groupBy("frame").agg(F.max("Max Face Order").cast("double").alias("most"), F.sum(col("Atomic Volume")).alias("sum"))
    sums = ds.cells.join(sums, "frame").withColumn("missing", g.volume() - F.col("sum"))
    facts = F.map_from_arrays(F.array(*map(F.lit, ("Voronoi.max_face_order", "Voronoi.volume_sum", "Voronoi.volume_missing"))), F.array("most", "sum", "missing"))
    return out.with_attributes(sums.select("frame", F.explode(facts).alias("key", "num")))
