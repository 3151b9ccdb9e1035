import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, col
from sparktraj.operators import analyze, modify
from sparktraj.operators.voronoi import cell, voronoi
from sparktraj.sources.readers import parse_binary_dump
from tests.test_core import FCC, crystal, frame


def test_voronoi_of_a_crystal(spark):
    out = voronoi(crystal(spark, FCC, 3, 4.0), 4.5)
    r = out.particles.agg(F.min(col("Atomic Volume")).alias("a"), F.max(col("Atomic Volume")).alias("b"), F.min("Coordination").alias("c"), F.min(col("Voronoi Index.4")).alias("i")).first()
    assert (r.a, r.b) == pytest.approx((16, 16)) and (r.c, r.i) == (12, 12)
    facts = {r.key: r.num for r in out.attributes.collect()}
    assert facts["Voronoi.max_face_order"] == 4 and facts["Voronoi.volume_sum"] == pytest.approx(12**3) and facts["Voronoi.volume_missing"] == pytest.approx(0, abs=1e-6)


def test_voronoi_fills_the_box(spark):
    rng = np.random.default_rng(1)
    ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(rng.random((60, 3)) * 10)])
    assert voronoi(ds, 9.0).particles.agg(F.sum(col("Atomic Volume"))).first()[0] == pytest.approx(1000)


@pytest.mark.parametrize("cutoff", [1.0, 3.2])
def test_voronoi_at_any_cutoff(spark, cutoff):
    rng = np.random.default_rng(5)
    ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(rng.random((300, 3)) * 10)])
    facts = {r.key: r.num for r in voronoi(ds, cutoff).attributes.collect()}
    assert facts["Voronoi.volume_sum"] == pytest.approx(1000) and facts["Voronoi.volume_missing"] == pytest.approx(0, abs=1e-6)


def test_voronoi_between_walls(spark):
    rng = np.random.default_rng(6)
    points = [*rng.random((50, 3)) * (10, 10, 4), (3.0, 3.0, 0.0), (5.0, 5.0, 12.0)]
    ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(points)], pbc=(True, False, False))
    out = voronoi(ds, 8.0).particles
    assert out.agg(F.sum(col("Atomic Volume"))).first()[0] == pytest.approx(1000)
    assert tuple(out.where("idx = 51").select(col("Atomic Volume"), "Coordination").first()) == (0.0, 0)
    # A single particle is its own neighbour on all sides, and a flat cell has its area.
    assert voronoi(frame(spark, [(0, 0, 1.0, 2.0, 3.0)]), 3.0).particles.first()["Atomic Volume"] == pytest.approx(1000)
    flat = frame(spark, [(0, k, *map(float, p), 0.0) for k, p in enumerate(rng.random((30, 2)) * 10)])
    flat = flat.having(cells=flat.cells.withColumns({"is2d": F.lit(True), "pz": F.lit(False)}))
    assert voronoi(flat, 3.0).particles.agg(F.sum(col("Atomic Volume"))).first()[0] == pytest.approx(100)


def test_voronoi_face_of_fourteen_edges(spark):
    # A ring of fourteen about the first particle, and the face to the one above it.
    ring = lambda n, r, z: [(5 + r * np.cos(2 * np.pi * k / n), 5 + r * np.sin(2 * np.pi * k / n), z) for k in range(n)]
    points = [(5.0, 5.0, 4.0), (5.0, 5.0, 6.0), *ring(14, 1.0, 4.0), *ring(7, 1.3, 6.0), *((x, y, z) for x in (1.0, 5.0, 9.0) for y in (1.0, 5.0, 9.0) for z in (1.0, 9.0))]
    out = voronoi(frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(points)]), 9.0)
    r = out.particles.where("idx = 0").first()
    assert r["Max Face Order"] == out.attributes.where("key = 'Voronoi.max_face_order'").first().num == 14 and r["Coordination"] - sum(r[f"Voronoi Index.{k}"] for k in range(1, 13)) in (1, 2)
    assert out.particles.agg(F.sum(col("Atomic Volume"))).first()[0] == pytest.approx(1000)


def test_voronoi_bonds_and_radii(spark):
    rng = np.random.default_rng(2)
    ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(rng.random((40, 3)) * 10)])
    ds = ds.having(particles=ds.particles.withColumn("Radius", F.when(F.col("idx") % 2 == 0, 1.5).otherwise(F.lit(None).cast("double"))))
    plain = voronoi(ds, 9.5, bonds=True)
    ends = {(r.i, r.j, r.sx, r.sy, r.sz) for r in plain.bonds.collect()}
    assert {(j, i, -x, -y, -z) for i, j, x, y, z in ends} == ends and len(ends) == plain.particles.agg(F.sum("Coordination")).first()[0]
    by_radii = voronoi(ds, 9.5, radii="Radius").particles
    assert by_radii.agg(F.sum(col("Atomic Volume"))).first()[0] == pytest.approx(1000)
    even = lambda d: d.where("idx % 2 = 0").agg(F.sum(col("Atomic Volume"))).first()[0]
    assert even(by_radii) > even(plain.particles)


def test_power_diagram_moves_planes():
    faces, closed = cell(np.array([[2.0, 0, 0], [-2.0, 0, 0], [0, 2.0, 0], [0, -2.0, 0], [0, 0, 2.0], [0, 0, -2.0]]), 10.0, 1.0, np.array([0.0, 1.0, 1.0, 1.0, 1.0, 1.0]))
    assert closed and max(p[:, 0].max() for _, p in faces) == pytest.approx(1.25)


def test_rotation_and_stretch(spark):
    fcc = crystal(spark, FCC, 3, 4.0)
    c, s = np.cos(0.2), np.sin(0.2)
    turned = modify.affine_transform(fcc, ((1.1 * c, -s, 0.0, 0.0), (1.1 * s, c, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)), cell=True)
    both = Dataset(fcc.particles.unionByName(turned.particles.withColumn("frame", F.lit(1))), fcc.cells.unionByName(turned.cells.withColumn("frame", F.lit(1))))
    r = analyze.polar_decomposition(analyze.atomic_strain(both, 3.0)).particles.where("frame = 1").first()
    assert (r["Rotation.Z"], r["Rotation.W"], r["Stretch Tensor.XX"], r["Stretch Tensor.YY"]) == pytest.approx((np.sin(0.1), np.cos(0.1), 1.1, 1.0))


@pytest.mark.parametrize(("order", "wide"), [("<", "q"), (">", "q"), ("<", "i")])
def test_binary_dump(order, wide):
    values = np.arange(8.0).reshape(2, 4)
    one = b"".join([struct.pack(f"{order}{wide}{wide}i", 100, 2, 0), struct.pack(f"{order}6i", 0, 0, 1, 1, 0, 0), struct.pack(f"{order}6d", 0, 10, 0, 10, 0, 10), struct.pack(f"{order}ii", 4, 1), struct.pack(f"{order}i", 8), values.astype(f"{order}f8").tobytes()])
    frames = list(parse_binary_dump(one * 2, ["Particle Identifier", *POSITION]))
    assert len(frames) == 2 and frames[1].columns["Position.Z"].tolist() == [3.0, 7.0] and frames[0].cell[12:15] == (True, False, True) and frames[0].attributes == {"Timestep": 100.0}
    with pytest.raises(ValueError):
        list(parse_binary_dump(one, []))
