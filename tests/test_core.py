"""Operators on frames whose results are known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, box, cells_of, col
from sparktraj.functions.expressions import compiled
from sparktraj.operators import analyze, modify, select, structure
from sparktraj.operators.neighbors import knn, pairs



def frame(spark, rows, size=(10, 10, 10), pbc=(True, True, True), extra=()):
    schema = "frame int, idx long, " + ", ".join([*(f"`{c}` double" for c in POSITION), *extra])
    frames = sorted({r[0] for r in rows}) or [0]
    return Dataset(spark.createDataFrame(rows, schema), cells_of(spark, [box(f, size, pbc=pbc) for f in frames]))


def crystal(spark, basis, n, edge):
    rows = [(x + a, y + b, z + c) for x in range(n) for y in range(n) for z in range(n) for a, b, c in basis]
    return frame(spark, [(0, k, *(float(v) * edge for v in r)) for k, r in enumerate(rows)], (n * edge,) * 3)


FCC = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]


def test_pairs_over_the_border(spark):
    got = sorted((r.i, r.j, r.sx, round(r.d2, 9)) for r in pairs(frame(spark, [(0, 0, 0.5, 5.0, 5.0), (0, 1, 9.5, 5.0, 5.0)]), 1.0).collect())
    assert got == [(0, 1, -1, 1.0), (1, 0, 1, 1.0)]
    assert pairs(frame(spark, [(0, 0, 0.5, 5.0, 5.0), (0, 1, 9.5, 5.0, 5.0)], pbc=(False,) * 3), 1.0).count() == 0


def test_pairs_with_own_images(spark):
    assert pairs(frame(spark, [(0, 0, 0.2, 0.3, 0.4)], (1, 1, 1)), 1.0).count() == 6
    assert pairs(frame(spark, [(0, 0, 0.2, 0.3, 0.4)], (1, 1, 1)), 2.0).count() == 32


def test_shift_holds_for_positions_outside_the_cell(spark):
    ds = frame(spark, [(0, 0, 10.5, 5.0, 5.0), (0, 1, -0.5, 5.0, 5.0)])
    r = pairs(ds, 1.5).where("i = 0").first()
    assert (round(r.dx, 9), r.sx) == (-1.0, 1)


def test_coincident_particles(spark):
    ds = frame(spark, [(0, 0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0), (0, 2, 2.0, 1.0, 1.0)])
    assert pairs(ds, 0.5).count() == 2
    assert {(r.i, r.j) for r in knn(ds, 1).collect()} == {(0, 2), (1, 2), (2, 0)}


def test_bad_cutoff_and_cell(spark):
    with pytest.raises(ValueError):
        pairs(frame(spark, [(0, 0, 1.0, 1.0, 1.0)]), 0)
    with pytest.raises(Exception, match="degenerate"):
        pairs(frame(spark, [(0, 0, 1.0, 1.0, 1.0)], (10, 0, 10)), 1.0).collect()


def test_empty_frame(spark):
    ds = frame(spark, [])
    assert pairs(ds, 1.0).count() == 0 and knn(ds, 3).count() == 0
    assert analyze.coordination(ds, 1.0).particles.count() == 0
    assert analyze.cluster(ds, 1.0).particles.count() == 0


def test_perfect_crystals(spark):
    fcc = crystal(spark, FCC, 3, 4.0)
    for ds in (structure.common_neighbor_analysis(fcc), structure.common_neighbor_analysis(fcc, 3.4), structure.bond_angle_analysis(fcc)):
        assert {r[0] for r in ds.particles.select(col("Structure Type")).distinct().collect()} == {1}
    assert structure.centrosymmetry(fcc).particles.agg(F.max("Centrosymmetry")).first()[0] < 1e-9
    bcc = crystal(spark, [(0, 0, 0), (0.5, 0.5, 0.5)], 4, 3.0)
    for ds in (structure.common_neighbor_analysis(bcc), structure.bond_angle_analysis(bcc)):
        assert {r[0] for r in ds.particles.select(col("Structure Type")).distinct().collect()} == {3}
    diamond = crystal(spark, [*FCC, *((a + 0.25, b + 0.25, c + 0.25) for a, b, c in FCC)], 2, 5.0)
    assert {r[0] for r in structure.identify_diamond(diamond).particles.select(col("Structure Type")).distinct().collect()} == {1}


def test_bins_cut_towards_zero(spark):
    ds = frame(spark, [(0, 0, -0.3, 0.0, 0.0), (0, 1, -1.2, 0.0, 0.0), (0, 2, 5.5, 0.0, 0.0)], extra=())
    got = {r.bin_x: r.value for r in analyze.bin_and_reduce(ds, "Position.X", "sum", (0,), (10,)).collect()}
    assert got[0] == -0.3 and got[9] == -1.2 and got[5] == 5.5 and got[3] == 0


def test_histogram_of_a_constant(spark):
    got = analyze.histogram(frame(spark, [(0, k, 2.0, 0.0, 0.0) for k in range(3)]), "Position.X", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [3, 0, 0, 0]


def test_expressions(spark):
    row = spark.createDataFrame([(2.0, 0.0, -3.0)], "a double, z double, m double")
    names = {c: F.col(c) for c in row.columns}

    def value(text):
        return row.select(compiled(text, names).alias("v")).first().v

    assert value("1 + 2*3^2") == 19 and value("a > 1 && z == 0 || m") == 1 and value("a < 1 ? 10 : z < 1 ? 20 : 30") == 20
    assert value("1/z") == math.inf and math.isnan(value("z/z")) and math.isnan(value("ln(m)")) and value("ln(z)") == -math.inf
    assert value("rint(0.5)") == 1 and value("fmod(-7.5, 2)") == -1.5 and value("min(a, m, z)") == -3 and value("avg(a, z)") == 1 and value("!z") == 1
    assert math.isnan(value("sqrt(m)")) and abs(value("sin(pi/2)") - 1) < 1e-12
    for bad in ("", "a = 1", "nothing + 1", "a ? 1", "__import__('os')"):
        with pytest.raises(ValueError):
            compiled(bad, names)


def test_select_delete_and_bonds(spark):
    ds = analyze.create_bonds(frame(spark, [(0, k, float(k), 0.0, 0.0) for k in range(5)], pbc=(False,) * 3), 1.0)
    assert ds.bonds.count() == 8
    out = select.delete_selected(select.select_expression(ds, "ParticleIndex == 1"))
    assert sorted((r.i, r.j) for r in out.bonds.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert [r.idx for r in out.particles.orderBy("idx").collect()] == [0, 1, 2, 3]
    again = analyze.create_bonds(ds, 1.0)
    assert again.bonds.count() == 8
    one = select.marked(ds, F.col("idx") == 0)
    assert select.expand_selection(one, "bonded", iterations=2).particles.agg(F.sum("Selection")).first()[0] == 3


def test_replicate_rewires_bonds(spark):
    ds = analyze.create_bonds(frame(spark, [(0, 0, 0.5, 5.0, 5.0), (0, 1, 9.5, 5.0, 5.0)]), 1.0)
    out = modify.replicate(ds, (2, 1, 1))
    assert sorted((r.i, r.j, r.sx) for r in out.bonds.collect()) == [(0, 3, -1), (1, 2, 0), (2, 1, 0), (3, 0, 1)]
    lengths = {round(r.Length, 9) for r in modify.bond_lengths(out).bonds.collect()}
    assert lengths == {1.0}
    assert pairs(out, 1.0).count() == 2 * pairs(ds, 1.0).count()


def test_wrap_keeps_bonds(spark):
    ds = analyze.create_bonds(frame(spark, [(0, 0, 10.5, 5.0, 5.0), (0, 1, -0.5, 5.0, 5.0)]), 1.5)
    out = modify.wrap_periodic(ds)
    assert {round(r.Length, 9) for r in modify.bond_lengths(out).bonds.collect()} == {1.0}
    twice = modify.wrap_periodic(out)
    assert sorted(map(tuple, out.particles.collect())) == sorted(map(tuple, twice.particles.collect()))


def test_unwrapped_and_frozen(spark):
    ds = frame(spark, [(f, 0, x, 0.0, 0.0) for f, x in enumerate((9.0, 9.8, 0.6, 1.4))])
    got = [round(r.x, 9) for r in modify.trajectory_lines(ds).orderBy("frame").collect()]
    assert got == [9.0, 9.8, 10.6, 11.4]
    frozen = modify.freeze_property(ds, "Position.X", "Start", 1).particles
    assert {r.Start for r in frozen.collect()} == {9.8}
    more = frame(spark, [(0, 0, 1.0, 0.0, 0.0), (1, 0, 1.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0)])
    with pytest.raises(Exception, match="frozen frame"):
        modify.freeze_property(more, "Position.X", "Start", 0).particles.collect()


def test_strain_of_a_known_shear(spark):
    fcc = crystal(spark, FCC, 3, 4.0)
    sheared = modify.affine_transform(fcc, ((1.0, 0.1, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)), cell=True)
    both = Dataset(fcc.particles.unionByName(sheared.particles.withColumn("frame", F.lit(1))), fcc.cells.unionByName(sheared.cells.withColumn("frame", F.lit(1))))
    got = analyze.atomic_strain(both, 3.0).particles.where("frame = 1")
    r = got.agg(F.min(col("Shear Strain")).alias("a"), F.max(col("Shear Strain")).alias("b"), F.max(col("Nonaffine Squared Displacement")).alias("d")).first()
    assert abs(r.a - 0.05008306) < 1e-6 and abs(r.b - 0.05008306) < 1e-6 and r.d < 1e-9


def test_slices(spark):
    ds = frame(spark, [(0, k, float(k), 0.0, 0.0) for k in range(10)])
    xs = lambda d: sorted(r[0] for r in d.particles.select(col("Position.X")).collect())
    assert xs(select.slice_particles(ds, (2.0, 0.0, 0.0), 4.0)) == [0, 1, 2, 3, 4]
    assert xs(select.slice_particles(ds, (1.0, 0.0, 0.0), 4.0, inverse=True)) == [4, 5, 6, 7, 8, 9]
    assert xs(select.slice_particles(ds, (1.0, 0.0, 0.0), 4.0, 2.0)) == [3, 4, 5]
    assert xs(select.slice_particles(ds, (1.0, 0.0, 0.0), 4.0, 2.0, inverse=True)) == [0, 1, 2, 6, 7, 8, 9]


def test_coordination_of_a_crystal(spark):
    fcc = crystal(spark, FCC, 3, 4.0)
    assert {r[0] for r in analyze.coordination(fcc, 3.0).particles.select("Coordination").distinct().collect()} == {12}
    g = analyze.radial_distribution(fcc, 3.0, 10).where("g > 0").collect()
    assert [r.bin for r in g] == [9]

def test_displacements_without_deformation(spark):
    # A skewed cell that is stretched and turned: particles that go with it don't move, one crosses a border.
    cells = [(0, 10.0, 0.0, 0.0, 2.0, 8.0, 0.0, 1.0, 0.5, 6.0, 1.0, 1.0, 1.0, True, True, False, False), (1, 0.0, 12.0, 0.0, -9.0, 1.0, 0.0, 0.0, 0.5, 7.0, 0.0, 0.0, 0.0, True, True, False, False)]
    m = [np.array(c[1:10]).reshape(3, 3) for c in cells]
    o = [np.array(c[10:13]) for c in cells]
    s0 = np.array([[0.1, 0.2, 0.3], [0.9, 0.5, 0.5], [0.4, 0.4, 0.1]])
    s1 = s0 + np.array([[0.0, 0.0, 0.0], [-0.8, 0.1, 0.0], [0.0, 0.0, 0.7]])
    rows = [(f, k, *map(float, x)) for f, s in enumerate((s0, s1)) for k, x in enumerate(s @ m[f] + o[f])]
    d = spark.createDataFrame(rows, "frame int, idx long, " + ", ".join(f"`{c}` double" for c in POSITION))
    out = analyze.displacements(Dataset(d, cells_of(spark, cells)), 0, eliminate_deformation=True).particles.where("frame = 1").orderBy("idx")
    got = np.array([[r[f"Displacement.{k}"] for k in "XYZ"] for r in out.collect()])
    assert np.allclose(got, np.array([[0, 0, 0], [0.2, 0.1, 0.0], [0.0, 0.0, 0.7]]) @ m[0])
    lone = Dataset(d.where("frame = 1 OR idx < 2"), cells_of(spark, cells))
    kept = analyze.displacements(lone, 0, missing="null").particles.where("frame = 1 AND idx = 2").first()
    assert kept["Displacement.X"] is None and kept["Displacement Magnitude"] is None
