"""Known crystals: what the kinds must be, and rules at their limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, box, cells_of, col, number
from sparktraj.operators import analyze, structure
from sparktraj.sources import readers


def frame(spark, points, size, pbc=True, **more):
    rows = [(0, k, *map(float, p)) for k, p in enumerate(points)]
    return Dataset(spark.createDataFrame(rows, "frame int, idx long, `Position.X` double, `Position.Y` double, `Position.Z` double"), cells_of(spark, [box(0, size, (0.0, 0.0, 0.0), (pbc,) * 3, **more)]))


def kinds(ds):
    return {r[0]: r[1] for r in ds.particles.groupBy(col("Structure Type")).count().collect()}


def twin(spark):
    """Close-packed layers of 16 particles, stacked with faults: a layer between two like ones is hexagonal."""
    a = math.sqrt(0.5)
    layers = "ABCABCACBACB"
    shift = {"A": (0.0, 0.0), "B": (a / 2, a / (2 * math.sqrt(3))), "C": (a, a / math.sqrt(3))}
    points = []
    for z, name in enumerate(layers):
        for i in range(4):
            for j in range(2):
                for dx, dy in ((0.0, 0.0), (a / 2, a * math.sqrt(3) / 2)):
                    points.append(((i * a + dx + shift[name][0]) % (4 * a), (j * a * math.sqrt(3) + dy + shift[name][1]) % (2 * a * math.sqrt(3)), z * a * math.sqrt(2 / 3)))
    return frame(spark, points, (4 * a, 2 * a * math.sqrt(3), 12 * a * math.sqrt(2 / 3))), layers


def test_twinned_crystal(spark):
    ds, layers = twin(spark)
    n = len(layers)
    faulted = sum(layers[k - 1] == layers[(k + 1) % n] for k in range(n))
    want = {1: 16 * (n - faulted), 2: 16 * faulted}
    assert 0 < faulted < n / 2
    assert kinds(structure.common_neighbor_analysis(ds)) == want
    assert kinds(structure.bond_angle_analysis(ds)) == want
    assert kinds(structure.common_neighbor_analysis(ds, 0.85)) == want


def test_lone_icosahedron(spark):
    """Twelve neighbours and no more are enough for bond angles."""
    phi = (1 + math.sqrt(5)) / 2
    corners = [p for s in (1, -1) for t in (phi, -phi) for p in ((0, s, t), (s, t, 0), (t, 0, s))]
    ds = frame(spark, [(50, 50, 50), *((50 + x, 50 + y, 50 + z) for x, y, z in corners)], (100, 100, 100), pbc=False)
    assert structure.bond_angle_analysis(ds).particles.where("idx = 0").first()["Structure Type"] == 4
    few = frame(spark, [(50, 50, 50), *((50 + x, 50 + y, 50 + z) for x, y, z in corners[:4])], (100, 100, 100), pbc=False)
    assert kinds(structure.bond_angle_analysis(few)) == {0: 5}


def test_strain_in_the_plane(spark):
    grid = [(x + 0.5, y + 0.5, 0.0) for x in range(5) for y in range(5)]
    ref = frame(spark, grid, (5, 5, 1), is2d=True)
    now = ref.particles.withColumn("frame", F.lit(1)).withColumn("Position.X", col("Position.X") + 0.1 * col("Position.Y"))
    cells = cells_of(spark, [box(k, (50, 50, 1), (0.0, 0.0, 0.0), (False,) * 3, is2d=True) for k in (0, 1)])
    out = analyze.atomic_strain(Dataset(ref.particles.unionByName(now), cells), 1.2, 0).particles.where("frame = 1").collect()
    assert all(r["Selection"] == 0 and abs(r["Deformation Gradient.12"] - 0.1) < 1e-9 and abs(r["Deformation Gradient.33"] - 1) < 1e-9 and r["Nonaffine Squared Displacement"] < 1e-9 for r in out)
    assert all(abs(r["Strain.XY"] - 0.05) < 1e-9 and r["Strain.ZZ"] == 0 for r in out)


def test_flattened_neighbourhood_has_no_strain(spark):
    """The reference spans space, but what became of it doesn't."""
    rng = np.random.default_rng(1)
    ref = frame(spark, rng.random((20, 3)), (1, 1, 1), pbc=False)
    now = ref.particles.withColumn("frame", F.lit(1)).withColumn("Position.Z", F.lit(0.0))
    cells = cells_of(spark, [box(k, (1, 1, 1), (0.0, 0.0, 0.0), (False,) * 3) for k in (0, 1)])
    out = analyze.atomic_strain(Dataset(ref.particles.unionByName(now), cells), 0.9, 0).particles.where("frame = 1")
    assert {r.Selection for r in out.select("Selection").collect()} == {1}


def test_places_over_many_tasks(spark):
    d = spark.range(5000).select((F.col("id") % 3).cast("int").alias("frame"), (F.col("id") * 7919 % 5003).alias("k"))
    got = number(d, ["k"], "at").collect()
    for f in range(3):
        mine = sorted((r.k, r["at"]) for r in got if r.frame == f)
        assert [at for _, at in mine] == list(range(len(mine)))


@pytest.mark.parametrize(
    ("text", "size", "origin"),
    [
        ("1\nframe 3 cell_orig 1 2 3 cell_vec1 4 0 0 cell_vec2 0 5 0 cell_vec3 0 0 6\nA 1 1 1\n", (4, 5, 6), (1, 2, 3)),
        ('1\nLattice="4 0 0 0 5 0 0 0 6" Properties=species:S:1:pos:R:3 cell_origin="1 2 3"\nA 1 1 1\n', (4, 5, 6), (1, 2, 3)),
        ("1\nFrame number 7 1.5 fs boxsize 4 5 6\nA 1 1 1\n", (4, 5, 6), (-2, -2.5, -3)),
    ],
)
def test_cells_of_xyz_comments(text, size, origin):
    (f,) = readers.parse_xyz(text)
    assert [f.cell[0], f.cell[4], f.cell[8]] == list(size) and list(f.cell[9:12]) == list(origin) and all(f.cell[12:15])


def test_poscar_scale_with_more_behind_it_and_pdb_without_atoms():
    (f,) = readers.parse_poscar("W Ti\n2.0 1.00546\n1 0 0\n0 1 0\n0 0 1\nW Ti\n1 1\nDirect\n0 0 0\n0.5 0.5 0.5\n")
    assert f.columns["Position.X"].tolist() == [0.0, 1.0]
    (g,) = readers.parse_pdb("CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 1           1\nEND\n")
    assert len(g.columns["Position.X"]) == 0
    assert POSITION[0] in g.columns
