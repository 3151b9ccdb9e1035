import numpy as np
import pytest

from sparktraj.operators import analyze, mesh, structure
from sparktraj.dataset import col
from sparktraj.sources.readers import parse_vtk, read_mesh
from tests.test_core import FCC, crystal

CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
VTK = "# vtk DataFile Version 3.0\ncube\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 8 double\n" + "\n".join(" ".join(map(str, p)) for p in CUBE) + f"\nCELLS {len(FACES)} {4 * len(FACES)}\n" + "\n".join("3 " + " ".join(map(str, f)) for f in FACES) + "\n"


def test_mesh(spark, tmp_path):
    (tmp_path / "cube.vtk").write_text(VTK)
    assert parse_vtk(VTK)[1].shape == (12, 3)
    v, f = (d.drop("path").selectExpr("0 AS frame", "*") for d in read_mesh(spark, str(tmp_path / "cube.vtk")))
    r = mesh.area_and_volume(v, f).first()
    assert (r.area, r.volume) == pytest.approx((6, 1))
    soft = mesh.area_and_volume(mesh.smooth(v, f, 2), f).first()
    assert 0 < soft.volume < 1.2 and soft.area < 6
    assert mesh.slice_mesh(v, f, (0.0, 0.0, 1.0), 0.5).count() == 2


def _cut(spark, normal, distance):
    v = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(CUBE)], "frame int, v long, x double, y double, z double")
    f = spark.createDataFrame([(0, k, *t) for k, t in enumerate(FACES)], "frame int, f long, v1 long, v2 long, v3 long")
    points, triangles = mesh.cut_mesh(v, f, normal, distance)
    at = {r.v: np.array([r.x, r.y, r.z]) for r in points.collect()}
    rows = triangles.collect()
    assert len({r.f for r in rows}) == len(rows) and {x for r in rows for x in (r.v1, r.v2, r.v3)} == set(at)
    return at, [(r.v1, r.v2, r.v3) for r in rows]


@pytest.mark.parametrize(("normal", "distance", "area", "hole"), [((0.0, 0.0, 2.0), 0.5, 3.0, 1.0), ((1.0, 1.0, 1.0), 1 / (2 * 3**0.5), 3 / 8, 3**0.5 / 8), ((0.0, 0.0, 1.0), 0.0, 1.0, 1.0), ((0.0, 0.0, 1.0), 2.0, 6.0, 0.0), ((0.0, 0.0, 1.0), -1.0, 0.0, 0.0), ((1.0, -1.0, 0.0), 0.0, 3.0, 2**0.5)])
def test_cut_mesh(spark, normal, distance, area, hole):
    at, triangles = _cut(spark, normal, distance)
    turned = [np.cross(at[b] - at[a], at[c] - at[a]) / 2 for a, b, c in triangles]
    assert sum(np.linalg.norm(n) for n in turned) == pytest.approx(area)
    # The open rim lies in the plane, and what is missing there is its area, so no face was turned over.
    assert np.linalg.norm(sum(turned, np.zeros(3))) == pytest.approx(hole, abs=1e-12)
    once = {(a, b) for t in triangles for a, b in zip(t, (*t[1:], t[0]))}
    unit = np.array(normal) / np.linalg.norm(normal)
    assert all((b, a) in once or abs(at[a] @ unit - distance) + abs(at[b] @ unit - distance) < 1e-9 for a, b in once)


def test_analysis_by_bonds(spark):
    out = structure.common_neighbor_analysis_by_bonds(analyze.create_bonds(crystal(spark, FCC, 3, 4.0), 3.2))
    assert {r[0] for r in out.particles.select(col("Structure Type")).distinct().collect()} == {1}
    assert {tuple(r) for r in out.bonds.select(*(col(f"CNA Indices.{k}") for k in (1, 2, 3))).distinct().collect()} == {(4, 2, 1)}
