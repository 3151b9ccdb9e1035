"""Template matching: planted shells, orientation, strain, alloys, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, box, cells_of, col
from sparktraj.operators import templates

RNG = np.random.default_rng(5)
FACES = np.array([(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)])


def turns(n):
    q = np.linalg.qr(RNG.normal(size=(n, 3, 3)))[0]
    return q * np.linalg.det(q)[:, None, None]


@pytest.mark.parametrize("kind", templates.KINDS[1:])
def test_match_finds_the_planted_mapping(kind):
    p = templates.shell(kind)
    turned = turns(200)
    v = np.einsum("mij,nj->mni", turned, p) * 2.5 + RNG.normal(size=(200, len(p), 3)) * 0.1
    mixed = RNG.permuted(np.tile(np.arange(len(p)), (200, 1)), axis=1)
    off, at, turn, scale = templates.match(np.take_along_axis(v, mixed[:, :, None], 1), kind)
    # Brute force: the planted order, with rotation and scale as one least-squares problem with steps of its own.
    for k in range(20):
        x = np.concatenate([[(0, 0, 0)], v[k]])
        x = x - x.mean(axis=0)
        w = np.concatenate([[(0, 0, 0)], p])
        u, s, vt = np.linalg.svd(w.T @ x)
        d = np.diag([1, 1, np.linalg.det(u @ vt)])
        r = vt.T @ d @ u.T
        best = (s * np.diag(d)).sum() / (x**2).sum()
        assert off[k] == pytest.approx(np.sqrt(((best * x - w @ r.T) ** 2).sum() / len(w)), abs=1e-9)
        assert scale[k] == pytest.approx(best)
    near = np.einsum("mij,gjk->mgik", turned, templates.template(kind).rotations)
    assert (np.abs(near - turn[:, None]).max(axis=(2, 3)).min(axis=1) < 0.1).all()


@pytest.mark.parametrize("kind, n", [("SC", 24), ("FCC", 24), ("HCP", 6), ("BCC", 24), ("ICO", 60)])
def test_symmetries(kind, n):
    t = templates.template(kind)
    assert len(t.rotations) == n and np.linalg.norm(t.points, axis=1).mean() == pytest.approx(1)
    q, _ = templates.least_turned(t.rotations, kind)
    assert np.allclose(q, [0, 0, 0, 1], atol=1e-7)


def test_mirrored_shell_is_no_rotation():
    p = templates.shell("FCC") @ np.diag([1, 1, -1])
    assert templates.match(p[None] * 1.0, "FCC")[0][0] < 1e-6
    skewed = p + np.outer(np.arange(12), [0.01, 0.02, 0.0])
    assert np.isfinite(templates.match(skewed[None], "FCC")[0][0])


def crystal(spark, n=3, types=None, strain=(1.0, 1.0, 1.0), a=4.0, basis=FACES, missing=()):
    rows = []
    for x in range(n):
        for y in range(n):
            for z in range(n):
                for k, b in enumerate(basis):
                    at = (np.array([x, y, z]) + b) * a * np.array(strain)
                    rows.append((0, len(rows), *map(float, at), int(types[k]) if types else 1))
    rows = [r for r in rows if r[1] not in missing]
    d = spark.createDataFrame(rows, "frame int, idx long, " + ", ".join(f"`{c}` double" for c in POSITION) + ", `Particle Type` int")
    return Dataset(d, cells_of(spark, [box(0, tuple(n * a * s for s in strain), (0.0, 0.0, 0.0), (True,) * 3)]))


def test_strain_scale_and_attributes(spark):
    ds = templates.template_matching(crystal(spark, strain=(1.02, 1.0, 1.0)))
    rows = ds.particles.collect()
    assert {r["Structure Type"] for r in rows} == {1}
    r = rows[0]
    f = np.array([[r[f"Elastic Deformation Gradient.{i}{j}"] for j in "XYZ"] for i in "XYZ"])
    assert np.allclose(f / f[1, 1], np.diag([1.02, 1, 1]), atol=1e-9)
    assert r["Interatomic Distance"] == pytest.approx(4 / 2**0.5 * 1.0067, rel=1e-3)
    assert [r[f"Orientation.{c}"] for c in "XYZW"] == pytest.approx([0, 0, 0, 1], abs=1e-7)
    counts = {x.key: x.num for x in ds.attributes.collect()}
    assert counts["PolyhedralTemplateMatching.counts.FCC"] == 108 and counts["PolyhedralTemplateMatching.counts.SC"] == 0


@pytest.mark.parametrize("types, basis, kinds", [
    ([1, 1, 1, 1], FACES, {1}),
    ([1, 1, 2, 2], FACES, {2}),
    ([2, 1, 1, 1], FACES, {3, 4}),
    ([1, 2], np.array([(0, 0, 0), (0.5, 0.5, 0.5)]), {5}),
    ([1, 2, 3, 1], FACES, {0}),
])
def test_alloys(spark, types, basis, kinds):
    p = templates.template_matching(crystal(spark, types=types, basis=basis), alloy_types=True).particles
    assert {r[0] for r in p.select(col("Alloy Type")).distinct().collect()} == kinds
    if kinds == {3, 4}:
        assert {r[0] for r in p.where(col("Particle Type") == 2).select(col("Alloy Type")).distinct().collect()} == {4}


def test_cutoff_selection_and_histogram(spark):
    ds = crystal(spark, missing=(5,))
    found = templates.matched(ds, ("FCC",))
    assert found.count() == 107 and found.where(col("Structure Type") == 0).count() == 12
    p = templates.template_matching(crystal(spark, strain=(1.1, 1.0, 1.0)), rmsd_cutoff=0.01).particles
    assert p.where((col("Structure Type") != 0) | (col("RMSD") <= 0.01)).count() == 0
    h = templates.rmsd_histogram(templates.matched(crystal(spark, strain=(1.1, 1.0, 1.0)))).collect()
    assert [(x.bin, x.n) for x in h] == [(99, 108)]
    some = ds.having(particles=ds.particles.withColumn("Selection", F.lit(0)))
    q = templates.template_matching(some, only_selected=True).particles
    assert q.count() == 107 and q.where(col("Structure Type") != 0).count() == 0
    with pytest.raises(ValueError):
        templates.matched(ds, ("CUBE",))
