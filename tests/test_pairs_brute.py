"""Cutoff pairs in a skewed, partly open cell against a search over all images."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, cells_of
from sparktraj.operators import modify
from sparktraj.operators.neighbors import _binned, _start, knn, pairs
from tests.test_core import frame

CELL = np.array([[6.0, 0.5, 0.0], [1.5, 5.0, 0.3], [-0.7, 0.9, 4.0]])
ORIGIN = np.array([-1.0, 2.0, 0.5])


def dataset(spark, points, pbc):
    p = spark.createDataFrame([(0, k, *map(float, x)) for k, x in enumerate(points)], "frame int, idx long, " + ", ".join(f"`{c}` double" for c in POSITION))
    return Dataset(p, cells_of(spark, [(0, *CELL.ravel().tolist(), *ORIGIN.tolist(), *pbc, False)]))


def brute(points, pbc, cutoff):
    out = {}
    reach = [range(-6, 7) if p else (0,) for p in pbc]
    for s in itertools.product(*reach):
        d = points[None, :, :] + np.array(s) @ CELL - points[:, None, :]
        for i, j in np.argwhere((d**2).sum(axis=2) <= cutoff**2):
            if i != j or any(s):
                out[int(i), int(j), *s] = float((d[i, j] ** 2).sum())
    return out


@pytest.mark.parametrize("pbc", [(True, True, True), (True, False, True)])
def test_pairs(spark, pbc):
    rng = np.random.default_rng(3)
    # Some particles lie outside the cell.
    points = (rng.random((25, 3)) * 1.6 - 0.3) @ CELL + ORIGIN
    got = {(r.i, r.j, r.sx, r.sy, r.sz): r.d2 for r in pairs(dataset(spark, points, pbc), 3.1).collect()}
    want = brute(points, pbc, 3.1)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(j, i, -a, -b, -c) for i, j, a, b, c in got} == set(got)


def test_nearest_and_invariance(spark):
    rng = np.random.default_rng(4)
    points = rng.random((20, 3)) @ CELL + ORIGIN
    ds = dataset(spark, points, (True,) * 3)
    near = {(r.i, r["rank"]): r.d2 for r in knn(ds, 5).collect()}
    all_ = brute(points, (True,) * 3, 6.0)
    for i in range(20):
        want = sorted(d for (a, *_), d in all_.items() if a == i)[:5]
        assert [near[i, k + 1] for k in range(5)] == pytest.approx(want)
    moved = modify.affine_transform(ds, ((1.0, 0.0, 0.0, 17.3), (0.0, 1.0, 0.0, -5.1), (0.0, 0.0, 1.0, 2.2)))
    assert pairs(moved, 2.0).count() == pairs(ds, 2.0).count()


def test_start_radius_follows_the_particles(spark):
    # A cluster in a box a thousand times as large, and beside a thin gas: the radius is that of the tight box.
    rng = np.random.default_rng(9)
    tight = rng.random((400, 3)) * 10
    gas = rng.random((40, 3)) * 10_000
    radii = []
    for points, size in ((tight, 10.0), (tight, 10_000.0), (np.concatenate([tight, gas]), 10_000.0)):
        ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(points)], size=(size,) * 3)
        radii.append(_start(ds, ds.particles, 12).first()["_start"])
        if size > 10:
            near = [r.d2 for r in knn(ds, 12).where("i = 7").orderBy("rank").collect()]
            d2 = ((points - points[7]) ** 2).sum(axis=1)
            assert near == pytest.approx(np.sort(d2)[1:13])
    assert radii[0] / 1.7 < radii[1] < 1.7 * radii[0] and radii[0] / 1.7 < radii[2] < 1.7 * radii[0]


def test_bins_are_as_small_as_the_cutoff(spark):
    # 300 bins along a side.
    rng = np.random.default_rng(10)
    points = np.concatenate([rng.random((200, 3)) * 300, np.array([[0.1, 150, 150], [299.8, 150, 150]])])
    ds = frame(spark, [(0, k, *map(float, p)) for k, p in enumerate(points)], size=(300, 300, 300))
    assert (200, 201) in {(r.i, r.j) for r in pairs(ds, 1.0).collect()} and _binned(ds, ds.particles, F.lit(1.0)).agg(F.max("nx")).first()[0] == 300
