"""Clusters, transitions, grains and elastic strain: planted cases and plain versions of what components, tables of elements and rounds compute."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, box, cells_of, col
from sparktraj.operators import grains, templates
from sparktraj.operators.neighbors import knn


def turn(axis, degrees):
    a, t = np.array(axis, float) / np.linalg.norm(axis), math.radians(degrees)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def oriented(spark, points, kinds, turns, size):
    """Particles with the columns of template matching, without matching."""
    q = templates.quaternions(np.array(turns))
    rows = [(0, n, *map(float, p), int(k), *map(float, x)) for n, (p, k, x) in enumerate(zip(points, kinds, q))]
    d = spark.createDataFrame(rows, "frame int, idx long, " + ", ".join(f"`{c}` double" for c in POSITION) + ", `Structure Type` int, " + ", ".join(f"`Orientation.{c}` double" for c in "XYZW"))
    return Dataset(d, cells_of(spark, [box(0, size, pbc=(False,) * 3)]))


@pytest.mark.parametrize("kind", grains.CRYSTALS)
def test_tables_of_elements(spark, kind):
    r, product, inverse, one = grains.group(kind)
    n = len(r)
    pairs = spark.createDataFrame([(templates.KINDS.index(kind), a, b) for a in range(n) for b in range(n)], "kind int, a int, b int")
    for x in pairs.select("a", "b", grains._times(F.col("a"), F.col("b"), F.col("kind")).alias("ab"), grains._inverse(F.col("a"), F.col("kind")).alias("i")).collect():
        assert np.allclose(r[x.ab], r[x.a] @ r[x.b]) and np.allclose(r[x.i] @ r[x.a], np.eye(3))
    assert np.allclose(r[one], np.eye(3)) and len(product) == n * n and len(inverse) == n


def test_frames_follow_a_bend(spark):
    # A rod that turns by 180 degrees from end to end, each particle with any of its equal orientations.
    rng, n = np.random.default_rng(1), 91
    of = grains.group("FCC")[0]
    real = [turn((0, 0, 1), 2.0 * k) for k in range(n)]
    points = [(0.5 + k, 0.5, 0.5) for k in range(n)]
    ds = oriented(spark, points, [1] * n, [r @ of[rng.integers(24)] for r in real], (n, 1, 1))
    found = grains.links(ds, 2)
    assert found.agg(F.max("angle")).first()[0] == pytest.approx(4)
    out, table = grains.lattice_clusters(ds, 2.5, found)
    rows = out.particles.orderBy("idx").collect()
    frames = grains.matrices(np.array([[r[f"Lattice Frame.{c}"] for c in "XYZW"] for r in rows]))
    start = real[0].T @ frames[0]
    assert np.abs(np.abs(start).max(axis=0) - 1).max() < 1e-6
    assert max(np.abs(f - r @ start).max() for f, r in zip(frames, real)) < 1e-6
    t = table.first()
    assert (t.cluster, t.kind, t.size, t.n_disagree) == (1, 1, n, 0)


def test_paths_that_disagree(spark):
    # A ring whose way around turns by 90 degrees: each link fits, and some can't fit the frames.
    n = 60
    points = [(10 + 8 * math.cos(2 * math.pi * k / n), 10 + 8 * math.sin(2 * math.pi * k / n), 0.5) for k in range(n)]
    ds = oriented(spark, points, [1] * n, [turn((0, 0, 1), 1.5 * k) for k in range(n)], (20, 20, 1))
    found = grains.links(ds, 2)
    _, table = grains.lattice_clusters(ds, 2.0, found)
    t = table.first()
    assert t.size == n and t.n_disagree >= 1


def grown(spark, threshold, least, adopt, seed):
    rng = np.random.default_rng(seed)
    points = np.array(list(itertools.product(range(8), repeat=3)), float) + 0.5 + rng.uniform(-0.1, 0.1, (512, 3))
    centres = rng.random((5, 3)) * 8
    of_grain = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    base = [turn(rng.normal(size=3), a) for a in rng.uniform(0, 40, 5)]
    of = grains.group("FCC")[0]
    turns = [base[g] @ turn(rng.normal(size=3), abs(rng.normal()) * 1.2) @ of[rng.integers(24)] for g in of_grain]
    kinds = np.where(rng.random(512) < 0.15, 0, 1)
    kinds[rng.random(512) < 0.03] = 3
    ds = oriented(spark, points, kinds, turns, (8, 8, 8))
    found = grains.links(ds)
    rows = [(r.u, r.v, r.kind, r.kind2, r.angle) for r in found.collect()]
    near = {}
    for r in knn(ds, 12).orderBy("i", "rank").select("i", "j").collect():
        near.setdefault(r.i, []).append(r.j)
    got = grains.grains(ds, threshold, least, adopt, found)
    return rows, near, kinds, {r.idx: r.Grain for r in got.particles.collect()}, got.attributes.first().num, turns


@pytest.mark.parametrize(("threshold", "least", "adopt"), [(3.0, 10, True), (2.0, 25, False)])
def test_grains_against_union_find(spark, threshold, least, adopt):
    rows, near, kinds, got, count, turns = grown(spark, threshold, least, adopt, int(threshold))
    # The links' angles, against all elements of the group.
    for u, v, a, b, angle in rows[::97]:
        if a == b:
            of = grains.group(templates.KINDS[a])[0]
            assert angle == pytest.approx(min(math.degrees(math.acos(max(-1, min(1, (np.trace(turns[u].T @ turns[v] @ g) - 1) / 2)))) for g in of), abs=1e-4)
    parent = {k: k for k in range(512) if kinds[k]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    same = sorted((angle, u, v) for u, v, a, b, angle in rows if a == b)
    for angle, u, v in same:
        if angle < threshold:
            join(u, v)
    while True:
        size = {}
        for k in parent:
            size[root(k)] = size.get(root(k), 0) + 1
        picks = {}
        for angle, u, v in same:
            a, b = root(u), root(v)
            if a != b:
                for x, y in ((a, b), (b, a)):
                    if size[x] < least:
                        picks.setdefault(x, y)
        if not picks:
            break
        for x, y in picks.items():
            join(x, y)
    grain = {k: root(k) for k in parent if size[root(k)] >= least}
    while adopt:
        more = {k: next(grain[j] for j in near[k] if j in grain) for k in range(512) if k not in grain and any(j in grain for j in near.get(k, ()))}
        if not more:
            break
        grain |= more
    members = {}
    for k, r in grain.items():
        members.setdefault(r, set()).add(k)
    want = {r: n for n, r in enumerate(sorted(members, key=lambda r: (-len(members[r]), r)), 1)}
    assert got == {k: want[grain[k]] if k in grain else 0 for k in range(512)} and count == len(members)


def lattice(m, n, a=4.0):
    faces = np.array([(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)])
    return np.concatenate([(np.array(c) + faces) * a for c in itertools.product(range(-n, n), repeat=3)]) @ np.array(m).T


def bicrystal(spark, one, two):
    """Two half spaces of turned and strained crystals with a gap between them."""
    points = []
    for m, low, high in ((one, (1.0, 1.0, 1.0), (13.0, 25.0, 25.0)), (two, (16.0, 1.0, 1.0), (28.0, 25.0, 25.0))):
        p = lattice(m, 8) + (np.array(low) + high) / 2
        points.append(p[((p >= low) & (p <= high)).all(axis=1)])
    rows = [(0, k, *map(float, p)) for k, p in enumerate(np.concatenate(points))]
    d = spark.createDataFrame(rows, "frame int, idx long, " + ", ".join(f"`{c}` double" for c in POSITION))
    return Dataset(d, cells_of(spark, [box(0, (29.0, 26.0, 26.0), pbc=(False,) * 3)])), len(points[0])


def test_strain_comes_back_in_turned_grains(spark):
    strain = np.array([[0.01, 0.004, 0], [0.004, -0.005, 0.002], [0, 0.002, 0.003]])
    r1, r2 = turn((1, 2, 3), 35), turn((0, 1, -1), 80)
    ds, n = bicrystal(spark, (np.eye(3) + strain) @ r1, (np.eye(3) + strain) @ r2)
    ds = templates.template_matching(ds, ("FCC",))
    out, table = grains.lattice_clusters(ds)
    sizes = [r for r in table.orderBy("cluster").collect() if r.size > 20]
    assert len(sizes) == 2 and all(r.kind == 1 for r in sizes)
    inverse = np.linalg.inv(np.eye(3) + strain)
    want = (np.eye(3) - inverse.T @ inverse) / 2
    rows = grains.elastic_strain(out, "FCC", 4.0).particles.where(col("Lattice Cluster").isin([r.cluster for r in sizes])).collect()
    for r in rows:
        assert [r[f"Elastic Strain.{k}"] for k in ("XX", "YY", "ZZ", "XY", "XZ", "YZ")] == pytest.approx([want[0, 0], want[1, 1], want[2, 2], want[0, 1], want[0, 2], want[1, 2]], abs=1e-9)
        assert r["Volumetric Elastic Strain"] == pytest.approx(np.trace(want) / 3, abs=1e-9) and r["Selection"] == 0
    # In the cluster's frame: the gradient is the strain after the frame's own turn.
    own = grains.elastic_strain(out, "FCC", 4.0, push_forward=False).particles.where("idx < 100000").collect()
    for r in own:
        if r["Selection"] == 0 and r["Lattice Cluster"] in [s.cluster for s in sizes]:
            f = np.array([[r[f"Elastic Gradient.{a}{b}"] for b in "XYZ"] for a in "XYZ"])
            green = (f.T @ f - np.eye(3)) / 2
            assert np.linalg.det(f) == pytest.approx(np.linalg.det(np.eye(3) + strain)) and r["Elastic Strain.XY"] == pytest.approx(green[0, 1], abs=1e-12)
    first = {}
    for r in own:
        if r["Selection"] == 0:
            first.setdefault(r["Lattice Cluster"], []).append([r["Elastic Strain.XX"], r["Elastic Strain.YZ"]])
    assert all(np.ptp(np.array(x), axis=0).max() < 1e-9 for x in first.values())
    with pytest.raises(ValueError):
        grains.elastic_strain(out, "ICO", 4.0)
    grown_ = grains.grains(ds, adopt=True)
    assert {r.key: r.num for r in grown_.attributes.collect()}["GrainSegmentation.grain_count"] == 2
    assert {(r.Grain) for r in grown_.particles.where(F.col("idx") < n).select("Grain").distinct().collect()} != {r.Grain for r in grown_.particles.where(F.col("idx") >= n).select("Grain").distinct().collect()}


def test_a_twin(spark):
    from sparktraj.plans.crystals import twin_sites

    ds = templates.template_matching(twin_sites(spark.range(320).withColumnRenamed("id", "p_partkey")), ("FCC", "HCP"))
    found = grains.links(ds)
    out, table = grains.lattice_clusters(ds, found=found)
    rows = table.where("frame = 0").orderBy("cluster").collect()
    assert [r.kind for r in rows] == [1, 1, 2, 2] and rows[0].size == rows[1].size and all(r.n_disagree == 0 for r in rows)
    t = {(r.a, r.b): r for r in grains.transitions(out, table, found).where("frame = 0").collect()}
    assert t[1, 2].via and t[1, 2].angle == pytest.approx(60, abs=1e-6) and sorted(np.abs([t[1, 2].ax, t[1, 2].ay, t[1, 2].az])) == pytest.approx([3**-0.5] * 3, abs=1e-6)
    assert not t[1, 3].via and t[1, 3].n_links > 0
    assert ds.particles.count() == out.particles.count()
