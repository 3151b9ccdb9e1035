"""What grows with the input: steps that must not write more than the input's share, against plain versions of the same."""

import gzip

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import BONDS, Dataset, box, cells_of
from sparktraj.operators import analyze, blocks, modify, neighbors, select, structure, templates, voronoi
from sparktraj.plans.queries import _rounded
from sparktraj.sources import readers, writers


def cloud(spark, n: int, seed: int = 3, size: float = 4.0, pbc: bool = True) -> Dataset:
    rows = [(0, k, *map(float, p)) for k, p in enumerate(np.random.default_rng(seed).uniform(0, size, (n, 3)))]
    p = spark.createDataFrame(rows, "frame int, idx long, `Position.X` double, `Position.Y` double, `Position.Z` double")
    return Dataset(p, cells_of(spark, [box(0, (size,) * 3, pbc=(pbc,) * 3)]))


def _rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("frame", "bidx", "i", "n_common", "n_bonds", "longest").collect()))


@pytest.mark.parametrize("most", [64, 9, 0])
def test_signatures_of_rows_are_those_of_joins(spark, monkeypatch, most):
    """Bonds in rows of neighbourhoods, some in rows, none in rows: shifts matter, as the cell is less than three cutoffs wide."""
    ds = analyze.create_bonds(cloud(spark, 90), 1.5)
    b = ds.bonds.select("frame", "bidx", "i", "j", "sx", "sy", "sz")
    monkeypatch.setattr(structure, "MOST_BONDS", most)
    got = _rows(structure.bond_signatures(ds))
    assert len(got) == ds.bonds.count() and got == _rows(structure._joined(b, b))


def test_a_few_cells_are_known_to_be_few(spark):
    """Particles, or pairs, aren't dealt out by frame to meet their cell."""
    plan = cells_of(spark, [box(k, (1, 1, 1)) for k in range(4)])._jdf.queryExecution().optimizedPlan()
    assert int(str(plan.stats().sizeInBytes())) < 10_000


@pytest.mark.parametrize(("cutoff", "pbc"), [(0.45, True), (0.45, False), (3.0, True)])
def test_expanded_by_whole_bins(spark, cutoff, pbc):
    ds = cloud(spark, 300, 5, pbc=pbc)
    x = np.array([[r[f"Position.{c}"] for c in "XYZ"] for r in ds.particles.orderBy("idx").collect()])
    d = x[:, None] - x[None]
    d = d - 4.0 * np.round(d / 4.0) if pbc else d
    near, chosen = (d**2).sum(axis=2) <= cutoff**2, np.arange(300) % 25 == 0
    ds = ds.having(particles=ds.particles.withColumn("Selection", (F.col("idx") % 25 == 0).cast("int")))
    for rounds in (1, 2):
        chosen = chosen | near[chosen].any(axis=0)
        got = select.expand_selection(ds, "cutoff", cutoff, iterations=rounds).particles.where("Selection = 1").select("idx").collect()
        assert sorted(r.idx for r in got) == list(np.flatnonzero(chosen))


def test_expanded_by_bonds_of_one_direction(spark):
    ds = cloud(spark, 4).having(bonds=spark.createDataFrame([(0, 0, 0, 1, 0, 0, 0), (0, 1, 2, 1, 0, 0, 0), (0, 2, 2, 3, 0, 0, 0)], BONDS))
    ds = ds.having(particles=ds.particles.withColumn("Selection", (F.col("idx") == 0).cast("int")))
    got = lambda n: sorted(r.idx for r in select.expand_selection(ds, "bonded", iterations=n).particles.where("Selection = 1").collect())
    assert [got(n) for n in (1, 2, 3)] == [[0, 1], [0, 1, 2], [0, 1, 2, 3]]


def test_bonds_found_when_asked_for(spark):
    ds = cloud(spark, 80)
    ds = ds.having(particles=ds.particles.withColumn("Particle Type", (F.col("idx") % 3).cast("int")))
    keys = ["i", "j", "sx", "sy", "sz"]
    old = modify.bond_lengths(analyze.create_bonds(ds, 1.5)).bonds.select(*keys, F.round("Length", 9), (F.col("i") % 3).cast("int"), (F.col("j") % 3).cast("int"))
    new = analyze.create_bonds(ds, 1.5, numbered=False, lengths=True, ends=("Particle Type",)).bonds
    assert "bidx" not in new.columns
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.select(*keys, F.round("Length", 9), "`Particle Type.1`", "`Particle Type.2`").collect()))
    assert sorted(map(tuple, analyze.create_bonds(ds, 1.5, numbered=False).bonds.select(*keys).collect())) == sorted(map(tuple, new.select(*keys).collect()))


def test_prepared_cells_reduce_to_the_last_digit(spark):
    ds = cloud(spark, 50)
    tilted = (0, 4.0, 0.1, 0.0, 0.3, 3.7, 0.2, -0.4, 0.6, 3.9, 0.1, 0.2, 0.3, True, True, True, False)
    flat = (0, 4.0, 0.1, 0.0, 0.3, 3.7, 0.0, 0.0, 0.0, 1.0, 0.1, 0.2, 0.3, True, True, False, True)
    for row in (tilted, flat):
        p = tuple(F.col(f"`Position.{c}`") for c in "XYZ")
        d = ds.particles.join(g.prepared(cells_of(spark, [row])), "frame")
        assert d.where(F.array(*g.reduced(p)) != F.array(*g.reduced_here(p))).count() == 0


def test_a_fit_is_made_once_for_a_mapping(monkeypatch):
    rows, made, fit = 20, [], templates.fit
    monkeypatch.setattr(templates, "fit", lambda w, v: (made.append(len(v)), fit(w, v))[1])
    v = np.tile(templates.shell("FCC"), (rows, 1, 1)) + np.random.default_rng(2).normal(size=(rows, 12, 3)) * 0.02
    off, at, _, _ = templates.match(v, "FCC")
    assert (off < 0.05).all() and (np.sort(at, axis=1) == np.arange(12)).all()
    assert sum(made) < rows * len(templates.template("FCC").pairs) * templates.FITS * 0.8


@pytest.mark.parametrize(("size", "pbc"), [(4.0, True), (4.0, False), (1.3, True)])
def test_common_neighbors_of_pairs_are_those_of_bonds(spark, monkeypatch, size, pbc):
    """Without a list of common neighbours; parts of bins, images of the particle itself and places outside of the box too."""
    monkeypatch.setattr(neighbors, "TOGETHER", 5)
    ds = cloud(spark, 90 if size > 2 else 9, size=size, pbc=pbc)
    ds = ds.having(particles=ds.particles.withColumn("Position.X", F.col("`Position.X`") + F.when(F.col("idx") % 7 == 0, size if pbc else 0.0).otherwise(0.0)))
    bonded = analyze.create_bonds(ds, 1.5)
    b = structure.bond_signatures(bonded).join(bonded.bonds.drop("i"), ["frame", "bidx"])
    keys = ["frame", "i", "j", "sx", "sy", "sz", "n_common"]
    rows = lambda d: sorted(map(tuple, d.select(*keys).collect()))
    got = rows(structure.common_neighbors(ds, 1.5))
    assert got and got == rows(b)


_BODIES = {
    "cfg": ["Number of particles = 60", "A = 1.0", *(f"H0({k},{k}) = 10" for k in (1, 2, 3)), ".NO_VELOCITY.", "entry_count = 4", "auxiliary[0] = charge", *(x for k in range(60) for x in (["2.5"] if k % 29 == 0 else []) + ([f"K{k // 20}"] if k % 20 == 0 else []) + [f"{k / 64} 0.5 0.25 {k}"]), ""],
    "poscar": ["Title", "2", "5 0 0", "0 5 0", "0 0 5", "B A C", "13 40 7", "Direct", *(f"{k / 64} 0.5 0.25" for k in range(60)), "", *("0 0 0" for _ in range(60))],
    "pdb": ["CRYST1   50.000   50.000   50.000  90.00  90.00  90.00 P 1           1", *(f"ATOM  {k:5d}  T{k % 3}  RES A{k % 7:4d}    {k / 2:8.3f}{1:8.3f}{2:8.3f}  1.00  0.00          T{k % 3}" for k in range(60)), "END", "ATOM      1  T9  RES A   1       1.000   1.000   2.000  1.00  0.00          T9", "", "END"],
}


@pytest.mark.parametrize("format_", list(_BODIES))
@pytest.mark.parametrize("parts", [1, 7])
def test_long_frames_are_read_in_parts(spark, tmp_path, format_, parts):
    """Wherever a file is cut: kinds, weights, places and the end are told by what stands before."""
    lines = _BODIES[format_]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "frame").write_text("\n".join(lines) + "\n")
    folder = tmp_path / "parts" / "frame=0"
    folder.mkdir(parents=True)
    cuts = [0, *(12 + 9 * k for k in range(parts - 1)), len(lines)]
    for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
        (folder / f"part-{k:05d}.txt").write_text("\n".join(lines[a:e]) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, "700")
    try:
        got = readers.read_long_frames(spark, f"{tmp_path}/parts/*/*", format_)
        rows = got.particles.orderBy("idx").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = readers.read_frames(spark, f"{tmp_path}/whole/*", format_)
    assert len(rows) == 60 and rows == want.particles.select(*(f"`{c}`" for c in got.particles.columns)).orderBy("idx").collect()
    assert got.cells.collect() == want.cells.collect() and sorted(got.types.collect()) == sorted(want.types.collect())


def test_a_long_frame_that_breaks_off(spark, tmp_path):
    (tmp_path / "frame").write_text("\n".join(_BODIES["cfg"][:40]) + "\n")
    with pytest.raises(ValueError, match="of 60 particles"):
        readers.read_long_frames(spark, f"{tmp_path}/frame", "cfg")


def test_both_ways_of_a_pair_without_rows_of_structs(spark):
    """Pairs are turned by choosing among columns, and rounded in doubles as SQL does."""
    ds = cloud(spark, 80)
    d = neighbors.pairs(ds, 1.0, carry={"p": "Position.X"})
    assert "struct(" not in d.select("i", "j", "d2")._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.i, r.j, r.sx, r.sy, r.sz): r for r in d.collect()}
    assert rows
    for (i, j, *s), r in rows.items():
        b = rows[j, i, *(-x for x in s)]
        assert (b.dx, b.dy, b.dz, b.d2, b.p1, b.p2) == (-r.dx, -r.dy, -r.dz, r.d2, r.p2, r.p1)
    values = [0.0, 5e-7, 4.9999e-7, 0.1234565, 0.01, -1.5e-6, 123.4567891]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(_rounded(F.col("v"), "r")).collect()
    assert [r.r for r in got] == [float(np.copysign(np.floor(abs(v) * 1e6 + 0.5), v) / 1e6) for v in values]


def test_cells_are_worked_on_a_few_at_a_time(spark, monkeypatch):
    """And neither they nor what is unsure is sent to all tasks to be joined."""
    monkeypatch.setattr(voronoi, "AT_ONCE", 3)
    out = voronoi.voronoi(cloud(spark, 40), 1.5)
    assert "BroadcastHashJoin" not in out.particles._jdf.queryExecution().executedPlan().toString()
    rows = out.particles.select(F.col("`Atomic Volume`").alias("v")).collect()
    assert len(rows) == 40 and sum(r.v for r in rows) == pytest.approx(64.0)


@pytest.mark.parametrize(("n", "cutoff"), [(12, 0.9), (14, 1.3), (14, 2.5)])
def test_signatures_by_sets(n, cutoff):
    """Against plain sets."""
    v = np.random.default_rng(4).normal(size=(20, n, 3))
    got = structure.signatures(v, np.full(20, cutoff))
    for r, p in enumerate(v):
        near = [{b for b in range(n) if b != a and ((p[a] - p[b]) ** 2).sum() <= cutoff**2} for a in range(n)]
        for k in range(n):
            links, left, most = {a: near[a] & near[k] for a in near[k]}, set(near[k]), 0
            while left:
                part = {left.pop()}
                while (more := part.union(*(links[a] for a in part))) != part:
                    part = more
                left -= part
                most = max(most, sum(len(links[a]) for a in part) // 2)
            assert tuple(got[r, k]) == (len(near[k]), sum(map(len, links.values())) // 2, most)


def test_bonds_of_data_files_stream(spark, tmp_path):
    """Written as they are found and read as they stand: nothing is sorted, shuffled or joined on the way, and any cut of the file gives the same (F7)."""
    ds = cloud(spark, 90)
    ds = ds.having(particles=ds.particles.withColumns({"Particle Identifier": F.col("idx") * 3 + 5, "Particle Type": (F.col("idx") % 3 + 1).cast("int")}))
    ds = analyze.create_bonds(ds, 1.0, numbered=False, ends=("Particle Identifier",))
    writers.write_data(ds, f"{tmp_path}/parts")
    files = sorted((tmp_path / "parts" / "frame=0").glob("section=*/part-*"))
    (tmp_path / "whole.data").write_text("".join((gzip.decompress(f.read_bytes()) if f.suffix == ".gz" else f.read_bytes()).decode() for f in files))
    want = readers.read_frames(spark, f"{tmp_path}/whole.data", "data")
    rows = lambda d, *names: sorted(map(tuple, d.select(*(f"`{c}`" for c in names)).collect()))
    n = ds.bonds.count() // 2
    assert n > 100 and want.bonds.count() == 2 * n
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, "500")
    try:
        for path in (f"{tmp_path}/parts/*/*/*", f"{tmp_path}/whole.data"):
            got = readers.read_long_data(spark, path)
            assert rows(got.particles, "idx", *got.properties()) == rows(want.particles, "idx", *got.properties()) and got.cells.collect() == want.cells.collect()
            assert rows(got.bonds, "i", "j") == rows(want.bonds, "i", "j")
            bare = readers.read_long_data(spark, path, by_identifier=True).bonds
            assert sorted((min(a, b), max(a, b)) for a, b in rows(bare, "Particle Identifier.1", "Particle Identifier.2")) == [(3 * i + 5, 3 * j + 5) for i, j in rows(ds.bonds, "i", "j") if i < j]
            plan = bare._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    (tmp_path / "short.data").write_text("\n".join((tmp_path / "whole.data").read_text().splitlines()[:-3]) + "\n")
    with pytest.raises(ValueError, match="number of bonds"):
        readers.read_long_data(spark, f"{tmp_path}/short.data")


def test_numbers_are_written_as_before_without_patterns(spark):
    """The short way gives the text of the long one, of ten digits without zeros at the end (F26)."""
    rng = np.random.default_rng(5)
    x = [0.0, 5.0, -7.25, 0.001, 0.00099, 1e7, 1e10, 123456789.5, 9999999.9999, 0.1 + 0.2, 1000.1 - 900, 1e-300, 1e305, 0.12345678915, float("nan"), float("inf"), -float("inf"), None]
    x += [float(v) for v in rng.normal(size=200) * 10.0 ** rng.integers(-6, 12, 200)] + [float(np.round(v, k)) - 900 for v in rng.uniform(900, 2000, 40) for k in (0, 2, 4, 5)]
    d = spark.createDataFrame([(v,) for v in x], "v double")
    old = F.regexp_replace(F.regexp_replace(F.format_string("%.10g", "v"), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    assert [(r.v, r.new) for r in d.select("v", writers._number(F.col("v"), "double").alias("new"), old.alias("old")).where("new <> old OR new IS NULL").collect()] == []


def test_numbers_of_lines_are_cast_at_once():
    lines = ["1 2.5 -3e2", "4 nan 0.1"]
    assert readers._numbers(lines).tolist()[0] == [1.0, 2.5, -300.0] and readers._numbers(lines)[1, 2] == 0.1
    for other in ([], ["1 2", "3"], ["1  2"], ["1 T"], ["1\t2"]):
        assert readers._numbers(other) is None
    assert {c: v.tolist() for c, v in readers._table(["1 2 3", "4 5 6"], ["a", None, "b"]).items()} == {"a": [1.0, 4.0], "b": [3.0, 6.0]}


def test_heads_come_from_first_parts_alone(spark, tmp_path, monkeypatch):
    """Only each frame's first part is looked into for its head, however many parts there are."""
    for f in (2, 10):
        (tmp_path / f"frame={f}").mkdir()
        for k, text in enumerate(["#F A 1 1 0 3 0 0\n#C number type x y z\n#X 9 0 0\n#Y 0 9 0\n#Z 0 0 9\n#E\n1 1 0.5 0.5 0.5", *(f"{n} 1 0.5 0.5 {n}" for n in range(2, 8))]):
            (tmp_path / f"frame={f}" / f"part-{k:05d}.txt").write_text(text + "\n")
    read, asked = type(spark.read).text, []
    monkeypatch.setattr(type(spark.read), "text", lambda self, paths, *a, **k: (asked.append(paths), read(self, paths, *a, **k))[1])
    got = readers.read_long_frames(spark, f"{tmp_path}/*/*", "imd")
    firsts = [x for x in asked if isinstance(x, list)]
    assert len(firsts) == 1 and len(firsts[0]) == 2 and all(x.endswith("part-00000.txt") for x in firsts[0])
    assert [tuple(r) for r in got.particles.groupBy("frame").agg(F.count("*"), F.sum("`Particle Identifier`")).orderBy("frame").collect()] == [(0, 7, 28), (1, 7, 28)]


@pytest.mark.parametrize(("size", "pbc", "flat", "block"), [(4.0, True, False, 60), (4.0, False, False, 32768), (1.3, True, False, 9), (4.0, True, True, 60)])
def test_strain_without_rows_of_pairs(spark, monkeypatch, size, pbc, flat, block):
    """Sums over neighbours against plain ones; what is sent are places, a bounded number to a task, and not pairs (F1, F4)."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "SOURCES", 16)
    n, cutoff = 240 if size > 2 else 12, 1.5
    ref = cloud(spark, n, size=size, pbc=pbc)
    if flat:
        ref = ref.having(particles=ref.particles.withColumn("Position.Z", F.lit(0.0)), cells=cells_of(spark, [box(0, (size,) * 3, pbc=(pbc,) * 3, is2d=True)]))
    x = np.array([[r[f"Position.{c}"] for c in "XYZ"] for r in ref.particles.orderBy("idx").collect()])
    m = np.array([[1.0, 0.1, 0.0], [0.0, 1.05, 0.0], [0.0, 0.0, 1.0]])
    y = x @ m.T + np.random.default_rng(6).normal(size=x.shape) * 0.02 * np.array([1, 1, 0 if flat else 1])
    y = y - size * np.floor(y / size) * ([1, 1, 0 if flat else 1]) if pbc else y
    now = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(y)], ref.particles.schema)
    both = Dataset(ref.particles.unionByName(now), ref.cells.unionByName(ref.cells.withColumn("frame", F.lit(1))))
    got = analyze.atomic_strain(both, cutoff, 0, frames=[1]).particles.orderBy("idx").collect()
    assert [(r.frame, r.idx) for r in got] == [(1, k) for k in range(n)]
    periodic, images = np.array([pbc, pbc, pbc and not flat]), range(-2, 3) if size < 2 else range(-1, 2)
    shifts = np.array([(a, b, c) for a in images for b in images for c in images]) * size
    shifts = shifts[(periodic | (shifts == 0)).all(axis=1)]
    pairs = 0
    for k, r in enumerate(got):
        q = (x[None] + shifts[:, None] - x[k]).reshape(-1, 3)
        near = ((q * q).sum(axis=1) <= cutoff**2) & ((q != 0).any(axis=1))
        pairs += near.sum()
        u = np.tile(y - y[k], (len(shifts), 1))
        u = u - size * np.floor(u / size + 0.5) * periodic
        q, u = q[near], u[near]
        v, w = q.T @ q, u.T @ q
        if flat:
            v[2], v[:, 2], w[2], w[:, 2], v[2, 2], w[2, 2] = 0, 0, 0, 0, 1, 1
        ok = len(q) >= (2 if flat else 3) and abs(np.linalg.det(v)) > 1e-4 and abs(np.linalg.det(w)) >= 1e-4
        f = w @ np.linalg.inv(v) if ok else np.zeros((3, 3))
        green = (f.T @ f - np.eye(3)) / 2 if ok else f
        assert r.Selection == (not ok) and r["Volumetric Strain"] == pytest.approx(np.trace(green) / 3, abs=1e-9) and r["Strain.XY"] == pytest.approx(green[0, 1], abs=1e-9)
        assert r["Nonaffine Squared Displacement"] == pytest.approx(((u[:, : 2 if flat else 3] - (q @ f.T)[:, : 2 if flat else 3]) ** 2).sum() if ok else 0, abs=1e-9)
    rows = blocks.blocks(ref, cutoff)
    held = rows.groupBy("frame", "bin_x", "bin_y", "bin_z", "part", "chunk").agg(F.count_if(F.col("role") == 0).alias("a"), F.count_if(F.col("role") > 0).alias("b")).agg(F.max("a"), F.max("b"), F.count("*")).first()
    assert max(held[:2]) <= 2 * block + 30 and (held[2] > 27 or block > 100)
    if block > 100:
        assert rows.count() < pairs / 4


@pytest.mark.parametrize(("size", "pbc"), [(4.0, True), (4.0, False), (1.3, True)])
def test_pairs_of_blocks_are_those_of_the_join(spark, monkeypatch, size, pbc):
    """To the last digit, with images of the particle itself and places outside of the box; a particle's neighbours stand together, so that files are small (F6)."""
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "SOURCES", 16)
    ds = cloud(spark, 120 if size > 2 else 9, size=size, pbc=pbc)
    ds = ds.having(particles=ds.particles.withColumn("Position.X", F.col("`Position.X`") + F.when(F.col("idx") % 7 == 0, size if pbc else 0.0).otherwise(0.0)).withColumn("name", F.concat(F.lit("n"), F.col("idx"))))
    names = ["frame", "i", "j", "sx", "sy", "sz", "d2", "p1", "p2"]
    rows = lambda d: sorted(map(tuple, d.select(*names).collect()))
    got = blocks.pairs_in_blocks(ds, 1.5, carry={"p": "name"})
    want = rows(neighbors.pairs(ds, 1.5, carry={"p": "name"}))
    assert want and rows(got) == want and blocks.pairs_in_blocks(ds, 1.5, ("i", "d2")).columns == ["i", "d2"]
    ends = blocks.pairs_in_blocks(ds, 1.5, ("i", "j")).collect()
    assert len(ends) == len(want) and sum(a.i != b.i for a, b in zip(ends, ends[1:])) < len(want) * 0.7
