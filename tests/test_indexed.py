"""Frames that are read by byte ranges, from files built here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, col
from sparktraj.sources import indexed, readers


def binary_dump(frames, order="<", wide="q", chunk=3):
    """Frames are (step, values), in a box of edge 10; chunks of at most ``chunk`` particles, an empty one first."""
    out = b""
    for step, values in frames:
        parts = [values[:0], *(values[k : k + chunk] for k in range(0, len(values), chunk))]
        out += struct.pack(f"{order}{wide}{wide}i", step, len(values), 0) + struct.pack(f"{order}6i", 0, 0, 1, 1, 0, 0) + struct.pack(f"{order}6d", 0, 10, 0, 10, 0, 10) + struct.pack(f"{order}ii", values.shape[1], len(parts))
        out += b"".join(struct.pack(f"{order}i", p.size) + p.astype(f"{order}f8").tobytes() for p in parts)
    return out


def rows_of(ds, *names):
    return [tuple(r) for r in ds.particles.select("frame", "idx", *map(col, names)).orderBy("frame", "idx").collect()]


@pytest.mark.parametrize(("order", "wide"), [("<", "q"), (">", "i")])
def test_binary_dump_by_stretches(spark, tmp_path, order, wide):
    values = np.random.default_rng(0).random((8, 4)) * 10
    values[:, 0] = np.arange(8)
    (tmp_path / "a.bin").write_bytes(binary_dump([(100, values), (200, values[:0]), (300, values[:2])], order, wide))
    names = ["Particle Identifier", *POSITION]
    index = indexed.frame_index(spark, str(tmp_path / "a.bin"), "binary_dump", columns=names)
    assert index.where("frame = 0").count() == 3
    ds = indexed.read_indexed(spark, index, "binary_dump", at_once=2)
    want = [(f, k, int(v[0]), *v[1:]) for f, part in ((0, values), (2, values[:2])) for k, v in enumerate(part)]
    assert rows_of(ds, *names) == want
    assert {r.frame: (r.ax, r.px, r.py, r.pz) for r in ds.cells.collect()} == {f: (10.0, True, False, True) for f in range(3)}
    assert {r.frame: r.num for r in ds.attributes.collect()} == {0: 100.0, 1: 200.0, 2: 300.0}
    # The same as from the reader of whole files.
    plain = readers.read_frames(spark, str(tmp_path / "a.bin"), "binary_dump", columns=names)
    assert rows_of(plain, *names) == want


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    values = np.arange(40.0).reshape(10, 4)
    raw = bytearray(binary_dump([(k, values + k) for k in range(5)], chunk=10))
    size = len(raw) // 5
    whole = bytes(raw)
    (tmp_path / "a.bin").write_bytes(whole)
    index = indexed.frame_index(spark, str(tmp_path / "a.bin"), "binary_dump", columns=["Particle Identifier", *POSITION])
    # All frames but one are spoilt after the index was made: they can't be read any more.
    raw[:] = b"\xff" * len(raw)
    raw[3 * size : 4 * size] = whole[3 * size : 4 * size]
    (tmp_path / "a.bin").write_bytes(bytes(raw))
    ds = indexed.read_indexed(spark, index.where("frame = 3"), "binary_dump", ["Position.X"])
    assert ds.particles.columns == ["frame", "idx", "Position.X"]
    assert rows_of(ds, "Position.X") == [(3, k, 4.0 * k + 1 + 3) for k in range(10)]


@pytest.mark.parametrize(("order", "real"), [("<", 8), (">", 4)])
def test_parcas(spark, tmp_path, order, real):
    kind = "d" if real == 8 else "f"
    names = b"EpoteV  Heat    "
    types = b"Fe  Cr  "
    at = struct.calcsize("<4i2q4iq3i5d") + len(names) + len(types)
    head = struct.pack(f"{order}4i", 0x3F302010, 0x11223344, 1, real) + struct.pack(f"{order}qq", at, at + 16) + struct.pack(f"{order}4i", 7, 0, 1, 2) + struct.pack(f"{order}q", 3) + struct.pack(f"{order}3i", 1, 2, 1) + struct.pack(f"{order}5d", 2.5, 1.0, -10.0, 20.0, -30.0)
    body = b"".join(struct.pack(f"{order}qi5{kind}", 5 - k, -2 if k else 1, k, 2 * k, 3 * k, -k, 0.5 * k) for k in range(3))
    (tmp_path / "a.parcas").write_bytes(head + names + types + b"\0" * 16 + body)
    ds = indexed.read_indexed(spark, indexed.frame_index(spark, str(tmp_path / "a.parcas"), "parcas"), "parcas", at_once=2)
    assert rows_of(ds, "Particle Identifier", "Particle Type", *POSITION, "Potential Energy", "Heat") == [(0, k, 5 - k, 2 if k else 1, k, 2 * k, 3 * k, -k, 0.5 * k) for k in range(3)]
    c = ds.cells.first()
    assert (c.ax, c["by"], c.cz, c.ox, c.oy, c.oz, c.px, c.py, c.pz) == (10, 20, 30, -5, -10, -15, True, False, True)
    assert {r.key: r.num for r in ds.attributes.collect()} == {"Timestep": 7.0, "Time": 2.5}
    assert {r.id: r.name for r in ds.types.collect()} == {1: "Fe", 2: "Cr"}
    (tmp_path / "b.parcas").write_bytes((head + names + types + b"\0" * 16 + body)[:-1])
    with pytest.raises(Exception, match="breaks off"):
        indexed.frame_index(spark, str(tmp_path / "b.parcas"), "parcas")


def gsd(frames, version=1 << 16):
    """Frames are {chunk: array}; a file of the published layout."""
    kinds = {np.dtype(k): n + 1 for n, k in enumerate(indexed.GSD_KINDS)}
    names = sorted({c for f in frames for c in f})
    data, entries = b"", b""
    for k, f in enumerate(frames):
        for c, a in f.items():
            a = np.asarray(a)
            entries += struct.pack("<QQqIHBB", k, len(a), 256 + len(data), a.size // len(a) if len(a) else 1, names.index(c), kinds[a.dtype], 0)
            data += a.tobytes()
    listed = b"".join(x.encode() + b"\0" for x in names).ljust(64 * len(names), b"\0") if version >= 2 << 16 else b"".join(x.encode().ljust(64, b"\0") for x in names)
    at = 256 + len(data)
    entries += b"\0" * 64
    head = struct.pack("<5Q", 0x65DF65DF65DF65DF, at, len(entries) // 32, at + len(entries), len(names)) + struct.pack("<II64s64s80s", 1 << 16, version, b"test", b"hoomd", b"")
    return head + data + entries + listed


@pytest.mark.parametrize("version", [1 << 16, 2 << 16])
def test_gsd(spark, tmp_path, version):
    f4 = lambda *x: np.array(x, "<f4")
    names = np.frombuffer(b"A\0\0\0Big\0", "u1").reshape(2, 4)
    first = {
        "configuration/step": np.array([10], "<u8"), "configuration/box": f4(10, 20, 30, 0.5, 0, 0), "particles/N": np.array([3], "<u4"), "particles/types": names, "particles/typeid": np.array([0, 1, 1], "<u4"),
        "particles/position": f4([-4, 0, 0], [4, 0, 0], [1, 2, 3]), "particles/diameter": f4(1, 2, 4), "particles/orientation": f4([1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1]), "bonds/N": np.array([2], "<u4"), "bonds/group": np.array([[0, 1], [1, 2]], "<u4"),
    }
    then = {"configuration/step": np.array([20], "<u8"), "particles/position": f4([0, 0, 0], [1, 0, 0], [2, 0, 0])}
    less = {"configuration/step": np.array([30], "<u8"), "particles/N": np.array([1], "<u4"), "particles/position": f4([7, 0, 0]), "bonds/N": np.array([0], "<u4"), "configuration/dimensions": np.array([2], "u1")}
    (tmp_path / "a.gsd").write_bytes(gsd([first, then, less], version))
    ds = indexed.read_indexed(spark, indexed.frame_index(spark, str(tmp_path / "a.gsd"), "gsd"), "gsd", at_once=2)
    assert rows_of(ds, "Position.X", "Particle Type", "Radius", "Orientation.W") == [(0, 0, -4, 0, 0.5, 1), (0, 1, 4, 1, 1, 0), (0, 2, 1, 1, 2, 0), (1, 0, 0, 0, 0.5, 1), (1, 1, 1, 1, 1, 0), (1, 2, 2, 1, 2, 0), (2, 0, 7, None, None, None)]
    cells = {r.frame: r for r in ds.cells.collect()}
    assert (cells[0].ax, cells[0].bx, cells[0]["by"], cells[0].ox, cells[0].oz, cells[0].px, cells[2].is2d) == (10, 10, 20, -10, -15, True, True)
    assert {r.frame: r.num for r in ds.attributes.collect()} == {0: 10, 1: 20, 2: 30} and {r.id: r.name for r in ds.types.collect()} == {0: "A", 1: "Big"}
    # Over the border in the first frame: the image that is nearest.
    got = sorted((r.frame, r.bidx, r.i, r.j, r.sx) for r in ds.bonds.collect())
    assert got == [(0, 0, 0, 1, -1), (0, 1, 1, 0, 1), (0, 2, 1, 2, 0), (0, 3, 2, 1, 0), (1, 0, 0, 1, 0), (1, 1, 1, 0, 0), (1, 2, 1, 2, 0), (1, 3, 2, 1, 0)]


def netcdf(dims, variables, records, facts):
    """Classic layout: variables are (name, dimensions by number, type, array); the first dimension is the one of records."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    pad = lambda raw: raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    code = {v: k for k, v in indexed.NC_KINDS.items()}

    def head(begins):
        out = b"CDF\2" + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(text(n) + struct.pack(">i", m) for n, m in dims)
        out += struct.pack(">ii", 12, len(facts)) + b"".join(text(k) + struct.pack(">i", 2) + text(v) for k, v in facts.items())
        out += struct.pack(">ii", 11, len(variables))
        for (name, ds, kind, a), b in zip(variables, begins):
            out += text(name) + struct.pack(">i", len(ds)) + b"".join(struct.pack(">i", d) for d in ds) + struct.pack(">ii", 0, 0) + struct.pack(">iiq", code[kind], 0, b)
        return out

    still = [v for v in variables if v[1][0] != 0]
    moving = [v for v in variables if v[1][0] == 0]
    raw = lambda kind, a: pad(np.asarray(a).astype(f">{kind}").tobytes())
    at, begins = len(head([0] * len(variables))), {}
    for name, _, kind, a in still:
        begins[name], at = at, at + len(raw(kind, a))
    for name, _, kind, a in moving:
        begins[name], at = at, at + len(raw(kind, a[0]))
    return head([begins[v[0]] for v in variables]) + b"".join(raw(kind, a) for _, _, kind, a in still) + b"".join(raw(kind, a[k]) for k in range(records) for _, _, kind, a in moving)


def test_netcdf(spark, tmp_path):
    dims = [("frame", 0), ("atom", 3), ("spatial", 3), ("Voigt", 6), ("label", 5), ("cell_spatial", 3), ("cell_angular", 3)]
    x = np.arange(18.0).reshape(2, 3, 3)
    x[1, 2] = indexed.NC_FILL
    variables = [
        ("element", [1, 4], "S1", np.frombuffer(b"Fe\0\0\0C\0\0\0\0Fe\0\0\0", "S1")), ("coordinates", [0, 1, 2], "f4", x), ("id", [0, 1], "i2", np.array([[3, 2, 1], [1, 2, 3]])), ("time", [0], "f8", np.array([0.5, 1.5])),
        ("cell_lengths", [0, 5], "f8", np.array([[10, 20, 0], [10, 20, 0]])), ("cell_angles", [0, 6], "f8", np.full((2, 3), 90.0)), ("strain", [0, 1, 3], "f8", np.arange(36.0).reshape(2, 3, 6)), ("stress", [0, 1, 2, 2], "f8", np.arange(54.0).reshape(2, 3, 3, 3)),
    ]
    (tmp_path / "a.nc").write_bytes(netcdf(dims, variables, 2, {"Conventions": "AMBER", "title": "two frames"}))
    ds = indexed.read_indexed(spark, indexed.frame_index(spark, str(tmp_path / "a.nc"), "netcdf"), "netcdf", at_once=2)
    # Types are numbered by name; the particle of the last frame that is only filled is gone.
    want = [(f, k, *x[f, k], [2, 1, 2][k], int(variables[2][3][f, k])) for f in range(2) for k in range(3 - f)]
    assert rows_of(ds, *POSITION, "Particle Type", "Particle Identifier") == want
    r = ds.particles.where("frame = 1 AND idx = 1").first()
    assert [r[f"strain.{k}"] for k in range(1, 7)] == list(range(24, 30))
    assert [r[f"stress.{k}"] for k in range(1, 7)] == [36, 40, 44, 42, 40, 38]
    assert {(r.frame, r.key): r.num if r.str is None else r.str for r in ds.attributes.collect()} == {(0, "time"): 0.5, (1, "time"): 1.5, (0, "NetCDF_Title"): "two frames", (1, "NetCDF_Title"): "two frames"}
    c = ds.cells.where("frame = 0").first()
    assert (c.ax, c["by"], c.cz, c.px, c.py, c.pz) == (10, 20, 0, True, True, False) and {r.id: r.name for r in ds.types.collect()} == {1: "C", 2: "Fe"}
    (tmp_path / "b.nc").write_bytes(netcdf(dims, variables, 2, {"Conventions": "CF"}))
    with pytest.raises(Exception, match="conventions"):
        indexed.frame_index(spark, str(tmp_path / "b.nc"), "netcdf")


def dump_text(frames, mark="ITEM: TIMESTEP"):
    return "".join(f"{mark}\n{step}\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS pp pp ff\n0 10\n0 10\n0 10\nITEM: ATOMS id x y z\n" + "".join(f"{k} {step + k} 0 1\n" for k in range(n)) for step, n in frames)


def test_text_dump_across_blocks(spark, tmp_path, monkeypatch):
    frames = [(k, k % 4) for k in range(60)]
    (tmp_path / "b10.dump").write_text("ITEM: UNITS\nmetal\n" + dump_text(frames))
    (tmp_path / "b9.dump").write_text(dump_text([(1000, 2)]))
    whole = indexed.frame_index(spark, str(tmp_path / "*.dump"), "dump")
    # Blocks so short that marks lie across their borders.
    monkeypatch.setattr(indexed, "BLOCK", 37)
    index = indexed.frame_index(spark, str(tmp_path / "*.dump"), "dump")
    order = ["frame", "path", "begin", "end"]
    assert index.select(order).orderBy(order).collect() == whole.select(order).orderBy(order).collect()
    ds = indexed.read_indexed(spark, index, "dump")
    want = [(0, k, 1000.0 + k) for k in range(2)] + [(f + 1, k, float(step + k)) for f, (step, n) in enumerate(frames) for k in range(n)]
    assert rows_of(ds, "Position.X") == want and ds.cells.count() == 61
    some = indexed.read_indexed(spark, index.where("frame IN (4, 40)"), "dump")
    assert rows_of(some, "Position.X") == [r for r in want if r[0] in (4, 40)]


def test_xyz_of_many_frames(spark, tmp_path):
    text = "".join(f'{n}\nLattice="5 0 0 0 5 0 0 0 5" step={k}\n' + "".join(f"{'HO'[j % 2]} {k} {j} 0\n" for j in range(n)) for k, n in enumerate((2, 0, 3)))
    (tmp_path / "a.xyz").write_text(text)
    ds = indexed.read_indexed(spark, indexed.frame_index(spark, str(tmp_path / "a.xyz"), "xyz"), "xyz")
    assert rows_of(ds, "Position.X", "Position.Y", "Particle Type") == [(f, j, f, j, 1 + j % 2 == 1 and 1 or 2) for f, n in ((0, 2), (2, 3)) for j in range(n)]
    assert {r.frame: r.num for r in ds.attributes.where("key = 'step'").collect()} == {0: 0, 1: 1, 2: 2}


def test_files_of_nothing(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("")
    (tmp_path / "a.dump").write_text("")
    for kind in ("xyz", "dump"):
        index = indexed.frame_index(spark, str(tmp_path / f"a.{kind}"), kind)
        assert index.count() == 0 and indexed.read_indexed(spark, index, kind).particles.count() == 0


def tilted(spark, n=25):
    from sparktraj.dataset import Dataset, cells_of

    rng = np.random.default_rng(4)
    rows = [(f, k, 100 + k, 1 + k % 3, *map(float, rng.random(3) * 9)) for f in range(2) for k in range(n - 5 * f)]
    p = spark.createDataFrame(rows, "frame int, idx long, `Particle Identifier` long, `Particle Type` int, " + ", ".join(f"`{c}` double" for c in POSITION)).repartition(5, "idx")
    cells = cells_of(spark, [(f, 10.0, 0.0, 0.0, 2.0, 9.0, 0.0, -1.0, 0.5, 8.0, 1.0, 2.0, 3.0, True, True, True, False) for f in range(3)])
    return Dataset(p, cells).with_attributes(spark.createDataFrame([(0, "Timestep", 50.0), (1, "Timestep", 70.0)], "frame int, key string, num double"))


@pytest.mark.parametrize("kind", ["binary_dump", "netcdf"])
def test_written_and_read_back(spark, tmp_path, kind):
    from sparktraj.sources import binary_writers as w

    ds, names = tilted(spark), ["Particle Identifier", "Particle Type", *POSITION]
    pieces = w.binary_dump_pieces(ds, names, chunk=7) if kind == "binary_dump" else w.netcdf_pieces(ds, names, ("Timestep",))
    files = w.write_pieces(pieces, f"file://{tmp_path}/out", ".bin")
    assert {r.frame: (tmp_path / "out" / f"{r.frame}.bin").stat().st_size == r["size"] for r in files.collect()} == {0: True, 1: True, 2: True}
    options = {"columns": names} if kind == "binary_dump" else {}
    back = indexed.read_indexed(spark, indexed.frame_index(spark, f"{tmp_path}/out/*.bin", kind, **options), kind, at_once=4)
    assert rows_of(back, *names) == rows_of(ds, *names)
    got = {r.frame: r for r in back.cells.collect()}
    for r in ds.cells.collect():
        assert list(got[r.frame])[1:13] == pytest.approx(list(r)[1:13], abs=1e-9) and list(got[r.frame])[13:] == list(r)[13:]
    steps = {r.frame: r.num for r in back.attributes.where("key = 'Timestep'").collect()}
    assert steps[0] == 50 and steps[1] == 70 and (steps[2] == 2 if kind == "binary_dump" else np.isnan(steps[2]))


def test_what_cannot_be_written(spark, tmp_path):
    from sparktraj.sources import binary_writers as w

    ds = tilted(spark)
    gaps = ds.having(particles=ds.particles.where("idx <> 3"))
    with pytest.raises(Exception, match="without gaps"):
        w.write_pieces(w.binary_dump_pieces(gaps, list(POSITION)), f"file://{tmp_path}/a", ".bin")
    none = ds.having(particles=ds.particles.withColumn("Particle Type", F.when(F.col("idx") > 0, col("Particle Type"))))
    with pytest.raises(Exception, match="missing values"):
        w.write_pieces(w.netcdf_pieces(none, ["Particle Type"]), f"file://{tmp_path}/b", ".nc")


LOG = """  Invoking FHI-aims ...
  | Number of atoms: 2
  atom 9 9 9 X
  Updated atomic structure:
                         x [A]             y [A]             z [A]
  lattice_vector         4.0               0.0               0.0
  lattice_vector         0.0               5.0               0.0
  lattice_vector         0.0               0.0               6.0

            atom         1.0               2.0               {0}.0  Si
       atom_frac         0.5               0.5               0.5  C
  Fractional coordinates:
            atom_frac    0.1 0.1 0.1 Si
"""


def test_log_of_a_run(spark, tmp_path, monkeypatch):
    step = LOG[LOG.index("  Updated") :]
    (tmp_path / "run.out").write_text(LOG.format(0) + "".join(step.format(k) for k in range(1, 5)))
    want = [(f, k, *p, t) for f in range(5) for k, (p, t) in enumerate([((1, 2, f), 2), ((2, 2.5, 3), 1)])]
    assert rows_of(readers.read_frames(spark, str(tmp_path / "run.out")), *POSITION, "Particle Type") == want
    monkeypatch.setattr(indexed, "BLOCK", 61)
    index = indexed.frame_index(spark, str(tmp_path / "run.out"), "aims_log")
    ds = indexed.read_indexed(spark, index, "aims_log")
    assert rows_of(ds, *POSITION, "Particle Type") == want and {(r.ax, r["by"], r.cz) for r in ds.cells.collect()} == {(4.0, 5.0, 6.0)}
    with pytest.raises(ValueError):
        list(readers.parse_aims_log("Updated atomic structure:\n\nnothing"))
