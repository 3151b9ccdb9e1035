"""Trajectories by byte ranges: an index has a row for each stretch of a frame's particles, and tasks read only the ranges that are asked for.

The index is a table: ``frame_index(...).where("frame = 5")`` is what ``read_indexed`` then opens, so frames are pruned before anything is read, and ``properties``
prunes columns.  Binary formats (LAMMPS binary dumps, PARCAS, GSD, classic NetCDF in AMBER's conventions) keep a particle's values at fixed distances, so a frame is read by
as many tasks as its particles make stretches of ``AT_ONCE``; only headers are read to index them.  Text frames (dumps, XYZ, logs of FHI-aims) are read by one task each.  Files aren't limited in size,
but must not be compressed.  They are opened by ``pyarrow.fs``, which knows local, HDFS and S3 paths.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import CELL, POSITION, Dataset, col, on_workers, stage
from sparktraj.sources import readers

#: Particles that a task reads at a time.
AT_ONCE = 200_000
#: Bytes of a text file in which a task looks for frames.
BLOCK = 64 << 20
#: A row a stretch of particles: ``first`` to ``first + count`` of the frame's ``n``.  Field values are numbers of numpy's ``kind``, the first at byte ``at``, ``step`` bytes apart, and are
#: multiplied by ``factor``; fields of one name are added up.  Text frames have no fields but the range ``begin`` to ``end``.  Cells, facts, types and bonds come with the stretch that has ``first`` 0.
INDEX = (
    "path string, part int, n long, first long, count long, begin long, end long, fields array<struct<name: string, kind: string, at: bigint, step: bigint, factor: double>>, cell array<double>, "
    "facts array<struct<key: string, num: double, str: string>>, types array<struct<id: int, name: string>>, bonds array<struct<at: bigint, n: bigint>>"
)


def _open(path: str) -> Any:
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _field(name: str, kind: str, at: int, step: int, factor: float = 1.0) -> dict:
    return {"name": name, "kind": kind, "at": at, "step": step, "factor": factor}


def _facts(values: dict[str, float | str]) -> list[dict]:
    return [{"key": k, "num": v if isinstance(v, float) else None, "str": v if isinstance(v, str) else None} for k, v in values.items()]


def _row(part: int, n: int, first: int = 0, count: int | None = None, fields=(), cell=None, facts=None, types=(), bonds=(), begin=None, end=None) -> dict:
    return {
        "part": part, "n": n, "first": first, "count": n if count is None else count, "begin": begin, "end": end, "fields": list(fields), "cell": None if cell is None else [float(x) for x in cell],
        "facts": _facts(facts or {}), "types": [{"id": k, "name": v} for k, v in types], "bonds": [{"at": a, "n": m} for a, m in bonds],
    }


def _take(f: BinaryIO, layout: str, at: int | None = None) -> tuple:
    if at is not None:
        f.seek(at)
    size = struct.calcsize(layout)
    raw = f.read(size)
    if len(raw) < size:
        raise ValueError("a file breaks off")
    return struct.unpack(layout, raw)


def index_binary_dump(f: BinaryIO, size: int, columns: list[str | None]) -> Iterator[dict]:
    """Each chunk of a frame is a stretch.  ``columns`` names the values of a particle."""

    def fits(order: str, wide: str) -> bool:
        try:
            step, n, triclinic = _take(f, f"{order}{wide}{wide}i", 0)
            if not (0 <= n < 10**12 and 0 <= step < 10**15 and triclinic in (0, 1)):
                return False
            width, chunks = _take(f, f"{order}ii", struct.calcsize(f"{order}{wide}{wide}i") + 24 + 8 * (9 if triclinic else 6))
        except ValueError:
            return False
        return 1 <= width <= 10_000 and 1 <= chunks <= 10**6

    if not size:
        return
    order, wide = next(((o, w) for o in "<>" for w in "qi" if fits(o, w)), (None, None))
    if order is None:
        raise ValueError("not a binary dump")
    at, part = 0, 0
    while at < size:
        step, n, triclinic = _take(f, f"{order}{wide}{wide}i", at)
        sides = np.array(_take(f, f"{order}6i")).reshape(3, 2)
        bounds = np.array(_take(f, f"{order}{9 if triclinic else 6}d"))
        width, chunks = _take(f, f"{order}ii")
        if not columns or len(columns) > width:
            raise ValueError("the columns don't fit the file")
        lo, hi = bounds[:6:2].copy(), bounds[1:6:2].copy()
        xy, xz, yz = bounds[6:] if triclinic else (0.0, 0.0, 0.0)
        lo[0], hi[0] = lo[0] - min(0, xy, xz, xy + xz), hi[0] - max(0, xy, xz, xy + xz)
        lo[1], hi[1] = lo[1] - min(0, yz), hi[1] - max(0, yz)
        cell = readers._cell(np.array([[hi[0] - lo[0], 0, 0], [xy, hi[1] - lo[1], 0], [xz, yz, hi[2] - lo[2]]]), lo, tuple((sides == 0).all(axis=1)))
        at, first, rows = f.tell(), 0, []
        for _ in range(chunks):
            (values,) = _take(f, f"{order}i", at)
            if values % width or at + 4 + 8 * values > size:
                raise ValueError("a file breaks off")
            if values:
                fields = [_field(c, f"{order}f8", at + 4 + 8 * k, 8 * width) for k, c in enumerate(columns) if c]
                rows.append(_row(part, n, first, values // width, fields, None if first else cell, None if first else {"Timestep": float(step)}))
            first, at = first + values // width, at + 4 + 8 * values
        if first != n:
            raise ValueError("a frame's chunks don't hold its particles")
        yield from rows or [_row(part, 0, cell=cell, facts={"Timestep": float(step)})]
        part += 1


def index_parcas(f: BinaryIO, size: int) -> Iterator[dict]:
    """Records of fixed width behind a header; sides below zero are periodic ones, and the box is centred on the origin."""
    mark = _take(f, "<ii", 0)[1]
    order = "<" if mark == 0x11223344 else ">"
    if _take(f, f"{order}ii", 0)[1] != 0x11223344:
        raise ValueError("not a PARCAS file")
    _version, real = _take(f, f"{order}ii")
    names_at, atoms_at = _take(f, f"{order}qq")
    number, _part, _parts, extra = _take(f, f"{order}4i")
    (n,) = _take(f, f"{order}q")
    least, most, _cpus = _take(f, f"{order}3i")
    time, _scale, *sides = _take(f, f"{order}5d")
    if real not in (4, 8):
        raise ValueError("reals must have 4 or 8 bytes")
    known = {"Epot": "Potential Energy", "Ekin": "Kinetic Energy"}
    clean = lambda raw: raw.split(b"\0")[0].decode("latin-1").strip()
    extras = [known.get(x, x) for x in (clean(_take(f, "4s4s")[0]) for _ in range(extra))]
    types = [(k, clean(_take(f, "4s")[0])) for k in range(least, most + 1)]
    if not f.tell() <= max(names_at, f.tell()) <= atoms_at or f.tell() > atoms_at:
        raise ValueError("a header's offsets are wrong")
    step = 12 + real * (3 + len(extras))
    if atoms_at + n * step > size:
        raise ValueError("a file breaks off")
    fields = [_field("Particle Identifier", f"{order}i8", atoms_at, step), _field("Particle Type", f"{order}i4", atoms_at + 8, step)]
    places = {c: k for k, c in reversed(list(enumerate([*POSITION, *extras])))}
    fields += [_field(c, f"{order}f{real}", atoms_at + 12 + real * k, step) for c, k in places.items()]
    box = np.abs(sides)
    yield _row(0, n, fields=fields, cell=readers._cell(np.diag(box), -box / 2, tuple(s < 0 for s in sides)), facts={"Timestep": float(number), "Time": time}, types=types)


#: Types of numbers in GSD files, from 1, and its chunks of particle values.
GSD_KINDS = ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8")
GSD_CHUNKS = {
    "particles/position": POSITION, "particles/typeid": ("Particle Type",), "particles/mass": ("Mass",), "particles/charge": ("Charge",), "particles/velocity": ("Velocity.X", "Velocity.Y", "Velocity.Z"),
    "particles/diameter": ("Radius",), "particles/orientation": ("Orientation.W", "Orientation.X", "Orientation.Y", "Orientation.Z"),
}


def index_gsd(f: BinaryIO, size: int) -> Iterator[dict]:
    """Frames from a file's own index of chunks.  By the schema's rule a chunk that a frame lacks is that of frame 0, if that has as many rows as the frame has particles."""
    magic, at, room, names_at, names_room = _take(f, "<5Q", 0)
    _schema, version, _application, schema = _take(f, "<II64s64s")
    if magic != 0x65DF65DF65DF65DF or schema.split(b"\0")[0] != b"hoomd":
        raise ValueError("not a GSD file of the hoomd schema")
    f.seek(names_at)
    raw = f.read(64 * names_room)
    names = [x.decode() for x in raw.split(b"\0") if x] if version >= 2 << 16 else [x.split(b"\0")[0].decode() for x in (raw[k : k + 64] for k in range(0, len(raw), 64))]
    f.seek(at)
    entries = np.frombuffer(f.read(32 * room), [("frame", "<u8"), ("n", "<u8"), ("at", "<i8"), ("m", "<u4"), ("id", "<u2"), ("type", "u1"), ("flags", "u1")])
    entries = entries[entries["at"] != 0]
    entries = entries[np.argsort(entries["frame"], kind="stable")]
    cuts = np.flatnonzero(np.diff(entries["frame"])) + 1
    first: dict[str, tuple] = {}
    of_frame = {int(part["frame"][0]): part for part in np.split(entries, cuts)} if len(entries) else {}
    for frame in range(max(of_frame, default=-1) + 1):
        own = {names[e["id"]]: (int(e["n"]), int(e["m"]), int(e["at"]), GSD_KINDS[e["type"] - 1]) for e in of_frame.get(frame, ())}
        first = own if frame == 0 else first
        chunks = first | own

        def values(name: str, default: list) -> list:
            if name not in chunks:
                return default
            rows, width, start, kind = chunks[name]
            f.seek(start)
            return np.frombuffer(f.read(rows * width * int(kind[1])), f"<{kind}").tolist()

        n = int(values("particles/N", [0])[0])
        x, y, z, xy, xz, yz = values("configuration/box", [1, 1, 1, 0, 0, 0])
        vectors = np.array([[x, 0, 0], [xy * y, y, 0], [xz * z, yz * z, z]], float)
        fields = []
        for name, properties in GSD_CHUNKS.items():
            if name not in chunks or chunks[name][0] != n:
                if name in own:
                    raise ValueError(f"chunk {name} doesn't have a row a particle")
                continue
            _, width, start, kind = chunks[name]
            fields += [_field(c, f"<{kind}", start + k * int(kind[1]), width * int(kind[1]), 0.5 if c == "Radius" else 1.0) for k, c in enumerate(properties)]
        kinds = ["A"]
        if "particles/types" in chunks:
            rows, width, start, _ = chunks["particles/types"]
            f.seek(start)
            raw = f.read(rows * width)
            kinds = [raw[k * width : (k + 1) * width].split(b"\0")[0].decode() for k in range(rows)] or kinds
        m = int(values("bonds/N", [0])[0])
        if m and ("bonds/group" not in chunks or chunks["bonds/group"][0] != m):
            raise ValueError("the list of bonds isn't as long as said")
        flat = int(values("configuration/dimensions", [3])[0]) == 2
        yield _row(frame, n, fields=fields, cell=readers._cell(vectors, -vectors.sum(axis=0) / 2, is2d=flat), facts={"Timestep": float(values("configuration/step", [0])[0])}, types=enumerate(kinds), bonds=[(chunks["bonds/group"][2], m)] if m else [])


#: Types of numbers in classic NetCDF files, and properties by variable.
NC_KINDS = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
NC_FILL = 9.969209968386869e36
NC_VARIABLES = {
    "coordinates": "Position", "unwrapped_coordinates": "Position", "velocities": "Velocity", "id": "Particle Identifier", "identifier": "Particle Identifier", "type": "Particle Type",
    "element": "Particle Type", "atom_types": "Particle Type", "species": "Particle Type", "mass": "Mass", "radius": "Radius", "c_cna": "Structure Type", "pattern": "Structure Type",
    "c_epot": "Potential Energy", "c_kpot": "Kinetic Energy", "selection": "Selection", "forces": "Force", "force": "Force",
    "c_stress[1]": "Stress Tensor.XX", "c_stress[2]": "Stress Tensor.YY", "c_stress[3]": "Stress Tensor.ZZ", "c_stress[4]": "Stress Tensor.XY", "c_stress[5]": "Stress Tensor.XZ", "c_stress[6]": "Stress Tensor.YZ",
}
#: Which of nine components make the six of a symmetric tensor, XX, YY, ZZ, YZ, XZ, XY.
NC_SYMMETRIC = ((0,), (4,), (8,), (5, 7), (2, 6), (1, 3))


def _nc_header(f: BinaryIO, size: int) -> tuple[list[tuple[str, int]], dict[str, Any], list[tuple], int]:
    """Dimensions, attributes of the file, variables (name, dimensions, kind, begin), and the number of records."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3:] not in (b"\1", b"\2", b"\5"):
        raise ValueError("not a classic NetCDF file")
    count = lambda: _take(f, ">q" if magic[3] == 5 else ">i")[0]
    text = lambda n: f.read(-(-n // 4) * 4)[:n]

    def listed(what: Callable[[], Any]) -> list:
        _tag, n = _take(f, ">i")[0], count()
        return [what() for _ in range(n)]

    def attribute() -> tuple[str, Any]:
        name, kind, n = text(count()).decode(), NC_KINDS[_take(f, ">i")[0]], count()
        raw = text(n * int(kind[1]))
        return name, raw.rstrip(b"\0").decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, f">{kind}").tolist()

    def variable() -> tuple:
        name = text(count()).decode()
        dims = [count() for _ in range(count())]
        listed(attribute)
        kind = NC_KINDS[_take(f, ">i")[0]]
        count()  # the size as written is wrong for large variables
        return name, dims, kind, _take(f, ">i" if magic[3] == 1 else ">q")[0]

    records = count()
    dims = listed(lambda: (text(count()).decode(), count()))
    facts, variables = dict(listed(attribute)), listed(variable)
    return dims, facts, variables, records


def index_netcdf(f: BinaryIO, size: int) -> Iterator[dict]:
    """Variables over atoms, with or without frames, are properties; variables over frames alone are attributes.  Sides of length 0 aren't periodic."""
    f.seek(0)
    dims, facts, variables, records = _nc_header(f, size)
    if facts.get("Conventions") != "AMBER":
        raise ValueError("the file doesn't follow AMBER's conventions")
    length, place = dict(dims), {name: k for k, (name, _) in enumerate(dims)}
    if not {"frame", "atom", "spatial"} <= set(place):
        raise ValueError("the file lacks a dimension of frames, atoms or space")
    unlimited, n = next((k for k, (_, m) in enumerate(dims) if m == 0), None), length["atom"]
    span = lambda ds, kind: int(np.prod([dims[d][1] for d in ds], dtype=np.int64)) * int(kind[1])
    sizes = [span(v[1][1:], v[2]) for v in variables if v[1][:1] == [unlimited]]
    record = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
    if records < 0:  # a file that was still being written
        records = (size - min(v[3] for v in variables if v[1][:1] == [unlimited])) // record if record else 0
    frames = records if place["frame"] == unlimited else length["frame"]
    atoms = {place[d] for d in ("atom", "sph", "dem") if d in place and length[d] == n}
    start = lambda v, k: v[3] + k * (record if v[1][0] == unlimited else span(v[1][1:], v[2]))

    def numbers(name: str, k: int, default: float) -> list[float]:
        v = next((v for v in variables if v[0] == name and v[1][:1] == [place["frame"]]), None)
        if v is None:
            return [default] * 3
        f.seek(start(v, k))
        return np.frombuffer(f.read(3 * int(v[2][1])), f">{v[2]}").astype(float).tolist()

    for k in range(frames):
        fields: dict[str, list[dict]] = {}
        for v in variables:
            name, ds, kind, begin = v
            moving = ds[:1] == [place["frame"]]
            inner = ds[1:] if moving else ds
            if not inner or inner[0] not in atoms:
                continue
            at, rest, one = start(v, k) if moving else begin, [dims[d] for d in inner[1:]], int(kind[1])
            prop = NC_VARIABLES.get(name.lower(), name)  # of several variables of a property the last one counts
            step = span(inner[1:], kind)
            if kind == "S1":
                if len(rest) == 1:  # names, padded
                    fields[prop] = [_field(prop, f"S{rest[0][1]}", at, step)]
                continue
            names = [f"{prop}.{c}" for c in ("XYZ" if prop in ("Position", "Velocity", "Force") else range(1, 7))]
            shape = tuple(d for d, _ in rest)
            if shape == ():
                fields[prop] = [_field(prop, f">{kind}", at, step)]
            elif shape in (("spatial",), ("Voigt",)):
                fields[prop] = [_field(c, f">{kind}", at + one * j, step) for j, c in enumerate(names[: rest[0][1]])]
            elif shape == ("spatial", "spatial"):
                fields[prop] = [_field(c, f">{kind}", at + one * j, step, 1 / len(js)) for c, js in zip(names, NC_SYMMETRIC) for j in js]
        values: dict[str, float | str] = {"NetCDF_Title": facts["title"]} if isinstance(facts.get("title"), str) else {}
        for v in variables:
            if v[1] == [place["frame"]] and v[2] != "S1":
                f.seek(start(v, k))
                values[v[0]] = float(np.frombuffer(f.read(int(v[2][1])), f">{v[2]}")[0])
        o, sides, angles, shear = numbers("cell_origin", k, 0.0), numbers("cell_lengths", k, 0.0), numbers("cell_angles", k, 90.0), numbers("shear_dx", k, 0.0)
        al, be, ga = (0.0 if abs(a - 90) < 1e-12 else np.cos(np.radians(a)) for a in angles)
        sine = np.sqrt(1 - ga * ga)
        cy = (al - be * ga) / sine
        vectors = [[sides[0], 0, 0], [sides[1] * ga, sides[1] * sine, 0], [sides[2] * be + shear[0], sides[2] * cy + shear[1], sides[2] * np.sqrt(1 - be * be - cy * cy)]]
        yield _row(k, n, fields=[x for of in fields.values() for x in of], cell=readers._cell(np.array(vectors), o, tuple(abs(s) >= 1e-12 for s in sides)), facts=values)


def index_xyz(f: BinaryIO, size: int) -> Iterator[dict]:
    """Frames of an XYZ file, by walking over its lines."""
    part = 0
    while True:
        begin = f.tell()
        head = f.readline()
        if not head.strip():
            return
        n = int(head.split()[0])
        for _ in range(n + 1):
            if not f.readline():
                raise ValueError("a file breaks off")
        yield _row(part, n, begin=begin, end=f.tell())
        part += 1


INDEXERS: dict[str, Callable[..., Iterator[dict]]] = {"binary_dump": index_binary_dump, "parcas": index_parcas, "gsd": index_gsd, "netcdf": index_netcdf, "xyz": index_xyz}
#: What a frame of a text begins with, at the beginning of a line, and perhaps behind some blanks.
MARKS = {"dump": readers.DUMP_MARK.encode(), "aims_log": readers.AIMS_MARK.encode()}
_BLANKS = 32


def _spread(df: DataFrame, tasks: int) -> DataFrame:
    """Small rows that stand for much work, one by one over tasks; a number that is asked for isn't lowered again."""
    return df.repartition(max(1, tasks))


def _marked(spark: SparkSession, files: DataFrame, mark: bytes) -> DataFrame:
    """Marks of frames are looked for in blocks of the files at once."""
    pattern = re.compile(rb"(?<=\n)[ \t]{0,%d}%s" % (_BLANKS, re.escape(mark)))
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK).cast("long"))).alias("at"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("at").to_pylist()):
                with _open(path) as f:
                    # One byte before the block tells whether a mark begins a line; a mark may end in the next block.
                    lead = min(at, 1)
                    f.seek(at - lead)
                    raw = b"\n" * (1 - lead) + f.read(lead + BLOCK + len(mark) + _BLANKS - 1)
                found = [at + m.start() for m in pattern.finditer(raw)]
                found = [x - 1 for x in found if x - 1 < at + BLOCK]
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array(found, pa.int64())], names=["path", "begin"])

    n = blocks.count()
    found = stage(_spread(blocks, min(n, max(n // 16, spark.sparkContext.defaultParallelism))).mapInArrow(marks, "path string, begin long"), "marks")
    in_file = Window.partitionBy("path").orderBy("begin")
    ends = found.withColumns({"part": F.row_number().over(in_file) - 1, "next": F.lead("begin").over(in_file)}).join(files, "path")
    empty = {f.split()[0]: F.lit(None).cast(f.split(maxsplit=1)[1]) for f in re.split(r", (?=\w+ (?:string|long|int|array<))", INDEX)}
    return ends.select(*((empty | {"path": F.col("path"), "part": F.col("part"), "begin": F.col("begin"), "end": F.coalesce("next", "length"), "first": F.lit(0).cast("long")})[c].alias(c) for c in empty))


def frame_index(spark: SparkSession, path: str, format_: str, **options) -> DataFrame:
    """The index of one file or a glob: ``INDEX`` behind ``frame``, which counts frames over files in natural order.

    ``format_``: dump, xyz, aims_log, binary_dump (with ``columns``), parcas, gsd or netcdf.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    on_workers(spark)
    if format_ in MARKS:
        rows = _marked(spark, files, MARKS[format_])
    else:
        kinds = pa.schema([("path", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in ("n", "first", "count", "begin", "end")), ("fields", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("step", pa.int64()), ("factor", pa.float64())]))), ("cell", pa.list_(pa.float64())), ("facts", pa.list_(pa.struct([("key", pa.string()), ("num", pa.float64()), ("str", pa.string())]))), ("types", pa.list_(pa.struct([("id", pa.int32()), ("name", pa.string())]))), ("bonds", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))])

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                    rows: list[dict] = []
                    with io.BufferedReader(_open(name), 1 << 16) as f:
                        for row in INDEXERS[format_](f, size, **options):
                            rows.append({"path": name, **row})
                            if len(rows) == 1000:
                                yield pa.RecordBatch.from_pylist(rows, kinds)
                                rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

        rows = _spread(files, max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(index, INDEX)
    rows = stage(rows, "index")
    # A row a frame: their numbering is a window over a small table.
    order = rows.where("first = 0").select("path", "part", readers.natural_key(F.col("path")).alias("key"))
    numbered = order.withColumn("frame", (F.row_number().over(Window.orderBy("key", "path", "part")) - 1).cast("int")).select("path", "part", "frame")
    return stage(rows.join(numbered, ["path", "part"]).select("frame", *rows.columns), "frame-index")


def _read_fields(f: Any, fields: list[dict], skip: int, count: int) -> dict[str, np.ndarray]:
    """The values of some particles, from as many reads as there are interleaved blocks of fields."""
    out, groups = {}, []
    for x in sorted(fields, key=lambda x: (x["step"], x["at"])):
        if groups and groups[-1][0]["step"] == x["step"] and x["at"] - groups[-1][0]["at"] < x["step"]:
            groups[-1].append(x)
        else:
            groups.append([x])
    for group in groups:
        base, step = group[0]["at"], group[0]["step"]
        width = max(x["at"] - base + np.dtype(x["kind"]).itemsize for x in group)
        f.seek(base + skip * step)
        raw = f.read((count - 1) * step + width)
        if len(raw) < (count - 1) * step + width:
            raise ValueError("a file breaks off")
        for x in group:
            v = np.ndarray((count,), x["kind"], raw, x["at"] - base, (step,))
            if v.dtype.kind == "S":
                out[x["name"]] = np.array([w.split(b"\0")[0].decode("utf-8", "replace").strip() for w in v], object)
            else:
                v = v.astype(float) * x["factor"] if x["factor"] != 1 or v.dtype.kind == "f" else v.astype(np.int64)
                out[x["name"]] = out[x["name"]] + v if x["name"] in out else v
    return out


def _ranges(index: DataFrame, begin: F.Column, n: F.Column, at_once: int) -> DataFrame:
    """Rows cut into stretches of ``at_once``: lo and m beside them."""
    lo = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(at_once).cast("long"))).alias("lo")
    return index.where(n > 0).select("*", lo).withColumn("m", F.least(F.lit(at_once).cast("long"), n - F.col("lo")))


def read_indexed(spark: SparkSession, index: DataFrame, format_: str, properties: list[str] | None = None, at_once: int = AT_ONCE) -> Dataset:
    """The frames of an index, or of some rows of one (all rows of a frame together), under their numbers.  ``properties``: only these are read, of binary formats.

    Types that are names in the file are numbered by name over all frames read.  Of PARCAS files signs of types are dropped; of NetCDF files particles at a frame's end go from where
    a variable of 4-byte reals is only filled.  Bonds of GSD files go to the nearest image.
    """
    on_workers(spark)
    if format_ in MARKS or format_ == "xyz":
        return _read_text(spark, index, format_)
    wanted = F.col("fields") if properties is None else F.filter("fields", lambda x: x["name"].isin(*properties))
    index = index.withColumn("fields", wanted)
    # A bounded table: a row a property and kind.
    named = {(r.name, r.kind[:1] == "S") for r in index.select(F.explode("fields").alias("f")).select("f.name", F.substring("f.kind", 1, 1).alias("kind")).distinct().collect()}
    worded = {c for c, words in named if words}
    names = sorted({c for c, _ in named} | (set(POSITION) if properties is None else set()))
    kinds = {c: "string" if c in worded else "long" if c == "Particle Identifier" else "int" if c in readers.INTEGERS else "double" for c in names}
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _open(r["path"]) as f:
                    got = _read_fields(f, r["fields"], r["lo"], r["m"])
                if format_ == "parcas" and "Particle Type" in got:
                    got["Particle Type"] = np.abs(got["Particle Type"])
                idx = np.arange(r["lo"], r["lo"] + r["m"]) + r["first"]
                cols = [pa.nulls(r["m"], arrow[kinds[c]]) if c not in got else pa.array([str(x) for x in got[c]] if c in worded else got[c].astype({"long": np.int64, "int": np.int32, "double": float}[kinds[c]]), arrow[kinds[c]]) for c in names]
                yield pa.record_batch([pa.array(np.full(r["m"], r["frame"], np.int32)), pa.array(idx), *cols], names=["frame", "idx", *names])

    cut = _ranges(index.select("frame", "path", "first", "count", "fields"), F.col("first"), F.col("count"), at_once)
    tasks = cut.count()
    schema = "frame int, idx long, " + ", ".join(f"`{c}` {kinds[c]}" for c in names) if names else "frame int, idx long"
    p = _spread(cut, min(tasks, max(tasks // 4, spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)
    frames = index.where("first = 0")
    if format_ == "netcdf":
        floats = [r.name for r in index.select(F.explode("fields").alias("f")).where("f.kind = '>f4'").select("f.name").distinct().collect()]
        if floats:
            p = stage(p, "netcdf")
            last = p.groupBy("frame").agg(F.least(*(F.coalesce(F.max(F.when(col(c) != NC_FILL, F.col("idx"))), F.lit(-1)) for c in floats), F.max("idx")).alias("_last"))
            p = p.join(last, "frame").where("idx <= _last").drop("_last")
    types = frames.select("frame", F.explode("types").alias("t")).groupBy("t.id").agg(F.min_by("t.name", "frame").alias("name")).select(F.lit("Particle Type").alias("property"), "id", "name")
    if worded:
        p = stage(p, "worded")
        types = types.limit(0)
    for c in sorted(worded):
        of = stage(p.select(col(c).alias("name")).where("name IS NOT NULL").distinct().withColumn("id", F.dense_rank().over(Window.orderBy("name"))), "types")
        p = p.join(of.select(F.col("name").alias("_name"), F.col("id").alias("_id")), col(c) == F.col("_name"), "left").withColumn(c, F.col("_id")).drop("_name", "_id")
        types = types.unionByName(of.select(F.lit(c).alias("property"), "id", "name"))
    types = types.select("property", "id", "name", *(F.lit(None).cast("double").alias(c) for c in ("r", "g", "b", "radius")))
    out = Dataset(p.select("frame", "idx", *map(col, names)), _cells(frames), None, types, frames.select("frame", F.explode("facts").alias("f")).select("frame", "f.key", "f.num", "f.str"))
    bonds = frames.select("frame", "path", "n", F.explode("bonds").alias("b")).select("frame", "path", F.col("n").alias("most"), "b.at", "b.n")
    return out if format_ != "gsd" or not set(POSITION) <= set(names) or bonds.isEmpty() else _with_bonds(out, bonds, at_once)


def _cells(frames: DataFrame) -> DataFrame:
    fields = [x.split() for x in CELL.split(", ")][1:]
    return frames.select("frame", *(F.col("cell")[k].cast(t).alias(n) for k, (n, t) in enumerate(fields)))


def _with_bonds(ds: Dataset, bonds: DataFrame, at_once: int) -> Dataset:
    """Two half-bonds for each pair of particle numbers in a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _open(r["path"]) as f:
                    f.seek(r["at"] + 8 * r["lo"])
                    ends = np.frombuffer(f.read(8 * r["m"]), "<u4").reshape(-1, 2).astype(np.int64)
                if len(ends) < r["m"] or (ends >= r["most"]).any():
                    raise ValueError("a bond goes to a particle that isn't there")
                yield pa.record_batch([pa.array(np.full(len(ends), r["frame"], np.int32)), pa.array(np.arange(len(ends)) + r["lo"]), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["frame", "b", "i", "j"])

    cut = _ranges(bonds, F.col("at"), F.col("n"), at_once)
    pairs = _spread(cut, min(cut.count(), 4 * ds.spark.sparkContext.defaultParallelism)).mapInArrow(read, "frame int, b long, i long, j long")
    at = lambda end: ds.particles.select("frame", F.col("idx").alias(end), *(col(c).alias(f"{end}{k}") for c, k in zip(POSITION, "xyz")))
    d = ds.in_cell(pairs.join(at("i"), ["frame", "i"]).join(at("j"), ["frame", "j"]))
    a, b = (g.reduced(tuple(F.col(f"{end}{k}") for k in "xyz")) for end in "ij")
    shift = [F.when(p, -F.floor(t - s + 0.5)).otherwise(0).cast("int") for p, s, t in zip(g.periodic(), a, b)]
    d = d.select("frame", "b", "i", "j", *(s.alias(f"s{k}") for s, k in zip(shift, "xyz")))
    forth = d.select("frame", (2 * F.col("b")).alias("bidx"), "i", "j", "sx", "sy", "sz")
    back = d.select("frame", (2 * F.col("b") + 1).alias("bidx"), F.col("j").alias("i"), F.col("i").alias("j"), *((-F.col(f"s{k}")).alias(f"s{k}") for k in "xyz"))
    return ds.having(bonds=forth.unionByName(back))


def _read_text(spark: SparkSession, index: DataFrame, format_: str) -> Dataset:
    """Frames of text, each by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _open(r["path"]) as f:
                    f.seek(r["begin"])
                    text = f.read(r["end"] - r["begin"]).decode("utf-8", "replace")
                for frame in readers.PARSERS[format_](text):
                    yield from readers._rows(frame, (r["path"], r["begin"], 0, r["frame"]))

    n = index.count()
    some = _spread(index.select("frame", "path", "begin", "end"), min(n, max(n // 4, spark.sparkContext.defaultParallelism)))
    rows = stage(some.mapInArrow(parse, readers._ROW), "parsed").withColumnRenamed("part", "frame")
    frames = rows.where("cell IS NOT NULL")
    particles, types = readers._properties(rows.select("names", "worded").distinct(), rows.where("cell IS NULL"))
    return Dataset(particles, _cells(frames), None, types, frames.select("frame", F.explode("facts").alias("f")).select("frame", "f.key", "f.num", "f.str"))
