"""Writers of binary trajectory files, a file a frame.

A file is rows of bytes in the order of (part, place): its head, and the encoded values of particles.  Spark sorts them, and a task writes a frame's bytes as they come, so
it holds some thousand particles at a time.  Files get their names when they are complete; what an attempt that was lost has left has a name that readers pass over.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, col, on_workers, stage

_PIECES = "frame int, part int, place long, value binary"
_NAMES = ["frame", "part", "place", "value"]
#: Variables of AMBER's conventions by property.
_VARIABLES = {"Position": "coordinates", "Velocity": "velocities", "Force": "forces", "Particle Identifier": "id", "Particle Type": "type", "Mass": "mass", "Radius": "radius", "Selection": "selection"}


def _encoded(values: np.ndarray) -> pa.Array:
    """A row of numbers as one value of bytes each."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _heads(ds: Dataset) -> DataFrame:
    """Of each frame: its cell, the number of its particles, and its numbers among the attributes."""
    d = ds.cells.join(ds.particles.groupBy("frame").agg(F.count("*").alias("n"), F.max("idx").alias("last")), "frame", "left").fillna({"n": 0, "last": -1})
    d = d.withColumn("n", F.when(F.col("last") >= F.col("n"), F.raise_error(F.lit("particles must be numbered from 0 without gaps"))).otherwise(F.col("n"))).drop("last")
    if ds.attributes is None:
        return d.withColumn("facts", F.create_map().cast("map<string, double>"))
    facts = ds.attributes.where("num IS NOT NULL").groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("key", "num"))).alias("facts"))
    return d.join(facts, "frame", "left")


def _lower(r: dict) -> np.ndarray:
    m = np.array([[r[f"{v}{k}"] for k in "xyz"] for v in "abc"])
    if abs(m[0, 1]) + abs(m[0, 2]) + abs(m[1, 2]) > 1e-9 * np.abs(m).max():
        raise ValueError("the format takes only cells whose first edge lies along x and whose second in the plane of x and y")
    return m


def binary_dump_pieces(ds: Dataset, columns: list[str], chunk: int = 10_000) -> DataFrame:
    """LAMMPS binary dumps, little-endian with wide counts, in chunks of ``chunk`` particles.  The step is the attribute ``Timestep``, or the frame's number.  A missing value is NaN."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                m, o, n = _lower(r), [r["ox"], r["oy"], r["oz"]], r["n"]
                xy, xz, yz = m[1, 0], m[2, 0], m[2, 1]
                lo = [o[0] + min(0, xy, xz, xy + xz), o[1] + min(0, yz), o[2]]
                hi = [o[0] + m[0, 0] + max(0, xy, xz, xy + xz), o[1] + m[1, 1] + max(0, yz), o[2] + m[2, 2]]
                tilted = bool(xy or xz or yz)
                step = int(dict(r["facts"] or {}).get("Timestep", r["frame"]))
                raw = struct.pack("<qqi6i", step, n, tilted, *(0 if r[p] else 1 for p in ("px", "px", "py", "py", "pz", "pz"))) + struct.pack("<6d", *(x for pair in zip(lo, hi) for x in pair))
                raw += (struct.pack("<3d", xy, xz, yz) if tilted else b"") + struct.pack("<ii", len(columns), max(1, -(-n // chunk)))
                rows.append((r["frame"], -1, -1, raw))
                rows += [(r["frame"], k, -1, struct.pack("<i", len(columns) * min(chunk, n - k * chunk))) for k in range(max(1, -(-n // chunk)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=_NAMES)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(k + 2).to_numpy(zero_copy_only=False).astype("<f8") for k in range(len(columns))], axis=1)
            idx = b.column("idx").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array((idx // chunk).astype(np.int32)), pa.array(idx), _encoded(values)], names=_NAMES)

    on_workers(ds.spark)
    p = ds.particles.select("frame", F.col("idx").cast("long").alias("idx"), *(col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    return _heads(ds).mapInArrow(head, _PIECES).unionByName(p.mapInArrow(body, _PIECES))


def netcdf_pieces(ds: Dataset, columns: list[str], attributes: tuple[str, ...] = ()) -> DataFrame:
    """Classic NetCDF in AMBER's conventions, a record a file.  Position, Velocity and Force become vectors where ``columns`` has all three parts; integers have 4 bytes, and must not be missing.
    ``attributes`` become variables over frames; one that a frame lacks is NaN."""
    kinds, left, listed = {f.name: f.dataType.typeName() for f in ds.particles.schema.fields}, list(columns), []
    for c in columns:
        stem = c.rpartition(".")[0]
        vector = [f"{stem}.{k}" for k in "XYZ"]
        if stem in ("Position", "Velocity", "Force") and set(vector) <= set(left):
            listed.append((_VARIABLES[stem], vector, "f8"))
            left = [x for x in left if x not in vector]
        elif c in left:
            listed.append((_VARIABLES.get(c, c), [c], "i4" if kinds[c] in ("integer", "long", "short", "byte") else "f8"))
            left.remove(c)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["frame"], 0, 0, _netcdf_head(r, listed, attributes)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=_NAMES)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, (name, parts, kind) in enumerate(listed, 1):
                cols = [b.column(f"v{columns.index(c)}") for c in parts]
                if kind == "i4" and cols[0].null_count:
                    raise ValueError(f"{name} has missing values")
                # Numbers that need more than 4 bytes are an error, not cut.
                values = np.stack([c.cast(pa.int32() if kind == "i4" else pa.float64()).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(f">{kind}")
                yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array(np.full(len(b), part, np.int32)), b.column("idx"), _encoded(values)], names=_NAMES)

    on_workers(ds.spark)
    p = ds.particles.select("frame", F.col("idx").cast("long").alias("idx"), *(col(c).alias(f"v{k}") for k, c in enumerate(columns)))
    return _heads(ds).mapInArrow(head, _PIECES).unionByName(p.mapInArrow(body, _PIECES))


def _netcdf_head(r: dict, listed: list[tuple[str, list[str], str]], attributes: tuple[str, ...]) -> bytes:
    """All that stands before the first variable over atoms; a file with variables beyond 2 GB has wide counts."""
    m, n = _lower(r), r["n"]
    sides = np.linalg.norm(m, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        angles = [np.degrees(np.arccos(m[i] @ m[j] / sides[i] / sides[j])) if sides[i] * sides[j] else 90.0 for i, j in ((1, 2), (0, 2), (0, 1))]
    facts = dict(r["facts"] or {})
    wide = 24 * n >= 1 << 31
    count = (lambda x: struct.pack(">q", x)) if wide else (lambda x: struct.pack(">i", x))
    text = lambda s: count(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    dims = [("frame", 0), ("atom", n), ("spatial", 3), ("cell_spatial", 3), ("cell_angular", 3)]
    periodic = [s if r[p] else 0.0 for s, p in zip(sides, ("px", "py", "pz"))]
    small = [(k, [0], [facts.get(k, np.nan)]) for k in attributes] + [("cell_origin", [0, 3], [r["ox"], r["oy"], r["oz"]]), ("cell_lengths", [0, 3], periodic), ("cell_angles", [0, 4], angles)]
    variables = [(name, ds, "f8", 8 * len(v)) for name, ds, v in small] + [(name, [0, 1, 2] if len(parts) > 1 else [0, 1], kind, int(kind[1]) * len(parts) * n) for name, parts, kind in listed]
    kinds = {"i4": 4, "f8": 6}

    def head(begin: int) -> bytes:
        out = b"CDF" + (b"\5" if wide else b"\2") + count(1) + struct.pack(">i", 10) + count(len(dims)) + b"".join(text(k) + count(v) for k, v in dims)
        out += struct.pack(">i", 12) + count(2) + b"".join(text(k) + struct.pack(">i", 2) + text(v) for k, v in (("Conventions", "AMBER"), ("ConventionVersion", "1.0")))
        out += struct.pack(">i", 11) + count(len(variables))
        for name, ds, kind, size in variables:
            out += text(name) + count(len(ds)) + b"".join(count(d) for d in ds) + struct.pack(">i", 0) + count(0) + struct.pack(">i", kinds[kind]) + count(size) + struct.pack(">q", begin)
            begin += size
        return out

    return head(len(head(0))) + b"".join(np.array(v, ">f8").tobytes() for *_, v in small)


def write_pieces(pieces: DataFrame, folder: str, ending: str) -> DataFrame:
    """Writes ``folder``/<frame><ending> and returns frame, path and size of the files.  ``folder`` is a path or URI that ``pyarrow.fs`` opens, on every executor."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        frame, out, own, done = None, None, "", []

        def finish() -> None:
            if out is not None:
                size = out.tell()
                out.close()
                where.move(own, f"{base}/{frame}{ending}")
                done.append((frame, f"{folder}/{frame}{ending}", size))

        for b in batches:
            frames, values = b.column("frame").to_numpy(), b.column("value")
            ends, data = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(b) + 1], values.buffers()[2]
            starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(b) else np.zeros(0, int)
            for a, e in zip(starts, [*starts[1:], len(b)]):
                if out is None or frames[a] != frame:
                    finish()
                    frame, own = int(frames[a]), f"{base}/.{frames[a]}-{uuid.uuid4().hex}"
                    out = where.open_output_stream(own)
                out.write(data[int(ends[a]) : int(ends[e])])
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 3, (pa.int32(), pa.string(), pa.int64()))], names=["frame", "path", "size"])

    on_workers(pieces.sparkSession)
    dealt = pieces.repartition("frame").sortWithinPartitions("frame", "part", "place")
    return stage(dealt.mapInArrow(write, "frame int, path string, size long"), "written")
