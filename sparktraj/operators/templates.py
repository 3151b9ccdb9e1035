"""Template matching: which ideal shell of neighbours fits a particle's own with the least deviation, and how it is turned, scaled and strained.

A particle's nearest neighbours are one row; batches of rows are fitted at once in numpy.  Neighbours are mapped to a template's
points by alignment: the particle's nearest neighbour and the one most nearly at a right angle to it are laid on each pair of template
points that the template's symmetry doesn't make equal, all neighbours then go to the points next to them, and the fit is repeated.  A mapping counts
if each point has one neighbour.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.dataset import Dataset, col, stage
from sparktraj.operators.analyze import structure_counts
from sparktraj.operators.neighbors import knn
from sparktraj.operators.select import selected
from sparktraj.operators.structure import STRUCTURES, _arrow, _vectors

#: Structure kinds in the order of their ids, and kinds of order in alloys.
KINDS = [*STRUCTURES, "SC"]
ALLOYS = ["NONE", "PURE", "L10", "L12_CU", "L12_AU", "B2"]
#: Rows that are fitted together, and fits per starting position.
ROWS, FITS = 1000, 3


@dataclass(frozen=True)
class Template:
    #: Points at a mean distance of 1 from the centre, rotations that map them onto themselves, and pairs of points to start from.
    points: np.ndarray
    rotations: np.ndarray
    pairs: tuple[tuple[int, int], ...]


def _frames(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Right-angled axes as columns: along a, and in the plane of a and b."""
    x = a / np.linalg.norm(a, axis=-1, keepdims=True)
    z = np.cross(a, b)
    z = z / np.linalg.norm(z, axis=-1, keepdims=True)
    return np.stack([x, np.cross(z, x), z], axis=-1)


def shell(kind: str) -> np.ndarray:
    """The neighbours of a particle in the ideal structure, nearest ones first, at a mean distance of 1."""
    signs = (-1.0, 1.0)
    axes = [tuple(s if k == n else 0.0 for k in range(3)) for n in range(3) for s in signs]
    if kind == "SC":
        p = axes
    elif kind == "FCC":
        p = [tuple(np.insert([a, b], n, 0.0)) for n in range(3) for a in signs for b in signs]
    elif kind == "BCC":
        p = [(a / 2, b / 2, c / 2) for a in signs for b in signs for c in signs] + axes
    elif kind == "ICO":
        golden = (1 + math.sqrt(5)) / 2
        p = [tuple(np.roll([0.0, a, b * golden], n)) for n in range(3) for a in signs for b in signs]
    else:  # HCP: a hexagon, and equal triangles above and below
        around = [(math.cos(t), math.sin(t)) for t in (k * math.pi / 3 for k in range(6))]
        out = [(math.cos(t) / math.sqrt(3), math.sin(t) / math.sqrt(3)) for t in (math.pi / 2 + k * 2 * math.pi / 3 for k in range(3))]
        p = [(x, y, 0.0) for x, y in around] + [(x, y, s * math.sqrt(2 / 3)) for s in signs for x, y in out]
    q = np.array(p, float)
    return q / np.linalg.norm(q, axis=1).mean()


@functools.cache
def template(kind: str) -> Template:
    p = shell(kind)
    n = len(p)
    able = [(i, j) for i in range(n) for j in range(n) if np.linalg.norm(np.cross(p[i], p[j])) > 1e-6]
    start = _frames(p[able[0][0]], p[able[0][1]])
    rotations, moves = [], []
    for i, j in able:
        r = _frames(p[i], p[j]) @ start.T
        apart = np.linalg.norm((p @ r.T)[:, None, :] - p[None, :, :], axis=2)
        if (apart.min(axis=1) < 1e-6).all() and all(np.abs(r - o).max() > 1e-6 for o in rotations):
            rotations.append(r)
            moves.append(apart.argmin(axis=1))
    pairs, seen = [], set()
    for i, j in able:
        if (i, j) not in seen:
            pairs.append((i, j))
            seen |= {(int(m[i]), int(m[j])) for m in moves}
    return Template(p, np.array(rotations), tuple(pairs))


def fit(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation R and scale s of least deviation of s (v - mean) from R w, and the root mean square of it, the centres at 0 being points too."""
    n = v.shape[1] + 1
    u, s, vt = np.linalg.svd(np.swapaxes(w, 1, 2) @ v)
    flip = np.linalg.det(u @ vt)
    u = np.concatenate([u[:, :, :2], u[:, :, 2:] * flip[:, None, None]], axis=2)
    along = s[:, 0] + s[:, 1] + flip * s[:, 2]
    own = (v**2).sum(axis=(1, 2)) - (v.sum(axis=1) ** 2).sum(axis=1) / n
    left = (w**2).sum(axis=(1, 2)) - along**2 / own
    return np.swapaxes(u @ vt, 1, 2), along / own, np.sqrt(np.maximum(left, 0) / n)


def match(v: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of as many neighbours as the template has points: deviation (inf: no mapping), the point of each neighbour, rotation and scale."""
    t = template(kind)
    n = len(t.points)
    size = np.linalg.norm(v, axis=2).mean(axis=1)
    v = v / size[:, None, None]
    a = v[:, 0]
    square = np.linalg.norm(np.cross(a[:, None, :], v), axis=2) / np.linalg.norm(v, axis=2)
    axes = _frames(a, v[np.arange(len(v)), square.argmax(axis=1)])
    half = (t.points**2).sum(axis=1) / 2
    best, at = np.full(len(v), np.inf), np.zeros((len(v), n), np.int64)
    turn, scale = np.tile(np.eye(3), (len(v), 1, 1)), np.zeros(len(v))
    for i, j in t.pairs:
        r = axes @ _frames(t.points[i], t.points[j]).T
        to, s, off, left = np.full((len(v), n), -1), np.zeros(len(v)), np.full(len(v), np.inf), np.arange(len(v))
        for k in range(FITS):
            new = (v[left] @ (r[left] @ t.points.T) - half).argmax(axis=2)
            # A fit depends on the mapping alone, so it is made where that has changed, and the last one where it is a mapping.
            moved = (new != to[left]).any(axis=1)
            left, new = left[moved], new[moved]
            to[left] = new
            if k == FITS - 1:
                left = left[(np.sort(new, axis=1) == np.arange(n)).all(axis=1)]
            if not len(left):
                break
            r[left], s[left], off[left] = fit(t.points[to[left]], v[left])
        better = (np.sort(to, axis=1) == np.arange(n)).all(axis=1) & (off < best)
        best[better], at[better], turn[better], scale[better] = off[better], to[better], r[better], s[better]
    return best, at, turn, scale / size


def quaternions(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) with w >= 0: the main axis of the symmetric matrix that a rotation gives."""
    t = r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
    k = np.empty((len(r), 4, 4))
    for i in range(3):
        for j in range(3):
            k[:, i, j] = r[:, i, j] + r[:, j, i] - (t if i == j else 0)
        a, b = (i + 1) % 3, (i + 2) % 3
        k[:, i, 3] = k[:, 3, i] = r[:, b, a] - r[:, a, b]
    k[:, 3, 3] = t
    q = np.linalg.eigh(k)[1][:, :, -1]
    return q * np.where(q[:, 3:] < 0, -1, 1)


def least_turned(r: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of all rotations that the template's symmetry makes equal, the one of the least angle, as a quaternion, and the symmetry that leads to it."""
    of = template(kind).rotations
    g = of[np.einsum("mij,gji->mg", r, of).argmax(axis=1)]
    return quaternions(r @ g), g


def alloys(types: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Order by the types of a particle (first column) and its neighbours, whose template points are ``at``."""
    own = types[:, :1]
    same = types[:, 1:] == own
    other = np.where(same, np.iinfo(types.dtype).max, types[:, 1:]).min(axis=1, keepdims=True)
    two = (same | (types[:, 1:] == other)).all(axis=1)
    out = same.all(axis=1).astype(np.int32)
    if kind == "FCC":
        # The four points in the plane of two axes.
        planes = np.stack([(np.abs(template(kind).points[at][:, :, k]) < 1e-6) for k in range(3)], axis=1)
        alike = lambda x: (planes == x[:, None, :]).all(axis=2).any(axis=1)
        order = np.select([alike(same), alike(~same), ~same.any(axis=1)], [2, 3, 4], 0)
    elif kind == "BCC":
        order = np.where((same == (at >= 8)).all(axis=1), 5, 0)
    else:
        return out
    return np.where(two & (out == 0), order, out).astype(np.int32)


def _matched(near: pa.ListArray, types: np.ndarray | None, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    rows = len(near)
    out = {"kind": np.zeros(rows, np.int32), "rmsd": np.zeros(rows), "distance": np.zeros(rows), "alloy": np.zeros(rows, np.int32), "q": np.zeros((rows, 4)), "f": np.zeros((rows, 9))}
    best = np.full(rows, np.inf)
    for kind in kinds:
        p = template(kind).points
        at_rows, v = _vectors(near, len(p))
        for k in range(0, len(at_rows), ROWS):
            r, x = at_rows[k : k + ROWS], v[k : k + ROWS]
            off, at, turn, scale = match(x, kind)
            won = off < best[r]
            r, x, at, turn, scale = r[won], x[won], at[won], turn[won], scale[won]
            if not len(r):
                continue
            best[r] = off[won]
            out["kind"][r], out["rmsd"][r], out["distance"][r] = KINDS.index(kind), off[won], np.linalg.norm(p, axis=1).min() / scale
            out["q"][r], g = least_turned(turn, kind)
            # The points turn the other way, so that the gradient is that of the same orientation.
            grown = np.swapaxes(x * scale[:, None, None], 1, 2) @ (p[at] @ g) @ np.linalg.inv(p.T @ p)
            out["f"][r] = np.swapaxes(grown, 1, 2).reshape(-1, 9)
            if types is not None:
                out["alloy"][r] = alloys(types[r][:, : len(p) + 1], at, kind)
    return out


#: Columns of the result, after frame and idx.
_OUT = {"kind": ["Structure Type"], "rmsd": ["RMSD"], "distance": ["Interatomic Distance"], "alloy": ["Alloy Type"], "q": [f"Orientation.{c}" for c in "XYZW"], "f": [f"Elastic Deformation Gradient.{r}{c}" for c in "XYZ" for r in "XYZ"]}


def matched(ds: Dataset, structures: tuple[str, ...] = ("FCC", "HCP", "BCC"), only_selected: bool = False, alloy_types: bool = False) -> DataFrame:
    """frame, idx and the properties of the best match, without a bound on its deviation; staged.  Particles without neighbours have no row.

    With ``only_selected`` others are neither matched nor neighbours.
    """
    if not structures or not set(structures) <= set(KINDS[1:]):
        raise ValueError(f"structures are of {KINDS[1:]}")
    kinds = tuple(k for k in ("SC", "FCC", "HCP", "ICO", "BCC") if k in structures)
    if only_selected:
        ds = ds.having(particles=ds.particles.where(selected(ds)))
    near = knn(ds, max(len(shell(k)) for k in kinds))
    own = F.lit(0)
    if alloy_types:
        kind_of = ds.particles.select("frame", "idx", F.coalesce(col("Particle Type"), F.lit(0)).cast("int").alias("_kind"))
        near = near.join(kind_of.select("frame", F.col("idx").alias("j"), F.col("_kind").alias("kind")), ["frame", "j"]).join(kind_of.select("frame", F.col("idx").alias("i"), F.col("_kind").alias("own")), ["frame", "i"])
        own = F.first("own")
    else:
        near = near.withColumn("kind", F.lit(0))
    rows = near.groupBy("frame", F.col("i").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("d2", "j", "dx", "dy", "dz", "kind"))).alias("near"), own.alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, types = b.column("near"), None
            if alloy_types:
                size = np.diff(lists.offsets.to_numpy())
                place = np.minimum(np.arange(size.max(initial=1))[None, :], size[:, None] - 1) + lists.offsets.to_numpy()[:-1, None]
                types = np.concatenate([b.column("own").to_numpy()[:, None], lists.values.field("kind").to_numpy()[place]], axis=1)
            got = _matched(lists, types, kinds)
            flat = [a if a.ndim == 1 else a[:, k] for key, names in _OUT.items() for k, a in ((k, got[key]) for k in range(len(names)))]
            yield pa.record_batch([b.column("frame"), b.column("idx"), *map(pa.array, flat)], names=["frame", "idx", *(n for names in _OUT.values() for n in names)])

    types = {"kind": "int", "alloy": "int"}
    return stage(_arrow(rows, run, "frame int, idx long, " + ", ".join(f"`{n}` {types.get(key, 'double')}" for key, names in _OUT.items() for n in names)), "matched")


def template_matching(ds: Dataset, structures: tuple[str, ...] = ("FCC", "HCP", "BCC"), rmsd_cutoff: float = 0.1, only_selected: bool = False, alloy_types: bool = False) -> Dataset:
    """``Structure Type`` of the best match, ``RMSD``, ``Interatomic Distance`` (to the nearest neighbours of the fitted shell), ``Orientation`` (least turned of equal ones),
    ``Elastic Deformation Gradient`` (of the fitted scale) and, if asked for, ``Alloy Type``.

    Without a match the kind is OTHER and all else 0.  Where the RMSD is over a cutoff above 0, the kind is OTHER and the rest stays.
    """
    found = matched(ds, structures, only_selected, alloy_types)
    names = [n for key, ns in _OUT.items() for n in ns if key != "alloy" or alloy_types]
    kind = F.when((col("RMSD") > rmsd_cutoff) & F.lit(rmsd_cutoff > 0), 0).otherwise(col("Structure Type")).cast("int")
    found = found.select("frame", "idx", *(kind.alias(n) if n == "Structure Type" else col(n) for n in names))
    d = ds.particles.drop(*names).join(found, ["frame", "idx"], "left")
    # Not fillna, which takes dots in names for fields.
    d = d.select(*(F.coalesce(col(c), F.lit(0)).cast(d.schema[c].dataType).alias(c) if c in names else col(c) for c in d.columns))
    return structure_counts(ds.having(particles=d), KINDS, "PolyhedralTemplateMatching")


def rmsd_histogram(found: DataFrame, bins: int = 100) -> DataFrame:
    """frame, bin, x (the bin's centre), n of the deviations of all matches in ``matched``, from 0 to 1.01 times the largest of the frame.  Bins without a match have no row."""
    top = found.groupBy("frame").agg((F.max("RMSD") * 1.01 / bins).alias("_w")).select("frame", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0).alias("_w"))
    d = found.where(col("Structure Type") != 0).join(top, "frame")
    return d.groupBy("frame", F.floor(col("RMSD") / F.col("_w")).cast("int").alias("bin"), ((F.floor(col("RMSD") / F.col("_w")) + 0.5) * F.col("_w")).alias("x")).agg(F.count("*").alias("n"))
