"""Corners of Voronoi cells, many cells at a time: the kernel behind Voronoi analysis and surface construction.

A particle's cell about itself is what no plane half-way to a neighbour cuts off.  Each corner lies on three planes, and is the centre of a
sphere through the particle and three neighbours with no particle inside: a tetrahedron of the Delaunay tessellation.  Corners are found by
walking: from a corner along each of its three edges up to the next plane.  All edges of all cells of a batch take their step at once.

Sites are moved by a tiny vector that depends on their index alone, so that never more than four of them lie on an empty sphere; all tasks see the same
sites, and so the same tetrahedra, without talking to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells that take their steps together.
TOGETHER = 128
#: How far sites are moved, in units of the distance to the nearest neighbour.
NUDGE = 1e-8
#: Sine of the angle up to which edges of a face go the same way.
TURN = 1e-5


def nudges(idx: np.ndarray) -> np.ndarray:
    """A vector in [-1, 1)^3 for each index: bits of a mixed counter."""
    out = np.empty((len(idx), 3))
    with np.errstate(over="ignore"):
        for k in range(3):
            x = idx.astype(np.uint64) * np.uint64(3) + np.uint64(k + 1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            out[:, k] = (x >> np.uint64(11)).astype(float) / 2.0**52 - 1.0
    return out


def _next(v: np.ndarray, d: np.ndarray, p: np.ndarray, y: np.ndarray, e: np.ndarray, on: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From points y of cells p along e: the plane met first and how far it is, infinite if none.  ``on``: planes that the points lie on."""
    planes = v[p]
    speed = np.einsum("nmk,nk->nm", planes, e)
    room = d[p] - np.einsum("nmk,nk->nm", planes, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(speed > 1e-12 * np.abs(d[p]), np.maximum(room, 0) / speed, np.inf)
    t[np.isinf(d[p])] = np.inf
    for c in on:
        t[np.arange(len(p)), c] = np.inf
    c = t.argmin(axis=1)
    return c, t[np.arange(len(p)), c]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _first(v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A corner of each cell that has one: cells, planes, points.  From the nearest plane's foot within the plane to a second one, and along both to a third."""
    p = np.flatnonzero(np.isfinite(d).any(axis=1))
    size = np.linalg.norm(v[p], axis=2)
    a = np.where(np.isfinite(d[p]), d[p] / np.where(size > 0, size, 1), np.inf).argmin(axis=1)
    normal = _unit(v[p, a])
    foot = normal * (d[p, a] / np.linalg.norm(v[p, a], axis=1))[:, None]
    side = _unit(np.cross(normal, np.eye(3)[np.abs(normal).argmin(axis=1)]))
    got = [(np.zeros(0, int), np.zeros((0, 3), int), np.zeros((0, 3)))]
    ways = np.stack([side, -side, np.cross(normal, side), -np.cross(normal, side)], axis=1)
    for k in range(4):
        if not len(p):
            break
        e = ways[:, k]
        b, t = _next(v, d, p, foot, e, [a])
        hit = np.isfinite(t)
        q, qa, qb, y = p[hit], a[hit], b[hit], foot[hit] + e[hit] * t[hit, None]
        along = np.cross(v[q, qa], v[q, qb])
        done = np.zeros(len(p), bool)
        for way in (1.0, -1.0):
            if not len(q):
                continue
            step = _unit(along) * way
            c, far = _next(v, d, q, y, step, [qa, qb])
            end = np.isfinite(far)
            got.append((q[end], np.stack([qa, qb, c], axis=1)[end], y[end] + step[end] * far[end, None]))
            done |= np.isin(p, q[end])
            q, qa, qb, y, along = q[~end], qa[~end], qb[~end], y[~end], along[~end]
        p, a, foot, ways = p[~done], a[~done], foot[~done], ways[~done]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])


def _walk(v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All corners of the cells: cells, sorted planes, points; and which cells are open."""
    n, m = d.shape
    open_ = np.ones(n, bool)
    if not np.isfinite(d).any():
        return np.zeros(0, int), np.zeros((0, 3), int), np.zeros((0, 3)), open_
    p, on, y = _first(v, d)
    open_[p] = False
    on = np.sort(on, axis=1)
    found, done = [(p, on, y)], np.zeros(0, np.int64)
    while len(p):
        sides = [(0, 1, 2), (0, 2, 1), (1, 2, 0)]
        key = np.concatenate([(p * m + on[:, a]) * m + on[:, b] for a, b, _ in sides])
        which = np.tile(np.arange(len(p)), 3)
        other = np.concatenate([on[:, c] for *_, c in sides])
        # An edge between two new corners needs no walk, nor does one that was walked before.
        once, at, times = np.unique(key, return_index=True, return_counts=True)
        walked = done[np.minimum(np.searchsorted(done, once), len(done) - 1)] == once if len(done) else np.zeros(len(once), bool)
        at = at[(times == 1) & ~walked]
        done = np.sort(np.concatenate([done, once[~walked]]), kind="stable")
        q, a, b, c = p[which[at]], key[at] // m % m, key[at] % m, other[at]
        e = np.cross(v[q, a], v[q, b])
        e = _unit(e * np.where(np.einsum("nk,nk->n", e, v[q, c]) > 0, -1.0, 1.0)[:, None])
        start = y[which[at]]
        new, t = _next(v, d, q, start, e, [a, b, c])
        ends = np.isfinite(t)
        open_[q[~ends]] = True
        on = np.sort(np.stack([a, b, new], axis=1)[ends], axis=1)
        p, y = q[ends], start[ends] + e[ends] * t[ends, None]
        _, at = np.unique(((p * m + on[:, 0]) * m + on[:, 1]) * m + on[:, 2], return_index=True)
        p, on, y = p[at], on[at], y[at]
        found.append((p, on, y))
        if len(found) > 10_000:
            raise ValueError("the walk around a cell doesn't end")
    return *(np.concatenate([f[k] for f in found]) for k in range(3)), open_


def corners(vectors: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For cells in order, some at a time: (cells, planes, points, open).  The neighbours of cell k are ``vectors[ends[k]:ends[k + 1]]``, and planes are rows of ``vectors``.

    ``open`` is over the cells of the part, from its first one on.
    """
    count = np.diff(ends)
    for at in range(0, len(count), TOGETHER):
        n = count[at : at + TOGETHER]
        m = max(1, int(n.max()))
        v, d = np.zeros((len(n), m, 3)), np.full((len(n), m), np.inf)
        rows = np.repeat(np.arange(len(n)), n)
        places = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        part = vectors[ends[at] : ends[at + len(n)]]
        v[rows, places], d[rows, places] = part, np.einsum("nk,nk->n", part, part) / 2
        p, on, y, open_ = _walk(v, d)
        yield p + at, on + ends[at + p][:, None], y, open_


def faces(cells: np.ndarray, planes: np.ndarray, points: np.ndarray, vectors: np.ndarray, least_edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Faces from corners: cell, plane, area, distance from the particle, and edges longer than ``least_edge``."""
    cell, plane, y = np.repeat(cells, 3), planes.ravel(), np.repeat(points, 3, axis=0)
    order = np.lexsort((plane, cell))
    cell, plane, y = cell[order], plane[order], y[order]
    start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (plane[1:] != plane[:-1])]) if len(cell) else np.zeros(0, int)
    n = np.diff(np.r_[start, len(cell)])
    of = np.repeat(np.arange(len(start)), n)
    w = vectors[plane[start]]
    size = np.linalg.norm(w, axis=1)
    normal = w / size[:, None]
    u = _unit(np.cross(normal, np.eye(3)[np.abs(normal).argmin(axis=1)])) if len(w) else normal
    middle = np.add.reduceat(y, start, axis=0) / n[:, None] if len(start) else y
    r = y - middle[of]
    angle = np.arctan2(np.einsum("nk,nk->n", r, np.cross(normal, u)[of]), np.einsum("nk,nk->n", r, u[of]))
    r = r[np.lexsort((angle, of))]
    after = np.arange(1, len(r) + 1)
    after[start + n - 1] = start
    area = np.einsum("nk,nk->n", np.add.reduceat(np.cross(r, r[after]), start, axis=0), normal) / 2 if len(start) else np.zeros(0)
    # An edge that goes on where the last long one ended, the same way, is part of it: there, a face without width begins or ends.
    step = r[after] - r
    long = np.linalg.norm(step, axis=1) > least_edge
    step, of = _unit(step[long]), of[long]
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    before = np.arange(-1, len(of) - 1)
    before[begins] = np.r_[begins[1:], len(of)] - 1
    turns = np.linalg.norm(np.cross(step, step[before]), axis=1) > TURN
    edges = np.bincount(of[turns], minlength=len(start))
    return cell[start], plane[start], area, size / 2, edges


def neighbour_vectors(near: pa.ListArray, idx: np.ndarray, scale: float, by_image: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vectors to neighbours with both ends nudged, and where each particle's begin.  ``near`` holds j, dx, dy, dz, sx, sy, sz; what has no j, a wall, stays where it is.

    ``by_image``: images of a particle are nudged each its own way, for boxes so small that they meet in a cell; cells of different particles then don't fit each other to the last digit.
    """
    ends = near.offsets.to_numpy().astype(int)
    inner = near.values.slice(ends[0], ends[-1] - ends[0])
    v = np.stack([inner.field(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "dz")], axis=1)
    ends = ends - ends[0]
    j = inner.field("j")
    sites = pc.fill_null(j, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if by_image:
        sites = sites + sum(inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) * p for c, p in zip(("sx", "sy", "sz"), (1 << 40, 1 << 46, 1 << 52)))
    moved = nudges(sites) - nudges(np.repeat(idx, np.diff(ends)))
    v = v + scale * np.where(j.is_valid().to_numpy(zero_copy_only=False)[:, None], moved, 0.0)
    return v, ends
