"""Lines: smoothed, coarsened and cut, against plain versions."""

import numpy as np
import pytest

from sparktraj.operators.lines import coarsen_lines, cut_lines, line_lengths, smooth_lines

SCHEMA = "frame int, line long, k long, x double, y double, z double, core int, closed boolean"


def table(spark, lines):
    """Lines are (points, core, closed)."""
    rows = [(0, n, 10 * k, *map(float, p), core, closed) for n, (points, core, closed) in enumerate(lines) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def points_of(df, line):
    return np.array([(r.x, r.y, r.z) for r in df.where(f"line = {line}").orderBy("k").collect()])


def plain_smooth(p, closed):
    for factor in (0.5, 1 / (0.1 - 2)):
        ring = np.vstack([p[-2] - (p[-1] - p[0]), p, p[1] + (p[-1] - p[0])])
        mean = (ring[:-2] + ring[2:]) / 2
        step = factor * (mean - p)
        if not closed:
            step[[0, -1]] = 0
        p = p + step
    return p


def test_smoothing(spark):
    rng = np.random.default_rng(0)
    open_, ring = rng.random((9, 3)), rng.random((8, 3))
    ring[-1] = ring[0] + (10, 0, 0)
    short = rng.random((2, 3))
    small = np.vstack([short, short + 1])
    small[-1] = small[0]
    got = smooth_lines(table(spark, [(open_, 1, False), (ring, 1, True), (short, 1, False), (small, 1, True)]))
    assert points_of(got, 0) == pytest.approx(plain_smooth(open_, False)) and points_of(got, 1) == pytest.approx(plain_smooth(ring, True))
    assert points_of(got, 1)[-1] - points_of(got, 1)[0] == pytest.approx(np.array([10, 0, 0]))
    assert points_of(got, 2) == pytest.approx(short) and points_of(got, 3) == pytest.approx(small) and got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    twice = smooth_lines(table(spark, [(open_, 1, False)]), 2)
    assert points_of(twice, 0) == pytest.approx(plain_smooth(plain_smooth(open_, False), False))


def test_coarsening(spark):
    line = np.stack([np.arange(14.0), np.zeros(14), np.zeros(14)], axis=1)
    turn = np.linspace(0, 2 * np.pi, 41)
    ring = np.stack([np.cos(turn), np.sin(turn), np.zeros(41)], axis=1)
    screw = np.stack([np.arange(17.0), np.zeros(17), np.zeros(17)], axis=1)
    got = coarsen_lines(table(spark, [(line, 2, False), (ring, 2, True), (screw, 4, True), (line[:3], 9, False), (line, 100, False)]), 2.0)
    # Twelve points between the ends, four to a stretch.
    assert points_of(got, 0)[:, 0].tolist() == [0, 2.5, 6.5, 10.5, 13]
    p = points_of(got, 1)
    assert len(p) == 11 and p[0] == pytest.approx(p[-1]) and np.linalg.norm(p, axis=1) == pytest.approx(np.full(11, np.linalg.norm(p[1])), rel=1e-2)
    # A line that goes once through the cell: at least four stretches, ends a period of 16 apart.
    p = points_of(got, 2)[:, 0]
    assert len(p) == 5 and p[-1] - p[0] == pytest.approx(16) and np.diff(p) == pytest.approx(np.full(4, 4.0))
    assert points_of(got, 3) == pytest.approx(line[:3]) and points_of(got, 4)[:, 0].tolist() == [0, 6.5, 13]


def test_cutting(spark):
    zigzag = [(0, 0, 0), (2, 0, 0), (4, 0, 0), (2, 2, 0), (0, 2, 0), (0, 4, 0)]
    d = table(spark, [(zigzag, 1, False), ([(5, 0, 0), (6, 0, 0)], 1, False), ([(1, 0, 0), (3, 0, 0)], 1, False)])
    got = sorted((r.line, r.piece, r.x1, r.y1, r.x2, r.y2) for r in cut_lines(d, (2, 0, 0), 1.0).collect())
    assert got == [(0, 0, 0, 0, 1, 0), (0, 1, 0, 2, 0, 4), (0, 1, 1, 2, 0, 2)]
    assert {r.line: r.length for r in line_lengths(d).collect()} == {0: pytest.approx(4 + 8**0.5 + 4), 1: 1, 2: 2}
    assert cut_lines(d.where("line > 5"), (1, 0, 0), 1.0).count() == smooth_lines(d.where("line > 5")).count() == coarsen_lines(d.where("line > 5"), 2.0).count() == 0
