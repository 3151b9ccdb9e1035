"""Queries of lines: each particle's way through the frames is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, col
from sparktraj.operators import lines
from sparktraj.plans.adapters import tracks
from sparktraj.plans.queries import _TRACKS, _r, query

_POINTS = f"{_TRACKS}, w AS (SELECT id AS line, frame AS k, x, y, CAST(frame AS DOUBLE) AS z, CAST(1 << (CAST(y AS INT) % 3) AS DOUBLE) AS core FROM k)"


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks(spark, sf_dir).particles
    core = F.lit(1.0) * F.pow(F.lit(2.0), col("Position.Y").cast("int") % 3)
    return d.select(F.lit(0).alias("frame"), col("Particle Identifier").cast("long").alias("line"), F.col("frame").cast("long").alias("k"), *(col(c).alias(k) for c, k in zip(POSITION[:2], "xy")), F.col("frame").cast("double").alias("z"), core.alias("core"))


def _pass(of: str, factor: str) -> str:
    moved = ", ".join(f"{c} + {factor} * coalesce((lag({c}) OVER o + lead({c}) OVER o) / 2 - {c}, 0) AS {c}" for c in "xyz")
    return f"SELECT line, k, {moved} FROM {of} WINDOW o AS (PARTITION BY line ORDER BY k)"


@query(f"WITH {_POINTS}, a AS ({_pass('w', '0.5::DOUBLE')}), b AS ({_pass('a', '(1 / (0.1::DOUBLE - 2))')}) SELECT line, CAST(k AS BIGINT) AS k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM b")
def smooth_lines(spark, sf_dir):
    return lines.smooth_lines(_ways(spark, sf_dir)).select("line", "k", *(_r(c) for c in "xyz"))


@query(f"""WITH {_POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY line) AS n FROM w),
s AS (SELECT *, CASE WHEN pos IN (0, n - 1) THEN 0 ELSE 1 / (2 * core) END AS share FROM p),
c AS (SELECT *, sum(share) OVER (PARTITION BY line) AS total, sum(share) OVER (PARTITION BY line ORDER BY k ROWS UNBOUNDED PRECEDING) - share / 2 AS passed FROM s),
m AS (SELECT *, greatest(floor(total + 0.5), 1) AS m FROM c),
q AS (SELECT *, CASE WHEN n < 4 THEN pos WHEN pos = 0 THEN 0 WHEN pos = n - 1 THEN m + 1 ELSE least(floor(passed / total * m), m - 1) + 1 END AS part FROM m)
SELECT line, CAST(part AS BIGINT) AS k, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(core), 6) AS core FROM q GROUP BY line, part""")
def coarsen_lines(spark, sf_dir):
    """Every stretch has points, as points are no farther apart than half of one."""
    return lines.coarsen_lines(_ways(spark, sf_dir), 2.0).select("line", "k", *(_r(c) for c in ("x", "y", "z", "core")))


@query(f"""WITH {_POINTS}, e AS (SELECT line, k, x AS x1, y AS y1, z AS z1, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(z) OVER o AS z2 FROM w WINDOW o AS (PARTITION BY line ORDER BY k)),
i AS (SELECT *, x1 - 40 AS a, x2 - 40 AS b, (x1 - 40) / (x1 - x2) AS t FROM e WHERE x2 IS NOT NULL AND (x1 < 40 OR x2 < 40)),
g AS (SELECT *, CASE WHEN a >= 0 AND row_number() OVER (PARTITION BY line ORDER BY k) > 1 THEN 1 ELSE 0 END AS begins FROM i)
SELECT line, CAST(sum(begins) OVER (PARTITION BY line ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece, CAST(k AS BIGINT) AS k,
{', '.join(f'round(CASE WHEN a > 0 THEN {c}1 + ({c}2 - {c}1) * t ELSE {c}1 END, 6) AS {c}1, round(CASE WHEN b > 0 THEN {c}1 + ({c}2 - {c}1) * t ELSE {c}2 END, 6) AS {c}2' for c in 'xyz')} FROM g""")
def cut_lines(spark, sf_dir):
    return lines.cut_lines(_ways(spark, sf_dir), (1.0, 0.0, 0.0), 40.0).select("line", "piece", "k", *(_r(f"{c}{e}") for c in "xyz" for e in (1, 2)))


@query(f"WITH {_POINTS}, e AS (SELECT line, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, z - lag(z) OVER o AS dz FROM w WINDOW o AS (PARTITION BY line ORDER BY k)) SELECT line, round(sum(sqrt(dx * dx + dy * dy + dz * dz)), 4) AS length FROM e WHERE dx IS NOT NULL GROUP BY 1")
def line_lengths(spark, sf_dir):
    return lines.line_lengths(_ways(spark, sf_dir)).select("line", _r("length", digits=4))
