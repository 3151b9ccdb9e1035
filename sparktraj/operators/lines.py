"""Lines as tables: points (frame, line, k, x, y, z, core), in the order of k, which may have gaps; ``core`` is the size of a point's core where lines are coarsened.

A line is closed where ``closed`` is true: its last point is its first one again, perhaps a period of the cell away, and both stay together.  Everything is windows over a line
and sums over stretches of it, so lines are spread over tasks and a line is sorted in one, on disk if it must.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparktraj.dataset import stage

def _line() -> WindowSpec:
    return Window.partitionBy("frame", "line").orderBy("k")


def _all() -> WindowSpec:
    return _line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _closed(points: DataFrame) -> Column:
    return F.coalesce(F.col("closed"), F.lit(False)) if "closed" in points.columns else F.lit(False)


def smooth_lines(points: DataFrame, passes: int = 1, pass_band: float = 0.1, strength: float = 0.5) -> DataFrame:
    """Each pass moves points towards the middle of their two neighbours by ``strength``, and then back by the factor that keeps the length for a pass band.

    Ends of open lines stay.  The neighbours of a closed line's end are its second point and its last but one; closed lines of up to four points, and lines of two, stay as they are.
    Columns beside the places are kept.
    """
    back = 1 / (pass_band - 1 / strength)
    names = points.columns
    d = points.withColumn("_closed", _closed(points)).withColumn("_n", F.count("*").over(_all())).withColumn("_place", F.row_number().over(_line()))
    # Of a closed line: from the first point to the last, and the points beside those.
    for c in "xyz":
        d = d.withColumn(f"_period{c}", F.last(c).over(_all()) - F.first(c).over(_all()))
    moves = (F.col("_n") > 2) & (~F.col("_closed") | (F.col("_n") > 4))
    for number in range(passes):
        for factor in (strength, back):
            new = {}
            for c in "xyz":
                before = F.coalesce(F.lag(c).over(_line()), F.when(F.col("_closed"), F.max(F.when(F.col("_place") == F.col("_n") - 1, F.col(c))).over(_all()) - F.col(f"_period{c}")))
                after = F.coalesce(F.lead(c).over(_line()), F.when(F.col("_closed"), F.max(F.when(F.col("_place") == 2, F.col(c))).over(_all()) + F.col(f"_period{c}")))
                new[c] = F.when(moves, F.col(c) + factor * F.coalesce((before + after) / 2 - F.col(c), F.lit(0.0))).otherwise(F.col(c))
            d = d.withColumns(new)
        if number % 4 == 3:
            d = stage(d, "lines")
    return d.select(*names)


def coarsen_lines(points: DataFrame, interval: float) -> DataFrame:
    """Fewer points: means over stretches whose number of points is ``interval`` times their core size.  Returns frame, line, k from 0, x, y, z, core (the stretch's mean) and closed.

    A point is 1 / (interval core) of a stretch, and a line has as many stretches as its points make together, rounded, but at least one between an open line's ends, which stay,
    and four in a closed line, where the ends lie in the middle of a stretch.  Lines of fewer than four points stay.  A core that is missing or below one counts as one.
    """
    core = F.greatest(F.coalesce(F.col("core").cast("double"), F.lit(1.0)), F.lit(1.0)) if "core" in points.columns else F.lit(1.0)
    d = points.select("frame", "line", "k", "x", "y", "z", core.alias("core"), _closed(points).alias("closed"))
    d = d.withColumns({"n": F.count("*").over(_all()), "at": F.row_number().over(_line()) - 1, **{f"p{c}": F.last(c).over(_all()) - F.first(c).over(_all()) for c in "xyz"}})
    last = F.col("at") == F.col("n") - 1
    # A closed line's last point is its first one; an open line's ends are no part of stretches.
    share = F.when(F.col("closed"), F.when(last, 0.0)).otherwise(F.when(last | (F.col("at") == 0), 0.0))
    d = d.withColumn("share", F.coalesce(share, 1 / (interval * F.col("core"))))
    d = d.withColumns({"total": F.sum("share").over(_all()), "passed": F.sum("share").over(_line().rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("closed"), F.col("share")).otherwise(F.col("share") / 2)})
    d = d.withColumn("m", F.greatest(F.floor(F.col("total") + 0.5), F.when(F.col("closed"), 4).otherwise(1)))
    place = F.col("passed") / F.col("total") * F.col("m")
    ring = F.floor(place + 0.5)
    d = d.withColumn("part", F.when(F.col("n") < 4, F.col("at")).when(F.col("closed"), F.when(last, F.col("m")).otherwise(ring)).when(F.col("at") == 0, 0).when(last, F.col("m") + 1).otherwise(F.least(F.floor(place), F.col("m") - 1) + 1).cast("long"))
    # What ends a closed line belongs to the stretch about its first point, a period away.
    wraps = F.col("closed") & (F.col("n") >= 4) & (F.col("part") == F.col("m"))
    d = d.withColumns({c: F.when(wraps, F.col(c) - F.col(f"p{c}")).otherwise(F.col(c)) for c in "xyz"}).withColumns({"part": F.when(wraps, 0).otherwise(F.col("part")), "again": wraps & last})
    means = d.where("NOT again").groupBy("frame", "line", "part").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z", "core")), *(F.first(c).alias(c) for c in ("closed", "n", "px", "py", "pz")))
    ends = means.where("closed AND n >= 4 AND part = 0").withColumns({c: F.col(c) + F.col(f"p{c}") for c in "xyz"}).withColumn("part", F.lit(1 << 62))
    out = means.unionByName(ends)
    return out.withColumn("k", (F.row_number().over(Window.partitionBy("frame", "line").orderBy("part")) - 1).cast("long")).select("frame", "line", "k", "x", "y", "z", "core", "closed")


def segments(points: DataFrame) -> DataFrame:
    """From each point to the next one: frame, line, k, x1, y1, z1, x2, y2, z2."""
    ends = [F.lead(c).over(_line()).alias(f"{c}2") for c in "xyz"]
    return points.select("frame", "line", "k", *(F.col(c).alias(f"{c}1") for c in "xyz"), *ends).where("x2 IS NOT NULL")


def cut_lines(points: DataFrame, normal: tuple[float, float, float], distance: float) -> DataFrame:
    """The segments of lines, or what is left of them, on the inner side of a plane, as in ``segments``, and ``piece``, which counts a line's parts from 0.

    A segment in the plane or only touching it from outside goes.
    """
    size = math.sqrt(sum(x * x for x in normal))
    above = lambda end: sum(F.col(f"{c}{end}") * (x / size) for c, x in zip("xyz", normal)) - distance
    d = segments(points).withColumns({"a": above(1), "b": above(2)}).where("a < 0 OR b < 0")
    part = F.col("a") / (F.col("a") - F.col("b"))
    cross = {c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * part for c in "xyz"}
    d = d.withColumns({f"{c}1": F.when(F.col("a") > 0, x).otherwise(F.col(f"{c}1")) for c, x in cross.items()} | {f"{c}2": F.when(F.col("b") > 0, x).otherwise(F.col(f"{c}2")) for c, x in cross.items()})
    # Where a segment begins on the plane the line came in, and a new piece begins.
    begins = F.when((F.col("a") >= 0) & (F.row_number().over(_line()) > 1), 1).otherwise(0)
    d = d.withColumn("_begins", begins)
    return d.withColumn("piece", F.sum("_begins").over(_line().rowsBetween(Window.unboundedPreceding, 0))).select("frame", "line", "piece", "k", *(f"{c}{e}" for e in (1, 2) for c in "xyz"))


def line_lengths(points: DataFrame) -> DataFrame:
    """frame, line, length."""
    far = F.sqrt(sum((F.col(f"{c}2") - F.col(f"{c}1")) * (F.col(f"{c}2") - F.col(f"{c}1")) for c in "xyz"))
    return segments(points).groupBy("frame", "line").agg(F.sum(far).alias("length"))
