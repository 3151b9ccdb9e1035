"""Aggregations: bins, histograms, radial distribution, clusters, site occupancy, displacements and strain."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import POSITION, col, Dataset, number, on_workers, stage
from sparktraj.operators.blocks import neighbor_sums
from sparktraj.operators.neighbors import closest, half_pairs, pairs, within
from sparktraj.operators.select import selected


def _grid(ds: Dataset, n: int, name: str) -> DataFrame:
    return ds.cells.select("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def bin_and_reduce(ds: Dataset, property_: str, how: str = "mean", directions: tuple[int, ...] = (2,), bins: tuple[int, ...] = (200,), derivative: bool = False, only_selected: bool = False) -> DataFrame:
    """One value per bin along one or two cell vectors: frame, bin_x[, bin_y], value.  how: mean, sum, sum_vol (over the bin's volume), min, max.

    A bin is the reduced coordinate times the number of bins, cut towards 0; periodic directions wrap and others drop what is outside.
    NaN is left out and empty bins are 0.  ``derivative``: of the values along the first direction, central, one-sided at open ends.
    """
    d = (ds.particles.where(selected(ds)) if only_selected else ds.particles).join(g.prepared(ds.cells), "frame")
    s, periodic = g.reduced_here(tuple(map(col, POSITION))), g.periodic()
    names = ["bin_x", "bin_y"][: len(directions)]
    for name, k, n in zip(names, directions, bins):
        at = (s[k] * n).cast("int")
        d = d.withColumn(name, F.when(periodic[k], F.pmod(at, F.lit(n))).otherwise(at)).where(F.col(name).between(0, n - 1))
    v = col(property_).cast("double")
    total = {"mean": F.avg, "sum": F.sum, "sum_vol": F.sum, "min": F.min, "max": F.max}[how](v)
    got = d.where(~F.isnan(v)).groupBy("frame", *names).agg(total.alias("value"))
    grid = _grid(ds, bins[0], "bin_x")
    if len(directions) == 2:
        grid = grid.withColumn("bin_y", F.explode(F.sequence(F.lit(0), F.lit(bins[1] - 1))))
    out = grid.join(got, ["frame", *names], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if how == "sum_vol":
        out = out.join(ds.cells, "frame").withColumn("value", F.col("value") / (g.volume() / math.prod(bins)))
    if derivative:
        w = Window.partitionBy("frame", *names[1:]).orderBy("bin_x")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.select("frame", *names, "value").join(ds.cells, "frame")
        step = g.norm(g.edges()[directions[0]]) / bins[0]
        p = periodic[directions[0]]
        ahead = F.coalesce(F.lead("value").over(w), F.when(p, F.first("value").over(whole)), F.col("value"))
        behind = F.coalesce(F.lag("value").over(w), F.when(p, F.last("value").over(whole)), F.col("value"))
        steps = F.when(p, 2).otherwise((F.col("bin_x") > 0).cast("int") + (F.col("bin_x") < bins[0] - 1).cast("int"))
        out = out.withColumns({"_a": ahead, "_b": behind}).withColumn("value", F.when(steps > 0, F.try_divide(F.col("_a") - F.col("_b"), step * steps)).otherwise(0.0))
    return out.select("frame", *names, "value")


def histogram(ds: Dataset, property_: str, bins: int = 200, start: float | None = None, end: float | None = None, only_selected: bool = False) -> DataFrame:
    """frame, bin, x (the bin's centre), n.  Without a fixed range, from the least to the greatest value of the frame."""
    d, v = (ds.particles.where(selected(ds)) if only_selected else ds.particles), col(property_).cast("double")
    ends = d.groupBy("frame").agg(F.min(v).alias("lo"), F.max(v).alias("hi")) if start is None or end is None else ds.cells.select("frame")
    ends = ends.select("frame", (F.col("lo") if start is None else F.lit(float(start))).alias("lo"), (F.col("hi") if end is None else F.lit(float(end))).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(F.try_divide(v - F.col("lo"), width).cast("int"), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    n = d.join(ends, "frame").where(v.between(F.col("lo"), F.col("hi"))).groupBy("frame", at.alias("bin")).agg(F.count("*").alias("n"))
    return _grid(ds, bins, "bin").join(ends, "frame").join(n, ["frame", "bin"], "left").select("frame", "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def scatter(ds: Dataset, x: str, y: str, type_: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The points (frame, idx, x, y, type) and each frame's ranges."""
    points = ds.particles.select("frame", "idx", col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), (col(type_) if type_ else F.lit(0)).alias("type"))
    return points, points.groupBy("frame").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def coordination(ds: Dataset, cutoff: float = 3.2) -> Dataset:
    ends = half_pairs(ds, cutoff).select("frame", F.explode(F.array("i", "j")).alias("idx"))
    n = ends.groupBy("frame", "idx").agg(F.count("*").cast("int").alias("Coordination"))
    d = ds.particles.drop("Coordination").join(n, ["frame", "idx"], "left").fillna(0, ["Coordination"])
    return ds.having(particles=d)


def radial_distribution(ds: Dataset, cutoff: float = 3.2, bins: int = 200) -> DataFrame:
    """frame, bin, r (the bin's middle), g.  Each pair counts in both directions; shells in 3D, rings in 2D."""
    if bins < 4:
        raise ValueError("a radial distribution has 4 bins at least")
    step = cutoff / bins
    at = F.least((F.sqrt("d2") / ((cutoff + 1e-12) / bins)).cast("int"), F.lit(bins - 1))
    h = half_pairs(ds, cutoff).groupBy("frame", at.alias("bin")).agg((2 * F.count("*")).alias("h"))
    size = ds.particles.groupBy("frame").agg(F.count("*").alias("n")).join(ds.cells, "frame").select("frame", "n", g.volume().alias("v"), "is2d")
    r1, r2 = F.col("bin") * step, (F.col("bin") + 1) * step
    ideal = F.when(F.col("is2d"), math.pi * (r2 * r2 - r1 * r1)).otherwise(4 / 3 * math.pi * (r2 * r2 * r2 - r1 * r1 * r1)) * F.col("n") / F.col("v") * F.col("n")
    return _grid(ds, bins, "bin").join(size, "frame").join(h, ["frame", "bin"], "left").select("frame", "bin", (r1 + step / 2).alias("r"), (F.coalesce("h", F.lit(0)) / ideal).alias("g"))


def structure_counts(ds: Dataset, names: list[str], operator: str, column: str = "Structure Type") -> Dataset:
    """Attributes ``<operator>.counts.<NAME>``, with 0 for kinds that don't occur.  ``names`` in the order of their ids."""
    n = ds.particles.groupBy("frame", col(column).alias("kind")).agg(F.count("*").alias("n"))
    kinds = ds.cells.select("frame", F.posexplode(F.array(*map(F.lit, names))).alias("kind", "name"))
    rows = kinds.join(n, ["frame", "kind"], "left").select("frame", F.concat(F.lit(f"{operator}.counts."), F.col("name")).alias("key"), F.coalesce("n", F.lit(0)).alias("num"))
    return ds.with_attributes(rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (frame, i, j): frame, idx, root (the least idx), by alternating large and small stars."""
    e, before = edges.where("i <> j").selectExpr("frame", "i AS u", "j AS v"), None
    while True:
        both = e.unionByName(e.selectExpr("frame", "v AS u", "u AS v"))
        least = both.groupBy("frame", "u").agg(F.min("v").alias("m")).selectExpr("frame", "u", "least(u, m) AS m")
        large = both.join(least, ["frame", "u"]).where("v > u AND v <> m").selectExpr("frame", "v AS u", "m AS v").repartition("frame", "u").distinct()
        least = large.groupBy("frame", "u").agg(F.min("v").alias("m"))
        e = stage(large.join(least, ["frame", "u"]).selectExpr("frame", "v AS u", "m AS v").where("u <> v").unionByName(least.selectExpr("frame", "u", "m AS v")).repartition("frame", "u").distinct(), "stars")
        now = e.selectExpr("count(*)", "bit_xor(xxhash64(frame, u, v))").first()
        if now == before:
            break
        before = now
    return e.selectExpr("frame", "u AS idx", "v AS root").unionByName(e.selectExpr("frame", "v AS idx", "v AS root").distinct())


def cluster(ds: Dataset, cutoff: float = 3.2, only_selected: bool = False, by_size: bool = False) -> Dataset:
    """``Cluster``: components of the cutoff graph, numbered from 1 by their least index, or by falling size (of equal ones the least index); 0 for what isn't selected."""
    take = selected(ds) if only_selected else F.lit(True)
    members = ds.particles.where(take).select("frame", "idx")
    inside = ds.having(particles=ds.particles.where(take))
    roots = components(half_pairs(inside, cutoff).where("i <> j").select("frame", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))
    of = stage(members.join(roots, ["frame", "idx"], "left").select("frame", "idx", F.coalesce("root", "idx").alias("root")), "roots")
    sizes = of.groupBy("frame", "root").agg(F.count("*").alias("size"))
    numbered = number(sizes.withColumn("_smaller", -F.col("size")), [*(["_smaller"] if by_size else []), "root"], "_place").withColumn("Cluster", (F.col("_place") + 1).cast("int"))
    d = ds.particles.drop("Cluster").join(of.join(numbered, ["frame", "root"]).select("frame", "idx", "Cluster"), ["frame", "idx"], "left").fillna(0, ["Cluster"])
    facts = ds.cells.select("frame").join(sizes.groupBy("frame").agg(F.count("*").alias("n"), F.max("size").alias("most")), "frame", "left")
    rows = facts.select("frame", F.explode(F.map_from_arrays(F.array(F.lit("ClusterAnalysis.cluster_count"), F.lit("ClusterAnalysis.largest_size")), F.array(F.coalesce("n", F.lit(0)), F.coalesce("most", F.lit(0))))).alias("key", "num"))
    return ds.having(particles=d).with_attributes(rows)


def wigner_seitz(ds: Dataset, sites: DataFrame, by_type: str | None = None, reference_cells: DataFrame | None = None) -> Dataset:
    """Sites of a reference with the number of particles closest to each.  ``sites``: frame (that of the current particles), idx and positions.

    With ``reference_cells`` the particles are first carried to them.  With ``by_type`` there is a column ``Occupancy.<t>`` for each type.
    """
    from sparktraj.operators.modify import deform_to

    now = ds if reference_cells is None else deform_to(ds, reference_cells)
    at = closest(now, sites)
    n = at.groupBy("frame", F.col("j").alias("idx"))
    if by_type:
        kinds = sorted(r[0] for r in ds.particles.select(col(by_type)).distinct().collect())
        n = at.join(ds.particles.select("frame", F.col("idx").alias("i"), col(by_type).alias("_t")), ["frame", "i"]).groupBy("frame", F.col("j").alias("idx"))
        n = n.agg(F.count("*").cast("int").alias("Occupancy"), *(F.count_if(F.col("_t") == t).cast("int").alias(f"Occupancy.{t}") for t in kinds))
    else:
        n = n.agg(F.count("*").cast("int").alias("Occupancy"))
    out = now.having(particles=sites.join(n, ["frame", "idx"], "left").fillna(0), bonds=None)
    rows = out.particles.groupBy("frame").agg(F.count_if(F.col("Occupancy") == 0).alias("v"), F.sum(F.greatest(F.col("Occupancy") - 1, F.lit(0))).alias("i"))
    rows = rows.select("frame", F.explode(F.map_from_arrays(F.array(F.lit("WignerSeitz.vacancy_count"), F.lit("WignerSeitz.interstitial_count")), F.array("v", "i"))).alias("key", "num"))
    return out.with_attributes(rows)


def reference_pairs(ds: Dataset, reference_frame: int | None = None, offset: int = -1, by: str = "Particle Identifier", missing: str = "error") -> DataFrame:
    """Each particle with its place in the reference frame (a fixed one, or this one plus an offset), matched by identifier or else by idx: the particle's columns, rx, ry, rz, r_idx, r_frame.

    ``missing``: what a particle without a place there is: an error, dropped, or kept with nulls.
    """
    key = by if ds.has(by) else "idx"
    ref = ds.particles.select(F.col("frame").alias("r_frame"), col(key).alias("_key"), F.col("idx").alias("r_idx"), *(col(c).alias(f"r{k}") for c, k in zip(POSITION, "xyz")))
    ref = ref.withColumn("_count", F.count("*").over(Window.partitionBy("r_frame", "_key")))
    want = F.lit(reference_frame) if reference_frame is not None else F.col("frame") + offset
    d = ds.particles.withColumn("_want", want).join(ref, (F.col("_want") == F.col("r_frame")) & (col(key) == F.col("_key")), "inner" if missing == "drop" else "left")
    checks = F.when(F.col("_count") > 1, F.raise_error(F.lit("an identifier isn't unique")))
    if missing == "error":
        checks = checks.when(F.col("r_idx").isNull(), F.raise_error(F.lit("a particle isn't in the reference")))
    d = d.withColumn("r_idx", F.coalesce(checks.cast("long"), F.col("r_idx")))
    return d.drop("_want", "_key", "_count")


def _one_period(v: Column, limit: Column) -> Column:
    return F.when(v > limit, -1).when(v < -limit, 1).otherwise(0)


def less_a_period(d: DataFrame) -> DataFrame:
    """Vectors _vx, _vy, _vz with at most one period of the row's cell taken off along each periodic direction, one direction after another."""
    for edge, periodic in zip(g.edges(), g.periodic()):
        v = tuple(F.col(f"_v{k}") for k in "xyz")
        half, along = g.dot(edge, edge) / 2, g.dot(v, edge)
        # Shorter by one period or not: |v - e| < |v| is v.e > e.e / 2.
        k = F.when(periodic, _one_period(along, half)).otherwise(0)
        d = d.withColumns({f"_v{x}": F.col(f"_v{x}") + k * e for x, e in zip("xyz", edge)})
    return d


def displacements(ds: Dataset, reference_frame: int | None = 0, offset: int = -1, missing: str = "error", eliminate_deformation: bool = False) -> Dataset:
    """Displacement.X/Y/Z and Displacement Magnitude, with at most one period taken off along each periodic direction, one direction after another.

    With ``eliminate_deformation`` both places are taken in units of their own frame's cell, and the difference, at most one whole unit of it taken off where it passes a half, in those of the reference's cell.
    """
    d = reference_pairs(ds, reference_frame, offset, missing=missing).join(ds.cells, "frame")
    if eliminate_deformation:
        d = d.withColumns({f"_s{k}": x for k, x in zip("xyz", g.reduced(tuple(map(col, POSITION))))}).drop(*(c for c in ds.cells.columns if c != "frame"))
        d = d.join(ds.cells.withColumnRenamed("frame", "_f"), F.col("r_frame") == F.col("_f"), "left").drop("_f")
        d = d.withColumns({f"_v{k}": F.col(f"_s{k}") - x for k, x in zip("xyz", g.reduced(tuple(F.col(f"r{k}") for k in "xyz")))})
        # In a flat cell z stays as it is.
        part = tuple(F.col(f"_v{k}") + F.when(p, _one_period(F.col(f"_v{k}"), F.lit(0.5))).otherwise(0) for k, p in zip("xyz", g.periodic()))
        flat = (*g.absolute_vector((part[0], part[1], F.lit(0.0)))[:2], part[2])
        d = d.withColumns({f"_v{k}": F.when(F.col("is2d"), f).otherwise(x) for k, f, x in zip("xyz", flat, g.absolute_vector(part))})
    else:
        v = tuple(col(c) - F.col(f"r{k}") for c, k in zip(POSITION, "xyz"))
        d = d.withColumns({f"_v{k}": x for k, x in zip("xyz", v)})
        d = less_a_period(d)
    out = {f"Displacement.{k.upper()}": F.col(f"_v{k}") for k in "xyz"}
    d = d.withColumns(out | {"Displacement Magnitude": g.norm(tuple(F.col(f"_v{k}") for k in "xyz"))})
    return ds.having(particles=d.select(*map(col, dict.fromkeys([*ds.particles.columns, *out, "Displacement Magnitude"]))))


def mean_square_displacement(ds: Dataset, reference_frame: int = 0) -> DataFrame:
    """frame, msd and n, over the particles that are in the reference; null and 0 in frames without one of these."""
    d = displacements(ds, reference_frame, missing="null").particles
    return d.groupBy("frame").agg(F.avg(col("Displacement Magnitude") * col("Displacement Magnitude")).alias("msd"), F.count(col("Displacement Magnitude")).alias("n"))


def atomic_strain(ds: Dataset, cutoff: float = 3.0, reference_frame: int = 0, frames: Iterable[int] | None = None) -> Dataset:
    """Deformation gradient from the neighbours in the reference, Green strain, shear, volumetric strain and D2min.

    The sums of r0 r0' and r r0' are taken in blocks of particles (``blocks.neighbor_sums``); what is left per particle is algebra on 3x3 matrices.  In two dimensions strain
    is in the plane, the third direction stays as it is.  With fewer than three neighbours, two in two dimensions, or sums whose
    determinants are under 1e-4, all are 0 and the particle is selected.  ``frames``: of which strain is asked for, all without it; the result has these only.
    """
    # Each frame's particles at their places in the reference, which tell pairs, with their own places, in units of their frame's cell, beside them.
    asked = ds if frames is None else ds.frames(frames)
    now = reference_pairs(ds if frames is None else ds.frames({reference_frame, *frames}), reference_frame, missing="drop")
    now = now if frames is None else now.where(F.col("frame").isin(*frames))
    flags = sum((F.when(p, 1 << k).otherwise(0) for k, p in enumerate(g.periodic())), F.lit(0)).cast("int")
    now = now.join(g.prepared(ds.cells), "frame").select("frame", "idx", flags.alias("_periodic"), *(s.alias(f"_u{k}") for k, s in enumerate(g.reduced_here(tuple(map(col, POSITION))))), *(F.col(f"r{k}").alias(c) for c, k in zip(POSITION, "xyz")))
    then = asked.cells.select("frame").crossJoin(ds.cells.where(F.col("frame") == reference_frame).drop("frame"))
    s = neighbor_sums(Dataset(now, then), cutoff, ("_u0", "_u1", "_u2"), "_periodic").join(ds.cells, "frame")
    # The edges as columns of a matrix; in a flat cell the third unit is the length itself.
    edge = [[F.when(F.col("is2d"), float(m == n)).otherwise(c) if 2 in (m, n) else c for n, c in enumerate(row)] for m, row in enumerate(zip(*g.edges()))]
    three = lambda t: t(0) + t(1) + t(2)
    sums = {f"v{m}{n}": F.col(f"qq{min(m, n)}{max(m, n)}") for m in range(3) for n in range(3)}
    sums |= {f"w{m}{n}": three(lambda k: edge[m][k] * F.col(f"uq{k}{n}")) for m in range(3) for n in range(3)}
    rr = three(lambda m: three(lambda k: three(lambda n: edge[m][k] * edge[m][n] * F.col(f"uu{min(k, n)}{max(k, n)}"))))
    s = s.select("frame", "idx", "n", F.col("is2d").alias("flat"), rr.alias("rr"), *(x.alias(c) for c, x in sums.items()))
    out_of_plane = [(m, n) for m in range(3) for n in range(3) if 2 in (m, n)]
    s = s.withColumns({f"{x}{m}{n}": F.when(F.col("flat"), float(m == n)).otherwise(F.col(f"{x}{m}{n}")) for x in "vw" for m, n in out_of_plane})
    v, w = ([[F.col(f"{x}{m}{n}") for n in range(3)] for m in range(3)] for x in "vw")
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    enough = F.col("n") >= F.when(F.col("flat"), 2).otherwise(3)
    s = s.withColumn("det", det(v)).withColumn("ok", enough & (F.abs("det") > 1e-4) & (F.abs(det(w)) >= 1e-4))
    minor = lambda m, n: v[(n + 1) % 3][(m + 1) % 3] * v[(n + 2) % 3][(m + 2) % 3] - v[(n + 1) % 3][(m + 2) % 3] * v[(n + 2) % 3][(m + 1) % 3]
    s = s.withColumns({f"i{m}{n}": F.try_divide(minor(m, n), F.col("det")) for m in range(3) for n in range(3)})
    s = s.withColumns({f"f{m}{n}": sum((F.col(f"w{m}{k}") * F.col(f"i{k}{n}") for k in range(1, 3)), F.col(f"w{m}0") * F.col(f"i0{n}")) for m in range(3) for n in range(3)})
    green = lambda m, n: (sum((F.col(f"f{k}{m}") * F.col(f"f{k}{n}") for k in range(1, 3)), F.col(f"f0{m}") * F.col(f"f0{n}")) - (1.0 if m == n else 0.0)) * 0.5
    s = s.withColumns({"xx": green(0, 0), "yy": green(1, 1), "zz": green(2, 2), "xy": green(0, 1), "xz": green(0, 2), "yz": green(1, 2)})
    e = {k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    shear = F.sqrt(e["xy"] * e["xy"] + e["xz"] * e["xz"] + e["yz"] * e["yz"] + ((e["xx"] - e["yy"]) * (e["xx"] - e["yy"]) + (e["xx"] - e["zz"]) * (e["xx"] - e["zz"]) + (e["yy"] - e["zz"]) * (e["yy"] - e["zz"])) / 6)
    # The sum of |r - F q|^2 is rr - tr(F W') since F V = W.
    fit = sum((F.col(f"f{m}{n}") * F.col(f"w{m}{n}") for m in range(3) for n in range(3)), F.lit(0.0)) - F.col("flat").cast("double")
    new = {"Shear Strain": shear, "Volumetric Strain": (e["xx"] + e["yy"] + e["zz"]) / 3, "Nonaffine Squared Displacement": F.greatest(F.lit(0.0), F.col("rr") - fit)}
    new |= {f"Strain.{k.upper()}": x for k, x in e.items()} | {f"Deformation Gradient.{m + 1}{n + 1}": F.col(f"f{m}{n}") for n in range(3) for m in range(3)}
    s = s.select("frame", "idx", F.col("ok").alias("_ok"), *(F.when(F.col("ok"), x).otherwise(0.0).alias(c) for c, x in new.items()))
    kept = asked.particles.select(*(col(c) for c in ds.particles.columns if c not in new and c != "Selection"))
    out = kept.join(s, ["frame", "idx"], "left").withColumn("Selection", (~F.coalesce("_ok", F.lit(False))).cast("int")).drop("_ok")
    out = asked.having(particles=out.withColumns({c: F.coalesce(col(c), F.lit(0.0)) for c in new}))
    return out.count_attribute("AtomicStrain.invalid_particle_count", F.col("Selection") != 0)


def polar_decomposition(ds: Dataset) -> Dataset:
    """Rotation (a quaternion x, y, z, w) and the stretch tensor of each deformation gradient; the identity where it is singular."""
    import numpy as np
    import pyarrow as pa

    given = [f"Deformation Gradient.{m}{n}" for n in (1, 2, 3) for m in (1, 2, 3)]
    names = ["frame", "idx", *(f"Rotation.{k}" for k in "XYZW"), *(f"Stretch Tensor.{k}" for k in ("XX", "YY", "ZZ", "XY", "XZ", "YZ"))]

    def run(batches):
        for b in batches:
            f = np.stack([b.column(k + 2).to_numpy(zero_copy_only=False) for k in range(9)], axis=1).reshape(-1, 3, 3).transpose(0, 2, 1)
            f = np.where((np.abs(np.linalg.det(f)) > 1e-12)[:, None, None], f, np.eye(3))
            u, s, vt = np.linalg.svd(f)
            r = u @ vt
            stretch = np.einsum("nji,nj,njk->nik", vt, s, vt)
            # The quaternion from the eigenvector of the greatest eigenvalue of a symmetric 4x4 matrix of the rotation's entries.
            k = np.zeros((len(r), 4, 4))
            k[:, 0, 0], k[:, 1, 1], k[:, 2, 2] = r[:, 0, 0] - r[:, 1, 1] - r[:, 2, 2], r[:, 1, 1] - r[:, 0, 0] - r[:, 2, 2], r[:, 2, 2] - r[:, 0, 0] - r[:, 1, 1]
            k[:, 3, 3] = r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
            for i, j, v in ((0, 1, r[:, 0, 1] + r[:, 1, 0]), (0, 2, r[:, 0, 2] + r[:, 2, 0]), (1, 2, r[:, 1, 2] + r[:, 2, 1]), (0, 3, r[:, 2, 1] - r[:, 1, 2]), (1, 3, r[:, 0, 2] - r[:, 2, 0]), (2, 3, r[:, 1, 0] - r[:, 0, 1])):
                k[:, i, j] = k[:, j, i] = v
            q = np.linalg.eigh(k)[1][:, :, 3]
            q *= np.where(q[:, 3:] < 0, -1, 1)
            cols = [*q.T, *(stretch[:, i, j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=names)

    on_workers(ds.spark)
    schema = "frame int, idx long, " + ", ".join(f"`{n}` double" for n in names[2:])
    return ds.having(particles=ds.particles.join(ds.particles.select("frame", "idx", *(col(c).alias(f"f{k}") for k, c in enumerate(given))).mapInArrow(run, schema), ["frame", "idx"]))


def add_bonds(ds: Dataset, new: DataFrame, numbered: bool = True, extra: tuple[str, ...] = ()) -> Dataset:
    """Half-bonds (frame, i, j, sx, sy, sz) beside those that are there already, numbered anew.  ``extra`` columns are kept; bonds that were there have nulls."""
    keys = ["frame", "i", "j", "sx", "sy", "sz"]
    new = new.select(*keys, *map(col, extra))
    if ds.bonds is not None:
        new = ds.bonds.select(*keys).unionByName(new.join(ds.bonds.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return ds.having(bonds=number(new, keys[1:], "bidx").select("frame", "bidx", *keys[1:], *map(col, extra)) if numbered else new)


def create_bonds(ds: Dataset, cutoff: float = 3.2, lower: float = 0.0, pair_cutoffs: dict[tuple[int, int], float] | None = None, type_column: str = "Particle Type", molecule_column: str | None = None, numbered: bool = True, lengths: bool = False, ends: tuple[str, ...] = ()) -> Dataset:
    """Half-bonds for all pairs within a cutoff, one for all or one for each pair of types (in either order), added to the bonds that are there.

    ``lengths`` gives new bonds their ``Length``, and ``ends`` properties of both ends, as ``<name>.1`` and ``<name>.2``.  Without ``numbered`` bonds have no bidx: nothing is sorted or written, and
    they are found whenever they are asked for.
    """
    most = max(pair_cutoffs.values()) if pair_cutoffs else cutoff
    extra = [c for c in ([type_column] if pair_cutoffs else []) + ([molecule_column] if molecule_column else [])]
    carry = {f"_e{n}_": c for n, c in enumerate([*extra, *ends])}
    # Bonds that are looked up from their first end, as unnumbered ones may be, are found from there, so that Spark can look up the end first.
    d = pairs(ds, most, carry=carry) if numbered or ends or lengths else within(ds, most, carry=carry).where("i <> j OR sx <> 0 OR sy <> 0 OR sz <> 0")
    d = d.where(F.col("d2") >= lower * lower)
    for n in range(len(extra)):
        d = d.withColumns({f"_i{n}": F.col(f"_e{n}_1"), f"_j{n}": F.col(f"_e{n}_2")})
    if pair_cutoffs:
        limit = F.lit(None).cast("double")
        for (a, b), rc in pair_cutoffs.items():
            limit = F.when(((F.col("_i0") == a) & (F.col("_j0") == b)) | ((F.col("_i0") == b) & (F.col("_j0") == a)), F.lit(float(rc))).otherwise(limit)
        d = d.where(F.col("d2") <= limit * limit)
    if molecule_column:
        d = d.where(F.col(f"_i{len(extra) - 1}") == F.col(f"_j{len(extra) - 1}"))
    more = {f"{c}.{k}": F.col(f"_e{len(extra) + n}_{k}") for n, c in enumerate(ends) for k in (1, 2)} | ({"Length": F.sqrt("d2")} if lengths else {})
    out = add_bonds(ds, d.withColumns(more), numbered, tuple(more))
    n = out.bonds.groupBy("frame").agg((F.count("*") / 2).alias("n"))
    return out.with_attributes(ds.cells.select("frame").join(n, "frame", "left").select("frame", F.lit("CreateBonds.num_bonds").alias("key"), F.coalesce("n", F.lit(0.0)).alias("num")))
