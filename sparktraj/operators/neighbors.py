"""The join layer: cutoff pairs, nearest neighbours and closest sites under periodic boundaries.

A cutoff join is an equi-join on (frame, bin): each particle looks into the bins around its own, with the cell shift that goes
with each, and the exact distance is a filter behind the join.  Bins are at least as wide as the cutoff, so their number
per particle is bounded and no frame, bin or neighbour list is gathered.  Pairs of one table are found once, from half of the
bins around; what needs both directions mirrors them behind the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import POSITION, Dataset, col, stage


def _length(cutoff: float | str) -> Column:
    """A cutoff as a column: a number, or the name of a column of the cells, so that frames have their own."""
    if isinstance(cutoff, str):
        return F.col(cutoff)
    if not cutoff > 0:
        raise ValueError("a cutoff must be over 0")
    return F.lit(float(cutoff))


def _binned(ds: Dataset, particles: DataFrame, cutoff: Column, carry: dict[str, str] | None = None, wide: int = 1) -> DataFrame:
    """frame, idx, position, what ``carry`` names, cell, wraps f*, bins bin_*, number of bins n*, reach m* and bins' width w* of each direction.  However large the box, bins are as small as ``wide`` cutoffs (up to 2**30 along a side).

    What depends on the cell alone is worked out once for a cell, not for every particle.
    """
    p = tuple(col(c).alias(k) for c, k in zip(POSITION, "xyz"))
    flat = (F.lit(False), F.lit(False), F.col("is2d"))
    # A degenerate cell is an error only where it has particles.
    cells = g.prepared(ds.cells).withColumn("_fine", F.coalesce(g.volume() > 0, F.lit(False)))
    cells = cells.withColumns({f"_t{k}": F.when(F.col("_fine"), t) for k, t in zip("xyz", g.thickness())})
    cells = cells.withColumns({f"n{k}": F.when(two, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(2**30), F.floor(F.col(f"_t{k}") / (wide * cutoff))))).cast("int") for k, two in zip("xyz", flat)})
    cells = cells.withColumns({f"w{k}": F.col(f"_t{k}") / F.col(f"n{k}") for k in "xyz"})
    cells = cells.withColumns({f"m{k}": F.when(two, 0).otherwise(F.ceil(cutoff / F.col(f"w{k}"))).cast("int") for k, two in zip("xyz", flat)})
    d = particles.select("frame", "idx", *p, *(col(c).alias(f"_c_{k}") for k, c in (carry or {}).items())).join(cells, "frame")
    d = d.withColumn("_ok", F.when(F.col("_fine"), True).otherwise(F.raise_error(F.lit("a simulation cell is degenerate")).cast("boolean"))).where("_ok").drop("_ok")
    d = d.withColumns({f"s{k}": x for k, x in zip("xyz", g.reduced_here((F.col("x"), F.col("y"), F.col("z"))))})
    d = d.withColumns({f"f{k}": x for k, x in zip("xyz", g.images(tuple(F.col(f"s{k}") for k in "xyz")))})
    return d.withColumns({f"bin_{k}": F.least(F.greatest(F.floor((F.col(f"s{k}") - F.col(f"f{k}")) * F.col(f"n{k}")), F.lit(0)), F.col(f"n{k}") - 1).cast("int") for k in "xyz"})


def within(ds: Dataset, cutoff: float | str, targets: DataFrame | None = None, sources: DataFrame | None = None, most_images: int | None = None, half: bool = False, carry: dict[str, str] | None = None) -> DataFrame:
    """All (i, j, shift) with \\|x_j + shift - x_i\\| <= cutoff between two tables of particles in one cell: frame, i, j, dx, dy, dz, d2, sx, sy, sz.

    ``cutoff`` may name a column of the cells.  The shift holds for positions as they are, not wrapped.  ``most_images`` bounds the images looked at in each direction.
    A particle and itself are no pair here unless the shift differs from 0; two tables are told apart by the caller.
    With ``half`` both tables must be the same one: of each pair and its mirror image one row comes, and none of a particle with itself unshifted.
    ``carry``: short names of properties that come along, of i as ``<name>1`` and of j as ``<name>2``, so that nothing has to be joined to the pairs.
    """
    rc = _length(cutoff)
    left = _binned(ds, ds.particles if sources is None else sources, rc, carry)
    right = _binned(ds, ds.particles if targets is None else targets, rc, carry)
    ahead = F.lit(False)
    for k, periodic in zip("xyz", g.periodic()):
        left = left.withColumn(f"_d{k}", F.explode(F.sequence(-F.col(f"m{k}"), F.col(f"m{k}"))))
        left = left.withColumn(f"u{k}", F.floor((F.col(f"bin_{k}") + F.col(f"_d{k}")) / F.col(f"n{k}")).cast("int")).where(periodic | (F.col(f"u{k}") == 0)).withColumn(f"t{k}", (F.col(f"bin_{k}") + F.col(f"_d{k}") - F.col(f"u{k}") * F.col(f"n{k}")).cast("int"))
        if most_images is not None:
            left = left.where(F.abs(f"u{k}") <= most_images)
        if half:
            left = left.where(ahead | (F.col(f"_d{k}") >= 0))
            ahead = ahead | (F.col(f"_d{k}") > 0)
    # The cell stays behind: what goes through the shuffle are positions, whole shifts and the vectors that these amount to.
    crossed, wraps = tuple(F.col(f"u{k}") + F.col(f"f{k}") for k in "xyz"), tuple(F.col(f"f{k}") for k in "xyz")
    left = left.select("frame", F.col("idx").alias("i"), *([(rc * rc).alias("_rc2")] if isinstance(cutoff, str) else []), *(F.col(c) for c in "xyz"), *(F.col(f"t{k}") for k in "xyz"), ahead.alias("_ahead"), *(F.col(f"_c_{k}").alias(f"{k}1") for k in carry or ()), *(c.alias(f"h{k}") for k, c in zip("xyz", crossed)), *(v.alias(f"v{k}") for k, v in zip("xyz", g.absolute_vector(crossed))))
    right = right.select("frame", F.col("idx").alias("j"), *(F.col(f"_c_{k}").alias(f"{k}2") for k in carry or ()), *(F.col(c).alias(f"j_{c}") for c in "xyz"), *(F.col(f"bin_{k}").alias(f"t{k}") for k in "xyz"), *(F.col(f"f{k}").alias(f"j_f{k}") for k in "xyz"), *(v.alias(f"w{k}") for k, v in zip("xyz", g.absolute_vector(wraps))))
    d = left.join(right, ["frame", "tx", "ty", "tz"])
    if half:
        d = d.where(F.col("_ahead") | (F.col("i") < F.col("j")))
    apart = ((F.col(f"j_{k}") - F.col(k) + (F.col(f"v{k}") - F.col(f"w{k}"))).alias(f"d{k}") for k in "xyz")
    most = F.col("_rc2") if isinstance(cutoff, str) else F.lit(cutoff * cutoff)
    d = d.select("frame", "i", "j", *([most] if isinstance(cutoff, str) else []), *apart, *((F.col(f"h{k}") - F.col(f"j_f{k}")).cast("int").alias(f"s{k}") for k in "xyz"), *(f"{k}{n}" for n in (1, 2) for k in carry or ()))
    return d.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("d2") <= most).drop("_rc2")


#: Particles of a bin that are handled together, and parts into which a bin is cut at most.
TOGETHER, MOST_PARTS = 256, 8


def halos(ds: Dataset, cutoff: float) -> DataFrame:
    """Each bin with all that lies within the cutoff of it: frame, bin_x, bin_y, bin_z, part, idx, place (wrapped, as seen from the bin) hx, hy, hz, the cells kx, ky, kz from there to the particle as it is, and whether the particle is the bin's own.

    A bin with many particles is cut in slices along its first direction, its parts; ``own`` is of one part each.  Only places are sent, so what is shuffled grows with the particles and not with their pairs.
    """
    d = _binned(ds, ds.particles, _length(cutoff))
    bins = ["frame", "bin_x", "bin_y", "bin_z"]
    parts = d.groupBy(*bins).agg(F.least(F.ceil(F.count("*") / TOGETHER), F.lit(MOST_PARTS)).cast("int").alias("parts"))
    d = d.withColumn("along", (F.col("sx") - F.col("fx")) * F.col("nx") - F.col("bin_x"))
    for k, periodic in zip("xyz", g.periodic()):
        d = d.withColumn(f"_d{k}", F.explode(F.sequence(-F.col(f"m{k}"), F.col(f"m{k}"))))
        d = d.withColumn(f"u{k}", F.floor((F.col(f"bin_{k}") + F.col(f"_d{k}")) / F.col(f"n{k}")).cast("int")).where(periodic | (F.col(f"u{k}") == 0))
        d = d.withColumn(f"t{k}", (F.col(f"bin_{k}") + F.col(f"_d{k}") - F.col(f"u{k}") * F.col(f"n{k}")).cast("int"))
    own = (F.col("_dx") == 0) & (F.col("_dy") == 0) & (F.col("_dz") == 0)
    away = tuple(0 - F.col(f"u{k}") - F.col(f"f{k}") for k in "xyz")
    seen = g.plus(tuple(F.col(k) for k in "xyz"), g.absolute_vector(away))
    d = d.select("frame", *(F.col(f"t{k}").alias(f"bin_{k}") for k in "xyz"), "idx", *(v.alias(f"h{k}") for k, v in zip("xyz", seen)), *(v.cast("int").alias(f"k{k}") for k, v in zip("xyz", away)), own.alias("_own"), "along")
    d = d.join(parts, bins).withColumn("_part", F.least(F.floor(F.col("along") * F.col("parts")).cast("int"), F.col("parts") - 1))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.select(*bins, "part", "idx", "hx", "hy", "hz", "kx", "ky", "kz", (F.col("_own") & (F.col("_part") == F.col("part"))).alias("own"))


def reached(d: DataFrame, cutoff: float) -> tuple[DataFrame, list[Column], g.Vector, Column]:
    """Particles with bins, once for each bin that they are near to: the rows, columns of the bin's bin_*, the whole cells from it to the particle as it is, and whether the particle is the bin's own."""
    for k, periodic in zip("xyz", g.periodic()):
        along = (F.col(f"s{k}") - F.col(f"f{k}")) * F.col(f"n{k}") - F.col(f"bin_{k}")
        d = d.withColumn(f"_a{k}", along).withColumn(f"_d{k}", F.explode(F.sequence(-F.col(f"m{k}"), F.col(f"m{k}"))))
        away = F.when(F.col(f"_d{k}") > 0, F.col(f"_d{k}") - F.col(f"_a{k}")).when(F.col(f"_d{k}") < 0, F.col(f"_a{k}") - F.col(f"_d{k}") - 1).otherwise(0.0)
        d = d.where(away * F.col(f"w{k}") <= cutoff * (1 + 1e-9))
        d = d.withColumn(f"u{k}", F.floor((F.col(f"bin_{k}") + F.col(f"_d{k}")) / F.col(f"n{k}")).cast("int")).where(periodic | (F.col(f"u{k}") == 0))
    own = (F.col("_dx") == 0) & (F.col("_dy") == 0) & (F.col("_dz") == 0)
    whole = tuple(0 - F.col(f"u{k}") - F.col(f"f{k}") for k in "xyz")
    bins = [(F.col(f"bin_{k}") + F.col(f"_d{k}") - F.col(f"u{k}") * F.col(f"n{k}")).cast("int").alias(f"bin_{k}") for k in "xyz"]
    return d, bins, whole, own


def regions(ds: Dataset, cutoff: float, wide: int) -> DataFrame:
    """Bins of ``wide`` cutoffs with all that lies within the cutoff of them, columns as in ``halos`` without parts: a particle goes to the bins that it is near to only."""
    d, bins, whole, own = reached(_binned(ds, ds.particles, _length(cutoff), wide=wide), cutoff)
    seen = g.plus(tuple(F.col(k) for k in "xyz"), g.absolute_vector(whole))
    return d.select("frame", *bins, "idx", *(v.alias(f"h{k}") for k, v in zip("xyz", seen)), *(v.cast("int").alias(f"k{k}") for k, v in zip("xyz", whole)), own.alias("own"))


def half_pairs(ds: Dataset, cutoff: float, carry: dict[str, str] | None = None) -> DataFrame:
    """Each unordered pair within the cutoff once, in either direction; a particle with its own image too."""
    return within(ds, cutoff, half=True, carry=carry)


def pairs(ds: Dataset, cutoff: float, targets: Column | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """All ordered pairs within the cutoff; a particle is its own neighbour only through an image.  ``targets`` selects what may be j."""
    if targets is not None:
        return within(ds, cutoff, ds.particles.where(targets), carry=carry).where("i <> j OR sx <> 0 OR sy <> 0 OR sz <> 0")
    d = half_pairs(ds, cutoff, carry)
    vectors = [f"{c}{k}" for c in "ds" for k in "xyz"]
    turned = {"i": "j", "j": "i"} | {f"{k}{a}": f"{k}{b}" for k in carry or () for a, b in ((1, 2), (2, 1))}
    # A pair comes twice, and what isn't asked for of it is never made.
    d = d.withColumn("_back", F.explode(F.array(F.lit(False), F.lit(True))))
    back = {c: F.col(turned[c]) if c in turned else 0 - F.col(c) for c in [*turned, *vectors]}
    return d.select(*(F.when(F.col("_back"), back[c]).otherwise(F.col(c)).alias(c) if c in back else F.col(c) for c in d.columns if c != "_back"))


def _start(ds: Dataset, targets: DataFrame, k: int) -> DataFrame:
    """The cells with ``_start``, a radius that holds about twice k targets where most targets are, and ``_most``, one that reaches everything.

    The density is what targets see about themselves, from the number of pairs in bins, not the mean over the box; a radius from it makes finer bins, until it
    shrinks no more.  So a cluster in a large empty box starts as in a tight one.
    """
    a, b, c = g.edges()
    radius = lambda each: F.when(F.col("is2d"), F.sqrt(2 * k * each / 3.1416)).otherwise(F.cbrt(2 * k * each * 3 / 12.5664))
    n = targets.groupBy("frame").agg(F.count("*").alias("_n"))
    cells = ds.cells.join(n, "frame", "left").withColumns({"_start": F.coalesce(radius(g.volume() / F.col("_n")), F.lit(1.0)), "_most": 2 * (g.norm(a) + g.norm(b) + g.norm(c))})
    cells = stage(cells.withColumn("_shrunk", F.lit(True)), "radii")
    names = [c for c in cells.columns if c != "_shrunk"]
    while not cells.where("_shrunk").isEmpty():
        d = _binned(ds.having(cells=cells.where("_shrunk")), targets, F.col("_start"))
        held = d.groupBy("frame", "bin_x", "bin_y", "bin_z").agg(F.count("*").alias("m"), F.first(g.volume() / (F.col("nx").cast("double") * F.col("ny") * F.col("nz"))).alias("v"))
        seen = held.groupBy("frame").agg((F.sum(F.col("m") * (F.col("m") - 1)) / F.sum("m")).alias("others"), F.first("v").alias("v"))
        new = cells.join(seen, "frame", "left").withColumn("_new", radius(F.try_divide(F.col("v"), F.col("others"))))
        shrunk = F.col("_shrunk") & F.coalesce(F.col("_new") < 0.6 * F.col("_start"), F.lit(False))
        cells = stage(new.select(*(F.when(shrunk, F.col("_new")).otherwise(F.col("_start")).alias("_start") if c == "_start" else F.col(c) for c in names), shrunk.alias("_shrunk")), "radii")
    return cells.drop("_shrunk", "_n")


def _ranked(d: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("frame", "i").orderBy("d2", "j", "sx", "sy", "sz")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_among(ds: Dataset, targets: DataFrame, k: int, self_too: bool) -> DataFrame:
    """The k nearest targets of each particle over the 27 images.  Particles with fewer within the radius are tried again with twice the radius."""
    cells, factor = _start(ds, targets, k), 1.0
    far = cells.agg(F.max(F.col("_most") / F.col("_start"))).first()[0] or 1.0
    sources, done = ds.particles.select("frame", "idx", *(col(c) for c in POSITION)), []
    while True:
        at = ds.having(cells=cells.withColumn("_radius", F.least(factor * F.col("_start"), F.col("_most"))))
        found = within(at, "_radius", targets, sources, most_images=1)
        if not self_too:
            found = found.where("d2 > 0")
        found = stage(_ranked(found, k), "nearest")
        enough = found.where(F.col("rank") == k).select("frame", F.col("i").alias("idx"))
        last = factor >= far
        done.append(found if last else found.join(enough.withColumnRenamed("idx", "i"), ["frame", "i"]))
        if last:
            break
        sources = sources.join(enough, ["frame", "idx"], "left_anti")
        if sources.isEmpty():
            break
        factor *= 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def knn(ds: Dataset, k: int, targets: Column | None = None) -> DataFrame:
    """The k nearest others: frame, i, rank (from 1), j, dx, dy, dz, d2, shift.  What lies at distance 0 is left out."""
    return nearest_among(ds, ds.particles if targets is None else ds.particles.where(targets), k, self_too=False)


def closest(ds: Dataset, sites: DataFrame) -> DataFrame:
    """The closest site of each particle: frame, i, j, d2.  ``sites`` has frame, idx and positions in the same cell; of equal ones the first."""
    return nearest_among(ds, sites, 1, self_too=True).select("frame", "i", "j", "d2")
