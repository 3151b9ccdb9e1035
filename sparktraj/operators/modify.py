"""Operators that change properties, positions, cells or the set of particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import POSITION, Dataset, col
from sparktraj.functions.expressions import compiled
from sparktraj.operators.neighbors import pairs
from sparktraj.operators.select import SELECTION, evaluated, selected, variables

Matrix = tuple[tuple[float, float, float, float], ...]


def compute_property(ds: Dataset, outputs: dict[str, str], neighbor: dict[str, str] | None = None, cutoff: float = 3.0, integer: bool = False, only_selected: bool = False) -> Dataset:
    """Each output column is its expression, plus, in neighbour mode, the sum of another over all neighbours within the cutoff.

    The neighbour expression sees the neighbour's properties and Distance, Delta.X, Delta.Y, Delta.Z; the first one also sees NumNeighbors and Cutoff.
    Integer targets are cut towards 0.  Of particles that aren't selected the old value stays, or 0.
    """
    names = {f"_out{k}": e for k, e in enumerate(outputs.values())}
    d = ds
    if neighbor is not None:
        near = pairs(ds, cutoff)
        theirs = ds.in_cell().withColumn("_n", F.lit(None).cast("double")).withColumnRenamed("idx", "j")
        known = {k: v for k, v in variables(ds).items() if k != "ParticleIndex"}
        known |= {"Distance": F.sqrt("d2"), "Delta.X": F.col("dx"), "Delta.Y": F.col("dy"), "Delta.Z": F.col("dz"), "ParticleIndex": F.col("j"), "Cutoff": F.lit(cutoff)}
        sums = [F.sum(compiled(neighbor[c], known)).alias(f"_sum{k}") for k, c in enumerate(outputs) if c in neighbor]
        total = near.join(theirs, ["frame", "j"]).groupBy("frame", F.col("i").alias("idx")).agg(F.count("*").cast("double").alias("NumNeighbors"), *sums)
        d = ds.having(particles=ds.particles.join(total, ["frame", "idx"], "left").fillna(0.0, ["NumNeighbors", *(f"_sum{k}" for k, c in enumerate(outputs) if c in neighbor)]).withColumn("Cutoff", F.lit(cutoff)))
    rows = evaluated(d, names)
    for k, c in enumerate(outputs):
        new = F.col(f"_out{k}") + (F.col(f"_sum{k}") if neighbor and c in neighbor else 0.0)
        if integer:
            new = new.cast("int")
        if only_selected:
            new = F.when(selected(ds), new).otherwise(col(c) if ds.has(c) else F.lit(0))
        rows = rows.withColumn(f"_out{k}", new)
    kept = [col(c) for c in ds.particles.columns if c not in outputs]
    return ds.having(particles=rows.select(*kept, *(F.col(f"_out{k}").alias(c) for k, c in enumerate(outputs))))


def bond_lengths(ds: Dataset) -> Dataset:
    """Length of each half-bond with its shift; 0 where an end is missing."""
    ends = ds.particles.select("frame", "idx", *map(col, POSITION))
    d = ds.bonds.join(ends.toDF("frame", "i", "x1", "y1", "z1"), ["frame", "i"], "left").join(ends.toDF("frame", "j", "x2", "y2", "z2"), ["frame", "j"], "left").join(ds.cells, "frame")
    apart = g.plus(tuple(F.col(f"{k}2") - F.col(f"{k}1") for k in "xyz"), g.absolute_vector((F.col("sx"), F.col("sy"), F.col("sz"))))
    return ds.having(bonds=d.withColumn("Length", F.coalesce(g.norm(apart), F.lit(0.0))).select(*ds.bonds.columns, "Length"))


def freeze_property(ds: Dataset, source: str, target: str, frame: int = 0, by: str = "Particle Identifier", missing: str = "error") -> Dataset:
    """The values of one frame at all frames, by identifier, or by place where there is none.  An identifier that isn't unique is an error, and so is a particle without a value, unless ``missing`` is "null"."""
    key = by if ds.has(by) else "idx"
    snap = ds.particles.where(F.col("frame") == frame).groupBy(col(key).alias("_key")).agg(F.first(col(source)).alias("_value"), F.count("*").alias("_count"))
    d = ds.particles.join(snap, col(key) == F.col("_key"), "left")
    fault = F.when(F.col("_count") > 1, F.raise_error(F.lit("an identifier isn't unique")))
    if missing == "error":
        fault = fault.when(F.col("_count").isNull(), F.raise_error(F.lit("a particle isn't in the frozen frame")))
    kept = [col(c) for c in ds.particles.columns if c != target]
    return ds.having(particles=d.select(*kept, F.coalesce(fault.cast(ds.particles.select(col(source)).schema[0].dataType), F.col("_value")).alias(target)))


def affine_transform(ds: Dataset, matrix: Matrix, particles: bool = True, only_selected: bool = False, cell: bool = False) -> Dataset:
    """Positions (and the cell) times a 3x4 matrix."""

    def turned(v: g.Vector, shift: float) -> g.Vector:
        return tuple(m[0] * v[0] + m[1] * v[1] + m[2] * v[2] + m[3] * shift for m in matrix)  # type: ignore[return-value]

    out = ds
    if particles:
        new = turned(tuple(map(col, POSITION)), 1.0)
        out = out.having(particles=ds.particles.withColumns({c: F.when(selected(ds), x).otherwise(col(c)) if only_selected else x for c, x in zip(POSITION, new)}))
    if cell:
        vectors = [*zip("abco", (*g.edges(), g.origin()), (0.0, 0.0, 0.0, 1.0))]
        out = out.having(cells=ds.cells.withColumns({f"{name}{k}": x for name, v, shift in vectors for k, x in zip("xyz", turned(v, shift))}))
    return out


def deform_to(ds: Dataset, target: DataFrame) -> Dataset:
    """Particles and cell are carried to other cells: reduced coordinates stay.  ``target`` has the columns of cells."""
    s = g.reduced(tuple(map(col, POSITION)))
    d = ds.in_cell().withColumns({f"_s{k}": x for k, x in zip("xyz", s)}).select(*map(col, ds.particles.columns), "_sx", "_sy", "_sz").join(target, "frame")
    new = g.absolute((F.col("_sx"), F.col("_sy"), F.col("_sz")))
    d = d.withColumns({f"_p{k}": x for k, x in enumerate(new)})
    return ds.having(particles=d.withColumns({c: F.col(f"_p{k}") for k, c in enumerate(POSITION)}).select(*map(col, ds.particles.columns)), cells=target)


def wrap_periodic(ds: Dataset) -> Dataset:
    """Particles into the cell; the shifts of bonds follow."""
    d = ds.in_cell().withColumn("_flat", F.when(F.col("is2d"), F.raise_error(F.lit("a cell is two-dimensional")).cast("boolean")).otherwise(False)).where("NOT _flat")
    shift = g.images(g.reduced(tuple(map(col, POSITION))))
    d = d.withColumns({f"_f{k}": x for k, x in zip("xyz", shift)})
    new = g.minus(tuple(map(col, POSITION)), g.absolute_vector((F.col("_fx"), F.col("_fy"), F.col("_fz"))))
    bonds = ds.bonds
    if bonds is not None:
        outside = d.select("frame", "idx", "_fx", "_fy", "_fz")
        b = bonds.join(outside.toDF("frame", "i", "ix", "iy", "iz"), ["frame", "i"]).join(outside.toDF("frame", "j", "jx", "jy", "jz"), ["frame", "j"])
        bonds = b.withColumns({f"s{k}": F.col(f"s{k}") - F.col(f"i{k}") + F.col(f"j{k}") for k in "xyz"}).select(*bonds.columns)
    return ds.having(particles=d.withColumns(dict(zip(POSITION, new))).select(*map(col, ds.particles.columns)), bonds=bonds)


COLOR = ("Color.R", "Color.G", "Color.B")


def assign_color(ds: Dataset, color: tuple[float, float, float] = (0.3, 0.3, 1.0), keep_selection: bool = False) -> Dataset:
    """Selected particles get the colour, or all without a selection."""
    on = selected(ds) if ds.has(SELECTION) else F.lit(True)
    d = ds.particles.withColumns({c: F.when(on, F.lit(x)).otherwise(col(c) if ds.has(c) else F.lit(1.0)) for c, x in zip(COLOR, color)})
    return ds.having(particles=d if keep_selection else d.drop(SELECTION))


def _ramp(t: Column, at: list[float], values: list[float]) -> Column:
    """Straight lines between values at places from 0 to 1."""
    out = F.lit(values[-1])
    for a, b, x, y in reversed([*zip(at[:-1], at[1:], values[:-1], values[1:])]):
        out = F.when(t <= b, x + (t - a) / (b - a) * (y - x)).otherwise(out)
    return out


def gradient(name: str, t: Column) -> g.Vector:
    """Colours of t in [0, 1].  rainbow runs through the hues from blue to red; a list of colours is a table that is looked up evenly."""
    if name == "rainbow":
        hue = (1 - t) * 0.7 * 6
        return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (F.abs(hue - 3) - 1, 2 - F.abs(hue - 2), 2 - F.abs(hue - 4)))  # type: ignore[return-value]
    if name == "grayscale":
        return t, t, t
    if name == "hot":
        return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (t / 0.375, (t - 0.375) / 0.375, (t - 0.75) / 0.25))  # type: ignore[return-value]
    if name == "jet":
        return _ramp(t, [0, 0.375, 0.625, 0.875, 1], [0, 0, 1, 1, 0.5]), _ramp(t, [0, 0.125, 0.375, 0.625, 0.875, 1], [0, 0, 1, 1, 0, 0]), _ramp(t, [0, 0.125, 0.375, 0.625, 1], [0.5, 1, 1, 0, 0])
    if name == "blue_white_red":
        return _ramp(t, [0, 0.5, 1], [0, 1, 1]), _ramp(t, [0, 0.5, 1], [0, 1, 0]), _ramp(t, [0, 0.5, 1], [1, 1, 0])
    raise ValueError(f"no gradient {name!r}")


def color_coding(ds: Dataset, property_: str, gradient_name: str = "rainbow", start: float | None = None, end: float | None = None, only_selected: bool = False, lookup: list[tuple[float, float, float]] | None = None) -> Dataset:
    """Colours by a property's place between start and end (each frame's least and greatest value by default)."""
    d, v = ds.particles, col(property_).cast("double")
    lo, hi = F.lit(start), F.lit(end)
    if start is None or end is None:
        d = d.join(d.groupBy("frame").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")), "frame")
        lo, hi = (F.col("_lo") if start is None else lo), (F.col("_hi") if end is None else hi)
    t = F.when(lo == hi, F.when(v == lo, 0.5).when(v > lo, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(v - lo, hi - lo))))
    if lookup is None:
        colors = gradient(gradient_name, t)
    else:
        at = (F.floor(t * (len(lookup) - 1)) + 1).cast("int")
        colors = tuple(F.element_at(F.array(*(F.lit(float(x[k])) for x in lookup)), at) for k in range(3))
    on = selected(ds) if only_selected else F.lit(True)
    new = {c: F.when(on, x).otherwise(col(c) if ds.has(c) else F.lit(1.0)) for c, x in zip(COLOR, colors)}
    return ds.having(particles=d.withColumns(new).drop("_lo", "_hi"))


def replicate(ds: Dataset, counts: tuple[int, int, int], adjust_cell: bool = True, unique_ids: bool = True) -> Dataset:
    """Periodic images -(n-1)/2 .. n/2 in each direction, x outermost; bonds between images are rewired."""
    first = [-((n - 1) // 2) for n in counts]
    d = ds.particles.join(ds.particles.groupBy("frame").agg(F.count("*").alias("_size")), "frame").join(ds.cells, "frame")
    if ds.has("Particle Identifier"):
        d = d.join(ds.particles.groupBy("frame").agg((F.max(col("Particle Identifier")) - F.min(col("Particle Identifier")) + 1).alias("_ids")), "frame")
    for k, n, lo in zip("xyz", counts, first):
        d = d.withColumn(f"_i{k}", F.explode(F.sequence(F.lit(lo), F.lit(lo + n - 1))))
    number = lambda x, y, z: ((x - first[0]) * counts[1] + y - first[1]) * counts[2] + z - first[2]
    image = number(*(F.col(f"_i{k}") for k in "xyz"))
    moved = g.plus(tuple(map(col, POSITION)), g.absolute_vector(tuple(F.col(f"_i{k}") for k in "xyz")))
    new = dict(zip(POSITION, moved)) | {"idx": F.col("idx") + image * F.col("_size")}
    if ds.has("Particle Identifier") and unique_ids:
        new["Particle Identifier"] = col("Particle Identifier") + image * F.col("_ids")
    bonds = ds.bonds
    if bonds is not None:
        b = bonds.join(ds.particles.groupBy("frame").agg(F.count("*").alias("_size")), "frame")
        for k, n, lo in zip("xyz", counts, first):
            b = b.withColumn(f"_i{k}", F.explode(F.sequence(F.lit(lo), F.lit(lo + n - 1))))
        b = b.withColumns({f"_t{k}": F.col(f"_i{k}") + F.col(f"s{k}") - lo for k, lo in zip("xyz", first)})
        b = b.withColumns({f"_j{k}": F.pmod(F.col(f"_t{k}"), F.lit(n)) + lo for k, n, lo in zip("xyz", counts, first)})
        full = F.lit(True) if adjust_cell else F.lit(False)
        b = b.withColumns({f"s{k}": F.when(full, F.floor(F.col(f"_t{k}") / n)).otherwise(F.col(f"s{k}")).cast("int") for k, n in zip("xyz", counts)})
        own, other = number(*(F.col(f"_i{k}") for k in "xyz")), number(*(F.col(f"_j{k}") for k in "xyz"))
        bonds = b.withColumns({"i": F.col("i") + own * F.col("_size"), "j": F.col("j") + other * F.col("_size")}).select(*bonds.columns)
    cells = ds.cells
    if adjust_cell:
        a, b_, c = g.edges()
        start = g.plus(g.origin(), g.absolute_vector(tuple(map(F.lit, first))))
        cells = cells.withColumns({f"o{k}": x for k, x in zip("xyz", start)} | {f"{v}{k}": e * n for v, edge, n in zip("abc", (a, b_, c), counts) for k, e in zip("xyz", edge)})
    return ds.having(particles=d.withColumns(new).select(*map(col, ds.particles.columns)), cells=cells, bonds=bonds)


def combine(ds: Dataset, other: Dataset) -> Dataset:
    """Another set's particles after the first's: the first one's properties, with 0 for what the second lacks, and identifiers that go on."""
    size = ds.particles.groupBy("frame").agg(F.count("*").alias("_size"), *([F.max(col("Particle Identifier")).alias("_max")] if ds.has("Particle Identifier") else []))
    d = other.particles.join(size, "frame", "left").fillna(0, ["_size"])
    cols = []
    for f in ds.particles.schema.fields:
        if f.name == "idx":
            x = F.col("idx") + F.col("_size")
        elif f.name == "Particle Identifier":
            x = F.coalesce(F.col("_max"), F.lit(0)) + 1 + F.col("idx")
        else:
            x = col(f.name) if other.has(f.name) else F.lit(0)
        cols.append(x.cast(f.dataType).alias(f.name))
    bonds = ds.bonds
    if other.bonds is not None:
        more = other.bonds.join(size, "frame", "left").fillna(0, ["_size"]).withColumns({"i": F.col("i") + F.col("_size"), "j": F.col("j") + F.col("_size")})
        bonds = more.drop("_size", "_max") if bonds is None else bonds.unionByName(more.drop("_size", "_max"), allowMissingColumns=True)
    out = ds.having(particles=ds.particles.unionByName(d.select(*cols)), bonds=bonds)
    return out if other.attributes is None else out.with_attributes(other.attributes)


def load_trajectory(ds: Dataset, trajectory: Dataset, by: str = "Particle Identifier") -> Dataset:
    """Positions and cells of every frame of a trajectory on the topology of ``ds`` (one frame); shifts of bonds are found anew."""
    key = by if ds.has(by) and trajectory.has(by) else "idx"
    place = trajectory.particles.select(F.col("frame").alias("_frame"), col(key).alias("_key"), *(col(c).alias(f"_p{k}") for k, c in enumerate(POSITION)))
    d = ds.particles.join(place, col(key) == F.col("_key"))
    d = d.withColumns({c: F.col(f"_p{k}") for k, c in enumerate(POSITION)}).withColumn("frame", F.col("_frame")).select(*map(col, ds.particles.columns))
    out = ds.having(particles=d, cells=trajectory.cells)
    if ds.bonds is None:
        return out
    ends = d.select("frame", "idx", *map(col, POSITION))
    b = ds.bonds.drop("frame").join(ends.toDF("frame", "i", "x1", "y1", "z1"), "i").join(ends.toDF("frame", "j", "x2", "y2", "z2"), ["frame", "j"]).join(trajectory.cells, "frame")
    s = g.reduced_vector(tuple(F.col(f"{k}1") - F.col(f"{k}2") for k in "xyz"))
    shift = g.images(tuple(x + 0.5 for x in s))  # type: ignore[arg-type]
    return out.having(bonds=b.withColumns({f"s{k}": x for k, x in zip("xyz", shift)}).select(*ds.bonds.columns))


def trajectory_lines(ds: Dataset, unwrap: bool = True, by: str = "Particle Identifier", only_selected: bool = False) -> DataFrame:
    """id, frame, x, y, z of particles over time.  Unwrapped: each step is the nearest image's, added up."""
    key = by if ds.has(by) else "idx"
    d = ds.in_cell(ds.particles.where(selected(ds)) if only_selected else ds.particles)
    d = d.withColumns({k: col(c) for k, c in zip("xyz", POSITION)}).withColumn("id", col(key))
    if not unwrap:
        return d.select("id", "frame", "x", "y", "z")
    w = Window.partitionBy("id").orderBy("frame")
    step = g.nearest_image(tuple(F.col(k) - F.lag(k).over(w) for k in "xyz"))
    d = d.withColumns({f"_d{k}": F.coalesce(x, F.col(k)) for k, x in zip("xyz", step)})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.select("id", "frame", *(F.sum(f"_d{k}").over(so_far).alias(k) for k in "xyz"))


