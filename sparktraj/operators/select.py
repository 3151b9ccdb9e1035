"""Selections: an integer column ``Selection``, where what isn't 0 is selected."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj import geometry as g
from sparktraj.dataset import POSITION, col, Dataset, number, stage
from sparktraj.functions.expressions import compiled
from sparktraj.operators.neighbors import knn, within

SELECTION = "Selection"


def selected(ds: Dataset) -> Column:
    """Whether a particle is selected; none is without a selection."""
    return F.coalesce(col(SELECTION) != 0, F.lit(False)) if ds.has(SELECTION) else F.lit(False)


def marked(ds: Dataset, condition: Column) -> Dataset:
    return ds.having(particles=ds.particles.withColumn(SELECTION, F.coalesce(condition, F.lit(False)).cast("int")))


def variables(ds: Dataset) -> dict[str, Column]:
    """What expressions may name, over particles joined with cells (and ``_n``, the number of particles): properties, ParticleIndex, N, Frame and the cell's size."""
    numeric = [f.name for f in ds.particles.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "boolean") and f.name not in ("frame", "idx")]
    out = {name: col(name) for name in numeric}
    if all(map(ds.has, POSITION)):
        out |= dict(zip(("ReducedPosition.X", "ReducedPosition.Y", "ReducedPosition.Z"), g.reduced(tuple(map(col, POSITION)))))
    out |= {"ParticleIndex": F.col("idx"), "Frame": F.col("frame"), "N": F.col("_n"), "CellVolume": g.volume()}
    return out | {f"CellSize.{k}": F.abs(F.col(e)) for k, e in zip("XYZ", ("ax", "by", "cz"))}


def evaluated(ds: Dataset, expressions: dict[str, str]) -> DataFrame:
    """The particles with expressions as further columns.  Attributes of the frame may be named too."""
    d, names = ds.in_cell(), variables(ds)
    if any(re.search(r"\bN\b", e) for e in expressions.values()):
        d = d.join(ds.particles.groupBy("frame").agg(F.count("*").cast("double").alias("_n")), "frame")
    else:
        d = d.withColumn("_n", F.lit(None).cast("double"))
    used = " ".join(expressions.values())
    if ds.attributes is not None:
        keys = [r.key for r in ds.attributes.where("num IS NOT NULL").select("key").distinct().collect() if r.key in used]
        if keys:
            d = d.join(ds.attributes.where(F.col("key").isin(keys)).groupBy("frame").pivot("key", keys).agg(F.first("num")).toDF("frame", *(f"_attr_{k}" for k in range(len(keys)))), "frame", "left")
            names |= {k: F.col(f"_attr_{n}") for n, k in enumerate(keys)}
    cols = {name: compiled(e, names) for name, e in expressions.items()}
    return d.select(*(col(c) for c in ds.particles.columns if c not in cols), *(x.alias(name) for name, x in cols.items()))


def select_expression(ds: Dataset, expression: str) -> Dataset:
    d = evaluated(ds, {"_sel": expression})
    out = ds.having(particles=d.withColumn(SELECTION, F.coalesce(F.col("_sel") != 0, F.lit(False)).cast("int")).drop("_sel"))
    return out.count_attribute("SelectExpression.num_selected", selected(out))


def select_type(ds: Dataset, types: Iterable[int | str], property_: str = "Particle Type") -> Dataset:
    """By ids, or by names of the type table."""
    wanted = set(types)
    names = [t for t in wanted if isinstance(t, str)]
    ids = {t for t in wanted if not isinstance(t, str)}
    if names and ds.types is not None:
        ids |= {r.id for r in ds.types.where((F.col("property") == property_) & F.col("name").isin(names)).select("id").collect()}
    out = marked(ds, col(property_).isin(*ids) if ids else F.lit(False))
    return out.count_attribute("SelectParticleType.num_selected", selected(out))


def invert_selection(ds: Dataset) -> Dataset:
    return marked(ds, ~selected(ds))


def clear_selection(ds: Dataset) -> Dataset:
    return ds.having(particles=ds.particles.drop(SELECTION))


def manual_selection(ds: Dataset, ids: DataFrame, how: str = "replace", by: str = "Particle Identifier") -> Dataset:
    """``ids``: one column of identifiers (or of idx, where there are none), kept and applied at every frame.  how: replace, add, subtract, toggle."""
    key = by if ds.has(by) else "idx"
    hit = ids.toDF("_id").distinct().withColumn("_hit", F.lit(True))
    d = ds.having(particles=ds.particles.join(hit, col(key) == F.col("_id"), "left").drop("_id"))
    chosen, before = F.coalesce("_hit", F.lit(False)), selected(ds)
    out = marked(d, {"replace": chosen, "add": before | chosen, "subtract": before & ~chosen, "toggle": before != chosen}[how])
    return out.having(particles=out.particles.drop("_hit"))


def _reached(ds: Dataset, cutoff: float, chosen: DataFrame, new: DataFrame) -> DataFrame:
    """Particles that aren't chosen within the cutoff of new ones.

    A bin whose diagonal is under the cutoff is reached as a whole if one of its particles is new, so where particles are dense nothing is compared; what lies in other bins is compared
    with new particles of the bins around.
    """
    rest = ds.particles.join(chosen, ["frame", "idx"], "left_anti")
    hot = ds.particles.join(new, ["frame", "idx"], "left_semi").select("frame", "idx", *map(col, POSITION))
    rest = rest.select("frame", "idx", *map(col, POSITION))
    # Bins of the wrapped places; the diagonal of a bin is that of the cell over the number of bins.
    a, b, c = g.edges()
    longest = F.greatest(*(g.norm(g.plus(g.plus(a, g.times(b, y)), g.times(c, z))) for y in (1.0, -1.0) for z in (1.0, -1.0)))
    n = F.least(F.lit(2.0**20), F.ceil(longest / cutoff * (1 + 1e-9)))

    def binned(d: DataFrame) -> DataFrame:
        d = d.join(ds.cells, "frame")
        s = g.reduced(tuple(map(col, POSITION)))
        d = d.withColumns({f"_s{k}": x for k, x in zip("xyz", s)} | {"_n": n, "_small": longest / n <= cutoff * (1 - 1e-12)})
        inside = tuple(F.when(p, F.col(f"_s{k}") - F.floor(f"_s{k}")).otherwise(F.col(f"_s{k}")) for k, p in zip("xyz", g.periodic()))
        # In a flat cell z is no part of the cell.
        flat = F.col("is2d")
        bins = {f"_b{k}": F.when(flat & F.lit(k == "z"), col("Position.Z")).otherwise(F.floor(x * F.col("_n"))).cast("double") for k, x in zip("xyz", inside)}
        return d.withColumns(bins).where("_small")

    at = ["frame", "_bx", "_by", "_bz"]
    full = binned(hot).select(*at).distinct()
    whole = stage(binned(rest).join(full, at, "left_semi").select("frame", "idx"), "whole")
    left = rest.join(whole, ["frame", "idx"], "left_anti")
    return whole.unionByName(within(ds, cutoff, targets=left, sources=hot).select("frame", F.col("j").alias("idx")))


def expand_selection(ds: Dataset, mode: str = "cutoff", cutoff: float = 3.2, nearest: int = 1, iterations: int = 1, mirrored: bool = False) -> Dataset:
    """Adds the neighbours of what is selected, each round from the one before.  mode: cutoff, nearest, bonded.  ``mirrored``: all bonds are there in both directions, as created ones are, so one is enough."""
    if mode == "cutoff":
        edges = None
    elif mode == "nearest":
        edges = stage(knn(ds, nearest).select("frame", "i", "j"), "edges")
    else:
        edges = None
    chosen = stage(ds.particles.where(selected(ds)).select("frame", "idx"), "chosen")
    new = chosen
    for _ in range(iterations):
        # What was chosen before has its neighbours already, and what is chosen finds none anew: no more edges are looked at than those of new particles.
        if mode == "cutoff":
            near = _reached(ds, cutoff, chosen, new)
        elif mode == "nearest":
            near = edges.join(new.withColumnRenamed("idx", "i"), ["frame", "i"], "left_semi").select("frame", F.col("j").alias("idx"))
        else:
            ends = [ds.bonds.join(new.withColumnRenamed("idx", a), ["frame", a], "left_semi").select("frame", F.col(b).alias("idx")) for a, b in (("i", "j"), ("j", "i"))[: 1 if mirrored else 2]]
            near = ends[0] if mirrored else ends[0].unionByName(ends[1])
        new = stage(near.distinct().join(chosen, ["frame", "idx"], "left_anti"), "new")
        chosen = chosen.unionByName(new)
    d = ds.particles.join(chosen.withColumn("_in", F.lit(1)), ["frame", "idx"], "left")
    out = ds.having(particles=d.withColumn(SELECTION, F.coalesce("_in", F.lit(0))).drop("_in").select(*map(col, dict.fromkeys([*ds.particles.columns, SELECTION]))))
    return out.count_attribute("ExpandSelection.num_selected", selected(out))


def slab(normal: tuple[float, float, float], distance: float, width: float, inverse: bool) -> Column:
    """Whether a particle is cut away by a plane (width 0) or a slab."""
    size = math.sqrt(sum(x * x for x in normal))
    n = tuple(x / size for x in normal) if size else (0.0, 0.0, 1.0)
    away = n[0] * col(POSITION[0]) + n[1] * col(POSITION[1]) + n[2] * col(POSITION[2]) - distance
    if width <= 0:
        return -away > 0 if inverse else away > 0
    inside = F.abs(away) <= width / 2
    return inside if inverse else ~inside


def slice_particles(ds: Dataset, normal: tuple[float, float, float] = (1.0, 0.0, 0.0), distance: float = 0.0, width: float = 0.0, inverse: bool = False, only_selected: bool = False, select: bool = False, renumber: bool = True) -> Dataset:
    """Cuts away, or selects, what lies beyond a plane or outside of a slab; ``renumber`` as for ``delete``."""
    cut = slab(normal, distance, width, inverse)
    if only_selected:
        cut = cut & selected(ds)
    return marked(ds, cut) if select else delete(ds, cut, renumber)


def delete(ds: Dataset, gone: Column, renumber: bool = True) -> Dataset:
    """Removes particles and the bonds that hung on them, and numbers the rest anew within each frame, which deals all of them out by ranges and writes them once.

    Without ``renumber`` the rest keep their idx, with gaps, and nothing runs before the result is asked for.
    """
    left = ds.particles.where(~F.coalesce(gone, F.lit(False)))
    left = number(left, ["idx"], "_new") if renumber else left.withColumn("_new", F.col("idx"))
    bonds = ds.bonds
    if bonds is not None:
        at = left.select("frame", "idx", "_new")
        for end in ("i", "j"):
            bonds = bonds.join(at.toDF("frame", end, f"_{end}"), ["frame", end])
        bonds = bonds.withColumns({"i": F.col("_i"), "j": F.col("_j")}).select(*ds.bonds.columns)
    return ds.having(particles=left.withColumn("idx", F.col("_new")).select(*map(col, ds.particles.columns)), bonds=bonds)


def delete_selected(ds: Dataset) -> Dataset:
    out = delete(ds, selected(ds))
    return out.having(particles=out.particles.drop(SELECTION))


def select_range(ds: Dataset, ranges: dict[str, tuple[float, float]]) -> Dataset:
    """Particles with every named property in its closed range; bounds may be in either order."""
    inside = F.lit(True)
    for name, (a, b) in ranges.items():
        inside = inside & col(name).between(min(a, b), max(a, b))
    return marked(ds, inside)
