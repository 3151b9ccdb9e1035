"""Lattice frames, clusters of one lattice, their transitions, grains, and elastic strain, all from the orientations of template matching.

A particle's orientation is one of several that its crystal's symmetry makes equal, so neighbours that belong to one lattice agree up to an element of the
symmetry group.  A link carries that element and the angle that is left.  Clusters are components of links of small angles, and their stars
carry the composed element along: each particle knows which of its equal orientations goes with its cluster's frame, however far the
crystal bends.  Links whose element isn't the one that the frames of their ends give are where two paths disagree.  Products of elements are
looked up in tables, so components stay joins and aggregates.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj.dataset import Dataset, col, number, on_workers, stage
from sparktraj.operators.analyze import components
from sparktraj.operators.neighbors import knn
from sparktraj.operators.templates import KINDS, quaternions, template

CRYSTALS = ("FCC", "HCP", "BCC", "SC")
_Q = [f"Orientation.{c}" for c in "XYZW"]


@functools.cache
def group(kind: str) -> tuple[np.ndarray, list[int], list[int], int]:
    """A kind's rotations, the table of products (row times column), inverses, and the place of the identity."""
    r = template(kind).rotations
    n = len(r)
    place = lambda m: np.abs(r[None] - m[:, None]).max(axis=(2, 3)).argmin(axis=1)
    product = place((r[:, None] @ r[None]).reshape(-1, 3, 3))
    return r, product.tolist(), place(np.swapaxes(r, 1, 2)).tolist(), int(place(np.eye(3)[None])[0])


def _table(kind: Column, of) -> Column:
    """The table of each kind as a literal, by the kind's id."""
    out = F.lit(None).cast("array<int>")
    for k in CRYSTALS:
        out = F.when(kind == KINDS.index(k), F.lit(of(k))).otherwise(out)
    return out


def _times(a: Column, b: Column, kind: Column) -> Column:
    size = _table(kind, lambda k: [len(group(k)[0])])[0]
    return F.get(_table(kind, lambda k: group(k)[1]), a * size + b)


def _inverse(a: Column, kind: Column) -> Column:
    return F.get(_table(kind, lambda k: group(k)[2]), a)


def matrices(q: np.ndarray) -> np.ndarray:
    """Rotations of quaternions (x, y, z, w)."""
    x, y, z, w = q.T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)


def angles(r: np.ndarray) -> np.ndarray:
    """Angles of rotations, in degrees."""
    axis = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], axis=-1)
    return np.degrees(np.arctan2(np.linalg.norm(axis, axis=-1), np.trace(r, axis1=-2, axis2=-1) - 1))


def _floats(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(b) else np.zeros((0, len(names)))


def links(ds: Dataset, neighbours: int = 12) -> DataFrame:
    """frame, u, v (u < v), kind, kind2, t, angle: particles of which one is among the other's nearest, both of a crystal.

    Of one kind, ``t`` is the place of the element that turns u's lattice coordinates into v's, and ``angle`` what is left, in degrees; of two kinds both are null.
    ``ds`` has the columns of template matching.  Staged.
    """
    ids = [KINDS.index(k) for k in CRYSTALS]
    p = ds.particles.select("frame", "idx", col("Structure Type").alias("kind"), *(col(c).alias(f"q{k}") for k, c in enumerate(_Q))).where(F.col("kind").isin(ids))
    near = knn(ds, neighbours).where("i <> j").select("frame", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()
    d = near.join(p.select("frame", F.col("idx").alias("u"), F.col("kind"), *(F.col(f"q{k}").alias(f"a{k}") for k in range(4))), ["frame", "u"])
    d = d.join(p.select("frame", F.col("idx").alias("v"), F.col("kind").alias("kind2"), *(F.col(f"q{k}").alias(f"b{k}") for k in range(4))), ["frame", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (matrices(_floats(b, [f"{x}{k}" for k in range(4)])) for x in "ab")
            kind, other = b.column("kind").to_numpy(), b.column("kind2").to_numpy()
            t, angle = np.zeros(len(b), np.int32), np.zeros(len(b))
            for k in CRYSTALS:
                rows = np.flatnonzero((kind == KINDS.index(k)) & (other == kind))
                if len(rows):
                    of = group(k)[0]
                    t[rows] = np.einsum("mji,mjk,gki->mg", one[rows], two[rows], of).argmax(axis=1)
                    angle[rows] = angles(np.swapaxes(one[rows], 1, 2) @ two[rows] @ of[t[rows]])
            apart = kind != other
            yield pa.record_batch([*(b.column(c) for c in ("frame", "u", "v", "kind", "kind2")), pa.array(t, mask=apart), pa.array(angle, mask=apart)], names=["frame", "u", "v", "kind", "kind2", "t", "angle"])

    on_workers(ds.spark)
    return stage(d.mapInArrow(run, "frame int, u long, v long, kind int, kind2 int, t int, angle double"), "links")


def framed_components(edges: DataFrame) -> DataFrame:
    """Components of edges (frame, u, v, kind, t) within kinds: frame, idx, root (the least idx), t from the particle's coordinates to the root's.

    Large and small stars as for plain components, each edge with the product of the elements on its way.  Where ways disagree the least element stays.
    """
    kind = F.col("kind")
    e, before = edges.where("u <> v").select("frame", "kind", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.when(F.col("u") > F.col("v"), F.col("t")).otherwise(_inverse(F.col("t"), kind)).alias("t")), None
    place = ["frame", "kind", "u"]
    while True:
        both = e.unionByName(e.select("frame", "kind", F.col("v").alias("u"), F.col("u").alias("v"), _inverse(F.col("t"), kind).alias("t")))
        least = both.groupBy(*place).agg(F.min(F.struct("v", "t")).alias("m"))
        same = F.col("u") < F.col("m.v")
        one = _table(kind, lambda k: [group(k)[3]])[0]
        least = least.select(*place, F.least("u", "m.v").alias("m"), F.when(same, one).otherwise(F.col("m.t")).alias("tm"))
        through = _times(F.col("tm"), _inverse(F.col("t"), kind), kind)
        large = both.join(least, place).where("v > u AND v <> m").select("frame", "kind", F.col("v").alias("u"), F.col("m").alias("v"), through.alias("t"))
        large = large.groupBy(*place, "v").agg(F.min("t").alias("t"))
        least = large.groupBy(*place).agg(F.min(F.struct("v", "t")).alias("m")).select(*place, F.col("m.v").alias("m"), F.col("m.t").alias("tm"))
        small = large.join(least, place).where("v <> m").select("frame", "kind", F.col("v").alias("u"), F.col("m").alias("v"), through.alias("t"))
        e = small.unionByName(least.select(*place, F.col("m").alias("v"), F.col("tm").alias("t"))).groupBy(*place, "v").agg(F.min("t").alias("t"))
        e = stage(e, "framed-stars")
        now = e.selectExpr("count(*)", "bit_xor(xxhash64(frame, u, v, t))").first()
        if now == before:
            break
        before = now
    return e.select("frame", F.col("u").alias("idx"), F.col("v").alias("root"), "t").unionByName(e.select("frame", F.col("v").alias("idx"), F.col("v").alias("root"), _table(kind, lambda k: [group(k)[3]])[0].alias("t")).distinct())


def lattice_clusters(ds: Dataset, threshold: float = 5.0, found: DataFrame | None = None) -> tuple[Dataset, DataFrame]:
    """``Lattice Cluster`` (from 1 by falling size, of equal ones the least index; 0 for what is no crystal) and ``Lattice Frame.X`` to ``.W``, the particle's
    orientation that goes with its cluster's frame; and the clusters: frame, cluster, kind, size, mean orientation qx to qw, and n_disagree, links
    whose ends' frames don't give their element.

    A cluster is what links of one kind and at most ``threshold`` degrees connect.  ``found``: the table of ``links``, where there is one already.
    """
    found = links(ds) if found is None else found
    near = found.where(F.col("angle") <= threshold)
    kinds = ds.particles.select("frame", "idx", col("Structure Type").alias("kind"), *(col(c).alias(f"q{k}") for k, c in enumerate(_Q))).where(F.col("kind").isin([KINDS.index(k) for k in CRYSTALS]))
    own = _table(F.col("kind"), lambda k: [group(k)[3]])[0]
    of = stage(kinds.join(framed_components(near), ["frame", "idx"], "left").withColumns({"root": F.coalesce("root", "idx"), "t": F.coalesce("t", own)}), "framed")
    sizes = of.groupBy("frame", "root").agg(F.count("*").alias("size"), F.first("kind").alias("kind")).withColumn("_smaller", -F.col("size"))
    numbered = stage(number(sizes, ["_smaller", "root"], "_place").withColumn("cluster", (F.col("_place") + 1).cast("int")), "clusters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, kind, t = matrices(_floats(b, [f"q{k}" for k in range(4)])), b.column("kind").to_numpy(), b.column("t").to_numpy()
            for k in CRYSTALS:
                rows = kind == KINDS.index(k)
                r[rows] = r[rows] @ np.swapaxes(group(k)[0][t[rows]], 1, 2)
            q = quaternions(r) if len(r) else np.zeros((0, 4))
            yield pa.record_batch([*(b.column(c) for c in ("frame", "idx", "root", "t")), *(pa.array(np.ascontiguousarray(x)) for x in q.T)], names=["frame", "idx", "root", "t", "x", "y", "z", "w"])

    on_workers(ds.spark)
    turned = of.select("frame", "idx", "root", "t", "kind", *(f"q{k}" for k in range(4))).mapInArrow(run, "frame int, idx long, root long, t int, x double, y double, z double, w double")
    turned = stage(turned.join(numbered.select("frame", "root", "cluster"), ["frame", "root"]), "frames")
    # A quaternion and its negative are one rotation; sums take the sign that goes with the root's.
    root = turned.where("idx = root").select("frame", "root", *(F.col(c).alias(f"r{c}") for c in "xyzw"))
    sign = F.signum(sum((F.col(c) * F.col(f"r{c}") for c in "yzw"), F.col("x") * F.col("rx")))
    mean = turned.join(root, ["frame", "root"]).groupBy("frame", "cluster").agg(*(F.sum(F.col(c) * sign).alias(c) for c in "xyzw"))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in "yzw"), F.col("x") * F.col("x")))
    ends = turned.select("frame", "idx", "root", "t")
    odd = near.join(ends.toDF("frame", "u", "_ru", "_tu"), ["frame", "u"]).join(ends.toDF("frame", "v", "_rv", "_tv"), ["frame", "v"])
    odd = odd.where(F.col("t") != _times(_inverse(F.col("_tv"), F.col("kind")), F.col("_tu"), F.col("kind"))).groupBy("frame", F.col("_ru").alias("root")).agg(F.count("*").alias("n_disagree"))
    table = numbered.join(odd, ["frame", "root"], "left").join(mean, ["frame", "cluster"]).select("frame", "cluster", "kind", "size", *((F.col(c) / size).alias(f"q{c}") for c in "xyzw"), F.coalesce("n_disagree", F.lit(0)).alias("n_disagree"))
    names = {"Lattice Cluster": F.coalesce("cluster", F.lit(0))} | {f"Lattice Frame.{c.upper()}": F.coalesce(F.col(c), F.lit(0.0)) for c in "xyzw"}
    p = ds.particles.drop(*names).join(turned.select("frame", "idx", "cluster", *"xyzw"), ["frame", "idx"], "left")
    return ds.having(particles=p.withColumns(names).drop("cluster", *"xyzw")), stage(table, "lattice-clusters")


def transitions(ds: Dataset, clusters: DataFrame, found: DataFrame) -> DataFrame:
    """How clusters that touch are turned against each other: frame, a, b (a < b), n_links, via (whether only through a cluster of another kind that
    touches both), angle in degrees and axis ax, ay, az in the frame of a.

    Of all rotations from a's frame to b's that the symmetries of both make equal, that of the least angle.
    """
    at = ds.particles.select("frame", "idx", col("Lattice Cluster").alias("c"))
    pairs = found.join(at.toDF("frame", "u", "a"), ["frame", "u"]).join(at.toDF("frame", "v", "b"), ["frame", "v"]).where("a <> b")
    direct = stage(pairs.groupBy("frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n_links")), "touching")
    both = direct.unionByName(direct.select("frame", F.col("b").alias("a"), F.col("a").alias("b"), "n_links"))
    kind = clusters.select("frame", "cluster", "kind")
    both = both.join(kind.toDF("frame", "a", "ka"), ["frame", "a"]).join(kind.toDF("frame", "b", "kb"), ["frame", "b"])
    through = both.where("ka <> kb").select("frame", F.col("b").alias("c"), "a", "ka", "n_links")
    through = through.join(through.select("frame", "c", F.col("a").alias("b"), F.col("ka").alias("kb"), F.col("n_links").alias("n2")), ["frame", "c"]).where("a < b AND ka = kb")
    through = through.groupBy("frame", "a", "b").agg(F.sum(F.least("n_links", "n2")).alias("n_links")).join(direct, ["frame", "a", "b"], "left_anti")
    d = direct.withColumn("via", F.lit(False)).unionByName(through.withColumn("via", F.lit(True)))
    q = lambda x: clusters.select("frame", F.col("cluster").alias(x), F.col("kind").alias(f"k{x}"), *(F.col(f"q{c}").alias(f"{x}{c}") for c in "xyzw"))
    d = d.join(q("a"), ["frame", "a"]).join(q("b"), ["frame", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (matrices(_floats(b, [f"{x}{c}" for c in "xyzw"])) for x in "ab")
            ka, kb = b.column("ka").to_numpy(), b.column("kb").to_numpy()
            r = np.swapaxes(two, 1, 2) @ one
            for n in range(len(r)):
                of, to = group(KINDS[ka[n]])[0], group(KINDS[kb[n]])[0]
                every = (to[:, None] @ r[n] @ of[None]).reshape(-1, 3, 3)
                r[n] = every[np.trace(every, axis1=1, axis2=2).argmax()]
            axis = quaternions(r)[:, :3] if len(r) else np.zeros((0, 3))
            size = np.linalg.norm(axis, axis=1, keepdims=True)
            axis = np.divide(axis, size, out=np.zeros_like(axis), where=size > 1e-12)
            yield pa.record_batch([*(b.column(c) for c in ("frame", "a", "b", "n_links", "via")), pa.array(angles(r)), *(pa.array(np.ascontiguousarray(x)) for x in axis.T)], names=["frame", "a", "b", "n_links", "via", "angle", "ax", "ay", "az"])

    on_workers(ds.spark)
    return d.mapInArrow(run, "frame int, a int, b int, n_links long, via boolean, angle double, ax double, ay double, az double")


def grains(ds: Dataset, threshold: float = 3.0, least_size: int = 10, adopt: bool = True, found: DataFrame | None = None) -> Dataset:
    """``Grain``: from 1 by falling size, of equal ones the least index; 0 for none.  And the frame's ``GrainSegmentation.grain_count``.

    Links of one kind under ``threshold`` degrees join their ends.  Then, in rounds, each grain of fewer than ``least_size`` particles joins the grain across its
    link of least angle (of equal ones that of the least indices), whatever the angle; what stays small without such a link is dissolved.  With ``adopt``,
    particles without a grain take, round by round, that of the nearest of their 12 nearest neighbours that has one.
    """
    found = (links(ds) if found is None else found).where("kind = kind2")
    crystal = ds.particles.where(col("Structure Type").isin([KINDS.index(k) for k in CRYSTALS])).select("frame", "idx")
    joined = components(found.where(F.col("angle") < threshold).select("frame", F.col("u").alias("i"), F.col("v").alias("j")))
    of = stage(crystal.join(joined, ["frame", "idx"], "left").withColumn("root", F.coalesce("root", "idx")), "grains")
    while True:
        ends = of.join(of.groupBy("frame", "root").agg(F.count("*").alias("size")), ["frame", "root"])
        d = found.join(ends.select("frame", F.col("idx").alias("u"), F.col("root").alias("a"), F.col("size").alias("na")), ["frame", "u"]).join(ends.select("frame", F.col("idx").alias("v"), F.col("root").alias("b"), F.col("size").alias("nb")), ["frame", "v"]).where("a <> b")
        ways = F.array(F.struct(F.col("a").alias("from"), F.col("na").alias("size"), F.col("b").alias("to")), F.struct(F.col("b").alias("from"), F.col("nb").alias("size"), F.col("a").alias("to")))
        d = d.select("frame", "angle", "u", "v", F.explode(ways).alias("w")).where(F.col("w.size") < least_size)
        best = stage(d.groupBy("frame", F.col("w.from").alias("i")).agg(F.min_by("w.to", F.struct("angle", "u", "v")).alias("j")), "merges")
        if best.isEmpty():
            break
        onto = components(best).toDF("frame", "root", "_to")
        of = stage(of.join(onto, ["frame", "root"], "left").select("frame", "idx", F.coalesce("_to", "root").alias("root")), "grains")
    sizes = of.groupBy("frame", "root").agg(F.count("*").alias("n")).where(F.col("n") >= least_size)
    of = stage(of.join(sizes.select("frame", "root"), ["frame", "root"], "left_semi").select("frame", "idx", "root"), "grains")
    if adopt:
        near = stage(knn(ds, 12).select("frame", "i", "j", "rank"), "near")
        while True:
            free = near.join(of.select("frame", F.col("idx").alias("i")), ["frame", "i"], "left_anti")
            more = free.join(of.select("frame", F.col("idx").alias("j"), "root"), ["frame", "j"]).groupBy("frame", F.col("i").alias("idx")).agg(F.min_by("root", "rank").alias("root"))
            more = stage(more, "adopted")
            if more.isEmpty():
                break
            of = stage(of.unionByName(more), "grains")
    sizes = of.groupBy("frame", "root").agg((-F.count("*")).alias("_smaller"))
    numbered = number(sizes, ["_smaller", "root"], "_place").select("frame", "root", (F.col("_place") + 1).cast("int").alias("Grain"))
    p = ds.particles.drop("Grain").join(of.join(numbered, ["frame", "root"]).select("frame", "idx", "Grain"), ["frame", "idx"], "left")
    out = ds.having(particles=p.withColumn("Grain", F.coalesce("Grain", F.lit(0))))
    count = ds.cells.select("frame").join(sizes.groupBy("frame").agg(F.count("*").alias("n")), "frame", "left")
    return out.with_attributes(count.select("frame", F.lit("GrainSegmentation.grain_count").alias("key"), F.coalesce("n", F.lit(0)).alias("num")))


def elastic_strain(ds: Dataset, structure: str, lattice_constant: float, ca_ratio: float = math.sqrt(8 / 3), push_forward: bool = True) -> Dataset:
    """``Elastic Strain.XX`` to ``.YZ``, ``Volumetric Elastic Strain`` and ``Elastic Gradient.XX`` to ``.ZZ`` (column after column) of particles of one structure, against its ideal lattice.

    The gradient maps ideal lattice vectors, in the frame of the particle's cluster, to the particle's neighbours.  Strain is Euler's in space, or with ``push_forward`` off Green's in the
    cluster's frame.  Other particles have zeros and are selected.  ``ds`` has the columns of template matching and of ``lattice_clusters``.
    """
    if structure not in CRYSTALS:
        raise ValueError(f"structures are of {CRYSTALS}")
    nearest = {"FCC": math.sqrt(0.5), "BCC": math.sqrt(0.75), "SC": 1.0, "HCP": 1.0}[structure] * lattice_constant
    stretch = np.diag([1.0, 1.0, math.sqrt(8 / 3) / ca_ratio if structure == "HCP" else 1.0])
    axes = [f"{r}{c}" for c in "XYZ" for r in "XYZ"]
    parts = ("XX", "YY", "ZZ", "XY", "XZ", "YZ")
    out = [*(f"Elastic Strain.{k}" for k in parts), "Volumetric Elastic Strain", *(f"Elastic Gradient.{k}" for k in axes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.swapaxes(_floats(b, [f"f{k}" for k in range(9)]).reshape(-1, 3, 3), 1, 2) @ stretch * (b.column("d").to_numpy() / nearest)[:, None, None]
            own, frame = (matrices(_floats(b, [f"{x}{k}" for k in range(4)])) for x in "qc")
            f = f @ (np.swapaxes(own, 1, 2) @ frame)  # from the cluster's frame to the particle's own
            if push_forward:
                i = np.linalg.inv(f)
                e = (np.eye(3) - np.swapaxes(i, 1, 2) @ i) / 2
            else:
                e = (np.swapaxes(f, 1, 2) @ f - np.eye(3)) / 2
            cols = [*(e[:, "XYZ".index(k[0]), "XYZ".index(k[1])] for k in parts), np.trace(e, axis1=1, axis2=2) / 3, *np.swapaxes(f, 1, 2).reshape(-1, 9).T]
            yield pa.record_batch([b.column("frame"), b.column("idx"), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["frame", "idx", *out])

    on_workers(ds.spark)
    fit = ds.particles.where((col("Structure Type") == KINDS.index(structure)) & (col("Lattice Cluster") > 0))
    given = [col("Interatomic Distance").alias("d"), *(col(f"Elastic Deformation Gradient.{k}").alias(f"f{n}") for n, k in enumerate(axes)), *(col(c).alias(f"q{k}") for k, c in enumerate(_Q)), *(col(f"Lattice Frame.{c}").alias(f"c{k}") for k, c in enumerate("XYZW"))]
    found = fit.select("frame", "idx", *given).mapInArrow(run, "frame int, idx long, " + ", ".join(f"`{c}` double" for c in out))
    p = ds.particles.drop(*out, "Selection").join(found.withColumn("_ok", F.lit(0)), ["frame", "idx"], "left")
    return ds.having(particles=p.withColumns({c: F.coalesce(col(c), F.lit(0.0)) for c in out} | {"Selection": F.coalesce("_ok", F.lit(1))}).drop("_ok"))
