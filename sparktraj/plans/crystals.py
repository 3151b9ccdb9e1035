"""Queries about local structure, over crystals that are built from the table of parts.

Each part is a site: parts are dealt out to four frames (fcc, hcp, bcc and diamond crystals), fill cubes of cells in order, and are
shaken a little, those of the largest sizes much.  Where the last cells are missing the crystal has a surface, so that all kinds occur.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparktraj.dataset import POSITION, Dataset, box, cells_of, col
from sparktraj.operators import analyze, grains, mesh, modify, select, structure, surface, templates
from sparktraj.operators.voronoi import voronoi
from sparktraj.plans.adapters import cloud
from sparktraj.plans.queries import _CLOUD, _NEAR, _PAIRS, RC, _r, query

#: Edges of a cell, and its sites in units of them.
_H = math.sqrt(0.5)
_FACES = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
CRYSTALS = [
    ((1.0, 1.0, 1.0), _FACES),
    ((_H, _H * math.sqrt(3), _H * math.sqrt(8 / 3)), [(0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.5, 5 / 6, 0.5), (0.0, 1 / 3, 0.5)]),
    ((1.0, 1.0, 1.0), [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]),
    ((1.0, 1.0, 1.0), _FACES + [(x + 0.25, y + 0.25, z + 0.25) for x, y, z in _FACES]),
]


def crystals(spark: SparkSession, sf_dir: str) -> Dataset:
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    sites = (t.count() + 3) // 4
    d = t.withColumn("frame", (F.col("id") % 4).cast("int")).withColumn("m", F.expr("id DIV 4"))
    edges, place = [], {c: F.lit(0.0) for c in POSITION}
    for frame, (size, basis) in enumerate(CRYSTALS):
        n = len(basis)
        along = math.ceil(round((-(-sites // n)) ** (1 / 3), 9))
        edges.append(box(frame, tuple(along * s for s in size)))
        cell = F.expr(f"m DIV {n}")
        at = (cell % along, F.expr(f"(m DIV {n}) DIV {along}") % along, F.expr(f"(m DIV {n}) DIV {along * along}"))
        site = (F.col("m") % n + 1).cast("int")
        for k, c in enumerate(POSITION):
            inner = F.element_at(F.array(*(F.lit(b[k]) for b in basis)), site)
            place[c] = F.when(F.col("frame") == frame, (at[k] + inner) * size[k]).otherwise(place[c])
    shaken = F.when(F.col("size") > 45, 0.3).otherwise(0.05)
    place = {c: x + shaken * ((F.col("id") * p) % 101 / 101.0 - 0.5) for (c, x), p in zip(place.items(), (37, 53, 71))}
    p = d.select("frame", F.col("id").alias("idx"), F.col("id").alias("Particle Identifier"), *(x.alias(c) for c, x in place.items()))
    return Dataset(p, cells_of(spark, edges))


def _sites_sql() -> str:
    frames = []
    for frame, (size, basis) in enumerate(CRYSTALS):
        n = len(basis)
        at = ("(m // {n}) % a", "((m // {n}) // a) % a", "(m // {n}) // (a * a)")
        xyz = (f"({at[k].format(n=n)} + CAST(([{', '.join(repr(float(b[k])) for b in basis)}])[CAST(m % {n} AS INT) + 1] AS DOUBLE)) * CAST({size[k]!r} AS DOUBLE)" for k in range(3))
        lengths = (f"a * CAST({s!r} AS DOUBLE) AS l{c}" for s, c in zip(size, "xyz"))
        frames.append(f"SELECT {frame} AS f, id, size, {', '.join(f'{e} AS {c}' for e, c in zip(xyz, 'xyz'))}, {', '.join(lengths)} FROM t0, (SELECT CAST(ceil(round(pow(ceil(s / {n}.0), 1.0 / 3), 9)) AS BIGINT) AS a FROM n0) WHERE f0 = {frame}")
    shake = ", ".join(f"{c} + (CASE WHEN size > 45 THEN 0.3 ELSE 0.05 END) * ((id * {p}) % 101 / 101.0 - 0.5) AS {c}" for c, p in zip("xyz", (37, 53, 71)))
    return (
        "n0 AS (SELECT (count(*) + 3) // 4 AS s FROM part), t0 AS (SELECT p_partkey AS id, p_size AS size, p_partkey % 4 AS f0, p_partkey // 4 AS m FROM part), "
        f"s0 AS ({' UNION ALL '.join(frames)}), c AS (SELECT f, id, {shake}, lx, ly, lz FROM s0), "
        "v0 AS (SELECT a.f, a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, a.lx, a.ly, a.lz FROM c a JOIN c b ON a.f = b.f AND a.id <> b.id), "
        "v1 AS (SELECT f, i, j, dx - lx * round(dx / lx) AS dx, dy - ly * round(dy / ly) AS dy, dz - lz * round(dz / lz) AS dz FROM v0), v2 AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM v1)"
    )


#: All pairs of a crystal (v2), and the nearest 14 (k).
_SITES = _sites_sql()
_NEAREST = _SITES + ", k AS (SELECT *, row_number() OVER (PARTITION BY f, i ORDER BY d2, j) AS rank FROM v2 QUALIFY rank <= 14)"


def _signatures(name: str, near: str, cutoff: str) -> str:
    """Tables of the signatures of neighbours: ``near`` has f, i, j, dx, dy, dz, and ``cutoff`` has f, i, rc.  Result: <name>s (f, i, p, a, b, c)."""
    n = name
    return f"""{n}e AS (SELECT x.f, x.i, x.j AS p, y.j AS q FROM {near} x JOIN {near} y ON x.f = y.f AND x.i = y.i AND x.j <> y.j JOIN {cutoff} u ON u.f = x.f AND u.i = x.i WHERE pow(x.dx - y.dx, 2) + pow(x.dy - y.dy, 2) + pow(x.dz - y.dz, 2) <= rc * rc),
{n}t AS (SELECT x.f, x.i, x.p, x.q, y.q AS r FROM {n}e x JOIN {n}e y ON x.f = y.f AND x.i = y.i AND x.p = y.p JOIN {n}e z ON z.f = x.f AND z.i = x.i AND z.p = x.q AND z.q = y.q),
{n}g(f, i, p, node, root) AS (SELECT f, i, p, q, q FROM {n}t UNION SELECT g.f, g.i, g.p, t.r, g.root FROM {n}g g JOIN {n}t t ON t.f = g.f AND t.i = g.i AND t.p = g.p AND t.q = g.node),
{n}m AS (SELECT f, i, p, node, min(root) AS root FROM {n}g GROUP BY ALL),
{n}l AS (SELECT f, i, p, max(c) AS c, sum(c) AS b FROM (SELECT t.f, t.i, t.p, root, count(*) // 2 AS c FROM {n}t t JOIN {n}m m ON m.f = t.f AND m.i = t.i AND m.p = t.p AND m.node = t.q GROUP BY ALL) GROUP BY 1, 2, 3),
{n}n AS (SELECT f, i, p, count(*) AS a FROM {n}e GROUP BY ALL),
{n}s AS (SELECT x.f, x.i, x.j AS p, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM {near} x LEFT JOIN {n}n o ON o.f = x.f AND o.i = x.i AND o.p = x.j LEFT JOIN {n}l l ON l.f = x.f AND l.i = x.i AND l.p = x.j)"""


_COUNTS = "count(*) AS n, count(*) FILTER (a = 4 AND b = 2 AND c = 1) AS c421, count(*) FILTER (a = 4 AND b = 2 AND c = 2) AS c422, count(*) FILTER (a = 5 AND b = 5 AND c = 5) AS c555, count(*) FILTER (a = 4 AND b = 4 AND c = 4) AS c444, count(*) FILTER (a = 6 AND b = 6 AND c = 6) AS c666"
_PACKED = "WHEN n = 12 AND c421 = 12 THEN 1 WHEN n = 12 AND c421 = 6 AND c422 = 6 THEN 2 WHEN n = 12 AND c555 = 12 THEN 4"
_KINDS = f"CASE {_PACKED} WHEN n = 14 AND c444 = 6 AND c666 = 8 THEN 3 ELSE 0 END"
_ADAPTIVE = f"""WITH RECURSIVE {_NEAREST}, k12 AS (SELECT * FROM k WHERE rank <= 12), u12 AS (SELECT f, i, avg(sqrt(d2)) * (1 + sqrt(2.0)) / 2 AS rc FROM k12 GROUP BY 1, 2 HAVING count(*) = 12),
u14 AS (SELECT f, i, 1.207 * (sum(sqrt(d2)) FILTER (rank <= 8) / sqrt(0.75) + sum(sqrt(d2)) FILTER (rank > 8)) / 14 AS rc FROM k GROUP BY 1, 2 HAVING count(*) = 14),
{_signatures('q', 'k12', 'u12')}, {_signatures('b', 'k', 'u14')},
p12 AS (SELECT f, i, {_COUNTS} FROM qs GROUP BY 1, 2), p14 AS (SELECT f, i, {_COUNTS} FROM bs GROUP BY 1, 2)
SELECT c.id, CAST(CASE {_PACKED.replace('n = ', 'p12.n = ').replace('c4', 'p12.c4').replace('c5', 'p12.c5')} WHEN p14.n = 14 AND p14.c444 = 6 AND p14.c666 = 8 THEN 3 ELSE 0 END AS INT) AS kind
FROM c LEFT JOIN p12 ON p12.f = c.f AND p12.i = c.id LEFT JOIN p14 ON p14.f = c.f AND p14.i = c.id"""


def _kinds(ds: Dataset):
    return ds.particles.select(F.col("idx").alias("id"), col("Structure Type").alias("kind"))


@query(_ADAPTIVE)
def common_neighbor_analysis(spark, sf_dir):
    return _kinds(structure.common_neighbor_analysis(crystals(spark, sf_dir)))


#: Between the first and the second shell of the fcc and the hcp crystal.
_CUT = 0.854
_FIXED = f"WITH RECURSIVE {_SITES}, k AS (SELECT * FROM v2 WHERE d2 <= {_CUT} * {_CUT}), u AS (SELECT DISTINCT f, i, {_CUT} AS rc FROM k), {_signatures('b', 'k', 'u')}, p AS (SELECT f, i, {_COUNTS} FROM bs GROUP BY 1, 2)"


@query(f"{_FIXED} SELECT c.id, CAST({_KINDS} AS INT) AS kind FROM c LEFT JOIN p ON p.f = c.f AND p.i = c.id")
def common_neighbor_analysis_fixed(spark, sf_dir):
    return _kinds(structure.common_neighbor_analysis(crystals(spark, sf_dir), _CUT))


@query(f"{_FIXED} SELECT c.id, CAST({_KINDS} AS INT) AS kind FROM c LEFT JOIN p ON p.f = c.f AND p.i = c.id")
def common_neighbor_analysis_bonds(spark, sf_dir):
    return _kinds(structure.common_neighbor_analysis_by_bonds(analyze.create_bonds(crystals(spark, sf_dir), _CUT)))


@query(f"{_FIXED} SELECT f AS frame, a AS n_common, b AS n_bonds, c AS longest, count(*) AS half_bonds FROM bs GROUP BY ALL")
def bond_signature_counts(spark, sf_dir):
    d = structure.common_neighbor_analysis_by_bonds(analyze.create_bonds(crystals(spark, sf_dir), _CUT)).bonds
    names = ("n_common", "n_bonds", "longest")
    return d.groupBy("frame", *(col(f"CNA Indices.{k + 1}").cast("long").alias(n) for k, n in enumerate(names))).agg(F.count("*").alias("half_bonds"))


@query(f"""WITH {_NEAREST}, r AS (SELECT f, i, avg(d2) AS r0 FROM k WHERE rank <= 6 GROUP BY 1, 2), n1 AS (SELECT f, i, count(*) FILTER (d2 < 1.55 * r0) AS n1 FROM k JOIN r USING (f, i) GROUP BY 1, 2),
g AS (SELECT x.f, x.i, (x.dx * y.dx + x.dy * y.dy + x.dz * y.dz) / sqrt(x.d2 * y.d2) AS g FROM k x JOIN k y ON x.f = y.f AND x.i = y.i AND x.rank < y.rank JOIN r ON r.f = x.f AND r.i = x.i WHERE x.d2 <= 1.45 * r0 AND y.d2 <= 1.45 * r0),
h AS (SELECT f, i, count(*) FILTER (g < -0.945) AS c0, count(*) FILTER (g >= -0.945 AND g < -0.915) AS c1, count(*) FILTER (g >= -0.915 AND g < -0.755) AS c2, count(*) FILTER (g >= -0.755 AND g < -0.195) AS c3, count(*) FILTER (g >= -0.195 AND g < 0.195) AS c4, count(*) FILTER (g >= 0.195 AND g < 0.245) AS c5, count(*) FILTER (g >= 0.245 AND g < 0.795) AS c6, count(*) FILTER (g >= 0.795) AS c7 FROM g GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN c0 = 7 THEN 0 WHEN c5 + c6 = c4 THEN 1e30 ELSE 0.35 * c4 / (c5 + c6 - c4) END AS bcc, abs(1 - c6 / 24.0) AS cp, CASE WHEN c0 = 6 THEN 0 ELSE 0.61 * (abs(c0 + c1 - 6) + c2) / 6 END AS fcc, CASE WHEN c0 <= 3 THEN 0 ELSE (abs(c0 - 3) + abs(c0 + c1 + c2 + c3 - 9)) / 12.0 END AS hcp FROM h JOIN n1 USING (f, i))
SELECT c.id, CAST(CASE WHEN c7 IS NULL OR c7 > 0 THEN 0 WHEN c4 < 3 THEN CASE WHEN n1 BETWEEN 11 AND 13 THEN 4 ELSE 0 END WHEN bcc <= cp THEN CASE WHEN n1 >= 11 THEN 3 ELSE 0 END WHEN n1 NOT BETWEEN 11 AND 12 THEN 0 WHEN fcc < hcp THEN 1 ELSE 2 END AS INT) AS kind FROM c LEFT JOIN w ON w.f = c.f AND w.i = c.id""")
def bond_angle_analysis(spark, sf_dir):
    return _kinds(structure.bond_angle_analysis(crystals(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_NEAREST}, k4 AS (SELECT * FROM k WHERE rank <= 4), z0 AS (SELECT x.f, x.i, y.j, x.dx + y.dx AS dx, x.dy + y.dy AS dy, x.dz + y.dz AS dz FROM k4 x JOIN k4 y ON y.f = x.f AND y.i = x.j),
z1 AS (SELECT f, i, row_number() OVER (PARTITION BY f, i) AS j, dx, dy, dz FROM z0 WHERE abs(dx) > 0.01 OR abs(dy) > 0.01 OR abs(dz) > 0.01), u AS (SELECT f, i, avg(sqrt(dx * dx + dy * dy + dz * dz)) * 1.2071068 AS rc FROM z1 GROUP BY 1, 2 HAVING count(*) = 12), z AS (SELECT z1.* FROM z1 JOIN u USING (f, i)),
{_signatures('b', 'z', 'u')}, p AS (SELECT f, i, {_COUNTS} FROM bs GROUP BY 1, 2), d0 AS (SELECT c.f, c.id, CASE WHEN c421 = 12 THEN 1 WHEN c421 = 6 AND c422 = 6 THEN 4 ELSE 0 END AS kind FROM c LEFT JOIN p ON p.f = c.f AND p.i = c.id),
f1 AS (SELECT x.f, x.j AS id, arg_min(d.kind, x.i) AS k FROM k4 x JOIN d0 d ON d.f = x.f AND d.id = x.i AND d.kind IN (1, 4) GROUP BY 1, 2), d1 AS (SELECT d.f, d.id, CASE WHEN d.kind = 0 AND k IS NOT NULL THEN k + 1 ELSE d.kind END AS kind FROM d0 d LEFT JOIN f1 USING (f, id)),
f2 AS (SELECT x.f, x.j AS id, arg_min(d.kind, x.i) AS k FROM k4 x JOIN d1 d ON d.f = x.f AND d.id = x.i AND d.kind IN (2, 5) GROUP BY 1, 2)
SELECT d.id, CAST(CASE WHEN d.kind = 0 AND k IS NOT NULL THEN k + 1 ELSE d.kind END AS INT) AS kind FROM d1 d LEFT JOIN f2 USING (f, id)""")
def identify_diamond(spark, sf_dir):
    return _kinds(structure.identify_diamond(crystals(spark, sf_dir)))


@query(f"WITH {_NEAR}, s0 AS (SELECT id FROM c WHERE q > 0.25), s1 AS (SELECT id FROM s0 UNION SELECT j FROM k JOIN s0 ON k.i = s0.id WHERE rank <= 3) SELECT id FROM s1")
def expand_selection_nearest(spark, sf_dir):
    ds = select.select_expression(cloud(spark, sf_dir), "Charge > 0.25")
    return select.expand_selection(ds, "nearest", nearest=3).particles.where("Selection = 1").select(F.col("idx").alias("id"))


@query(f"WITH {_PAIRS}, s0 AS (SELECT id FROM c WHERE q > 0.25), s1 AS (SELECT id FROM s0 UNION SELECT j FROM p JOIN s0 ON p.i = s0.id) SELECT id FROM s1")
def expand_selection_bonded(spark, sf_dir):
    ds = select.select_expression(analyze.create_bonds(cloud(spark, sf_dir), RC, numbered=False), "Charge > 0.25")
    return select.expand_selection(ds, "bonded", mirrored=True).particles.where("Selection = 1").select(F.col("idx").alias("id"))


@query(f"WITH {_CLOUD} SELECT id, CAST(NULL AS INT) AS selection FROM c")
def clear_selection(spark, sf_dir):
    ds = select.clear_selection(select.select_type(cloud(spark, sf_dir), [1]))
    return ds.particles.select(F.col("idx").alias("id"), (col("Selection") if ds.has("Selection") else F.lit(None).cast("int")).alias("selection"))


def _clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@query(
    f"WITH {_CLOUD}, r AS (SELECT min(q) AS lo, max(q) AS hi FROM c), t AS (SELECT id, (q - lo) / (hi - lo) AS t, (1 - (q - lo) / (hi - lo)) * 0.7 * 6 AS h FROM c, r) "
    f"SELECT id, round({_clip('abs(h - 3) - 1')}, 6) AS rainbow_r, round({_clip('2 - abs(h - 2)')}, 6) AS rainbow_g, round({_clip('2 - abs(h - 4)')}, 6) AS rainbow_b, round({_clip('t / 0.375')}, 6) AS hot_r, round({_clip('(t - 0.375) / 0.375')}, 6) AS hot_g, round({_clip('(t - 0.75) / 0.25')}, 6) AS hot_b, "
    "round(CASE WHEN t <= 0.375 THEN 0 WHEN t <= 0.625 THEN (t - 0.375) / 0.25 WHEN t <= 0.875 THEN 1 ELSE 1 - (t - 0.875) / 0.125 * 0.5 END, 6) AS jet_r, round(t, 6) AS gray FROM t"
)
def color_gradients(spark, sf_dir):
    out = None
    for name in ("rainbow", "hot", "jet", "grayscale"):
        d = modify.color_coding(cloud(spark, sf_dir), "Charge", name).particles.select(F.col("idx").alias("id"), *(_r(f"Color.{c}", f"{name}_{c.lower()}") for c in "RGB"))
        out = d if out is None else out.join(d, "id")
    return out.drop("jet_g", "jet_b", "grayscale_g", "grayscale_b").withColumnRenamed("grayscale_r", "gray")


@query(f"WITH {_CLOUD}, n AS (SELECT a.id, count(*) AS n, sum(pow(b.x - a.x, 2)) AS xx, sum(pow(b.y - a.y, 2)) AS yy, sum((b.x - a.x) * (b.y - a.y)) AS xy FROM c a JOIN c b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.1 * 0.1 GROUP BY 1), d AS (SELECT id, n, xx * yy - xy * xy AS det FROM n) SELECT id, round(CASE WHEN n >= 2 AND det > 1e-4 AND det * 1.05 >= 1e-4 THEN 0.1025 / 2 / 3 ELSE 0 END, 5) AS volumetric, CAST(CASE WHEN n >= 2 AND det > 1e-4 AND det * 1.05 >= 1e-4 THEN 0 ELSE 1 END AS INT) AS invalid FROM c LEFT JOIN d USING (id)")
def atomic_strain_2d(spark, sf_dir):
    """In the plane, under a stretch along y."""
    ds = cloud(spark, sf_dir, pbc=False)
    flat = ds.particles.withColumn("Position.Z", F.lit(0.0))
    both = flat.unionByName(flat.withColumn("frame", F.lit(1)).withColumn("Position.Y", col("Position.Y") * 1.05))
    both = Dataset(both, cells_of(spark, [box(k, (1, 1, 1), (-0.5, -0.5, -0.5), (False,) * 3, is2d=True) for k in (0, 1)]))
    d = analyze.atomic_strain(both, 0.1, 0, frames=[1]).particles.where("frame = 1")
    return d.select(F.col("idx").alias("id"), _r("Volumetric Strain", "volumetric", 5), col("Selection").alias("invalid"))


@query(f"WITH {_SITES} SELECT f AS frame, count(*) AS n, round(min(lx * ly * lz), 6) AS volume FROM c GROUP BY 1")
def voronoi_volumes(spark, sf_dir):
    """The cells of a crystal fill its box."""
    return voronoi(crystals(spark, sf_dir), 1.6).particles.groupBy("frame").agg(F.count("*").alias("n"), _r(F.sum(col("Atomic Volume")), "volume"))


def triangles(spark: SparkSession, sf_dir: str):
    """A triangle for each part, all of them in one frame: vertices and faces."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("f"))
    v = t.select("f", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).withColumn("v", F.col("f") * 3 + F.col("k"))
    xyz = (((F.col("v") * F.lit(p)) % 101 / 101.0).alias(c) for c, p in zip("xyz", (37, 53, 71)))
    return v.select(F.lit(0).alias("frame"), "v", *xyz), t.select(F.lit(0).alias("frame"), "f", *((F.col("f") * 3 + k).alias(f"v{k + 1}") for k in range(3)))


_POINT = ", ".join(f"((p_partkey * 3 + {k}) * {p}) % 101 / 101.0 AS {c}{k}" for k in range(3) for c, p in zip("xyz", (37, 53, 71)))
_OVER = ", ".join(f"(x{k} + y{k} + z{k}) / sqrt(3.0) - 0.9 AS s{k}" for k in range(3))


@query(f"""WITH t AS (SELECT p_partkey AS f, {_POINT} FROM part), u AS (SELECT *, {_OVER}, sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2 AS a FROM t),
w AS (SELECT f, a, list_sort([s0, s1, s2]) AS s FROM u)
SELECT round(sum(CASE WHEN s[3] <= 0 THEN a WHEN s[2] <= 0 THEN a * (1 - s[3] * s[3] / ((s[3] - s[1]) * (s[3] - s[2]))) ELSE a * s[1] * s[1] / ((s[1] - s[2]) * (s[1] - s[3])) END), 6) AS area, count(*) + count(*) FILTER (s[2] <= 0 AND s[3] > 0) AS faces FROM w WHERE s[1] <= 0""")
def cut_mesh(spark, sf_dir):
    vertices, faces = mesh.cut_mesh(*triangles(spark, sf_dir), (1.0, 1.0, 1.0), 0.9)
    return mesh.area_and_volume(vertices, faces).select(_r("area")).crossJoin(faces.agg(F.count("*").alias("faces")))


def _fitted_sql(cutoff: float) -> str:
    """The deviation of each particle of the first three frames from its own crystal's shell, which lies along the axes (in every other layer of the hcp crystal half a turn about z): each neighbour goes to the point next to it.

    The sum of the singular values of the mixed moments, the least with the determinant's sign, is the largest root of a quartic (Newton's steps from above).
    """
    points = ", ".join(f"({f}, {turned}, {k}, {', '.join(f'CAST({x!r} AS DOUBLE)' for x in (turned * float(p[0]), turned * float(p[1]), float(p[2])))})" for f, kind in enumerate(("FCC", "HCP", "BCC")) for turned in ((1, -1) if kind == "HCP" else (1,)) for k, p in enumerate(templates.shell(kind)))
    moments = ", ".join(f"sum(w{a} * d{b}) AS m{a}{b}" for a in "xyz" for b in "xyz")
    minor = lambda r, c: "m{0}{2} * m{1}{3} - m{0}{3} * m{1}{2}".format(*r, *c)
    two = ["xy", "yz", "xz"]
    minors = " + ".join(f"pow({minor(r, c)}, 2)" for r in two for c in two)
    det = f"mxx * ({minor('yz', 'yz')}) - mxy * ({minor('yz', 'xz')}) + mxz * ({minor('yz', 'xy')})"
    return f"""WITH {_NEAREST}, w0(f, turned, p, wx, wy, wz) AS (VALUES {points}), e AS (SELECT f, count(DISTINCT p) AS n, sum(wx * wx + wy * wy + wz * wz) FILTER (turned = 1) AS ww, min(sqrt(wx * wx + wy * wy + wz * wz)) AS first FROM w0 GROUP BY 1),
k0 AS (SELECT k.f, k.i, k.dx, k.dy, k.dz, k.d2, e.n FROM k JOIN e ON e.f = k.f WHERE rank <= e.n), z AS (SELECT f, i, avg(sqrt(d2)) AS size, count(*) AS have FROM k0 GROUP BY 1, 2),
a0 AS (SELECT k0.f, k0.i, k0.dx, k0.dy, k0.dz, k0.n, w0.turned, w0.p, wx, wy, wz, row_number() OVER (PARTITION BY k0.f, k0.i, w0.turned, k0.dx, k0.dy, k0.dz ORDER BY (wx * k0.dx + wy * k0.dy + wz * k0.dz) / size - (wx * wx + wy * wy + wz * wz) / 2 DESC) AS choice FROM k0 JOIN w0 ON w0.f = k0.f JOIN z ON z.f = k0.f AND z.i = k0.i),
g AS (SELECT f, i, turned, n, {moments}, sum(dx * dx + dy * dy + dz * dz) - (pow(sum(dx), 2) + pow(sum(dy), 2) + pow(sum(dz), 2)) / (n + 1) AS own FROM a0 WHERE choice = 1 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT p) = n AND count(*) = n),
h AS (SELECT *, {' + '.join(f'm{a}{b} * m{a}{b}' for a in 'xyz' for b in 'xyz')} AS t, {det} AS d, {minors} AS c FROM g),
s AS (SELECT f, i, n, own, list_reduce(list_prepend(sqrt(3 * t), list_transform(range(60), lambda x: 0.0::DOUBLE)), lambda l, x: l - (pow(l, 4) - 2 * t * l * l - 8 * d * l + t * t - 4 * c) / (4 * pow(l, 3) - 4 * t * l - 8 * d)) AS l FROM h),
o AS (SELECT s.f, s.i, sqrt(greatest(0, ww - l * l / own) / (s.n + 1)) AS rmsd, first * own / l AS distance FROM s JOIN e ON e.f = s.f QUALIFY row_number() OVER (PARTITION BY s.f, s.i ORDER BY rmsd) = 1),
r AS (SELECT c.f AS frame, c.id, CASE WHEN rmsd <= {cutoff} THEN c.f + 1 ELSE 0 END AS kind, CASE WHEN rmsd <= {cutoff} THEN round(rmsd, 6) ELSE 0 END AS rmsd, CASE WHEN rmsd <= {cutoff} THEN round(distance, 6) ELSE 0 END AS distance FROM c LEFT JOIN o ON o.f = c.f AND o.i = c.id)"""


#: Under this deviation a shell of these crystals is none but its own.
_FITS = 0.08


@query(f"{_fitted_sql(_FITS)} SELECT id, CAST(kind AS INT) AS kind, rmsd, distance FROM r")
def template_matching(spark, sf_dir):
    """The crystals along the axes; the diamond's shells are none of these."""
    p = templates.template_matching(crystals(spark, sf_dir), rmsd_cutoff=_FITS).particles
    fits = lambda name: F.when(col("Structure Type") > 0, F.round(col(name), 6)).otherwise(0.0)
    return p.select(F.col("idx").alias("id"), col("Structure Type").alias("kind"), fits("RMSD").alias("rmsd"), fits("Interatomic Distance").alias("distance"))


@query()
def template_rmsd_histogram(spark, sf_dir):
    """Over all crystals and kinds, without a cutoff."""
    return templates.rmsd_histogram(templates.matched(crystals(spark, sf_dir), tuple(templates.KINDS[1:])))


def twin_sites(t) -> Dataset:
    """Parts as an fcc crystal of two twins in frame 0: close-packed layers of triangles, stacked one way up to the middle and the other way back, so
    that the box closes.  Layers beyond an even number of full ones are far apart from each other in frame 1.
    """
    n = t.count()
    p = max(3, math.floor(round((n / 40) ** 0.5, 9)))
    q = max(2, math.floor(round(p / math.sqrt(3), 9)))
    each = 2 * p * q
    layers = n // each // 2 * 2
    m = F.col("p_partkey")
    layer, site = F.floor(m / each), m % each
    # Steps from A to B to C up to the middle, and back.
    step = F.when(layer <= layers // 2, layer).otherwise(layers - layer)
    row = F.floor(site / p)
    x = site % p + (row % 2) * 0.5 + step * 0.5
    y = row * math.sqrt(0.75) + step * math.sqrt(0.75) / 3
    z = layer * math.sqrt(2 / 3)
    solid = m < each * layers
    place = (F.when(solid, v).otherwise(F.lit(10.0) * w + 5) for v, w in ((x, m - each * layers), (y, F.lit(0)), (z, F.lit(0))))
    d = t.select((~solid).cast("int").alias("frame"), F.col("p_partkey").cast("long").alias("idx"), *(v.cast("double").alias(c) for c, v in zip(POSITION, place)))
    rest = max(1, n - each * layers)
    return Dataset(d, cells_of(t.sparkSession, [box(0, (p, 2 * q * math.sqrt(0.75), max(2, layers) * math.sqrt(2 / 3))), box(1, (10.0 * rest, 10.0, 10.0))]))


def _twins(spark, sf_dir):
    ds = templates.template_matching(twin_sites(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")), ("FCC", "HCP"))
    found = grains.links(ds)
    return ds, found, *grains.lattice_clusters(ds, found=found)


#: Particles of a layer, and full layers, of which there is an even number.
_TWINS = "n0 AS (SELECT count(*) AS n FROM part), p0 AS (SELECT n, greatest(3, CAST(floor(round(sqrt(n / 40.0), 9)) AS BIGINT)) AS p FROM n0), e0 AS (SELECT n, 2 * p * greatest(2, CAST(floor(round(p / sqrt(3.0), 9)) AS BIGINT)) AS each FROM p0), t AS (SELECT n, each, n // each // 2 * 2 AS layers FROM e0)"


@query(f"WITH {_TWINS} SELECT cluster, CAST(CASE WHEN cluster <= 2 THEN 1 ELSE 2 END AS INT) AS kind, CAST(each * CASE WHEN cluster <= 2 THEN layers // 2 - 1 ELSE 1 END AS BIGINT) AS size, 0 AS n_disagree FROM t, (SELECT CAST(unnest(range(1, 5)) AS INT) AS cluster)")
def lattice_clusters(spark, sf_dir):
    """Two twins and the two layers between them."""
    return _twins(spark, sf_dir)[3].select("cluster", "kind", "size", "n_disagree")


@query(f"WITH {_TWINS} SELECT a, b, a = 1 AND b = 2 OR a = 3 AND b = 4 AS via, CASE WHEN b = 2 THEN 60.0::DOUBLE END AS angle FROM t, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) AS v(a, b)")
def cluster_transitions(spark, sf_dir):
    """The twins are turned by 60 degrees, which the layers between them, that touch both, tell."""
    _, found, out, table = _twins(spark, sf_dir)
    return grains.transitions(out, table, found).select("a", "b", "via", F.when(F.col("b") == 2, F.round("angle", 4)).alias("angle"))


@query(f"WITH {_TWINS} SELECT p_partkey AS id, CAST(CASE WHEN p_partkey >= each * layers THEN 0 WHEN p_partkey // each = 0 OR p_partkey // each = layers // 2 THEN 0 WHEN p_partkey // each < layers // 2 THEN 1 ELSE 2 END AS INT) AS grain FROM part, t")
def grain_segmentation(spark, sf_dir):
    """Twins are grains.  Layers between them join nothing here, as adoption is off and they are under the least size."""
    ds = templates.template_matching(twin_sites(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")), ("FCC",), rmsd_cutoff=0.05)
    return grains.grains(ds, adopt=False).particles.select(F.col("idx").alias("id"), F.col("Grain").alias("grain"))


@query(f"WITH {_TWINS} SELECT p_partkey AS id, CAST(round(CASE WHEN solid THEN {{0}} ELSE 0 END, 8) AS DOUBLE) AS xx, CAST(round(CASE WHEN solid THEN {{1}} ELSE 0 END, 8) AS DOUBLE) AS xy, CAST(round(CASE WHEN solid THEN {{2}} ELSE 0 END, 8) AS DOUBLE) AS volumetric, CAST(CASE WHEN solid THEN 0 ELSE 1 END AS INT) AS invalid FROM (SELECT p_partkey, p_partkey < each * layers AND p_partkey // each NOT IN (0, layers // 2) AS solid FROM part, t)".format(*(repr(x) for x in ((1 - 1 / 1.02**2 - (0.01 / 1.02) ** 2) / 2, 0.01 / 1.02 / 2, (1 - 1 / 1.02**2 - (0.01 / 1.02) ** 2) / 6))))
def elastic_strain(spark, sf_dir):
    """Both twins under a stretch and a shear that are one in space."""
    ds = twin_sites(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    # y' = y + 0.01 x, x' = 1.02 x: the inverse is x = x' / 1.02, y = y' - 0.01 / 1.02 x'.
    ds = modify.affine_transform(ds, ((1.02, 0.0, 0.0, 0.0), (0.01, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)), cell=True)
    ds = templates.template_matching(ds, ("FCC", "HCP"))
    out = grains.elastic_strain(grains.lattice_clusters(ds)[0], "FCC", math.sqrt(2)).particles
    return out.select(F.col("idx").alias("id"), _r("Elastic Strain.XX", "xx", 8), _r("Elastic Strain.XY", "xy", 8), _r("Volumetric Elastic Strain", "volumetric", 8), F.col("Selection").alias("invalid"))


def terraces(spark: SparkSession, sf_dir: str) -> tuple[Dataset, int]:
    """Parts as a simple cubic crystal that fills its box row by row and leaves the top empty: periodic, so with a surface below and a step above."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("idx"))
    a = max(2, math.ceil(round(t.count() ** (1 / 3), 9)))
    at = (F.col("idx") % a, F.expr(f"idx DIV {a} % {a}"), F.expr(f"idx DIV {a * a}"))
    return Dataset(t.select(F.lit(0).alias("frame"), "idx", *(x.cast("double").alias(c) for c, x in zip(POSITION, at))), cells_of(spark, [box(0, (a, a, a + 10))])), a


@query("""WITH n AS (SELECT count(*) AS n, greatest(2, CAST(ceil(round(pow(count(*), 1.0 / 3), 9)) AS BIGINT)) AS a FROM part), l AS (SELECT a, n // (a * a) AS layers, n % (a * a) AS rest FROM n),
s AS (SELECT a, layers, unnest(range(a * a)) AS m, rest FROM l), k AS (SELECT a, layers, (m < rest)::INT + (m // a * a + (m + 1) % a < rest)::INT + ((m + a) % (a * a) < rest)::INT + ((m // a + 1) % a * a + (m + 1) % a < rest)::INT AS k FROM s)
SELECT round(sum(layers - 1 + [0, 1 / 3.0, 1 / 2.0, 5 / 6.0, 1][k + 1]::DOUBLE), 4) AS volume, round(sum(1 + [1, sqrt(2.0), sqrt(2.0), (1 + sqrt(3.0)) / 2, 1][k + 1]), 4) AS area, 0 AS odd_edges FROM k""")
def surface_mesh(spark, sf_dir):
    """The solid is cubes, and on the step what is left of them: pyramids, wedges and cubes without a corner.  No edge of the surface has an odd number of faces."""
    ds, _ = terraces(spark, sf_dir)
    _, faces, out = surface.surface_mesh(ds, 0.9, smoothing=0)
    ends = faces.select(F.explode(F.array(*(F.struct(F.least(f"v{a}", f"v{b}").alias("v"), F.greatest(f"v{a}", f"v{b}").alias("w")) for a, b in ((1, 2), (2, 3), (3, 1))))).alias("e"))
    odd = ends.groupBy("e").count().agg(F.count_if(F.col("count") % 2 == 1).alias("odd_edges"))
    facts = out.attributes.groupBy().pivot("key", ["ConstructSurfaceMesh.solid_volume", "ConstructSurfaceMesh.surface_area"]).agg(F.first("num")).toDF("volume", "area")
    return facts.select(_r("volume", digits=4), _r("area", digits=4)).crossJoin(odd)


def _uneven(i, p: int):
    return i + F.lit(0.3) * ((i * p) % 11) / 11


def uneven_grid(spark: SparkSession, sf_dir: str) -> Dataset:
    """Parts on a grid of uneven spacings: whole layers in frame 0, and what is left as a single row in frame 1."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("idx"))
    n = t.count()
    a = max(1, math.floor(round(n ** (1 / 3), 9)))
    layers = n // (a * a)
    rest = F.col("idx") - a * a * layers
    grid = (_uneven(F.col("idx") % a, 37), _uneven(F.expr(f"idx DIV {a} % {a}"), 53), _uneven(F.expr(f"idx DIV {a * a}"), 71))
    at = (F.when(rest < 0, x).otherwise(y) for x, y in zip(grid, (_uneven(rest, 37), F.lit(0.5), F.lit(0.5))))
    return Dataset(t.select((rest >= 0).cast("int").alias("frame"), "idx", *(x.cast("double").alias(c) for c, x in zip(POSITION, at))), cells_of(spark, [box(0, (a, a, layers)), box(1, (max(1, n - a * a * layers), 1, 1))]))


def _width(i: str, n: str, p: int) -> str:
    at = lambda x: f"(({x}) + 0.3::DOUBLE * ((({x}) * {p}) % 11) / 11)"
    return f"((CASE WHEN {i} + 1 < {n} THEN {at(f'{i} + 1')} ELSE {n} END) - (CASE WHEN {i} > 0 THEN {at(f'{i} - 1')} ELSE {at(f'{n} - 1')} - {n} END)) / 2"


@query(f"""WITH n AS (SELECT count(*) AS n, greatest(1, CAST(floor(round(pow(count(*), 1.0 / 3), 9)) AS BIGINT)) AS a FROM part), l AS (SELECT n, a, n // (a * a) AS layers FROM n), p AS (SELECT p_partkey AS id, n, a, layers, p_partkey - a * a * layers AS rest FROM part, l)
SELECT id, round(CASE WHEN rest < 0 THEN {_width('(id % a)', 'a', 37)} * {_width('(id // a % a)', 'a', 53)} * {_width('(id // (a * a))', 'layers', 71)} ELSE {_width('rest', '(n - a * a * layers)', 37)} END, 5) AS volume, CAST(6 AS INT) AS coordination, CAST(6 AS INT) AS of_four FROM p""")
def voronoi_cells(spark, sf_dir):
    """Cells of a grid are boxes, half-way to the neighbours on all six sides."""
    d = voronoi(uneven_grid(spark, sf_dir), 1.8).particles
    return d.select(F.col("idx").alias("id"), _r("Atomic Volume", "volume", 5), F.col("Coordination").alias("coordination"), col("Voronoi Index.4").alias("of_four"))
