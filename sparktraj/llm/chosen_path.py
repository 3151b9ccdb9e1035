"""N-gram Jaccard join by chosen paths.

1. Each text becomes its set of word 5-grams; equal sets are one *text class*.  A class is embedded as ``COORDS`` minimum hashes,
   its tokens (place, value); the share of equal tokens of two classes estimates their Jaccard similarity.
2. A run samples tokens, each with probability 1 / (similarity * COORDS), and classes that share a sampled token meet in a
   bucket.  Buckets over ``LEAF`` are split again on newly sampled tokens, ``DEPTH`` times at most.  Runs are repeated until
   a pair at the threshold is found with the target recall.
3. Small buckets are brute-forced on the embedding.  In a large one all classes are compared with a pivot: those near it are its
   candidates, and only classes very close to it leave the splitting.  Shares of unequal tokens obey the triangle inequality, so
   what the brute force would pair with a class very close to the pivot is near the pivot itself, and nothing is lost by that.
   What is large at the last level shares so many sampled tokens that all of it is taken as candidates.  Connected candidates
   form a *candidate cluster*.
4. Within each candidate cluster all pairs are compared by their exact sets, in blocks of about ``BLOCK`` classes and ``BLOCK_BYTES`` of
   n-grams; links are counted and never listed.  Each block returns, for a class, its number of links and the least class that it is connected to.

Result: one row per document: doc_id, class_id (the least doc_id among all documents connected by links), n_links (other documents at
the threshold or above, copies included), text_class (equal for equal sets), n_copies (documents of the text class).

Defined results: a text of one to four words is one n-gram; a text without words, null too, links to nothing and is a class of its own,
with its doc_id as class_id and a null text_class; rows of one id are documents of their own; a null id counts as a document and is never a
class_id unless all ids of the class are null; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, docs_of, id_type, read, slices, stage

COORDS = 64
LEAF = 1000
DEPTH = 4
BLOCK, BLOCK_BYTES = 3000, 48_000_000
#: Chance that one run brings a pair at the threshold together, for buckets split to the last level (a critical branching process).
RUN_FINDS = 0.35
#: On the embedding, candidates are this much below the threshold; classes this close to a pivot leave the splitting of its bucket, and the
#: pivot's own candidates are further below the threshold by as much as those may differ from it.
SLACK, CLOSE = 0.2, 0.88
#: Bits of the filter of clustered classes, each of which sets one; a fixed size, 4 MB.
FILTER_BITS = 1 << 25
#: Rows up to which the table of clustered classes (a digest and four numbers) or of pivots (an embedding) is broadcast.
BROADCAST_ROWS = 100_000

_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, COORDS), dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each trimmed text's word n-grams; of all its words if they are fewer; none without words."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))[words.indices.to_numpy()]
    blank = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
    cut = np.diff(lists.offsets.to_numpy(), prepend=lists.offsets[0].as_py()).cumsum().tolist()
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams = _mixed(grams)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a == 1 and blank[a]:  # a trimmed text without words is split into one empty word
            out.append(np.empty(0, np.uint64))
        elif b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(_mixed(np.array([int.from_bytes(xxhash.xxh64_digest(hashes[a:b].tobytes()), "big")], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _texts(b: pa.RecordBatch) -> pa.Array:
    return pc.ascii_trim_whitespace(b.column("text"))


def _digest(grams: np.ndarray) -> str | None:
    import xxhash

    return xxhash.xxh128_hexdigest(grams.tobytes()) if len(grams) else None


def _embedded(grams: np.ndarray) -> np.ndarray:
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        np.minimum(least, (part[None, :] * _MIX[0][:, None] + _MIX[1][:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(32)).astype("<u4")


def embedded(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, key (of the set of n-grams, null for none), the set's size and the embedding, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = gram_sets(_texts(b), n)
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array([_digest(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_embedded(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "text_hash", "key", "size", "sig"])

    return stage(arrow_map(docs, run, f"doc_id {id_type(docs)}, text_hash long, key string, size long, sig binary"), "embedded")


def runs_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - RUN_FINDS))


def _paths(similarity: float, level: int, roots: tuple[tuple[int, int], ...] = ()):
    """Rows (cls, sig[, node]) -> (cls, node): the buckets of the next level that a class falls in."""
    most = int(2**32 / (similarity * COORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, COORDS).astype(np.uint64)
            if roots:
                r = np.repeat(np.arange(len(sig)), len(roots))
                seed, c = (np.tile(np.array(x), len(sig)) for x in zip(*roots))
                seed = seed.astype(np.uint64)
            else:
                node = b.column("node").to_numpy().view(np.uint64)
                draw = _mixed(node[:, None] + np.arange(1, COORDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
                r, c = np.nonzero(draw < most)
                seed = node[r]
            node = _mixed(_mixed(seed * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(level << 20)) + sig[r, c]).view(np.int64)
            cls = b.column("cls").to_numpy()[r]
            for at in range(0, len(r), 50_000):
                yield pa.record_batch([pa.array(cls[at : at + 50_000]), pa.array(node[at : at + 50_000])], names=["cls", "node"])

    return run


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the share of equal tokens with the bucket's pivot."""
    for b in batches:
        own, other = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u4").reshape(-1, COORDS) for x in ("sig", "pivot_sig"))
        yield pa.record_batch([*(b.column(x) for x in ("cls", "sig", "node", "pivot")), pa.array((own == other).mean(axis=1))], names=["cls", "sig", "node", "pivot", "share"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``by``, in tables of whole groups, with the places where groups begin and the end."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        x = b.column(by).to_numpy()
        last = int(np.searchsorted(x, x[-1]))  # where the last group begins, which may go on
        if last or (kept and kept[-1].column(by)[-1].as_py() != x[0]):
            last_of_kept = last if last else 0
            t = pa.Table.from_batches([*kept, b.slice(0, last_of_kept)])
            kept = [b.slice(last_of_kept)]
            y = t[by].to_numpy()
            if len(y):
                yield t, np.concatenate([[0], np.flatnonzero(y[1:] != y[:-1]) + 1, [len(y)]])
        else:
            kept.append(b)
    if kept:
        t = pa.Table.from_batches(kept)
        y = t[by].to_numpy()
        yield t, np.concatenate([[0], np.flatnonzero(y[1:] != y[:-1]) + 1, [len(y)]])


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels along links a-b."""
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _leaf_edges(least: float):
    """Brute force on the embedding in buckets of ``LEAF`` at most: each class with the least class that it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _sorted_groups(batches, "node"):
            cls = t["cls"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(-1, COORDS)
            size = np.diff(cut)
            row = np.arange(len(sig))
            later = np.repeat(cut[1:], size) - row - 1  # rows of the bucket after this one
            label, ends = np.arange(len(sig)), np.cumsum(later)
            links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            at = 0
            while at < len(row):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000, "right")))
                n = later[at:to]
                a = np.repeat(row[at:to], n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                near = (sig[a] == sig[b]).mean(axis=1) >= least
                links_a.append(a[near])
                links_b.append(b[near])
                at = to
            label = _spread(label, np.concatenate(links_a), np.concatenate(links_b))
            k = np.flatnonzero(label != row)
            if len(k):
                yield pa.record_batch([pa.array(cls[k]), pa.array(cls[label[k]])], names=["a", "b"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most ``BROADCAST_ROWS`` rows, else joined as the engine likes.  ``df`` is staged."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidate_edges(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) between text classes; connected ones are candidates.  ``classes``: cls, sig."""
    chance, rng, roots = 1 / (similarity * COORDS), np.random.default_rng(11), []
    for k in range(runs_for(recall)):
        chosen = np.flatnonzero(rng.random(COORDS) < chance).tolist() or [int(rng.integers(COORDS))]
        roots += [(k, c) for c in chosen]
    at, found = classes, []
    for level in range(DEPTH):
        rows = stage(arrow_map(at, _paths(similarity, level, tuple(roots) if level == 0 else ()), "cls long, node long"), f"paths{level}")
        # Counted and written first: a bucket with very many rows is then split by the engine where it is joined.
        sizes = stage(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        sized = stage(rows.join(_small(sizes), "node").join(classes, "cls"), f"buckets{level}")
        small = sized.where(F.col("n") <= LEAF).select("cls", "sig", "node")
        found.append(arrow_map(small.repartition("node").sortWithinPartitions("node", "cls"), _leaf_edges(similarity - SLACK), "a long, b long"))
        large = sized.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        if level == DEPTH - 1:
            pivots = stage(large.groupBy("node").agg(F.min("cls").alias("b")), "pivots")
            found.append(large.join(_small(pivots), "node").where("cls <> b").select(F.col("cls").alias("a"), "b"))
            break
        pivots = stage(large.groupBy("node").agg(F.min(F.struct("cls", "sig")).alias("p")).selectExpr("node", "p.cls AS pivot", "p.sig AS pivot_sig"), "pivots")
        shared = stage(arrow_map(large.join(_small(pivots), "node").select("cls", "sig", "node", "pivot", "pivot_sig"), _to_pivot, "cls long, sig binary, node long, pivot long, share double"), "shared")
        found.append(shared.where((F.col("share") >= similarity - SLACK - (1 - CLOSE)) & (F.col("cls") != F.col("pivot"))).select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
        at = shared.where(F.col("share") < CLOSE).select("cls", "sig", "node")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return stage(out.distinct(), "candidates")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars: node, label (the least node), for all nodes of edges.

    No node's neighbours are gathered: each step is a minimum per node and a join back, and nodes with very many neighbours are
    split by the engine as skewed.  What comes out of a step is keyed by nodes that have few rows, so it's dealt out once by them and
    made distinct, reduced and joined there.
    """
    e = edges.selectExpr(f"{a} AS u", f"{b} AS v").where("u <> v")
    before = None
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        # Written first: a node with very many neighbours is then split by the engine where it is joined.
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), "least")
        large = both.join(_small(least), "u").where("v > u AND v <> m").selectExpr("v AS u", "m AS v")
        down = large.repartition("u").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e = stage(down.join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(least.selectExpr("u", "m AS v")).repartition("u").distinct(), "stars")
        now = e.selectExpr("count(*)", "bit_xor(xxhash64(u, v))", "sum(CAST(xxhash64(v, u) AS decimal(38, 0)))").first()
        if now == before:
            break
        before = now
    return e.selectExpr("u AS node", "v AS label").unionByName(e.selectExpr("v AS node", "v AS label").distinct())


def _exact(similarity: float):
    """Blocks (or pairs of blocks) of a cluster -> cls, links (weighted by copies), label (the least cls connected here)."""

    def shared(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of some sets with others."""
        token, size = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
        doc = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        begin = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
        df = np.diff(np.append(begin, len(token)))
        out = np.zeros((len(rows), len(cols)), np.float32)
        at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
        at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
        dense = np.flatnonzero(df > max(16, 0.06 * len(sets)))
        for k in range(0, len(dense), 512):
            part = dense[k : k + 512]
            m = np.zeros((len(sets), len(part)), np.float32)
            n = df[part]
            m[doc[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(part)), n)] = 1
            out += m[rows] @ m[cols].T
        rare = np.flatnonzero((df > 1) & (df <= max(16, 0.06 * len(sets))))
        for n in np.unique(df[rare]):
            tokens = rare[df[rare] == n]
            step = max(1, 500_000 // int(n * n))
            for k in range(0, len(tokens), step):
                d = doc[begin[tokens[k : k + step]][:, None] + np.arange(n)[None, :]]
                x, y = at_row[np.repeat(d, n, axis=1).ravel()], at_col[np.tile(d, (1, n)).ravel()]
                ok = (x >= 0) & (y >= 0)
                np.add.at(out, (x[ok], y[ok]), 1)
        return out

    def linked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t["grams"].combine_chunks()]
        side, weight = t["side"].to_numpy(), t["n_docs"].to_numpy()
        own = t["lo"][0].as_py() == t["hi"][0].as_py()
        rows = np.arange(len(sets)) if own else np.flatnonzero(side == t["lo"][0].as_py())
        cols = rows if own else np.flatnonzero(side == t["hi"][0].as_py())
        links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        if not len(rows) or not len(cols):
            return links, label
        size = np.fromiter(map(len, sets), np.float64, len(sets))
        common, near = shared(sets, rows, cols), np.zeros((len(rows), len(cols)), bool)
        for at in range(0, len(rows), 500):
            # Whole numbers, so that pairs at just the threshold don't hang on rounding.
            least = np.ceil(similarity * (size[rows[at : at + 500]][:, None] + size[cols][None, :]) / (1 + similarity) - 1e-9)
            near[at : at + 500] = common[at : at + 500] >= least
        del common
        if own:
            np.fill_diagonal(near, False)
        links[rows] += near @ weight[cols]
        if not own:
            links[cols] += near.T @ weight[rows]
        while True:
            new = label.copy()
            big = len(sets)
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                new[part] = np.minimum(new[part], np.where(near[at : at + 500], label[cols][None, :], big).min(axis=1))
            for at in range(0, len(cols), 500):
                part = cols[at : at + 500]
                new[part] = np.minimum(new[part], np.where(near[:, at : at + 500], label[rows][:, None], big).min(axis=0))
            if (new == label).all():
                return links, label
            label = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _sorted_groups(batches, "g"):
            for a, b in zip(cut[:-1], cut[1:]):
                part = t.slice(a, b - a)
                # Copies of a set from several partitions: one is enough.
                cls, first = np.unique(part["cls"].to_numpy(), return_index=True)
                links, label = linked(part.take(pa.array(first)))
                yield pa.record_batch([pa.array(cls), pa.array(links), pa.array(cls[label])], names=["cls", "links", "label"])

    return run


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap in which each text hash sets a bit.  Its words come to the driver, ``FILTER_BITS`` at most."""
    bit = F.pmod("text_hash", F.lit(FILTER_BITS))
    words = hashes.select(bit.alias("bit")).groupBy(F.expr("bit DIV 32 AS word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _grams_of(n: int, bitmap: np.ndarray, seen_most: int = 50_000):
    """key and grams of the texts whose hash sets a bit that ``bitmap`` has, of copies in a partition only one as long as its key is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches):
            bit = b.column("text_hash").to_numpy() % FILTER_BITS
            b = b.filter(pa.array((bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
            rows = []
            for s in gram_sets(_texts(b), n) if len(b) else []:
                k = _digest(s)
                if k is not None and k not in seen:
                    seen.add(k)
                    rows.append((k, s.astype("<u8").tobytes()))
            if len(seen) > seen_most:
                seen.clear()
            if rows:
                key, grams = zip(*rows)
                yield pa.record_batch([pa.array(key, pa.string()), pa.array(grams, pa.binary())], names=["key", "grams"])

    return run


def jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See the module's docstring."""
    d = docs_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = embedded(d, n)
    classes = stage(told.where("key IS NOT NULL").groupBy("key").agg(F.min("sig").alias("sig"), F.min("size").alias("size"), F.min("text_hash").alias("text_hash"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least_id")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    clusters = components(candidate_edges(classes.select("cls", "sig"), similarity, recall))
    of = stage(clusters.withColumnRenamed("node", "cls").join(classes.select("cls", "key", "n_docs", "size", "text_hash"), "cls"), "clusters")
    sizes = stage(of.groupBy("label").agg(F.expr(f"CAST(ceil(greatest(count(*) / {BLOCK}, sum(size) * 8 / {BLOCK_BYTES})) AS int)").alias("blocks")), "cluster-sizes")
    clustered = stage(of.join(_small(sizes), "label").selectExpr("key", "cls", "label AS cluster", "n_docs", "blocks", "text_hash"), "clustered")
    # The n-grams of one text of each class are enough.
    held = arrow_map(d.select("text", "text_hash"), _grams_of(n, _bits(clustered)), "key string, grams binary").join(_small(clustered.drop("text_hash")), "key")
    blocks = held.withColumn("side", F.expr("CAST(pmod(xxhash64(cls), blocks) AS int)")).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    blocks = blocks.selectExpr("cls", "grams", "n_docs", "side", "least(side, other) AS lo", "greatest(side, other) AS hi", "xxhash64(cluster, least(side, other), greatest(side, other)) AS g")
    exact = stage(arrow_map(blocks.repartition("g").sortWithinPartitions("g"), _exact(similarity), "cls long, links long, label long"), "exact")
    links = exact.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(exact.where("cls <> label").select(F.col("cls").alias("a"), F.col("label").alias("b")).distinct())
    per_class = classes.drop("sig", "size", "text_hash").join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("key", "n_docs", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "cls").alias("label"))
    per_class = stage(per_class, "linked")
    least = per_class.groupBy("label").agg(F.min("least_id").alias("class_id"))
    per_class = per_class.join(least, "label").selectExpr("key", "class_id", "links + n_docs - 1 AS n_links", "n_docs AS n_copies")
    return told.select("doc_id", "key").join(per_class, "key", "left").selectExpr("doc_id", "CASE WHEN key IS NULL THEN doc_id ELSE class_id END AS class_id", "coalesce(n_links, 0L) AS n_links", "key AS text_class", "coalesce(n_copies, 1L) AS n_copies")


def op7_chosen_path(spark, sf_dir):
    return jaccard_join(read(spark, sf_dir, "documents"))


QUERIES = {"op7_chosen_path": op7_chosen_path}
ORACLES = {}
