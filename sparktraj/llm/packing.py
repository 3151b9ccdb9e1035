"""Best-fit packing of documents into sequences, improved by swap-based local search.

Pieces of full length make a sequence each, in SQL.  The others are dealt to groups of bounded size by a hash, each group is
packed best fit first, and all its underfull bins are then worked on: items move, or are exchanged one for one, two for one or
one for two, always from the emptier to the fuller bin, which raises the sum of squared fills, until no two bins of the group
have such an exchange.  The underfull bins of all groups are dealt anew and worked on again, until there is one group or a
round saves no sequence.

Defined results: a null text is empty and has the end id only; ids, null or repeated, are carried through, and repeated rows are
packed one by one; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.chunks import SPACES, ChunkEncoder, by_library
from sparktraj.llm.common import CHUNKED_BYTES, arrow_map, docs_of, id_type, read, slices, stage

#: Pieces packed together in one task.
GROUP = 4000


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(SPACES, by_library(path, lowered=False))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  Of a document of over ``size`` ids, the first piece is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([end_id], "<u4")
        for b in slices(batches, most=CHUNKED_BYTES):
            rows: list[tuple] = []
            for k, x in enumerate(encode(b.column("text"))):
                ids = np.concatenate([x, end])
                edges = [0, *range(len(ids) - (len(ids) - 1) // size * size, len(ids) + 1, size)]
                rows += [(k, n, s, e - s, zlib.crc32(ids[s:e])) for n, (s, e) in enumerate(zip(edges[:-1], edges[1:]))]
            k, n, s, length, crc = zip(*rows)
            yield pa.record_batch([b.column("doc_id").take(pa.array(k)), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs_of(docs, id_col, text_col), cut, f"doc_id {id_type(docs, id_col)}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit over items by falling length: bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    frees = 0  # bit f: some bin has f free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = frees >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                frees ^= 1 << free
            bins[k].append(i)
        else:
            k, free = len(bins), size
            bins.append([i])
        if free > n:
            by_free.setdefault(free - n, []).append(k)
            frees |= 1 << free - n
    return bins


class _Bins:
    """Bins with their items by length, and an index of what each underfull bin can be brought to have free.

    In ``rooms[w][c][f]`` are the bins of ``f`` free that have ``c`` free once they have given back one item (w = 1), or none, one or two (w = 0).
    A bin has few distinct lengths, 63 at most in 2048, so its entries are few however many items it has.
    """

    def __init__(self, bins: list[list[int]], length: list[int], size: int):
        self.length, self.size = length, size
        self.held: list[dict[int, list[int]]] = [{} for _ in bins]
        self.fill = [0] * len(bins)
        self.rooms: tuple[dict[int, dict[int, set[int]]], ...] = ({}, {})
        self.known = [0, 0]  # bit c: rooms[w] has c
        for k, b in enumerate(bins):
            self.put(k, b)
            self.enter(k)

    def put(self, k: int, items: list[int]) -> None:
        for i in items:
            self.held[k].setdefault(self.length[i], []).append(i)
            self.fill[k] += self.length[i]

    def take(self, k: int, total: int, items: int) -> list[int]:
        """Takes ``items`` items of that total length out."""
        held = self.held[k]
        if items == 0:
            return []
        if items == 1:
            lengths = [total]
        else:
            n = next(n for n in held if (total - n in held if 2 * n != total else len(held[n]) > 1))
            lengths = [n, total - n]
        out = [held[n].pop() for n in lengths]
        for n in lengths:
            if n in held and not held[n]:
                del held[n]
        self.fill[k] -= total
        return out

    def sums(self, k: int) -> tuple[set[int], set[int]]:
        """Lengths of single items and of two."""
        held = self.held[k]
        ones = sorted(held)
        return set(ones), {n + m for i, n in enumerate(ones) for m in ones[:i]} | {2 * n for n in ones if len(held[n]) > 1}

    def _rooms(self, k: int) -> tuple[set[int], set[int]]:
        free = self.size - self.fill[k]
        ones, twos = self.sums(k)
        return {free, *(free + n for n in ones | twos)}, {free + n for n in ones}

    def open(self, k: int) -> bool:
        return 0 < self.fill[k] < self.size

    def enter(self, k: int) -> None:
        if self.open(k):
            for w, rooms in enumerate(self._rooms(k)):
                for c in rooms:
                    self.rooms[w].setdefault(c, {}).setdefault(self.size - self.fill[k], set()).add(k)
                    self.known[w] |= 1 << c

    def leave(self, k: int) -> None:
        if self.open(k):
            free = self.size - self.fill[k]
            for w, rooms in enumerate(self._rooms(k)):
                for c in rooms:
                    of = self.rooms[w][c]
                    of[free].discard(k)
                    if not of[free]:
                        del of[free]
                    if not of:
                        self.known[w] ^= 1 << c

    def exchange(self, low: int) -> tuple[int, int, int, int, int] | None:
        """What ``low`` gives (length, items), to which bin, as full as itself or fuller, and what it gets back (length, items).

        The exchange that leaves the receiver the least room, of all that raise its fill; None only if there is none.
        """
        ones, twos = self.sums(low)
        least, found = self.size + 1, None
        for w, given in ((0, ones), (1, twos)):
            for n in sorted(given, reverse=True):
                rest, c = self.known[w] >> n, n
                while rest:
                    step = (rest & -rest).bit_length()
                    c += step - 1
                    if c - n >= least:
                        break
                    # It gets c - free back, so its fill rises by n - c + free.
                    for free, bins in self.rooms[w][c].items():
                        if c - n < free <= self.size - self.fill[low]:
                            k = next((k for k in bins if k != low), None)
                            if k is not None:
                                back = c - free
                                least, found = c - n, (n, 1 + w, k, back, 0 if not back else 1 if w or back in self.held[k] else 2)
                                break
                    rest, c = rest >> step, c + 1
                if least == 0:
                    return found
        return found


def local_search(bins: list[list[int]], length: list[int], size: int) -> list[list[int]]:
    """Empties bins by exchanges that raise the sum of squared fills, until no two bins have one left."""
    b = _Bins(bins, length, size)
    moved = True
    while moved:
        moved = False
        for low in sorted(filter(b.open, range(len(bins))), key=lambda k: b.fill[k]):
            while b.open(low) and (got := b.exchange(low)):
                n, items, high, back, returned = got
                b.leave(low)
                b.leave(high)
                given, taken = b.take(low, n, items), b.take(high, back, returned)
                b.put(high, given)
                b.put(low, taken)
                b.enter(low)
                b.enter(high)
                moved = True
    return [[i for items in held.values() for i in items] for held in b.held if held]


def _packed(size: int):
    """A group's pieces with bin and offset; ``again``: in an underfull bin.  ``was`` tells the bins that the pieces came in."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        length = table["length"].to_pylist()
        came: dict[int, list[int]] = {}
        for i, was in enumerate(table["was"].to_pylist()):
            came.setdefault(was, []).append(i)
        bins = local_search(min(best_fit(length, size), list(came.values()), key=len), length, size)
        n, place, again = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                n[i], place[i] = k, at
                at += length[i]
            again[b] = at < size
        return pa.table({"rid": table["rid"], "length": table["length"], "grp": pa.array([key[0].as_py()] * len(length), pa.int64()), "bin": n, "offset": place, "again": again})

    return pack


def pack(pieces: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table with a length column of 1 to ``size``."""
    told = stage(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    done = [told.where(F.col("length") >= size).select("rid", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, base, before = told.where(F.col("length") < size).select("rid", "length", F.col("rid").alias("was")), 0, None
    while n := rest.count():
        groups = -(-n // group)
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("was", F.lit(base)), F.lit(groups)))
        packed = stage(dealt.groupBy("g").applyInArrow(_packed(size), "rid long, length long, grp long, bin long, offset long, again boolean"), "packed")
        packed = packed.withColumn("sequence_id", (F.lit(base) + F.col("grp")) * F.lit(1 << 24) + F.col("bin"))
        # Each bin has one piece at its start.
        now, left = packed.where("offset = 0").selectExpr("count(*)", "count_if(again)").first()
        last = groups == 1 or now == before
        done.append(packed.where(F.lit(last) | ~F.col("again")).select("rid", "sequence_id", "offset"))
        if last:
            break
        base, before = base + groups, left
        rest = packed.where("again").select("rid", "length", F.col("sequence_id").alias("was"))
    places = functools.reduce(DataFrame.unionByName, done)
    return told.join(places, "rid").drop("rid")


def op5_best_fit_packing(spark, sf_dir, docs: DataFrame | None = None):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048), 2048)


QUERIES = {"op5_best_fit_packing": lambda spark, sf_dir: op5_best_fit_packing(spark, sf_dir)}
ORACLES = {}
