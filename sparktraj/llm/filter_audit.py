"""Filter interaction audit: what each of five filters removes in each order, by part of a corpus.

Copies are found by sorting: texts are dealt out by ranges of (fingerprint, doc_id), sorted by fingerprint, full text and doc_id, and compared
with their predecessor.  So a large group of copies spreads over many tasks.  Each task hands on the texts of its last fingerprint
with their least doc_id; the few rows that begin a task's first fingerprint are held against those of all other tasks.  Each
document then is a mask of the filters it fails, masks are counted by part, and all orders follow from these counts:
after a set S of filters a part keeps what has no bit in S.

A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * characters A-Z > 5 * code points; D: holds one of #$%&*|; E: identical to the
text of a smaller doc_id.  Words are maximal runs of other characters than ASCII white space, and case counts.

Defined results: a null text is empty; a null source is the part ''; a null doc_id is neither smaller nor larger than another, so its row never fails E
and has no labels; repeated rows count each, and are no copies of one another; of several labels of a document any 1 counts; a part without
failures has its zeros; an empty table has no parts; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, docs_of, id_type, read, slices, stage

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MASKS = range(2 ** len(FILTERS))
#: Bytes of a text that are split into words at a time.
PIECE = 1_000_000

_UPPER, _SPECIAL, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def failed(text: bytes) -> int:
    """The mask of A to D for a text in UTF-8."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    less = lambda chars: len(text) - len(text.translate(None, chars))
    return (n < 50) | (100 * len(seen) < 65 * n) << 1 | (100 * less(_UPPER) > 5 * (len(text) - less(_INNER))) << 2 | (less(_SPECIAL) > 0) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of fingerprint, text and doc_id -> kind 0: a document and its mask (with its text where another task may have a smaller copy); kind 1: a text of the last fingerprint."""
    names, schema = ["kind", "part", "doc_id", "fp", "mask", "edge"], None
    first = fp = None
    texts: list[tuple[bytes, object]] = []  # of this fingerprint, each with its least doc_id
    for b in slices(batches):
        schema = b.schema
        ids, fps = b.column("doc_id").to_pylist(), b.column("fp").to_pylist()
        masks, edges = np.zeros(len(b), np.int32), []
        for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            if fps[k] != fp:
                fp, texts = fps[k], []
                first = fp if first is None else first
            if not texts or texts[-1][0] != text:
                texts.append((text, ids[k]))
            least = texts[-1][1]
            if least is None and ids[k] is not None:
                texts[-1] = (text, least := ids[k])
            copy = ids[k] is not None and ids[k] > least
            masks[k] = failed(text) | copy << 4
            edges.append(text if fp == first and ids[k] is not None and not copy else None)
        yield pa.record_batch([pa.array(np.zeros(len(b), np.int32)), b.column("part"), b.column("doc_id"), b.column("fp"), pa.array(masks), pa.array(edges, pa.binary())], names=names)
    last = [(t, d) for t, d in texts if d is not None]
    if last:
        n = len(last)
        yield pa.record_batch([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.string()), pa.array([d for _, d in last], schema.field("doc_id").type), pa.array([fp] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([t for t, _ in last], pa.binary())], names=names)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: part, doc_id and mask, bit k for the k-th of ``FILTERS``."""
    d = docs_of(docs, id_col, text_col, part=F.coalesce(F.col(part_col).cast("string"), F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("part", "doc_id", F.xxhash64("text").alias("fp"), "text")
    d = d.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    d = stage(arrow_map(d, _judged, f"kind int, part string, doc_id {id_type(docs, id_col)}, fp long, mask int, edge binary"), "filter-masks")
    rows = d.where("kind = 0")
    tails = d.where("kind = 1").groupBy("fp", "edge").agg(F.min("doc_id").alias("least"))
    begun = rows.where("edge IS NOT NULL").join(tails, ["fp", "edge"], "left")
    settled = begun.withColumn("mask", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")))
    return rows.where("edge IS NULL").select("part", "doc_id", "mask").unionByName(settled.select("part", "doc_id", "mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: sums that add up over any split of the documents."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    d = masks.join(marks, "doc_id", "left")
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def interactions(counted: DataFrame) -> DataFrame:
    """All orders and steps of each part.  One row a part has what each of the 32 sets keeps, and the steps are looked up in it."""
    kept = lambda c: F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in MASKS))
    fails = lambda k: F.col("mask").bitwiseAND(1 << k) != 0
    orders = len(ORDERS)
    share = F.element_at(F.array(*(F.lit(orders // max(1, m.bit_count())) for m in MASKS)), F.col("mask") + 1)
    each = lambda value: F.array(*(F.sum(F.when(fails(k), value(k)).otherwise(0)) for k in range(len(FILTERS))))
    d = counted.groupBy("part").agg(
        *(kept(c).alias(f"_{c}") for c in ("n", "good", "toxic")), each(lambda k: F.col("n")).alias("_fails"),
        each(lambda k: F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias("_only"), each(lambda k: F.col("n") * share).alias("_shapley"),
    )
    steps = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            steps.append((order, step, k, before, before := before | 1 << k))
    table = "array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'f', {k}, 'b', {b}, 'a', {a})" for o, s, k, b, a in steps) + ")"
    d = d.withColumn("s", F.explode(F.expr(table)))
    return d.select(
        "part", "s.filter_order", "s.step", F.expr("_n[s.a]").alias("kept"), F.expr("_n[s.b] - _n[s.a]").alias("removed"),
        F.expr("_fails[s.f] - (_n[s.b] - _n[s.a])").alias("redundant"), F.expr("_only[s.f]").alias("unique_fails"),
        F.expr("_good[s.b] - _good[s.a]").alias("good_lost"), F.expr("_toxic[s.b] - _toxic[s.a]").alias("toxic_lost"), F.expr("_shapley[s.f]").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step.  See the module's docstring for the edge cases."""
    return interactions(counters(masks(docs, id_col, text_col, part_col), labels))


def op12_filter_audit(spark, sf_dir):
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ORDER_ROWS = ", ".join(f"('{o}')" for o in ORDERS)
ORACLE = rf"""
WITH t AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
        'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)}} AS x
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT filter_order, step, filter_order[step:step] AS letter, string_split(filter_order[1:step], '') AS done, CASE WHEN step = 1 THEN [] ELSE string_split(filter_order[1:step - 1], '') END AS earlier
      FROM (VALUES {_ORDER_ROWS}) AS v(filter_order), range(1, 6) AS r(step)),
g AS (SELECT part, filter_order, step, letter, n, good, toxic, NOT list_has_any(fails, done) AS kept, list_contains(fails, letter) AS hit, list_contains(fails, letter) AND NOT list_has_any(fails, earlier) AS gone, len(fails) = 1 AS only_one FROM m, o),
s AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (hit AND only_one), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (gone), 0) AS BIGINT) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": ORACLE}
