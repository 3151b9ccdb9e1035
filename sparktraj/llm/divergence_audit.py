"""Source divergence audit: which sources of a language use its terms otherwise, and by which terms.

Terms are maximal runs of letters A-Z, a-z and all characters beyond ASCII, only A-Z lower-cased.  A language keeps the V terms that at least
``LEAST_DOCS`` of its documents have.  With N the sum of a group's counts over kept terms, a term's share is p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), for
each (lang, source) group and for each language as a whole, and two shares are f = floor((p - q)**2 / (p + q)) apart.

Pairs of sources come from postings: a term that neither source has adds the same as any other such term, one that a single source has
depends on its count alone, and only terms of both are met in a join on (lang, term).

Terms of a group (p over the language's q) are searched by bounds: buckets of like counts have a largest p and a least q, and f of these two bounds all
of a bucket, as f grows with p and falls with q.  Buckets are evaluated best first, in rounds; a group is done when the bounds of
all buckets not seen lie strictly below its k-th best value.

Defined results: null text, lang and source are ''; a group without terms has its pairs; a language without kept terms has pairs of value 0; a group whose shares are nowhere over the language's
has no term rows; repeated rows count each, as documents of their own; an empty table gives an empty table; ids and other columns aren't read.
All arithmetic is on whole numbers.  Counts are summed inside tasks first, so a hot source or term is a row a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, read, slices, stage

LEAST_DOCS, TOP = 10, 10
#: Terms that a task holds before it hands its sums on, and bytes of a text that it splits at a time.
MOST_TERMS, PIECE = 200_000, 1_000_000
#: Buckets of a group that the first round evaluates; each further round has four times as many.
FIRST = 4

#: Bytes of terms, lower-cased, all others as blanks: all bytes of characters beyond ASCII are over 0x7F.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Stands before a source's name in the row that tells of a group; no term has it.
_GROUP = b"\x00"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of a task, in parts; a group's own row has ``_GROUP`` and its source as term."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> pa.RecordBatch:
        rows = [(lang, source, t, n[t], d) for (lang, source), (n, docs) in sums.items() for t, d in docs.items()]
        sums.clear()
        lang, source, term, n, docs = zip(*rows)
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in slices(batches):
        langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
        for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            n, docs = sums.setdefault((langs[k], sources[k]), (Counter(), Counter()))
            text, seen, at = text.translate(_TABLE), {_GROUP + sources[k].encode()}, 0
            while at < len(text):
                end = text.find(b" ", at + PIECE)
                end = len(text) if end < 0 else end
                words = text[at:end].split()
                n.update(words)
                seen.update(words)
                at = end
            docs.update(seen)
        if sum(len(docs) for _, docs in sums.values()) > MOST_TERMS:
            yield handed()
    if sums:
        yield handed()


def postings(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n of kept terms, with the language's count n_lang and whether this is the term's first source; for each group a row without term."""
    names = {"text": text_col, "lang": lang_col, "source": source_col}
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in names.items()))
    d = arrow_map(d, _counted, "lang string, source string, term string, n long, docs long")
    # Dealt by (lang, term) once, for the sums of a group's term and for those over the term's groups.
    d = d.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    d = d.withColumns({"n_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
    group = F.col("term").startswith(_GROUP.decode())
    d = d.where(group | (F.col("n_docs") >= least_docs))
    return stage(d.select("lang", "source", F.when(~group, F.col("term")).alias("term"), "n", "n_lang", "lead"), "divergence-postings")


def _share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (N + 2 V)) on decimals, as the product may pass 2**63."""
    up = (F.lit(count) if isinstance(count, int) else count).cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", (up * F.lit(10**9).cast("decimal(10,0)")), (total + 2 * terms).cast("decimal(19,0)")) + 1


def _apart(p: str, q: str) -> Column:
    """Shares are at most 10**9 + 1, so squares fit a long."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))")


def groups_of(posts: DataFrame) -> DataFrame:
    """lang, source, total (N), terms (V), lang_total, p0 (the share of a count of 0; null where V is 0)."""
    each = posts.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count_if(F.col("term").isNotNull() & F.col("lead")).alias("leads"))
    whole = each.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("total").alias("lang_total"))
    d = each.drop("leads").join(whole, "lang")
    return stage(d.withColumn("p0", F.when(F.col("terms") > 0, _share(0, F.col("total"), F.col("terms")))), "divergence-groups")


def shares_of(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings with the shares p (the group's) and q (the language's), and the group's p0."""
    d = posts.where("term IS NOT NULL").join(groups, ["lang", "source"])
    d = d.select("lang", "source", "term", "n", "p0", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    return stage(d, "divergence-shares")


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each other source of a language: f summed over all its kept terms."""
    g = groups.select("lang", "source", "terms", "p0")
    pairs = g.join(g.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0")), "lang").where("source <> item")
    # Terms of one source against a count of 0 in the other, less what is counted for all terms as if both had 0.
    alone = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    alone = alone.join(g.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0")), "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_apart("p", "i0") - _apart("p0", "i0"))).alias("v"))
    # Terms of both: what they add in place of the two parts above.
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("i"), F.col("p0").alias("i0"))
    both = shares.select("lang", "term", "source", "p", "p0").join(other, ["lang", "term"]).where("source < item")
    both = both.groupBy("lang", "source", "item").agg(F.sum(_apart("p", "i") - _apart("p", "i0") - _apart("p0", "i") + _apart("p0", "i0")).alias("v"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    mirrored = alone.unionByName(both).select("lang", F.explode(ways).alias("w"), "v").select("lang", "w.source", "w.item", "v")
    base = pairs.select("lang", "source", "item", (F.col("terms") * _apart("p0", "i0")).alias("v"))
    return base.unionByName(mirrored).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))


def _best(d: DataFrame, top: int) -> DataFrame:
    """The best rows of each group; tasks drop what is beyond ``top`` before the rows are dealt by group."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_terms(shares: DataFrame, top: int = TOP, first: int = FIRST) -> DataFrame:
    """lang, source, item, value, rank: the best terms of each group among those with p > q."""
    key = ["lang", "source"]
    d = shares.where("p > q").select(*key, F.col("term").alias("item"), "p", "q", F.expr("CAST(floor(log2(n) * 4) AS int)").alias("bucket"))
    bounds = d.groupBy(*key, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).select(*key, "bucket", _apart("p", "q").alias("bound"))
    bounds = stage(bounds.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bound"), "bucket"))), "divergence-bounds")
    found, turn, seen, upto = None, bounds, 0, first
    while True:
        chosen = turn.where((F.col("place") > seen) & (F.col("place") <= upto)).select(*key, "bucket")
        got = d.join(chosen, [*key, "bucket"]).select(*key, "item", _apart("p", "q").alias("value"))
        found = stage(_best(got if found is None else got.unionByName(found.drop("rank")), top), "divergence-best")
        last = found.where(F.col("rank") == top).select(*key, F.col("value").alias("least"))
        turn = stage(bounds.where(F.col("place") > upto).join(last, key, "left").where("least IS NULL OR bound >= least").drop("least"), "divergence-open")
        if turn.isEmpty():
            return found
        seen, upto = upto, upto * 4


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.  See the module's docstring for the edge cases."""
    posts = postings(docs, text_col, lang_col, source_col, least_docs)
    groups = groups_of(posts)
    shares = shares_of(posts, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(shares, groups).withColumn("rank", F.row_number().over(order))
    out = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, d in (("pair", pairs), ("term", top_terms(shares, top)))]
    return out[0].unionByName(out[1])


def op13_divergence_audit(spark, sf_dir):
    return divergence_audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (n_lang + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q FROM x),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op13_divergence_audit": op13_divergence_audit}
ORACLES = {"op13_divergence_audit": ORACLE}
