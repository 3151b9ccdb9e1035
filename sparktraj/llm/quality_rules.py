"""Quality rules: a threshold table compiled into one projection.

``quality_rules(docs)`` takes any frame with an id and a text column and returns one row per input row with the counts,
the ratios' verdict and nothing else of the input, so further or clashing columns don't matter.

Defined results: a null text has no words and no lines, so all counts are 0 and the base rule (fewer than 50 words) fails
it; an id is passed through, null too; repeated rows give repeated results; an empty table gives an empty table.
All is built-in SQL functions inside one row: no shuffle, and memory follows the longest single text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import WS, read, words_of

#: Common function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is that it was for on are as with be by this from at or an not
der die und das den von zu mit sich auf ist im dem nicht ein eine als auch des
le la les de des et un une du en que qui pour dans est par sur pas au plus
el los las y del una se con para por lo su al es como
""".split()


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose feature lies in [low, high]; None: no bound on that side."""

    feature: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_length", low=1.5, high=20),
    Rule("symbol_ratio", high=0.15),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("upper_ratio", high=0.6),
)

#: Ratios over counted columns; a ratio over nothing is 0.
FEATURES = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
}


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression over the counted columns."""
    verdict = F.lit(True)
    for rule in rules:
        over = FEATURES.get(rule.feature)
        x = F.col(rule.feature) if over is None else F.when(F.col(over[1]) > 0, F.col(over[0]) / F.col(over[1])).otherwise(0.0)
        if rule.low is not None:
            verdict = verdict & (x >= rule.low)
        if rule.high is not None:
            verdict = verdict & (x <= rule.high)
    return verdict


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, counts, base_failed and kept, then the columns ``keep`` as _keep_0 and so on.  See the module's docstring for the edge cases.

    Words in repeated 3-word windows are found per row: 44 bits of each window's hash and its position are packed into a
    long, neighbours after a sort are the candidates, and only those are compared as words.  Texts of over 2**20 words take
    every window as a candidate.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)))
    kept = [f"_keep_{k}" for k in range(len(keep))]
    d = d.select("doc_id", "_t", *kept, words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("_l"))
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(stops))).cast("long"),
        "_s": F.expr("CASE WHEN size(_w) >= 3 THEN sort_array(transform(sequence(0, size(_w) - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), 20) | CAST(i AS bigint))) END"),
    }).drop("_t", "_l")
    d = d.withColumn("_p", F.expr("""CASE
        WHEN _s IS NULL THEN CAST(array() AS array<int>)
        WHEN size(_s) > 1048576 THEN sequence(0, size(_s) - 1)
        ELSE transform(filter(_s, (x, i) -> shiftright(x, 20) <=> shiftright(get(_s, i - 1), 20) OR shiftright(x, 20) <=> shiftright(get(_s, i + 1), 20)), x -> CAST(x & 1048575 AS int)) END"""))
    d = d.withColumn("_e", F.expr("sort_array(transform(_p, p -> named_struct('a', _w[p], 'b', _w[p + 1], 'c', _w[p + 2], 'p', p)))"))
    same = "(x.a <=> get(_e, i {0} 1).a AND x.b <=> get(_e, i {0} 1).b AND x.c <=> get(_e, i {0} 1).c)"
    d = d.withColumn("_q", F.expr(f"transform(filter(_e, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> x.p)"))
    d = d.withColumn("n_repeat_words", F.expr("CAST(size(array_distinct(flatten(transform(_q, p -> array(p, p + 1, p + 2))))) AS bigint)"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & compiled(rules)).alias("kept"), *kept)


def op8_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"))


def _rule_sql() -> str:
    out = []
    for r in RULES:
        over = FEATURES.get(r.feature)
        x = r.feature if over is None else f"(CASE WHEN {over[1]} > 0 THEN CAST({over[0]} AS DOUBLE) / {over[1]} ELSE 0 END)"
        out += [f"{x} >= {r.low}"] * (r.low is not None) + [f"{x} <= {r.high}"] * (r.high is not None)
    return " AND ".join(out)


_STOPS = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
        SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE g.n > 1 GROUP BY rid),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
        len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rule_sql()} AS kept FROM b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": ORACLE}
