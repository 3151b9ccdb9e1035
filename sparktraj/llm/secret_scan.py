"""Secret scans with corpus-wide ownership frequency.

Three base kinds are found per text by pattern; further credential shapes are candidates only.  All candidate values are
hashed, counted by distinct repository and distinct owner over the whole corpus, and a value held by few owners counts as
live, one copied widely as an example.  Live candidates of the further shapes are added to the base spans.  A repository's owner is a column
of its own, or else what stands before the first slash of the repository's name, the whole name if it has none.

Defined results: a null text is empty and has no spans; a null id is passed through; a null repository or owner counts as
one unnamed one; repeated rows each give a row and count once per repository; an empty table gives an empty table; other
columns are not read.  Only built-in SQL functions run.  The text is never shuffled: what moves is the spans found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import read, spans_of, stage

#: Kind -> (prefix, match, gate, SQL condition on x.v that a match must meet).  Fixed values.
BASE = {
    "assign": (
        "(?s:.*?)", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=-]+)""",
        "(instr(_t, ':') > 0 OR instr(_t, '=') > 0)",
        r"""length(regexp_extract(x.v, '^[A-Za-z_]+["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""",
    ),
    "access": ("(?s:.*?)", "AKIA[A-Z0-9]+", "instr(_t, 'AKIA') > 0", "length(x.v) >= 20"),
    "hex": ("(?s:.*?)", "[0-9a-f]{24,}", "_t RLIKE '[0-9a-f]{24}'", "true"),
}
_PEM_LINE_END = r"(?:\r?\n|(?:\\r)?\\n)"
#: A private key from its header to its END line; where there is none, with all lines of base64 that follow.  Line ends may be escaped.
#: Loops are possessive, as Java takes others by recursion.
_PEM = (
    "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:"
    "[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]{0,30}PRIVATE KEY-----|"
    rf"(?:[\x20\t]*+[A-Za-z0-9+/=]{{32,}}+)?+(?:[\x20\t]*+{_PEM_LINE_END}[A-Z][A-Za-z-]{{2,30}}:\x20[^\r\n\\]*+)*+"
    rf"""(?:[\x20\t]*+(?:{_PEM_LINE_END}[\x20\t]*+)++(?:[A-Za-z0-9+/=]{{32,}}+|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:["']|{_PEM_LINE_END}|\z))))*+)"""
)
#: Further shapes; only live values of these become spans.
EXTRA = {
    "jwt": ("(?s:.*?)", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "instr(_t, 'eyJ') > 0"),
    "prefixed": ("(?s:.*?)", r"(?:gh[pousr]_|github_pat_|xox[baprs]-|sk_live_|rk_live_|glpat-|AIza)[A-Za-z0-9_-]{16,}", "_t RLIKE 'gh[pousr]_|github_pat_|xox[baprs]-|[sr]k_live_|glpat-|AIza'"),
    "url_login": ("(?s:.*?)", r"://[^\s:/@]{1,64}:[^\s/@]{6,128}@", "instr(_t, '://') > 0"),
    "pem": ("(?s:.*?)", _PEM, "instr(_t, '-----BEGIN ') > 0"),
}
#: Values are compared as what follows the assignment sign, private keys as their body however its lines are cut (a header alone as it stands); other kinds as they stand.
_VALUES = {
    "assign": r"""regexp_extract(x.v, '^(?:[A-Za-z_]+["\']?\\x20*[:=]\\x20*["\']?)?(.*)$', 1)""",
    "pem": r"""coalesce(nullif(regexp_replace(x.v, '-----[A-Z ]+-----|\\\\[rnt]|[^A-Za-z0-9+/=]', ''), ''), x.v)""",
}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, repo, owner, base and extra arrays of (s, rank, e, kind, h)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), (F.col(owner_col).cast("string") if owner_col else F.substring_index(F.col(repo_col).cast("string"), "/", 1)).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    kinds = [*BASE, *EXTRA]
    for kind, (prefix, match, gate, *_) in (BASE | EXTRA).items():
        d = d.withColumn(f"_{kind}", F.expr(spans_of("_t", prefix, match, gate)))

    def shaped(kind: str) -> str:
        keep = f"filter(_{kind}, x -> {BASE[kind][3]})" if kind in BASE else f"_{kind}"
        return f"transform({keep}, x -> named_struct('s', x.s, 'rank', {kinds.index(kind)}, 'e', x.e, 'kind', '{kind}', 'h', sha2({_VALUES.get(kind, 'x.v')}, 256)))"

    d = d.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "owner",
        F.expr(f"array_sort(concat({', '.join(map(shaped, BASE))}))").alias("base"),
        F.expr(f"array_sort(concat({', '.join(map(shaped, EXTRA))}))").alias("extra"),
    )
    return stage(d, "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: the number of distinct repositories and owners.  Counted in two steps, so no hot value meets in one task."""
    c = found.select(F.explode(F.concat("base", "extra")).alias("x"), "repo", "owner").select(F.col("x.h").alias("h"), "repo", "owner").distinct()
    return c.groupBy("h").agg(F.count_distinct(F.coalesce("repo", F.lit(""))).alias("n_repos"), F.count_distinct(F.coalesce("owner", F.lit(""))).alias("n_owners"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, max_live_owners: int = 2, max_live_repos: int = 5) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans, and n_live and n_example over all its spans.

    A value found with at most ``max_live_owners`` owners, in at most ``max_live_repos`` of their repositories, is live, else an example.
    """
    found = candidates(docs, id_col, text_col, repo_col, owner_col)
    each = found.where("size(base) + size(extra) > 0").select("rid", F.explode(F.concat("base", "extra")).alias("x"))
    judged = each.withColumn("h", F.col("x.h")).join(stage(ownership(found), "secret-owners"), "h")  # written first: a value held very often is then split by the engine
    live = (F.col("n_repos") <= max_live_repos) & (F.col("n_owners") <= max_live_owners)
    per_doc = judged.groupBy("rid").agg(
        F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example"),
        F.collect_list(F.when(live & (F.col("x.rank") >= len(BASE)), F.col("x"))).alias("added"),
    )
    joined = found.join(per_doc, "rid", "left")
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    count = lambda kind: F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    return joined.select(
        "doc_id", *map(count, BASE), F.expr(f"sha2({text.format('base')}, 256)").alias("base_sha256"),
        F.expr(text.format("array_sort(concat(base, coalesce(added, filter(base, x -> false))))")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op2_secret_scan(spark, sf_dir):
    return secret_scan(read(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES = {}
