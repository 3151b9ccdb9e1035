"""The corpus pipeline: language ID, quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.  All but the last
return the columns of ``documents``.

* language ID learns its profiles from the rows with a language and rejects what has no letters, and texts of at least ``LETTERS``
  letters whose cosine with every language is under ``LEAST_COSINE``;
* quality rules keep what ``quality_rules`` keeps;
* near duplicates: of each class of documents linked at a Jaccard similarity of 0.8 over word 5-grams the one of least doc_id (of
  these, of least text hash) stays; of repeated rows one stays; documents without words stay;
* personal data is replaced by the name of its kind in brackets, and n_chars follows the new text;
* packing returns the pieces with their sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktraj.llm import language_id, pii
from sparktraj.llm.chosen_path import jaccard_join
from sparktraj.llm.common import drop_staged, read, stage, staged
from sparktraj.llm.packing import pack, pieces
from sparktraj.llm.quality_rules import quality_rules

LETTERS = 200
LEAST_COSINE = 0.2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    names = docs.columns
    out = language_id.predict(docs, language_id.fit(docs), keep=tuple(names))
    strange = (F.col("n_letters") >= LETTERS) & (2 * F.col("score") - 1 < LEAST_COSINE)
    return out.where((F.col("lang_pred") != "und") & ~strange).select(*(F.col(f"_keep_{k}").alias(c) for k, c in enumerate(names)))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # A condition on a row number stays above the projection; else the filter's expression would be computed anew below it.
    judged = quality_rules(docs, keep=tuple(docs.columns)).withColumn("_row", F.monotonically_increasing_id())
    return judged.where("kept AND _row >= 0").select(*(F.col(f"_keep_{k}").alias(c) for k, c in enumerate(docs.columns)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    row = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    classes = jaccard_join(docs.select(row.alias("row"), "text"), id_col="row")
    gone = classes.where("text_class IS NOT NULL AND NOT (doc_id <=> class_id)").select(F.col("doc_id").alias("row")).distinct()
    keyed = docs.withColumn("_row", row)
    left = keyed.join(gone, F.col("_row").eqNullSafe(F.col("row")), "left_anti")
    # Repeated rows have one id and text; all but one of them go.
    if keyed.groupBy("_row").count().where("count > 1").isEmpty():
        return left.drop("_row")
    copy = Window.partitionBy("_row").orderBy("lang", "source", "n_chars")
    return left.withColumn("_n", F.row_number().over(copy)).where("_n = 1 OR btrim(coalesce(text, '')) = ''").drop("_n", "_row")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048), 2048)


STAGES = [("language ID", identified), ("quality rules", ruled), ("near duplicates", distinct), ("personal data", without_pii), ("packing", packed)]

#: No SQL can express the learnt and iterative stages; a test compares run() with a plain version of its stages on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read(spark, sf_dir, "documents"), staged()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(spark, since, keep=1)  # all that this stage and the one before it wrote, but its result
    return STAGES[-1][1](spark, docs, sf_dir)
