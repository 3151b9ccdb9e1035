"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words everywhere in this package.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"

#: Bytes of text that Python code takes at a time; a longer single text is taken alone.  Chunks repeat more in larger slices.
SLICE_BYTES, CHUNKED_BYTES = 2_000_000, 8_000_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; where it's unset, a new local one, with a local master only."""
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{_own_dir()}"


def new_path(spark: SparkSession, name: str) -> str:
    _STAGED.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


_STAGED: list[str] = []


def staged() -> int:
    """How many tables and files have been written to the shared folder so far."""
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables and files written to the shared folder from the ``since``-th on, but the last ``keep``, when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    end = len(_STAGED) - keep
    for name in _STAGED[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _STAGED[since:end]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and lost executors lose nothing.  ``drop_staged`` takes it away."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_fs(uri: str):
    """(pyarrow file system, path in it) of a folder that all machines share; local files are memory-mapped on reading."""
    import pyarrow.fs as fs

    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(use_mmap=True), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where it lies in the same folder; elsewhere ship it with --py-files."""
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, beside other ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in order, in batches of at most ``most`` bytes of text each, one row at least.  Nulls in ``text`` become ''."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        k = b.schema.get_field_index(text)
        col = pc.fill_null(b.column(k), "")
        b = b.set_column(k, text, col)
        total = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
    give_back()


def docs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """Only the columns that an operator reads, under its own names; other columns and clashing names are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in more.items()))


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % mod


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; none in a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


#: Elements that an SQL expression handles by growing an array; longer arrays are handled in parts of so many, so work stays near the length.
PART = 512


def parts_of(items: str) -> str:
    """SQL: the array in parts of ``PART`` elements; one empty part for an empty array.  ``items`` must be cheap to evaluate again."""
    return f"transform(sequence(0, greatest(size({items}) - 1, 0) DIV {PART}), i -> slice({items}, i * {PART} + 1, {PART}))"


def running(values: str, step: str) -> str:
    """SQL for what stands before each element of an int array: 0 for the first, then ``step`` (of a and x) over the elements before it."""
    grown = lambda items, start, of: (
        f"aggregate({items}, named_struct('r', CAST(array() AS array<int>), 'a', {start}), (acc, y) -> named_struct('r', concat(acc.r, array(acc.a)), 'a', {of}), acc -> acc.r)"
    )
    one = step.replace("{a}", "acc.a").replace("{x}", "y")
    part = step.replace("{a}", "acc.a").replace("{x}", f"aggregate(y, 0, (b, z) -> {step.replace('{a}', 'b').replace('{x}', 'z')})")
    return f"""transform(array({values}), v -> transform(array({parts_of('v')}), ps ->
        flatten(zip_with(ps, {grown('ps', '0', part)}, (p, s) -> {grown('p', 's', one)})))[0])[0]"""


#: Steps of ``running``: sums, and largest so far.
SUM, LARGEST = "({a} + {x})", "greatest({a}, {x})"


def spans_of(text: str, prefix: str, match: str, gate: str = "true", context: int = 0) -> str:
    """SQL for the leftmost non-overlapping matches in column ``text``: array<struct<s, e, v, c>> in code points, end exclusive.

    ``prefix`` must take what lies before the next match and never what a match would begin with; with the anchor to the
    end of the previous match the scan is linear in the text.  ``gate`` is a cheap necessary condition.  ``c`` is what stands
    before the match, back to the previous one, ``context`` characters at most.
    """
    pattern = ("\\G(" + prefix + ")(" + match + ")").replace("\\", "\\\\").replace("'", "\\'")
    part = lambda k: f"regexp_extract_all({text}, '{pattern}', {k})"
    kind = "CAST(array() AS array<struct<s:int,e:int,v:string,c:string>>)"
    before = f"right(x.p, {context})" if context else "''"
    return f"""CASE WHEN {gate} THEN transform(array(zip_with({part(1)}, {part(2)}, (p, m) -> named_struct('p', p, 'l', length(p), 'm', m, 'n', length(m)))), found ->
        zip_with(found, {running('transform(found, w -> w.l + w.n)', SUM)}, (x, at) -> named_struct('s', at + x.l, 'e', at + x.l + x.n, 'v', x.m, 'c', {before})))[0]
        ELSE {kind} END"""
