"""The data model: lazy tables of particles, bonds, cells, types and attributes, all keyed by frame."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of ``cells``: three edge vectors, the origin, periodicity and whether the cell is two-dimensional.
CELL = "frame int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, ox double, oy double, oz double, px boolean, py boolean, pz boolean, is2d boolean"
ATTRIBUTES = "frame int, key string, num double, str string"
BONDS = "frame int, bidx long, i long, j long, sx int, sy int, sz int"
TYPES = "property string, id int, name string, r double, g double, b double, radius double"
POSITION = ("Position.X", "Position.Y", "Position.Z")


def col(name: str, of: str | None = None) -> Column:
    """A column whose name may hold dots and blanks."""
    return F.col(f"{of}.`{name}`" if of else f"`{name}`")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share.  Only a local master may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{_own_dir()}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Written to the shared folder and read again: lineage is cut and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds places from 0 within each frame in an order whose keys tell rows apart.

    Rows are dealt out by ranges of (frame, order), so a frame spreads over many tasks; each task's rows begin at the sum of
    what tasks before it have of the frame, from a table with a row per task and frame.
    """
    dealt = df.repartitionByRange("frame", *(col(c) for c in order)).sortWithinPartitions("frame", *(col(c) for c in order))
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    counts = dealt.groupBy("frame", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("frame").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("frame", "_part", (before - F.col("_first")).alias("_base"))
    out = dealt.join(base, ["frame", "_part"]).withColumn(name, F.col("_row") + F.col("_base"))
    return out.select(*(col(c) for c in dict.fromkeys([*df.columns, name])))


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers find this package where it lies in the same folder; elsewhere ship it with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))


@dataclass(frozen=True)
class Dataset:
    """Tables of a trajectory.  ``particles`` has frame, idx (the order within the frame) and property columns such as ``Position.X``."""

    particles: DataFrame
    cells: DataFrame
    bonds: DataFrame | None = None
    types: DataFrame | None = None
    attributes: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.particles.sparkSession

    def having(self, **tables: DataFrame | None) -> Dataset:
        return replace(self, **tables)

    def properties(self) -> list[str]:
        return [c for c in self.particles.columns if c not in ("frame", "idx")]

    def has(self, name: str) -> bool:
        return name in self.particles.columns

    def in_cell(self, what: DataFrame | None = None) -> DataFrame:
        """Rows with the cell of their frame beside them."""
        return (self.particles if what is None else what).join(self.cells, "frame")

    def with_attributes(self, rows: DataFrame) -> Dataset:
        """``rows``: frame, key, num[, str].  A key that is there already is replaced in the frames of ``rows``."""
        rows = rows.select("frame", "key", F.col("num").cast("double").alias("num"), (F.col("str") if "str" in rows.columns else F.lit(None).cast("string")).alias("str"))
        if self.attributes is None:
            return self.having(attributes=rows)
        kept = self.attributes.join(rows.select("frame", "key"), ["frame", "key"], "left_anti")
        return self.having(attributes=kept.unionByName(rows))

    def count_attribute(self, key: str, condition: Column) -> Dataset:
        """An attribute with the number of particles that meet a condition, 0 in frames without any."""
        n = self.particles.groupBy("frame").agg(F.count_if(condition).alias("n"))
        rows = self.cells.select("frame").join(n, "frame", "left").select("frame", F.lit(key).alias("key"), F.coalesce("n", F.lit(0)).alias("num"))
        return self.with_attributes(rows)

    def apply(self, fn: Callable[[Dataset], Dataset]) -> Dataset:
        """A user's operator on the lazy tables."""
        return fn(self)

    def apply_frames(self, fn, schema: str) -> Dataset:
        """A user's function over the pandas table of each frame's particles; a frame must fit one task."""
        return self.having(particles=self.particles.groupBy("frame").applyInPandas(fn, schema))

    def frames(self, wanted: Iterable[int]) -> Dataset:
        """Only some frames of every table."""
        keep = F.col("frame").isin(*wanted)
        return Dataset(self.particles.where(keep), self.cells.where(keep), self.bonds and self.bonds.where(keep), self.types, self.attributes and self.attributes.where(keep))

    def neighbors(self, cutoff: float) -> DataFrame:
        from sparktraj.operators.neighbors import pairs

        return pairs(self, cutoff)

    def nearest(self, k: int) -> DataFrame:
        from sparktraj.operators.neighbors import knn

        return knn(self, k)


@dataclass(frozen=True)
class Pipeline:
    """An ordered list of operators (functions from Dataset to Dataset).  Most add to a lazy plan per table; those that write on their way (deletion with new numbers, created
    bonds, nearest neighbours and what is built on them) run jobs when they are applied."""

    steps: tuple[Callable[[Dataset], Dataset], ...] = ()

    def append(self, step: Callable[[Dataset], Dataset]) -> Pipeline:
        return Pipeline((*self.steps, step))

    def insert(self, at: int, step: Callable[[Dataset], Dataset]) -> Pipeline:
        return Pipeline((*self.steps[:at], step, *self.steps[at:]))

    def without(self, at: int) -> Pipeline:
        return Pipeline((*self.steps[:at], *self.steps[at + 1 :]))

    def apply(self, ds: Dataset) -> Dataset:
        for step in self.steps:
            ds = step(ds)
        return ds


def cells_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Cells from tuples in the order of ``CELL``.

    As an Arrow table, whose size Spark knows: a few cells are broadcast, where rows of unknown size would have particles, or pairs, dealt out by frame to join them.
    """
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in CELL.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[t]) for c, (n, t) in zip(columns, fields)}))


def box(frame: int, size: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0), pbc: tuple[bool, bool, bool] = (True, True, True), is2d: bool = False) -> tuple:
    """A rectangular cell's row."""
    x, y, z = map(float, size)
    return (frame, x, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, z, *map(float, origin), *pbc[:2], pbc[2] and not is2d, is2d)
