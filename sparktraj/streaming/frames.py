"""Trajectories that grow: frames arrive as Parquet files of particle rows and operators run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparktraj import geometry as g
from sparktraj.dataset import CELL, POSITION, Dataset, col
from sparktraj.operators.analyze import less_a_period


def stream_particles(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Particle rows of files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts_by_frame(particles: DataFrame, time_column: str, window: str, delay: str) -> DataFrame:
    """Particles per time window, with a watermark for late files."""
    return particles.withWatermark(time_column, delay).groupBy(F.window(time_column, window).alias("window")).agg(F.count("*").alias("n"))


def stream_displacements(particles: DataFrame, cells: DataFrame | None, late: int, key: str = "Particle Identifier") -> DataFrame:
    """Displacement.X/Y/Z and Displacement Magnitude of each particle since the frame before, on a stream whose frames arrive in any order, also apart for the particles of one.

    The stream joins itself on (key, frame before), so Spark keeps each particle's last places as state.  Frames are their own clock: one that comes more than ``late`` frames
    behind the largest one is dropped (a batch's progress counts such rows), and a place that came twice counts once.  Rows come as soon as both places are there; those whose place
    before is missing come with nulls once it would be too late for it.  ``cells`` has a row a frame, or is None where particles have the columns of their cell beside them.
    """
    names = [x.split()[0] for x in CELL.split(", ")][1:]
    seen = particles if cells is None else particles.join(cells, "frame")
    seen = seen.select("frame", col(key).alias("_id"), *(col(c).alias(f"_{k}") for c, k in zip(POSITION, "xyz")), *names).where("_id IS NOT NULL")
    # Watermarks begin at second 0, and what isn't beyond them is late: frame 0 and numbers below must lie behind it.
    seen = seen.withColumn("_at", F.timestamp_seconds(F.col("frame").cast("long") + (1 << 32))).withWatermark("_at", f"{late} seconds").dropDuplicatesWithinWatermark(["_id", "frame"])
    before = seen.select(F.col("_id").alias("_id0"), *(F.col(f"_{k}").alias(f"_{k}0") for k in "xyz"), (F.col("frame") + 1).alias("_next"), F.col("_at").alias("_at0"))
    joined = seen.join(before, (F.col("_id") == F.col("_id0")) & (F.col("frame") == F.col("_next")) & (F.col("_at") == F.col("_at0") + F.expr("INTERVAL 1 SECOND")), "left")
    d = less_a_period(joined.withColumns({f"_v{k}": F.col(f"_{k}") - F.col(f"_{k}0") for k in "xyz"}))
    v = tuple(F.col(f"_v{k}") for k in "xyz")
    return d.select("frame", F.col("_id").alias(key), *(x.alias(f"Displacement.{k}") for x, k in zip(v, "XYZ")), g.norm(v).alias("Displacement Magnitude"))


def run_on_frames(particles: DataFrame, cells: DataFrame, operator: Callable[[Dataset], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to each micro-batch and writes its rows, a folder a batch, so that a batch that is tried again takes its own place.

    A frame's rows must come in one file, as frames don't wait for each other.
    """

    def each(batch: DataFrame, number: int) -> None:
        ds = Dataset(batch, cells.join(batch.select("frame").distinct(), "frame"))
        operator(ds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return particles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
