"""The driver's tables as particle frames."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparktraj.dataset import box, cells_of, Dataset, number


def cloud(spark: SparkSession, sf_dir: str, pbc: bool = True) -> Dataset:
    """Vectors as particles in a unit cube: the first three components are the position and the label is the type."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = t.select(F.lit(0).alias("frame"), F.col("vec_id").alias("idx"), F.col("vec_id").alias("Particle Identifier"), F.col("label").cast("int").alias("Particle Type"), *(F.col("embedding")[k].cast("double").alias(f"Position.{c}") for k, c in enumerate("XYZ")), F.col("embedding")[3].cast("double").alias("Charge"))
    return Dataset(p, cells_of(spark, [box(0, (1, 1, 1), (-0.5, -0.5, -0.5), (pbc,) * 3)]))


def items(spark: SparkSession, sf_dir: str) -> Dataset:
    """Order lines as particles, a frame per line number, in a box of edge 50.  Rows have no key, so their order is that of all columns."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Seven frames would mean seven tasks for a numbering; as nothing here needs places without gaps, a hash of the row serves.
    idx = F.xxhash64(*t.columns)
    p = t.select(F.col("l_linenumber").cast("int").alias("frame"), idx.alias("idx"), F.col("l_quantity").alias("Position.X"), (F.col("l_extendedprice") / 2100).alias("Position.Y"), (F.col("l_discount") * 500).alias("Position.Z"), F.col("l_tax").alias("Charge"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("Particle Type"))
    return Dataset(p, cells_of(spark, [box(k, (50, 50, 50)) for k in range(1, 8)]))


def tracks(spark: SparkSession, sf_dir: str) -> Dataset:
    """Users as particles, a frame per day: the mean value and the number of events of the day are the position, in a box of edge 100."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts"), F.lit("2020-01-01"))
    d = t.groupBy(day.alias("frame"), F.col("user_id").alias("Particle Identifier")).agg(F.sum(F.round("value").cast("long")).alias("v"), F.count("*").alias("n"))
    frames = d.select("frame").distinct()
    x = (F.col("v") % 100).cast("double")
    p = d.select("frame", F.col("Particle Identifier").alias("idx"), "Particle Identifier", x.alias("Position.X"), (F.col("n") * 7 % 100).cast("double").alias("Position.Y"), F.lit(1.0).alias("Position.Z"))
    row = box(0, (100, 100, 100))
    names = cells_of(spark, [row])
    cells = frames.select("frame", *(F.lit(v).alias(c) for c, v in zip(names.columns[1:], row[1:])))
    return Dataset(p, cells)


def lattice(spark: SparkSession, sf_dir: str) -> Dataset:
    """Parts as particles: size, price and key are the position in a box of 50 x 1200 x 50."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = t.select(F.lit(0).alias("frame"), F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("Particle Identifier"), F.col("p_size").cast("double").alias("Position.X"), (F.col("p_retailprice") - 900).alias("Position.Y"), (F.col("p_partkey") % 50).cast("double").alias("Position.Z"), F.substring("p_brand", 7, 1).cast("int").alias("Particle Type"))
    return Dataset(p, cells_of(spark, [box(0, (50, 1200, 50))]))


def numbered(ds: Dataset) -> Dataset:
    """idx as places from 0 within each frame."""
    return ds.having(particles=number(ds.particles, ["idx"], "_place").withColumn("idx", F.col("_place")).drop("_place"))
