import random

import pytest
from pyspark.sql import functions as F

from sparktraj.dataset import Dataset, box, cells_of, col
from sparktraj.operators import analyze
from sparktraj.streaming.frames import run_on_frames, stream_displacements, stream_particles


def test_frames_arrive_in_two_runs(spark, tmp_path):
    cells = cells_of(spark, [box(f, (10, 10, 10)) for f in range(2)])
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "frame int, idx long, `Position.X` double, `Position.Y` double, `Position.Z` double"
    for f in range(2):
        rows = [(f, k, float(k), 0.0, 0.0) for k in range(3 + f)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run_on_frames(stream_particles(spark, source, schema), cells, lambda ds: analyze.coordination(ds, 1.0).particles, out, log).awaitTermination()
    got = spark.read.parquet(out).groupBy("frame").agg(F.sum(col("Coordination")).alias("n")).collect()
    assert {r.frame: r.n for r in got} == {0: 4, 1: 6}


SCHEMA = "frame int, idx long, `Particle Identifier` long, `Position.X` double, `Position.Y` double, `Position.Z` double"
NAMES = ["Displacement.X", "Displacement.Y", "Displacement.Z", "Displacement Magnitude"]


def arriving(spark, tmp_path, parts, cells, late):
    """What the stream gives for files of rows that come one by one, a batch each."""
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stream_displacements(stream_particles(spark, source, SCHEMA, 1), cells, late)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len({(r.frame, r["Particle Identifier"]) for r in got}) == len(got)
    return {(r.frame, r["Particle Identifier"]): None if r[NAMES[3]] is None else tuple(r[c] for c in NAMES) for r in got}


def test_displacements_of_shuffled_arrivals_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(3)
    # A particle is missing in one frame, and all cross the border now and then.
    rows = [(f, k, 10 + k, (3.0 * f + k) % 10, rng.random() * 10, 5.0) for f in range(6) for k in range(4) if (f, k) != (3, 2)]
    cells = cells_of(spark, [box(f, (10, 10, 10), pbc=(True, False, True)) for f in range(102)])
    want = analyze.displacements(Dataset(spark.createDataFrame(rows, SCHEMA), cells), None, -1, missing="null").particles.collect()
    want = {(r.frame, r["Particle Identifier"]): None if r[NAMES[3]] is None else tuple(r[c] for c in NAMES) for r in want}
    rng.shuffle(rows)
    # Frames come in pieces, and one piece twice; a frame far ahead ends the waiting.
    parts = [rows[k::4] for k in range(4)] + [rows[1::4], [(100, 0, 10, 0.0, 0.0, 0.0)], [(101, 0, 10, 1.0, 0.0, 0.0)]]
    got = arriving(spark, tmp_path, parts, cells, 20)
    assert got.pop((101, 10)) == pytest.approx((1, 0, 0, 1)) and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v)
    assert got[3, 10] is not None and got[4, 12] is None and got[0, 10] is None


def test_a_frame_that_comes_too_late_is_no_place_before(spark, tmp_path):
    one = lambda f: [(f, 0, 10, float(f), 0.0, 0.0)]
    cells = cells_of(spark, [box(f, (100, 10, 10)) for f in range(60)])
    got = arriving(spark, tmp_path, [one(f) for f in (0, 1, 3, 4, 8, 9, 2, 50)], cells, 2)
    assert got == {(0, 10): None, (1, 10): (1, 0, 0, 1), (3, 10): None, (4, 10): (1, 0, 0, 1), (8, 10): None, (9, 10): (1, 0, 0, 1)}
