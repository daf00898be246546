"""Accumulators over several micro-batches: rows that come again, are taken back, or come late."""

import numpy as np
from pyspark.sql import functions as F

from pixelspark.streaming import accumulators as acc


def _arriving(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_retraction_over_batches(spark, tmp_path):
    schema = "image_id long, channel string, v double, sign int"
    parts = [[(1, "R", 5.0, 1), (1, "R", 5.0, 1), (1, "G", 7.5, 1)], [(1, "R", 5.0, -1), (2, "R", 0.0, 1)], [(1, "G", 7.5, -1), (2, "R", 255.0, 1)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = acc.run_to_end(acc.stream_histogram(_arriving(spark, tmp_path / "in", schema), sign="sign"), f"file://{tmp_path}/state")
    assert {(r.image_id, r.channel, r.bin): r.n for r in got.collect()} == {(1, "R", 5): 1, (1, "G", 7): 0, (2, "R", 0): 1, (2, "R", 255): 1}


def test_growing_spectrum_and_its_inverse_keep_a_row_for_eight_columns(spark, tmp_path):
    """Planes of 5 x 19 and 5 x 8 in batches of some lines each: NumPy's transform, back again, and the size of the state."""
    rng = np.random.default_rng(3)
    planes = {(1, "R"): rng.normal(size=(5, 19)), (1, "G"): rng.normal(size=(5, 19)), (2, "R"): rng.normal(size=(5, 8))}
    lines = [(*k, y, v[y].tolist()) for k, v in planes.items() for y in range(5)]
    schema = "image_id long, channel string, y int, v array<double>"
    for k in range(3):
        spark.createDataFrame(lines[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spectrum = acc.run_to_end(acc.stream_spectrum(_arriving(spark, tmp_path / "in", schema), 5), f"file://{tmp_path}/state")
    got = {(r.image_id, r.channel, r.ky, r.kx): complex(r.re, r.im) for r in spectrum.collect()}
    want = {(*k, ky, kx): z for k, v in planes.items() for (ky, kx), z in np.ndenumerate(np.fft.fft2(v))}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    state = spark.read.format("statestore").load(f"{tmp_path}/state/state").count()
    assert state == 5 * (3 + 3 + 1)
    schema = "image_id long, channel string, ky int, re array<double>, im array<double>"
    rows = [(*k, y, np.fft.fft2(v)[y].real.tolist(), np.fft.fft2(v)[y].imag.tolist()) for k, v in planes.items() if v.shape[1] == 19 for y in range(5)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    back = acc.run_to_end(acc.stream_reconstruct(_arriving(spark, tmp_path / "rows", schema), 5, 19), f"file://{tmp_path}/state2")
    got = {(r.image_id, r.channel, r.y, r.x): r.v for r in back.collect()}
    assert len(got) == 2 * 95 and all(np.isclose(v, planes[k[:2]][k[2:]]) for k, v in got.items())


def test_rows_that_arrive_again_count_once(spark, tmp_path):
    schema = "image_id long, y int, at timestamp"
    for rows in ([(1, 0), (1, 1)], [(1, 1), (1, 2), (2, 0)], [(1, 0), (2, 0)]):
        df = spark.createDataFrame(rows, "image_id long, y int").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n, watermark in enumerate((None, ("at", "1 hour"))):
        got = acc.run_to_end(acc.stream_progress(_arriving(spark, tmp_path / "in", schema), 3, watermark), f"file://{tmp_path}/state{n}")
        assert {r.image_id: (r.done, r.complete) for r in got.collect()} == {1: (3, True), 2: (1, False)}


def test_state_of_finished_images_leaves(spark, tmp_path):
    schema, day = "image_id long, y int, at timestamp", "2024-01-01 "
    parts = [
        [(1, 0, "00:00"), (1, 1, "00:01"), (2, 0, "00:00"), (3, 9, "00:00")],
        [(1, 1, "00:02"), (1, 2, "00:03"), (2, 0, "00:05"), (1, 0, "00:04")],  # image 1 completes, then a line comes again
        [(1, 2, "00:30"), (2, 1, "00:50"), (4, 0, "00:40")],
        [(-1, -1, "05:00")],
        [(4, 1, "05:01"), (1, 1, "05:02"), (9, 0, "00:10"), (-1, -1, "23:00")],  # images 1 and 4 anew, image 9 too late
    ]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame([(i, y, day + t + ":00") for i, y, t in rows], "image_id long, y int, t string").selectExpr("image_id", "y", "cast(t as timestamp) at")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, progress = acc.run_appending(acc.stream_completion(arriving.select("image_id", "y", "at"), 3, "10 minutes"), f"file://{tmp_path}/state")
    rows = sorted((r.image_id, r.done, r.complete, r.replayed) for r in got.collect())
    # Image 1 was complete and got three lines again; what images 1 and 4 send after their time begins anew; (2, 0) came twice.
    assert rows == [(1, 1, False, 0), (1, 3, True, 3), (2, 2, False, 1), (4, 1, False, 0), (4, 1, False, 0)]
    totals = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert len(progress) >= 6 and max(totals) >= 2 and totals[-1] == 0
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1  # (9, 0) of ten hours before
