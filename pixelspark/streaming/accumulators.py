"""Structured Streaming over arriving image rows: histograms with retraction, spectra and reconstructions that grow row by row, progress."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.histograms import bin_of
from ..operators.planes import lines_of

#: Columns of a row of the state of a growing plane, and products that a task holds at a time.
BLOCK, PRODUCTS = 8, 1 << 20


def stream_histogram(samples: DataFrame, sign: str | None = None, total: tuple[str, ...] = ()) -> DataFrame:
    """Running ``image_id, channel, bin, n``; a column ``sign`` of 1 and -1 adds and retracts rows; with ``total``, those channels also sum up as ``Total``."""
    n = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
    d = samples.select("image_id", "channel", bin_of("v").alias("bin"), n.alias("n")).filter("bin is not null")
    if total:
        names = F.when(F.col("channel").isin(*total), F.array("channel", F.lit("Total"))).otherwise(F.array("channel"))
        d = d.withColumn("channel", F.explode(names))
    return d.groupBy("image_id", "channel", "bin").agg(F.sum("n").alias("n"))


def _turned(batch: pa.RecordBatch, index: str, lines: np.ndarray, height: int, to: str, sign: int, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """What complex ``lines`` (a row each of ``batch``, at the place ``index``) add to the ``height`` lines ``to`` of their planes, in blocks of ``BLOCK`` columns: parts ``re0, re1, ..., im0, ...`` of ``kinds``, null beyond the width.

    Lines of a plane are summed first, so a batch sends on each of its planes once as a rule.
    """
    n, width = lines.shape
    image, channel = (pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in ("image_id", "channel"))
    order = np.lexsort((channel, image))
    place, turns = batch.column(index).to_numpy().astype(np.int64), np.exp(sign * 2j * np.pi * np.arange(height) / height)
    wide = -(-width // BLOCK) * BLOCK
    for at in range(0, n, step := max(1, PRODUCTS // (height * width))):
        some = order[at : at + step]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(image[some]) != 0) | (np.diff(channel[some]) != 0)]))
        sums = np.full((len(first), height, wide), np.nan, complex)
        sums[:, :, :width] = np.add.reduceat(lines[some][:, None, :] * turns[np.outer(place[some], np.arange(height)) % height][:, :, None], first, axis=0)
        beyond = np.tile((np.arange(wide) >= width).reshape(-1, BLOCK), (len(first) * height, 1))
        keys = pa.array(np.repeat(some[first], height * (wide // BLOCK)))
        y, block = (np.tile(a.ravel().astype(np.int32), len(first)) for a in np.indices((height, wide // BLOCK)))
        columns = [batch.column("image_id").take(keys), batch.column("channel").take(keys), pa.array(y), pa.array(block), *(pa.array(part[:, k], mask=beyond[:, k]) for kind in kinds for part in [(sums.real if kind == "re" else sums.imag).reshape(-1, BLOCK)] for k in range(BLOCK))]
        yield pa.record_batch(columns, names=["image_id", "channel", to, "block", *_parts(kinds)])


def _parts(kinds: tuple[str, ...]) -> list[str]:
    return [f"{kind}{k}" for kind in kinds for k in range(BLOCK)]


def _summed(lines: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], to: str, along: str, kinds: tuple[str, ...]) -> DataFrame:
    """Running ``image_id, channel, to, along`` and ``kinds``. The state has a row for ``BLOCK`` columns of a line."""
    parts = lines.mapInArrow(run, f"image_id long, channel string, {to} int, block int, " + ", ".join(f"{c} double" for c in _parts(kinds)))
    sums = parts.groupBy("image_id", "channel", to, "block").agg(*(F.sum(c).alias(c) for c in _parts(kinds)))
    cells = F.inline(F.array(*(F.struct((F.col("block") * BLOCK + k).alias(along), *(F.col(f"{kind}{k}").alias(kind) for kind in kinds)) for k in range(BLOCK))))
    return sums.select("image_id", "channel", to, cells).filter("re is not null")


def stream_spectrum(scanlines: DataFrame, height: int) -> DataFrame:
    """Running DFT of planes of a known height: an arriving row's own transform, turned by its place, is added to every bin; order does not matter. Meant for previews, as the state is a whole plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes[sizes > 0]).tolist():
                of = batch.take(pa.array(np.flatnonzero(sizes == width)))
                yield from _turned(of, "y", np.fft.fft(lines_of(of), axis=1), height, "ky", -1, ("re", "im"))

    return _summed(scanlines.select("image_id", "channel", "y", F.col("v").cast("array<double>").alias("v")), run, "ky", "kx", ("re", "im"))


def stream_reconstruct(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Running inverse from arriving spectrum rows ``image_id, channel, ky, re, im`` (arrays over kx): exact once all have come, in any order.

    A row is inverted along x once; each of its ``width`` values is then turned along y and added to the ``height`` pixels of its column, so a row makes height * width additions, not
    width times as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("re")).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]).tolist():
                of = batch.take(pa.array(np.flatnonzero(sizes == n)))
                yield from _turned(of, "ky", np.fft.ifft(lines_of(of, "re") + 1j * lines_of(of, "im"), n=width, axis=1), height, "y", 1, ("re",))

    doubles = (F.col(c).cast("array<double>").alias(c) for c in ("re", "im"))
    return _summed(rows.select("image_id", "channel", "ky", *doubles), run, "y", "x", ("re",)).select("image_id", "channel", "y", "x", (F.col("re") / height).alias("v"))


def stream_progress(rows: DataFrame, height: int, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Running ``image_id, done, complete``; a row that arrives again does not count twice. A watermark (column, delay) bounds what is remembered."""
    keys = ["image_id", "y"]
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    else:
        rows = rows.dropDuplicates(keys)
    return rows.groupBy("image_id").agg(F.count("*").alias("done")).withColumn("complete", F.col("done") >= height)


def stream_completion(rows: DataFrame, height: int, delay: str = "1 hour") -> DataFrame:
    """Each image once, when it is done with: ``image_id, done, complete, replayed``, from arriving ``image_id, y, at``.

    An image's state is one bit a line and two counts. It leaves by a timer as soon as the watermark is ``delay`` behind the image's last row, complete or not; a complete image gives
    up its bits at once and keeps the counts until then. A line that comes again within that time is ``replayed``; rows of an image that has left begin anew. Rows behind the watermark are
    late: Spark leaves them out and counts them in each batch's progress (``numRowsDroppedByWatermark``). Lines outside the image only move the watermark.
    """
    wait = int(_seconds(delay) * 1000)

    def closed(key, held) -> pd.DataFrame:
        _, done, replayed, _ = held
        return pd.DataFrame({"image_id": [key[0]], "done": [done], "complete": [done >= height], "replayed": [replayed]})

    def step(key, batches, state):
        if state.hasTimedOut:
            yield closed(key, state.get)
            state.remove()
            return
        held = state.get if state.exists else None
        if held is not None and held[3] + wait <= state.getCurrentWatermarkMs():  # its time is over, but new rows came before the timer
            yield closed(key, held)
            held = None
        seen, done, replayed, newest = held or (bytes(-(-height // 8)), 0, 0, 0)
        bits = bytearray(seen)
        for pdf in batches:
            newest = max(newest, int(pdf["at"].max().timestamp() * 1000))
            for y in pdf["y"].tolist():
                if not 0 <= y < height:
                    continue
                if done >= height or bits[y >> 3] >> (y & 7) & 1:
                    replayed += 1
                else:
                    bits[y >> 3] |= 1 << (y & 7)
                    done += 1
        if done + replayed == 0:
            return
        state.update((bytes(bits) if done < height else b"", done, replayed, newest))
        state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))

    rows = rows.select("image_id", "y", "at").withWatermark("at", delay)
    return rows.groupBy("image_id").applyInPandasWithState(step, "image_id long, done long, complete boolean, replayed long", "seen binary, done long, replayed long, newest long", "append", "EventTimeTimeout")


def _seconds(delay: str) -> float:
    """Seconds of an interval such as ``10 minutes``."""
    return pd.Timedelta(delay).total_seconds()


def run_appending(stream: DataFrame, folder: str) -> tuple[DataFrame, list[dict]]:
    """Process all that is available; ``(rows, progress of each batch)``. A batch writes its own rows only, under its number, so a batch that runs again leaves the same files."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result").select(*stream.columns), [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Process all that is available, keep the last complete result as Parquet under ``folder`` and return it."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result")
