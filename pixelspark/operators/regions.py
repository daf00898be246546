"""Connected regions of sparse masks ``image_id, y, x``.

Set pixels of a line become runs (gaps and islands), runs of neighbouring lines that lie close enough are the edges of a graph, and the graph is contracted until no edge is left: every label moves to
its smallest neighbour, then to that one's, and edges follow their ends. Only runs and edges are shuffled, and no task holds an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Columns that share a bucket when close runs of two lines are looked up.
STRIP = 64


def mask_runs(mask: DataFrame, reach: int = 1) -> DataFrame:
    """``image_id, y, x, run``: each distinct set pixel with the first column of its run, in which neighbours are at most ``reach`` columns apart."""
    line = Window.partitionBy("image_id", "y").orderBy("x")
    d = mask.select("image_id", "y", "x").distinct().withColumn("start", F.coalesce(F.col("x") - F.lag("x").over(line) > reach, F.lit(True)))
    return d.select("image_id", "y", "x", F.max(F.when(F.col("start"), F.col("x"))).over(line).alias("run"))


def _touching(runs: DataFrame, reach: int) -> DataFrame:
    """``image_id, a, b``: pairs of runs ``image_id, id, y, first, last`` of two lines at most ``reach`` apart that come within ``reach`` columns of each other, looked up by strips of columns."""
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(lo / STRIP).cast("int"), F.floor(hi / STRIP).cast("int"))).alias("strip")
    upper = runs.select("image_id", F.col("id").alias("a"), "y", (F.col("first") - reach).alias("from"), (F.col("last") + reach).alias("to"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("dy"))
    upper = upper.select("image_id", "a", (F.col("y") + F.col("dy")).alias("y"), "from", "to", strips(F.col("from"), F.col("to")))
    lower = runs.select("image_id", F.col("id").alias("b"), "y", "first", "last", strips(F.col("first"), F.col("last")))
    return upper.join(lower, ["image_id", "y", "strip"]).filter("first <= to and last >= `from`").select("image_id", "a", "b").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """``image_id, a, b`` -> ``image_id, id, region``: the smallest id reachable from each id that has an edge."""
    ends = lambda e: e.union(e.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.filter("a <> b"), "edges")
    labels = ends(edges).select("image_id", F.col("a").alias("id"), F.col("a").alias("region")).distinct()
    while not edges.isEmpty():
        up = ends(edges).groupBy("image_id", F.col("a").alias("region")).agg(F.least(F.min("b"), F.col("a")).alias("to"))
        up = stored(up, "parents")
        for _ in range(2):  # parents of parents, so that chains shrink fast
            over = up.select("image_id", F.col("region").alias("to"), F.col("to").alias("then"))
            up = up.join(over, ["image_id", "to"], "left").select("image_id", "region", F.coalesce("then", "to").alias("to"))
        up = stored(up, "parents")
        move = lambda d, c: d.join(up.select("image_id", F.col("region").alias(c), F.col("to").alias(f"new_{c}")), ["image_id", c], "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
        labels = stored(move(labels, "region").select("image_id", "id", "region"), "labels")
        edges = stored(move(move(edges, "a"), "b").filter("a <> b").select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def mask_regions(mask: DataFrame, reach: int = 1) -> DataFrame:
    """``image_id, y, x, region``: set pixels are of one region if a chain of set pixels joins them, each at most ``reach`` lines and columns from the next.

    A region's name is y * 2^32 + x of its first pixel by line and column. Repeated pixels count once, an empty mask has no regions.
    """
    key = F.shiftleft(F.col("y").cast("long"), 32) + F.col("run")
    pixels = stored(mask_runs(mask, reach).withColumn("id", key), "runs")
    runs = pixels.groupBy("image_id", "id", "y").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    labels = contracted(_touching(runs, reach))
    return pixels.join(labels, ["image_id", "id"], "left").select("image_id", "y", "x", F.coalesce("region", "id").alias("region"))
