"""Connected components and the exact resolution of candidate buckets, in DataFrame operations only.

A *bucket* holds ids that may be linked pairwise. Writing out all pairs of a bucket grows with the square of its size, so ``connect_buckets`` first
compares every bucket's members with one of them only, its centre: the member whose buckets are the most crowded, as what is close to the middle of a
group of copies shares more buckets than what strayed from it. What is linked joins components, and a bucket whose members all share a component
needs no further comparison. Only ids of buckets that hold several components stay open; ``settle`` names the pairs that may still be linked among them, and all of these are
compared. No link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, materialize

#: Edges in one partition of a table of edges.
EDGES = 200_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    return checkpoint(df.coalesce(1 + rows // EDGES))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, comp)``, comp being the smallest id reachable; alternating large-star and small-star steps.

    Ids without an edge do not appear. Self-loops, repeated edges and nulls are ignored. An empty input gives no rows. The steps end when every id hangs on
    one smaller id that hangs on none, which is looked up exactly.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and u is not null and v is not null").distinct())
    rows = e.count()
    e = _packed(e, rows) if rows else e
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("v").alias("id"), F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = _packed(large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), rows)
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connect_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame, DataFrame], DataFrame], near: Callable[[str, str], Column] | None = None, payload: tuple[str, ...] = (), owned: bool = False) -> DataFrame:
    """Components of ids that meet in a bucket and are linked.

    members: ``(key, id, *payload)``, each id at most once in a bucket; verify: distinct candidate pairs ``(a, b)`` with a < b -> the linked ones; near: a condition on the
    payloads of two aliases that every link meets, tested inside joins; settle: ``(id, comp)`` of what is open and the crowded members -> the linked pairs ``(a, b)`` among
    ids of different components, all of them at least; owned: members is a materialized table that nothing else reads, and is removed as soon as it has been read.
    Returns ``(id, comp)`` of all ids that have a link, comp being the smallest id of the component.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = materialize(members.join(sizes, "key"), "crowded")
    if owned:
        discard(members)
    weighed = crowded.drop("size").join(crowded.groupBy("id").agg(F.sum("size").alias("weight")), "id")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "id", *payload)).alias("centre")).select("key", "centre.*")
    m, c = weighed.alias("m"), centres.alias("c")
    met = (F.col("m.key") == F.col("c.key")) & (F.col("m.id") != F.col("c.id")) & (F.lit(True) if near is None else near("m", "c"))
    links = checkpoint(verify(m.join(c, met).select(*ordered(F.col("m.id"), F.col("c.id"))).distinct()).select("a", "b"))
    labels = connected_components(links)
    now = crowded.drop("size").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    left = materialize(now.join(mixed, "key", "left_semi"), "open")
    discard(crowded)
    found = checkpoint(settle(left.select("id", "comp").distinct(), left).select("a", "b"))
    if not found.isEmpty():
        labels = connected_components(found.union(labels.filter("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b"))))
    discard(left)
    return labels
