"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents are dealt by hash into at most ``BLOCKS`` blocks. A source whose target exceeds its size is passed over once or twice
whole; for the rest of its target, blocks are taken in a pseudo-random order until the target is met, the last block document by document. What is taken
makes each source's exact quota of blocks. A splitting tree deals the quotas to 2^depth output shards, ``LEAST_SHARDS`` or more: each node halves its blocks, the halves' shares of the
sources being a multivariate hypergeometric draw (a chain of univariate draws by inversion). A source's blocks, in a second pseudo-random order, are then cut by the
leaves' quotas, so shards hold disjoint blocks and each shard is a uniform sample without replacement; rows are shuffled inside their shard.

All draws are hashes of the seed and of names, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, materialize

BLOCKS = 4096
#: Output shards there are at least, and words of one where there are more.
LEAST_SHARDS, SHARD_WORDS = 64, 4_000_000
WEIGHTS = (3, 1, 2)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _keyed(docs: DataFrame, id_col: str, source_col: str) -> list[Column]:
    """The source's key (null apart from every text), the block and the order inside the block."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    return [key.alias("_key"), F.substring(digest, 1, 3).alias("_block"), F.substring(digest, 4, 29).alias("_order")]


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(_key, source_size)`` -> the same with ``target``.

    Keys in code point order, null last, take the weights in turn and split ``share`` times all sizes; a target stops at ``cap`` times its source's size and the
    excess is dealt again by weight. In order of cap per weight the capped sources come first, so one running sum finds the level of the others.
    """
    named = Window.orderBy(F.col("_key") == "n", "_key")
    w = sources.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(cap))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    w = w.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - spent("most")) / (F.sum("w").over(whole) - spent("w")))
    level = F.max(F.when(F.col("most") > F.col("level") * F.col("w"), F.col("level"))).over(whole)
    return w.select("_key", "source_size", F.least("most", F.coalesce(level * F.col("w"), "most")).alias("target"))


def _uniform(*names) -> Column:
    """A number in (0, 1) from a hash of names."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in names)).cast("binary")), 1, 12), 16, 10).cast("double")
    return (n + 0.5) / F.lit(2.0**48)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by seven factors."""

    def series(z: Column) -> Column:
        low = z - 1.0
        for i in range(2, 8):
            low = low * (z - float(i))
        return (z - 0.5) * F.ln(z) - z + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) + 0.5 * math.log(2 * math.pi) - F.ln(low)

    return _let(x.cast("double") + 8.0, series)


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a uniform draw of ``drawn``: inversion over nine standard deviations (all that a double can tell apart)."""
    given = F.struct(good.cast("double").alias("g"), total.cast("double").alias("t"), drawn.cast("double").alias("d"), u.alias("u"))

    def spread(p: Column) -> Column:
        mean = F.when(p["t"] > 0, p["d"] * p["g"] / p["t"]).otherwise(0.0)
        variance = F.when(p["t"] > 1, p["d"] * p["g"] / p["t"] * (1 - p["g"] / p["t"]) * (p["t"] - p["d"]) / (p["t"] - 1)).otherwise(0.0)
        return _let(F.struct(mean.alias("mean"), (9 * F.sqrt(F.greatest(F.lit(0.0), variance)) + 9).alias("reach")), lambda m: _let(F.struct(
            F.greatest(F.lit(0.0), p["d"] - (p["t"] - p["g"]), F.floor(m["mean"] - m["reach"]).cast("double")).alias("low"), F.least(p["g"], p["d"], F.ceil(m["mean"] + m["reach"]).cast("double")).alias("high"),
        ), lambda r: chosen(p, r)))

    def weight(p: Column, k: Column) -> Column:
        return -(_ln_factorial(k) + _ln_factorial(p["g"] - k) + _ln_factorial(p["d"] - k) + _ln_factorial(p["t"] - p["g"] - p["d"] + k))

    def chosen(p: Column, r: Column) -> Column:
        mode = F.least(F.greatest(F.floor((p["d"] + 1) * (p["g"] + 1) / (p["t"] + 2)).cast("double"), r["low"]), r["high"])
        mass = _let(weight(p, mode), lambda top: F.transform(F.sequence(r["low"].cast("long"), r["high"].cast("long")), lambda k: F.exp(weight(p, k) - top)))
        return _let(mass, lambda w: _let(p["u"] * F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda level: F.least(r["low"] + below(w, level), r["high"]).cast("long")))

    def below(w: Column, level: Column) -> Column:
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["sum"] + x < level, 1).otherwise(0)).cast("long").alias("n"))
        return F.aggregate(w, state, step, lambda s: s["n"])

    return _let(given, spread)


def _splitter(level: int, seed: int, kind: str):
    """Takes a source's share of the half from what is left of the node and of the half."""

    def step(s: Column, x: Column) -> Column:
        def put(k: Column) -> Column:
            out = F.concat(s["out"], F.array(F.struct(x["_key"].alias("_key"), k.alias("q"))))
            return F.struct((s["left"] - x["q"]).alias("left"), (s["draw"] - k).alias("draw"), out.alias("out")).cast(kind)

        return _let(hypergeometric(x["q"], s["left"], s["draw"], _uniform(seed, level, F.col("shard"), x["_key"])), put)

    return step


def split_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """``quotas(_key, q)`` -> ``(shard, _key, q)`` for 2^depth shards; every source's q is kept exactly. One row a node: the number of sources is that of a mixture's weights."""
    nodes = quotas.filter("q > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("_key", F.col("q").cast("long").alias("q")))).alias("have"), F.lit(0).cast("long").alias("shard"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["q"])
    for level in range(depth):
        nodes = nodes.withColumn("all", total(F.col("have")))
        kind = "struct<left:bigint,draw:bigint,out:array<struct<_key:string,q:bigint>>>"
        start = F.struct(F.col("all").alias("left"), F.floor(F.col("all") / 2).alias("draw"), F.array().cast("array<struct<_key:string,q:bigint>>").alias("out")).cast(kind)

        step = _splitter(level, seed, kind)
        nodes = nodes.withColumn("one", F.aggregate("have", start, step, lambda s: s["out"]))
        other = F.zip_with("have", "one", lambda a, b: F.struct(a["_key"].alias("_key"), (a["q"] - b["q"]).alias("q")))
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("one").alias("have")), F.struct((F.col("shard") * 2 + 1).alias("shard"), other.alias("have")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.shard", "h.have")
        if level % 6 == 5:
            nodes = checkpoint(nodes)
    return nodes.select("shard", F.explode("have").alias("x")).select("shard", "x._key", "x.q")


def _plan(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...], seed: int, words_per_shard: int) -> tuple[DataFrame, DataFrame]:
    """``sizes(_key, _block, size)`` -> blocks ``(_key, _block, source_size, target, cut)`` and placed units ``(_key, _block, pass, shard, cut)``; cut: words taken of a partial unit, else null."""
    blocks = checkpoint(sizes.groupBy("_key", "_block").agg(F.sum("size").alias("words")))
    goals = targets(blocks.groupBy("_key").agg(F.sum("words").alias("source_size")), share, cap, weights)
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), "_key", "_block").cast("binary"))
    before = Window.partitionBy("_key").orderBy(rank, "_block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.join(goals, "_key").withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    b = b.withColumn("short", F.col("target") - F.col("passes") * F.col("source_size") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    b = b.withColumn("extra", (F.col("short") > 0) & (F.col("words") > 0)).withColumn("cut", F.when(F.col("extra") & (F.col("short") < F.col("words")), F.col("short")))
    b = checkpoint(b.select("_key", "_block", "words", "source_size", "target", "passes", "extra", "cut"))
    runs = (F.col("passes") + F.col("extra").cast("long")).cast("int")
    units = b.filter(runs > 0).select("_key", "_block", "cut", "passes", F.explode(F.sequence(F.lit(0), runs - 1)).alias("pass")).withColumn("cut", F.when(F.col("pass") == F.col("passes"), F.col("cut"))).drop("passes")
    wanted = b.groupBy().agg(F.sum(F.col("words") * F.col("passes") + F.when(F.col("extra"), F.coalesce("cut", "words")).otherwise(0)).alias("n")).first()["n"] or 0
    depth = math.ceil(math.log2(max(LEAST_SHARDS, wanted / words_per_shard)))
    leaves = split_quotas(units.groupBy("_key").agg(F.count("*").alias("q")), depth, seed)
    ends = Window.partitionBy("_key").orderBy("shard")
    leaves = leaves.withColumn("to", F.sum("q").over(ends)).filter("q > 0").select("_key", "shard", F.explode(F.sequence(F.col("to") - F.col("q") + 1, F.col("to"))).alias("place"))
    drawn = F.md5(F.concat_ws("|", F.lit(f"{seed}d"), "_key", "_block", "pass").cast("binary"))
    units = units.withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy(drawn, "_block", "pass")).cast("long"))
    return b, checkpoint(units.join(leaves, ["_key", "place"]).select("_key", "_block", "pass", "shard", "cut"))


def _with_chosen(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``rows(_key, _block, _order, size, ...)`` joined to ``times(_key, _block, cut, ...)``, and whether a row of a partial block is among those taken: rows in hash order up to the cut, the row at the
    cut if more than half of it fits. A source has one partial block at most, so few rows are sorted."""
    times = checkpoint(times)
    order = Window.partitionBy("_key", "_block").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("cut")
    partial = rows.join(times.filter("cut is not null"), ["_key", "_block"]).withColumn("chosen", chosen)
    return rows.join(times.filter("cut is null"), ["_key", "_block"]).withColumn("chosen", F.lit(False)).unionByName(partial)


def _dealt_rows(docs: DataFrame, share: float, cap: float, weights: tuple[int, ...], seed: int, words_per_shard: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of ``mix_report`` with their source's key."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(d.select("doc_id", "size", *_keyed(d, "doc_id", "source")), "sizes")
    blocks, placed = _plan(sizes, share, cap, weights, seed, words_per_shard)
    dealt = F.array_sort(F.collect_list(F.when(F.col("cut").isNull(), F.col("shard"))))  # at most three entries
    times = placed.groupBy("_key", "_block").agg(F.sum(F.col("cut").isNull().cast("long")).alias("whole"), F.max("cut").alias("cut"), dealt.alias("dealt"), F.max(F.when(F.col("cut").isNotNull(), F.col("shard"))).alias("last"))
    times = blocks.select("_key", "_block", "source_size", "target").join(times, ["_key", "_block"], "left")
    taken = F.col("size") * (F.coalesce("whole", F.lit(0)) + F.col("chosen").cast("long"))
    shards = F.array_join(F.when(F.col("chosen"), F.array_sort(F.concat("dealt", F.array("last")))).otherwise(F.col("dealt")), ",")
    shards = F.when((F.col("size") > 0) & F.col("dealt").isNotNull(), shards).otherwise(F.lit(""))
    return _with_chosen(sizes, times).select("_key", "doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def mix_report(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, words_per_shard: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken, shards``.

    ``shards`` are the numbers of the output shards that the splitting tree deals the document to, ascending and joined by commas, one for each time it is taken.
    Null, empty and white-space texts have size 0 and taken 0; a null source is a source of its own, ordered last. Repeated rows are counted as often as they occur.
    An empty table gives no rows. Other columns are not used.
    """
    return _dealt_rows(docs, share, cap, weights, seed, words_per_shard, id_col, text_col, source_col).drop("_key")


def shard_counts(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, words_per_shard: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, shard, documents, words``: the times that documents of a source are taken in an output shard, and their words. Repeated rows and null ids count as in ``mix_report``; shards that take nothing of a source have no row."""
    rows = _dealt_rows(docs, share, cap, weights, seed, words_per_shard, id_col, text_col, source_col).filter("shards <> ''")
    source = F.when(F.col("_key") != "n", F.substring("_key", 2, (1 << 31) - 1)).alias("source")
    each = rows.select(source, "size", F.explode(F.split("shards", ",").cast("array<int>")).alias("shard"))
    return each.groupBy("source", "shard").agg(F.count("*").alias("documents"), F.sum("size").alias("words"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, words_per_shard: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: the rows of ``docs``, as often as they are taken, with their columns and no others, laid out shard by shard, each shard in pseudo-random order. Rows without words are never taken."""
    shown = docs.columns
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in shown)).alias("_row"), *_keyed(docs, id_col, source_col), word_count(F.col(text_col)).alias("size"))
    blocks, placed = _plan(d.select("_key", "_block", "size"), share, cap, weights, seed, words_per_shard)
    cuts = blocks.groupBy("_key", "_block").agg(F.max("cut").alias("cut"))
    runs = placed.groupBy("_key", "_block").agg(F.collect_list(F.struct("pass", "shard", F.col("cut").isNotNull().alias("part"))).alias("runs"))  # at most three entries
    rows = _with_chosen(d, cuts.join(runs, ["_key", "_block"])).filter("size > 0")
    rows = rows.select("_row", "chosen", "_order", F.explode("runs").alias("r")).filter("not r.part or chosen")
    mixed = F.xxhash64(F.lit(seed), "_order", "r.pass")
    return rows.repartition(F.col("r.shard")).sortWithinPartitions(F.col("r.shard"), mixed, "_order").select("_row.*")
