"""Targets against the plain rounds of resharing; exact quotas, disjoint blocks and repeatable draws; a hypergeometric draw's distribution."""

from collections import Counter, defaultdict
from math import comb

from pyspark.sql import functions as F

from pixelspark.llm import mixing


def plain_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    keys = sorted(sizes, key=lambda k: (k == "n", k))
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, out, free = share * sum(sizes.values()), {}, set(keys)
    while free:
        left = total - sum(out.values())
        over = {k for k in free if left * w[k] / sum(w[j] for j in free) > cap * sizes[k]}
        if not over:
            out |= {k: left * w[k] / sum(w[j] for j in free) for k in free}
            break
        out |= {k: cap * sizes[k] for k in over}
        free -= over
    return out


def test_targets(spark):
    for sizes in ({"sa": 100, "sb": 900, "sc": 10, "n": 50}, {"sa": 5}, {"sa": 0, "sb": 7}, {"sa": 1, "sb": 1000, "sc": 1, "sd": 400, "se": 30}):
        got = {r._1: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_key string, source_size long")).withColumnRenamed("_key", "_1").collect()}
        want = plain_targets(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


def test_hypergeometric_draws(spark):
    n = 4000
    d = spark.range(n).select(mixing.hypergeometric(F.lit(6).cast("long"), F.lit(15).cast("long"), F.lit(7).cast("long"), mixing._uniform("t", F.col("id"))).alias("k"))
    seen = Counter(r.k for r in d.collect())
    for k in range(7):
        p = comb(6, k) * comb(9, 7 - k) / comb(15, 7) if 7 - k <= 9 else 0
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    edge = spark.range(1).select(*(mixing.hypergeometric(*(F.lit(x).cast("long") for x in a), F.lit(0.5)).alias(f"c{i}") for i, a in enumerate(((0, 5, 3), (5, 5, 3), (3, 5, 5), (2, 2, 0), (0, 0, 0), (100_000, 250_000, 125_000))))).first()
    assert list(edge)[:5] == [0, 3, 3, 0, 0] and abs(edge[5] - 50_000) < 500


def test_quotas_are_kept_exactly(spark):
    q = {"sa": 13, "sb": 1, "sc": 40, "n": 7}
    rows = mixing.split_quotas(spark.createDataFrame(list(q.items()), "_key string, q long"), 3).collect()
    total, shards = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r[1]] += r.q
        shards[r.shard] += r.q
    assert dict(total) == q and set(shards.values()) == {7, 8} and len(shards) == 8


def test_mix_and_report_agree(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["w"] * (i * 37 % 23))) for i in range(300)] + [(300, "s1", None), (301, "s1", " \t"), (None, "s2", "a b"), (5, "s2", "twin row"), (5, "s2", "twin row")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, target int")
    report = mixing.mix_report(df, words_per_shard=500).collect()
    assert len(report) == len(rows)
    taken, target = defaultdict(int), {}
    for r, (source, size) in ((r, next((s, len((t or "").split())) for i, s, t in rows if i == r.doc_id and len((t or "").split()) == r.size)) for r in report):
        assert r["size"] == size and 0 <= r.taken <= 2 * size
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 23 for s in target)
    again = mixing.mix_report(df.repartition(7), words_per_shard=500).collect()
    assert sorted(map(str, report)) == sorted(map(str, again))
    mixed = mixing.mix(df, words_per_shard=500)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in report:
        want[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_the_tree_splits_small_tables_into_disjoint_blocks(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "w " * (1 + i * 37 % 23)) for i in range(600)], "doc_id long, source string, text string")
    d = df.select(*mixing._keyed(df, "doc_id", "source"), mixing.word_count("text").alias("size"))
    blocks, placed = mixing._plan(d, 1.5, 2.0, mixing.WEIGHTS, 0, mixing.SHARD_WORDS)
    units = placed.collect()
    assert len({u.shard for u in units}) > 32 and all(0 <= u.shard < mixing.LEAST_SHARDS for u in units)
    assert len({(u["_key"], u["_block"], u["pass"]) for u in units}) == len(units)  # no unit is in two shards
    for b in blocks.collect():
        assert sum((u["_key"], u["_block"]) == (b["_key"], b["_block"]) for u in units) == b.passes + b.extra
    per = Counter(u.shard for u in units)
    assert max(per.values()) - min(per.get(k, 0) for k in range(mixing.LEAST_SHARDS)) <= 1


def test_long_texts_and_no_words(spark):
    df = spark.createDataFrame([(1, "a", "w " * 300_000), (2, "a", "w"), (3, "b", None)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    assert got[1]["size"] == 300_000 and got[3].taken == 0 and got[3].target == 0 and sum(r.taken for r in got.values()) <= 2 * 300_001


def test_shards_of_a_document_are_those_the_tree_dealt_its_blocks_to(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i * 37 % 23)) for i in range(600)], "doc_id long, source string, text string")
    keyed = df.select("doc_id", *mixing._keyed(df, "doc_id", "source"), mixing.word_count("text").alias("size"))
    _, placed = mixing._plan(keyed.drop("doc_id"), 1.5, 2.0, mixing.WEIGHTS, 0, mixing.SHARD_WORDS)
    units = defaultdict(list)
    for u in placed.collect():
        units[u["_key"], u["_block"]].append((u.shard, u.cut is not None))
    of = {r.doc_id: (r["_key"], r["_block"]) for r in keyed.collect()}
    copies = Counter()
    for r in mixing.mix_report(df).collect():
        shards = [int(x) for x in r.shards.split(",") if x]
        assert len(shards) * r["size"] == r.taken and shards == sorted(shards)
        whole = sorted(s for s, part in units[of[r.doc_id]] if not part)
        part = [s for s, part in units[of[r.doc_id]] if part]
        assert shards == ([] if not r["size"] else whole if len(shards) == len(whole) else sorted(whole + part))
        copies.update(shards)
    assert len(copies) > 32
    mixed = mixing.mix(df).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in mixed) == sum(copies.values())


def test_counts_of_shards_are_those_of_the_report(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i * 37 % 23)) for i in range(300)] + [(None, "s2", "a b"), (5, "s2", "twin row"), (5, "s2", "twin row"), (6, "n", "word")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sources, want = {}, Counter()
    for i, s, t in rows:
        sources.setdefault((i, len(t.split())), s)
    for r in mixing.mix_report(df).collect():
        for x in filter(None, r.shards.split(",")):
            want[sources[r.doc_id, r["size"]], int(x), "documents"] += 1
            want[sources[r.doc_id, r["size"]], int(x), "words"] += r["size"]
    got = mixing.shard_counts(df)
    assert got.dtypes == [("source", "string"), ("shard", "int"), ("documents", "bigint"), ("words", "bigint")]
    assert {(r.source, r.shard, k): r[k] for r in got.collect() for k in ("documents", "words")} == want
    assert mixing.shard_counts(df.limit(0)).count() == 0


def test_the_registered_query_of_shards_runs(spark, tmp_path):
    from pixelspark.llm.queries import QUERIES

    spark.createDataFrame([(i, "a", "two words") for i in range(100)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["mixing_shards"](spark, str(tmp_path)).collect()
    assert sum(r.words for r in got) == 2 * sum(r.documents for r in got) == 300
