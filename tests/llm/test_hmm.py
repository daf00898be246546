"""Likelihoods and expected counts against sums over all state paths; base scores against plain counting; a better score than the base on held-out texts."""

import itertools
import zlib
from collections import Counter
from math import log10

import numpy as np
from pyspark.sql import functions as F

from pixelspark.llm import hmm


def test_forward_and_expected_counts_equal_sums_over_paths():
    r = np.random.default_rng(1)
    model = hmm.Hmm(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    sequences = [r.integers(0, 5, n) for n in (4, 1, 6, 4, 2)]
    p = hmm.Packed(sequences)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, got in zip(sequences, model.forward(p)[2], strict=True):
        total = 0.0
        a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for path in itertools.product(range(3), repeat=len(s)):
            w = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                w *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += w
            a[path[0]] += w
            for t in range(len(s)):
                c[s[t], path[t]] += w
                if t:
                    b[path[t - 1], path[t]] += w
        assert abs(got - log10(total)) < 1e-5
        starts, moves, emits = starts + a / total, moves + b / total, emits + c / total
    for x, y in zip(model.expected(p, 5), (starts, moves, emits), strict=True):
        assert np.allclose(x, y, atol=1e-4)


def test_scores(spark):
    r = np.random.default_rng(2)
    langs = [[f"{x}{i}" for i in range(60)] for x in ("aa", "bb")]
    rows = [(i, " ".join(r.choice(langs[i % 2], 30)) + (" Rare%d" % i)) for i in range(150)] + [(150, None), (151, " \t"), (151, " \t"), (None, "AA1 x")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = hmm.language_model_scores(df, known=50).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in [*hmm.words(t), b""])
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [[*hmm.words(t), b""]])
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) and all(x.score < 0 for x in got)
    assert hmm.language_model_scores(df.limit(0)).count() == 0


def test_every_training_word_has_its_own_emissions(spark):
    r = np.random.default_rng(5)
    # the two languages share the endings of their words, so only the words themselves tell them apart
    rows = [(i, " ".join(f"{'pq'[i % 2]}{j}zz" for j in r.integers(0, 150, 25))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few, all_known = ({x.doc_id: x for x in hmm.language_model_scores(df, known=n).collect()} for n in (20, 1000))
    assert all(abs(few[i].score - all_known[i].score) < 1e-3 for i, _ in rows)
    held = [x for x in few.values() if x.held_out]
    assert sum(x.score - x.base_score for x in held) > 0.1 * sum(x.n_tokens for x in held)


def test_the_end_counts_though_other_words_are_more_frequent(spark):
    rows = [(i, "a b c d a b c d a b c d e") for i in range(40)] + [(40, "z " * 50_000), (41, "a"), (41, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: x for x in hmm.language_model_scores(df, known=2, rounds=1).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in [*hmm.words(t), b""])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        w = [*hmm.words(t), b""]
        assert got[i].n_known == sum(count[x] > 0 for x in w) and abs(got[i].base_score - sum(log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert np.isfinite(got[i].score)


def test_a_rare_word_has_one_row_for_each_block_that_holds_it(spark, monkeypatch):
    monkeypatch.setattr(hmm, "TOGETHER", 400)
    rows = [(i, " ".join(["many", "words"] * 10 + [f"rare{i // 3}"] * 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", hmm.held_out_rows(F.col("doc_id"))).coalesce(1).cache()
    counts = hmm.token_counts(df.filter("not held_out"))
    vocabulary = hmm.Vocabulary([(b"many", 1), (b"words", 1), (b"", 1)])
    coded = hmm.code_texts(df, vocabulary).cache()
    held = [r for r in coded.filter("symbols is not null").collect()]
    assert len(held) == 120 and all(r.held_out == r.block % 2 for r in held) and len({r.block for r in held}) > 2
    listed = {(r.block, w) for r in coded.filter("rare is not null").collect() for w in map(bytes, r.rare)}
    word = {(r.block, f"rare{r.doc_id // 3}".encode()) for r in held}
    places = hmm.rare_places(coded, counts).collect()
    assert listed == word and len(places) == len({(r.block, r.slot) for r in places}) == len(word) < 120
    for r in held:
        assert sorted(Counter(hmm._symbols(r.symbols, r.n_tokens).tolist()).values()) == [1, 4, 10, 10]
    whole = {x.doc_id: x.score for x in hmm.language_model_scores(df.select("doc_id", "text"), known=1000).collect()}
    small = {x.doc_id: x.score for x in hmm.language_model_scores(df.select("doc_id", "text"), known=2).collect()}
    assert all(abs(whole[i] - small[i]) < 1e-3 for i, _ in rows)


def test_rare_words_travel_in_one_row_for_each_block_and_bucket(spark, monkeypatch):
    rows = [(i, " ".join([*(f"rare{i}x{j}" for j in range(40)), *(f"both{j}" for j in range(i % 7, 40, 7))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    written, write = {}, hmm.materialize
    monkeypatch.setattr(hmm, "materialize", lambda table, name, *rest: written.setdefault(name, []).append(write(table, name, *rest)) or written[name][-1])
    monkeypatch.setattr(hmm, "discard", lambda *tables: None)
    got = {x.doc_id: x.score for x in hmm.language_model_scores(df, known=20).collect()}
    blocks = written["coded"][0].select("block").distinct().count()
    buckets, shelves = 2 * spark.sparkContext.defaultParallelism, 1
    for table in [*written["block-counts"], *written["expected-counts"]]:
        assert 0 < table.count() <= blocks * buckets + shelves * spark.sparkContext.defaultParallelism
    # each rare word once a block, with one sum wherever it is
    tiles = written["rare-tiles"][0].collect()
    held = sum(len(np.frombuffer(t.slots, "<i4")) for t in tiles)
    assert held == sum(len(r.rare) for r in written["coded"][0].filter("rare is not null").collect()) > 60 * 40
    bucket_of: dict = {}
    for t in tiles:
        for i in np.frombuffer(t.ids, "<i8").tolist():
            assert i < 0 or bucket_of.setdefault(i, t.bucket) == t.bucket
    monkeypatch.undo()
    whole = {x.doc_id: x.score for x in hmm.language_model_scores(df, known=10_000).collect()}
    assert all(abs(got[i] - whole[i]) < 1e-3 for i, _ in rows)
