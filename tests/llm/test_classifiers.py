"""Held-out accuracy of the two classifiers, and their odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from pixelspark.llm import langid, quality


def test_quality(spark):
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 9)))
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        docs.append((i, " ".join(word() for _ in range(60)) if good else " ".join([word().upper() + "!!"] * 40)))
        labels.append((i, int(good)))
    extra = [(400, None), (401, ""), (None, "some words here"), (5, docs[5][1])]
    d = spark.createDataFrame([(*x, 0.5) for x in docs + extra], "doc_id long, text string, score double")
    y = spark.createDataFrame([*labels, (None, 1), (7000, 1), (6, None)], "doc_id long, quality int")
    got = quality.quality_scores(d, y).collect()
    assert len(got) == 404 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    kept = [x.doc_id for x in quality.keep_good(d, y).collect()]
    assert sorted(map(str, kept)) == sorted(str(x.doc_id) for x in got if x.predicted)
    assert quality.quality_scores(d.limit(0), y).count() == 0
    assert {x.score for x in quality.quality_scores(d, y.limit(0)).collect()} == {0.5}


def test_languages(spark):
    r = np.random.default_rng(2)
    parts = {"aa": ["tra", "lo", "mi"], "bb": ["sch", "un", "keit"], "cc": ["é", "eau", "tion"]}
    rows = [(i, " ".join("".join(r.choice(parts[k], 3)) for _ in range(30)), k) for i, k in ((i, list(parts)[i % 3]) for i in range(600))]
    rows += [(600, None, "aa"), (601, "12 34 !", "aa"), (602, "", "bb"), (None, "trlomi", None)]
    d = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double")
    got = {x.doc_id: x for x in langid.languages(d).collect()}
    assert len(got) == 604 and all(got[i].lang_pred == "und" for i in (600, 601, 602)) and all(0 <= x.score <= 1 for x in got.values())
    held = [(got[i].lang_pred, k) for i, _, k in rows[:600] if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert langid.languages(d.limit(0)).count() == 0
    assert {x.lang_pred for x in langid.languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_are_those_of_unicode():
    assert [langid.has_letter(t) for t in ("²½", "12 _-", "\u0e32", "\u093e", "\u00e9", "\u4e2d", "\u02b0", "Ⅷ")] == [False, False, True, False, True, True, True, False]
    net = langid.ByteConv(["aa", "bb"])
    assert net.predict(["²½", "٣٤", None, ""]) == [("und", 0.0)] * 4 and net.predict(["é"])[0][0] in ("aa", "bb")


def test_convolution_and_pooling_equal_nested_loops():
    net = langid.ByteConv(["aa", "bb", "cc"], seed=3)
    r = np.random.default_rng(4)
    x = r.integers(0, 256, (3, langid.WIDTH)).astype(np.uint8)
    net.p["shift"] = r.normal(0, 0.3, len(net.p["shift"])).astype(np.float32)
    got = net.logits(x, part=2)
    for n, window in enumerate(x):
        hidden, f = [], 0
        for width, filters in langid.FILTERS.items():
            for _ in range(filters):
                kernel = net.p["conv"][:, f].reshape(-1, langid.EMBED)
                places = [sum(float(net.p["embed"][window[at + i]] @ kernel[i]) for i in range(width)) for at in range(langid.WIDTH - max(langid.FILTERS) + 1)]
                hidden.append(max(0.0, max(places) + float(net.p["shift"][f])))
                f += 1
        want = [sum(h * float(w) for h, w in zip(hidden, net.p["out"][:, k], strict=True)) + float(net.p["bias"][k]) for k in range(3)]
        assert np.allclose(got[n], want, atol=1e-4)


def test_gradients_equal_differences():
    net = langid.ByteConv(["aa", "bb"], seed=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(6)
    x, y, weight = r.integers(0, 256, (6, langid.WIDTH)).astype(np.uint8), np.array([0, 1, 1, 0, 1, 1]), np.array([1.5, 0.75])

    def loss():
        z = net.logits(x)
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(weight[y] * z[np.arange(6), y]).mean())

    for name, g in net.gradients(x, y, weight).items():
        flat = net.p[name].reshape(-1)
        for i in r.permutation(np.flatnonzero(g.reshape(-1)))[:12]:
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 1e-5, name


def test_trees_equal_a_plain_walk():
    r = np.random.default_rng(7)
    x = r.normal(size=(500, 5))
    trees = quality.Trees(x, ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float))
    got = trees.predict(x)
    for i in range(0, 500, 7):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if x[i, trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(8)
    for _ in range(5):
        x = np.round(r.normal(size=(60, 3)), 1)
        y = (x[:, 1] + r.normal(0, 0.5, 60) > 0).astype(float)
        trees = quality.Trees(x, y)
        p = 1 / (1 + np.exp(-trees.start))
        g, h = p - y, np.full(60, p * (1 - p))

        def gain(low):
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)  # noqa: E731, B023
            return part(low) + part(~low) - part(np.ones(60, bool))

        # every cut between neighbouring quantile edges, which are what histograms know
        cuts = [x[:, j] <= e for j in range(3) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]))]
        best = max(gain(c) for c in cuts if min(c.sum(), (~c).sum()) >= quality.LEAST)
        root = trees.roots[0]
        assert abs(gain(x[:, trees.feature[root]] <= trees.threshold[root]) - best) < 1e-9


def test_long_texts_ties_and_repeated_rows(spark):
    long = "palabra larga " * 60_000
    rows = [(i, ("uno dos tres " if i % 2 else "one two three ") * 5, "es" if i % 2 else "en") for i in range(200)] + [(300, long, "es"), (300, long, "es"), (301, "x" * 900_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.languages(d).collect()
    again = langid.languages(d.repartition(2)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again)) and len({str(x) for x in got if x.doc_id == 300}) == 1
    y = spark.createDataFrame([(i, int(i % 2)) for i in range(200)] + [(3, 0), (3, 0)], "doc_id long, quality int")
    scores = quality.quality_scores(d.drop("lang"), y).collect()
    assert len(scores) == len(rows) and all(np.isfinite(x.score) for x in scores)


def test_a_text_scores_the_same_whatever_is_predicted_with_it():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcdefgh éß"), int(n))) + "a" for n in r.integers(1, 3000, 120)]
    net = langid.ByteConv(["de", "en", "fr"])
    assert net.predict(texts) == [net.predict([t])[0] for t in texts] == net.predict(texts[::-1])[::-1]
