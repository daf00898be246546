"""Components of near duplicates against brute force over all pairs."""

import random

from pixelspark.llm import minhash
from pixelspark.llm.common import words
from pixelspark.llm.linking import connected_components


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    rows = []
    for size in (3, 5, 8, 20, 60, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(r.choice([1, 3, 12])):
                copy = list(base)
                for _ in range(r.randint(0, max(1, size // 12))):
                    copy[r.randrange(size)] = word()
                rows.append(" ".join(copy))
    rows += ["one", "One", "one two", "", None, " \t\n", "the same text", "THE same\ttext"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id long, text string, kept boolean, sig string").repartition(5)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k, 80).collect())
        want = sorted((d, n, c, c == d) for d, n, c in brute(rows, k, 80))
        assert got == want
        if k == 5:
            kept = {r.doc_id for r in minhash.keep_first(df, k, 80).collect()}
            assert kept == {d for d, _, c in brute(rows, k, 80) if c == d}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "lonely words here"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df, 2).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("None", 2, "1", False), ("None", 2, "None", True), ("2", 0, "2", True)])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 2), (5, 1), (None, 3), (9, 8), (8, 9)]
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1, 5: 1, 8: 8, 9: 8}


def test_settling_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MARGIN", -100.0)  # no estimate reaches what that asks for, so comparisons with centres link nothing
    rows = corpus(3)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect())
    assert got == sorted((d, c) for d, _, c in brute(rows, 2, 80))


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 5, "x"), (2, "a b c d e f g", 6, "y"), (3, None, 7, "z")], "doc_id long, text string, gone long, GONE_ string")
    assert sorted((r.doc_id, r.gone) for r in minhash.keep_first(df).collect()) == [(1, 5), (3, 7)]


def test_pairs_of_a_near_copy_group_stay_few(spark, monkeypatch):
    """Near copies of one text, most of them beyond the threshold of each other: what is compared must not grow with the square of the group."""
    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(100)]
    rows = []
    for _ in range(800):
        copy = list(base)
        for i in r.sample(range(100), r.randint(2, 9)):
            copy[i] = f"w{r.randrange(3000)}"
        rows.append(" ".join(copy))
    counts, kept = [], minhash.materialize

    def counting(df, name):
        out = kept(df, name)
        if name in ("likely", "rare-pairs"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counting)
    made = []
    for n in (400, 800):
        counts.clear()
        got = sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows[:n])), "doc_id long, text string")).collect())
        made.append(sum(counts))
        if n == 400:
            assert got == sorted((d, c) for d, _, c in brute(list(enumerate(rows[:n])), 5, 80))
    assert made[1] <= 3 * made[0] + 100 and made[1] < 800 * 10
