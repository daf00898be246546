"""Leaks against a plain edit-distance search over every text and item."""

import random

from pixelspark.llm import decontaminate as dc


def plain(item, text, k):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) if min(row) <= k else None


def _case(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.choice([1, 4, 15, 30]))) for i in range(6)] + [(6, None), (7, "?!")]
    docs = []
    for d in range(30):
        t = text(r.randint(0, 40))
        if d % 2:
            x = list(r.choice(items[:6])[1])
            for _ in range(r.randint(0, max(1, len(x) // 8))):
                p = r.randrange(len(x)) if x else 0
                x[p : p + 1] = r.choice([[], [r.choice("abcde")], ["a", "b"]])
            t = t + " " + "".join(x).upper() + ", " + text(r.randint(0, 20))
        docs.append((d, t))
    return docs, items


def test_all_leaks_are_found_and_no_other(spark):
    for seed in range(12):
        docs, items = _case(seed)
        index = dc.Index(items, 0.1)
        texts = [dc.normalised(t) for _, t in docs]
        got = {(t, index.ids[j]): d for t, j, d, *_ in index.matches(texts)}
        want = {}
        for t, text in enumerate(texts):
            for j, item in enumerate(index.items):
                d = plain(item, text, int(index.k[j]))
                if d is not None:
                    want[t, index.ids[j]] = d
        assert got == want
    d = spark.createDataFrame([*docs, (None, items[2][1]), (90, None), (91, "")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows if r.doc_id is not None} == want and any(r.doc_id is None and r.item_id == 2 for r in rows)
    kept = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert kept == {x for x in [*range(30), 90, 91]} - {t for t, _ in want}
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 500)
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    index = dc.Index([(1, item)], 0.1)
    for at in range(380, 560, 7):
        text = "z" * at + " " + item.replace("lazy", "lzay") + " " + "y" * 900
        assert [(t, d) for t, _, d, *_ in index.matches([text])] == [(0, 2)]


def test_short_items_have_their_whole_budget_of_edits_in_characters():
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzéß中"
    for m in [*range(1, 45), 81]:
        for _ in range(6):
            item = "".join(r.choice(letters) for _ in range(m))
            x = list(item)
            for p in r.sample(range(m), m // 10):
                x[p] = r.choice(["", "Q", "é", x[p] + "ü"])
            text = "some words " + "".join(x) + " more words"
            assert [t for t, *_ in dc.Index([(1, item)], 0.1).matches([dc.normalised(text), dc.normalised("0123456789 " * 9)])] == [0], (m, item, text)
    assert [d for _, _, d, *_ in dc.Index([(1, "the capital of france is paris")], 0.1).matches([dc.normalised("so: the kapital of frence is pariz!")])] == [3]


def test_column_names_that_clash_and_long_texts(spark):
    item = "which of these rivers flows through the largest number of countries"
    d = spark.createDataFrame([(1, "x " * 400_000 + item, 5, "a"), (2, "x", 6, "b"), (2, None, None, None)], "doc_id long, text string, item_id long, distance string")
    b = spark.createDataFrame([(7, item, 1), (7, item, 1)], "item_id long, text string, doc_id long")
    assert [(r.doc_id, r.item_id, r.distance) for r in dc.find_leaks(d, b).collect()] == [(1, 7, 0), (1, 7, 0)]
    assert sorted(map(str, dc.decontaminate(d, b).collect())) == sorted(map(str, d.filter("doc_id = 2").collect()))
