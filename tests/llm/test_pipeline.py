"""Each stage's decisions against plain versions on the small tables."""

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pixelspark.llm import decontaminate as dc
from pixelspark.llm.common import materialize
from tests.llm.test_minhash import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        tables.append(docs.toPandas())
    good, unique, clean, mixed, coded = tables
    assert all(list(t.columns) == columns for t in tables[:-1])
    labels = duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").df().set_index("doc_id")["quality"]
    kept = labels.index.isin(good["doc_id"])
    assert kept[labels == 1].mean() > 0.97 and kept[labels == 0].mean() < 0.3
    assert set(unique["doc_id"]) == {d for d, _, c in brute(list(zip(good["doc_id"], good["text"], strict=True)), 5, 80) if c == d}
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    leaks = {t for t, *_ in dc.Index(items, 0.1).matches([dc.normalised(x) for x in unique["text"]])}
    assert set(clean["doc_id"]) == set(unique["doc_id"].drop(unique.index[list(leaks)]))
    assert not any(dc.normalised(t) in dc.normalised(x) for x in clean["text"] for _, t in items)
    times = mixed["doc_id"].value_counts()
    assert times.max() <= 2 and set(times.index) <= set(clean["doc_id"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(zip(mixed["doc_id"], mixed["text"], strict=True))
    coded = coded.sort_values("start")
    assert len(coded) == len(mixed) and coded["doc_id"].is_monotonic_increasing
    assert np.array_equal(coded["start"], np.cumsum(coded["n_tokens"]) - coded["n_tokens"])
    assert all(len(tokenizer.encode(text[d], add_special_tokens=False).ids) + 1 == n for d, n in zip(coded["doc_id"], coded["n_tokens"], strict=True))


def _run(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 3 != 0 and 1 or 0, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "the seventh question asks which of these rivers is the longest one in the northern half")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_null_and_long_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(i, " ".join(f"word{i * 31 % 97}x{j}" for j in range(30)) if i % 3 else "zz " * 12, "en", "web" if i % 2 else None, 7, 1, "k") for i in range(60)]
    rows += [(100, None, "en", "web", 0, 0, ""), (101, "", None, None, 0, 0, ""), (1, rows[1][1], "en", "web", 7, 1, "k"), (102, rows[4][1] + " end", "en", "web", 7, 1, "k"), (103, "a long text of words " * 40_000, "en", "web", 7, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, size int, _key string")
    got = _run(spark, tmp_path / "a", docs)
    ids = [r.doc_id for r in got]
    assert ids and set(ids) <= {r[0] for r in rows} and 102 not in ids and 100 not in ids and 101 not in ids
    assert _run(spark, tmp_path / "b", docs.limit(0)) == []
