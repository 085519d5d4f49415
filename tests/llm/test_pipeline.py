"""The pipeline's stages on a small folder, each against a plain version of what it keeps."""

import random

import pytest

import corpus_pipeline
from tests.llm import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() if rng.random() < 0.7 else "the" for _ in range(n))
    item = say(40)
    texts = [say(rng.randint(60, 200)) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", None, "", "too short", say(80) + "\n" + "A repeated line.", say(80) + "\na repeated LINE.", say(60) + " " + item]
    texts.append(" ".join(w + "%%%" for w in say(100).split()))
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = dict(enumerate(texts))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k == 4:
            assert {r["doc_id"] for r in out.collect()} == set(left)
            break
        assert out.columns == columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            assert set(got) == set(left) - {32, 33, 34, 38}
        if name == "line_dedup":
            assert {i: brute.sha(t) for i, t in got.items()} == {i: v[2] for i, v in brute.line_dedup(sorted(left.items())).items()}
        if name == "ngram_jaccard_join":
            assert set(got) == {i for i, (_, c) in brute.jaccard_components(left.items()).items() if c == i}
        if name == "benchmark_decontamination":
            assert set(got) == set(left) - {37}
        left, docs = got, spark.createDataFrame(out.collect(), docs.schema)


def test_run(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder[0]).collect()} >= {2, 5}


def test_stages_take_empty_tables_null_keys_and_repeated_rows(spark, folder):
    path, texts = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_id string, part string, kept string, n_words string, n_lines string, __words string, __root string"
    own = ("k", "w", "l", "o", "r")
    rows = [(None, texts[3], None, None, None, "x", "y")] * 2 + [(7, texts[4], "en", "s", 1, None, None)] * 2 + [(8, texts[4], "en", "s", 1, None, None), (9, None, None, None, None, None, None), (7, texts[37], "en", "s", 1, None, None)]
    want = {"quality_rules": 6, "line_dedup": 7, "ngram_jaccard_join": 6, "benchmark_decontamination": 6, "packing": None}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, spark.createDataFrame([], schema), path)
        assert none.count() == 0
        out = stage(spark, spark.createDataFrame([(*r, *own) for r in rows], schema).repartition(2), path)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {None, 7, 8, 9}
        else:
            assert out.columns == none.columns == [f.split()[0] for f in schema.split(", ")] and out.count() == want[name]
            assert {tuple(r)[-5:] for r in out.collect()} == {own}
