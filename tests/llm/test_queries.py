"""The registered queries themselves, on a folder with nulls, copies and repeated rows, and their SQL on it and on the smallest tables."""

import os
import random

import duckdb
import pytest

from tarnspark.llm import queries
from tests.llm import brute

pytest.importorskip("public_tokenizers")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["the", "of", "sea", "Hill", "water", "rock", "über", "so,"]) + str(rng.randrange(90)) for _ in range(n))
    texts = [None, "", " \n", *(say(rng.randrange(300)) for _ in range(40))]
    texts += [texts[10], texts[11] + " more", say(20) + "\n" + texts[12] + "\n" + "A line that repeats.", "a LINE that repeats.\n" + say(60), say(9000)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, texts[13]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_source_divergence"}))  # whose rows are sources, not documents
def test_each_query_returns_every_document(spark, folder, name):
    out = queries.QUERIES[name](spark, folder[0]).collect()
    ids = {r["doc_id"] for r in out}
    assert ids == {13} if name.startswith("op1_") else ids == set(range(len(folder[1])))


def test_jaccard_and_substring_queries_equal_brute_force(spark, folder):
    docs = list(enumerate(folder[1]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_jaccard_join(spark, folder[0]).collect()}
    assert got == brute.jaccard_components(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op8_substring_dedup(spark, folder[0]).collect()}
    assert got == brute.substring_dedup(docs)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, folder, name):
    for path, files in ((folder[0], "/*.parquet"), *(((FOLDER, ""),) if os.path.exists(FOLDER) else ())):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{files}'")
        found = con.execute(queries.ORACLES[name])
        names = [c[0] for c in found.description]
        want = sorted(found.fetchall())
        assert sorted(tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, path).collect()) == want
