"""Personal data, source divergence and periodic runs against plain versions, on odd rows as well."""

import math
import random

import numpy as np
import pytest

from tarnspark.llm import divergence, periodic_runs, personal_data, queries
from tarnspark.llm.divergence import QuadTree, source_divergence, walk
from tarnspark.llm.kernels import mix
from tarnspark.llm.periodic_runs import collapse_runs, least_depth, runs_of_texts
from tarnspark.llm.personal_data import find_personal_data
from tests.llm import brute

CLASHING = "doc_id long, text string, spans string, runs string, n_words string, spans_base string, scores string, body string, row string, lang string, source string, term string, slot string, kept string, n string"


def clashing(spark, rows):
    """Rows of (doc_id, text, lang, source) among columns that operators use names like."""
    return spark.createDataFrame([(i, t, *"abcdefg", lang, source, *"hijk") for i, t, lang, source in rows], CLASHING).repartition(3)


# Periodic runs


def test_runs_of_words_equal_brute_force():
    rng, met = random.Random(1), 0
    for _ in range(400):
        least, exponent = rng.choice([(24, 3), (6, 2), (10, 3), (1, 2), (24, 2)])
        texts = []
        for _ in range(rng.randint(1, 5)):
            kinds, x = rng.choice([1, 2, 3, 6]), []
            for _ in range(rng.randint(0, 6)):
                x += [rng.randrange(kinds) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7) + [rng.randrange(kinds) for _ in range(rng.randint(0, 4))]
            texts.append(x)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        items = mix(np.array([w + 77 for x in texts for w in x], dtype=np.uint64))
        want = {k: r for k, x in enumerate(texts) if (r := brute.periodic_runs(x, least, exponent))}
        assert runs_of_texts(items, bounds, least, exponent) == want
        met += len(want)
    assert met > 300


def test_least_depth():
    assert (least_depth(24, 3), least_depth(1, 2), least_depth(6, 2)) == (7, 1, 2)


def run_texts():
    rng = random.Random(7)
    say = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(n)]
    texts = [None, "", " \n\t", "x", "x " * 24, "x " * 23, "  a\tb\x0bc\n" * 8 + "a b", "a b c " * 8 + "a c"]
    for _ in range(30):
        texts.append(" ".join(say(rng.randrange(40)) + say(rng.randint(1, 30)) * rng.randint(1, 6) + say(rng.randrange(9)) + ["z"] * rng.choice([0, 25])))
    texts += [" ".join(say(900) * 11), " ".join(say(9000)), texts[9], texts[9], "Ähre über " * 13]
    return texts


def test_collapse_runs(spark):
    texts = run_texts()
    rows = [*((i, t, "en", "s") for i, t in enumerate(texts)), (None, texts[4], None, None), (3, texts[4], "x", "y")]
    out = collapse_runs(clashing(spark, rows))
    assert out.columns == [c for c in (f.split()[0] for f in CLASHING.split(", ")) if c not in ("runs", "n_words")] + ["n_words", "runs"]
    want = []
    for i, t, *_ in rows:
        x = brute.words(t)
        runs = brute.periodic_runs(x) if len(x) < 5000 else ([(0, 9900, 900)] if len(set(x[:900])) and x[:900] == x[900:1800] else [])
        want.append((str(i), brute.collapsed(x, runs), len(x), runs, "a"))
    got = [(str(r["doc_id"]), r["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["spans"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(bool(w[3]) for w in want) > 15
    assert collapse_runs(clashing(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        collapse_runs(out, exponent=1)


def test_op13_equals_brute_force(spark, tmp_path):
    texts = run_texts()[:40] + ["word " + " ".join(f"w{k}" for k in range(n)) for n in range(0, 200, 2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        x = brute.with_period(r["doc_id"], brute.words(texts[r["doc_id"]]))
        runs = brute.periodic_runs(x)
        top = min(runs, key=lambda q: (-q[1] / q[2], q[0], q[2])) if runs else (None, None, None)
        milli = top[1] * 1000 // top[2] if runs else None
        lines = brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert tuple(r)[1:] == (len(runs), *top, milli, lines, brute.sha(brute.collapsed(x, runs)))
        planted += bool(runs) and r["doc_id"] >= 40
    assert planted > 4


# Source divergence


def divergence_rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeñÉ") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for k in range(260):
        lang, source = rng.choice(["de", "en"]), f"s{min(rng.randrange(20), rng.randrange(20))}"
        rows.append((" ".join(rng.choice(vocabulary[: 20 + len(source) * 30]).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randrange(30))) + ".", lang, source))
    rows += [(None, "en", "s1"), ("", "de", "only"), ("1 2 3 -- \x00 \x7f", "en", "digits"), ("abc", None, None), ("abc", "", "x"), ("lonely", "xx", "one")]
    return rows + [rows[5]] * 12


@pytest.mark.parametrize("sources, terms", [(64, 512), (3, 8)])
def test_source_divergence(spark, monkeypatch, sources, terms):
    monkeypatch.setattr(divergence, "TILE_SOURCES", sources)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    rows = divergence_rows()
    docs = clashing(spark, [(k, *r) for k, r in enumerate(rows)])
    got = sorted(tuple(r) for r in source_divergence(docs).collect())
    want = brute.divergence(rows)
    assert got == want and sum(r[2] == "pair" for r in want) > 300 and sum(r[2] == "term" for r in want) > 100
    assert source_divergence(docs.where("false")).count() == 0


def test_source_divergence_takes_other_names_and_bounds(spark):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "body string, tongue string, site string, text string")
    got = sorted(tuple(r) for r in source_divergence(df, min_docs=3, top=4, text="body", lang="tongue", source="site").collect())
    assert got == brute.divergence(rows, 3, 4)


def test_walk_of_quadtrees_equals_dense_matrices():
    rng = np.random.default_rng(2)
    for _ in range(60):
        rows, columns, share = rng.integers(1, 9, 2), int(rng.integers(1, 40)), rng.choice([0.02, 0.3, 0.9])
        height = int(max(*rows, columns) - 1).bit_length()
        dense = [np.where(rng.random((n, columns)) < share, rng.integers(2, 10**9, (n, columns)), 0) for n in rows]
        zeros = [rng.integers(1, 1000, n) for n in rows]
        trees = [QuadTree(*np.nonzero(m), height, m[np.nonzero(m)]) for m in dense]
        value, met = walk(*trees, *zeros, False)
        for a in range(rows[0]):
            for b in range(rows[1]):
                either = (dense[0][a] > 0) | (dense[1][b] > 0)
                p, q = np.where(dense[0][a], dense[0][a], zeros[0][a])[either], np.where(dense[1][b], dense[1][b], zeros[1][b])[either]
                assert met[a, b] == either.sum() and value[a, b] == ((p - q) ** 2 // (p + q)).sum()


# Personal data


def private_texts():
    rng = random.Random(9)
    parts = [
        "mail me: a.b+c@ex-ample.org.", "x@y", "a@b.c_d@e.f", "..@b.-", "see 1.2.3.4.5.6.7.8!", "300.1.1.1", "000255.01.1.1", "v1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "4465758382889437 4465758382889437", "+1 (456) 555-2186", "+49-30-1234567", "+1 2 3", "+1...2", "12:30:45", "555-123-4567 call", "größe 5 über", "\U0001f600\U0001f601 q@r.st", "bob (at) site [dot] com",
        "2001:db8:0:0:0:0:0:1", "isbn 978-3-16-148410-0", "10 20 30", "jim at home dot com",
    ]
    texts = [None, "", " ", *parts, "no data here at all", "1" * 30000, "a" * 30000, "1." * 9000, "@" * 5000, "+1" + " " * 20000, "a@" + "b." * 9000 + "c", "x@y.zz " * 1500]
    for _ in range(60):
        texts.append(" ".join(rng.choice(parts) if rng.random() < 0.4 else rng.choice(["the", "sea", "Öl", "now", "7"]) for _ in range(rng.randrange(25))))
    return texts


def plain_scores(counts):
    """What expectation-maximisation and the regression give each key, in plain Python."""
    scores = {}
    for kind in {k[0] for k in counts}:
        rows = sorted((k, [int(c) for c in k[2:]], float(n), k[1] == "1") for k, n in counts.items() if k[0] == kind)
        label = [1.0 if known else (v[:5].count(1) + 0.5) / (v[:5].count(0) + v[:5].count(1) + 1) for _, v, _, known in rows]
        for _ in range(20):
            table = {}
            for true in (True, False):
                weight = [n * (y if true else 1 - y) for (_, _, n, _), y in zip(rows, label)]
                table[true] = [math.log(sum(weight) + 1)]
                for place in range(5):
                    for vote in range(3):
                        held = sum(w for w, (_, v, *_) in zip(weight, rows) if v[place] == vote)
                        table[true].append(math.log((held + personal_data.BELIEF[true][vote]) / (sum(weight) + 15)))
            odds = [table[True][0] - table[False][0] + sum(table[True][1 + 3 * p + v[p]] - table[False][1 + 3 * p + v[p]] for p in range(5)) for _, v, *_ in rows]
            label = [1.0 if r[3] else 1 / (1 + math.exp(-o)) for r, o in zip(rows, odds)]
        x = np.array([[v[j // 4] == j % 4 for j in range(32)] for _, v, *_ in rows], float)
        n, y, w = np.array([r[2] for r in rows]), np.array(label), np.zeros(32)
        for _ in range(30):
            off = n * (y - 1 / (1 + np.exp(-x @ w)))
            w = w + 0.5 * (x.T @ off - w) / (x.T @ n + 1)
        scores |= {r[0]: s for r, s in zip(rows, 1 / (1 + np.exp(-x @ w)))}
    return scores


def test_base_spans_equal_brute_force(spark, tmp_path):
    texts = private_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_personal_data(spark, str(tmp_path)).collect():
        base = brute.base_spans(texts[r["doc_id"]])
        named = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert r["base_sha256"] == brute.sha(",".join(named)), (texts[r["doc_id"]], base, r["spans"])
        assert [r[f"n_{k}"] for k in brute.PRIVATE] == [sum(b[2] == k for b in base) for k in brute.PRIVATE]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(named) <= set(spans) and len(spans) == len(set(spans))
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), list(brute.PRIVATE).index(s.split(":")[0])))


def test_reliabilities_and_scores_equal_plain_python(spark):
    rng = random.Random(4)
    keys = [rng.choice("eicp") + rng.choice("0001") + "".join(rng.choice("012") for _ in range(5)) + "".join(rng.choice("0123") for _ in range(3)) for _ in range(60)]
    counts = {k: rng.randint(1, 400) for k in keys}
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "key string")
    got = personal_data.fitted_scores(df).first()["scores"]
    want = plain_scores(counts)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert personal_data.fitted_scores(df.where("false")).first()["scores"] == {}


def test_spans_beyond_the_strict_patterns(spark):
    filler = "The sea was calm at noon. Version 1.2.3 of 12:30:45 has order 12345 and 4111111111111112 in it. "
    wanted = {"call 555-123-4567 now": ["phone"], "my card 4465758382889437 4465758382889437.": ["card", "card"], "mail bob (at) site [dot] com": ["email"], "server 2001:db8:0:0:0:0:0:1 up": ["ip"]}
    plain = ["write to a.b@example.com", "host 10.1.2.3", "card 4111111111111111", "phone +1 (456) 555-2186"]
    texts = [filler * 3] * 40 + plain * 10 + list(wanted)
    df = clashing(spark, [*((i, t, "en", "s") for i, t in enumerate(texts)), (None, None, None, None), (5, texts[40], "x", "y")])
    out = find_personal_data(df)
    assert out.columns == [c for c in df.columns if c != "spans"] + ["spans"]
    got = {r["text"]: r["spans"] for r in out.collect()}
    assert got[filler * 3] == [] and got[None] == []
    for text, kinds in wanted.items():
        assert [s["kind"] for s in got[text]] == kinds and not any(s["base"] for s in got[text]), (text, got[text])
    assert all(len(got[t]) == 1 and got[t][0]["base"] for t in plain)
    assert find_personal_data(df.where("false")).count() == 0


def test_no_python_runs_in_the_search_for_personal_data(spark):
    plan = find_personal_data(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInArrow" not in plan
