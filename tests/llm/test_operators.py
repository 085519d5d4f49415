"""Every operator against its plain version, on texts with nulls, blanks, ties, copies, long texts and clashing names."""

import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tarnspark.llm import kernels, packing
from tarnspark.llm.decontaminate import contamination, decontaminate, smith_waterman
from tarnspark.llm.jaccard_join import jaccard_components, keep_one_of_each, link_cell
from tarnspark.llm.line_dedup import dedup_lines
from tarnspark.llm.quality_classifier import fit, score_documents
from tarnspark.llm.quality_rules import BASE, score_quality
from tarnspark.llm.sharding import shard_documents
from tarnspark.llm.substring_dedup import dedup_substrings
from tarnspark.llm.token_counts import count_tokens, document_token_counts, read_flat_files
from tarnspark.llm.token_ids import encoder
from tarnspark.llm.token_store import frame_ids, read_token_store, write_token_store
from tarnspark.scratch import stored
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
#: Names of the operators' own columns, and of what they add.
OWN = "__id __tk __doc __words __jump __dropped __gone_id __gone_key __chunk __rank __offset __keep __root __times __again __starts __copy __text __key __row __first n_lines kept base_failed n_removed slot size law".split()
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_words string, kept double, score string, shard string, k string"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeñé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, origin = say(60), say(160)
    texts = [None, "", " \t\n", "one", "One", "two words", "Two  Words\n", "a b c d e", "a b c d e", "x" * 40, "\n\n", "Of Of Of " * 30]
    for _ in range(12):  # near copies, some chained
        w = list(origin)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
        origin = w if rng.random() < 0.3 else origin
    for _ in range(12):
        w = say(rng.randint(5, 140))
        w[3:3] = passage
        texts.append(" ".join(w))
    texts += [" ".join(say(5000)), " ".join(passage), " ".join(passage[:49]), " ".join(passage[:50]), "A shared line here.\n" + " ".join(say(80))]
    texts += ["  a SHARED line here.\t\nother\n" + " ".join(say(70)), " ".join(say(90)) + "\nA shared line here.", texts[30], texts[30], texts[12]]
    return [(i, t) for i, t in enumerate(texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.5, "y", "z", "k") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_jaccard_join(docs, none):
    got = rows(jaccard_components(docs), "n_shingles", "component_id")
    assert got == brute.jaccard_components(DOCS)
    assert jaccard_components(none).count() == 0
    kept = {r["doc_id"] for r in keep_one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_jaccard_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(df).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "None")]
    assert keep_one_of_each(df).count() == 4


def test_link_cell_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(10_000, 10**6, 1)[0]
            sets.append(np.unique(s))
        links = link_cell(np.arange(len(sets)), sets, 80)
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        true = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    true[root(a, true)] = root(b, true)
        same = lambda p: {frozenset(i for i in range(len(p)) if root(i, p) == r) for r in {root(j, p) for j in range(len(p))}}
        assert same(parent) == same(true)


def test_jaccard_join_cuts_large_cells(spark, monkeypatch):
    from tarnspark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CELL_HASHES", 2500)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(2):  # chains of near copies that drift apart, and a crowd around each origin
        w = [word() for _ in range(90)]
        origin = list(w)
        for _ in range(60):
            w[rng.randrange(90)] = word()
            near = list(origin)
            near[rng.randrange(90)] = word()
            texts += [" ".join(w), " ".join(near)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_components(df), "n_shingles", "component_id") == brute.jaccard_components(sorted(docs))


def test_jaccard_key_with_several_texts(spark):
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = lambda w: " ".join([*w[:-1], "end"])
    table = [(5, " ".join(one)), (5, " ".join(two)), (7, near(one)), (9, near(two)), (5, " "), (3, "some other text of some words")]
    for part in (table, table[::-1]):
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect())
        assert got == [(3, 2, 3), (5, 0, 5), (5, 56, 5), (5, 56, 5), (7, 56, 5), (9, 56, 5)]


def test_line_dedup(docs, none):
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"])) for r in out.collect()}
    assert got == brute.line_dedup(DOCS)
    assert dedup_lines(none).count() == 0
    assert sum(r["n_dropped"] for r in dedup_lines(docs, min_docs=3).collect()) < sum(n for _, n, _ in got.values())


def test_quality_rules(docs, none):
    out = score_quality(docs)
    assert rows(out, *BASE, "base_failed") == {i: brute.quality(t) for i, t in DOCS}
    assert {c for c in docs.columns if c not in ("n_words", "kept")} <= set(out.columns)
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    assert score_quality(none).count() == 0


def test_substring_dedup(docs, none):
    out = dedup_substrings(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["text"])) for r in out.collect()}
    assert got == brute.substring_dedup(DOCS)
    assert dedup_substrings(none).count() == 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["text"])) for r in dedup_substrings(docs, 7, 3).collect()}
    assert got == brute.substring_dedup(DOCS, 7)


def test_decontamination(spark, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(6)]
    text = lambda w: " ".join(w)
    edited = [w if k % 6 else word() for k, w in enumerate(items[1])]
    docs = [text([word() for _ in range(300)]), None, "", text([word() for _ in range(50)] + items[0] + [word() for _ in range(50)]),
            text([word() for _ in range(90)] + edited), text([word() for _ in range(90)] + items[2][:6]), text(items[3]).upper() + ".", text(items[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, text(w)) for i, w in enumerate(items)] + [(9, None), (10, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(df, bench).collect()}
    assert set(got) == {(3, 0), (4, 1), (6, 3), (7, 3)} and got[3, 0] == 1.0 and 0.6 < got[4, 1] < 1
    assert {r["doc_id"] for r in decontaminate(df, bench).collect()} == {0, 1, 2, 5}
    assert contamination(none, bench).count() == 0 and contamination(df, bench.limit(0)).count() == 0
    assert decontaminate(df, bench.limit(0)).count() == len(docs)


def test_decontamination_finds_edited_copies_beside_exact_ones(spark):
    items = [[f"i{n}w{k}" for k in range(40)] for n in range(3)]
    text = " ".join
    every4th = [w if k % 4 else f"x{k}" for k, w in enumerate(items[0])]
    half = items[0][:21]
    spread = items[2][:10] + [f"y{k}" for k in range(36)] + items[2][10:]
    bodies = [items[0], every4th, half] * 2 + [items[1], [w if k % 4 else f"z{k}" for k, w in enumerate(items[1])], spread]
    df = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bodies)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, text(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(df, bench).collect()}
    ids = lambda b: np.array([hash(w) for w in b]).astype(np.uint64)
    whole = {(i, n): smith_waterman(ids(w), ids(b)[None])[0][0] / 80 for i, b in enumerate(bodies) for n, w in enumerate(items)}
    assert got == {pair: score for pair, score in whole.items() if score >= 0.5} and len(got) == len(bodies)
    assert decontaminate(df, bench).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(17)
    vocab = [f"w{k}" for k in range(60)]  # few words, so that many documents hold the same seeds
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.randint(1, 30)) for _ in range(14)]
    bodies = []
    for _ in range(40):
        w = say(rng.randint(0, 60))
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, len(item) // 2)):
            item[rng.randrange(len(item))] = rng.choice(vocab)
        bodies.append(w[:20] + item + w[20:])
    keys = [None if k % 13 == 5 else k for k in range(40)]
    docs = [(k, " ".join(b), "x") for k, b in zip(keys, bodies)] + [(0, " ".join(bodies[0]), "x"), (77, None, "x"), (78, "", "x")]
    bench = [(n % 12, " ".join(w)) for n, w in enumerate(items)] + [(3, " ".join(items[3])), (None, " ".join(items[5])), (50, None)]
    ids = lambda w: np.array([int(x[1:]) for x in w], dtype=np.uint64)
    want = []
    for key, body, _ in docs:
        w = (body or "").split()
        pieces = lambda v: {tuple(v[i : i + 3]) for i in range(len(v) - 2)} | {(*v[i : i + 2], *v[i + 3 : i + 5]) for i in range(len(v) - 4)}
        grams = pieces(w)
        best = {}
        for item, t in {(i, t) for i, t in bench if t}:
            v = t.split()
            if pieces(v) & grams:
                best[item] = max(best.get(item, 0), smith_waterman(ids(v), ids(w)[None])[0][0] / (2 * len(v)))
        want += [(key, item, round(float(s), 9)) for item, s in best.items() if s >= 0.5]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3)
    items_df = spark.createDataFrame(bench, "item_id long, text string")
    out = contamination(df, items_df)
    order = lambda rows: sorted(rows, key=str)
    assert order((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in out.collect()) == order(want) and len(want) > 20
    hit = {(k, t) for k, t, _ in docs if any(k == w[0] for w in want if w[0] is not None)}
    left = decontaminate(df, items_df).collect()
    assert {(r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None} == {(k, t) for k, t, _ in docs if k is not None} - hit


def test_decontamination_finds_passages_of_long_items_anywhere(spark):
    long = [f"q{k}" for k in range(600)]
    starts = [0, 60, 128, 200, 230, 255, 300, 460]
    docs = [(a, " ".join([f"x{a}_{k}" for k in range(40)] + long[a : a + 130] + [f"y{a}_{k}" for k in range(40)])) for a in starts]
    docs.append((999, " ".join(long[100:160])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = contamination(df, spark.createDataFrame([(1, " ".join(long))], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == starts


def test_a_phrase_that_many_items_share_brings_nobody_together(spark, monkeypatch):
    from tarnspark.llm import decontaminate as module

    kept = {}
    monkeypatch.setattr(module, "stored", lambda df, name, **more: kept.setdefault(name, stored(df, name, **more)))
    rng = random.Random(2)
    own = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    items = [f"which of the following {own(f'i{n}x', 12)}" for n in range(200)]
    docs = [f"{own(f'd{n}x', 20)} which of the following {own(f'e{n}x', 20)}" for n in range(1000)] + [own("z", 9) + " " + items[7]]
    same = ["what is the name of the city"] * 30 + [f"what is the name of the {w}" for w in ("river", "hill", "sea", "lake", "bay", "road", "bird", "fish", "tree", "king")]
    docs.append("they ask what is the name of the city here")
    bench = spark.createDataFrame(list(enumerate(items + same)), "item_id long, text string")
    found = contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()
    assert kept["pairs"].count() < 2000
    assert {r["item_id"] for r in found if r["doc_id"] == 1000} == {7} and {r["item_id"] for r in found if r["doc_id"] == 1001} >= set(range(200, 230))
    assert {r["doc_id"] for r in found} == {1000, 1001} and rng


@pytest.mark.parametrize("every", [3, 4, 5])
def test_recall_on_copies_with_replaced_words(spark, every):
    rng = random.Random(every)
    vocab = [f"v{int(rng.paretovariate(0.6))}" for _ in range(4000)]  # common words make common pieces
    items = [[rng.choice(vocab) for _ in range(rng.randint(24, 60))] for _ in range(120)]
    copies = [[w if (k + n) % every else f"new{k}" for k, w in enumerate(item)] for n, item in enumerate(items)]
    bodies = [" ".join([rng.choice(vocab) for _ in range(80)] + c + [rng.choice(vocab) for _ in range(80)]) for c in copies]
    ids = lambda w: np.array([hash(x) for x in w]).astype(np.uint64)
    true = {n for n in range(120) if smith_waterman(ids(items[n]), ids(bodies[n].split())[None])[0][0] >= len(items[n])}
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    found = contamination(df, spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string"))
    hit = {r["doc_id"] for r in found.collect() if r["doc_id"] == r["item_id"]}
    assert len(true) >= 40 and len(hit & true) >= 0.9 * len(true)


def test_smith_waterman_equals_the_textbook():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        h = np.zeros((10, 16), int)
        for i in range(1, 10):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert smith_waterman(a, b[None])[0][0] == h.max()


def test_sharding(docs, none):
    got = rows(shard_documents(docs, 5), "size", "text_crc32", "shard", "slot", "grown_shard")
    more = rows(shard_documents(docs, 6), "shard")
    for i, t in DOCS:
        size, crc, shard, _, grown = got[i]
        assert (size, crc) == (len((t or "").encode()) + 8, brute.crc(t))
        assert grown == more[i][0] and grown in (shard, 5)
    for s in range(5):
        slots = sorted(v[3] for v in got.values() if v[2] == s)
        assert slots == list(range(len(slots)))
    assert shard_documents(none, 5).count() == 0


def jump(key, shards):
    """Jump consistent hashing, one jump after another, on Spark's hash of (key, jump)."""
    at, beyond, i = -1, 0, 0
    while beyond < shards:
        at, i = beyond, i + 1
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        draw = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 33
        beyond = math.floor((at + 1) / ((draw + 1) / 2**31))
    return at


def test_sharding_equals_plain_jumps(spark):
    df = spark.createDataFrame([(k,  str(k)) for k in range(3000)] + [(None, "x"), (7, "again"), (7, "7")], "doc_id long, text string")
    got = shard_documents(df, 24).collect()
    assert all(r["shard"] == jump(r["doc_id"], 24) and r["grown_shard"] == jump(r["doc_id"], 25) for r in got) and len(got) == 3003
    moved = sum(r["shard"] != r["grown_shard"] for r in got) / len(got)
    assert 0.02 < moved < 0.065  # one in 25
    assert sorted(r["slot"] for r in got if r["shard"] == jump(7, 24)) == list(range(sum(r["shard"] == jump(7, 24) for r in got)))


def token_ids(text, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " a", "a ", "it's don't we'll  x", "a\nb\n\nc \n d", "x…, y— z", "ñ, é.É!ü?", "tab\tx\r\ny", "1a2.3 b4,5", "×, ÷. a×,b", "foo<|endoftext|>bar", "日本語, テスト。 ok", "\x1c x\x1cy", "é, x", "²³, ½. x", "a,", ",a"]


@pytest.mark.parametrize("plain", [False, True])
def test_encoder_equals_the_library(plain):
    texts = ODD + [t or "" for _, t in DOCS] + ["".join(p) for p in zip(ODD, reversed(ODD))]
    made = encoder(VOCAB, plain)
    for at, run in kernels.runs(pa.array(texts), 5000):
        flat, bounds = made.encode(run)
        for i in range(run.n):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == token_ids(texts[at + i], plain), texts[at + i]


def test_packing(docs, none):
    got = packing.pack_documents(docs, VOCAB, size=64, grain=4).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in DOCS:
        ids, at = token_ids(t) + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(none, VOCAB).count() == 0


@pytest.mark.parametrize(("size", "grain"), [(100, 16), (7, 7), (5, 1)])
def test_packing_takes_any_size_and_grain(spark, size, grain):
    texts = [(None, "x y z"), (1, None), (1, "a b"), (1, "a b"), (2, ""), (3, "word " * 211)]
    got = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), VOCAB, size=size, grain=grain).collect()
    assert sum(r["length"] for r in got) == sum(len(token_ids(t)) + 1 for _, t in texts)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_seq.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= size


def test_packing_refuses_a_grain_over_the_size(docs):
    with pytest.raises(ValueError, match="grain"):
        packing.pack_documents(docs, VOCAB, size=8, grain=9)


def test_patterns_hold_the_histogram_and_waste_little():
    rng = np.random.default_rng(4)
    demand = {int(s): int(n) for s, n in enumerate(rng.integers(1, 400, 64), start=1)}
    plans = packing.plan_patterns(demand, 64)
    held = {}
    for pattern, copies in plans:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            held[s] = held.get(s, 0) + n * copies
    assert held == demand
    assert sum(n for _, n in plans) <= 1.02 * sum(s * n for s, n in demand.items()) / 64 + 2
    assert packing.plan_patterns({}, 64) == []


def test_token_store(spark, docs, none, tmp_path):
    write_token_store(docs, f"file://{tmp_path}/a", VOCAB)
    got, at = rows(read_token_store(spark, f"file://{tmp_path}/a"), "start", "n_tokens", "ids_crc32"), 0
    for i, t in DOCS:
        ids = token_ids(t) + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    block = spark.read.parquet(f"file://{tmp_path}/a/blocks").first()
    known = bytes(spark.read.parquet(f"file://{tmp_path}/a/dictionary").first()["content"])
    text = dict(DOCS)[block["keys"][0]]
    assert frame_ids(block["frames"], block["offsets"], 0, block["width"], known).tolist() == token_ids(text) + [2]
    write_token_store(none, f"file://{tmp_path}/b", VOCAB)
    assert read_token_store(spark, f"file://{tmp_path}/b").count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    got = rows(document_token_counts(docs, f"file://{tmp_path}/a", VOCAB), "n_tokens")
    assert got == {i: (len(token_ids(t, True)),) for i, t in DOCS}
    assert document_token_counts(none, f"file://{tmp_path}/b", VOCAB).count() == 0
    ids = np.array([5, 6, 9, 9, 7, 7, 7, 7, 7, 9, 3], "<u2")
    (tmp_path / "flat.bin").write_bytes(ids.tobytes())
    for block in (1, 2, 3, 100):
        found = count_tokens(read_flat_files(spark, f"file://{tmp_path}/flat.bin", 2, block), 9).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"]) for r in found] == [(0, 0, 2), (1, 3, 0), (2, 4, 5)]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole ids"):
        read_flat_files(spark, f"file://{tmp_path}/odd.bin").collect()


def test_word_vectors_pooling_and_temperature_equal_plain_loops(spark):
    from tarnspark.llm import quality_classifier as module

    texts = [None, "", "a b c a b", "x, y! (z) über\tüber", "a b " * 40, "one", "!!?", "b c d\ne f"]
    cut = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (t or "").encode())

    def slot(word):
        run = kernels.Run(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        return int(run.hashes(np.array([0]), np.array([len(word)]), lower=False)[0] >> np.uint64(40)) % module.SLOTS

    table = np.zeros((module.SLOTS, module.WIDTH))
    for text in texts:
        held = [slot(w) for w in cut(text)]
        for i, a in enumerate(held):
            for j, b in enumerate(held):
                if i != j and abs(i - j) <= 2:
                    for place, sign in zip(module.INDEX_PLACE[b], module.INDEX_SIGN[b]):
                        table[a, place] += sign
    unit = table / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9)
    got = module.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, unit, atol=1e-6) and (np.abs(unit).sum(axis=1) > 0).sum() > 8
    for at, run in kernels.runs(pa.array(texts)):
        for k, row in enumerate(module.pooled(run, got)):
            mean = np.mean([got[slot(w)] for w in cut(texts[at + k])] or [np.zeros(module.WIDTH)], axis=0)
            assert np.allclose(row, [*mean, math.sqrt((mean**2).sum())], atol=1e-6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net, order = fit(x, y), np.random.default_rng(11).permutation(400)
    logits = [float(z) for z in net.logits(x[order[40:80]])]
    loss = lambda t: sum(math.log(1 + math.exp(z / t)) - w * z / t for z, w in zip(logits, y[order[40:80]]))
    tried = [math.exp(math.log(0.25) + k * (math.log(8) - math.log(0.25)) / 59) for k in range(60)]
    assert net.temperature == pytest.approx(min(tried, key=loss))


def test_quality_classifier(spark, none):
    rng = random.Random(9)
    good, bad = [f"w{k}" for k in range(40)], [f"w{k}%%%" for k in range(40)]
    texts = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(60)), int(i % 3 > 0)) for i in range(400)] + [(400, None, 0), (401, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts if i < 300] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = rows(score_documents(docs, labels), "held_out", "score", "predicted")
    assert len(got) == 402 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got.values())
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, (h, _, _) in got.items())
    held = [(got[i][2], y) for i, _, y in texts if got[i][0] and i < 400]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    swapped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end quality")
    assert rows(score_documents(docs, swapped), "score") == {i: (s,) for i, (_, s, _) in got.items()}
    assert score_documents(none, labels).count() == 0
    assert {s for _, s, _ in rows(score_documents(docs, labels.limit(0)), "held_out", "score", "predicted").values()} == {0.5}


def test_fit_with_one_class_is_constant():
    net = fit(np.ones((30, 2)), np.ones(30))
    assert np.allclose(net.probability(np.zeros((2, 2))), 31 / 32)


def test_words_split_on_ascii_space_only():
    text = "a b\x0bc\x0c d e"
    for _, run in kernels.runs(pa.array([text])):
        assert len(run.words(lower=False)[3]) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_null_and_repeated_keys_everywhere(spark, tmp_path):
    say = " ".join(f"w{k}" for k in range(60))
    texts = [(None, say), (1, say), (1, say), (2, say), (1, "A line that repeats.\n" + say), (2, "a LINE that repeats."), (None, None), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    pairs = lambda out, name: sorted((str(r["doc_id"]), r[name]) for r in out.collect())
    assert pairs(dedup_lines(df), "n_dropped") == [("1", 0), ("1", 0), ("1", 0), ("2", 1), ("2", 1), ("3", 0), ("None", 0), ("None", 0)]
    assert pairs(dedup_substrings(df), "n_removed") == [("1", 0), ("1", 0), ("1", 0), ("2", 0), ("2", 60), ("3", 0), ("None", 0), ("None", 0)]
    assert pairs(score_quality(df), "n_words") == [("1", 60), ("1", 60), ("1", 64), ("2", 4), ("2", 60), ("3", 0), ("None", 0), ("None", 60)]
    lengths = sorted((str(k), len(token_ids(t, True))) for k, t in texts)
    assert pairs(document_token_counts(df, f"file://{tmp_path}/a", VOCAB), "n_tokens") == lengths
    write_token_store(df, f"file://{tmp_path}/b", VOCAB)
    got = sorted((r["start"], str(r["doc_id"]), r["n_tokens"]) for r in read_token_store(spark, f"file://{tmp_path}/b").collect())
    assert [k for _, k, _ in got] == ["None", "None", "1", "1", "1", "2", "2", "3"]
    assert [a for a, *_ in got] == [sum(n for *_, n in got[:i]) for i in range(len(got))]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    assert len(score_documents(df, labels).collect()) == len(texts)


def test_columns_of_the_operators_own_names_stay(spark):
    texts = ["a shared line of some length\n" + f"and words of its own {k} " * 20 for k in range(6)] + [None, ""]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in OWN)
    df = spark.createDataFrame([(k, t, *(f"{n}:{k}" for n in OWN)) for k, t in enumerate(texts)], schema)
    bench = spark.createDataFrame([(1, texts[2][40:300])], "item_id long, text string")
    operators = {
        "quality": lambda d: score_quality(d), "lines": lambda d: dedup_lines(d), "substrings": lambda d: dedup_substrings(d), "shards": lambda d: shard_documents(d, 7),
        "one of each": lambda d: keep_one_of_each(d), "decontaminate": lambda d: decontaminate(d, bench),
        "substrings by name": lambda d: dedup_substrings(d, key="doc_id", text="text"), "small windows": lambda d: dedup_substrings(d, window=10),
    }
    for name, operator in operators.items():
        out = operator(df)
        assert [c for c in df.columns if c.startswith("__")] == [c for c in out.columns if c.startswith("__")], name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in OWN if n.startswith("__")), name
    for operator in (jaccard_components, lambda d: contamination(d, bench), lambda d: score_documents(d, df.select("doc_id", (df["doc_id"] % 2).alias("quality")))):
        assert operator(df).count() >= 0
    renamed = df.withColumnsRenamed({"doc_id": "__n", "text": "__body"})
    assert dedup_lines(renamed, key="__n", text="__body").columns[:2] == ["__n", "__body"]
    with pytest.raises(ValueError):
        dedup_substrings(df, window=10, gram=25)


def test_jumps_beyond_the_common_number_are_taken_one_by_one(spark, monkeypatch):
    from tarnspark.llm import sharding

    df = spark.createDataFrame([(k, "x") for k in range(200)], "doc_id long, text string")
    want = {r["doc_id"]: r["shard"] for r in shard_documents(df, 1000).collect()}
    assert want == {k: jump(k, 1000) for k in range(200)}
    monkeypatch.setattr(sharding, "MOST_JUMPS", 3)
    assert {r["doc_id"]: r["shard"] for r in shard_documents(df, 1000).collect()} == want


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_counts_do_not_depend_on_the_chunks_of_the_scan(spark, monkeypatch, chunk):
    from tarnspark.llm import token_counts

    monkeypatch.setattr(token_counts, "SCAN_BLOCKS", chunk)
    rng = random.Random(chunk)
    ids = {f: [rng.choice([9, 1, 2]) if f else 1 for _ in range(100)] for f in range(3)}
    rows = [(f, b, 2, np.array(x[b * 4 : b * 4 + 4], "<u2").tobytes()) for f, x in ids.items() for b in range(25)]
    got = sorted(tuple(r) for r in count_tokens(spark.createDataFrame(rows, "file int, block int, width int, ids binary").repartition(3), 9).select("file", "ordinal", "start", "n_tokens").collect())
    want = []
    for f, x in ids.items():
        ends = [k for k, v in enumerate(x) if v == 9]
        want += [(f, n, a + 1, b - a - 1) for n, (a, b) in enumerate(zip([-1, *ends], ends))]
    assert got == want
