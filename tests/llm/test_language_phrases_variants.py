"""op11 (byte GRU), op12 (phrase tiles), op13 (spelling variants) against brute force, a direct gradient and odd rows."""

from __future__ import annotations

import os
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from workmart.llm import byte_gru, phrase_tiles, spelling_variants  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, word string, phrase string, score double, lang_pred string"


def frame(spark, rows):
    """rows: (id, text, lang); columns named like results clash on purpose."""
    return spark.createDataFrame([(i, t, l, "s", "x", "y", -1.0, "zz") for i, t, l in rows], DOCS)


def odd():
    long = " ".join(["colourful painting", "colorful painting"][i % 2] for i in range(6000))
    return [(1, None, "en"), (2, "", None), (3, " \t\n.,;", "en"), (4, long, "en"), (4, long, "en"), (None, "Information informaton", None), (6, "é你好 1234 !!!", "fr")]


# --- op13 -----------------------------------------------------------------------------


def planted_words():
    rng = random.Random(3)
    rows, i = [], 0
    for word, n in [("colourful", 300), ("colorful", 25), ("colurful", 2), ("information", 40), ("informaton", 3), ("bookkeeper", 50), ("bokkeeper", 4), ("bookeeper", 3),
                    ("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 500), ("Straße", 9), ("Strasse", 9), ("Ãéíóúàèì", 5), ("ãéíóúàèi", 60)]:
        for _ in range(n):
            rows.append((i, f"{word} and {rng.choice(['more', 'less', 'TEXT'])}", "en"))
            i += 1
    return rows


def test_variants_equal_brute_force(spark):
    rows = planted_words() + odd()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(frame(spark, rows)).collect()}
    want = brute.variants([(i, t) for i, t, _ in rows])
    assert got == want
    assert got["abcdefgh"][1] == "abcdefghij"  # a chain of two forms
    assert got["colurful"][0] is None or got["colurful"][2] * 10 <= got["colurful"][4]


def test_variants_sort_narrow_rotations_once(spark):
    vocabulary = spark.createDataFrame([("colourful", 300), ("colorful", 25), ("colurful", 2)], "word string, n long")
    rows = spelling_variants.rotations(vocabulary)
    assert rows.columns == ["key", "c", "n"]
    words = rows.select(spelling_variants.word_of(rows.c).alias("word")).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in words} == {"colourful": 19, "colorful": 17, "colurful": 17}
    plan = spelling_variants.neighbours(vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1


def test_variants_on_empty_table(spark):
    assert spelling_variants.variants(frame(spark, [])).collect() == []


# --- op12 -----------------------------------------------------------------------------


def planted_phrases():
    rng = random.Random(5)
    words = "the of new york city red wine a b c hot dog".split()
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        text += rng.choice([". New York City", "; red wine, ", "\nhot  dog\t", "!"])
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows


def test_collocations_equal_brute_force(spark):
    rows = planted_phrases() + odd()
    got = {}
    for r in sorted(phrase_tiles.collocations(frame(spark, rows)).collect(), key=lambda r: (r.lang, r.rank)):
        got.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == brute.collocations([(t, l) for _, t, l in rows])
    few = {}
    for r in phrase_tiles.collocations(frame(spark, rows), top=3).collect():
        few.setdefault(r.lang, []).append(r.rank)
    assert all(sorted(v) == [1, 2, 3] for v in few.values())


def test_collocations_by_joins_beyond_the_shipped_bound(spark, monkeypatch):
    monkeypatch.setattr(phrase_tiles, "SHIPPED", 0)
    rows = planted_phrases() + odd()
    got = {}
    for r in sorted(phrase_tiles.collocations(frame(spark, rows)).collect(), key=lambda r: (r.lang, r.rank)):
        got.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == brute.collocations([(t, l) for _, t, l in rows])


def test_tiles_count_like_a_counter():
    rng = np.random.default_rng(2)
    lang = rng.integers(0, 2, 5000)
    a, b = rng.integers(0, 3000, 5000) ** 1 // rng.integers(1, 4, 5000), rng.integers(0, 2000, 5000)
    got = {(int(c), int(x), int(y)): int(k) for c, xs, ys, ks in phrase_tiles.count_pairs(lang, a, b, dense=64) for x, y, k in zip(xs, ys, ks)}
    want = {}
    for key in zip(lang.tolist(), a.tolist(), b.tolist()):
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_tiles_count_ids_of_32_bits():
    rng = np.random.default_rng(3)
    lang, left, right = (rng.integers(0, most, 5000) for most in (2, 3000, 3000))
    left[:50], right[:50] = 2**31 - 1, 2**31 - 1
    wide, narrow = phrase_tiles.count_pairs(lang, left, right), phrase_tiles.count_pairs(lang.astype(np.int32), left.astype(np.int32), right.astype(np.int32))
    for one, two in zip(wide, narrow, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_collocations_count_pairs_once(spark, monkeypatch):
    seen, counter = spark.sparkContext.accumulator(0), phrase_tiles._pair_counter

    def counted(reader):
        run = counter(reader)

        def watched(batches):
            def watch():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            return run(watch())

        return watched

    monkeypatch.setattr(phrase_tiles, "_pair_counter", counted)
    rows = planted_phrases() + odd()
    assert phrase_tiles.collocations(frame(spark, rows)).count() > 0
    assert seen.value == 2 * len(rows)  # each text once for pairs and once for phrases of three words


def test_pair_counts_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(phrase_tiles, "FLUSH", 3000)
    monkeypatch.setattr(phrase_tiles, "SENT", 100)
    rng = np.random.default_rng(4)
    langs = [["en", "de"][x] for x in rng.integers(0, 2, 10_000)]
    left, right = rng.integers(0, 2000, 10_000), rng.integers(0, 3, 10_000) * 700
    given = pa.table({"lang": langs, "left": left, "right": right}).to_batches(max_chunksize=1000)
    got, want = {}, {}
    for batch in phrase_tiles._pair_counter(phrase_tiles._given)(iter(given)):
        assert batch.num_rows <= 100
        for r in batch.to_pylist():
            key = (r["lang"], r["left"], r["right"])
            got[key] = got.get(key, 0) + r["c"]
    for key in zip(langs, left.tolist(), right.tolist()):
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_collocations_with_words_but_not_pairs_sent(spark, monkeypatch):
    """Beyond the bound for pairs, texts are still read by the tasks (twice), and no word occurrence is joined."""
    seen, encoded = spark.sparkContext.accumulator(0), phrase_tiles._encoded

    def watched(batch, words):
        seen.add(batch.num_rows)
        return encoded(batch, words)

    monkeypatch.setattr(phrase_tiles, "_encoded", watched)
    monkeypatch.setattr(phrase_tiles, "SHIPPED", 60)  # 13 words or so in each of three langs, and about 150 pairs
    rows = planted_phrases() + odd()
    got = {}
    for r in sorted(phrase_tiles.collocations(frame(spark, rows)).collect(), key=lambda r: (r.lang, r.rank)):
        got.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == brute.collocations([(t, l) for _, t, l in rows])
    assert seen.value == 2 * len(rows)


def test_texts_in_chunks_have_the_vocabulary_s_ids(spark, monkeypatch):
    monkeypatch.setattr(phrase_tiles, "BUCKET", 50)  # a few texts to a chunk
    docs = phrase_tiles.texts(spark.createDataFrame([("Red wine. red\tx", "en"), ("wine", "de"), ("", "en"), (None, None), *[("RED", "en")] * 40], "text string, lang string"))
    words = spark.createDataFrame([("en", "red", 0), ("en", "wine", 1), ("de", "wine", 7)], "lang string, word string, id long")
    got = sorted((r["lang"], r["ids"]) for r in phrase_tiles.encoded_texts(docs, words, 45).collect())
    assert got == sorted([("en", [0, 1, -1, 0, -1, -1]), ("de", [7, -1]), ("en", [-1]), ("und", [-1]), *[("en", [0, -1])] * 40])


@pytest.mark.parametrize("bits, wide", [(0, False), (3, False), (3, True)])
def test_packed_counts_come_back_and_are_small(bits, wide):
    """About two bytes leave a task for a pair, instead of a row of four columns."""
    rng = np.random.default_rng(6)
    left, right = (rng.zipf(1.3, 200_000) % 30_000 for _ in range(2))
    left = left << 32 | left[::-1] if wide else left
    left[0], right[0] = (2**62 - 1 if wide else 2**31 - 1), 2**31 - 1
    once = phrase_tiles.sum_counts(left, right, np.ones(len(left), np.int64), 1)
    packed = list(phrase_tiles.pack_counts(*once, bits))
    assert len({b for b, _, _ in packed}) == len(packed) == 1 << bits
    assert sum(len(held) for *_, held in packed) < (5 if wide else 3) * len(once[0])
    back = [np.concatenate(x) for x in zip(*[phrase_tiles.unpack_counts(b, n, held, bits) for b, n, held in packed])]
    assert all(np.array_equal(a, b) for a, b in zip(phrase_tiles.sum_counts(*back, 1), once))
    often = phrase_tiles.sum_counts(*back, 10)
    assert 0 < len(often[0]) < len(once[0]) and often[2].min() >= 10


def test_wide_pairs_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(phrase_tiles, "FLUSH", 3000)
    rng = np.random.default_rng(7)
    langs = [["en", "de"][x] for x in rng.integers(0, 2, 10_000)]
    left, right = rng.integers(0, 40, 10_000) << 50 | 5, rng.integers(0, 2000, 10_000)
    got, want = {}, {}
    for batch in phrase_tiles._wide_counter(phrase_tiles._given)(iter(pa.table({"lang": langs, "left": left, "right": right}).to_batches(max_chunksize=1000))):
        for r in batch.to_pylist():
            key = (r["lang"], r["left"], r["right"])
            got[key] = got.get(key, 0) + r["c"]
    for key in zip(langs, left.tolist(), right.tolist()):
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_collocations_on_empty_table(spark):
    assert phrase_tiles.collocations(frame(spark, [])).collect() == []


# --- op11 -----------------------------------------------------------------------------


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in byte_gru._init(3, hidden=4).items()}
    X, mask, y = rng.integers(0, 256, (4, 6)), np.ones((4, 6)), rng.integers(0, 3, 4)
    mask[1, 3:] = 0
    _, g = byte_gru.loss_and_grad(p, X, mask, y)
    for k in p:
        for idx in list(np.ndindex(p[k].shape))[:: max(1, p[k].size // 12)]:
            old = p[k][idx]
            p[k][idx] = old + 1e-6
            up = byte_gru.loss_and_grad(p, X, mask, y)[0]
            p[k][idx] = old - 1e-6
            down = byte_gru.loss_and_grad(p, X, mask, y)[0]
            p[k][idx] = old
            assert abs((up - down) / 2e-6 - g[k][idx]) <= 1e-4 * max(1.0, abs(g[k][idx]))


def test_pooled_distributions_equal_the_trained_network_in_little_memory():
    rng = np.random.default_rng(2)
    p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in byte_gru._init(3).items()}
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 127, 128, 129, 700)]
    found = byte_gru.pooled(p, [None, b"", *texts], chunks=3)
    assert (found[:2] == 0).all()
    for text, dist in zip(texts, found[2:]):
        X, mask = byte_gru._pack([text[at:at + 128] for at in range(0, len(text), 128)])
        prob = byte_gru._softmax(byte_gru.logits(p, X, mask)[0].astype(np.float64)) * mask.T[:, :, None]
        assert np.allclose(prob.sum((0, 1)) / len(text), dist, atol=1e-5)
    tracemalloc.start()
    byte_gru.pooled(p, [bytes(128 * 4096)])  # 4,096 chunks: their states alone are 67 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, peak


def two_languages(n):
    rng = random.Random(9)
    one, two = "ka ki ko ku kan kon".split(), "zé zö zü zéé öz üz".split()
    return [(i, " ".join(rng.choice(one if i % 2 else two) for _ in range(rng.randint(1, 40))), "aa" if i % 2 else "bb") for i in range(n)]


def test_languages_held_out_and_odd_rows(spark):
    rows = two_languages(400)
    docs = frame(spark, rows + odd())
    model = byte_gru.fit(docs.filter("doc_id < 300"), per_lang=100, windows=2)
    assert model.langs == ["aa", "bb", "en", "fr"]
    found = {r.doc_id: r for r in byte_gru.predict(docs, model).collect() if r.doc_id is not None}
    assert sum(found[i].lang_pred == lang for i, _, lang in rows[300:]) >= 95
    assert found[1].lang_pred == "und" and found[1].score == 0.0 and found[3].lang_pred == "und"
    assert found[4].lang_pred in model.langs and 0 < found[4].score <= 1
    assert set(byte_gru.predict(docs, model).columns) == set(docs.columns)
    assert byte_gru.predict(frame(spark, []), model).collect() == []
    assert byte_gru.fit(frame(spark, [])).langs == []
