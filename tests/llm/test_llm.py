"""The operators of workmart.llm against brute force, and on odd inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from workmart.llm import ads_search, bfd_shards, ngram_join, norm_topk, pareto_mix, pii_boost, piece_table, quality_fm, toxicity_ordinal, warc_dict
from workmart.llm.common import share_out, with_rank

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard string"


def docs(spark, rows):
    """rows: (id, text, source). The columns size and shard clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), -1, "x") for i, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, long, "a"), (5, long, "b"), (5, long, "b"), (6, "one two", None), (7, "one two", "b"), (None, "no id here at all, really", "c"), (9, "é你好 x@y.de +1 (229) 555-4838", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# --- pieces ---------------------------------------------------------------------------


def test_pieces_equal_the_library():
    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_table.table_of(open(MODEL, "rb").read())
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "ing", "1", "23", "é", "😀", "你好", "\x00", "<s>", "<0x41>", "=", "-", "//", "\r", "　", "of", "tion", ".", ",", "ABC"]
    texts = ["", " " * 70, "a" * 5000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)), *(" " * n + "x" for n in range(40))]
    for text in texts:
        ids = library.encode(text)
        assert table.encode(text).tolist() == ids
        assert table.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)
    for _ in range(500):  # ids that no encoding gives
        ids = [rng.choice([0, 1, 2, *range(3, 260), 259, 28705]) for _ in range(rng.randint(0, 6))]
        assert table.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def test_pieces_of_many_words_are_worked_out_once():
    table = piece_table.PieceTable(open(MODEL, "rb").read())
    made, make = [], table.words.make
    table.words.make = lambda word: made.append(word) or make(word)
    words = [f"{a}{b}{c}{d}" for a in "abcdefghijklmnopqrst" for b in "aeiouy" for c in "bcdfghjklmnpqrstvwxz" for d in "abcdefghijklmnopqrstuvwxyz"] + ["b" * 60]
    texts = [" ".join(words[at:at + 1000]) for at in range(0, len(words), 1000)]
    texts += [t.upper() for t in texts]
    first = [table.encode(t).tolist() for t in texts]
    n = len(made)
    assert len({w for w in made if len(w) < 60}) == 2 * len(words) - 2
    assert [table.encode(t).tolist() for t in texts] == first
    assert [w for w in made[n:] if len(w) < 60] == []
    assert not any(len(w) >= 60 for w in [*table.words, *table.words.old])  # too long to be kept


def test_pieces_on_odd_rows(odd, none):
    found = piece_table.encode(odd, MODEL, ["doc_id", "size"], outputs=("ids", "decoded", "n_tokens")).collect()
    assert sorted(r["decoded"] for r in found) == sorted(t or "" for _, t, _ in odd_rows()) and all(len(r["ids"]) == r["n_tokens"] and r["size"] == -1 for r in found)
    assert piece_table.encode(none, MODEL, ["doc_id"]).count() == 0


# --- mixing -----------------------------------------------------------------------------


def test_shares_stop_at_their_caps():
    assert share_out(15, [5, 2, 1], [8, 100, 100]) == pytest.approx([8, 14 / 3, 7 / 3])
    assert share_out(0, [1, 1], [0, 0]) == [0, 0]


def test_mix_meets_targets_and_repeats(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(1.1) * 4))), rng.choice(["s1", "s1", "s1", "s2", "s3", "s4", None])) for i in range(1500)]
    one, two = (sorted(pareto_mix.mix(docs(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=str) for _ in range(2))
    assert one == two
    sizes = {i: len(t.split()) for i, t, _ in rows}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in one)
    by = {s: [r for r in one if r["source"] == s] for s in ("s1", "s2", "s3", "s4", None)}
    total = sum(sizes.values())
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * total)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(4, 0.002 * own[0]["target"])
    assert pareto_mix.mix(odd).count() == len(odd_rows()) and pareto_mix.mix(none).count() == 0


# --- shards -----------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [(room, b) for b, room in enumerate(rooms) if room >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(capacity - s)
    return rooms


def test_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        order = sorted(counts, reverse=True)
        runs = bfd_shards.pack(order, [counts[s] for s in order], 50)
        used, before = {}, {}
        for size, end, b in runs:
            used[b] = used.get(b, 0) + size * (end - before.get(size, 0))
            before[size] = end
        assert before == counts and sorted(50 - u for u in used.values()) == sorted(plain_best_fit(sizes, 50))


def test_shards_hold_groups_and_balance(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300) + str(i % 900), "s") for i in range(3000)] + [(5000 + i, "same text again", "s") for i in range(1500)]
    found = bfd_shards.shard(docs(spark, rows), shards=8).collect()
    texts = {i: t for i, t, _ in rows}
    bytes_, slots, where = {}, {}, {}
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]]) + 1
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(found) == 4500 and set(bytes_) == set(range(8)) and max(bytes_.values()) - min(bytes_.values()) < 0.02 * sum(bytes_.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(w) == 1 for w in where.values())
    # a group of a third of all bytes and more is cut, the others stay whole
    rows = [(i, "hot " * 10, "s") for i in range(500)] + [(1000 + i, f"text {i}", "s") for i in range(500)]
    found = bfd_shards.shard(docs(spark, rows), shards=8).collect()
    sums = [sum(r["size"] for r in found if r["shard"] == b) for b in range(8)]
    assert len(found) == 1000 and max(sums) - min(sums) <= 0.02 * sum(sums)
    assert bfd_shards.shard(odd, capacity=1000).count() == len(odd_rows())
    assert bfd_shards.shard(none, shards=8).count() == 0


def test_ranks_are_gapless(spark):
    found = with_rank(spark.range(1000).selectExpr("id", "nullif(id % 3, 0) k"), ["k"], ["id"], 7, "at").collect()
    for k in (None, 1, 2):
        assert sorted(r["at"] for r in found if r["k"] == k) == list(range(sum(r["k"] == k for r in found)))


# --- near copies ------------------------------------------------------------------------


def grams(text):
    w = (text or "").encode().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_join_equals_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((3, 5, 40, 150)))] for _ in range(60)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(words), "s"))
    rows += [(1000, "", "s"), (1001, "", "s"), (1002, None, "s"), (1003, " \n", "s")]
    sets = {i: grams(t) for i, t, _ in rows}
    links, first = {i: 0 for i in sets}, {i: i for i in sets}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                first[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows)).collect()}
    assert found == {i: (root(i), links[i]) for i in sets}
    kept = [r["doc_id"] for r in ngram_join.keep_first(docs(spark, rows)).collect()]
    assert sorted(root(i) for i in kept) == sorted({root(i) for i in sets})


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 500)  # many blocks of few texts
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[51:]]), "s") for i in range(40)]
    found = ngram_join.join(docs(spark, rows)).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 39)}  # 91 common n-grams of 101


def test_join_on_odd_rows(odd, none):
    found = ngram_join.join(odd).collect()
    assert len(found) == len(odd_rows()) and {r["n_links"] for r in found if r["doc_id"] == 5} == {2} and {r["n_links"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert sorted(r["doc_id"] or 0 for r in ngram_join.keep_first(odd).collect()) == [0, 1, 2, 3, 4, 6, 9]
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_first(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9995, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


# --- archives ---------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://x.org/{i}\r\nInjected: y", f"<p>{rng.choice(['common text ' * 30, str(i) * 50])}</p>") for i in range(300)]
    rows += [(1000, None, None), (1001, "u", ""), (None, "u", "only here"), (1002, "u", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, record_type string")
    manifest = warc_dict.write(pages, str(tmp_path / "a"), roll_bytes=20_000)
    found = warc_dict.read_back(spark, manifest).collect()
    newest = {}
    for i, _, html in rows:
        newest[html or ""] = max(newest.get(html or "", -1), -1 if i is None else i)
    assert len(found) == len(rows) and manifest.count() > 3
    texts = {i: html or "" for i, _, html in rows}
    for r in found:
        raw = texts[r["page_id"]].encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        last = newest[texts[r["page_id"]]]
        alone = r["page_id"] is None or r["page_id"] == last
        assert (r["record_type"], r["refers_to"]) == (("response", None) if alone else ("revisit", last))
        assert r["payload"] is None if not alone else bytes(r["payload"]) == raw
    head = next((tmp_path / "a").glob("*.zst")).read_bytes()[:4]
    assert head == (0x184D2A5D).to_bytes(4, "little")
    nothing = warc_dict.write(pages.limit(0), str(tmp_path / "b"))
    assert nothing.count() == 0 and warc_dict.read_back(spark, nothing).count() == 0


# --- vectors ----------------------------------------------------------------------------


def vectors(spark, seed, n, dim, spread=0.4, scale=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))) * scale * rng.uniform(0.3, 1.5, (n, 1))
    x = np.round(x, 3)
    x[n // 2 : n // 2 + 30] = x[0]  # ties
    odd = [(n, None), (n + 1, [float("nan")] * dim), (n + 2, [1.0] * (dim - 1)), (n + 3, [0.0] * dim), (None, x[1].tolist()), (n + 4, [float("inf")] + [0.0] * (dim - 1))]
    return x, spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)] + [(*o, 5) for o in odd], "vec_id bigint, embedding array<double>, rank int")


def test_norm_bucketed_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(norm_topk, "BLOCK", 60)
    monkeypatch.setattr(norm_topk, "SEEDS", 50)
    for scale in (1.0, 1e6, 1e8):  # beyond exact sums of doubles, beyond a long
        x, table = vectors(spark, 5, 300, 8, scale=scale)
        ints = [[int(np.floor(64 * c)) for c in row] for row in x] + [[0] * 8]
        ids = [*range(300), 303]
        found = {}
        for r in norm_topk.search(table, k=7, every=20).collect():
            found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        for q in range(0, 300, 20):
            scores = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v)), -(2**63)), 2**63 - 1), i) for i, v in zip(ids, ints) if i != q)[:7]
            assert found[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(scores)}


def test_adaptive_scan_finds_neighbours(spark):
    x, table = vectors(spark, 7, 1500, 24)
    found = {}
    for r in ads_search.search(table, k=10, every=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -s))[:10].tolist()) & {i for _, i, _ in found[q]})
        assert [r for r, _, _ in sorted(found[q])] == list(range(1, 11)) and all(abs(x[q] @ x[i] - v) < 1e-9 for _, i, v in found[q])
    assert hits / 750 >= 0.9


def test_searches_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ads_search.search(few).collect()) == [(0, 1, 20), (20, 1, 0)]
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in norm_topk.search(few).collect()) == [(0, 20, 0), (20, 0, 0)]
    assert ads_search.search(few.limit(0)).count() == 0 and norm_topk.search(few.limit(0)).count() == 0


# --- models -----------------------------------------------------------------------------


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    marks, features = [], []
    for _ in range(1200):  # label 1 where exactly one of two features is there: no weights alone can tell
        a, b = rng.integers(0, 2, 2)
        features.append(np.array([a, 2 + b, 10 + rng.integers(0, 50)]))
        marks.append(float(a != b))
    values, marks = [np.ones(3)] * 1200, np.array(marks)
    machine = quality_fm.fit_sample(features[:1000], values[:1000], marks[:1000], np.ones(1000), epochs=30)
    assert np.mean([(machine.raw(f, v) > 0) == m for f, v, m in zip(features[1000:], values[1000:], marks[1000:])]) > 0.95
    f, v = features[0], values[0]
    pairs = sum(machine.v[f[i]] @ machine.v[f[j]] * v[i] * v[j] for i in range(3) for j in range(i))
    assert machine.raw(f, v) == pytest.approx(machine.bias + machine.w[f] @ v + pairs)


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic, good = i % 4 == 0, i % 3 > 0
        words = [f"word{rng.randint(0, 300)}" for _ in range(60)] + [rng.choice(("vile", "rotten", "vileness"))] * (toxic * rng.randint(1, 6))
        rng.shuffle(words)
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), "s"))
        labels.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_classifiers_on_held_back_rows(spark, odd, none):
    table, labels = labelled(spark)
    learn = labels.filter("doc_id % 5 <> 0")
    marks = {r["doc_id"]: r for r in labels.filter("quality is not null").collect()}
    machine = quality_fm.fit(table, learn)
    scored = quality_fm.score(table, machine).collect()
    assert np.mean([(r["score"] >= 0.5) == marks[r["doc_id"]]["quality"] for r in scored if r["doc_id"] % 5 == 0]) > 0.95
    model = toxicity_ordinal.fit(table, learn)
    assert (np.diff(model.thresholds) > 0).all()
    graded = toxicity_ordinal.score(table, model).collect()
    assert np.mean([r["rejected"] == bool(marks[r["doc_id"]]["toxic"]) for r in graded if r["doc_id"] % 5 == 0]) > 0.95
    assert quality_fm.score(odd, machine).count() == toxicity_ordinal.score(odd, model).count() == len(odd_rows())
    assert quality_fm.score(none, machine).count() == toxicity_ordinal.score(none, model).count() == 0
    # without labels: the flat score, nothing rejected
    assert {r["score"] for r in quality_fm.score(odd, quality_fm.fit(odd, learn.limit(0))).collect()} == {0.5}
    assert not any(r["rejected"] for r in toxicity_ordinal.score(odd, toxicity_ordinal.fit(odd, learn.limit(0))).collect())


# --- personal data ----------------------------------------------------------------------


def plain_spans(t):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii_boost.luhn(d)):
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(12)
    parts = ["@", ".", "..", "1", "255", "256", "007", "4111111111111111", "4111 1111-1111 1111", "+1 (229) 555-4838", "+", "(", ")", " ", "-", "a", "mail", "x.y", "é", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii_boost.base_spans(text) == plain_spans(text), text
    for text in ("1" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "a" * 200_000, "a@" * 50_000):  # linear time
        pii_boost.base_spans(text)


def test_trees_add_what_the_patterns_miss(spark, odd, none):
    rng = random.Random(13)

    def card():
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(digits + str(c) for c in range(10) if pii_boost.luhn(digits + str(c)))

    texts = []
    for i in range(300):
        value = rng.choice([card(), f"+1 ({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}", f"n{i}.{rng.randint(10, 99)}@mail{i % 9}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4))])
        texts.append(f"some words come before and at. Then {value} and after it come other words, version 2.0 and key = {rng.getrandbits(64):x}")
    finder = pii_boost.fit_texts(texts)
    number = card()
    base, spans = finder.find(f"call +1 (689) 555-1019 {number} now")
    assert base == [] and {(2, 23, 39), (3, 5, 22)} <= set(spans)
    assert finder.find("they meet at and. Of course at noon. In all")[1] == []
    text = f"a@b.de and {number}"
    assert pii_boost.redacted(text, finder.find(text)[1]) == "[EMAIL] and [CARD]"
    found = pii_boost.find(odd, finder, ["doc_id"], outputs=("n_email", "n_phone", "spans", "redacted")).collect()
    assert len(found) == len(odd_rows()) and next((r["n_email"], r["n_phone"]) for r in found if r["doc_id"] == 9) == (1, 1)
    assert {r["redacted"] for r in found if r["doc_id"] == 1} == {None}
    assert pii_boost.find(none, finder, ["doc_id"]).count() == 0 and pii_boost.fit(none).trees == {}


def test_personal_data_learns_from_whole_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):  # all values stand behind the first 2,000 characters
        value = f"n{i}@mail{i % 9}.example.com" if i % 2 else f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
        rows.append((i, "7 " + "words and more " * 200 + f"call {value} now, version 2.0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    finder = pii_boost.fit(docs.repartition(1))
    assert set(finder.trees) >= {3}
    other = pii_boost.fit(docs.repartition(5))
    assert other.thresholds == finder.thresholds
    for kind, trees in finder.trees.items():
        assert all(np.array_equal(a, b) for one, two in zip(trees.splits, other.trees[kind].splits, strict=True) for a, b in zip(one, two))


def test_personal_data_uses_every_span(spark):
    """Every base span of every text is in four examples, or three where it can't be written otherwise."""
    docs = spark.createDataFrame([(i, f"mail a{i}@b.example.org or 4111 1111 1111 1111 " + "x" * 100) for i in range(1600)], "doc_id long, text string")
    rows = pii_boost.examples(docs).groupBy("kind", "true").count().collect()
    n = {(r["kind"], r["true"]): r["count"] for r in rows}
    assert n[2, 1] >= 1600 * 4  # as it is, in the two pairs with another value, written otherwise


# --- pipeline ---------------------------------------------------------------------------


def test_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{folder}/documents.parquet")
    docs_, kept = before, []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        docs_ = stage(spark, docs_, folder)
        if n < len(pipeline.STAGES) - 1:
            assert docs_.columns == before.columns
        kept.append(docs_.collect())
    toxic, near, private, mixed, last = kept
    rejected = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in toxic}
    assert {r["doc_id"] for r in near} == {r["class_id"] for r in ngram_join.join(before.filter(~before["doc_id"].isin(*rejected)) if rejected else before).collect()}
    assert len(private) == len(near) and not any(plain_spans(r["text"]) for r in private)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in private} and len(last) == len(mixed)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in last)
    assert pipeline.run(spark, folder).count() == len(last)
