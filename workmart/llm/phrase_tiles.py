"""Phrase collocations by direct-address tiling of frequency-ranked word ids.

Texts are lower-cased (A-Z only), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words at `[\\x20\\x09]+`, per
lang (null: `und`). Only words that occur `least` times or more can be in a phrase that does, so they alone get ids:
ranked by frequency (descending classes of powers of two of their count; within a class by a hash-cut order), so that
the most frequent words have the smallest ids. If there are at most SHIPPED of them (a count checks it), the table goes
to the tasks, which read the texts and turn words into ids themselves, so that no word occurrence is shuffled; beyond,
texts are cut into chunks of about BUCKET words, each chunk's distinct words are joined with the table, and each text becomes
an array of ids (-1 for the other words and after each piece) by the dictionary of its chunk alone.

Pairs of neighbouring ids are counted inside tasks, in tiles of the id plane: the tile of the `dense` most frequent ids
(where nearly all pairs fall) with a dense numpy bincount, the others as sorted coordinate lists (np.unique of packed
pair codes). Tasks send their partial counts in buckets, each as a sorted list of differences in compressed byte planes
(about two bytes for a pair), and a bucket is added up where it arrives. Pairs that reach `least` are ranked again by
frequency and get ids of their own; a phrase of three words is the pair (id of its first two words, id of its third
word) and is counted in the same tiles. If there are at most SHIPPED frequent pairs, the table goes to the tasks, which
leave out phrases with another pair; beyond, a task gives the pairs it holds ids of its own, and sends all phrases of
known words, without a join: those that reach `least` have frequent pairs. So no text phrase is ever shuffled, only ids
and counts.

A candidate is a phrase of two or three words with a = f(phrase) >= `least`. Each cut after k words gives
l = f(first part), r = f(rest) and floor(1e6 a^2 / (l r)) in decimal(38, 0), which is exact (l, r >= a, so the score is at
most 1e6); the lowest cut counts, ties to the smallest k. A pair inside a three-word candidate (as its first or last
two words) with 2 f(longer) >= a is dropped. Each lang's first `top` by score descending, a descending, phrase
ascending (UTF-8 bytes) are found in two steps: first within hash cells of the phrase, then among the cells' best.

Results for odd inputs: a null text is empty; a null lang is `und`; repeated rows count each time; empty pieces and
texts have no words; an empty table gives an empty result. Only text and lang are read, so other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from workmart.llm.common import arrow_map, cells_for, slices, store, with_rank

# Fixed values of the contract: letters lower-cased, the lang of a null lang.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"
#: Ids below DENSE on both sides are counted in one dense DENSE x DENSE tile (8 MB of counters).
DENSE = 1024
#: A task's pairs are reduced to distinct pairs when it holds so many (8 bytes each, and as much again while a lang is sorted).
FLUSH = 2_000_000
#: Rows of the batches that a task sends back: a whole reduction in one batch is held again by the worker and by Spark.
SENT = 65_536
#: Word occurrences for each bucket of partial counts and each chunk of texts: what one call holds stays the same size at every scale.
BUCKET = 4_000_000
#: Cells of the first ranking step.
CELLS = 64
#: The frequent words and the frequent pairs are sent to the tasks if each has at most so many rows (checked by a count;
#: about 60 MB of words); beyond that, chunks of texts get their own words, and phrases are counted without the pairs.
SHIPPED = 2_000_000
#: Separators and letters in the bytes of a text, in tasks that read texts themselves: every piece separator becomes a full stop, a tab a
#: space, A-Z lower case.
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t" + UPPER.encode(), b"." * 9 + b" " + LOWER.encode())
#: Any separator, where only words are wanted.
BETWEEN = "[.,;:!?\\x0A-\\x0D\\x20\\x09]+"


def texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, _t (the text as it is)."""
    return docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))


def lowered() -> Column:
    return F.translate("_t", UPPER, LOWER)


def ranked(df: DataFrame, by: list[str], count: str, order: list[str], name: str) -> DataFrame:
    """Gapless ids from 0 within each value of `by`, more frequent first: classes of powers of two of `count` in
    descending order, within a class by `order` cut into cells, so that no class is one task."""
    classed = df.withColumn("_class", F.floor(F.log2(count)).cast("int"))
    placed = with_rank(classed, [*by, "_class"], order, cells_for(classed.count()), "_pos")
    before = W.partitionBy(*by).orderBy(F.desc("_class")).rowsBetween(W.unboundedPreceding, -1)
    offsets = classed.groupBy(*by, "_class").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(offsets, [*by, "_class"]).withColumn(name, (F.col("_off") + F.col("_pos")).cast("long")).drop("_class", "_pos", "_off")


def count_tile(codes: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (left << 32 | right) of the dense tile and their counts, from positions left * dense + right."""
    tile = np.bincount(codes, minlength=dense * dense)
    at = np.flatnonzero(tile)
    return at // dense << 32 | at % dense, tile[at]


def count_sorted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts; sorts `packed` in place, as np.unique holds copies."""
    packed.sort()
    new = np.ones(len(packed), dtype=bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return packed[first], np.diff(first, append=len(packed))


def split_pairs(left: np.ndarray, right: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids >= 0 and below 2^31: positions in the dense tile, and packed codes of the others."""
    inside = (left < dense) & (right < dense)
    packed = left[~inside].astype(np.int64)
    packed <<= 32
    packed |= right[~inside]
    return left[inside].astype(np.int32) * np.int32(dense) + right[inside].astype(np.int32), packed


def count_pairs(lang: np.ndarray, left: np.ndarray, right: np.ndarray, dense: int = DENSE):
    """Distinct (lang, left, right) with their counts; ids >= 0 and below 2^31. The dense tile by bincount, the others
    as sorted coordinates."""
    out = []
    for code in np.unique(lang):
        mine = lang == code
        tile, others = split_pairs(left[mine], right[mine], dense)
        for codes, counts in (count_tile(tile, dense), count_sorted(others)):
            out.append((code, codes >> 32, codes & 0xFFFFFFFF, counts))
    return out


def _counts_batch(lang: str, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(left)), pa.array(left), pa.array(right), pa.array(counts, pa.int64())],
                                      ["lang", "left", "right", "c"])


def _pair_counter(left):
    """A function for mapInArrow that counts the pairs that `left(batch)` gives: (langs of its rows, row of each pair,
    left ids, right ids). Pairs are held by lang, packed; counts leave in batches of SENT rows."""

    def run(batches):
        tiles, others, held = {}, {}, 0

        def joined(parts, name):
            """One array of a lang's parts, which are let go."""
            return np.concatenate(parts.pop(name))

        def flush():
            for parts, count in ((tiles, count_tile), (others, count_sorted)):
                for name in list(parts):
                    codes, counts = count(joined(parts, name))
                    for at in range(0, len(codes), SENT):
                        some = codes[at:at + SENT]
                        yield _counts_batch(name, some >> 32, some & 0xFFFFFFFF, counts[at:at + SENT])

        for batch in slices(batches, 4096):
            langs, rows, a, b = left(batch)
            coded = langs.dictionary_encode()
            owner = coded.indices.to_numpy(zero_copy_only=False)[rows]
            for code, name in enumerate(coded.dictionary.to_pylist()):
                mine = owner == code
                for parts, codes in zip((tiles, others), split_pairs(a[mine], b[mine])):
                    if len(codes):
                        parts.setdefault(name, []).append(codes)
            held += len(a)
            if held >= FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _known_pairs(ids: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whether each word and its right neighbour are both known; `ok` is false at the last word of a row."""
    return ok[:-1] & (ids[:-1] >= 0) & (ids[1:] >= 0)


def _wide_counter(left):
    """`_pair_counter` for lefts of up to 62 bits (packed pairs): a reduction gives them ids of its own, the most
    frequent first, counts in the same tiles and gives the lefts back."""

    def run(batches):
        parts, held = {}, 0

        def flush():
            for name in list(parts):
                lefts, rights = (np.concatenate(x) for x in zip(*parts.pop(name)))
                keys, own, times = np.unique(lefts, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                for codes, count in zip(split_pairs(place[own], rights), (count_tile, count_sorted)):
                    codes, counts = count(codes)
                    for at in range(0, len(codes), SENT):
                        some = codes[at:at + SENT]
                        yield _counts_batch(name, keys[order[some >> 32]], some & 0xFFFFFFFF, counts[at:at + SENT])

        for batch in slices(batches, 4096):
            langs, rows, a, b = left(batch)
            coded = langs.dictionary_encode()
            owner = coded.indices.to_numpy(zero_copy_only=False)[rows]
            for code, name in enumerate(coded.dictionary.to_pylist()):
                mine = owner == code
                if mine.any():
                    parts.setdefault(name, []).append((a[mine], b[mine].astype(np.int32)))
            held += len(a)
            if held >= FLUSH // 2:  # a phrase takes twice the room of a pair
                yield from flush()
                held = 0
        yield from flush()

    return run


def _mixed(left: np.ndarray) -> np.ndarray:
    """31 bits that depend on all bits of `left`, so that buckets get equal shares whatever ids are frequent."""
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _ranks(left: np.ndarray) -> np.ndarray:
    """`left`, or, if it doesn't fit 31 bits, numbers in the same order that do."""
    return left if not len(left) or int(left.max()) < 1 << 31 else np.unique(left, return_inverse=True)[1]


def pack_counts(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: int):
    """(bucket, n, bytes) for each of 2^bits buckets with pairs: in order of left, differences of the left ids, what the
    bucket doesn't say of the right ids, and counts, as compressed byte planes. `left` < 2^62, `right` < 2^31."""
    low = (1 << bits) - 1
    bucket = (right + _mixed(left)) & low
    code = bucket << (63 - bits) | _ranks(left) << (32 - bits) | right >> bits
    order = np.argsort(code)
    bucket, left, right, counts = bucket[order], left[order], right[order] >> bits, counts[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    codec = pa.Codec("zstd", compression_level=1)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        planes = [x.view(np.uint8).reshape(end - start, -1).T.tobytes() for x in (
            np.diff(left[start:end], prepend=0), right[start:end].astype(np.uint32), counts[start:end].astype(np.uint32))]
        yield int(bucket[start]), end - start, codec.compress(b"".join(planes), asbytes=True)


def unpack_counts(bucket: int, n: int, held: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, counts as `pack_counts` got them."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(held, 16 * n, asbytes=True), np.uint8)
    whole = lambda at, kind: np.ascontiguousarray(raw[at * n:(at + kind().itemsize) * n].reshape(-1, n).T).view(kind).ravel().astype(np.int64)
    left = np.cumsum(whole(0, np.int64))
    return left, whole(8, np.uint32) << bits | (bucket - _mixed(left)) & ((1 << bits) - 1), whole(12, np.uint32)


def sum_counts(left: np.ndarray, right: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of their counts, if these reach `least`."""
    code = _ranks(left) << 32 | right
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.add.reduceat(counts[order], first) if len(first) else counts
    kept = total >= least
    at = order[first[kept]]
    return left[at], right[at], total[kept]


def _packer(count, bits: int):
    """A function for mapInArrow that packs the batches of `count` (a counter's function) when there are FLUSH pairs."""

    def run(batches):
        parts, held = {}, 0

        def flush():
            for name in list(parts):
                rows = list(pack_counts(*(np.concatenate(x) for x in zip(*parts.pop(name))), bits))
                for at in range(0, len(rows), 1024):
                    buckets, sizes, blobs = zip(*rows[at:at + 1024])
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(blobs)), pa.array(buckets, pa.int32()), pa.array(sizes, pa.int32()),
                                                      pa.array(blobs, pa.binary())], ["lang", "bucket", "n", "held"])

        for batch in count(batches):
            if batch.num_rows:
                parts.setdefault(batch.column("lang")[0].as_py(), []).append(tuple(batch.column(c).to_numpy() for c in ("left", "right", "c")))
            held += batch.num_rows
            if held >= FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _adder(least: int, bits: int):
    """A function for applyInArrow that adds up one bucket of a lang."""

    def run(key, table):
        found = [unpack_counts(key[1].as_py(), n, held, bits) for n, held in zip(table["n"].to_pylist(), table["held"].to_pylist())]
        left, right, c = sum_counts(*(np.concatenate(x) for x in zip(*found)), least)
        return pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(c)), left, right, c], ["lang", "left", "right", "c"])

    return run


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in a batch of texts, whether each has a right neighbour, and the row of each."""
    ids = batch.column("ids")
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]  # a slice's offsets start where it starts
    ok = np.ones(len(flat), dtype=bool)
    ok[offsets[1:] - 1] = False  # the last word of a row has no right neighbour
    return flat, ok, np.repeat(np.arange(len(ids)), np.diff(offsets))


def _neighbours(batch: pa.RecordBatch):
    """Pairs of neighbouring known ids within each piece."""
    ids, ok, owner = _ids_of(batch)
    keep = _known_pairs(ids, ok)
    return batch.column("lang"), owner[:-1][keep], ids[:-1][keep], ids[1:][keep]


def _threes(langs, ids: np.ndarray, ok: np.ndarray, owner: np.ndarray):
    """(packed pair of two known neighbours, id of the known third) within each piece."""
    both = _known_pairs(ids, ok)
    at = np.flatnonzero(both[:-1] & both[1:])
    return langs, owner[at], ids[at] << 32 | ids[at + 1], ids[at + 2]


def _neighbour_threes(batch: pa.RecordBatch):
    return _threes(batch.column("lang"), *_ids_of(batch))


def _given(batch: pa.RecordBatch):
    """Pairs given as columns left and right."""
    return batch.column("lang"), np.arange(batch.num_rows), batch.column("left").to_numpy().astype(np.int64), batch.column("right").to_numpy().astype(np.int64)


def _encoded(batch: pa.RecordBatch, words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of a batch's texts, each piece followed by -1, and the row of each. Separators are single bytes
    of UTF-8, and a full stop, which no word holds, is looked up as the end of a piece."""
    ids, sizes = [], []
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_t").cast(pa.binary()).to_pylist()):
        find, start = words.get(lang, {}).get, len(ids)
        ids.extend([find(w, -1) for w in text.translate(PLAIN).replace(b".", b" . ").split()])
        ids.append(-1)
        sizes.append(len(ids) - start)
    return np.array(ids, np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _shipped_pairs(words):
    """Reader of neighbouring known ids from texts, with the words sent to the tasks."""

    def read(batch):
        ids, rows = _encoded(batch, words.value)
        keep = (ids[:-1] >= 0) & (ids[1:] >= 0)
        return batch.column("lang"), rows[:-1][keep], ids[:-1][keep], ids[1:][keep]

    return read


def _shipped_threes(words):
    """Reader of (packed pair of two known neighbours, id of the third) from texts, with the words sent to the tasks."""

    def read(batch):
        ids, rows = _encoded(batch, words.value)
        return _threes(batch.column("lang"), ids, np.ones(len(ids), dtype=bool), rows)

    return read


def _shipped_triples(words, pairs):
    """Reader of (pair id of two known neighbours, id of the third) from texts, with words and pairs sent to the tasks. The
    last two words must be a frequent pair too."""

    def read(batch):
        ids, rows = _encoded(batch, words.value)
        at = np.flatnonzero(_known_pairs(ids, np.ones(len(ids), dtype=bool)))
        packed = ids[at] << 32 | ids[at + 1]
        coded = batch.column("lang").dictionary_encode()
        owner = coded.indices.to_numpy(zero_copy_only=False)[rows[at]]
        pid = np.full(len(ids), -1, np.int64)
        for code, lang in enumerate(coded.dictionary.to_pylist()):
            codes, ids_of = pairs.value.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            if len(codes):
                mine = owner == code
                found = np.minimum(np.searchsorted(codes, packed[mine]), len(codes) - 1)
                pid[at[mine]] = np.where(codes[found] == packed[mine], ids_of[found], -1)
        at = np.flatnonzero((pid[:-1] >= 0) & (pid[1:] >= 0))
        return batch.column("lang"), rows[at], pid[at], ids[at + 2]

    return read


def _chunk_ids(texts: pa.Table, words: pa.Table) -> pa.Table:
    """lang, ids: the texts of a chunk as ids of its words."""
    known, langs, ids = {}, [], []
    for lang, word, at in zip(words["_lang"].to_pylist(), words["word"].cast(pa.binary()).to_pylist(), words["id"].to_pylist()):
        known.setdefault(lang, {})[word] = at
    for batch in slices(texts.to_batches()):
        found, rows = _encoded(batch, known)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
        langs.append(batch.column("lang"))
        ids.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.int32())))
    return pa.table([pa.chunked_array(langs, pa.string()), pa.chunked_array(ids, pa.list_(pa.int32()))], ["lang", "ids"])


def encoded_texts(rows: DataFrame, vocabulary: DataFrame, words: int) -> DataFrame:
    """lang, ids: texts as ids, without sending the vocabulary. A chunk is a run of the stored rows, so that its distinct
    words are found where it is read; only these are joined, not the occurrences."""
    rows = store(rows.select(F.monotonically_increasing_id().alias("_row"), "lang", "_t"))  # row numbers must stay
    run = max(1, rows.count() * BUCKET // max(1, words))
    rows = rows.select(F.expr(f"_row div {run}").alias("_chunk"), "lang", "_t")
    needed = rows.select("_chunk", "lang", F.explode(F.split(lowered(), BETWEEN)).alias("word")).filter(F.col("word") != "").distinct()
    known = needed.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select(
        F.col("_chunk").alias("_of"), F.col("lang").alias("_lang"), "word", "id")
    return rows.groupBy("_chunk").cogroup(known.groupBy("_of")).applyInArrow(_chunk_ids, "lang string, ids array<int>")


def buckets_of(words: int) -> int:
    """Bits of a bucket's number, for so many word occurrences."""
    return min(20, max(0, (max(1, words) - 1) // BUCKET).bit_length())


def counted_pairs(df: DataFrame, counter, least: int, words: int) -> DataFrame:
    """lang, left, right, c of the pairs that occur `least` times or more: partial counts from every task, added up by bucket.
    `words` (occurrences in all) only sets the number of buckets."""
    bits = buckets_of(words)
    partial = arrow_map(df, _packer(counter, bits), "lang string, bucket int, n int, held binary")
    return partial.groupBy("lang", "bucket").applyInArrow(_adder(least, bits), "lang string, left long, right long, c long")


def frequent_pairs(df: DataFrame, reader, least: int, words: int) -> DataFrame:
    """Pairs that occur `least` times or more, with their ids. The counts are stored first: ranking reads them several times."""
    counts = store(counted_pairs(df, _pair_counter(reader), least, words))
    return store(ranked(counts, ["lang"], "c", ["left", "right"], "pid"))


def _exact(a: str, l: str, r: str) -> Column:
    """floor(1e6 a^2 / (l r)), exact."""
    big = "decimal(38,0)"
    return F.expr(f"(cast({a} as {big}) * cast({a} as {big}) * cast(1000000 as {big})) div (cast({l} as {big}) * cast({r} as {big}))").cast("long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` candidates, as the module says."""
    rows = texts(docs, text, lang)
    words_of = rows.select("lang", F.explode(F.split(lowered(), BETWEEN)).alias("word")).filter(F.col("word") != "")
    counts = store(words_of.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")))
    totals = counts.groupBy("lang").agg(F.sum("c").cast("long").alias("n"))
    vocabulary = store(ranked(counts.filter(F.col("c") >= least), ["lang"], "c", ["word"], "id"))
    occurrences = int(totals.agg(F.sum("n")).first()[0] or 0)
    context = docs.sparkSession.sparkContext
    if vocabulary.count() <= SHIPPED:
        known = {}
        for r in vocabulary.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        words, source = context.broadcast(known), rows
        pairs = frequent_pairs(rows, _shipped_pairs(words), least, occurrences)
    else:
        words, source = None, store(encoded_texts(rows, vocabulary, occurrences))
        pairs = frequent_pairs(source, _neighbours, least, occurrences)
    if words is not None and pairs.count() <= SHIPPED:
        table = {}
        for r in pairs.select("lang", (F.shiftleft("left", 32).bitwiseOR(F.col("right"))).alias("code"), "pid").toLocalIterator():
            table.setdefault(r["lang"], []).append((r["code"], r["pid"]))
        table = {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for k, v in table.items()}
        triples = store(counted_pairs(rows, _pair_counter(_shipped_triples(words, context.broadcast(table))), least, occurrences))
    else:
        threes = store(counted_pairs(source, _wide_counter(_neighbour_threes if words is None else _shipped_threes(words)), least, occurrences))
        halves = (F.shiftright("left", 32).alias("left"), F.col("left").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_second"))
        threes = threes.select("lang", *halves, F.col("right").alias("_third"), F.col("c").alias("_c"))
        triples = threes.withColumnRenamed("_second", "right").join(pairs.select("lang", "left", "right", "pid"), ["lang", "left", "right"]).select(
            "lang", F.col("pid").alias("left"), F.col("_third").alias("right"), F.col("_c").alias("c"))

    word_c = vocabulary.select("lang", "id", "c")
    pair_c = pairs.select("lang", "pid", "left", "right", "c")
    w1, w2, w3 = (word_c.select("lang", F.col("id").alias(f"_w{i}"), F.col("c").alias(f"_f{i}")) for i in (1, 2, 3))
    three = (triples.select("lang", F.col("left").alias("pid"), F.col("right").alias("_w3"), F.col("c").alias("a"))
             .join(pair_c.select("lang", "pid", F.col("left").alias("_w1"), F.col("right").alias("_w2"), F.col("c").alias("_f12")), ["lang", "pid"])
             .join(pair_c.select("lang", F.col("left").alias("_w2"), F.col("right").alias("_w3"), F.col("c").alias("_f23")), ["lang", "_w2", "_w3"])
             .join(w1, ["lang", "_w1"]).join(w3, ["lang", "_w3"]))
    best3 = F.least(F.struct(_exact("a", "_f1", "_f23").alias("s"), F.lit(1).alias("k")), F.struct(_exact("a", "_f12", "_f3").alias("s"), F.lit(2).alias("k")))
    three = store(three.select("lang", "_w1", "_w2", "_w3", "a", best3.alias("_cut"), "_f1", "_f23", "_f12", "_f3"))
    inside = three.select("lang", F.col("_w1").alias("left"), F.col("_w2").alias("right"), "a").unionByName(
        three.select("lang", F.col("_w2").alias("left"), F.col("_w3").alias("right"), "a")).groupBy("lang", "left", "right").agg(F.max("a").alias("_longer"))
    two = (pair_c.join(inside, ["lang", "left", "right"], "left").filter(F.col("_longer").isNull() | (2 * F.col("_longer") < F.col("c")))
           .select("lang", F.col("left").alias("_w1"), F.col("right").alias("_w2"), F.col("c").alias("a")).join(w1, ["lang", "_w1"]).join(w2, ["lang", "_w2"]))
    names = [vocabulary.select("lang", F.col("id").alias(f"_w{i}"), F.col("word").alias(f"_t{i}")) for i in (1, 2, 3)]
    two = two.join(names[0], ["lang", "_w1"]).join(names[1], ["lang", "_w2"]).select(
        "lang", F.concat_ws(" ", "_t1", "_t2").alias("phrase"), "a", F.col("_f1").alias("l"), F.col("_f2").alias("r"), _exact("a", "_f1", "_f2").alias("score"))
    three = three.join(names[0], ["lang", "_w1"]).join(names[1], ["lang", "_w2"]).join(names[2], ["lang", "_w3"]).select(
        "lang", F.concat_ws(" ", "_t1", "_t2", "_t3").alias("phrase"), "a", F.when(F.col("_cut.k") == 1, F.col("_f1")).otherwise(F.col("_f12")).alias("l"),
        F.when(F.col("_cut.k") == 1, F.col("_f23")).otherwise(F.col("_f3")).alias("r"), F.col("_cut.s").alias("score"))
    found = two.unionByName(three)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = found.withColumn("_cell", F.pmod(F.xxhash64("phrase"), F.lit(CELLS))).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_cell").orderBy(*order))).filter(F.col("_r") <= top)
    final = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return final.join(totals, "lang").select("lang", "rank", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
