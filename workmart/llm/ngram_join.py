"""Similarity join on word n-grams: MinHash banding, then full n-gram sets.

1. Each text gets a MinHash signature of its word 5-grams, cut into bands. Rows per band are as many, and bands just
   enough, as the wanted recall at the threshold asks for within a number of hashes.
2. Equal texts are one node with a number of copies. Band hashes are shuffled; every node of a bucket is tied to the
   bucket's first node, never to each other. The ties' connected components hold every candidate pair.
3. Components are cut into blocks of a bounded number of n-grams; every pair of blocks is one unit of work. In it an
   inverted index counts common n-grams of all pairs at once, so the full sets decide. A unit gives one row for each of
   its texts (its links, and the first text it's tied to), never a row for each pair.
4. The ties that hold are joined to classes.

So a frequent copy is one node, a large group of near copies is many units, and no row count grows with the square of a
group. Words are runs of characters other than ASCII white space, as they are written. A link joins two documents whose
n-gram sets have a Jaccard similarity of the threshold or more; documents with equal texts are linked.

Results for odd inputs: a text with fewer words than n has one n-gram, all its words; a text without a word, or a null
one, is linked to nothing and is a class of its own, also where it occurs several times; repeated rows are copies; the class
id is the smallest id in the class, null ids aside. Extra columns are left out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import Recent, arrow_map, slices, store

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 256
#: N-grams of a block: two blocks are in memory at once.
BLOCK = 1_000_000
KEPT_WORDS = 60_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands for the recall at the threshold need at most so many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd_numbers(n: int, seed: int, dtype) -> np.ndarray:
    rng, bits = random.Random(seed), np.dtype(dtype).itemsize * 8
    return np.array([rng.getrandbits(bits) | 1 for _ in range(n)], dtype=dtype)


class Shingler:
    def __init__(self, words: int = WORDS, bands: int = 1, rows: int = 1):
        self.n, self.bands, self.rows = words, bands, rows
        self.hash_of = Recent(xxhash.xxh3_64_intdigest, KEPT_WORDS)
        self.place = _odd_numbers(words, 1, np.uint64)
        self.a, self.b = _odd_numbers(bands * rows, 2, np.uint32)[:, None], _odd_numbers(bands * rows, 3, np.uint32)[:, None]
        self.row, self.band = _odd_numbers(rows, 4, np.uint64), _odd_numbers(bands, 5, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of the text's n-grams, in order, repeats included."""
        words = text.encode().split() if text else []
        hashes = np.fromiter(map(self.hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(hashes))
        if not n:
            return hashes
        total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for i in range(n):
            total += _mixed(hashes[i : len(total) + i] + self.place[i]) * self.place[i]
        return _mixed(total + np.uint64(n))

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(x), 2048):
            part = (self.a * x[None, at : at + 2048] + self.b).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        table = _mixed(least.astype(np.uint64)).reshape(self.bands, self.rows)
        return _mixed((table * self.row).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def _digest(text: str):
    return F.unhex(F.sha2(F.col(f"`{text}`"), 256))


#: Words of a sieve. Its size is fixed: with more texts than bits it lets all through, and the joins behind it do the work.
SIEVE = 1 << 17


def _places(digest: str) -> tuple:
    return F.expr(f"cast(pmod(xxhash64({digest}), {SIEVE}) as int)"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({digest}), 32), 64) as int))")


def sieve(df: DataFrame) -> DataFrame:
    """One bit for each digest of `df`, as at most SIEVE rows of 64 bits."""
    word, bit = _places("digest")
    return df.filter("digest is not null").groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def sifted(df: DataFrame, bits: DataFrame, digest: str) -> DataFrame:
    """`df` with _maybe: false where the digest is surely not among those of the sieve."""
    word, bit = _places(digest)
    joined = df.join(F.broadcast(bits), word == F.col("_word"), "left")
    return joined.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def signatures(docs: DataFrame, id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest, n (n-grams), bands, row (a number for each row), stored."""

    def run(batches):
        shingler = Shingler(words, bands, rows)
        for batch in slices(batches):
            sizes, found = [], []
            for value in batch.column(2):
                s = shingler.shingles(value.as_py())
                sizes.append(len(s))
                found.append(shingler.band_hashes(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "bands"])

    slim = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), _digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    return store(arrow_map(slim, run, "doc_id long, digest binary, n long, bands array<long>").withColumn("row", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes other than roots. edges: (a, b).

    Large and small stars by turns: every node passes its neighbours to the smallest one it knows. The number of edges never
    grows, and rounds grow with the logarithm of the nodes.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = large.join(least, large["a"] == least["k"])
        small = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = store(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _linked(mine: list[np.ndarray], others: list[np.ndarray], threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each of `mine`, which of `others` it's similar to. same: both are one list; a text isn't linked to itself."""
    sizes = np.array([len(o) for o in others])
    values, owners = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for i, own in enumerate(mine):
        first = np.searchsorted(values, own, "left")
        n = np.searchsorted(values, own, "right") - first
        ends = np.cumsum(n)
        if not ends[-1]:
            continue
        common = np.bincount(owners[np.repeat(first - (ends - n), n) + np.arange(ends[-1])], minlength=len(others))
        hit = common >= threshold * (len(own) + sizes - common)
        if same:
            hit[i] = False
        yield i, np.flatnonzero(hit)


def _verify(unit: list[tuple[int, int, int, np.ndarray]], i: int, j: int, threshold: float) -> tuple[list, list, list]:
    """unit: (block, node, copies, n-grams) of two blocks or one. For each node: links to other texts, and the smallest node it's tied to here."""
    unit = list({u[1]: u for u in sorted(unit, key=lambda u: u[:2])}.values())
    nodes, copies = [u[1] for u in unit], np.array([u[2] for u in unit])
    at = [[k for k, u in enumerate(unit) if u[0] == b] for b in (i, j)]
    parent, links = list(range(len(unit))), np.zeros(len(unit), dtype=np.int64)

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    if at[0] and at[1]:
        for own, hits in _linked([unit[k][3] for k in at[0]], [unit[k][3] for k in at[1]], threshold, i == j):
            a, others = at[0][own], np.array(at[1])[hits]
            links[a] += copies[others].sum()
            if i != j:
                links[others] += copies[a]
            for b in others.tolist():
                if (x := root(a)) != (y := root(b)):
                    parent[max(x, y)] = min(x, y)
    first: dict[int, int] = {}
    for k in sorted(range(len(unit)), key=nodes.__getitem__):
        first.setdefault(root(k), nodes[k])
    return nodes, links.tolist(), [first[root(k)] for k in range(len(unit))]


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """A row for each row of `docs`: doc_id, digest (of the text), class_id, n_links (other documents it's linked to), first (one row of each class)."""
    bands, rows = bands_for(threshold, recall, hashes)
    known = signatures(docs, id, text, words, bands, rows)
    nodes = store(known.filter("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
                  .select("digest", F.col("f.row").alias("node"), F.col("f.doc_id").alias("first_id"), "copies", "n"))
    banded = known.select("row", "bands").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    banded = store(banded)
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ties = banded.join(heads, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b"))
    roots = components(ties)
    member = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    member = store(member.join(nodes, "node").select("node", F.col("root").alias("part"), "digest", "first_id", "copies", "n"))
    cuts = member.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    member = store(member.join(cuts, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    # the texts of candidates are read again; only they are cut into n-grams for the test
    full = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), _digest(text).alias("_digest"), F.col(f"`{text}`").alias("text"))
    full = sifted(full, store(sieve(member)), "_digest").filter("_maybe")
    full = full.join(member, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("first_id")))

    def cut(batches):
        shingler = Shingler(words)
        for batch in slices(batches):
            sets = [np.unique(shingler.shingles(t.as_py())).tobytes() for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(sets, pa.binary())], names=["part", "block", "blocks", "node", "copies", "grams"])

    grams = arrow_map(full.select("part", "block", "blocks", "node", "copies", "text"), cut, "part long, block int, blocks int, node long, copies long, grams binary")
    units = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "grams")
    units = units.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def verify(batches):
        unit, key = [], None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            part, i, j, block, node, copies, sets = (batch.column(c) for c in range(7))
            for k, own in enumerate(zip(part.to_pylist(), i.to_pylist(), j.to_pylist())):
                if own != key:
                    if unit:
                        for o, v in zip(out, _verify(unit, key[1], key[2], threshold)):
                            o += v
                    unit, key = [], own
                unit.append((block[k].as_py(), node[k].as_py(), copies[k].as_py(), np.frombuffer(sets[k].as_py(), dtype=np.uint64)))
            yield _rows(out)
        if unit:
            yield _rows(_verify(unit, key[1], key[2], threshold))

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "links", "tied"])

    found = store(arrow_map(units, verify, "node long, links long, tied long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.filter("node <> tied").select(F.col("node").alias("a"), F.col("tied").alias("b")))
    placed = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    placed = placed.join(ids, "root").select("digest", "node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.withColumn("digest", F.when(F.col("n") > 0, F.col("digest"))).select("doc_id", "digest", "row").join(placed, "digest", "left")
    return out.select("doc_id", "digest", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      (F.col("root").isNull() | (F.col("row") == F.col("root"))).alias("first"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with the columns of `docs`; texts without a word all stay.

    Only texts that share a digest's place with a dropped one are shuffled.
    """
    found = store(join(docs, id, text))
    bits = store(sieve(found.filter("not first")))
    kept = found.filter("first").select(F.col("doc_id").alias("_kid"), F.coalesce("digest", F.lit(b"")).alias("_kdigest")).distinct()
    blank = F.trim(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    own = sifted(docs.withColumn("_own", F.when(blank, F.lit(b"")).otherwise(_digest(text))), bits, "_own")
    left = own.filter("_maybe").join(kept, F.col(f"`{id}`").cast("long").eqNullSafe(F.col("_kid")) & (F.col("_own") == F.col("_kdigest")), "left_semi")
    # rows that repeat id and text are copies too
    left = left.dropDuplicates([id, "_own"])
    return own.filter("not _maybe").unionByName(left).select(*docs.columns)
