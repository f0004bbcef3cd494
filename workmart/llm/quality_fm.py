"""Text quality by a factorisation machine.

Features of a text: its hashed words (their share of all words), and structure statistics and metadata (letter case,
punctuation, symbols, line ends, repeated words, word lengths, size, stated length), each cut into fixed bins, one
feature for each bin. The machine adds a weight for every feature and a low-rank interaction for every pair. All pairs
cost linear time: sum over pairs of <vi, vj> xi xj = 1/2 sum over factors of ((sum vif xi)^2 - sum vif^2 xi^2).

It's fitted on a bounded sample (`SAMPLE` labelled rows of either class, chosen by a hash of the id) by the driver, which
holds that many sparse rows; rows stand for all labelled rows of their class. Scoring is one pass without a shuffle; the
model has a fixed size.

Results for odd inputs: a null text is scored as an empty one, by its structure alone; null and other labels are left
out; without labels of both classes every score is the share of label 1 (1/2 without any); repeated rows have equal
scores. Extra columns stay. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from workmart.llm.common import Recent, arrow_map, labelled_sample, slices

SAMPLE, BITS, FACTORS, EPOCHS, KEPT_WORDS = 4000, 14, 8, 12, 60_000
#: Borders of the bins: shares, and sizes.
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
SIZES = np.array([0, 1, 3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 51200])
WORD_LENGTHS = np.array([1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 20])
BORDERS = [SHARES] * 14 + [SIZES] * 3 + [WORD_LENGTHS]
STARTS = np.concatenate(([0], np.cumsum([len(b) + 1 for b in BORDERS])))
WIDTH = (1 << BITS) + int(STARTS[-1])

#: Kinds of bytes: 0 others, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 . and ,, 7 ! and ?, 8 other ASCII marks, 9 beyond ASCII.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[128:] = 9
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r", 5), (b".,", 6), (b"!?", 7), (b"\"#$%&'()*+-/:;<=>@[\\]^_`{|}~", 8)):
    KINDS[list(_chars)] = _kind


def structure(raw: bytes, words: np.ndarray, distinct: int, most: float, stated: int | None) -> np.ndarray:
    """One number for each entry of BORDERS. words: buckets of the words in order."""
    n, k = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=10) / n
    again = float(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0.0
    lines = raw.split(b"\n")
    letters = max(1e-9, kinds[1] + kinds[2])
    alike = 1 - len(set(lines)) / len(lines)
    shares = [kinds[2] / letters, kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], distinct / k, again, most, alike, raw.count(b"|") / k, raw.count(b"!!") / k]
    return np.array([*shares, len(words), len(lines), -1 if stated is None else stated, (n - kinds[4] * n) / k])


class Features:
    def __init__(self):
        self.bucket_of = Recent(lambda w: xxhash.xxh3_64_intdigest(w.lower()) & ((1 << BITS) - 1), KEPT_WORDS)

    def of(self, text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of a text."""
        raw = (text or "").encode()
        parts = raw.split()
        words = np.fromiter(map(self.bucket_of.__getitem__, parts), dtype=np.int64, count=len(parts))
        counts = np.bincount(words, minlength=1 << BITS)
        own = np.flatnonzero(counts)
        tallies = counts[own]
        numbers = structure(raw, words, len(own), float(tallies.max() / len(words)) if len(words) else 0.0, stated)
        bins = np.array([STARTS[i] + np.searchsorted(b, x, side="right") for i, (b, x) in enumerate(zip(BORDERS, numbers))]) + (1 << BITS)
        # words have the same length as a vector in every text; a bin is 1
        weight = np.sqrt(tallies) / np.sqrt(max(1, len(words)))
        return np.concatenate((own, bins)), np.concatenate((weight, np.ones(len(bins))))


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, features: np.ndarray, values: np.ndarray) -> float:
        parts = self.v[features] * values[:, None]
        total = parts.sum(axis=0)
        return float(self.bias + self.w[features] @ values + 0.5 * (total @ total - np.einsum("ij,ij->", parts, parts)))


def fit_sample(features: list[np.ndarray], values: list[np.ndarray], marks: np.ndarray, importance: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, penalty: float = 2e-4) -> Machine:
    """AdaGrad on batches of the log loss."""
    rng = np.random.default_rng(11)
    w, v, bias = np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)), 0.0
    gw, gv, gb = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
    importance = importance / importance.mean()
    for _ in range(epochs):
        order = rng.permutation(len(marks))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            f, x = np.concatenate([features[i] for i in batch]), np.concatenate([values[i] for i in batch])
            sizes = np.array([len(features[i]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            parts = v[f] * x[:, None]
            total = np.add.reduceat(parts, starts)
            pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((parts**2).sum(axis=1), starts))
            z = bias + np.add.reduceat(w[f] * x, starts) + pairs
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - marks[batch]) * importance[batch] / len(batch)
            each = np.repeat(slope, sizes)
            own, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, weights=each * x, minlength=len(own)) + penalty * w[own]
            change = (np.repeat(total, sizes, axis=0) - parts) * (each * x)[:, None]
            dv = np.stack([np.bincount(place, weights=change[:, k], minlength=len(own)) for k in range(FACTORS)], axis=1) + penalty * v[own]
            gw[own] += dw**2
            gv[own] += dv**2
            gb += slope.sum() ** 2
            w[own] -= rate * dw / np.sqrt(gw[own])
            v[own] -= rate * dv / np.sqrt(gv[own])
            bias -= rate * slope.sum() / np.sqrt(gb)
    return Machine(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, per_class: int = SAMPLE) -> Machine:
    """keep: condition on doc_id for rows that may be learned from."""
    picked, sizes = labelled_sample(labels, label, per_class, keep)
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    flat = Machine(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)))
    if len(sizes) < 2:
        return flat
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"])

    def features(batches):
        maker = Features()
        for batch in slices(batches):
            made = [maker.of(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())],
                                             names=["doc_id", "label", "features", "vals"])

    found = arrow_map(sample.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "label"), features, "doc_id long, label int, features binary, vals binary").toPandas().sort_values("doc_id")
    marks = found["label"].to_numpy().astype(float)
    if len(set(marks)) < 2:
        return flat
    importance = np.where(marks == 1, sizes[1] / (marks == 1).sum(), sizes[0] / (marks == 0).sum())
    return fit_sample([np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in found["features"]], [np.frombuffer(b, dtype=np.float32).astype(float) for b in found["vals"]], marks, importance)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with score, in place of its text."""

    def run(batches):
        maker = Features()
        for batch in slices(batches):
            z = np.array([machine.raw(*maker.of(t.as_py(), c.as_py())) for t, c in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))])
            scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 2)] + [pa.array(scores, pa.float64())], names=names)

    kept = [c for c in docs.columns if c not in ("text", "score")]
    names = [*kept, "score"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + ["score double"])
    return arrow_map(docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("_text"), F.col("n_chars").cast("long").alias("_stated")), run, schema)
