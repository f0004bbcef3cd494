"""Toxicity by cumulative-link ordinal regression.

A text's severity is one of K ordered grades. One weight vector w over sparse text features is shared by K - 1 rising
thresholds: P(grade > k) = 1 / (1 + exp(θk - w·x)). The score is the expected severity, the sum of these probabilities.

Features are hashed words and hashed beginnings of words (4 to 7 letters; some languages put endings on a stem), counted
over the whole text. Only those stay that the labelled sample ties to a grade above 0 or to grade 0 beyond chance; the
others have weight 0. As the sum is linear, each word has one weight, which scoring looks up.

The given labels only tell toxic from clean. Grades are made of them: a model of two grades is fitted first, and toxic
texts are graded 1 to 3 by thirds of its evidence w·x; then all thresholds are fitted together.

The model is fitted on a bounded sample (`SAMPLE` labelled rows of either class, chosen by a hash of the id) on the
driver, which holds at most that many sparse rows. Scoring is one pass without a shuffle.

Results for odd inputs: null and empty texts have no feature and so the severity of no evidence; labels that are null or
no grade are left out; without labels of both classes no text has evidence and none is rejected; repeated rows have equal
scores. Extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import Recent, arrow_map, labelled_sample, slices

SAMPLE, BITS, GRADES, KEPT_WORDS = 3000, 20, 4, 60_000
PARTS = (4, 5, 6, 7)
#: A text is rejected where P(grade > 0) is at least this.
REJECT = 0.5


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings; none for what has no letter."""
    letters = word.decode(errors="ignore").casefold().strip(".,;:!?\"'()[]{}<>|*#%&$-_")
    if not letters or not any(c.isalpha() for c in letters):
        return ()
    mask = (1 << BITS) - 1
    return tuple({xxhash.xxh3_64_intdigest(s.encode()) & mask for s in [letters, *("^" + letters[:n] for n in PARTS if len(letters) >= n)]})


@dataclass
class Model:
    buckets: np.ndarray  # chosen features, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def evidence_of(self):
        table = dict(zip(self.buckets.tolist(), self.weights.tolist()))
        return Recent(lambda word: sum(table.get(b, 0.0) for b in word_features(word)), KEPT_WORDS)

    def above(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - evidence[:, None], -60, 60)))


def count_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of every feature of some texts."""
    known = Recent(word_features, KEPT_WORDS)
    rows, buckets, counts = [], [], []
    for i, text in enumerate(texts):
        found: Counter = Counter()
        for word, n in Counter((text or b"").split()).items():
            for b in known[word]:
                found[b] += n
        rows.append(np.full(len(found), i))
        buckets.append(np.fromiter(found.keys(), dtype=np.int64, count=len(found)))
        counts.append(np.fromiter(found.values(), dtype=np.float64, count=len(found)))
    empty = np.empty(0)
    return np.concatenate(rows or [empty]).astype(np.int64), np.concatenate(buckets or [empty]).astype(np.int64), np.concatenate(counts or [empty])


def choose(rows: np.ndarray, buckets: np.ndarray, marked: np.ndarray, least: float = 24.0) -> np.ndarray:
    """Features that toxic and other texts have in different shares: the likelihood ratio statistic is `least` or more (by chance, one in a million)."""
    size = 1 << BITS
    on = np.bincount(buckets[marked[rows]], minlength=size)
    off = np.bincount(buckets, minlength=size) - on
    n_on, n_off = marked.sum(), (~marked).sum()
    share, total = (on + off) / (n_on + n_off), np.zeros(size)
    for seen, expected in ((on, n_on * share), (off, n_off * share), (n_on - on, n_on * (1 - share)), (n_off - off, n_off * (1 - share))):
        total += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
    return np.flatnonzero(total >= least)


def fit_ordinal(rows, columns, counts, grades, importance, n_features: int, n_grades: int, rounds: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample's likelihood; thresholds are a first one and positive steps."""
    n = len(grades)
    w, free = np.zeros(n_features), np.concatenate(([1.0], np.zeros(n_grades - 2)))
    beyond = grades[:, None] > np.arange(n_grades - 1)[None, :]
    first, second, share = np.zeros(n_features + n_grades - 1), np.zeros(n_features + n_grades - 1), importance / importance.sum()
    for t in range(1, rounds + 1):
        steps = np.exp(free[1:])
        theta = free[0] + np.concatenate(([0.0], np.cumsum(steps)))
        evidence = np.bincount(rows, weights=counts * w[columns], minlength=n)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - evidence[:, None], -60, 60)))
        # P(grade) is a difference of neighbours; its gradient in the evidence and in each threshold
        upper, lower = np.concatenate((np.ones((n, 1)), p), axis=1), np.concatenate((p, np.zeros((n, 1))), axis=1)
        at = np.arange(n), grades
        own = np.maximum(upper[at] - lower[at], 1e-12)
        slope_up, slope_low = upper[at] * (1 - upper[at]), lower[at] * (1 - lower[at])
        by_evidence = -(slope_up - slope_low) / own * share
        by_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            by_theta[k] = np.sum(share * (np.where(grades == k + 1, slope_up, 0.0) - np.where(grades == k, slope_low, 0.0)) / own)
        by_w = np.bincount(columns, weights=counts * by_evidence[rows], minlength=n_features) + penalty * w / max(1, n_features) + penalty * 0.1 * np.sign(w)
        by_free = np.concatenate(([by_theta.sum()], [by_theta[k:].sum() * steps[k - 1] for k in range(1, n_grades - 1)]))
        gradient = np.concatenate((by_w, by_free))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, free = w - move[:n_features], free - move[n_features:]
    w[np.abs(w) < 0.02] = 0.0
    return w, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> Model:
    picked, sizes = labelled_sample(labels, label, per_class)
    if len(sizes) < 2:
        return Model(np.empty(0, dtype=np.int64), np.empty(0), np.arange(2.0, 2.0 + GRADES - 1))
    # at most 2 * per_class ids: their size is bounded by the parameter
    sample = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"])

    def features(batches):
        for batch in slices(batches):
            rows, buckets, counts = count_features([None if (v := t.as_py()) is None else v.encode() for t in batch.column(1)])
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            cut = lambda a, kind: pa.array([a[ends[i] : ends[i + 1]].astype(kind).tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cut(buckets, np.int32), cut(counts, np.float32)], names=["doc_id", "label", "buckets", "counts"])

    found = arrow_map(sample.select("doc_id", "text", "label"), features, "doc_id long, label int, buckets binary, counts binary").toPandas().sort_values("doc_id")
    if found["label"].nunique() < 2:
        return Model(np.empty(0, dtype=np.int64), np.empty(0), np.arange(2.0, 2.0 + GRADES - 1))
    buckets = [np.frombuffer(b, dtype=np.int32) for b in found["buckets"]]
    rows, counts = np.repeat(np.arange(len(found), dtype=np.int32), [len(b) for b in buckets]), np.concatenate([np.frombuffer(c, dtype=np.float32) for c in found["counts"]])
    marked = found["label"].to_numpy() == 1
    del found
    return fit_sample(rows, np.concatenate(buckets), counts, marked, sizes)


def fit_sample(rows, buckets, counts, marked: np.ndarray, sizes: dict[int, int]) -> Model:
    """sizes: labelled rows of either class; sampled rows stand for all of their class."""
    chosen = choose(rows, buckets, marked)
    known = np.zeros(1 << BITS, dtype=bool)
    known[chosen] = True
    inside = known[buckets]
    rows, columns, counts = rows[inside], np.searchsorted(chosen, buckets[inside]), counts[inside].astype(float)
    importance = np.where(marked, sizes[1] / marked.sum(), sizes[0] / (~marked).sum())
    w, theta = fit_ordinal(rows, columns, counts, marked.astype(int), importance, len(chosen), 2)
    evidence = np.bincount(rows, weights=counts * w[columns], minlength=len(marked))
    thirds = np.quantile(evidence[marked], [1 / 3, 2 / 3])
    grades = np.where(marked, 1 + np.searchsorted(thirds, evidence, side="right"), 0)
    w, theta = fit_ordinal(rows, columns, counts, grades, importance, len(chosen), GRADES)
    return Model(chosen, w, theta)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with severity (expected, 0 to K - 1), p_toxic (P(grade > 0)), grade (the likeliest) and rejected."""

    def run(batches):
        evidence_of = model.evidence_of()
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            evidence = np.array([sum(map(evidence_of.__getitem__, t.as_py().encode().split())) if t.is_valid else 0.0 for t in texts])
            p = model.above(evidence)
            chance = np.concatenate((np.ones((len(p), 1)), p), axis=1) - np.concatenate((p, np.zeros((len(p), 1))), axis=1)
            made = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + made, names=names)

    own = ("severity", "p_toxic", "grade", "rejected")
    kept = [c for c in docs.columns if c not in own]
    names = [*kept, *own]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + ["severity double", "p_toxic double", "grade int", "rejected boolean"])
    return arrow_map(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")), run, schema)
