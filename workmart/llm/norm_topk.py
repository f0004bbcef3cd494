"""Exact top-k search by inner product over vectors grouped by length.

Vectors are put into bands of falling length; long bands are cut into blocks. A query first learns a lower bound θ of
its k-th best score from a bounded sample of the band of the longest vectors. A band whose longest vector l can't reach it, |q| l < θ, is
never visited. In a visited band the local threshold is the cosine θ / (|q| l): where it's high, candidates are pruned by
coordinates, that is by their product over the query's few largest coordinates plus the Cauchy-Schwarz bound of the rest;
where it's low, only by length, |p| >= θ / |q|. What remains is verified by its full product. Ties at θ are never pruned, so
the result is exact.

Components are floor(64 x). Products are computed in double precision while all sums are below 2^53, and in whole
numbers of any size otherwise; scores beyond the range of a long become its ends.

Results for odd inputs: vectors that are null, of another length than most, or hold null or non-finite components take no
part, nor rows without an id; zero vectors do, with score 0; fewer candidates than k give fewer rows; an id that several
rows have asks once, none of its rows is a candidate for it, and each row is one for others; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import sample_rows, store
from workmart.llm.vectors import best, queries_of, ranked, squared, usable

SCALE, SEEDS, BANDS, BLOCK, QUERY_BLOCK, FOCUS, STEEP, CHUNK = 64, 4096, 256, 16_384, 2_048, 4, 0.6, 256
FOUND = "query_id long, vec_id long, score long"


def whole(column) -> np.ndarray:
    """Integers as doubles (exact, as they come from floor) or, if too large for exact sums, as Python integers."""
    m = np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.float64)
    if m.size and np.abs(m).max() ** 2 * m.shape[1] >= 2**53:
        return np.array([[int(x) for x in row] for row in m], dtype=object)
    return m


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of a and of b."""
    if a.dtype == object or b.dtype == object or (a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53):
        as_int = lambda m: m if m.dtype == object else np.array([[int(x) for x in row] for row in m], dtype=object)
        return np.array([[min(max(sum(x * y for x, y in zip(r, s)), -(2**63)), 2**63 - 1) for s in as_int(b)] for r in as_int(a)], dtype=object)
    return a @ b.T


def lower_bounds(query_ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds; minus infinity if there are fewer."""
    found = []
    for at in range(0, len(q), CHUNK):
        s = products(q[at : at + CHUNK], seeds).astype(np.float64)
        s[query_ids[at : at + CHUNK, None] == seed_ids[None, :]] = -np.inf
        found.append(np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf))
    return np.concatenate(found) if found else np.empty(0)


def candidates(p: np.ndarray, lengths: np.ndarray, q: np.ndarray, q_length: float, bound: float) -> np.ndarray:
    """Places of the band's vectors that may reach `bound`. p: one row for each coordinate; lengths fall."""
    if bound == -np.inf or q_length == 0:
        return np.arange(p.shape[1]) if bound <= 0 else np.empty(0, dtype=np.int64)
    slack = 1e-9 * max(abs(bound), q_length * lengths[0])
    end = int(np.searchsorted(-lengths, -(bound - slack) / q_length, side="right")) if bound > 0 else p.shape[1]
    if end == 0 or bound / (q_length * lengths[0]) < STEEP:
        return np.arange(end)
    focus = np.argpartition(-np.abs(q), min(FOCUS, len(q)) - 1)[:FOCUS]
    part, rest = q[focus] @ p[focus, :end], np.sqrt(max(q_length**2 - float(q[focus] @ q[focus]), 0.0))
    reach = part + rest * np.sqrt(np.maximum(lengths[:end] ** 2 - (p[focus, :end] ** 2).sum(axis=0), 0.0))
    return np.flatnonzero(reach >= bound - slack)


def verify(ids: np.ndarray, p: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of each query among one block's rows that reach its bound."""
    lengths = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    ids, p, lengths = ids[order], p[order], lengths[order]
    columns, q_lengths = np.ascontiguousarray(p.astype(np.float64).T), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    out = []
    for n in range(len(q)):
        at = candidates(columns, lengths, q[n].astype(np.float64), float(q_lengths[n]), float(bounds[n]))
        at = at[ids[at] != query_ids[n]]
        if not len(at):
            continue
        scores = products(q[n : n + 1], p if len(at) == len(p) else p[at])[0]
        scores = np.array(scores.tolist(), dtype=np.int64) if scores.dtype == object else scores.astype(np.int64)
        good = np.flatnonzero(scores >= bounds[n])
        at, scores = at[good], scores[good]
        if len(at) > k:
            floor = np.partition(scores, -k)[-k]
            some = np.flatnonzero(scores >= floor)
            at, scores = at[some], scores[some]
        top = np.lexsort((ids[at], np.invert(scores)))[:k]  # falling; the least long has no negative
        out.append((np.full(len(top), query_ids[n]), ids[at[top]], scores[top]))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3


def search(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of every row whose id is divisible by `every`."""
    rows = usable(vectors, zero=True, id=id, vector=vector)
    # floor of a double is a whole double; F.floor would give a long, which may be too small
    floored = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    rows = rows.select("id", floored.alias("v")).withColumn("n2", squared("v"))
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # borders of the bands: quantiles of the length, at most BANDS of them
    wanted = min(BANDS, -(-n // BLOCK))
    borders = sorted(set(rows.approxQuantile("n2", [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    band = F.lit(0)
    for b in borders:
        band = band + F.when(F.col("n2") > b, 1).otherwise(0)
    rows = store(rows.withColumn("band", band))
    facts = rows.groupBy("band").agg(F.max("n2").alias("longest"), F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")).collect()
    longest, pieces = {r["band"]: float(np.sqrt(r["longest"])) for r in facts}, {r["band"]: r["nb"] for r in facts}
    top = max(facts, key=lambda r: r["band"])
    seed_rows = sample_rows(rows.filter(F.col("band") == top["band"]).select("id", "v"), ["id"], SEEDS, top["n"]).collect()
    seed_ids, seeds = np.array([r["id"] for r in seed_rows], dtype=np.int64), whole([r["v"] for r in seed_rows])
    queries = queries_of(rows.select("id", "v"), every)

    def route(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = whole(pdf["v"])
            lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            bounds = lower_bounds(pdf["id"].to_numpy(), q, seed_ids, seeds, k)
            for b, l in longest.items():
                near = bounds <= lengths * l * (1 + 1e-9) + 1e-6
                if near.any():
                    yield pdf[near].assign(bound=bounds[near], band=np.int32(b), nb=np.int32(pieces[b]))

    routed = store(queries.mapInPandas(route, "id long, v array<double>, bound double, band int, nb int"))
    parts = routed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
    block = F.pmod(F.xxhash64("id", "v"), F.col("nb")).cast("int")
    sizes = vectors.sparkSession.createDataFrame([(b, nb) for b, nb in pieces.items()], "band int, nb int").join(parts, "band")
    left = rows.join(sizes, "band").select("band", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("a"), "id", "v")
    right = routed.join(parts, "band").select("band", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("id", F.lit(4)), F.col("nq")).cast("int").alias("a"), "id", "v", "bound")

    def probe(rows_, asked):
        found = verify(rows_["id"].to_numpy(), whole(rows_["v"]), asked["id"].to_numpy(), whole(asked["v"]), asked["bound"].to_numpy(), k) if len(rows_) and len(asked) else (np.empty(0, dtype=np.int64),) * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = left.groupBy("band", "b", "a").cogroup(right.groupBy("band", "b", "a")).applyInPandas(probe, FOUND)
    return ranked(found, k)
