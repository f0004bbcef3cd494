"""Approximate nearest neighbours by an adaptive dimension scan within inverted lists.

Nearness is the largest inner product. With one more coordinate, sqrt(M^2 - |x|^2) (M: the largest length), the largest
product is the smallest distance. All vectors are turned by one random rotation, after which any first d of the D
coordinates are a sample of the whole: distance^2 over d coordinates times D / d estimates the distance^2. In each probed
list a query's candidates are read in blocks of columns; after each block, those whose estimate is beyond the k-th best
distance so far by more than the test allows, d2 D / d > (1 + ε / sqrt(d))^2 r2, are abandoned. What is left has its
product computed on the original vectors in double precision.

Lists are the cells of centres fitted on a bounded sample (`SAMPLE` rows by a hash of the id); every row is in a list. The
number of probed lists is measured: for `TRIED` queries the exact neighbours are found in one pass over all rows, and the
fewest lists are probed that hold the wanted share of them. Long lists are cut into blocks, and so are a list's queries,
so a frequent vector is many tasks; each task sends k rows for a query.

Results for odd inputs: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor rows without an id; fewer candidates than k give fewer rows (none give none); an id that several rows
have asks once, none of its rows is a candidate for it, and each row is one for others; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import sample_rows, store
from workmart.llm.vectors import best, matrix, queries_of, ranked, squared, usable

SAMPLE, TRIED, COLUMNS, EPSILON, SHARE = 20_000, 200, 16, 2.1, 0.96
BLOCK, QUERY_BLOCK, SEEDS, CHUNK = 16_384, 2_048, 256, 128
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    centres: np.ndarray  # with the further coordinate
    rotation: np.ndarray
    longest2: float
    probes: int

    def further(self, x: np.ndarray) -> np.ndarray:
        """Rows with their further coordinate."""
        return np.concatenate((x, np.sqrt(np.maximum(self.longest2 - (x * x).sum(axis=1), 0.0))[:, None]), axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries have 0 there and are brought to the length M; that leaves the order of products as it is."""
        lengths = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.concatenate((q / lengths * np.sqrt(self.longest2), np.zeros((len(q), 1))), axis=1)

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(axis=1)[None, :] - 2 * x[a : a + 2048] @ centres.T).argmin(axis=1) for a in range(0, len(x), 2048)])
        sizes = np.bincount(near, minlength=n)
        sums = np.stack([np.bincount(near, weights=x[:, c], minlength=n) for c in range(x.shape[1])], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, product) of the k best found for each query among one block's rows."""
    full_x, full_q = index.further(x) @ index.rotation, index.asked(q) @ index.rotation
    dim = full_x.shape[1]
    order = np.argsort(((full_x - full_x.mean(axis=0)) ** 2).sum(axis=1), kind="stable")  # the middle of the block first: a fair first radius
    ids, x, full_x = ids[order], x[order], full_x[order]
    seeds = min(len(x), max(SEEDS, 4 * k))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), CHUNK):
        own, turned = slice(at, at + CHUNK), full_q[at : at + CHUNK]
        d2 = (turned**2).sum(axis=1)[:, None] + (full_x[:seeds] ** 2).sum(axis=1)[None, :] - 2 * turned @ full_x[:seeds].T
        d2[query_ids[own][:, None] == ids[None, :seeds]] = np.inf
        radius = np.partition(d2, k - 1, axis=1)[:, k - 1] if seeds >= k else np.full(len(turned), np.inf)
        keep_q, keep_c = np.nonzero(d2 <= radius[:, None])
        rest_q, rest_c, partial = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
        for low in range(0, dim, COLUMNS):
            cols = slice(low, min(low + COLUMNS, dim))
            if partial is None:
                a, b = turned[:, cols], full_x[seeds:, cols]
                part = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)
                d = cols.stop
                live = part * (dim / d) <= (1 + EPSILON / np.sqrt(d)) ** 2 * radius[:, None] if d < dim else part <= radius[:, None] * (1 + 1e-12)
                rest_q, rest_c = np.nonzero(live)
                partial = part[rest_q, rest_c]
                rest_c = rest_c + seeds
            else:
                partial = partial + ((turned[rest_q, cols] - full_x[rest_c, cols]) ** 2).sum(axis=1)
                d = cols.stop
                bound = (1 + EPSILON / np.sqrt(d)) ** 2 * radius[rest_q] if d < dim else radius[rest_q] * (1 + 1e-12)
                live = partial * (dim / d) <= bound
                rest_q, rest_c, partial = rest_q[live], rest_c[live], partial[live]
        pair_q, pair_c = np.concatenate((keep_q, rest_q)), np.concatenate((keep_c, rest_c))
        scores = np.einsum("ij,ij->i", q[own][pair_q], x[pair_c])
        other = query_ids[own][pair_q] != ids[pair_c]
        pair_q, pair_c, scores = pair_q[other], pair_c[other], scores[other]
        top = best(pair_q, ids[pair_c], scores, k)
        out.append((query_ids[own][pair_q[top]], ids[pair_c[top]], scores[top]))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)


def build(rows: DataFrame, queries: DataFrame, k: int, share: float = SHARE) -> tuple[Index, DataFrame] | None:
    """The index, and the rows with the list of each, stored."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(squared("v")).alias("longest")).first()
    if not facts["n"]:
        return None
    sample = np.array([r["v"] for r in sample_rows(rows, ["id"], SAMPLE, facts["n"]).collect()], dtype=np.float64)
    dim = sample.shape[1] + 1
    index = Index(np.empty((0, dim)), np.linalg.qr(np.random.default_rng(1).normal(size=(dim, dim)))[0], float(facts["longest"]), 1)
    lists = int(max(1, min(np.sqrt(facts["n"]), len(sample) / 32)))
    index.centres = fit_centres(index.further(sample), lists)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=index.nearest_lists(index.further(matrix(pdf["v"])), 1)[:, 0].astype("int32"))

    placed = store(rows.mapInPandas(assign, "id long, v array<double>, list int"))
    tried = sample_rows(queries, ["id"], TRIED, queries.count()).collect()
    if tried:
        index.probes = probes_for(index, placed, np.array([r["id"] for r in tried]), np.array([r["v"] for r in tried], dtype=np.float64), k, share)
    return index, placed


def probes_for(index: Index, placed: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int, share: float) -> int:
    """The fewest lists that hold `share` of the exact neighbours of some queries."""

    def exact(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids, scores = pdf["id"].to_numpy(), q @ matrix(pdf["v"]).T
            scores[query_ids[:, None] == ids[None, :]] = -np.inf
            at = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            for n in range(len(query_ids)):
                yield pd.DataFrame({"query_id": query_ids[n], "vec_id": ids[at[n]], "score": scores[n, at[n]], "list": pdf["list"].to_numpy()[at[n]]})

    found = placed.mapInPandas(exact, FOUND + ", list int").filter(F.col("score") > float("-inf"))
    found = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "list"))), 1, k).alias("near")).collect()
    order = {i: {int(c): n for n, c in enumerate(row)} for i, row in zip(query_ids.tolist(), index.nearest_lists(index.asked(q), len(index.centres)))}
    needed = np.sort([order[r["query_id"]][x["list"]] for r in found for x in r["near"]])
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)]) + 1 if len(needed) else 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    rows = usable(vectors, zero=False, id=id, vector=vector)
    queries = store(queries_of(rows, every))
    built = build(rows, queries, k, share)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, placed = built

    def route(batches):
        for pdf in batches:
            if len(pdf):
                lists = index.nearest_lists(index.asked(matrix(pdf["v"])), index.probes)
                yield pdf.assign(lists=list(lists.astype("int32")))

    routed = queries.mapInPandas(route, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    # one small row for each list: how many blocks its rows and its queries make
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")).withColumnRenamed("list", "_l")
    asked = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
    plan = store(blocks.join(asked, F.col("_l") == F.col("list")).select("list", "nb", "nq"))
    left = placed.join(plan, "list").select("list", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("a"), "id", "v")
    right = routed.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("id", F.lit(4)), F.col("nq")).cast("int").alias("a"), "id", "v")

    def probe(rows_, asked_):
        if not len(rows_) or not len(asked_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = scan(index, rows_["id"].to_numpy(), matrix(rows_["v"]), asked_["id"].to_numpy(), matrix(asked_["v"]), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = left.groupBy("list", "b", "a").cogroup(right.groupBy("list", "b", "a")).applyInPandas(probe, FOUND)
    return ranked(found, k)
