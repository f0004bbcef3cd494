"""Language identification by a bidirectional gated recurrent network over the bytes of a text.

The network reads UTF-8 bytes in both directions (one GRU each way, `HIDDEN` units, the byte's input weights are a
table of 256 rows) and labels every position with a distribution over the known langs, from both directions' states.
A document's distribution is the mean over all its positions; its lang is the most likely one and its score that
probability.

Training is numpy on the driver, by backpropagation through time with Adam, on a bounded sample: at most `per_lang`
documents of each lang, chosen by a hash of the id, and `windows` windows of `WINDOW` bytes of each, placed by a hash
(a shorter text is one shorter window). Every position of a window is labelled with its document's lang. The sample
is the only thing brought to the driver: at most langs x per_lang x windows x WINDOW bytes.

Prediction is a Spark job over all rows (mapInArrow): each whole text is cut into chunks of WINDOW bytes that are run
as one batch of sequences through both directions, so the work is linear in the bytes and no text is cut short; the
positions of all chunks are pooled per document. Chunks start with a zero state, so context crosses no chunk border.

Results for odd inputs: a null text, or one without any letter (\\p{L}), has lang_pred `und` and score 0.0; a null
lang is never learnt; an empty table gives an empty result; repeated rows get equal predictions; very long texts are
read whole. Extra columns stay; lang_pred and score replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import arrow_map, slices, unit_interval

HIDDEN = 16
#: Bytes of a training window and of a chunk in prediction.
WINDOW = 128
#: Bounds of the training sample (documented parameters): documents of each lang, windows of each document.
PER_LANG, WINDOWS = 300, 4
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.01, 11
#: Chunks run through the network together in prediction: few, as a step's arrays then stay in a core's own cache.
CHUNKS = 1024
UNKNOWN = "und"
GATES = 3


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]


def _init(langs: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in ("f", "b"):
        p[f"W{d}"] = (rng.standard_normal((256, GATES * hidden)) * 0.1).astype(np.float32)
        p[f"U{d}"] = (rng.standard_normal((hidden, GATES * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[f"n{d}"] = np.zeros(hidden, np.float32)
    p["V"] = (rng.standard_normal((2 * hidden, langs)) * 0.1).astype(np.float32)
    p["c"] = np.zeros(langs, np.float32)
    return p


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _states(p: dict, d: str, X: np.ndarray, mask: np.ndarray | None, reverse: bool):
    """States (T, B, H) of one direction, as _direction gives them, in less time: each gate has its own contiguous arrays,
    written in place; halving the sigmoids' inputs is part of the weights (exact, as 0.5 is a power of 2); no mask where
    all positions count (mask None)."""
    B, T = X.shape
    H = p[f"U{d}"].shape[0]
    half = np.array([0.5, 0.5, 1.0], p[f"W{d}"].dtype)[:, None, None]
    W, U = (np.ascontiguousarray(p[f"{k}{d}"].reshape(-1, GATES, H).transpose(1, 0, 2)) * half for k in "WU")
    bn, at = p[f"n{d}"], np.ascontiguousarray(X.T)
    h = np.zeros((B, H), W.dtype)
    states = np.empty((T, B, H), W.dtype)
    xs, hu = np.empty((GATES, B, H), W.dtype), np.empty((GATES, B, H), W.dtype)
    gates, (z, r, m), n = hu[:2], hu, xs[2]
    for t in (range(T - 1, -1, -1) if reverse else range(T)):
        np.take(W, at[t], axis=1, out=xs, mode="clip")  # bytes are never clipped; with "raise" `out` would be copied
        np.matmul(h, U, out=hu)
        gates += xs[:2]
        np.tanh(gates, out=gates)
        gates += 1.0
        gates *= 0.5
        m += bn
        m *= r
        n += m
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if mask is not None:
            np.copyto(new, h, where=mask[:, t:t + 1] <= 0)
        h = new
    return states


def _direction(p: dict, d: str, X: np.ndarray, mask: np.ndarray, reverse: bool):
    """States (T, B, H) of one direction over bytes X (B, T), and what the backward pass needs, in processing order; masked
    positions keep the state."""
    B, T = X.shape
    H = p[f"U{d}"].shape[0]
    W, U, bn = p[f"W{d}"], p[f"U{d}"], p[f"n{d}"]
    h = np.zeros((B, H), W.dtype)
    states, cache = np.empty((T, B, H), W.dtype), []
    for t in (range(T - 1, -1, -1) if reverse else range(T)):
        xs, hu = W[X[:, t]], h @ U
        z = _sigmoid(xs[:, :H] + hu[:, :H])
        r = _sigmoid(xs[:, H:2 * H] + hu[:, H:2 * H])
        m = hu[:, 2 * H:] + bn
        n = np.tanh(xs[:, 2 * H:] + r * m)
        step = (1 - z) * n + z * h
        on = mask[:, t:t + 1]
        new = on * step + (1 - on) * h
        cache.append((t, h, z, r, m, n))
        h = new
        states[t] = h
    return states, cache


def _direction_grad(p: dict, d: str, X: np.ndarray, mask: np.ndarray, cache, dstates: np.ndarray, g: dict):
    H = p[f"U{d}"].shape[0]
    U = p[f"U{d}"]
    carry = np.zeros_like(dstates[0])
    for t, h, z, r, m, n in reversed(cache):
        dnew = dstates[t] + carry
        on = mask[:, t:t + 1]
        dstep, dh = on * dnew, (1 - on) * dnew
        dn, dz = dstep * (1 - z), dstep * (h - n)
        dh = dh + dstep * z
        dan = dn * (1 - n * n)
        dm = dan * r
        dar, daz = dan * m * r * (1 - r), dz * z * (1 - z)
        dhu = np.concatenate([daz, dar, dm], axis=1)
        g[f"U{d}"] += h.T @ dhu
        g[f"n{d}"] += dm.sum(0)
        np.add.at(g[f"W{d}"], X[:, t], np.concatenate([daz, dar, dan], axis=1))
        carry = dh + dhu @ U.T


def logits(p: dict, X: np.ndarray, mask: np.ndarray):
    """Per-position scores (T, B, L) of bytes X (B, T), and what the backward pass needs."""
    H = p["Uf"].shape[0]
    fs, fc = _direction(p, "f", X, mask, False)
    bs, bc = _direction(p, "b", X, mask, True)
    return fs @ p["V"][:H] + bs @ p["V"][H:] + p["c"], (fs, fc, bs, bc)


def _softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def loss_and_grad(p: dict, X: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Mean cross entropy over the unmasked positions, each labelled y (B,), and its gradient."""
    H = p["Uf"].shape[0]
    out, (fs, fc, bs, bc) = logits(p, X, mask)
    prob = _softmax(out.astype(np.float64))
    weight = mask.T[:, :, None] / max(1.0, float(mask.sum()))
    loss = -float((np.log(np.take_along_axis(prob, np.broadcast_to(y[None, :, None], prob.shape[:2] + (1,)), -1) + 1e-12) * weight).sum())
    dout = prob
    dout[np.arange(prob.shape[0])[:, None], np.arange(prob.shape[1])[None, :], y[None, :]] -= 1.0
    dout = (dout * weight).astype(p["V"].dtype)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["V"][:H] = np.einsum("tbh,tbl->hl", fs, dout)
    g["V"][H:] = np.einsum("tbh,tbl->hl", bs, dout)
    g["c"] = dout.sum((0, 1))
    _direction_grad(p, "f", X, mask, fc, dout @ p["V"][:H].T, g)
    _direction_grad(p, "b", X, mask, bc, dout @ p["V"][H:].T, g)
    return loss, g


def train(windows: list[bytes], labels: list[int], langs: int, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> dict:
    """Parameters fitted by Adam on windows of bytes, each with its lang's number."""
    p, rng = _init(langs, seed=seed), np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    X, mask = _pack(windows)
    y, step = np.asarray(labels, np.int64), 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(windows)), max(1, -(-len(windows) // batch))):
            if not len(at):
                continue
            _, g = loss_and_grad(p, X[at], mask[at], y[at])
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _pack(pieces: list[bytes], width: int = WINDOW):
    X, mask = np.zeros((len(pieces), width), np.int64), np.zeros((len(pieces), width), np.float32)  # masks of float32 keep the states' type
    for i, b in enumerate(pieces):
        X[i, :len(b)] = np.frombuffer(b, np.uint8)
        mask[i, :len(b)] = 1.0
    return X, mask


def fit(docs: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    """A model from the texts and non-null langs of `docs` (the caller leaves out what may not be learnt)."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(F.col(id).alias("_id"), F.col(lang).alias("_lang"), F.encode(F.col(text), "UTF-8").alias("_b"))
    sizes = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    picked = known.filter(unit_interval("_id", "_b", seed=5) <= share[F.col("_lang")])
    at = F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("_w")
    start = F.floor(unit_interval("_id", "_w", seed=6) * F.greatest(F.lit(0), F.length("_b") - WINDOW + 1)).cast("int")
    rows = picked.select("_id", "_lang", "_b", at).withColumn("_s", start).select("_lang", F.expr(f"substring(_b, _s + 1, {WINDOW})").alias("window")).collect()
    return Model(langs, train([bytes(r["window"]) for r in rows], [langs.index(r["_lang"]) for r in rows], len(langs)))


def _distributions(p: dict, X: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Distributions (L, T, B) of the positions of X (B, T). Langs come first, so that what runs over them runs over whole arrays."""
    H, (B, T) = p["Uf"].shape[0], X.shape
    out = p["V"][:H].T @ _states(p, "f", X, mask, False).reshape(-1, H).T
    out += p["V"][H:].T @ _states(p, "b", X, mask, True).reshape(-1, H).T
    out += p["c"][:, None]
    out -= out.max(0)
    np.exp(out, out=out)
    out /= out.sum(0)
    return out.reshape(-1, T, B)


def pooled(p: dict, texts: list[bytes | None], width: int = WINDOW, chunks: int = CHUNKS) -> np.ndarray:
    """Mean distribution over all positions of each text (rows of zeros for empty ones)."""
    L = p["c"].shape[0]
    sums, counts = np.zeros((len(texts), L), np.float64), np.zeros(len(texts), np.float64)
    for short in (False, True):  # whole chunks run without a mask; only a text's last chunk can be short
        owner, parts = [], []
        for i, b in enumerate(texts):
            for at in range(0, len(b or b""), width):
                if (len(b) - at < width) == short:
                    owner.append(i)
                    parts.append(b[at:at + width])
        owner = np.asarray(owner, np.int64)
        for at in range(0, len(parts), chunks):
            X, mask = _pack(parts[at:at + chunks], width)
            prob = _distributions(p, X, mask if short else None)
            if short:
                prob *= mask.T
            np.add.at(sums, owner[at:at + chunks], prob.sum(1).T)
            np.add.at(counts, owner[at:at + chunks], mask.sum(1))
    return sums / np.maximum(counts, 1.0)[:, None]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, for every row, as the module says."""
    langs, params = model.langs, model.params
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], F.encode(F.col(text), "UTF-8").alias("_b"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_letters"))
    schema = inner.drop("_b", "_letters").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in slices(batches, 512):
            texts, letters = batch.column("_b").to_pylist(), batch.column("_letters").to_numpy(zero_copy_only=False)
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if langs:
                dist = pooled(params, [b if ok else None for b, ok in zip(texts, letters)])
                best = dist.argmax(1)
                for i in np.flatnonzero(letters):
                    pred[i], score[i] = langs[best[i]], float(dist[i, best[i]])
            rest = batch.drop_columns(["_b", "_letters"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*rest.schema.names, "lang_pred", "score"])

    found = arrow_map(inner, run, schema)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")
