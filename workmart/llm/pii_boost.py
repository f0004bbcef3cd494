"""Personal data by candidates and gradient boosting.

Plain rules give base spans (e-mail, IP, card, phone), which always stay. Besides them, generators with high recall
propose overlapping spans: every run of neighbouring digit groups that could be a card, a phone number or an address, also
inside a longer chain of digits that a plain rule takes as one and drops; and e-mail addresses whose signs are spelt out.
Boosted regression trees score each proposal from its format (digits, groups, separators, check digit, ...) and its
context (neighbouring characters and words). A threshold for each kind, calibrated on examples that were held back, selects
what is added; of overlapping proposals the best stays, and none overlaps a base span.

There are no labels of personal data. The trees learn from all documents: base spans are positive; so are the same values set
next to each other or written in other ways, at places that are then known; proposals that hit no such place, and values with a
wrong digit, are negative. Tasks make the examples and bin them; for each level of a tree Spark sums the histograms of all
kinds over all examples, and the driver, which sees these sums alone, picks the splits. Borders of the bins come from counts of
all values, thresholds from counts of all scores held back. Sums are of whole numbers, so results don't depend on partitions.

All scanning is linear in the text's length. Results for odd inputs: a null text is an empty one and has no spans; digits
of any number in a row are scanned once; without base spans there are no positive examples, and base spans are the result; repeated rows have equal spans. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from workmart.llm.common import arrow_map, cells_for, slices, store, with_rank

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, RATE, PRECISION = 60, 4, 0.2, 0.98
#: Bins of a feature; a unit of the whole numbers that histograms sum; raw scores are counted in cells of 1 / CELL from -EDGE to EDGE.
BINS, UNIT, CELL, EDGE = 33, 1 << 20, 128, 32
#: Examples of a block and of a partition of blocks at most; trees after which the blocks' scores are kept anew.
BLOCK, PART, KEEP = 1 << 16, 200_000, 8

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]++")
BETWEEN = re.compile(r"[ ().\-/]{1,3}")
SIGN = re.compile(r" ?[\[(]at[\])] ?| at ", re.I)
REST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,6}", re.I)
GROUPS = 8  # digit groups of a proposal at most


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans, done = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            spans.append((0, start, m.end()))
            done = m.end()
        # the part before an @ ends where the last match ended; a domain without it is no match, and nothing in it holds an @
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                spans.append((1, at, at + size))
            at += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append((3, *m.span()))
    return spans


def spelt(text: str) -> list[tuple[int, int, int]]:
    """Addresses with a spelt-out sign, also those that are plain prose."""
    found = []
    for m in SIGN.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        rest = REST.match(text, m.end()) if start < m.start() else None
        if rest:
            found.append((0, start, rest.end()))
    return found


def proposals(text: str) -> list[tuple[int, int, int]]:
    found = spelt(text)
    groups = [m.span() for m in GROUP.finditer(text)]
    for i, (start, _) in enumerate(groups):
        n, dots = 0, 0
        for k in range(i, min(i + GROUPS, len(groups))):
            if k > i:
                gap = text[groups[k - 1][1] : groups[k][0]]
                if len(gap) > 3 or not BETWEEN.fullmatch(gap):
                    break
                dots += gap == "."
            n += groups[k][1] - groups[k][0]
            if n > 19:
                break
            end = groups[k][1]
            if k - i == 3 and dots == 3 and n <= 12:
                found.append((1, start, end))
            if n >= 13:
                found.append((2, start, end))
            if 7 <= n <= 15:
                first = start
                while first > 0 and text[first - 1] in "+(" and start - first < 3:
                    first -= 1
                found.append((3, first, end))
    return found


def _kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "=\"':" else 5 if c in ".,;!?)" else 6


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in GROUP.findall(span)]
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    before = left.rsplit(None, 1)[-1] if left.strip() and not left[-1:].isspace() else (left.split() or [""])[-1]
    after = (right.split() or [""])[0]
    octets = [int(g) for g in GROUP.findall(span)[:4] if len(g) <= 3]
    return [len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
            float(luhn(digits)) if digits else -1, int(digits[0]) if digits else -1, span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("("),
            float(span[:1] == "+"), float(span.count("(") == span.count(")")), max(octets, default=-1) if len(octets) == len(groups) else 999,
            _kind_of(left[-1:]), _kind_of(right[:1]), float(bool(re.search(r"[0-9][ ().\-/]{0,3}$", left))), float(bool(re.match(r"[ ().\-/]{0,3}[0-9]", right))), float(left[-1:] == "+" or left[-1:] == "("),
            float(any(c.isdigit() for c in before)), float(any(c.isdigit() for c in after)), len(before), len(after), span.lower().count("at"), span.lower().count("dot"), float("[" in span or "(" in span),
            float(bool(re.search(r"\.[A-Za-z]{2,6}$|dot\W? ?[A-Za-z]{2,6}$", span))), float(before[-1:] == "=")]


@dataclass
class Trees:
    """Boosted regression trees of one depth over binned features: node n has the children 2n + 1 and 2n + 2."""

    start: float = -8.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, border, leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, border, leaves in self.splits:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > border[node])
            z += leaves[node - (2**DEPTH - 1)]
        return z


def borders_of(counts: dict[tuple[int, int], dict[float, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Up to 31 quantiles for each (kind, feature) from the counts of its values."""
    made = {}
    for key, seen in counts.items():
        values = np.array(sorted(seen))
        upto = np.cumsum([seen[v] for v in values.tolist()])
        at = np.floor(np.linspace(0, 1, BINS)[1:-1] * (upto[-1] - 1))
        made[key] = np.unique(values[np.searchsorted(upto, at, side="right")])
    return made


def binned(kind: np.ndarray, held: np.ndarray, true: np.ndarray, x: np.ndarray, borders: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """A block: one row of bytes for each example (kind, held back, true, bins); x > border j is bin > j."""
    block = np.empty((len(x), 3 + x.shape[1]), dtype=np.uint8)
    block[:, 0], block[:, 1], block[:, 2] = kind, held, true
    for k in np.unique(kind).tolist():
        own = kind == k
        for f in range(x.shape[1]):
            block[own, 3 + f] = np.searchsorted(borders.get((k, f), np.zeros(0)), x[own, f], side="left")
    return block


#: One tree for all kinds: feature and border (a bin) of each kind's inner nodes, and leaves.
Layer = tuple[np.ndarray, np.ndarray, np.ndarray]


def _nodes(block: np.ndarray, feature: np.ndarray, border: np.ndarray, levels: int) -> np.ndarray:
    kind, rows, node = block[:, 0], np.arange(len(block)), np.zeros(len(block), dtype=np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (block[rows, 3 + feature[kind, node]] > border[kind, node])
    return node


def _grown(block: np.ndarray, z: np.ndarray, layers: list[Layer]) -> np.ndarray:
    for feature, border, leaves in layers:
        z = z + leaves[block[:, 0], _nodes(block, feature, border, DEPTH) - (2**DEPTH - 1)]
    return z


def _histogram(block: np.ndarray, z: np.ndarray, feature: np.ndarray, border: np.ndarray, level: int) -> np.ndarray:
    """Slopes and bends of the log loss by kind, node of the level, feature and bin, in whole units, of what isn't held back."""
    learnt = block[:, 1] == 0
    block, z = block[learnt], z[learnt]
    width, places = block.shape[1] - 3, 2**level
    p = 1 / (1 + np.exp(-z))
    slope, bend = np.rint((block[:, 2] - p) * UNIT), np.maximum(np.rint(p * (1 - p) * UNIT), 1)
    place = (block[:, 0].astype(np.int64) * places + _nodes(block, feature, border, level) - (places - 1)) * BINS
    size = len(KINDS) * places * BINS
    sums = [[np.bincount(place + block[:, 3 + f], weights=w, minlength=size) for f in range(width)] for w in (slope, bend)]
    return np.array(sums).reshape(2, width, len(KINDS), places, BINS)


def _held_scores(block: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Examples held back by kind, truth and cell of the score."""
    held = block[:, 1] == 1
    cells = 2 * EDGE * CELL
    at = np.clip(np.floor((z[held] + EDGE) * CELL), 0, cells - 1).astype(np.int64)
    key = (block[held, 0].astype(np.int64) * 2 + block[held, 2]) * cells + at
    return np.bincount(key, minlength=len(KINDS) * 2 * cells).reshape(len(KINDS), 2, cells)


class Here:
    """Blocks in memory."""

    def __init__(self, blocks: list[np.ndarray], start: np.ndarray):
        self.start, self.blocks = start, blocks
        self.kept = [start[b[:, 0]] for b in blocks]

    def total(self, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return sum(make(b, z) for b, z in zip(self.blocks, self.kept))

    def keep(self, layers: list[Layer]) -> None:
        self.kept = [_grown(b, self.start[b[:, 0]], layers) for b in self.blocks]


class Spread:
    """Blocks of all tasks, summed by Spark."""

    def __init__(self, blocks: RDD, start: np.ndarray):
        self.start, self.blocks = start, blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept: RDD | None = None
        self.keep([])

    def total(self, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return self.kept.treeAggregate(0, lambda found, row: found + make(*row), lambda a, b: a + b)

    def keep(self, layers: list[Layer]) -> None:
        before, start = self.kept, self.start
        self.kept = self.blocks.map(lambda b: (b, _grown(b, start[b[:, 0]], layers))).persist(StorageLevel.MEMORY_AND_DISK)
        if before is not None:
            before.unpersist()

    def end(self) -> None:
        self.kept.unpersist()
        self.blocks.unpersist()


def boost(blocks: Here | Spread, borders: dict[tuple[int, int], np.ndarray], kinds: list[int], width: int, precision: float, trees: int = TREES) -> Finder:
    """Newton boosting of the log loss for all `kinds` at once, and for each the lowest threshold that is so precise on what was held back."""
    inner, layers, new = 2**DEPTH - 1, [], []
    for _ in range(trees):
        feature, border = np.zeros((len(KINDS), inner), dtype=np.int64), np.full((len(KINDS), inner), BINS, dtype=np.int64)
        leaves = np.zeros((len(KINDS), 2**DEPTH))
        for level in range(DEPTH):
            first, since = 2**level - 1, list(new)
            sums = blocks.total(lambda b, z: _histogram(b, _grown(b, z, since), feature, border, level)) / UNIT
            for k in kinds:
                g, h = sums[:, :, k].cumsum(axis=-1)  # feature, node, bin
                total_g, total_h = g[..., -1:], h[..., -1:]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                for f in range(width):
                    gain[f, :, len(borders.get((k, f), ())) :] = -1
                for place in range(2**level):
                    f, at = divmod(int(gain[:, place].argmax()), BINS)
                    if gain[f, place, at] > 1e-6:
                        feature[k, first + place], border[k, first + place] = f, at
                    else:
                        f, at = 0, BINS - 1  # no split: all go left
                    if level == DEPTH - 1:
                        left_g, left_h = g[f, place, at], h[f, place, at]
                        leaves[k, 2 * place] = RATE * left_g / (left_h + 1)
                        leaves[k, 2 * place + 1] = RATE * (g[f, place, -1] - left_g) / (h[f, place, -1] - left_h + 1)
        layers.append((feature, border, leaves))
        new.append(layers[-1])
        if len(new) == KEEP:
            blocks.keep(list(layers))
            new = []
    since = list(new)
    scores = blocks.total(lambda b, z: _held_scores(b, _grown(b, z, since)))
    models, thresholds = {}, {}
    for k in kinds:
        true, all_ = scores[k, 1, ::-1].cumsum(), scores[k].sum(axis=0)[::-1].cumsum()
        good = np.flatnonzero((true >= precision * all_) & (np.diff(all_, prepend=0) > 0))
        if len(good):
            cell = scores.shape[2] - 1 - good[-1]
            at = {f: np.append(borders.get((k, f), np.zeros(0)), np.inf) for f in range(width)}
            splits = [(f[k], np.array([at[i][min(j, len(at[i]) - 1)] for i, j in zip(f[k].tolist(), b[k].tolist())]), v[k]) for f, b, v in layers]
            models[k], thresholds[k] = Trees(float(blocks.start[k]), splits), max(float(cell / CELL - EDGE), 0.0)
    return Finder(models, thresholds)


def _starts(shown_: dict[tuple[int, int, int], int]) -> tuple[list[int], np.ndarray]:
    """From numbers of examples by (kind, held back, true): kinds with enough of them, and the log odds that trees start from."""
    kinds, start = [], np.zeros(len(KINDS))
    for k in range(len(KINDS)):
        n = {(h, t): shown_.get((k, h, t), 0) for h in (0, 1) for t in (0, 1)}
        if sum(n.values()) >= 40 and n[0, 1] >= 10 and n[1, 1] >= 3:
            share = min(max(n[0, 1] / (n[0, 0] + n[0, 1]), 1e-4), 1 - 1e-4)
            kinds.append(k)
            start[k] = float(np.log(share / (1 - share)))
    return kinds, start


@dataclass
class Finder:
    trees: dict[int, Trees]
    thresholds: dict[int, float]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Proposals that are good enough, best first, each clear of base spans and of better ones."""
        taken = sorted((s, e) for _, s, e in base)
        open_ = [p for p in proposals(text) if p[0] in self.trees and not _meets(taken, p[1], p[2])]
        scored = []
        for kind in {p[0] for p in open_}:
            own = [p for p in open_ if p[0] == kind]
            z = self.trees[kind].raw(np.array([features(text, *p) for p in own]))
            scored += [(-s, p) for s, p in zip(z.tolist(), own) if s >= self.thresholds[kind]]
        kept: list[tuple[int, int, int]] = []
        ends: list[tuple[int, int]] = []
        for _, p in sorted(scored):
            if not _meets(ends, p[1], p[2]):
                kept.append(p)
                ends.append((p[1], p[2]))
                ends.sort()
        return kept

    def find(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans by kind and start."""
        if not text:
            return [], []
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the sorted spans overlaps; spans of different base kinds may overlap each other, so neighbours aren't enough."""
    from bisect import bisect_left

    at = bisect_left(spans, (end,))
    return any(e > start for _, e in spans[max(0, at - 8) : at])


def _other_writing(rng: random.Random, kind: int, value: str) -> str | None:
    digits = _digits(value)
    if kind == 0 and " " not in value:
        name, _, domain = value.partition("@")
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "."), (" at ", ".")])
        return name + at + domain.replace(".", dot)
    if kind == 2 and len(digits) == 16:
        return rng.choice([" ", "-", ".", "/"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == 3 and len(digits) == 11:
        return rng.choice(["({1}) {2}-{3}", "{1}-{2}-{3}", "{1}.{2}.{3}", "{1} {2} {3}", "+{0} {1} {2} {3}", "+{0}/{1}/{2}-{3}"]).format(digits[0], digits[1:4], digits[4:7], digits[7:])
    return None


def _spoilt(rng: random.Random, kind: int, value: str) -> str:
    """A value of the kind's look that is none."""
    if kind == 1:
        parts = value.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return ".".join(parts)
    if kind == 2:
        at = [i for i, c in enumerate(value) if c.isdigit()]
        i = rng.choice(at)
        return value[:i] + str((int(value[i]) + rng.randrange(1, 9)) % 10) + value[i + 1 :]
    return "".join(str(rng.randrange(10)) for _ in range(rng.choice((5, 6, 8, 10, 14, 17)))) if kind == 3 else value.replace("@", " near ").replace(".", " ")


def passage_of(rng: random.Random, way: int, kind: int, value: str, before: str, after: str, other: tuple[int, str] | None) -> tuple[str, set[tuple[int, int, int]]] | None:
    """A value between its neighbours, with the places of true spans: beside another value (ways 0, 1), written otherwise (2), spoilt (3)."""
    if way < 2:
        values = [(kind, value, True), (*other, True)] if way == 0 else [(*other, True), (kind, value, True)]
    elif way == 2:
        written = _other_writing(rng, kind, value)
        values = [(kind, written, True)] if written else []
    else:
        values = [(kind, _spoilt(rng, kind, value), False)]
    passage, true = before, set()
    for n, (k, v, real) in enumerate(values):
        passage += " " * (n > 0)
        if real and (k != 2 or luhn(_digits(v))):
            true.add((k, len(passage), len(passage) + len(v)))
        passage += v
    return (passage + after, true) if values else None


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 40) : start], text[end : end + 40]


def _held(passage: str) -> bool:
    return zlib.crc32(passage.encode("utf-8", "surrogatepass")) % 4 == 3


def judged(text: str, true: set[tuple[int, int, int]], held: bool | None = None) -> Iterator[tuple[int, bool, bool, list[float]]]:
    """kind, held back, true and features of each proposal; a place is held back by its neighbourhood, so that copies are together."""
    for p in proposals(text):
        yield p[0], _held(text[max(0, p[1] - 24) : p[2] + 24]) if held is None else held, p in true, features(text, *p)


def fit_texts(texts: list[str], precision: float = PRECISION, seed: int = 5) -> Finder:
    """As `fit`, of a few texts in memory."""
    rng = random.Random(seed)
    own = [(t, base_spans(t)) for t in texts]
    pool = {k: [t[s:e] for t, b in own for kind, s, e in b if kind == k] for k in range(len(KINDS))}
    pool = {k: v for k, v in pool.items() if v}
    rows = [r for t, b in own for r in judged(t, set(b))]
    for t, b in own:
        for kind, s, e in b:
            for way in range(4):
                k = rng.choice(list(pool))
                made = passage_of(rng, way, kind, t[s:e], *_around(t, s, e), (k, rng.choice(pool[k])))
                rows += judged(*made, _held(made[0])) if made else []
    if not rows:
        return Finder({}, {})
    kind, held, true, x = (np.array(c) for c in zip(*rows))
    shown_: dict[tuple[int, int, int], int] = {}
    for r in rows:
        shown_[r[0], int(r[1]), int(r[2])] = shown_.get((r[0], int(r[1]), int(r[2])), 0) + 1
    counts = {(k, f): dict(zip(*(a.tolist() for a in np.unique(x[(kind == k) & ~held, f], return_counts=True)))) for k in np.unique(kind[~held]).tolist() for f in range(x.shape[1])}
    kinds, start = _starts(shown_)
    borders = borders_of(counts)
    return boost(Here([binned(kind, held, true, x, borders)], start), borders, kinds, x.shape[1], precision)


#: Examples as rows: features as 32-bit floats.
EXAMPLE = "kind int, held int, true int, x binary"


def _example_batch(rows: list[tuple[int, bool, bool, list[float]]]) -> list[pa.Array]:
    columns = [pa.array([int(r[i]) for r in rows], pa.int32()) for i in range(3)]
    return columns + [pa.array([np.array(r[3], dtype=np.float32).tobytes() for r in rows], pa.binary())]


def _seen(batches):
    """Of each text its base spans with what is around them (`value` is set) and its proposals as examples (`x` is set)."""
    for batch in slices(batches):
        spans, rows = [], []
        for key, text in zip(batch.column("_h").to_pylist(), batch.column("_text").to_pylist()):
            base = base_spans(text)
            spans += [(key, s, k, text[s:e], *_around(text, s, e)) for k, s, e in base]
            rows += judged(text, set(base))
        if spans:
            columns = [pa.array(c, t) for c, t in zip(zip(*spans), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            nothing = pa.nulls(len(spans), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, nothing, nothing, pa.nulls(len(spans), pa.binary())], names=_SEEN)
        if rows:
            kind, held, true, x = _example_batch(rows)
            blank = [pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()), kind, *blank, held, true, x], names=_SEEN)


_SEEN = ["h", "start", "kind", "value", "before", "after", "held", "true", "x"]


def _made(batches):
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            other = None if r["value2"] is None else (r["kind2"], r["value2"])
            made = passage_of(random.Random(r["seed"]), r["way"], r["kind"], r["value"], r["before"], r["after"], other)
            rows += judged(*made, _held(made[0])) if made else []
        if rows:
            yield pa.RecordBatch.from_arrays(_example_batch(rows), names=["kind", "held", "true", "x"])


def examples(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Examples from every text: all its proposals, and passages about each base span; for two of these another value is drawn
    from all base spans, first its kind, then its place among the spans of that kind."""
    keyed = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("_h"), F.col(f"`{text}`").alias("_text"))
    seen = store(arrow_map(keyed, _seen, "h long, start int, kind int, value string, before string, after string, held int, true int, x binary"))
    own = seen.filter("x is not null").select("kind", "held", "true", "x")
    spans = seen.filter("value is not null").select("h", "start", "kind", "value", "before", "after")
    sizes = {r["kind"]: r["count"] for r in spans.groupBy("kind").count().orderBy("kind").collect()}
    if not sizes:
        return own
    placed = with_rank(spans.select("kind", "value", "h", "start"), ["kind"], ["h", "start"], cells_for(sum(sizes.values())), "_at")
    values = placed.select(F.col("kind").alias("kind2"), F.col("_at").alias("at2"), F.col("value").alias("value2"))
    ways = spans.withColumn("way", F.explode(F.array(*map(F.lit, range(4))))).withColumn("seed", F.xxhash64("h", "start", "kind", "way"))
    kinds, counts = (F.array(*map(F.lit, c)) for c in (list(sizes), list(sizes.values())))
    ways = ways.withColumn("_k", F.when(F.col("way") < 2, F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(len(sizes))).cast("int")))
    ways = ways.withColumn("kind2", F.get(kinds, "_k")).withColumn("at2", F.pmod(F.xxhash64("seed", F.lit(2)), F.get(counts, "_k").cast("long")))
    drawn = ways.join(values, ["kind2", "at2"], "left").select("way", "seed", "kind", "value", "before", "after", "kind2", "value2")
    drawn = drawn.repartition(cells_for(4 * sum(sizes.values())), "seed")  # few bytes, but much work for each row
    return own.unionByName(arrow_map(drawn, _made, EXAMPLE))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, held, true = (batch.column(c).to_numpy() for c in ("kind", "held", "true"))
    return kind, held, true, np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1).astype(float)


def _value_counts(batches):
    """How often each value occurs by kind and feature in what isn't held back; feature -1 - held: examples by truth."""
    found: dict[tuple[int, int, float], int] = {}
    for batch in slices(batches, BLOCK):
        kind, held, true, x = _matrix(batch)
        for k in np.unique(kind).tolist():
            for f, column in [(-1 - h, true[(kind == k) & (held == h)].astype(float)) for h in (0, 1)] + [(f, x[(kind == k) & (held == 0), f]) for f in range(x.shape[1])]:
                for v, n in zip(*(a.tolist() for a in np.unique(column, return_counts=True))):
                    found[k, f, v] = found.get((k, f, v), 0) + n
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*key, n) for key, n in found.items()]), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["kind", "f", "v", "n"])


def fit(docs: DataFrame, text: str = "text", id: str = "doc_id", precision: float = PRECISION) -> Finder:
    """Trees and thresholds from the examples of all texts."""
    rows = store(examples(docs, text, id))
    counts: dict[tuple[int, int], dict[float, int]] = {}
    shown_: dict[tuple[int, int, int], int] = {}
    # a feature is a small number (a length, a digit, a flag), so its values are few
    for r in arrow_map(rows, _value_counts, "kind int, f int, v double, n long").groupBy("kind", "f", "v").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            shown_[r["kind"], -1 - r["f"], int(r["v"])] = r["n"]
        else:
            counts.setdefault((r["kind"], r["f"]), {})[r["v"]] = r["n"]
    kinds, start = _starts(shown_)
    if not kinds:
        return Finder({}, {})
    borders, width = borders_of(counts), 1 + max(f for _, f in counts)

    def pack(batches):
        held: list[np.ndarray] = []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])

        for batch in slices(batches, BLOCK):
            held.append(binned(*_matrix(batch), borders))
            if sum(map(len, held)) >= BLOCK:
                yield block()
                held = []
        if held:
            yield block()

    packed = arrow_map(rows.coalesce(-(-sum(shown_.values()) // PART)), pack, "block binary")
    blocks = Spread(packed.rdd.map(lambda r: np.frombuffer(bytes(r[0]), dtype=np.uint8).reshape(-1, 3 + width)), start)
    found = boost(blocks, borders, kinds, width, precision)
    blocks.end()
    return found


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """`text` with each stretch of spans replaced by the name of its first kind; overlapping spans are one stretch."""
    if not spans:
        return text
    out, at, open_ = [], 0, None
    for k, s, e in sorted(spans, key=lambda p: (p[1], -p[2])) + [(0, len(text) + 1, len(text) + 1)]:
        if open_ and s < open_[2]:
            open_ = (open_[0], open_[1], max(e, open_[2]))
            continue
        if open_:
            out += [text[at : open_[1]], f"[{KINDS[open_[0]].upper()}]"]
            at = open_[2]
        open_ = (k, s, e)
    return "".join(out) + text[at:]


#: Result columns: name -> (type, maker from text, base spans and all spans).
OUTPUTS = {
    **{f"n_{name}": ("long", pa.int64(), lambda t, b, a, k=k: sum(s[0] == k for s in b)) for k, name in enumerate(KINDS)},
    "base_sha256": ("string", pa.string(), lambda t, b, a: hashlib.sha256(shown(b).encode()).hexdigest()),
    "spans": ("string", pa.string(), lambda t, b, a: shown(a)),
    "redacted": ("string", pa.string(), lambda t, b, a: redacted(t, a)),
}


def find(docs: DataFrame, finder: Finder, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("spans", "redacted")) -> DataFrame:
    """The columns `keep` and the wanted `outputs` for each row's text."""

    def run(batches):
        for batch in slices(batches):
            made: list[list] = [[] for _ in outputs]
            for value in batch.column(batch.num_columns - 1):
                own = value.as_py()
                base, spans = finder.find(own)
                for out, name in zip(made, outputs):
                    out.append(OUTPUTS[name][2](own, base, spans))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(v, OUTPUTS[n][1]) for v, n in zip(made, outputs)], names=[*keep, *outputs])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` {OUTPUTS[n][0]}" for n in outputs])
    return arrow_map(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")), run, schema)
