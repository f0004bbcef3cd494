"""Plain Python versions of the contracts of op12 and op13, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variant_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants(rows):
    words = variant_words(rows)
    by_deletion = defaultdict(set)  # all words within one edit meet under a key of one deletion or none
    for w in words:
        by_deletion[w].add(w)
        for i in range(len(w)):
            by_deletion[w[:i] + w[i + 1:]].add(w)
    nears = {w: set() for w in words}
    for group in by_deletion.values():
        for a in group:
            nears[a] |= {b for b in group if near(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda b: (-words[b], b), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(nears[w]), None if forms[w] is None else words[forms[w]])
    return out


def collocations(rows, top=2000, least=10):
    """rows: (text, lang). {lang: [(phrase, a, l, r, n, score), ...]} in rank order."""
    grams, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWERED)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for size in (1, 2, 3):
                for i in range(len(ws) - size + 1):
                    grams[lang][tuple(ws[i:i + size])] += 1
    out = {}
    for lang, f in grams.items():
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cands.items():
            if len(g) == 2 and any(2 * b >= a for h, b in cands.items() if len(h) == 3 and (h[:2] == g or h[1:] == g)):
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((" ".join(g), a, f[g[:k]], f[g[k:]], total[lang], score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if kept:
            out[lang] = kept[:top]
    return out
