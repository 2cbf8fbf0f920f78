"""Plain restatements of the operators' contracts, without Spark, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_duplicates(docs, n, percent):
    """doc_id -> (set size, component) for rows (doc_id, text) of distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or find(a) == find(b):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def archive(pages):
    """page_id -> (bytes, digest, type, refers_to) for rows (page_id, html) of distinct ids."""
    payload = {i: (h or "").encode() for i, h in pages}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    out = {}
    for i, p in payload.items():
        whole = len(p) < 100 or first[p] == i
        out[i] = (len(p), hashlib.sha256(p).hexdigest(), "response" if whole else "revisit", None if whole else first[p])
    return out


def top_k(rows, is_query, k, scale=256):
    """[(query, rank, vec, score)] for rows (vec_id, vector or None)."""
    good = {i: [math.floor(scale * x) for x in v] for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if is_query(q):
            found = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def unigram(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    end = object()
    tokens = {i: [*words((t or "").translate(LOWER)), end] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(t for i in tokens if not held[i] for t in tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for i, ts in tokens.items()}


def mix_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), limit=2):
    """source -> target; sizes: source -> words. The excess over the limit is shared anew, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(limit * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def robust_distances(rows, floors=(20, 50, 50, 50, 50), least=60, subset=0.75, few=50):
    """doc_id -> distance for rows (doc_id, n_words, cell, lang, x) of texts that pass the base rules; minimum covariance determinant by exact C-steps until they settle."""
    import numpy as np

    floor = np.diag(np.array(floors, float) ** 2)

    def spread(x, mean):
        d = x - mean
        return d.T @ d / len(x) + floor

    def estimate(x):
        middle = np.sort(x, axis=0)[(len(x) - 1) // 2]
        away = np.minimum(np.abs(x - middle), 5 * np.array(floors)).mean(axis=0)
        best = None
        for mean, scatter in ((x.mean(axis=0), spread(x, x.mean(axis=0))), (middle, np.diag(away**2) + floor)):
            for _ in range(50):
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
                near = x[d <= np.sort(d)[int(np.ceil(subset * len(x))) - 1]]
                new = near.mean(axis=0), spread(near, near.mean(axis=0))
                if np.allclose(new[1], scatter):
                    break
                mean, scatter = new
            if best is None or np.linalg.det(scatter) < np.linalg.det(best[1]):
                best = mean, scatter
        d = np.einsum("ij,jk,ik->i", x - best[0], np.linalg.inv(best[1]), x - best[0])
        return best[0], np.linalg.inv(best[1]), max(1.0, np.median(d) / 4.351)

    groups: dict = {}
    for _, _, cell, lang, x in rows:
        for g in (("c", cell), ("l", lang), "a"):
            groups.setdefault(g, []).append(x)
    found = {g: estimate(np.array(x, float)) for g, x in groups.items() if len(x) >= least}
    out = {}
    for i, n, cell, lang, x in rows:
        g = next((g for g in (("c", cell), ("l", lang), "a") if g in found), None)
        if g is not None:
            mean, inverse, scale = found[g]
            d = np.array(x, float) - mean
            out[i] = d @ inverse @ d / scale * n / (n + few)
    return out
