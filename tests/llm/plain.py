"""Plain single-machine versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(docs):
    """(doc_id, text) rows, NULL ids first."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))


def passages(docs, size):
    """doc_id -> (words, removed)"""
    seen, out = {}, {}
    for doc, text in ordered(docs):
        words = WORD.findall(text or "")
        gone = set()
        for p in range(len(words) - size + 1):
            if seen.setdefault(tuple(words[p : p + size]), (doc, p)) != (doc, p):
                gone.update(range(p, p + size))
        out[doc] = (words, gone)
    return out


def lines(docs, size):
    seen, out = {}, {}
    for doc, text in ordered(docs):
        own = [] if text is None else text.split("\n")
        gone = set()
        for p in range(len(own) - size + 1):
            window = tuple(own[p : p + size])
            if "".join(window).strip(" ") and seen.setdefault(window, (doc, p)) != (doc, p):
                gone.update(range(p, p + size))
        out[doc] = (own, gone)
    return out


def contaminated(docs, items, span):
    """doc_id -> (n_words, hit positions, item ids)"""
    spans = defaultdict(set)
    for item, text in items:
        words = PLAIN_WORD.findall(lower(text or ""))
        n = min(len(words), span)
        for p in range(len(words) - n + 1 if n else 0):
            spans[tuple(words[p : p + n])].add(item)
    sizes = {len(s) for s in spans}
    out = {}
    for doc, text in docs:
        words, hit, ids = PLAIN_WORD.findall(lower(text or "")), set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                if found := spans.get(tuple(words[p : p + n])):
                    hit.update(range(p, p + n))
                    ids |= found
        out[doc] = (len(words), hit, ids)
    return out


def linked(prints, bits):
    """The smallest index reachable from each index over prints that differ in at most ``bits`` bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin((a ^ prints[j]) & (2**64 - 1)).count("1") <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def simhash(text, shingle, seed=42):
    import xxhash

    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _mixed(x):
    """The 64-bit mixing function, in plain numbers."""
    m = 2**64 - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


GEAR = [_mixed(b + 1) >> 48 for b in range(256)]


def chunks(data):
    """The content-defined chunks of a text's bytes: 16 to 192 bytes (a last one may be smaller), one at a time."""
    out, start = [], 0
    while len(data) - start > 16:
        h, at = 0, start
        while True:
            h = ((h << 1) + GEAR[data[at]]) & 0xFFFF
            at += 1
            if at == len(data):
                break
            if data[at] & 0xC0 != 0x80 and at - start < 192:
                if 16 <= at - start < 48 and h >> 9 == 0 or at - start >= 48 and h >> 12 == 0:
                    break
            if at - start == 192:
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                break
        out.append(data[start:at])
        start = at
    if start < len(data):
        out.append(data[start:])
    return out


def fingerprint(text):
    """{digest: length} of the distinct chunks of a text."""
    import xxhash

    return {xxhash.xxh64_intdigest(c): len(c) for c in chunks(text.encode())}


def share_within(a, b):
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def quality_features(text):
    """The statistics of a text that quality is judged by."""
    import math

    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]", data) if w]
    n, sizes = len(words), [len(w) for w in words]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(s * s for s in sizes) / max(n, 1) - mean * mean, 0))
    lines, distinct = data.count(b"\n") + data.count(b"\r") + 1, len(set(data.split(b"\n")))
    kinds = [rb"[A-Z]", rb"[0-9]", rb"[.?:;]", rb",", rb"!", rb"\|", rb"[#$%&*@^~+=_\\/]", rb"[<>(){}\[\]\"'-]"]
    known = kinds + [rb"[a-z]", rb"[ \t]", rb"[\r\n]", rb"[\x80-\xff]"]
    counts = [len(re.findall(k, data)) for k in known]
    shares = [*counts[:8], len(data) - sum(counts), counts[-1]]
    return [
        math.log1p(n), math.log1p((sum(sizes) + 50) / (n + 10)), math.log1p(spread),
        math.log1p(len(set(words)) + 10) / math.log1p(max(n, 1) + 10),
        math.log1p(distinct + 5) / math.log1p(max(lines, distinct) + 5), math.log1p(n / lines),
        *[math.sqrt(c / (len(data) + 200)) for c in shares],
    ]


def quality_scores(docs, labels):
    """doc_id -> score, from rows (doc_id, text) and {doc_id: 0 or 1}: densities with their covariances in full."""
    import zlib

    import numpy as np

    x = {i: np.array(quality_features(t)) for i, t in docs}
    learned = {i: y for i, y in labels.items() if i in x and zlib.crc32(str(i).encode()) % 5}
    rows = {y: np.array([x[i] for i, z in learned.items() if z == y]) for y in (0, 1)}
    every = np.concatenate([rows[0], rows[1]])
    within = {y: np.cov(rows[y].T, bias=True) for y in (0, 1)}
    pooled = sum(len(rows[y]) * within[y] for y in (0, 1)) / len(every)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    pooled = pooled / scale[:, None] / scale
    d = len(pooled)
    pooled = 0.95 * pooled + 0.05 * np.eye(d) * max(np.trace(pooled) / d, 1e-3)
    density = {}
    for y in (0, 1):
        covariance = 0.9 * within[y] / scale[:, None] / scale + 0.1 * pooled
        sign, determinant = np.linalg.slogdet(covariance)
        assert sign == 1
        apart = {i: (v - rows[y].mean(axis=0)) / scale for i, v in x.items()}
        prior = np.log(len(rows[y]) / len(every))
        density[y] = {i: prior - (a @ np.linalg.solve(covariance, a) + determinant) / 2 for i, a in apart.items()}
    return {i: 1 / (1 + np.exp(np.clip(density[0][i] - density[1][i], -700, 700))) for i in x}
