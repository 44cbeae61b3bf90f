"""Plain single-machine versions of the operators, straight from their contracts, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def fingerprint(text):
    import xxhash

    w = SPACE.findall((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    votes = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= radius)[0]:
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def decontaminate(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORDS.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w = ITEM_WORDS.findall((text or "").translate(LOWER))
        hit, got = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    got |= windows[k]
        out.append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


def line_dedup(rows, min_sites=10):
    """rows: (doc_id, text, source); the texts after removal."""
    sites, first = defaultdict(set), {}
    for d, text, source in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        for i, line in enumerate(text.split("\n")):
            k = line.strip(" \t\r")
            if k:
                sites[k].add(source)
                first.setdefault(k, (d, i))
    gone = lambda d, i, k: k and len(sites[k]) >= min_sites and first[k] != (d, i)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not gone(d, i, x.strip(" \t\r"))) for d, t, _ in rows]


def repeats(docs, least=50):
    """docs: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    owner = {}
    data = {d: (t or "").encode() for d, t in docs}
    for d in sorted(data):
        b = data[d]
        for i in range(len(b) - least + 1):
            owner.setdefault(b[i : i + least], d)
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - least + 1):
            if owner[b[i : i + least]] < d:
                gone[i : i + least] = True
        gone[len(b)] = False
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def token_pieces(texts, path, capacity=1024, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        step, at, rows = len(ids) % capacity or capacity, 0, []
        while at < len(ids):
            part = ids[at : at + step]
            rows.append((at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at, step = at + step, capacity
        out.append(rows)
    return out
