"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all subsequences of P characters that they share, DECAY to the power of the spans
that the subsequence takes in either, and is normalised. Gaps cost little, so ``i.d.i.o.t`` and ``idixot`` stay close to
the plain word; characters that are no letters match nothing and only widen gaps. Texts are cut into sentences, and the strings
are a sentence's words, each with a mark at its start; runs of single letters in a sentence read as one word.

Labels belong to documents, and a document is as toxic as its worst sentence, a sentence as its worst word: the machine
is trained by multiple-instance rounds. Landmarks are words that lie near words of many toxic and few other documents, and the words of other documents
closest to those. A word's features are its kernels with the landmarks, whitened (Nyström); a linear machine is fitted
on them, each toxic document's best word is chosen anew, and a document's score is the calibrated maximum.

The fitted machine is linear in the subsequence weights, so scoring needs one weight per subsequence, not one kernel per
landmark: every word of every whole text is scored, distinct words once per worker.

Training takes at most TRAIN_DOCS labelled rows, those first by a hash of their id, of at most TRAIN_CHARS characters
each; candidates for landmarks are counted in COUNTED_TOXIC and COUNTED_CLEAN of these, first by the same hash. Scoring has
no bounds.

Defined edge cases: a null text is scored like an empty one, by the machine's floor; words longer than WINDOW are read
in overlapping windows; a null doc_id is never learned from and not held out; several labels of one id count as toxic if
any is; without both classes among the labels every score is the share of toxic ones (0 without labels); repeated rows
are scored each; extra columns are ignored; labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = 3
DECAY = 0.5
WINDOW = 16
TRAIN_DOCS = 4000
TRAIN_CHARS = 20_000
#: Documents of the sample, first by the same hash, in which the neighbourhoods of candidate landmarks are counted; how many
#: candidates there are; and words of other documents that the first machine learns from, half of them nearest to the
#: landmarks and half from all over. Later rounds add the best word of every document of the sample.
COUNTED_TOXIC, COUNTED_CLEAN = 500, 1000
CANDIDATES = 320
NEGATIVES = 3000
POSITIVE_LANDMARKS = 64
NEGATIVE_LANDMARKS = 160
NEAR = 0.7
ROUNDS = 4
MORE_LANDMARKS = 60
SLOPE = 4.0
#: Least log-odds of a word, or of its neighbourhood, between toxic and other documents.
PECULIAR = 1.5
CACHE = 600_000

_ALPHABET = 40  # a-z, the start mark, 12 classes of other letters, and one of characters that match nothing
_MARK, _OTHER, _NONE = 26, 27, 39
EDGES = ".,;:!?\"'`´()[]{}<>|*#$%&@^~_=+-/\\«»„“”…¡¿"
SENTENCE_END = re.compile(r"\n+|(?<=[^\W\d_]{2}[.!?…])\s+")
SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:\s+[^\W\d_](?!\S)){2,}")


@lru_cache
def _classes() -> np.ndarray:
    """Class of each code point below 2^16."""
    out = np.full(1 << 16, _NONE, np.uint8)
    for c in range(128, 1 << 16):
        if chr(c).isalpha():
            out[c] = _OTHER + c % 12
    out[ord("a") : ord("z") + 1] = np.arange(26)
    return out


@lru_cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n characters, and the kernel weight of each."""
    t = np.array(list(combinations(range(n), P)), np.int64).reshape(-1, P)
    return t, (DECAY ** (t[:, -1] - t[:, 0] + 1)).astype(np.float32)


def _coded(words: list[str]) -> np.ndarray:
    """Classes of equally long words, behind the start mark."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    codes = _classes()[np.minimum(points, 0xFFFF)]
    return np.concatenate([np.full((len(words), 1), _MARK, np.uint8), codes], axis=1)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the kernels of words with themselves."""
    n = codes.shape[1]
    gap = np.tril(DECAY ** (np.arange(n)[:, None] - np.arange(n)[None, :]).clip(0), -1).astype(np.float32)
    same = ((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] != _NONE)).astype(np.float32)
    a = same * DECAY * DECAY
    for _ in range(P - 1):
        a = same * (gap @ a @ gap.T)
    return np.sqrt(np.maximum(a.sum(axis=(1, 2)), 1e-12))


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers of words (rows) by index triple, and their weights; nothing matches number 0 of no weight."""
    t, w = _triples(codes.shape[1])
    c = codes[:, t].astype(np.int32)
    number = (c[..., 0] * _ALPHABET + c[..., 1]) * _ALPHABET + c[..., 2]
    live = (c != _NONE).all(axis=2)
    return np.where(live, number, 0), w * live


def by_length(words: list[str], block: int = 4096) -> Iterator[tuple[list[int], np.ndarray]]:
    """Positions and codes of blocks of equally long words."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n in sorted(groups):
        for at in range(0, len(groups[n]), block):
            part = groups[n][at : at + block]
            yield part, _coded([words[i] for i in part])


def weigh(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised kernel sums of words with weights per subsequence: ``table`` has a column per sum."""
    flat = table.ndim == 1
    out = np.zeros(len(words) if flat else (len(words), table.shape[1]), np.float32)
    for part, codes in by_length(words, 4096 if flat else 256):
        if codes.shape[1] < P:
            continue
        number, w = _features(codes)
        sums = (table[number] * w).sum(axis=1) if flat else np.einsum("btm,bt->bm", table[number], w)
        # Fewer than P letters hold no subsequence of letters alone; their kernels would rest on the start mark.
        scale = ((codes != _NONE).sum(axis=1) > P) / _norms(codes)
        out[part] = sums * (scale if flat else scale[:, None])
    return out


def _table(words: list[str]) -> np.ndarray:
    """A column per word: its normalised weight of each subsequence."""
    out = np.zeros((_ALPHABET**P, len(words)), np.float32)
    for part, codes in by_length(words):
        if codes.shape[1] < P:
            continue
        number, w = _features(codes)
        for row, column in enumerate(part):
            np.add.at(out[:, column], number[row], w[row])
        out[:, part] /= _norms(codes)
    return out


def windows(word: str) -> Iterable[str]:
    """A word, or overlapping windows of a long one."""
    if len(word) <= WINDOW:
        return (word,)
    step = WINDOW // 2
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + step, step)]


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, lower-cased: parted at line feeds and behind marks that end one, unless a single letter comes
    before, as in a word spelled out with stops."""
    return [s for s in SENTENCE_END.split((text or "").lower()) if s]


def units(text: str | None) -> set[str]:
    """Distinct words of all sentences of a text, with spelled-out words joined."""
    found: set[str] = set()
    for s in sentences(text):
        words = s.split()
        found.update(w.strip(EDGES) for w in set(words))
        if sum(len(w) == 1 for w in words) > 2:
            found.update("".join(m[0].split()) for m in SPELLED.finditer(s))
    long = [w for w in found if len(w) > WINDOW]
    for w in long:
        found.discard(w)
        found.update(windows(w))
    return found


@dataclass
class Model:
    """weights per subsequence, the machine's offset, and the calibration of a document's maximum."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        return weigh(words, self.weights) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0) -> np.ndarray:
    """Primal linear machine with squared hinge loss, by Newton steps. The last weight is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda v: v @ ridge @ v + (c * weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    now = loss(w)
    for _ in range(60):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], c * weight[active]
        to = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ ya) - w
        step = 1.0
        while (then := loss(w + step * to)) > now and step > 1e-6:
            step /= 2
        w = w + step * to
        if now - then <= 1e-6 * max(1.0, now):
            break
        now = then
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid that is one half at the cut of fewest training errors (the middle of the widest such
    gap). A logistic fit alone would move the cut for toxic documents none of whose words was learned."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order] > 0
    # Errors if the first i are called clean.
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((~t)[::-1])[::-1], [0]])
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gaps = edges[1:] - edges[:-1]
    i = max(range(len(errors)), key=lambda k: (-errors[k], gaps[k]))
    cut = (edges[i] + edges[i + 1]) / 2
    return SLOPE, float(-SLOPE * cut)


def _chance(a: int, b: int, share: float) -> float:
    """Probability of ``a`` or more toxic ones among a + b documents, if toxic ones were dealt by chance."""
    n = a + b
    log = lambda k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(share) + (n - k) * np.log1p(-share)
    return float(min(1.0, sum(np.exp(log(k)) for k in range(a, n + 1))))


def _variants(word: str) -> list[str]:
    """Gapped and inserted spellings of a training word."""
    dotted = ".".join(word)[:WINDOW]
    return [dotted, *(word[:i] + "x" + word[i:] for i in range(1, len(word)) if len(word) < WINDOW)]


def train(sample: list[tuple[set[str], int]]) -> Model:
    """Fits the machine on (words, toxic) of documents. Deterministic."""
    zero = np.zeros(_ALPHABET**P, np.float32)
    toxic, clean = [u for u, y in sample if y], [u for u, y in sample if not y]
    if not toxic or not clean:
        share = 1.0 if toxic else 0.0
        return Model(zero, 1.0 if share else -1.0, 30.0, 0.0)
    np_, nn = len(toxic), len(clean)
    df_t, df_c = Counter(w for u in toxic for w in u), Counter(w for u in clean for w in u)
    odds = lambda a, b: np.log((a + 0.5) / (np_ + 1)) - np.log((b + 0.5) / (nn + 1))

    # Candidates: the words most peculiar to toxic documents. Their neighbourhoods are counted in part of the documents,
    # which come in the order of a hash.
    seen_t, seen_c = toxic[:COUNTED_TOXIC], clean[:COUNTED_CLEAN]
    pool = sorted({w for u in seen_t for w in u} | {w for u in seen_c for w in u})
    at = {w: i for i, w in enumerate(pool)}
    cands = sorted((w for w in df_t if len(w) >= P), key=lambda w: (-odds(df_t[w], df_c[w]), w))[:CANDIDATES]
    docs_t, docs_c = ([np.fromiter((at[w] for w in u), np.int64, len(u)) for u in docs] for docs in (seen_t, seen_c))
    share = len(seen_t) / (len(seen_t) + len(seen_c))
    picked: list[tuple[float, int, str, np.ndarray]] = []
    for k in range(0, len(cands), 64):
        part = cands[k : k + 64]
        near = weigh(pool, _table(part)) >= NEAR
        a = np.array([near[d].any(axis=0) for d in docs_t if len(d)]).reshape(-1, len(part))
        b = np.array([near[d].any(axis=0) for d in docs_c if len(d)]).reshape(-1, len(part))
        na, nb = a.sum(axis=0), b.sum(axis=0)
        gain = np.log((na + 0.5) / (len(seen_t) + 1)) - np.log((nb + 0.5) / (len(seen_c) + 1))
        picked += [(float(gain[j]), int(na[j]), w, a[:, j]) for j, w in enumerate(part) if _chance(int(na[j]), int(nb[j]), share) * len(cands) < 0.05]
    picked.sort(key=lambda x: (-x[0], -x[1], x[2]))
    picked = [x for x in picked if x[0] > PECULIAR] or picked[:1]
    if not picked:
        return Model(zero, -1.0, 1.0, float(np.log(np_ / nn)) + 1.0)
    # Cover the toxic documents first, then take the rest in order.
    chosen: list[str] = []
    covered = np.zeros(len(picked[0][3]), int)
    for want in (1, 3, 1 << 30):
        for _, _, w, docs in picked:
            if len(chosen) >= POSITIVE_LANDMARKS:
                break
            if w not in chosen and (docs & (covered < want)).any():
                chosen.append(w)
                covered += docs
    close = weigh(pool, _table(chosen)).max(axis=1)
    clean_words = {w for u in seen_c for w in u}
    order = np.argsort(-close, kind="stable")
    hard = [pool[i] for i in order if pool[i] in clean_words]
    negatives = hard[:NEGATIVE_LANDMARKS]
    marks = list(dict.fromkeys(chosen + negatives))

    positive = {w for u in toxic for w in u if df_t[w] and odds(df_t[w], df_c[w]) > PECULIAR and w in at and close[at[w]] >= NEAR}
    positive |= set(chosen)
    step = max(1, len(hard) // NEGATIVES)
    negative = set(hard[:NEGATIVES]) | set(hard[::step])
    model = Model(zero, -1.0, 1.0, 0.0)
    everything = sorted({w for u, _ in sample for w in u})
    where = {w: i for i, w in enumerate(everything)}
    met: set[str] = set(hard[:300])
    for _ in range(ROUNDS):
        negative -= positive
        table = _table(marks)
        values, vectors = np.linalg.eigh(weigh(marks, table).astype(float))
        good = values > 1e-6 * values.max()
        white = vectors[:, good] / np.sqrt(values[good])
        psi = lambda words: weigh(words, table).astype(float) @ white  # noqa: B023, E731
        pos = sorted(positive)
        pos += sorted({v for w in pos if w.isalpha() for v in _variants(w)} - positive)
        neg = sorted(negative)
        x, y = psi(pos + neg), np.array([1.0] * len(pos) + [-1.0] * len(neg))
        # Words that were some document's best in an earlier round weigh as much as all others together.
        weight = np.array([0.5 / len(pos)] * len(pos) + [0.25 / len(neg) + (0.25 / len(met) if z in met else 0.0) for z in neg]) * 1000
        w = _machine(x, y, weight)
        model = Model((table @ (white @ w[:-1])).astype(np.float32), float(w[-1]), 1.0, 0.0)
        margin = model.margins(everything)
        best = lambda u: max(u, key=lambda z: (margin[where[z]], z))
        # A toxic document speaks by its best word, unless other documents have that word as well.
        positive = set(chosen) | {z for u in toxic if u for z in [best(u)] if margin[where[z]] > -1 and odds(df_t[z], df_c[z]) > PECULIAR}
        met |= {z for u in clean if u for z in [best(u)]} - positive
        negative |= met
        # Words of other documents on the wrong side become landmarks, so that the next round can tell them apart.
        wrong = sorted((z for z in met - set(marks) if margin[where[z]] > -0.5), key=lambda z: (-margin[where[z]], z))
        marks += wrong[:MORE_LANDMARKS]
    top = np.array([max((margin[where[z]] for z in u), default=model.bias) for u, _ in sample])
    y = np.array([1 if t else 0 for _, t in sample])
    model.slope, model.offset = _calibrate(top, y)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The training sample: (doc_id, text, toxic) of rows that are not held out, the first TRAIN_DOCS by a hash of doc_id, in
    that order."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= TRAIN_CHARS)
    d = d.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    # Ids are drawn first, so only the sample's texts are moved.
    ids = d.select("doc_id").join(marks, F.col("doc_id") == F.col("l_id")).select("doc_id", "toxic").distinct()
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = d.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # An id may stand on any number of rows.
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(TRAIN_DOCS)


_cache: dict[int, dict[str, float]] = {}


def _scored(batches: Iterator[pa.RecordBatch], model: Model, key: int) -> Iterator[pa.RecordBatch]:
    known = _cache.setdefault(key, {})
    for b in batches:
        texts = b.column(2)
        scores = np.zeros(b.num_rows)
        for at in range(0, b.num_rows, 500):
            docs = [units(texts[i].as_py()) for i in range(at, min(at + 500, b.num_rows))]
            if len(known) > CACHE:
                known.clear()
            fresh = sorted(set().union(*docs).difference(known))
            known.update(zip(fresh, model.margins(fresh).tolist(), strict=True))
            for i, u in enumerate(docs):
                scores[at + i] = model.score(max(map(known.__getitem__, u), default=model.bias))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the bounded sample of labelled documents."""
    rows = labelled(docs, labels).toArrow().to_pylist()
    return train([(units(r["text"]), r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    key = hash((model.weights.tobytes(), model.bias))
    return d.mapInArrow(lambda batches: _scored(batches, model, key), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on what may be learned from and scores every row."""
    return score(docs, fit(docs, labels))
