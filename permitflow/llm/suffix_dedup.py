"""Exact repeated-substring dedup: bounded interval expansion on Burrows-Wheeler transforms.

Every byte covered by a LEAST-byte string that also starts in a document with a smaller doc_id is removed. Strings are
UTF-8 bytes, never cross documents, and are judged on the input.

Equal strings must meet in one place before they can be compared. A string's key is the smallest hash of its K-byte
grams, so equal strings have equal keys; consecutive strings of one key form a stretch. Stretches are reduced in three
steps, each exact:

1. In a task, and then in a bucket of keys, equal stretches keep only the smallest document; all others are removed
   whole. Hot passages thus send one entry per task, not one per document. A string reaches SIDE bytes or more to one
   side of its key's gram, so different stretches can share one only if they agree on SIDE bytes to the left or to the
   right; a key whose stretches do not is done.
2. What remains are different stretches that may share strings. Their bytes are fetched and gathered by key into blocks. On a block's
   Burrows-Wheeler transform, string intervals are extended backward breadth-first: the common-prefix value of two
   neighbouring suffixes becomes known in the round of that value, as soon as the intervals of their tails part. The
   expansion stops at LEAST; suffixes still together share LEAST bytes, and the smallest document among them owns them.
3. A key of more than SPLIT stretches is dealt out over several blocks, each with a transform of its own. What a block
   can't settle, its strings that no smaller document of the block has, once each, is settled by the smallest of the
   blocks' owners of a string. Where a sample of the texts shows a key of more than HOT stretches, they do not meet in one
   bucket before either: they are dealt out by stretch in step 1, and the sides are compared by aggregation.

Defined edge cases: a null text is empty; a null doc_id counts as larger than any; rows of equal doc_id never remove each
other's bytes, and are told apart by a checksum of their text, so that each gets its own result; texts below LEAST bytes stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import cut, sized, small_batches

LEAST = 50
K = 16
HOT = 20_000
#: Open stretches of a key in one block.
SPLIT = 4096
#: One text in so many shows which keys are hot before they are dealt out, and so many of them are told apart at most.
SAMPLE, HOT_MOST = 64, 1 << 20
SIDE = (LEAST - K) // 2
#: Bytes of text that are hashed at once, and of stretches that are compared at once: they bound a worker's memory and
#: change no result. A block takes whole keys.
CHUNK = 1 << 20
BLOCK = 1 << 18
BUCKET_BYTES = 2 << 20
BUCKETS = 1024
BROADCAST_BYTES = 32 << 20
NO_ID = (1 << 63) - 1

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20_240_229))
_LETTER = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)  # a random odd number per byte
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64

_ENTRY = np.dtype([("h", "<u4"), ("s", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "u1"), ("left", "<u2"), ("right", "<u2")])
_OPEN = np.dtype([("start", "<u4"), ("n", "u1"), ("key", "<i8")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
#: Low bits of a gram's hash that give way to its position while the smallest is sought; a chunk holds fewer positions.
_AT = 23


def _power(base: np.uint64, n: int) -> np.uint64:
    return _U(pow(int(base), n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position."""
    h, have, at = None, 0, 0
    part, width = _LETTER[data], 1
    n = len(data) - size + 1
    while at < size:  # by the binary digits of ``size``
        if size & width:
            piece = part[at : at + n]
            h = piece if h is None else h * _power(_BASE, width) + piece
            at += width
        have = width
        if at < size:
            part, width = part[:-have] * _power(_BASE, have) + part[have:], 2 * width
    return _mix(h)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one behind the other and end at ``ends``: start, strings, key, content hash, and hashes of the
    SIDE bytes left and right of the gram (0 where a stretch has no string that reaches so far) of each stretch: a
    maximal run of strings whose smallest gram is at one place."""
    none = np.zeros(0, np.int64)
    if len(data) < LEAST:
        return none, none, none.astype(_U), none.astype(_U), none, none
    h = _grams(data, K)
    at_mask = _U((1 << _AT) - 1)
    low = (h & ~at_mask) | np.arange(len(h), dtype=_U)
    want, size = LEAST - K + 1, 1
    while 2 * size <= want:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (want - size)], low[want - size :])
    place = (low & at_mask).astype(np.int64)
    bounds = np.concatenate([[0], ends])
    valid = np.zeros(len(place) + 1, np.int32)  # +1 at a text's first string, -1 behind its last
    full = np.nonzero(np.diff(bounds) >= LEAST)[0]
    valid[bounds[full]] += 1
    valid[bounds[full + 1] - LEAST + 1] -= 1
    ok = np.cumsum(valid)[:-1] > 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
    new[bounds[full]] = True
    start = np.nonzero(new)[0]
    n = np.diff(np.append(start, len(place)))
    live = ok[start]
    start, n = start[live], n[live]
    gram = place[start]
    # Content hash: a difference of prefix sums, brought to one shift whatever the array's length.
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(len(data), _BASE)]), dtype=_U)
    prefix = np.concatenate([[_U(0)], np.cumsum(_LETTER[data] * powers[:-1], dtype=_U)])
    s = (prefix[start + n + LEAST - 1] - prefix[start]) * powers[len(data) - start]
    s = _mix(s * _power(_U(pow(int(_BASE), -1, 1 << 64)), len(data)) + n.astype(_U))
    side = _grams(data, SIDE)
    near = lambda at: (side[np.clip(at, 0, len(side) - 1)] >> _U(48)).astype(np.int64) | 1
    left = np.where(gram - SIDE >= start, near(gram - SIDE), 0)
    right = np.where(gram + K + SIDE <= start + n + LEAST - 1, near(gram + K), 0)
    return start, n, h[gram], s, left, right


def _reduced(e: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket and stretch, and which entries in that order are of their stretch's smallest document."""
    order = np.lexsort((e["s"], e["h"], bucket))
    s, h, of, doc = e["s"][order], e["h"][order], bucket[order], e["doc"][order]
    first = np.ones(len(e), bool)
    first[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    low = np.minimum.reduceat(doc, np.nonzero(first)[0])[np.cumsum(first) - 1]
    return order, doc == low


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """(ids, checksums, bases, bytes) of runs of texts of some CHUNK bytes, from (doc, text)."""
    ids: list[int] = []
    tags: list[int] = []
    bases: list[int] = []
    parts: list[bytes] = []
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            t = text.as_py()
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            d, tag = doc_id.as_py(), zlib.crc32(raw)
            # A text beyond CHUNK goes in parts that overlap, so that each string lies whole in one.
            for base in range(0, max(1, len(raw) - LEAST + 1), CHUNK):
                part = raw[base : base + CHUNK + LEAST - 1]
                if len(part) < LEAST:
                    continue
                ids.append(NO_ID if d is None else d)
                tags.append(tag)
                bases.append(base)
                parts.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield ids, tags, bases, parts
                    ids, tags, bases, parts, size = [], [], [], [], 0
    if parts:
        yield ids, tags, bases, parts


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other, and where each ends."""
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of keys with two different stretches or more in a run of texts."""
    for *_, parts in _chunks(batches):
        _, _, key, s, _, _ = stretches(*_laid(parts))
        pairs = np.unique(np.stack([key, s]), axis=1) if len(key) else np.zeros((2, 0), _U)
        of, n = np.unique(pairs[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(of[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])


def _hot_keys(d: DataFrame) -> np.ndarray:
    """Keys, sorted, that one in SAMPLE texts shows to have more than HOT different stretches: HOT_MOST at most, the most
    frequent. They are dealt out by stretch. A key that is missed costs one larger task and no result."""
    some = d.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("doc", "text").mapInArrow(_frequent, "key long, n long")
    n = some.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLE > HOT).orderBy(F.desc("n"), "key").limit(HOT_MOST)
    return np.sort(n.select("key").toArrow().column(0).to_numpy().view(_U))


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray, spread: int) -> Iterator[pa.RecordBatch]:
    """Entries of each chunk of documents by bucket: of its key, or, beyond ``buckets``, of a hot key's place and the
    stretch. Those to be removed whole at once go by bucket -1 - some number."""
    for ids, tags, bases, parts in _chunks(batches):
        data, ends = _laid(parts)
        start, n, key, s, left, right = stretches(data, ends)
        text = np.searchsorted(ends, start, side="right")
        e = np.zeros(len(start), _ENTRY)
        bucket = (key % _U(buckets)).astype(np.int64)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            bucket = np.where(hot[place] == key, buckets + place * spread + (s % _U(spread)).astype(np.int64), bucket)
        e["h"], e["s"], e["doc"], e["n"], e["left"], e["right"] = (key >> _U(32)).astype(np.uint32), s, np.array(ids, np.int64)[text], n, left, right
        e["tag"] = np.array(tags, np.uint32)[text]
        e["start"] = start - np.concatenate([[0], ends])[text] + np.array(bases, np.int64)[text]
        if not len(e):
            continue
        order, least = _reduced(e, bucket)
        keep, rest = e[order[least]], e[order[~least]]
        of = bucket[order[least]]
        at = np.nonzero(np.diff(of, prepend=-1))[0]
        names, ends_at = of[at], np.append(at, len(keep))
        if len(rest):
            names, ends_at = np.append(names, -1 - int(rest["s"][0] % _U(buckets))), np.append(ends_at, len(e))
        offsets = pa.py_buffer((ends_at * _ENTRY.itemsize).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(names), [None, offsets, pa.py_buffer(keep.tobytes() + rest.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(names), blobs], names=["bucket", "blob"])


_FOUND = "doc long, tag long, start long, n int, key long, left int, right int"


def _settled(batches: Iterator[pa.RecordBatch], buckets: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, start, n, key, left, right) of a partition sorted by bucket: key null for what is removed whole, else
    still open. Hot keys have negative numbers, and their stretches come with the hashes of their sides."""

    def rows(e: np.ndarray, key: np.ndarray | None, sides: bool = False) -> pa.RecordBatch:
        k = pa.nulls(len(e), pa.int64()) if key is None else pa.array(key)
        side = [pa.array(e[x].astype(np.int32)) if sides else pa.nulls(len(e), pa.int32()) for x in ("left", "right")]
        return pa.RecordBatch.from_arrays([pa.array(e["doc"]), pa.array(e["tag"].astype(np.int64)), pa.array(e["start"].astype(np.int64)), pa.array(e["n"].astype(np.int32)), k, *side], names=["doc", "tag", "start", "n", "key", "left", "right"])

    def settle(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(blobs), _ENTRY)
        if bucket < 0:
            yield rows(e, None)
            return
        order, least = _reduced(e, np.zeros(len(e), np.int64))
        keep, rest = e[order[least]], e[order[~least]]
        if len(rest):
            yield rows(rest, None)
        if bucket >= buckets:
            yield rows(keep, np.full(len(keep), -1 - (bucket - buckets) // spread, np.int64), sides=True)
            return
        # Open: stretches that agree with one of another document on a side of their key's gram.
        open_ = np.zeros(len(keep), bool)
        for name in ("left", "right"):
            have = np.nonzero(keep[name])[0]
            if not len(have):
                continue
            at_side = keep["h"][have].astype(np.int64) << 16 | keep[name][have].astype(np.int64)
            order = have[np.argsort(at_side, kind="stable")]
            at_side.sort()
            first = np.nonzero(np.diff(at_side, prepend=-1))[0]
            docs = keep["doc"][order]
            shared = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            open_[order] |= np.repeat(shared, np.diff(np.append(first, len(order))))
        if open_.any():
            left = keep[open_]
            yield rows(left, (bucket << 32) + left["h"].astype(np.int64))

    now, blobs = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now and blobs:
                yield from settle(now, blobs)
                blobs = []
            now = bucket
            blobs.append(blob.as_py())
    if blobs:
        yield from settle(now, blobs)


def _open_hot(rows: DataFrame) -> DataFrame:
    """Of hot keys' stretches, those that agree with one of another document on a side: the test of :func:`_settled` by
    aggregation, so that no task sees a whole key."""
    hits = []
    for side in ("left", "right"):
        g = rows.filter(F.col(side) != 0).groupBy("key", side).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
        hits.append(g.select(F.col("key").alias(f"{side}_key"), F.col(side).alias(f"{side}_of"), F.lit(True).alias(f"{side}_hit")))
    j = rows
    for side, g in zip(("left", "right"), hits, strict=True):
        j = j.join(g, (F.col("key") == F.col(f"{side}_key")) & (F.col(side) == F.col(f"{side}_of")), "left")
    return j.filter("left_hit or right_hit").select("doc", "tag", "start", "n", "key")


def suffix_order(text: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Suffix array of strings that each end in symbol 0 (bytes are symbols 1 to 256); ``left``: symbols before that 0.
    A suffix ends at its string's 0; suffixes that agree on ``least`` symbols or to their ends come in any order."""
    n = len(text)
    depth = 7  # symbols of 9 bits in one key
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for i in range(depth):
        key = (key << 9) | np.where(left > i, padded[i : i + n], 0)
    order = np.argsort(key)
    while depth < least and depth <= left.max(initial=0):
        in_order = key[order]
        new = np.ones(n, bool)
        np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
        if new.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[:-depth] += np.where(left[:-depth] > depth, rank[depth:], 0)
        order = np.argsort(key)
        depth *= 2
    return order


def owners(strings: list[bytes], docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document that has the ``least``-byte string at each byte of the joined ``strings`` (each followed by one
    end symbol), and the offsets of the strings. Breadth-first backward extension of intervals on the transform."""
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(offsets[-1])
    text = np.zeros(n, np.int16)
    body = np.ones(n, bool)
    body[offsets[1:] - 1] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    left = np.repeat(offsets[1:] - 1, sizes + 1) - np.arange(n)
    sa = suffix_order(text, left, least)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    # bwt[i] = text[sa[i] - 1]; the suffix at rank r is the backward extension of the one at tail[r] by its first symbol.
    first = text[sa]
    tail = place[np.minimum(sa + 1, n - 1)]
    parted = np.zeros(n, bool)  # whether ranks r - 1 and r are known to share fewer than ``least`` bytes
    parted[0] = True
    parted[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    undecided = np.nonzero(~parted)[0]
    for _ in range(1, least):
        if not len(undecided):
            break
        # Intervals of the strings of this round's length. Two neighbours part if their tails lie in different ones:
        # then their common prefix is this round's value.
        interval = np.cumsum(parted)
        now = interval[tail[undecided - 1]] != interval[tail[undecided]]
        parted[undecided[now]] = True
        undecided = undecided[~now]
    group = np.cumsum(parted) - 1
    of = np.repeat(docs, sizes + 1)[sa]
    low = np.minimum.reduceat(of, np.nonzero(parted)[0])[group]
    out = np.empty(n, np.int64)
    out[sa] = low
    return out, offsets


_COMPARED = "doc long, tag long, start long, n int, string binary"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, start, n, string) of a partition of (key, part, split, doc, tag, start, data) sorted by key and part:
    runs to remove, and, of a key with other parts, each string that none of this block's documents removes."""

    def rows(*columns: np.ndarray | list, string: list[bytes] | None = None) -> pa.RecordBatch:
        last = pa.nulls(len(columns[0]), pa.binary()) if string is None else pa.array(string, pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)), last], names=["doc", "tag", "start", "n", "string"])

    def block(places: list[tuple[int, int, int, bool]], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        at = np.array(places, np.int64)
        low, offsets = owners(strings, at[:, 0])
        hit = low < np.repeat(at[:, 0], np.diff(offsets))
        # Runs of strings to remove, each within one stretch; ends and tails have no string of full length.
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        a, b = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
        which = np.searchsorted(offsets, a, side="right") - 1
        doc, tag, start, _ = at[which].T
        yield rows(doc, tag, start + a - offsets[which], b - a)
        if not at[:, 3].any():
            return
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(at)), sizes)
        within = np.arange(len(of)) - offsets[of]
        mine = np.nonzero(~hit & (at[of, 3] > 0) & (within < sizes[of] - LEAST))[0]
        joined = b"\0".join(strings)
        doc, tag, start, _ = at[of[mine]].T
        for i in range(0, len(mine), 10_000):
            some = slice(i, i + 10_000)
            yield rows(doc[some], tag[some], (start + within[mine])[some], np.ones(len(mine[some]), np.int32), string=[joined[k : k + LEAST] for k in mine[some].tolist()])

    places: list[tuple[int, int, int, bool]] = []
    strings: list[bytes] = []
    size, last = 0, None
    for b in batches:
        for key, part, split, doc, tag, start, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if (key, part) != last and size >= BLOCK:
                yield from block(places, strings)
                places, strings, size = [], [], 0
            last = key, part
            places.append((doc, tag, start, split))
            strings.append(data)
            size += len(data) + 1
    if places:
        yield from block(places, strings)


def _packed_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, open) with the open stretches of a document as one compact value."""
    for b in batches:
        out = []
        for x in b.column(2):
            v = x.values
            e = np.zeros(len(v), _OPEN)
            for name in ("start", "n", "key"):
                e[name] = v.field(name).to_numpy(zero_copy_only=False)
            out.append(e[np.argsort(e["start"], kind="stable")].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc", "tag", "open"])


def _packed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, spans) with the maximal byte runs to remove from a document as one compact value."""
    for b in batches:
        out = []
        for x in b.column(2):
            start = x.values.field("start").to_numpy(zero_copy_only=False)
            end = start + x.values.field("n").to_numpy(zero_copy_only=False) + LEAST - 1
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            first = np.ones(len(start), bool)
            first[1:] = start[1:] > end[:-1]  # touching runs are one
            at = np.nonzero(first)[0]
            e = np.zeros(len(at), _SPAN)
            e["start"], e["end"] = start[at], end[np.append(at[1:], len(end)) - 1]
            out.append(e.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc", "tag", "spans"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, tag, start, data) of each open stretch of (doc, tag, text, open)."""
    for b in batches:
        for i in range(b.num_rows):
            doc, tag, text, blob = (b.column(k)[i].as_py() for k in range(4))
            raw, e = text.encode("utf-8", "surrogatepass"), np.frombuffer(blob, _OPEN)
            yield pa.RecordBatch.from_arrays([
                pa.array(e["key"]), pa.array(np.full(len(e), doc, np.int64)), pa.array(np.full(len(e), tag, np.int64)), pa.array(e["start"].astype(np.int64)),
                pa.array([raw[a : a + m + LEAST - 1] for a, m in zip(e["start"].tolist(), e["n"].tolist(), strict=True)], pa.binary()),
            ], names=["key", "doc", "tag", "start", "data"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of (doc_id, text, spans)."""
    for b in batches:
        rows = []
        for doc_id, text, blob in zip(b.column(0), b.column(1), b.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs = np.frombuffer(blob.as_py() or b"", _SPAN).tolist()
            edges = [0, *(x for run in runs for x in run), len(raw)]
            left = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id.as_py(), len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, tag, doc_id, text): the id that orders, NO_ID for null, and the text's checksum."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
    )


def _meet(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc, tag, ...) with ``by_doc``, a written table of one compact row per document: broadcast if its files
    are small, else both sides are dealt by document."""
    size = int(by_doc._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.join(F.broadcast(by_doc) if size <= BROADCAST_BYTES else by_doc, ["doc", "tag"], how)


def spans(docs: DataFrame) -> DataFrame:
    """(doc, tag, spans) of documents that lose bytes, with the runs packed."""
    small_batches(docs.sparkSession)
    d = _rows(docs)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, total // BUCKET_BYTES)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (64 * BUCKET_BYTES)))
    hot_keys = _hot_keys(d)
    entries = d.select("doc", "text").mapInArrow(lambda it: _bucketed(it, buckets, hot_keys, parts), "bucket long, blob binary")
    found = entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _settled(it, buckets, parts), _FOUND)
    found = cut(found)
    open_ = found.filter("key >= 0").select("doc", "tag", "start", "n", "key")
    if len(hot_keys):
        open_ = open_.unionByName(cut(_open_hot(found.filter("key < 0"))))
    by_doc = open_.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "key")).alias("open"))
    by_doc = cut(by_doc.mapInArrow(_packed_open, "doc long, tag long, open binary"))
    texts = _meet(d, by_doc, "inner")
    fetched = texts.select("doc", "tag", "text", "open").mapInArrow(_fetched, "key long, doc long, tag long, start long, data binary")
    # Keys of several blocks: fewer than one in SPLIT of the open stretches.
    many = cut(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).select(F.col("key").alias("m_key"), F.ceil(F.col("n") / SPLIT).alias("blocks")))
    dealt = fetched.join(sized(many), F.col("key") == F.col("m_key"), "left")
    dealt = dealt.select("key", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc", "start"), F.col("blocks"))).cast("int").alias("part"), F.col("blocks").isNotNull().alias("split"), "doc", "tag", "start", "data")
    compared = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_compared, _COMPARED)
    gone = found.filter("key is null").select("doc", "tag", "start", "n")
    if many.isEmpty():
        gone = gone.unionByName(compared.select("doc", "tag", "start", "n"))
    else:
        compared = cut(compared)
        held = compared.filter("string is not null")
        first = held.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("string", "low")
        late = held.join(first, "string").filter("low < doc").select("doc", "tag", "start", "n")
        gone = gone.unionByName(compared.filter("string is null").select("doc", "tag", "start", "n")).unionByName(late)
    gone = gone.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return cut(gone.mapInArrow(_packed_spans, "doc long, tag long, spans binary"))


def dedup(docs: DataFrame, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes, per row."""
    d = _meet(_rows(docs), spans(docs), "left")
    out = d.select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if kept else out.drop("kept")
