"""Hierarchical residual packing: best fit in each partition, then a tree of merges over the bins left underfull.

Documents become token ids plus an end id and are cut into pieces of at most CAPACITY tokens, a short piece first. Each
task packs its pieces by best-fit decreasing in runs of at most CHUNK. Bins with at most SLACK free tokens are emitted;
the rest go on, each as one item, to a coarser partitioning, where they are packed by best fit again, until one
partition has seen the last of them or a round brings nothing. Only (bin, fill) rows move between rounds.

Token ids are those of the ``tokenizers`` library for the file given, with its defaults: the name of an added token in a
text is that token. Words are looked up in a cache of what the library gave for them.

Defined edge cases: a null text counts as empty and gives the end id alone; a null doc_id is kept; repeated rows are
packed each by itself; a text of any length is encoded whole; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from struct import pack as struct_pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import cut, drop

CAPACITY = 1024
END = 2
CHUNK = 50_000
SLACK = 8
#: Words that a worker keeps the ids of, and the longest one kept.
CACHE, LONGEST = 200_000, 100

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, Callable[[str], bytes]] = {}


#: White space other than blanks and line feeds, by any library's tables; texts with it are never taken apart.
_ODD_SPACE = frozenset(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n") | frozenset("\u180e\u200b\ufeff")
#: What a text of blanks and line feeds falls into so that no token crosses a bound: a word with the blank before it, and
#: a run of white space up to the last one, which belongs to the next word or stands alone.
_UNITS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Below this character, letters and digits are the same by every version of Unicode's tables.
_STABLE = "\u0250"


def _byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies are written: printable bytes stand for themselves, the
    rest follow in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _ranked(made: dict) -> Callable[[str], list[int]] | None:
    """A quicker encoder of the same byte-pair vocabulary, which merges by id; None if its merges are in another order."""
    import public_tokenizers
    import tiktoken

    model, of = made["model"], _byte_letters()
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    added = {t["content"] for t in made.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids by ``tokenizers`` as little-endian unsigned 32-bit integers. One per worker process and path.

    A vocabulary of the byte-level kind, which splits at white space, is applied to each distinct word once, in the
    quicker encoder where both are sure to agree; texts that name an added token or hold unusual white space, and
    vocabularies of other kinds, are encoded whole by the library.
    """
    if path in _encoders:
        return _encoders[path]
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split = made.get("pre_tokenizer") or {}
    by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made.get("normalizer") is None and made["model"].get("type") == "BPE"
    quick = _ranked(made) if by_word else None
    names = [t["content"] for t in made.get("added_tokens", [])]
    del made
    cache: dict[str, bytes] = {}
    library = []  # loaded when the first text needs it

    def packed(text: str) -> bytes:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_unit(unit: str) -> bytes:
        if quick is None or not unit.isascii() and max(unit) >= _STABLE:
            return packed(unit)
        ids = quick(unit)
        return struct_pack(f"<{len(ids)}I", *ids)

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not by_word or not _ODD_SPACE.isdisjoint(text) or any(n in text for n in names):
            return packed(text)
        out = []
        for unit in _UNITS.findall(text):
            got = cache.get(unit)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = of_unit(unit)
                if len(unit) <= LONGEST:
                    cache[unit] = got
            out.append(got)
        return b"".join(out)

    _encoders[path] = encode
    return encode


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece, step = 0, 0, n % capacity or capacity
                doc = doc_id.as_py()
                while at < n:
                    rows.append((doc, piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])))
                    at, piece, step = at + step, piece + 1, capacity
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, capacity), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin. Equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the distinct free rooms, sorted: at most ``capacity`` of them
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            own = open_by_room[room]
            target = own.pop()
            if not own:
                del open_by_room[room]
                rooms.pop(k)
        else:
            target, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = target, fill[target]
        fill[target] += size
        room -= size
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append(target)
    return bins, offsets, np.array(fill, np.int64)


def _packer(carry: list[str], level: int, capacity: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs a partition in runs of ``chunk`` rows. Adds bin (an id unique over levels and partitions), off and fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        next_bin = (level << 56) + (task << 32)

        def pack(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal next_bin
            t = pa.Table.from_batches(parts).combine_chunks()
            sizes = t.column("length").to_numpy()
            bins, offsets, fill = best_fit(sizes, capacity)
            t = t.select(carry).append_column("bin", pa.array(bins + next_bin)).append_column("off", pa.array(offsets)).append_column("fill", pa.array(fill[bins]))
            next_bin += len(fill)
            yield from t.to_batches()

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, chunk - n)
                held.append(take)
                n += take.num_rows
                b = b.slice(take.num_rows)
                if n == chunk:
                    yield from pack(held)
                    held, n = [], 0
        if n:
            yield from pack(held)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, chunk: int = CHUNK) -> DataFrame:
    """``pieces`` (a written table with ``length``) plus sequence_id and offset."""
    carry = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # Reading a written table deals rows out the same way each time, so a task that runs again packs the same bins.
    placed = cut(pieces.mapInArrow(_packer(carry, 0, capacity, chunk), f"{schema}, bin long, off long, fill long"))
    under = lambda t: t.filter(F.col("fill") < capacity - slack).select("bin", F.col("fill").alias("length")).distinct()
    items = cut(under(placed))
    n = items.count()
    moves: DataFrame | None = None
    level = 1
    while n > 1:
        parts = -(-n // chunk)
        # Dealt and ordered by value, so that a task that runs again sees the same items in the same order.
        dealt = items.repartition(parts, F.xxhash64("bin", F.lit(level))) if parts > 1 else items.coalesce(1)
        dealt = dealt.sortWithinPartitions("bin").withColumnRenamed("bin", "was")
        packed = cut(dealt.mapInArrow(_packer(["was"], level, capacity, chunk), "was long, bin long, off long, fill long"))
        step = packed.select("was", F.col("bin").alias("now"), F.col("off").alias("add"))
        if moves is None:
            moves = step
        else:
            s = step.withColumnRenamed("was", "via").withColumnRenamed("now", "then").withColumnRenamed("add", "more")
            moves = cut(moves.join(s, F.col("now") == F.col("via"), "left").select("was", F.coalesce("then", "now").alias("now"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add")))
        left = cut(under(packed))
        now = left.count()
        level += 1
        done = parts == 1 or now == n
        drop(items)
        items, n = left, now
        if done:
            break
    drop(items)
    if moves is None:
        return placed.select(*carry, F.col("bin").alias("sequence_id"), F.col("off").alias("offset"))
    j = placed.join(moves, F.col("bin") == F.col("was"), "left")
    return j.select(*carry, F.coalesce("now", "bin").alias("sequence_id"), (F.col("off") + F.coalesce("add", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of every document."""
    return pack(cut(pieces(docs, path, capacity)), capacity)
