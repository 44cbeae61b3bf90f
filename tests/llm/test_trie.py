"""The conversation trie against a brute-force form, on odd rows and on small blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from permitflow.llm import conversation_trie
from permitflow.llm.queries import op11_conversation_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, shared=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [t[-1] for t in sorted(v)] for c, v in by.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shared(df):
    return conversation_trie.trie(df, lambda c: c - c % 20, lambda c: (F.crc32(c.cast("string")) % 4).cast("int"), 3)


def rows_of(df):
    assert df.columns == COLS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert rows_of(op11_conversation_trie(spark, SF)) == brute(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    rows = [(None, 0, "user", "no id"), (7, None, "user", "before all"), (7, None, None, None), (7, 1, None, "x y"), (41, 3, "a", "b"), (41, 3, "a", "b"), (41, 3, "a", "c")]
    for c in [0, 1, 2, 3, 20, 21, 22, 25, 45, 60, 61, 99, 1000, 10**12 + 1]:
        rows += [(c, t, rng.choice(["u", "s"]), rng.choice(["", "one", "one two", "three  four\tfive"])) for t in range(rng.choice([1, 2, 3, 5]))]
    # Many with the same turns, a chain that each lengthens by one, and one much longer than the rest.
    rows += [(c, t, "u", "same words here") for c in range(200, 240) for t in range(4)]
    rows += [(c, t, "u", f"t{t}") for c in range(300, 318) for t in range(318 - c)]
    rows += [(500, t, "u", f"long {t % 7}") for t in range(150)] + [(501, t, "u", f"long {t % 7}") for t in range(140)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [True, False])
def test_odd_rows_in_small_blocks(spark, odd, monkeypatch, share):
    monkeypatch.setattr(conversation_trie, "DEPTHS", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 2)
    df = spark.createDataFrame([(*r, 1, "x") for r in odd], f"{SCHEMA}, pos int, owner string").repartition(7)
    got = shared(df) if share else conversation_trie.trie(df)
    assert rows_of(got) == brute(odd, share)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(shared(none)) == [] and rows_of(shared(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA))) == []
    one = [(3, 1, "u", "t")]
    assert rows_of(shared(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_turns_of_one_conversation_lie_in_many_partitions(spark):
    rows = [(1, t, "u", f"w{t}") for t in range(4000)] + [(2, 0, "u", "w0")]
    numbered = conversation_trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(8))
    got = {(r["conv_id"], r["turn_pos"]) for r in numbered.select("conv_id", F.col("pos").alias("turn_pos")).collect()}
    assert got == {(1, t + 1) for t in range(4000)} | {(2, 1)}
