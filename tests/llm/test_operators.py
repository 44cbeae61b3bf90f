"""Every operator on a fixture of hard cases against its plain form."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permitflow.llm import common, decontam, html_extract, line_dedup, packing, quality, simhash, suffix_dedup, token_rollup, toxicity, url_filter
from permitflow.llm.queries import tokenizer_path
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, row string"


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "on", "é", "and", "Zu", "x1", "q", "Ä"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    lines = [f"{prose(12)} {i}" for i in range(6)]
    passage = prose(70)
    out = []
    for i in range(60):
        t = "\n".join([prose(rnd.randint(3, 80)), rnd.choice(lines), prose(rnd.randint(1, 60))])
        if i % 5 == 0:
            t = f"{t} {passage} tail{i}"
        if i % 7 == 3:
            t = out[rnd.randrange(len(out))][1] or ""
        if i % 11 == 4 and out:
            t = (out[-1][1] or "") + " more"
        out.append((i, t, rnd.choice(["en", "de", None]), f"src{i % 12}", len(t)))
    extra = [
        (60, None, None, None, None), (61, "", "en", "src0", 0), (62, " \t\n", "en", "src1", 3), (63, "a", "en", "src1", 1), (64, "ab " * 400, "en", "src2", 1200), (65, "a" * 300, "en", "src3", 300),
        (66, "a" * 200, "en", "src3", 200), (67, "x\n\nx\n\n\nx " + "🙂 é\u00a0b\x85 " * 30, "fr", "src4", 0), (68, "word%%% " * 100, "en", "src5", 0), (69, passage, "en", "src6", 0), (70, "\n".join([lines[0]] * 3), "en", "src7", 0),
    ]
    return [(*r, "clash", "clash", "clash") for r in out + extra]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and rows that repeat, wholly or in their id."""
    r = [(None, "one two three four five", "en", "s"), (None, "one two three four five", "en", "s"), (3, "one two three four five", None, None), (3, "one two three four five", None, None), (3, "other words here", "en", "s"), (None, None, None, None)]
    return spark.createDataFrame(r, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, rows, odd, none):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for d, text, *_ in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), d
        assert not (r.base_failed and r.kept)
    assert not got[68].kept
    assert quality.quality(odd).count() == 6 and quality.quality(none).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.filter_documents(none).count() == 0


def test_quality_fence_adapts(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "a") for i in range(150)]
    noisy = [(200 + i, " ".join(f"w{i}#x{j}" for j in range(80)), "en", "b") for i in range(150)]
    df = spark.createDataFrame([*clean, *noisy, (999, " ".join(f"q{j}###" for j in range(80)), "en", "a"), (998, " ".join(f"v#x{j}" for j in range(80)), "en", "a")], "doc_id long, text string, lang string, source string")
    bad = {r["doc_id"] for r in quality.quality(df).filter("not kept").collect()}
    assert bad == {999, 998}  # what is usual in source b is not in source a


def test_line_dedup(docs, rows, odd, none):
    want = brute.line_dedup([(r[0], r[1], r[3]) for r in rows])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == dict(zip([r[0] for r in rows], want, strict=True))
    assert any(w != r[1] for w, r in zip(want, rows, strict=True))
    rep = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert all(rep[r[0]].text_md5 == hashlib.md5((w or "").encode()).hexdigest() for r, w in zip(rows, want, strict=True))
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(odd, 1).count() == 6 and line_dedup.dedup_lines(none).count() == 0
    few = brute.line_dedup([(r[0], r[1], r[3]) for r in rows], 2)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, 2).collect()} == dict(zip([r[0] for r in rows], few, strict=True))


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 7 and all(30 <= m.bit_count() <= 40 for m in masks)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    tree = simhash.mask_tree()
    assert max(64 - m.bit_count() for m in tree[-1]) <= 8


def test_simhash(docs, rows, odd, none):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute.fingerprint(r[1]) for r in rows]
    want = brute.components([r[0] for r in rows], prints)
    for r, f, c in zip(rows, prints, want, strict=True):
        assert (got[r[0]].fingerprint, got[r[0]].component_id) == (format(f, "016x"), c)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want)
    o = simhash.near_duplicates(odd).collect()
    assert len(o) == 6 and sorted((r.doc_id or -1, r.component_id if r.component_id is not None else -1) for r in o) == [(-1, -1), (-1, 3), (-1, 3), (3, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_dense_group(spark):
    """Many fingerprints close together: buckets are refined, and no link is lost."""
    rnd = random.Random(11)
    centre = rnd.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        f = rnd.choice(sorted(fps)) if rnd.random() < 0.5 else centre
        for _ in range(rnd.randint(1, 2)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4).cache()
    edges = {(r["a"], r["b"]) for r in simhash.links(nodes).collect()}
    s = [signed(f) for f in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(s) for b in s[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert edges == want and len(want) > 400
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes)).collect()}
    comp = brute.components(s, fps)
    assert [label.get(x, x) for x in s] == comp


def test_decontamination(spark, docs, rows, odd, none):
    texts = [r[1] for r in rows]
    w = brute.ITEM_WORDS.findall(texts[0].translate(brute.LOWER))
    items = [(1, " ".join(w[:12])), (2, " ".join(w[3:40])), (10, "ab ab ab"), (11, "x"), (12, None), (13, " ... "), (14, " ".join(["ab"] * 14)), (15, texts[69]), (16, "no such words here at all but many of them indeed so"), (None, " ".join(w[20:29]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, b).collect()}
    want = brute.decontaminate(texts, items)
    for r, x in zip(rows, want, strict=True):
        g = got[r[0]]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == x, r[0]
    assert sum(x[4] for x in want) > 8
    assert {r["doc_id"] for r in decontam.clean_documents(docs, b).collect()} == {r[0] for r, x in zip(rows, want, strict=True) if not x[4]}
    assert decontam.report(odd, b).count() == 6 and decontam.report(none, b).count() == 0
    assert decontam.report(docs, b.limit(0)).filter("contaminated").count() == 0


def test_items_that_share_an_id(spark, docs, rows):
    """Texts of unequal length under one id, and two without: each has windows of its own text, and they count as one item."""
    w = brute.ITEM_WORDS.findall(rows[0][1].translate(brute.LOWER))
    items = [(1, " ".join(w[:12])), (1, " ".join(w[:30])), (1, " ".join(w[5:40]) + " tail of another"), (None, " ".join(w[2:14])), (None, " ".join(w[:25]))]
    got = {r["doc_id"]: r for r in decontam.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for r, x in zip(rows, brute.decontaminate([r[1] for r in rows], items), strict=True):
        g = got[r[0]]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == x, r[0]


def test_decontamination_by_shuffle(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    items = [(1, " ".join(brute.ITEM_WORDS.findall(rows[0][1])[:15]))]
    got = {r["doc_id"]: r["n_hit"] for r in decontam.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[r[0]] for r in rows] == [x[1] for x in brute.decontaminate([r[1] for r in rows], items)]


def test_packing(docs, rows, odd, none):
    path = tokenizer_path()
    got = packing.pack_documents(docs, path).collect()
    pieces = brute.token_pieces([r[1] for r in rows], path)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((r[0], i, *x) for r, p in zip(rows, pieces, strict=True) for i, x in enumerate(p))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack_documents(odd, path).count() == 6 and packing.pack_documents(none, path).count() == 0


def test_ids_are_the_librarys():
    """The cached encoder against the library with its defaults, on strings made to part them."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    encode, library = packing.encoder(path), Tokenizer.from_file(path)
    rnd = random.Random(1)
    parts = ["a", "b", "é", "the", " ", "  ", "\n", "\n\n", " \n", "\n ", "\xa0", "\u2028", "\u3000", "\t", "\r\n", "<|endoftext|>", "<|", "'s", "don't", "123", "x1", "!?", "🙂", "\x85", "\x1c", "a\u0328\u0301", "中文", "שלום", "-", "\u200b", "\ufeff", "\u180e", "ßé", "’s", "ª²", "plain prose of words"]
    for _ in range(20_000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert np.frombuffer(encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s
    assert np.frombuffer(encode("<|endoftext|>"), "<u4").tolist() == [50256]
    assert np.frombuffer(encode("a\xa0b\n\xa0"), "<u4").tolist() == [64, 1849, 65, 44320]


def test_packing_tree(spark):
    """Small chunks leave underfull bins that later rounds merge."""
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(1, 400, 3000).tolist()
    p = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(8)
    got = packing.pack(packing.cut(p), chunk=40).collect()
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.doc_id for r in got) == list(range(3000))
    for s in fill.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    assert len(fill) <= 1.08 * sum(sizes) / 1024


def test_suffix_dedup(docs, rows, odd, none):
    want = brute.repeats([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    for d, x in want.items():
        g = got[d]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == x, d
        assert hashlib.sha256(bytes(g.kept)).hexdigest() == x[3]
    assert sum(x[1] > 0 for x in want.values()) > 10
    assert suffix_dedup.dedup(odd).count() == 6 and suffix_dedup.dedup(none).count() == 0


def test_suffix_dedup_repeated_ids(spark):
    """Rows of one id, or of none, keep their own results."""
    rnd = random.Random(4)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, "x" + b + c), (None, c + a), (None, c), (None, c)]
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 120, 0), (1, 120, 0), (1, 120, 0), (2, 241, 120), (99, 120, 120), (99, 120, 120), (99, 240, 240)]


@pytest.mark.parametrize(("name", "value"), [("HOT", 1), ("SPLIT", 1), ("SPLIT", 3), ("BROADCAST_BYTES", 0), ("CHUNK", 100)])
def test_suffix_dedup_other_ways(docs, rows, monkeypatch, name, value):
    monkeypatch.setattr(suffix_dedup, name, value)
    want = brute.repeats([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, kept=False).collect()}
    assert got == want


@pytest.mark.parametrize("split", [4096, 2])
def test_suffix_dedup_hot_keys(spark, docs, rows, monkeypatch, split):
    """Keys that are dealt out by stretch, then compared in one block or in several."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    hot = suffix_dedup._hot_keys(suffix_dedup._rows(docs))
    assert len(hot) > 5
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "_hot_keys", lambda d: hot)
    want = brute.repeats([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, kept=False).collect()} == want


def test_bounded_intervals_against_sorting():
    rnd = random.Random(9)
    for _ in range(40):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))).encode() for _ in range(rnd.randint(1, 30))]
        ids = np.array([rnd.randint(0, 9) for _ in strings])
        low, offsets = suffix_dedup.owners(strings, ids, least=6)
        first = {}
        for s, d in zip(strings, ids, strict=True):
            for i in range(len(s) - 5):
                first[s[i : i + 6]] = min(first.get(s[i : i + 6], 99), d)
        for k, s in enumerate(strings):
            for i in range(len(s) - 5):
                assert low[offsets[k] + i] == first[s[i : i + 6]]


def test_token_rollup(spark, tmp_path, odd):
    store = token_rollup.TokenRollup(spark, str(tmp_path / "store"))
    cols = "doc_id long, source string, lang string, version string, n_tokens long, action string, seq long"
    a = spark.createDataFrame([(1, "s", "en", "v1", 10, "upsert", 0), (2, "s", "en", "v1", 5, "upsert", 0), (2, "s", "en", "v1", 7, "upsert", 1), (3, "t", None, "v1", 1, "upsert", 0), (None, "s", "en", "v1", 2, "upsert", 0)], cols)
    b = spark.createDataFrame([(1, "t", "en", "v1", 11, "upsert", 0), (2, None, None, "v1", None, "delete", 0), (9, None, None, "v1", None, "delete", 0), (1, "s", "en", "v2", 4, "upsert", 0)], cols)
    key = lambda x: sorted(((r.source, r.lang or "", r.version, r.n_docs, r.n_tokens) for r in x.collect()), key=str)
    assert store.commit("a", a)
    assert key(store.totals()) == [("s", "en", "v1", 3, 19), ("t", "", "v1", 1, 1)]
    assert not store.commit("a", a)
    assert store.commit("b", b) and not store.commit("b", b) and store.commit("c", a.limit(0))
    assert key(store.totals()) == [("s", "en", "v1", 1, 2), ("s", "en", "v2", 1, 4), ("t", "", "v1", 1, 1), ("t", "en", "v1", 1, 11)]
    both = token_rollup.TokenRollup(spark, str(tmp_path / "store"))
    x = spark.createDataFrame([(50, "s", "en", "v9", 3, "upsert", 0)], cols)
    # Another writer commits between this one's reading and its rename: the number is taken, and it tries again.
    publish, raced = store._publish, []

    def late(*a, **k):
        if not raced:
            raced.append(both.commit("e", x))
        return publish(*a, **k)

    store._publish = late
    assert store.commit("d", x.withColumn("n_tokens", F.lit(5))) and raced == [True]
    store._publish = publish
    assert [r for r in key(store.totals()) if r[2] == "v9"] == [("s", "en", "v9", 1, 5)] and store.batches() == ["a", "b", "c", "e", "d"]
    assert store.compact() and store.batches() == ["a", "b", "c", "e", "d"] and not store.commit("a", a)
    before = key(store.totals())
    assert store.prune() == 5 and key(store.totals()) == before and store.batches() == ["a", "b", "c", "e", "d"]
    assert store.commit("f", spark.createDataFrame([(50, None, None, "v9", None, "delete", 0)], cols)) and not any(r[2] == "v9" for r in key(store.totals()))
    store.commit("b2", a.limit(0))
    live = store.live().groupBy("source", "lang", "version").agg({"copies": "sum", "n_tokens": "sum"}).count()
    assert live == 4
    assert token_rollup.count_tokens(odd, tokenizer_path(), "v").count() == 6


def test_token_query_against_a_count(spark):
    from tokenizers import Tokenizer

    from permitflow.llm.queries import op6_token_counts

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(tokenizer_path())
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        marks.setdefault(r["doc_id"], []).append(r)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        m = marks.get(r["doc_id"], [])
        if any(x["toxic"] == 1 for x in m):
            continue
        text = (r["text"] or "").strip(" \t\r\n") if m and min(x["quality"] for x in m) == 0 else r["text"] or ""
        n, total = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, total + len(t.encode(text, add_special_tokens=False).ids))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in op6_token_counts(spark, sf).collect()}
    assert got == want


def test_token_counts_of_odd_rows(spark, odd, none, docs):
    c = token_rollup.count_tokens(odd, tokenizer_path(), "v").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in c) == [(-1, 0), (-1, 5), (-1, 5), (3, 3), (3, 5), (3, 5)]
    assert token_rollup.count_tokens(none, tokenizer_path(), "v").count() == 0
    assert token_rollup.count_tokens(docs, tokenizer_path(), "v").columns == ["doc_id", "source", "lang", "n_tokens", "version", "action", "seq"]


URLS = [
    ("http://Blog.Example.ORG/es/7?x", "blog.example.org", "/es/7", "example.org/es/", "block"), ("https://a.example.org/en/17", "a.example.org", "/en/17", "example.org/en/1", "block"), ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("x://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"), ("http://q.com/fr/a#b", "q.com", "/fr/a", "com/fr/", "allow"), ("http://q.net?a=/b", "q.net", "", None, None), ("no url", "", "", None, None),
    (None, "", "", None, None), ("http://É.Net/A/É", "É.net", "/A/É", None, None), ("://h.net/p://q", "h.net", "/p://q", None, None), ("http://org", "org", "", None, None),
]


def test_url_rules(spark):
    p = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(p, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == (verdict or "allow")
    assert url_filter.judge(p.limit(0), labels).count() == 0


def test_url_templates_learn_from_labels(spark):
    pages = [(i, f"http://a.net/{'spam' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i}") for i in range(300)]
    pages += [(1000 + i, f"http://b.net/u{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(300)] + [(1000 + i, 1, 0) for i in range(60)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(300))
    assert got[0].template == "/spam/*" and got[1].template.startswith("/")
    assert {got[1000 + i].template for i in range(60)} == {"/*/*"}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>gone</p> --><div class="cookie-notice"><p>We use cookies and the like for all of this and that.</p></div>
<div class=sideBar><p>The side of it all is that this was on the side for the most part and so on.</p></div>
<article><h1>Head &amp; line</h1><p><b>Fish &lt;and&gt; chips</b> are&nbsp;the   food<br>of the day and it is that which we eat for the most part.<p>Be.</p><p>x%%% y### z&amp;&amp;</p>
<aside>Related</aside><div class="ad">Buy it</div><form><label>Name</label><input></form><p>Last one, with <a href=x>a link</a> in it.</p></article>
<section id="comments"><p>I think that this is the best of all and it was not for me.</p></section><footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "\n\n".join([
        "Head & line", "Fish <and> chips are the food of the day and it is that which we eat for the most part.", "Be.", "x%%% y### z&&", "Last one, with a link in it.",
    ])
    plain = "<div><a href=1>Home</a> <a href=2>About</a></div><h2>Title</h2><p>" + "The cat sat on the mat and it was good for all. " * 4 + "</p><p>Short</p><div><a href=3>More</a></div>"
    assert html_extract.extract(plain).split("\n\n")[::2] == ["Title", "Short"]
    for bad in (None, "", "<", "<p", "<!--", "<script>", "</b></p>", "<a href='x", "a < b & c", "&#0;&bogus;"):
        html_extract.extract(bad)
    assert html_extract.extract("a &lt; b") == "a < b"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<p>é 🙂</p>")], "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_kernel_against_enumeration():
    from itertools import combinations

    def phi(s):
        out = {}
        for t in combinations(range(len(s)), 3):
            out[tuple(s[i] for i in t)] = out.get(tuple(s[i] for i in t), 0) + toxicity.DECAY ** (t[-1] - t[0] + 1)
        return out

    words = ["idiot", "idixot", "moron", "aaaa", "trash", "thrash", "xyzzy"]
    got = toxicity.weigh(words, toxicity._table(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = phi("^" + a), phi("^" + b)
            dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
            assert got[i, j] == pytest.approx(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, abs=1e-4)


def test_toxicity_learns_and_tolerates_gaps(spark, odd):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice(["ba", "re", "ti", "no", "es", "ul", "an"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "pathetic"]
    docs, labels = [], []
    for i in range(400):
        w = [rnd.choice(vocabulary) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(2):
                w[rnd.randrange(40)] = rnd.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(900, "ba re i d i o t ul an"), (901, "ba m.o.r.o.n ul"), (902, "ba moxron, es"), (903, None), (904, "z" * 500)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lb).collect()}
    assert len(got) == 405
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[900].predicted and got[901].predicted and got[902].predicted and not got[903].predicted and not got[904].predicted
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(odd, lb.limit(0)).count() == 6
    assert {r["score"] for r in toxicity.toxicity(odd, lb.limit(0)).collect()} != {None}


def test_suffix_dedup_memory_of_a_worker():
    """Both steps that hold many arrays at once, on more text than they take at a time."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    strings = [t[i : i + 70].encode() for t in texts[:800] for i in range(0, 1400, 70)]
    open_ = pa.RecordBatch.from_arrays([pa.array(x) for x in (range(len(strings)), [0] * len(strings), [True] * len(strings), range(len(strings)), [0] * len(strings), [0] * len(strings), strings)], names=["key", "part", "split", "doc", "tag", "start", "data"])

    def peak(rows):
        tracemalloc.start()
        for _ in rows:
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    assert peak(suffix_dedup._bucketed(iter([batch]), 1024, np.zeros(0, np.uint64), 4)) < 120
    assert peak(suffix_dedup._compared(iter([open_]))) < 50


def test_decontamination_words(spark):
    """The contract's words, of odd texts; and at less than four times the cost of a plain split (six to seven, when every
    match was extracted)."""
    texts = ["", " ", "a", "  a b", "a ", "A É é ßZ x1", "\x00a\x00　b", "\U0001d518ab \U0001f600 c", "١ ab-c\n\td e", "...", "İI", "a\x7fb\x80c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontam.words(F.col("text")).alias("w"))
    assert {r.text: r.w for r in df.collect()} == {t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(brute.LOWER)) for t in texts}
    long = spark.range(64).select(F.repeat(F.concat(F.lit("Some word "), "id", F.lit(" ")), 10_000).alias("text")).cache()

    def seconds(c):
        began = time.monotonic()
        long.select(c).write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    plain, own = (min(seconds(c) for _ in range(4)) for c in (F.split(F.lower("text"), " "), decontam.words(F.col("text"))))
    assert own < 4 * plain
