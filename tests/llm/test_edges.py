"""Odd rows, long texts, clashing columns and empty tables, with the values that they give."""

from __future__ import annotations

import hashlib
import html
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from permitflow.llm import decontam, html_extract, line_dedup, near_copies, packing, quality, simhash, suffix_dedup, toxicity
from permitflow.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.test_near_copies import kept as near

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows that repeat wholly or in their id, and a long text; columns with names that operators use inside."""
    long = " ".join(f"w{i}x{i % 13}" for i in range(60_000))
    base = [(None, "one two three four five"), (None, "one two three four five"), (3, "one two three four five"), (3, "other words here"), (3, None), (4, ""), (5, long), (5, long), (6, None)]
    r = [(d, t, None if i % 2 else "en", None if i % 3 else "s", 0, "x", "y", "z", "w") for i, (d, t) in enumerate(base)]
    return spark.createDataFrame(r, f"{DOCS}, row string, h string, key string, gone string").repartition(3).cache()


@pytest.fixture(scope="module")
def texts(odd):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]


def test_measures_and_fences_by_hand(spark, odd, texts):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted(((d, *brute.quality(t)) for d, t, *_ in texts), key=str)
    assert rows_of(quality.quality(odd), *cols) == want
    # Verdicts: quartiles of values in order, drawn towards the language's and the corpus's.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = [r.asDict() for r in quality.metrics(docs).collect()]
    base = [r for r in m if not r["base_failed"]]

    def quartile(group, c, p):
        v = sorted(r[c] for r in group)
        return v[max(0, math.ceil(p * len(v)) - 1)]

    def drawn(r, c, p):
        lang = [x for x in base if x["lang"] == r["lang"]]
        own = [x for x in lang if x["source"] == r["source"]]
        q = quartile(base, c, p)
        for g in (lang, own):
            q = (len(g) * quartile(g, c, p) + quality.PULL * q) / (len(g) + quality.PULL) if g else q
        return q

    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    for r in m:
        ok = not r["base_failed"]
        for c, (side, size, lump) in quality.MEASURES.items():
            if r["base_failed"]:
                break
            low, high = drawn(r, c, 0.25), drawn(r, c, 0.75)
            n = max(1.0, min(r[size], drawn(r, size, 0.5)))
            reach = quality.SPREADS * max(high - low, lump * math.sqrt(high * n / lump + 1) / n)
            ok = ok and r[c] <= high + reach and (side != "both" or r[c] >= low - reach)
        assert got[r["doc_id"]] == ok, r["doc_id"]


def test_a_group_moves_its_own_fence(spark):
    """Symbols in most texts of one source raise what that source may hold, and nobody else's threshold."""
    rng = random.Random(4)

    def text(symbols):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(120)]
        return " ".join(w + "#" * (i < symbols) for i, w in enumerate(words))

    plain = [(i, text(0), "en", f"s{i % 8}", 0) for i in range(800)]
    planted = [(d, text(rng.randint(20, 60)) if s == "s3" else t, lang, s, n) for d, t, lang, s, n in plain]
    drawn = []
    for rows in (plain, planted):
        docs = spark.createDataFrame(rows, DOCS)
        drawn.append({r["source"]: r for r in quality.thresholds(quality.metrics(docs)).collect()})
    assert drawn[0].keys() == drawn[1].keys()
    for s, before in drawn[0].items():
        after = drawn[1][s]
        assert (after["q3_symbol_ratio"] > 0.05 and after["q3_symbol_ratio"] > after["q1_symbol_ratio"]) if s == "s3" else after["q3_symbol_ratio"] == before["q3_symbol_ratio"] == 0
    # A text with forty symbols is usual in s3 and rejected elsewhere.
    extra = [(9000 + k, text(40), "en", f"s{k}", 0) for k in range(8)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(planted + extra, DOCS)).filter("doc_id >= 9000").collect()}
    assert got == {9000 + k: k == 3 for k in range(8)}


@pytest.mark.parametrize("page", ["<form>x " * (1 << 17), "<b>x" * 131_072 + "</i>" * 131_072, "<div class=sidebar><article>x " * 35_000, "<li><b>x" * 120_000], ids=["forms", "stray ends", "nested", "items"])
def test_a_million_characters_of_odd_markup(page):
    """Time and memory in proportion: unclosed elements, end tags without a start, and containers in containers."""
    import time
    import tracemalloc

    assert len(page) > 900_000
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 5
    tracemalloc.start()
    html_extract.extract(page[: len(page) // 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


def test_lines_of_odd_rows(odd, texts):
    out = line_dedup.dedup_lines(odd, 1)
    assert out.columns == odd.columns
    # The five words stand first in document 3; its line goes from the rows without an id, the rest stays where it is.
    got = rows_of(out, "doc_id", "text")
    seen = {t for d, t, *_ in texts if d == 3 and t}
    first_long = [t for d, t, *_ in texts if d == 5][0]
    assert [x for x in got if x[0] is None] == [(None, "")] * 2
    assert {t for d, t in got if d == 3} == seen | {None} and (6, None) in got and (4, "") in got
    assert {t for d, t in got if d == 5} <= {first_long, ""}


def test_spans_of_odd_rows(odd, texts):
    got = rows_of(suffix_dedup.dedup(odd), "doc_id", "n_bytes", "n_removed")
    assert got == sorted(((d, len((t or "").encode()), 0) for d, t, *_ in texts), key=str)


def test_pieces_of_odd_rows(odd, texts):
    path = tokenizer_path()
    got = packing.pack_documents(odd, path).collect()
    want = sorted((str(d), i, *x) for (d, *_), p in zip(texts, brute.token_pieces([t for _, t, *_ in texts], path), strict=True) for i, x in enumerate(p))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_windows_of_odd_rows(spark, odd, texts):
    items = [(1, "one two three four five"), (2, " ".join(f"w{i}x{i % 13}" for i in range(500, 530))), (3, None), (4, "")]
    got = rows_of(decontam.report(odd, spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((d, *x) for (d, *_), x in zip(texts, brute.decontaminate([t for _, t, *_ in texts], items), strict=True)), key=str)


def test_fingerprints_of_long_texts(odd, texts, monkeypatch):
    monkeypatch.setattr(simhash, "_SLICE", 1000)
    assert all(simhash.fingerprint(t) == brute.fingerprint(t) for t in {t for _, t, *_ in texts})
    assert rows_of(simhash.near_duplicates(odd), "doc_id", "fingerprint") == sorted(((d, format(brute.fingerprint(t), "016x")) for d, t, *_ in texts), key=str)


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rnd = random.Random(2)
    said = lambda: " ".join("".join(rnd.choice(["ba", "re", "ti", "no", "es", "a"]) for _ in range(rnd.randint(1, 4))) for _ in range(30))
    learn = spark.createDataFrame([(i, f"{said()} {'idiot' if i % 2 else 'friend'} {said()}") for i in range(40)] * 2, "doc_id long, text string")
    model = toxicity.fit(learn, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    bad = spark.createDataFrame([(1, "well, i d i o t it is"), (2, "an i-d-i-o-t. so"), (3, "a dear friend"), (4, "x" * 200_000 + " idixot")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(bad, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert toxicity.sentences("One two. Three i. d. i. o. t. four\n\nfive") == ["one two.", "three i. d. i. o. t. four", "five"]


def test_near_copies_bounds_hold():
    """The spread's bound is never below what two sets share."""
    rnd = random.Random(8)
    for _ in range(300):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(0, 400))]
        other = words[rnd.randint(0, 20) :] + [f"v{rnd.randrange(300)}" for _ in range(rnd.randint(0, 60))]
        a, b = near_copies.shingles(" ".join(words)), near_copies.shingles(" ".join(other))
        assert near_copies._most(near_copies._spread(a), near_copies._spread(b), len(a), len(b)) >= len(set(a.tolist()) & set(b.tolist()))


def page(rnd):
    """A page made of known parts, and its article's blocks."""
    said = ["the", "of", "and", "to", "in", "is", "it", "was", "for"]
    prose = lambda n: " ".join(rnd.choice(said) if rnd.random() < 0.4 else "".join(rnd.choice("abcdeé&<") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    blocks = [prose(rnd.choice([2, 5, 30, 80])) for _ in range(rnd.randint(2, 8))]
    blocks[rnd.randrange(len(blocks))] = prose(60)

    def mark(t):
        words = [html.escape(w) if rnd.random() < 0.9 else "".join(f"&#{ord(c)};" for c in w) for w in t.split(" ")]
        if rnd.random() < 0.5:
            i, e = rnd.randrange(len(words)), rnd.choice(["b", "em", "span"])
            words[i] = f"<{e}>{words[i]}</{e}>"
        return rnd.choice([" ", "\n  ", "\t"]).join(words)

    body = "".join(f"<p title='a>b'>{mark(t)}" + ("</p>" if rnd.random() < 0.7 else "") for t in blocks)
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>{prose(1).replace('<', '').replace('&', '')}x</a></li>" for i in range(5)) + "</ul>"
    noise = lambda: html.escape(prose(30))
    around = [f"<nav>{menu}</nav>", f"<header><p>{noise()}</p></header>", f"<div class='cookie-notice'><p>{noise()}</p></div>", f"<aside><p>{noise()}</p></aside>", f"<section id=comments><p>{noise()}</p></section>", f"<form><p>{noise()}</p></form>", f"<script>var a='<p>{noise()}</p>';</script>", f"<!-- <p>{noise()}</p> -->", f"<div class=advert>{noise()}</div>", f"<footer><p>{noise()}</p></footer>"]
    rnd.shuffle(around)
    k = rnd.randrange(len(around) + 1)
    shell = rnd.choice(["<article>%s</article>", "<main>%s</main>", "<div role=main>%s</div>", "<div class='content no-sidebar'><article>%s</article></div>", "<div class='with-sidebar'>%s</div>", "<div id='post'>%s</div>"])
    return f"<html><head><title>x</title><style>p{{}}</style></head><body>{''.join(around[:k])}{shell % body}{''.join(around[k:])}</body></html>", blocks


def test_pages_made_of_known_parts():
    rnd = random.Random(6)
    for _ in range(400):
        text, blocks = page(rnd)
        assert html_extract.extract(text) == "\n\n".join(blocks), text


def test_density_alone_finds_the_articles(spark):
    """Without their article tags, pages of prose give the same text: blocks decide, not the element."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r["html"]]
    same = [html_extract.extract(h) == html_extract.extract(h.replace("<article", "<div").replace("</article", "</div")) for h in pages]
    assert sum(same) >= 0.9 * len(same)


def test_page_edges(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>" * 50_000, "t"), (1, "u", "<p>a</p>" * 50_000, "t"), (2, None, None, None), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = rows_of(html_extract.extract_pages(df), "page_id", "n_chars")
    assert got == sorted([(1, 149_998), (1, 149_998), (2, 0), (None, 0)], key=str)


def test_near_copies_of_odd_rows(odd, texts):
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns
    want = near([(d, t) for d, t, *_ in texts])
    assert {r["doc_id"] for r in out.collect()} == want


def test_pipeline_of_odd_rows_and_none(spark, odd):
    for docs in (odd.select(*[f.split()[0] for f in DOCS.split(", ")]), odd, odd.limit(0)):
        frames = [docs]
        for name, stage in corpus_pipeline.STAGES:
            frames.append(corpus_pipeline.cut(stage(spark, frames[-1], SF)))
            if name != "best_fit_packing":
                assert frames[-1].columns == docs.columns, name
        # Only the long text has fifty words; both rows of it have one id, and so stay together.
        n = docs.count()
        ids = [{r["doc_id"] for r in f.collect()} for f in frames[1:]]
        assert all(x == ({5} if n else set()) for x in ids), ids


def test_clean_texts_keep_their_bytes(odd):
    r = suffix_dedup.dedup(odd).filter("doc_id = 5").first()
    assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert packing.pieces(odd.filter(F.col("text").isNull()), tokenizer_path()).count() == 2
