from __future__ import annotations

import random

import pytest

from permitflow.llm import url_filter


def judged(spark, urls, bad, unlabelled=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, 0 if bad(u) else 1, 0) for i, u in enumerate(urls) if i not in unlabelled], "doc_id long, quality int, toxic int")
    by_id = {r["page_id"]: r for r in url_filter.judge(pages, labels, []).collect()}
    return {u: by_id[i] for i, u in enumerate(urls)}


def verdicts(spark, urls, bad):
    """Verdict by url; the pages are all labelled."""
    return {u: r["verdict"] for u, r in judged(spark, urls, bad).items()}


def test_bad_section_of_a_wide_host_is_blocked(spark):
    names = ["north", "south", "east", "west", "upper", "lower"]
    urls = [f"https://hot.test/{a}{b}/{c}-page" for a in names for b in "abcde" for c in "pqrstuvwxyzhijkl"]
    got = verdicts(spark, urls, lambda u: "/easta/" in u)
    assert {u for u, v in got.items() if v == "block"} == {u for u in urls if "/easta/" in u}


def test_branches_that_part_at_the_fifth_segment(spark):
    urls = [f"https://deep.test/2024/{m}/{d}/world/{kind}/story-{x}" for m in (1, 2) for d in (3, 4) for kind in ("spam", "news") for x in "abcdefghijklmnop"]
    urls += [u.replace("/story-", "/a/b/c/story-") for u in urls]
    got = verdicts(spark, urls, lambda u: "/spam/" in u)
    assert all((v == "block") == ("/spam/" in u) for u, v in got.items())


def test_like_branches_merge_and_chance_makes_none(spark):
    """Bad sections of one share become one branch, and labels dealt by chance leave one wildcard."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bcdfghjk") for _ in range(6)) for _ in range(400)]
    urls = [f"https://a.test/{sec}/{w}" for sec in ("spam", "junk", "news", "blog", "talk") for w in words[:40]]
    urls += [f"https://b.test/{w}" for w in words]
    unlucky = {u for u in urls if "b.test" in u and rnd.random() < 0.2}
    got = judged(spark, urls, lambda u: "/spam/" in u or "/junk/" in u or u in unlucky)
    of = lambda part: {r["template"] for u, r in got.items() if part in u}
    assert of("/spam/") == of("/junk/") and len(of("/spam/")) == 1 and of("/news/") == of("/blog/") == of("/talk/") != of("/spam/") and len(of("/news/")) == 1
    assert of("b.test") == {"/*"}
    assert all((r["verdict"] == "block") == ("/spam/" in u or "/junk/" in u) for u, r in got.items())


def plain_purity(rows):
    """Smoothed share by (host, template) from the judged rows themselves."""
    own = {key: [r[2] for r in rows if (r[0], r[1]) == key and r[2] is not None] for key in {(r[0], r[1]) for r in rows}}
    seen = [v for v in own.values() if v]
    n, k = sum(map(len, seen)), len(seen)
    p = sum(map(sum, seen)) / n
    between = (sum(len(v) * (sum(v) / len(v) - p) ** 2 for v in seen) - (k - 1) * p * (1 - p)) / (n - sum(len(v) ** 2 for v in seen) / n - (k - 1))
    share = between / (p * (1 - p))
    w = max(1.0, min((1 - share) / share, n) if share > 0 else n)
    return {key: (sum(v) + w * p) / (len(v) + w) for key, v in own.items()}


def test_weight_follows_the_spread_between_templates():
    rnd = random.Random(5)

    def weight(draw):
        groups = [[rnd.random() < q for _ in range(20)] for q in (draw() for _ in range(2000))]
        b = [sum(g) for g in groups]
        return url_filter.smoothing(sum(b), 20 * len(b), len(b), sum(x * x / 20 for x in b), 400 * len(b))

    for a, b in ((1, 3), (4, 12), (0.5, 0.5)):  # beta-binomial of weight a + b
        prior, w = weight(lambda a=a, b=b: rnd.betavariate(a, b))
        assert w == pytest.approx(max(1, a + b), rel=0.25) and prior == pytest.approx(a / (a + b), abs=0.03)
    assert weight(lambda: 0.2)[1] > 100  # alike but for chance
    assert url_filter.smoothing(None, None, 0, None, None) == (0.0, 1.0) and url_filter.smoothing(0, 5, 2, 0.0, 13) == (0.0, 5.0)
    assert url_filter.smoothing(3, 3, 1, 3.0, 9)[0] == 1.0


def test_planted_template_among_the_sample_pages(spark):
    """A bad section added to a host of the sample is rejected; every other verdict and all shares are as counted by hand."""
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    planted = [(10_000 + i, f"http://planted.test/{'offers' if i % 4 == 0 else 'guide'}/x{chr(97 + i % 26)}/{i}") for i in range(200)]
    p = pages.unionByName(spark.createDataFrame(planted, "page_id long, url string"))
    marks = labels.unionByName(spark.createDataFrame([(i, 0 if "offers" in u else 1, 0) for i, u in planted], labels.schema))
    rows = url_filter.judge(p, marks).collect()
    assert {r["page_id"] for r in rows if r["verdict"] == "block" and r["page_id"] >= 10_000} == {i for i, u in planted if "offers" in u}
    bad = {r["doc_id"]: int(r["quality"] == 0 or r["toxic"] == 1) for r in marks.collect()}
    share = plain_purity([(r["host"], r["template"], bad.get(r["page_id"])) for r in rows])
    for r in rows:
        assert r["purity"] == pytest.approx(share[r["host"], r["template"]])
        if r["rule"] is None:
            assert r["verdict"] == ("block" if share[r["host"], r["template"]] >= url_filter.REJECT else "allow")


def test_repeated_rows_are_judged_each(spark):
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.net/x/1")] * 3 + [(None, None)] * 2, "page_id long, url string"), spark.createDataFrame([(1, 0, None), (1, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int"), []).collect()
    assert len(got) == 5 and sum(r["host"] == "" for r in got) == 2
