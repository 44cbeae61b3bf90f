"""URL filter: rules first, then a path-template tree per host, in DataFrame functions only.

Paths are cut into segments. Runs of digits and long hexadecimal names become wildcards by their form, so that counts
combine early. The rest of the tree is learned from the data, depth by depth, among the children of one node (host and
template so far):

* A child whose share of bad labels does not differ from that of all its siblings together, by a test that allows for
  their number, is a variable: it joins the node's wildcard branch.
* Children that do differ are put into bands of like shares, and bands are compared branch with branch, from the lowest
  up: two whose shares do not differ significantly become one. A branch of one child keeps its name.

A template is rejected if its smoothed share of bad labels, (bad + weight * prior) / (labelled + weight) with the
corpus's share as prior, reaches REJECT. The weight comes from the templates themselves: it is that of the beta-binomial
whose spread between templates is the one seen beyond chance. Where templates differ much, a few labels say a lot about
one; where they differ no more than by chance, each is taken for the corpus. LEAST_WEIGHT labels at least are added, so that
one label alone decides nothing.

The tree works on counts per (host, path form), not on pages, so a hot host is combined map-side before any shuffle. A
node's bands are at most BANDS, however many children it has.

Defined edge cases: a null url, or one without ``://``, has an empty host and path and forms a template of its own; an
unlabelled page counts in no share; with no labels at all nothing is rejected; several labels of one page count once,
bad if any is; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitflow.llm.common import LOWER, UPPER, cut

#: (verdict, host, start of the path), a configuration list. The longest rule that fits wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Standard deviations beyond which two shares differ; a child's test adds what the largest of its siblings' deviations
#: reaches by chance.
Z = 2.0
BANDS = 20
LEAST_WEIGHT = 1.0
REJECT = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(F.translate(host, UPPER, LOWER)), empty(path)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Equally long rules: the first in text order."""
    name = verdict = None
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    for what, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def form(path: Column) -> Column:
    """The path with wildcards where a segment varies by its form: long hexadecimal names, then runs of digits."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=/)[0-9a-fA-F-]{16,}(?=/|$)", "*"), r"[0-9]+", "#")


def _branches(bands: DataFrame) -> DataFrame:
    """(host, tpl, band, as): the branch name of each band of a node's differing children. ``bands``: host, tpl, band,
    labelled, bad, width (children), only (one of them)."""
    entry = "struct<low:int,high:int,labelled:bigint,bad:bigint,width:bigint,only:string>"
    share = "(x.bad + g.bad) / (x.labelled + g.labelled)"
    alike = f"abs(x.bad / x.labelled - g.bad / g.labelled) <= {Z}D * sqrt({share} * (1 - {share}) * (1D / x.labelled + 1D / g.labelled))"
    joined = "named_struct('low', g.low, 'high', x.high, 'labelled', x.labelled + g.labelled, 'bad', x.bad + g.bad, 'width', x.width + g.width, 'only', g.only)"
    step = f"transform(slice(a, size(a), 1), g -> if({alike}, array({joined}), array(g, x)))"
    merged = f"aggregate(list, cast(array() as array<{entry}>), (a, x) -> if(size(a) = 0, array(x), concat(slice(a, 1, size(a) - 1), flatten({step}))))"
    one = F.struct(F.col("band").alias("low"), F.col("band").alias("high"), "labelled", "bad", "width", "only")
    node = bands.groupBy("host", "tpl").agg(F.array_sort(F.collect_list(one)).alias("list")).select("host", "tpl", F.posexplode(F.expr(merged)).alias("i", "g"))
    name = F.when(F.col("g.width") == 1, F.col("g.only")).otherwise(F.concat(F.lit("*"), F.col("i").cast("string")))
    return node.select("host", "tpl", F.explode(F.sequence("g.low", "g.high")).alias("band"), name.alias("as"))


def templates(forms: DataFrame) -> DataFrame:
    """(host, form, template) for every row of ``forms`` (host, form, n, labelled, bad), one row per host and form."""
    t = forms.select("host", "form", "n", "labelled", "bad", F.split("form", "/").alias("seg"), F.lit("").alias("tpl"), F.lit(False).alias("shut"))
    d = 0
    while True:
        d += 1
        t = cut(t.withColumn("s", F.when(~F.col("shut"), F.get("seg", F.lit(d)))))
        if t.filter("s is not null").isEmpty():
            break
        # Child counts, then node counts: each combined map-side and joined back, never a window over one host.
        child = t.filter("s is not null").groupBy("host", "tpl", "s").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        node = child.groupBy("host", "tpl").agg(F.count(F.lit(1)).alias("width"), F.sum("labelled").alias("p_labelled"), F.sum("bad").alias("p_bad"))
        c = child.join(node, ["host", "tpl"])
        # The share of all siblings, with one label of the node's share in case they have none.
        others = F.try_divide(F.col("p_bad") - F.col("bad") + F.try_divide("p_bad", "p_labelled"), F.col("p_labelled") - F.col("labelled") + 1)
        spread = F.sqrt(F.col("labelled") * others * (1 - others))
        beyond = F.abs(F.col("bad") - F.col("labelled") * others) > (Z + F.sqrt(2 * F.log(F.col("width").cast("double")))) * spread
        c = c.withColumn("differs", F.coalesce(beyond & (spread > 0), F.lit(False)))
        c = cut(c.withColumn("band", F.when(F.col("differs"), F.least(F.floor(BANDS * F.col("bad") / F.col("labelled")), F.lit(BANDS - 1)).cast("int"))))
        bands = c.filter("differs").groupBy("host", "tpl", "band").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("width"), F.min("s").alias("only"))
        named = c.join(_branches(bands), ["host", "tpl", "band"], "left")
        # A branch without labelled children has nothing left to tell apart: what lies deeper is one open tail.
        end = F.col("p_labelled") == 0
        named = named.select("host", "tpl", "s", F.when(end, "**").otherwise(F.coalesce("as", F.lit("*"))).alias("as"), end.alias("end"))
        t = t.join(named, ["host", "tpl", "s"], "left").select(
            "host", "form", "n", "labelled", "bad", "seg",
            F.when(F.col("as").isNull(), F.col("tpl")).otherwise(F.concat("tpl", F.lit("/"), "as")).alias("tpl"),
            (F.col("shut") | F.col("as").isNull() | F.col("end")).alias("shut"),
        )
    return t.select("host", "form", "n", "labelled", "bad", F.col("tpl").alias("template"))


def smoothing(bad: int | None, labelled: int | None, templates: int, bad_square: float | None, labelled_square: int | None) -> tuple[float, float]:
    """(prior, weight) by moments. ``bad_square``: sum of bad^2 / labelled over the templates with labels, of which there
    are ``templates``; ``labelled_square``: sum of labelled^2."""
    if not labelled:
        return 0.0, LEAST_WEIGHT
    p = bad / labelled
    chance = p * (1 - p)
    room = labelled - labelled_square / labelled - (templates - 1)
    between = (bad_square - labelled * p * p - (templates - 1) * chance) / room if room > 0 else 0.0
    share = between / chance if chance else 0.0  # of the spread that is between templates
    return p, max(LEAST_WEIGHT, min((1 - share) / share, float(labelled)) if share > 0 else float(labelled))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity per page row. ``labels``: doc_id of a page and its marks;
    a page of low quality or toxic text is bad."""
    host, path = parts(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("form", form(F.col("path")))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(bad.cast("int")).alias("mark"))
    p = cut(p)
    forms = p.join(marks, F.col("page_id") == F.col("l_id"), "left").groupBy("host", "form").agg(
        F.count(F.lit(1)).alias("n"), F.count("mark").alias("labelled"), F.coalesce(F.sum("mark"), F.lit(0)).alias("bad")
    )
    t = templates(cut(forms))
    stats = cut(t.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    square = F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("labelled")))
    whole = stats.agg(F.sum("bad"), F.sum("labelled"), F.count_if(F.col("labelled") > 0), square, F.sum(F.col("labelled") * F.col("labelled"))).first()  # five numbers
    prior, weight = smoothing(*whole)
    stats = stats.select("host", "template", ((F.col("bad") + weight * prior) / (F.col("labelled") + weight)).alias("purity"))
    by_form = cut(t.join(stats, ["host", "template"]).select(F.col("host").alias("f_host"), F.col("form").alias("f_form"), "template", "purity"))
    j = p.join(by_form, (F.col("host") == F.col("f_host")) & (F.col("form") == F.col("f_form")), "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return j.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "template", "purity")
