"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The urls that a rule judges are the labelled ones; the trees learn from them what blocked urls look like and judge the urls that no rule fits.
Everything on the way is a DataFrame or SQL expression: features (lengths, depth, ratio of digits, entropy of the characters, counts of
parameters, labels and hyphens, statistics of the host's suffix), histograms of gradients by node, feature and bin (one grouped aggregate for
each level of a tree), and the trees themselves, which become CASE expressions. The driver sees histograms only: nodes x features x bins rows.
Gradients are added up as whole numbers, so the trees do not depend on the order of rows.

The trees learn from a sample of distinct labelled urls, ``sample`` of them in expectation, chosen by the urls' hashes; rules and verdicts cover all
rows. A suffix (the host's last label) has statistics of its own if the sample holds ``SUPPORT`` urls of it, which bounds their number by
sample / SUPPORT; the others share one.

Defined cases. Urls that are null or hold no ``://`` have an empty host and path and are judged by the trees like an empty url. Without any
labelled url, or with labels of one kind, all urls that no rule fits get that one verdict (allow without labels). Repeated urls and ids are rows of
their own and get equal verdicts. Empty tables give no rows. Columns besides id and url are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of the task: verdict, host and path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

TREES, DEPTH, BINS, SAMPLE, SUPPORT, RATE, RIDGE = 10, 3, 16, 20_000, 20, 0.4, 5.0
#: Least sum of second derivatives on each side of a split.
LEAST = 2.0
#: Gradients are whole multiples of one in this.
UNIT = 1 << 24

NUMBERS = [
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "suffix_blocked"
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased), ``path`` and ``query`` to a frame with ``url``."""
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")  # a null url has no ://
    split = pages.withColumn("rest", rest).withColumns(
        {
            "host": _lower(F.regexp_extract("rest", r"\A([^/?#]*)", 1)),
            "path": F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1),
            "query": F.regexp_extract("rest", r"\A[^?#]*\?([^#]*)", 1)
        }
    )
    return split.drop("rest")


def fitting_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits ``host`` and ``path``; nulls if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in reversed(longest_first):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, from runs in the sorted characters."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))
    bits = lambda n: F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1)))).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        same = a["c"] == x
        return F.struct(
            x.alias("c"), F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            F.when(same, a["sum"]).otherwise(a["sum"] + bits(a["run"])).alias("sum")
        )

    letters = F.array_sort(F.split(text, ""))
    n = F.length(text)
    inside = F.aggregate(letters, start, step, lambda a: a["sum"] + bits(a["run"]))
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1))) - inside / F.greatest(n, F.lit(1))).otherwise(0.0)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def with_numbers(urls: DataFrame, suffixes: dict[str, float], other: float) -> DataFrame:
    """Adds the lexical features to a frame with ``url``, ``host``, ``path`` and ``query``. ``suffixes``: share of blocked urls by the host's last label."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    suffix = F.substring_index("host", ".", -1)
    blocked = F.lit(float(other))
    if suffixes:
        table = F.create_map(*[x for k, v in sorted(suffixes.items()) for x in (F.lit(k), F.lit(float(v)))])
        blocked = F.coalesce(F.try_element_at(table, suffix), blocked)
    return urls.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.when(n > 0, _count(url, "0123456789") / F.greatest(n, F.lit(1))).otherwise(0.0).cast("double"),
            "entropy": _entropy(url).cast("double"),
            "parameters": F.size(F.filter(F.split("query", "&"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.filter(F.split("host", r"\."), lambda x: x != "")).cast("double"),
            "hyphens": _count(F.col("host"), "-").cast("double"),
            "suffix_blocked": blocked
        }
    )


@dataclass
class Model:
    base: float
    #: A tree is a leaf's value or (feature, greatest value that goes left, left, right).
    trees: list = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    other: float = 0.0

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{float(self.base)!r}D", *map(_value, self.trees)]))


def _value(t) -> str:
    """SQL for a tree's value."""
    if not isinstance(t, tuple):
        return f"({float(t)!r}D)"
    name, most, left, right = t
    return f"CASE WHEN {name} <= {float(most)!r}D THEN {_value(left)} ELSE {_value(right)} END"


def _nodes(t, number: int = 1) -> str:
    """SQL for the number of the leaf that a row comes to: the root is 1, the children of k are 2k and 2k + 1."""
    if not isinstance(t, tuple):
        return str(number)
    name, most, left, right = t
    return f"CASE WHEN {name} <= {float(most)!r}D THEN {_nodes(left, 2 * number)} ELSE {_nodes(right, 2 * number + 1)} END"


def _gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def _bins(edges: dict[str, list[float]]) -> Column:
    """The bins of all features that have edges: an array of (feature's place among them, number of edges below the value)."""
    usable = [f for f in NUMBERS if edges[f]]
    below = lambda f: F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges[f]]), lambda x: x < F.col(f)))
    return F.array(*[F.struct(F.lit(i).alias("f"), below(f).alias("b")) for i, f in enumerate(usable)])


def _grown(rows: DataFrame, margin: Column, edges: dict[str, list[float]], depth: int) -> object:
    """One tree on rows with ``blocked`` (0 or 1), the features' values and ``bins``: a grouped aggregate a level."""
    p = 1 / (1 + F.exp(-margin))
    base = rows.withColumn("p", p).withColumns(
        {"g": F.round((F.col("blocked") - F.col("p")) * UNIT).cast("long"), "h": F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long")}
    )
    usable = [f for f in NUMBERS if edges[f]]
    tree: object = 0.0
    closed: dict[int, float] = {}
    for _ in range(depth):
        hist = base.select(F.expr(_nodes(tree)).alias("node"), "g", "h", F.explode("bins").alias("x")).groupBy("node", "x.f", "x.b").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")
        ).collect()
        by_node: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in hist:
            by_node.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"] / UNIT, r["h"] / UNIT)
        splits: dict[int, tuple] = {}
        for node, features in sorted(by_node.items()):
            if node in closed:
                continue
            g, h = (sum(x[i] for x in features[0].values()) for i in (0, 1))
            best = (1e-6, 0, 0.0)
            for f in sorted(features):
                left_g = left_h = 0.0
                for b, most in enumerate(edges[usable[f]]):
                    more = features[f].get(b, (0.0, 0.0))
                    left_g, left_h = left_g + more[0], left_h + more[1]
                    if min(left_h, h - left_h) < LEAST:
                        continue
                    won = _gain(left_g, left_h) + _gain(g - left_g, h - left_h) - _gain(g, h)
                    if won > best[0] + 1e-9:
                        best = (won, f, most, left_g, left_h)
            if len(best) > 3:
                _, f, most, left_g, left_h = best
                splits[node] = (usable[f], most, RATE * left_g / (left_h + RIDGE), RATE * (g - left_g) / (h - left_h + RIDGE))
            else:
                closed[node] = RATE * g / (h + RIDGE)
        tree = _split(tree, 1, splits, closed)
        if not splits:
            break
    return tree


def _split(t, number: int, splits: dict[int, tuple], closed: dict[int, float]):
    if isinstance(t, tuple):
        name, most, left, right = t
        return name, most, _split(left, 2 * number, splits, closed), _split(right, 2 * number + 1, splits, closed)
    return splits.get(number, closed.get(number, t))


def fit(
    labelled: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, sample: int = SAMPLE
) -> Model:
    """Trees from a frame with ``url`` and ``blocked`` (boolean). An url with labels of both kinds counts as blocked."""
    known = labelled.where("url is not null and blocked is not null").select("url", "blocked")
    n = known.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    if not n:
        return Model(-math.inf)
    share = min(1.0, sample / n)
    some = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    some = scratch.table(with_parts(some.groupBy("url").agg(F.max("blocked").cast("int").alias("blocked"))))
    by_suffix = some.groupBy(F.substring_index("host", ".", -1).alias("s")).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    total = some.agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).first()
    if not total["n"]:
        return Model(-math.inf)
    if total["b"] in (0, total["n"]):
        scratch.drop(some)
        return Model(math.inf if total["b"] else -math.inf)
    prior = total["b"] / total["n"]
    often = by_suffix.where(F.col("n") >= SUPPORT).collect()
    suffixes = {r["s"]: (r["b"] + 10 * prior) / (r["n"] + 10) for r in often}
    rare_n, rare_b = total["n"] - sum(r["n"] for r in often), total["b"] - sum(r["b"] for r in often)
    model = Model(math.log(prior / (1 - prior)), [], suffixes, (rare_b + 10 * prior) / (rare_n + 10))
    rows = scratch.table(with_numbers(some, suffixes, model.other).select("blocked", *NUMBERS))
    scratch.drop(some)
    at = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in NUMBERS]).first()
    tops = rows.agg(*[F.max(f).alias(f) for f in NUMBERS]).first()
    seen = {f: sorted({*cuts[f], tops[f]}) for f in NUMBERS}
    edges = {f: [(a + b) / 2 for a, b in zip(seen[f], seen[f][1:])] for f in NUMBERS}
    values = rows
    if any(edges.values()):
        rows = scratch.table(values.withColumn("bins", _bins(edges)))
        scratch.drop(values)
    for _ in range(trees):
        tree = _grown(rows, model.margin(), edges, depth) if any(edges.values()) else 0.0
        if not isinstance(tree, tuple):
            break
        model.trees.append(tree)
    scratch.drop(rows)
    return model


def judge(parts: DataFrame, model: Model) -> DataFrame:
    """``parts`` (url, host, path, query) with ``blocked``, the trees' verdict."""
    if not model.trees:
        return parts.withColumn("blocked", F.lit(model.base > 0))
    numbered = with_numbers(parts, model.suffixes, model.other)
    return numbered.withColumn("blocked", model.margin() > 0).drop(*NUMBERS)


def filter_urls(
    pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] = RULES, id: str = "page_id", url: str = "url", sample: int = SAMPLE,
    trees: int = TREES
) -> DataFrame:
    """Rows (id, url, host, path, rule, verdict): the longest fitting rule's verdict, else that of trees learned from the urls that rules judge.

    ``rules``: (allow or block, host, path); meant for lists of up to some hundred."""
    rule, verdict = fitting_rule(rules)
    parts = with_parts(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))).withColumns({"rule": rule, "ruled": verdict})
    model = fit(parts.where("rule is not null").select("url", (F.col("ruled") == "block").alias("blocked")), scratch, sample=sample, trees=trees)
    judged = judge(parts, model)
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"))


def op12_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, Scratch(pages.sparkSession, "op12")).select("page_id", "host", "path", "rule", "verdict")
