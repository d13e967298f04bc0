"""URL filter: rules for hosts and paths, and boosted trees for the rest.

Rules name a host (with all its subdomains) and a path prefix; of those that
fit, the longest wins (host and path together, then by its text).  URLs that a
rule fits are the labelled ones; gradient-boosted regression trees (logistic
loss) on lexical features learn from at most ``SAMPLE`` distinct ones of them,
those of the smallest hashes, and judge the URLs that no rule fits.  Features
and scores are DataFrame expressions: the trees become nested CASE expressions,
and the shares of allowed URLs for each suffix and ending of the sample are
joined by hash.  Only hashes and integer features of the sample come to the
driver, cut there by a hash limit first, so that it doesn't grow with the data.

Features are those of the whole URL, however long.  A null URL, or one without
``://``, has an empty host and path; it is scored like any other.  Where all
labels agree, or there are none, the verdict is that label, or allow.  Every
row gives one row, repeated rows too; a null page_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.training import smallest_hashes

SAMPLE = 20_000
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "suffix_rate", "ending_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, ASCII letters in lower case, and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))


def _strength(rule: tuple[str, str, str]) -> tuple[int, str]:
    return len(rule_name(rule)), rule_name(rule)


def decide(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=_strength):
        here = fits(rule, host, path)
        name = F.when(here, F.lit(rule_name(rule))).otherwise(name)
        verdict = F.when(here, F.lit(rule[0])).otherwise(verdict)
    return name, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the lexical features, scaled to integers, and hashes of suffix and ending."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    # lengths of the runs of equal signs in the sorted text
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(url, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    bits = F.aggregate(runs, F.lit(0.0), lambda h, r: h - F.length(r) / size * F.log2(F.length(r) / size))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return rows.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length("host"),
            "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
            "digits": F.floor(1000 * digits / F.greatest(F.length(url), F.lit(1))).cast("int"),
            "entropy": F.round(bits * 1000).cast("int"),
            "parameters": F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit("")))),
            "hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))),
            "labels": F.size(F.split("host", r"\.")),
            "suffix": F.xxhash64(F.substring_index("host", ".", -1)),
            "ending": F.xxhash64(F.regexp_extract("path", r"\.([A-Za-z0-9]++)\z", 1)),
        }
    )


class Trees:
    """Trees of (feature number, threshold, left, right) or a leaf's value; left where the feature is smaller.

    ``rates``: for suffix and for ending, the share of each hash in the sample,
    of at most its size, and the share of all others.
    """

    def __init__(self, base: float, trees: list, rates: tuple[dict[int, int], dict[int, int], int]) -> None:
        self.base, self.trees, self.rates = base, trees, rates

    def with_rates(self, rows: DataFrame) -> DataFrame:
        """``rows`` with suffix_rate and ending_rate; at most a row for each of the sample is broadcast."""
        for name, shares in zip(("suffix", "ending"), self.rates[:2], strict=True):
            listed = rows.sparkSession.createDataFrame(sorted(shares.items()), f"{name} long, {name}_rate int")
            rows = rows.join(F.broadcast(listed), name, "left") if shares else rows.withColumn(f"{name}_rate", F.lit(None).cast("int"))
        return rows.withColumns({c: F.coalesce(c, F.lit(self.rates[2])) for c in ("suffix_rate", "ending_rate")})

    def score(self) -> Column:
        def of(node: tuple | float) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(F.col(FEATURES[node[0]]) < node[1], of(node[2])).otherwise(of(node[3]))

        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + of(tree)
        return total


def _grow(x: list[list[int]], grad: list[float], hess: list[float], rows: list[int], depth: int, rate: float) -> tuple | float:
    g, h = math.fsum(grad[i] for i in rows), math.fsum(hess[i] for i in rows)
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f in range(len(FEATURES)):
            cells: dict[int, list[float]] = {}
            for i in rows:
                cell = cells.setdefault(x[i][f], [0.0, 0.0, 0])
                cell[0] += grad[i]
                cell[1] += hess[i]
                cell[2] += 1
            a = b = n = 0.0
            for value in sorted(cells)[:-1]:
                a, b, n = a + cells[value][0], b + cells[value][1], n + cells[value][2]
                if n >= 10 and len(rows) - n >= 10:
                    gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, value + 1)
    if best[1] is None:
        return round(-rate * g / (h + 1), 9)
    left = [i for i in rows if x[i][best[1]] < best[2]]
    right = [i for i in rows if x[i][best[1]] >= best[2]]
    return best[1], best[2], _grow(x, grad, hess, left, depth - 1, rate), _grow(x, grad, hess, right, depth - 1, rate)


def boost(x: list[list[int]], y: list[int], trees: int = 12, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    share = min(max(sum(y) / len(y), 0.01), 0.99)
    base = math.log(share / (1 - share))
    score = [base] * len(y)
    out = []

    def value(node: tuple | float, row: list[int]) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(x, [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], list(range(len(y))), depth, rate)
        out.append(tree)
        score = [s + value(tree, row) for s, row in zip(score, x, strict=True)]
    return base, out


def train(rows: DataFrame, size: int = SAMPLE) -> Trees:
    """``rows`` of :func:`lexical` with ``label`` (1: allow), null where no rule fits."""
    own = ["label", "suffix", "ending", *FEATURES[:-2]]
    known = rows.filter("label is not null").select(F.xxhash64("url").alias("h"), *own)
    # what is sorted on the driver's behalf are some ``size`` distinct URLs, whatever the data
    known = smallest_hashes(known, "h", size).groupBy("h").agg(*[F.min(c).alias(c) for c in own])
    sample = known.orderBy("h").limit(size).collect()  # at most ``size`` rows of numbers
    if not sample or len({r.label for r in sample}) == 1:
        return Trees(-1.0 if sample and not sample[0].label else 1.0, [], ({}, {}, 500))
    whole = sum(r.label for r in sample) / len(sample)
    rates: list[dict[int, int]] = []
    for column in ("suffix", "ending"):
        found: dict[int, list[int]] = {}
        for r in sample:
            found.setdefault(r[column], []).append(r.label)
        rates.append({k: round(1000 * (sum(v) + 10 * whole) / (len(v) + 10)) for k, v in found.items()})
    x = [[*[int(r[f]) for f in FEATURES[:-2]], rates[0][r.suffix], rates[1][r.ending]] for r in sample]
    base, trees = boost(x, [int(r.label) for r in sample])
    return Trees(base, trees, (rates[0], rates[1], round(1000 * whole)))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, size: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of allow) of every row."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = decide(rules, F.col("host"), F.col("path"))
    rows = lexical(rows.withColumns({"rule": name, "given": verdict})).withColumn("label", (F.col("given") == "allow").cast("int"))
    model = train(rows, size)
    rows = model.with_rates(rows).withColumn("score", F.round(model.score(), 6))
    own = F.when(F.col("score") >= 0, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")
