"""Mixing sources by temperature.

A source's weight is its share of the tokens to the power of an exponent in
[0, 1], normalised.  The exponent is bisected: the largest at which the weights
reach a target entropy (a share of the largest possible one), but never so
small that a source is repeated more often than a limit, which is bisected too.
The weights become token budgets, and these become whole passes over a source
plus, for the rest, the first blocks of a keyed permutation of its blocks; in
the block where the budget ends, documents count in the order of their keys as
far as they fit.

By default the budget is the smallest that reads every source at least once,
so mixing repeats documents and drops none.  Of a given budget, what a source
may not take because of the limit goes to the others by their weights; if all
are at the limit, less is read.

Up to ``MOST_SOURCES`` sources are weighed on the driver and broadcast, one row
each; beyond, the sums for the bisection are aggregates over the table of
sources, for several exponents at once, and that table is joined by shuffle.
A null source is a source of its own.  Texts that are null or without tokens
cost nothing: in a source without any tokens every document has one copy.  Rows
that are equal in id and text have the same key and are taken together.
Columns of any name pass through :func:`mixed` as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut_lineage, text_or_empty

MOST_SOURCES = 100_000
STEPS = 60


def entropy(shares: Sequence[float], exponent: float) -> float:
    """Entropy of the weights, as a share of the largest possible one; 1 for a single source."""
    if len(shares) < 2:
        return 1.0
    raised = [p**exponent for p in shares]
    total = math.fsum(raised)
    return -math.fsum(r / total * math.log(r / total) for r in raised) / math.log(len(shares))


def bisect(holds: Callable[[list[float]], list[bool]], low: float, high: float, points: int = 1) -> tuple[float, float]:
    """The border between where ``holds`` is true (from ``low`` on) and false, as its last and first place.

    ``points`` places are looked at together, for conditions that cost a job.
    """
    for _ in range(math.ceil(STEPS / math.log2(points + 1))):
        at = [low + (high - low) * k / (points + 1) for k in range(1, points + 1)]
        true = sum(holds(at))  # those that hold come first
        low, high = at[true - 1] if true else low, at[true] if true < points else high
    return low, high


class Sources:
    """Sizes of all sources that have tokens: on the driver, or as a table if they are too many."""

    def __init__(self, table: DataFrame, most: int) -> None:
        rows = table.limit(most + 1).collect()
        self.table = table if len(rows) > most else None
        self.sizes = [] if self.table is not None else sorted(r.tokens for r in rows if r.tokens)
        if self.table is not None:
            self.table = table.filter("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
            n, low, high, total = self.table.agg(F.count("*"), F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
        else:
            n, low, high, total = len(self.sizes), *((self.sizes[0], self.sizes[-1], sum(self.sizes)) if self.sizes else (0, 0, 0))
        self.n, self.low, self.high, self.total = n, low, high, total
        self.points = 1 if self.table is None else 31

    def sums(self, kinds: list[tuple[Callable[[float], float], Callable[[Column], Column]]]) -> list[float]:
        """Sums over the sources of functions of their sizes, each given for numbers and for a column."""
        if self.table is None:
            return [math.fsum(map(f, self.sizes)) for f, _ in kinds]
        return list(self.table.agg(*[F.sum(g(F.col("tokens"))) for _, g in kinds]).first())

    def raised(self, exponents: list[float]) -> list[float]:
        return self.sums([(lambda n, e=e: (n / self.total) ** e, lambda n, e=e: F.pow(n / self.total, F.lit(e))) for e in exponents])

    def entropies(self, exponents: list[float]) -> list[float]:
        if self.n < 2:
            return [1.0] * len(exponents)
        if self.table is None:
            return [entropy([n / self.total for n in self.sizes], e) for e in exponents]
        both = self.sums([f for e in exponents for f in ((None, lambda n, e=e: F.pow(n / self.total, F.lit(e))), (None, lambda n, e=e: F.pow(n / self.total, F.lit(e)) * F.log(n / self.total)))])
        return [(math.log(s) - e * t / s) / math.log(self.n) for e, s, t in zip(exponents, both[::2], both[1::2], strict=True)]

    def exponent(self, target_entropy: float | None, max_repeats: float | None) -> float:
        """The limit of repetition goes before the entropy."""
        if self.n < 2 or self.low == self.high:
            return 1.0 if target_entropy is not None else 0.0
        low, spread = 0.0, self.high / self.low
        if max_repeats is not None and spread > max_repeats:
            # the smallest source is read so much more often than the largest
            low = bisect(lambda at: [spread ** (1 - e) > max_repeats for e in at], 0.0, 1.0)[1]
        if target_entropy is None:
            return low
        if self.entropies([1.0])[0] >= target_entropy:
            return 1.0
        if self.entropies([low])[0] <= target_entropy:
            return low
        return bisect(lambda at: [h >= target_entropy for h in self.entropies(at)], low, 1.0, self.points)[0]

    def scale(self, exponent: float, whole: float, budget: int, max_repeats: float) -> float:
        """By how much budgets in proportion to the weights grow for what the limit takes from some to go to others."""
        def read(scales: list[float]) -> list[float]:
            return self.sums([(lambda n, x=x: min(x * budget * (n / self.total) ** exponent / whole, max_repeats * n), lambda n, x=x: F.least(x * budget * F.pow(n / self.total, F.lit(exponent)) / whole, max_repeats * n)) for x in scales])

        if not self.n or read([1.0])[0] >= budget * (1 - 1e-12):
            return 1.0
        # here the largest source is at the limit, and so are all others
        most = max_repeats * self.high * whole / budget / min((n / self.total) ** exponent for n in (self.low, self.high))
        return most if max_repeats * self.total <= budget else bisect(lambda at: [v <= budget for v in read(at)], 1.0, max(1.0, most), self.points)[0]


def find_exponent(shares: Sequence[float], target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent for positive ``shares``."""
    found = Sources.__new__(Sources)
    found.table, found.sizes, found.points = None, sorted(shares), 1
    found.n, found.low, found.high, found.total = len(shares), found.sizes[0], found.sizes[-1], math.fsum(shares)
    return found.exponent(target_entropy, max_repeats)


def token_count() -> Column:
    """Tokens of the text: runs of signs other than ASCII white space."""
    return F.regexp_count(text_or_empty(), F.lit(r"[^ \x09-\x0D]+")).cast("long")


def keyed(docs: DataFrame, seed: int, tokens: Column | None = None) -> DataFrame:
    """rest (all columns of ``docs``), mix_source, mix_tokens, mix_key and mix_block (4096 blocks a source)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty().cast("binary"))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    rows = docs.select(rest.alias("rest"), source.alias("mix_source"), (token_count() if tokens is None else tokens.cast("long")).alias("mix_tokens"), key.alias("mix_key"))
    return rows.withColumn("mix_block", F.substring("mix_key", 1, 3))


def _place(seed: int) -> Column:
    """A block's place in the permutation of the pass that isn't whole."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.col("mix_source"), F.col("mix_block")).cast("binary"))


def plan(rows: DataFrame, seed: int, target_entropy: float | None, max_repeats: float | None, budget: int | None, most: int = MOST_SOURCES) -> tuple[DataFrame, bool]:
    """For each source its weight, budget, whole passes, and where the last pass ends; whether they are few.

    ``rows``: mix_source, mix_tokens, mix_key, mix_block.
    """
    blocks = cut_lineage(rows.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("tokens")))
    totals = cut_lineage(blocks.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")))
    sources = Sources(totals, most)
    few = sources.table is None

    def hint(small: DataFrame) -> DataFrame:
        """At most ``most`` rows are broadcast."""
        return F.broadcast(small) if few else small

    exponent = sources.exponent(target_entropy, max_repeats) if sources.n else 1.0
    whole = sources.raised([exponent])[0] if sources.n else 1.0
    n = F.col("tokens").cast("double")
    weight = F.pow(n / F.lit(float(sources.total or 1)), F.lit(exponent)) / F.lit(whole)
    sized = cut_lineage(totals.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0))))
    scale = 1.0
    if budget is None:
        budget = sized.filter("tokens > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight") - 1e-6))).first()[0] or 0
    elif max_repeats is not None:
        scale = sources.scale(exponent, whole, budget, max_repeats)
    own = F.round(F.col("weight") * F.lit(float(budget)) * F.lit(scale)).cast("long")
    if max_repeats is not None:
        own = F.least(own, F.floor(F.lit(float(max_repeats)) * n).cast("long"))
    # rounding must not open or cut the only pass
    own = F.when(F.col("tokens") == 0, 0).when(F.abs(own - F.col("tokens")) <= 1, F.col("tokens")).otherwise(own).cast("long")
    ends = sized.select("mix_source", "tokens", "weight", F.lit(exponent).alias("exponent"), own.alias("budget"))
    passes, rest = F.expr("CASE WHEN tokens = 0 THEN 1L ELSE budget div tokens END"), F.expr("CASE WHEN tokens = 0 THEN 0L ELSE budget % tokens END")
    ends = ends.select("mix_source", "weight", "exponent", "budget", passes.alias("passes"), rest.alias("rest"))
    order = Window.partitionBy("mix_source").orderBy("place")
    placed = blocks.join(hint(ends), "mix_source").withColumn("place", _place(seed))  # at most 4096 rows a source
    placed = placed.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).filter("before <= rest and before + tokens > rest")
    last = placed.groupBy("mix_source").agg(F.min(F.struct("place", "mix_block", (F.col("rest") - F.col("before")).alias("left"))).alias("x"))
    ends = ends.join(last, "mix_source", "left").select(*ends.columns, F.col("x.place").alias("last_place"), F.col("x.mix_block").alias("last_block"), F.col("x.left").alias("left"))
    ends = cut_lineage(ends)
    # the block is cut into 4096 parts by the next signs of the keys, and only the part where the budget ends is looked into
    part = F.substring("mix_key", 1, 6).alias("part")
    inside = rows.join(hint(ends.select("mix_source", F.col("last_block").alias("mix_block"), "left")), ["mix_source", "mix_block"])
    inside = cut_lineage(inside.groupBy("mix_source", part, "mix_key", "left").agg(F.sum("mix_tokens").alias("tokens")))  # equal rows are one
    parts = inside.groupBy("mix_source", "part", "left").agg(F.sum("tokens").alias("size"))
    parts = parts.withColumn("before", F.sum("size").over(Window.partitionBy("mix_source").orderBy("part")) - F.col("size")).filter("before <= left and before + size > left")
    crossed = inside.join(parts.select("mix_source", "part", "before"), ["mix_source", "part"])
    used = F.col("before") + F.sum("tokens").over(Window.partitionBy("mix_source", "part").orderBy("mix_key"))
    # where none of its documents fits, its beginning comes after all keys before it
    cut = crossed.withColumn("fits", used <= F.col("left")).groupBy("mix_source", "part").agg(F.max(F.when(F.col("fits"), F.col("mix_key"))).alias("k")).select("mix_source", F.coalesce("k", "part").alias("last_key"))
    return cut_lineage(ends.join(cut, "mix_source", "left")), few


def with_copies(rows: DataFrame, ends: DataFrame, few: bool, seed: int) -> DataFrame:
    """``rows`` (of :func:`keyed`) with n_copies; a row for each source is broadcast if they are few."""
    own = ends.select("mix_source", "passes", "last_place", "last_block", "last_key")
    place = _place(seed)
    extra = F.when(F.col("mix_block") == F.col("last_block"), F.col("mix_key") <= F.col("last_key")).otherwise(place < F.col("last_place"))
    rows = rows.join(F.broadcast(own) if few else own, "mix_source")
    return rows.withColumn("n_copies", F.col("passes") + F.coalesce(extra, F.lit(False)).cast("long")).drop("passes", "last_place", "last_block", "last_key")


def mix_sources(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 1, tokens: Column | None = None, most: int = MOST_SOURCES) -> DataFrame:
    """doc_id, source, n_tokens, block and n_copies for every row.  ``tokens``: the count, if not of words."""
    rows = cut_lineage(keyed(docs, seed, tokens).select(F.col("rest.doc_id").alias("doc_id"), F.col("rest.source").alias("source"), "mix_source", "mix_tokens", "mix_key", "mix_block"))
    done = with_copies(rows, *plan(rows, seed, target_entropy, max_repeats, budget, most), seed)
    return done.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_block").alias("block"), "n_copies")


def mixed(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 1, tokens: Column | None = None, most: int = MOST_SOURCES) -> DataFrame:
    """The documents themselves, each as often as its source's budget says."""
    rows = keyed(docs, seed, tokens)
    ends, few = plan(cut_lineage(rows.select("mix_source", "mix_tokens", "mix_key", "mix_block")), seed, target_entropy, max_repeats, budget, most)
    done = with_copies(rows, ends, few, seed).filter("n_copies > 0")
    done = done.select("rest", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS BIGINT) AS n,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sizes AS (SELECT s, CAST(sum(n) AS BIGINT) AS t FROM rows GROUP BY s HAVING sum(n) > 0),
shares AS (SELECT s, t, CAST(t AS DOUBLE) / (SELECT sum(t) FROM sizes) AS p FROM sizes),
facts AS (SELECT count(*) AS m, greatest(0.0, 1 - ln(4.0) / nullif(ln(max(p) / min(p)), 0)) AS low FROM shares),
steps AS (
  SELECT 0 AS i, coalesce((SELECT low FROM facts), 0.0) AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN h >= 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= 0.95 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2))) / ln(count(*)) AS h
        FROM steps, shares WHERE i < 60 GROUP BY i, lo, hi)),
ends AS (SELECT CASE WHEN (SELECT m FROM facts) < 2 OR (SELECT -sum(p * ln(p)) / ln(count(*)) FROM shares) >= 0.95 THEN 1.0
                     ELSE (SELECT lo FROM steps WHERE i = 60) END AS e),
weights AS (SELECT s, t, pow(p, e) / sum(pow(p, e)) OVER () AS w FROM shares, ends),
budgets AS (SELECT s, t, CASE WHEN abs(least(round(w * b), floor(4.0 * t)) - t) <= 1 THEN t ELSE CAST(least(round(w * b), floor(4.0 * t)) AS BIGINT) END AS own
            FROM weights, (SELECT max(ceil(t / w - 1e-6)) AS b FROM weights)),
passes AS (SELECT r.s, coalesce(own // t, 1) AS q, coalesce(own % t, 0) AS rest FROM (SELECT DISTINCT s FROM rows) r LEFT JOIN budgets USING (s)),
blocks AS (SELECT s, substr(k, 1, 3) AS b, sum(n) AS n FROM rows GROUP BY ALL),
placed AS (SELECT s, b, q, rest, n, sum(n) OVER (PARTITION BY s ORDER BY md5('1:' || q || ':' || s || ':' || b)) - n AS before FROM blocks JOIN passes USING (s)),
taken AS (SELECT r.doc_id, r.source, r.n, r.k, p.b, p.q, p.before, p.rest, p.n AS whole,
                 sum(r.n) OVER (PARTITION BY r.s, p.b ORDER BY r.k) AS used
          FROM rows r JOIN placed p ON r.s = p.s AND substr(r.k, 1, 3) = p.b)
SELECT doc_id, source, n AS n_tokens, b AS block,
       CAST(q + CASE WHEN before + whole <= rest OR (before <= rest AND before + used <= rest) THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM taken
"""
