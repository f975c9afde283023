"""A quality classifier that is a short list of weighted rules.

Statistics of each text (shares of character classes, repetition, lengths) are computed in one
scan and stored. On a bounded sample of labelled rows the driver grows shallow random trees;
every path from a root to a node is a conjunctive rule over the statistics. A logistic regression
with an L1 penalty gives most rules the weight 0. What is left is compiled to one Spark column
expression, so scoring all texts is a projection of the stored statistics.

The sample's bounds are the parameters `max_rows` (rows with the least hash of their id, for the weights) and `tree_rows` (rows
drawn from those for one tree); labels are counted first, and only those below the hash that leaves about max_rows are
joined and sent to the driver, at any size of the tables. Rows held out (crc32 of the id as text, mod 4, is 2) are never in it. Labels, language, source and id
are not inputs of a score.

Defined results: null and empty texts have statistics of 0 and get a score like others; texts
are read whole; repeated rows are each scored; null labels are no labels, and of several labels
of a text the greatest counts; a null id is not held out; without labelled rows of both kinds every
score is the smoothed share of label 1; an empty table gives an empty result; further columns are
not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import add, and_, eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows, stash, text_bytes
from tarnwick.llm.quality_rules import KIND

STATISTICS = (
    "log_words", "word_length", "upper", "digit", "mark", "symbol", "rest", "beyond", "exclaim", "pipe",
    "distinct", "adjacent", "dup_lines", "line_words", "ends",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of a text, by STATISTICS. Shares are of its characters that aren't white space, or of its words or lines."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    kinds = np.bincount(KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9)
    lower, upper, digit, _, mark, symbol, rest, beyond, _ = kinds.tolist()
    chars = lower + upper + digit + mark + symbol + rest + beyond
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        math.log(n), chars / n, upper / max(1.0, lower + upper + beyond), digit / chars, mark / chars, symbol / chars, rest / chars, beyond / chars,
        text.count(b"!") / n, text.count(b"|") / n, len(set(words)) / n, sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), (text.count(b".") + text.count(b"?")) / n,
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""

    def run(batches):
        for b in batches:
            rows = [statistics(x.as_py()) for x in b.column(1)]
            columns = zip(*rows) if rows else [()] * len(STATISTICS)
            yield {"doc_id": b.column(0)} | dict(zip(STATISTICS, columns))

    return arrow_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)), run, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each (statistic, bound), its value is above the bound, or (False) at most it."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(and_, [(F.col(k) > v) if above else (F.col(k) <= v) for k, above, v in self.parts])

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, v in self.parts:
            out &= (x[:, STATISTICS.index(k)] > v) == above
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: tuple, out: set[Rule], least: int) -> None:
    """Adds the paths of a random tree: at each node the best Gini split of some statistics."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = None
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        bounds = middles if len(middles) <= 32 else np.unique(np.quantile(middles, np.linspace(0, 1, 32)))
        low = x[:, f][:, None] <= bounds
        n1, p1 = low.sum(0), (low & (y[:, None] > 0)).sum(0)
        n2, p2 = len(y) - n1, y.sum() - p1
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = p1 * (n1 - p1) / n1 + p2 * (n2 - p2) / n2
        impurity[(n1 < least) | (n2 < least)] = np.inf
        k = int(np.argmin(impurity))
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
            best = (float(impurity[k]), int(f), float(bounds[k]))
    if best is None:
        return
    _, f, bound = best
    for above in (False, True):
        side = (x[:, f] > bound) == above
        step = (STATISTICS[f], above, round(bound, 9))
        kept = tuple(p for p in path if p[:2] != step[:2])  # a tighter bound of the same side replaces the older one
        new = tuple(sorted((*kept, step)))
        out.add(Rule(new))
        grow(x[side], y[side], depth - 1, rng, new, out, least)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n = len(y)
    w, b = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40)))
        new = v - rate * (z.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        nb = c - rate * float(np.mean(p - y))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return b, w


@dataclass(frozen=True)
class RuleModel:
    """An intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score, 0 to 1, over the columns of the statistics."""
        total = reduce(add, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, tree_rows: int = 4_000, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """The rule ensemble of labelled statistics."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    rng = np.random.default_rng(seed)
    found: set[Rule] = set()
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), tree_rows), replace=True)
        grow(x[rows], y[rows], depth, rng, (), found, max(5, len(rows) // 200))
    rules = sorted(found, key=lambda r: (len(r.parts), r.parts))
    z = np.array([r.holds(x) for r in rules], float).T
    spread = z.std(0)
    rules, z, spread = [r for r, s in zip(rules, spread) if s > 0], z[:, spread > 0], spread[spread > 0]
    centre = z.mean(0)
    b, w = lasso((z - centre) / spread, y.astype(float), penalty, steps)
    w = w / spread
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-9]
    return RuleModel(float(b - (w * centre).sum()), tuple((rules[k], float(w[k])) for k in kept))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: How many more rows than asked for the hash threshold lets through: it then lacks some only by a rare chance.
SLACK = 1.1


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000, tree_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row of docs."""
    stats = stash(measured(docs, id_col, text_col), "quality-statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("hash", F.xxhash64("doc_id"))
    share = min(1.0, SLACK * max_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.col("hash") < int(share * 2.0**64) - 2**63)
    sample = known.join(stats, "doc_id").orderBy("hash", "doc_id", *STATISTICS).limit(max_rows).toPandas()
    model = fit(sample[list(STATISTICS)].to_numpy(float), sample["y"].to_numpy(int), tree_rows=tree_rows)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
