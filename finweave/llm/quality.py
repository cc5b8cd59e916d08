"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on a bounded sample of labelled rows propose rules (the conjunctions on the paths to
their nodes); a lasso logistic regression keeps few of them and weighs them; the kept rules become
one Spark column expression.  Statistics are built-in functions over whole texts, so scoring runs
inside the scan without Python or a shuffle.

Labels, language, source and id are never inputs.  ``MAX_TRAIN`` bounds the labelled rows that the
driver fits on, taken in order of a hash of the id; all else covers all rows.

Edge cases: null text is scored as empty; an empty text has all statistics 0 and a defined score;
repeated rows score alike; of the texts that share an id one is learnt from; without labelled rows every score is 1 (nothing is known against a
text), with one class only it is that class's share; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import clean_text, free_prefix, hash_candidates
from finweave.llm.trees import Cuts, Node, fit_tree, sigmoid, tree_values

#: Labelled rows that the driver fits on, at most.
MAX_TRAIN = 8_000
ACCEPT = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; each is 0 for an empty one."""
    chars = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    per = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    n_words = F.size(words)
    return {
        "chars": chars.cast("double"),
        "words": n_words.cast("double"),
        "word_length": per(left(r"\s+"), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "upper": per(left(r"[^\p{Lu}]+"), chars),
        "digits": per(left(r"[^0-9]+"), chars),
        "symbols": per(left(r"[\p{L}\p{M}\p{N}\s.,;:'\"()?\-]+"), chars),
        "stops": per(left(r"[^.,;:?]+"), n_words),
        "lines": per(left(r"[^\n]+"), n_words),
    }


FEATURES = ("chars", "words", "word_length", "distinct_words", "upper", "digits", "symbols", "stops", "lines")


@dataclass(frozen=True)
class Condition:
    feature: int
    below: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] <= self.threshold if self.below else x[:, self.feature] > self.threshold

    def column(self, names: tuple[str, ...]) -> Column:
        value = F.col(names[self.feature])
        return value <= F.lit(self.threshold) if self.below else value > F.lit(self.threshold)


Rule = tuple[Condition, ...]


@dataclass
class RuleModel:
    """log-odds = intercept + sum of the weights of the rules that hold."""

    intercept: float
    rules: list[Rule]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * rule_holds(rule, x)
        return sigmoid(z)

    def column(self, names: tuple[str, ...] = FEATURES) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = rule[0].column(names)
            for c in rule[1:]:
                holds = holds & c.column(names)
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def path_rules(node: Node, path: Rule = ()) -> list[Rule]:
    """The conjunction that leads to each node below the root; repeated tests of a feature merge."""
    out = [path] if path else []
    if not node.is_leaf:
        for below, child in ((True, node.left), (False, node.right)):
            c = Condition(node.feature, below, node.threshold)
            kept = [p for p in path if (p.feature, p.below) != (c.feature, c.below)]
            out += path_rules(child, tuple(sorted([*kept, c], key=lambda r: (r.feature, r.below, r.threshold))))
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient for mean log-loss + strength * |weights|; the intercept is free.

    ``y`` may have several columns, each fitted for itself.
    """
    n, m = a.shape
    lip = 0.25 * (np.linalg.norm(a, 2) ** 2 / n + 1)
    w, b = np.zeros((m, *y.shape[1:])), np.zeros(y.shape[1:])
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = sigmoid(a @ v + c) - y
        w_next = v - (a.T @ r) / n / lip
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - strength / lip, 0)
        b_next = c - r.mean(axis=0) / lip
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w_next + (t - 1) / t_next * (w_next - w)
        c = b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 24, depth: int = 3, strength: float = 1e-3, seed: int = 7) -> RuleModel:
    """Rules from boosted trees on random parts and random features, then the lasso."""
    if not len(y):
        return RuleModel(35.0, [], [])
    if len(np.unique(y)) < 2:
        return RuleModel(35.0 if y[0] else -35.0, [], [])
    rng, cuts, z = np.random.default_rng(seed), Cuts.of(x), np.zeros(len(y))
    rules: dict[bytes, Rule] = {}
    for _ in range(n_trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        features = rng.permutation(x.shape[1])[: max(3, 2 * x.shape[1] // 3)]
        tree = fit_tree(cuts, y - p, np.maximum(p * (1 - p), 1e-3), rows, depth, min_rows=max(3, len(y) // 400), features=features)
        z += 0.3 * tree_values(tree, x)
        for rule in path_rules(tree):
            rules.setdefault(np.packbits(rule_holds(rule, x)).tobytes(), rule)
    found = [r for r in rules.values() if 0 < rule_holds(r, x).mean() < 1]
    if not found:
        return RuleModel(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [], [])
    a = np.column_stack([rule_holds(r, x) for r in found]).astype(float)
    intercept, weights = lasso_logistic(a, y, strength)
    kept = np.flatnonzero(np.abs(weights) > 1e-3)
    return RuleModel(float(intercept), [found[i] for i in kept], [float(weights[i]) for i in kept])


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of every row."""
    text = clean_text()
    return docs.select("doc_id", *[c.alias(n) for n, c in statistics(text).items()])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleModel:
    """Fits on at most ``max_train`` labelled rows that are not held out."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    marks, u = hash_candidates(marks, "doc_id", max_train, "quality-sample")
    # One label for each id; contradictions are read as the worse.
    sample = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(u, "doc_id").limit(max_train)
    # The sample is bounded by max_train, so it may be broadcast; of the texts of one id the first by
    # digest is learnt from, so the rows that come to the driver are as few, and always the same.
    joined = docs.select("doc_id", clean_text().alias("text")).join(F.broadcast(sample), "doc_id")
    found = joined.select("doc_id", "quality", F.xxhash64("text").alias("digest"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    first = found.groupBy("doc_id").agg(F.min(F.struct("digest", "quality", *FEATURES)).alias("row"))
    rows = sorted(first.select("row.quality", *[f"row.{n}" for n in FEATURES]).collect())
    x = np.array([[r[n] for n in FEATURES] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit_rules(x, np.array([r["quality"] for r in rows], dtype=float))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, max_train)
    scored = with_statistics(docs).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, accept: float = ACCEPT, trained_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, that the classifier does not reject.

    ``trained_on`` holds the texts of the labelled rows where ``docs`` is only a part of them.
    """
    model = train(docs if trained_on is None else trained_on, labels, max_train)
    prefix = free_prefix(docs, "_q")
    names, score = tuple(f"{prefix}_{n}" for n in FEATURES), f"{prefix}_score"
    stats = statistics(clean_text())
    wide = docs.select("*", *[stats[n].alias(c) for n, c in zip(FEATURES, names)])
    # A filter on a projected score is pushed below the statistics, which are then computed once for
    # each rule that reads them; it stays above a generator.
    scored = wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(model.column(names))).alias(score))
    return scored.where(F.col(score) >= accept).drop(score)
