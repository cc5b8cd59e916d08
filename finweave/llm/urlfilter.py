"""URL filter: allow and block rules first, then boosted trees on lexical features.

Rules are column expressions.  The trees see only the shape of a URL: lengths, depth, digit ratios,
entropies, counts of parameters, labels and hyphens, and statistics of the host's suffixes.  A suffix
statistic of a host is told by the *other* hosts that share the suffix (their mean share of blocked
URLs, smoothed, and their number), in training and in scoring alike: so a host's own label never is
its feature, and what only one host has says nothing.  Suffix statistics cover all labelled URLs; they
are aggregated by host, then by suffix, and joined to the hosts and these to the URLs.

The trees are trained on labelled URLs.  Where the caller has none, ``seed_labels`` marks URLs by
words that block lists use in host names, as a weak label: the trees never see a word, and
``held_out_hosts`` tells how well they carry the labels over to hosts that training had none of.

The driver fits on at most ``MAX_TRAIN`` distinct labelled URLs.  A threshold on a hash of the URL
cuts the candidates to about that number before anything is sent to the driver, so what the driver
receives does not grow with the table.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no rule, and is judged
by the trees; repeated rows are judged alike and train as one; a URL with both labels trains as
blocked; without labels of both kinds the verdict is the kind that there is, or allow; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import hash_candidates, materialize
from finweave.llm.trees import Boosted, boost

MAX_TRAIN = 20_000
#: Words in host names of sites that public block lists put under spam, betting, pills and tracking.
BLOCK_WORDS = ("ads", "bet", "bets", "bonus", "casino", "cheap", "click", "lottery", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts without a label that pull a suffix's share towards the share of all.
SMOOTHING = 5.0
#: Suffixes of one, two and three labels.
SUFFIX_LABELS = 3


@dataclass(frozen=True)
class UrlRule:
    """A host and a path prefix; ``text`` is the rule as written, ``host/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_column(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[UrlRule], host: Column, path: Column, pick) -> Column:
    """``pick`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(pick(r))).otherwise(out)
    return out


def seed_labels(urls: DataFrame, words: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """(url, blocked) of every row that has a host: 1 where a label of the host, cut at hyphens, is a block word."""
    tokens = F.split(host_column(F.col("url")), r"[.\-]")
    named = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return urls.select("url").where(host_column(F.col("url")) != "").select("url", named.cast("int").alias("blocked"))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values()) if n else 0.0


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest (query and fragment) as the columns have them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(str.maketrans(UPPER, LOWER)), rest[:end], rest[end:]


def shape(url: str | None) -> list[float]:
    """Lexical features without the suffixes."""
    host, path, rest = split_url(url)
    text = url or ""
    labels = host.split(".")
    digits = lambda s: sum(c.isdigit() for c in s) / len(s) if s else 0.0
    query = rest.partition("#")[0][1:] if rest.startswith("?") else ""
    depth = sum(1 for p in path.split("/") if p)
    return [len(text), len(host), len(path), depth, len(labels), max(map(len, labels)), host.count("-"), digits(host), digits(path), entropy(host), entropy(path), query.count("&") + bool(query), len(query), float("#" in rest), float(text.startswith("https:")), float(path.endswith("/"))]


def suffix_rows(hosts: DataFrame) -> DataFrame:
    """(host, nth, suffix) of the last one, two and three labels of every row's host; shorter hosts have fewer."""
    labels = F.split("host", r"\.")
    nth = F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(SUFFIX_LABELS)))).alias("nth")
    return hosts.select("*", nth).withColumn("suffix", F.array_join(F.slice(labels, -F.col("nth"), F.col("nth")), "."))


#: Names of the suffix statistics, in the order of the model's features.
SUFFIX_FEATURES = tuple(f"{name}_{k}" for k in range(1, SUFFIX_LABELS + 1) for name in ("share", "hosts"))


def suffix_statistics(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, SUFFIX_FEATURES) of every host of ``urls`` (host), told by the other labelled hosts (url, blocked)."""
    own = labelled.select(host_column(F.col("url")).alias("host"), "blocked").where("host != '' AND blocked IS NOT NULL")
    own = materialize(own.groupBy("host").agg(F.avg("blocked").alias("mean")), "url-hosts")
    everywhere = own.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall"))
    # Statistics are written before they are joined, so such a join may be split or broadcast by its size.
    by_suffix = materialize(suffix_rows(own).groupBy("suffix").agg(F.sum("mean").alias("blocked"), F.count(F.lit(1)).alias("n")), "url-suffixes")
    rows = suffix_rows(urls.select("host").distinct().join(own, "host", "left")).join(by_suffix, "suffix", "left").crossJoin(everywhere)
    n = F.coalesce("n", F.lit(0)) - F.col("mean").isNotNull().cast("int")
    blocked = F.coalesce("blocked", F.lit(0.0)) - F.coalesce("mean", F.lit(0.0))
    # Sums of shares less one of them: what is left of rounding must not differ between runs.
    share = F.round((blocked + SMOOTHING * F.col("overall")) / (n + SMOOTHING), 6)
    pick = lambda k, value, default: F.coalesce(F.max(F.when(F.col("nth") == k, value)), default)
    overall = F.round(F.max("overall"), 6)
    made = [c for k in range(1, SUFFIX_LABELS + 1) for c in (pick(k, share, overall), pick(k, F.log1p(n), F.lit(0.0)))]
    return materialize(rows.groupBy("host").agg(*[c.alias(name) for c, name in zip(made, SUFFIX_FEATURES)]), "url-host-features")


def with_suffixes(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` (host, ...) with the suffix statistics of their hosts."""
    stats = suffix_statistics(rows, labelled).withColumnRenamed("host", "s_host")
    return rows.join(stats, F.col("host") == F.col("s_host"), "left").drop("s_host")


def feature_rows(urls: Sequence[str | None], suffixes: np.ndarray) -> np.ndarray:
    """Features of URLs: shape, then suffix statistics."""
    shapes = np.array([shape(u) for u in urls], dtype=float).reshape(len(urls), -1 if len(urls) else 16)
    return np.hstack([shapes, np.asarray(suffixes, dtype=float).reshape(len(urls), len(SUFFIX_FEATURES))])


def fit_urls(x: np.ndarray, blocked: Sequence[int], n_trees: int = 40, depth: int = 4) -> Boosted:
    y = np.asarray(blocked, dtype=float)
    if len(np.unique(y)) < 2:
        return Boosted(35.0 if len(y) and y[0] else -35.0, 0.3)
    return boost(x, y, n_trees, depth)


def sample(labelled: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """At most ``max_train`` distinct (url, host, blocked) in order of a hash of the URL.

    The hash threshold leaves about twice as many candidates whatever the table's size.
    """
    rows, u = hash_candidates(labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()), "url", max_train, "url-sample")
    rows = rows.groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
    return rows.orderBy(u, "url").limit(max_train).withColumn("host", host_column(F.col("url")))


def training_rows(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Hosts, features and labels of the sample; its bound is the driver's."""
    rows = sorted(with_suffixes(materialize(sample(labelled, max_train), "url-sample"), labelled).collect(), key=lambda r: r["url"])
    x = feature_rows([r["url"] for r in rows], np.array([[r[f] for f in SUFFIX_FEATURES] for r in rows]))
    return [r["host"] for r in rows], x, np.array([r["blocked"] for r in rows], dtype=float)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Boosted:
    """Fits on at most ``max_train`` rows of (url, blocked)."""
    _, x, y = training_rows(labelled, max_train)
    return fit_urls(x, y)


def held_out_hosts(labelled: DataFrame, max_train: int = MAX_TRAIN, folds: int = 5) -> np.ndarray:
    """(host's label, score) of every sampled URL, by trees that were trained without its host."""
    hosts, x, y = training_rows(labelled, max_train)
    names = sorted(set(hosts))
    # Blocked and allowed hosts are dealt to folds apart, so each fold has both where there are enough.
    blocked = {h for h, label in zip(hosts, y) if label}
    fold = {h: k % folds for group in ([h for h in names if h in blocked], [h for h in names if h not in blocked]) for k, h in enumerate(group)}
    mine = np.array([fold[h] for h in hosts])
    out = np.zeros(len(y))
    for k in range(folds):
        out[mine == k] = fit_urls(x[mine != k], y[mine != k]).predict(x[mine == k])
    return np.column_stack([y, out])


def score_batches(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        suffixes = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in SUFFIX_FEATURES])
        scores = model.predict(feature_rows(batch.column("url").to_pylist(), suffixes))
        kept = [n for n in batch.schema.names if n != "url" and n not in SUFFIX_FEATURES]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(scores, pa.float64())], names=[*kept, "score"])


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], labelled: DataFrame | None = None, max_train: int = MAX_TRAIN, block_at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url)."""
    labelled = seed_labels(pages) if labelled is None else labelled
    model = train(labelled, max_train)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_column(url).alias("host"), path_column(url).alias("path"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, score double"
    scored = with_suffixes(rows, labelled).select("page_id", "host", "path", "url", *SUFFIX_FEATURES).mapInArrow(lambda it: score_batches(it, model), schema)
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("score") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(fitting_rule(rules, host, path, lambda r: r.verdict), method)
    return scored.select("page_id", "host", "path", fitting_rule(rules, host, path, lambda r: r.text).alias("rule"), verdict.alias("verdict"), "score")
