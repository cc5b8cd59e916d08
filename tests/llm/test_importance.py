"""The draw against a plain one, with runs of several words, repeated rows and hot ids."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from finweave.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, "ONE", "é日 É\x00b\x7fc_d-e`f{g 09", "a" * 50_000, "x\t\ny", "Straße ﬁ \U0001f600 z"]


def features(text, n):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_draw(docs, target, buckets=10_000, max_words=1, min_words=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every document."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in rows for f in features(text, max_words)[1]) for rows in (docs, target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    out = []
    for i, text in docs:
        n, found = features(text, max_words)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def table(spark, rows, extra=None):
    return spark.createDataFrame([(*r, *(extra or ("x",) * 3)) for r in rows], "doc_id long, text string, score string, key string, place string")


@pytest.mark.parametrize("options", [{}, {"max_words": 3, "min_words": 4, "percent": 50, "buckets": 97}])
def test_draw_equals_brute_force(spark, options):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "x1", "été", "日本"]) for _ in range(n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    # Ids that many rows have, rows repeated in full, and rows without an id.
    docs += [(7, some(30)) for _ in range(40)] + [(8, "same words " * 15)] * 30 + [(None, some(25)) for _ in range(5)]
    target = [(i, some(9) + " gamma gamma") for i in range(20)] + [(99, None), (98, "")]
    got = importance.importance_scores(table(spark, docs), table(spark, target), **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_draw(docs, target, **options)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i % 50, f"{'word ' * 25}{i % 120}") for i in range(400)]
    rows = [(*r, f"s{k % 400 % 120}", "k", "p") for k, r in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, key string, place string")
    out = importance.resample(df, table(spark, [(1, "word")]), percent=30).collect()
    want = Counter(r[0] for r in brute_draw(docs, [(1, "word")], percent=30) if r[4])
    assert len(out) == 120 and Counter(r["doc_id"] for r in out) == want
    # No more copies of a row than there are.
    there = Counter(rows)
    assert all(n <= there[r] for r, n in Counter(tuple(r) for r in out).items())


def test_empty_tables_and_nothing_to_draw(spark):
    none = table(spark, [])
    assert importance.importance_scores(none, none).collect() == [] and importance.resample(none, none).collect() == []
    few = importance.importance_scores(table(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert sorted(tuple(r) for r in few) == sorted(brute_draw([(1, "a b c"), (2, None)], []))
