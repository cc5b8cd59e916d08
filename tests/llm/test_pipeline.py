"""The pipeline and its stages against plain tellings of them: which rows stay, not how many."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import ceil, floor, log2

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from finweave.llm import common, decontaminate, mixing, quality
from test_results import brute_align, brute_classes, words

LIBRARY = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))


def brute_statistics(text):
    text = text or ""
    parts = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    per = lambda n, d: n / d if d else 0.0
    return [
        len(text), len(parts), per(sum(map(len, parts)), len(parts)), per(len(set(parts)), len(parts)), per(sum(c.isupper() for c in text), len(text)), per(sum(c in "0123456789" for c in text), len(text)),
        per(sum(not (c.isalnum() or c in " \t\n\x0b\f\r.,;:'\"()?-") for c in text), len(text)), per(sum(c in ".,;:?" for c in text), len(parts)), per(text.count("\n"), len(parts)),
    ]


def brute_shares(item, text):
    """A text holds an item if it has three of its words in a row and the best alignment has half of the score."""
    bare = lambda t: [x for x in (re.sub(r"[\W_]+", "", w) for w in t.lower().split()) if x]
    a, b = bare(item), bare(text)
    runs = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
    return any(tuple(b[i : i + 3]) in runs for i in range(len(b) - 2)) and brute_align(a, b) >= len(a)


def number(seed, *parts):
    return int(hashlib.md5("|".join([seed, *parts]).encode()).hexdigest()[:13], 16) / 2**52


def brute_copies(rows):
    """Copies of each (doc_id, source, text) by one pass over each source in its order."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r[1]] += size[r]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(total)
    while open_:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    out = {}
    for s in total:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (floor(log2(size[r] + 1) * 16), number("mix-1", str(r[0])), r[0]))
        expected = min(target[s] / total[s], 2.0) if total[s] else 0
        offset = number("mix-1-offset", "true" if s is None else "false", s or "")
        for place, r in enumerate(mine):
            crossed = floor(expected * (place + 1) + offset) - floor(expected * place + offset)
            out[r] = min(crossed, ceil(expected)) if size[r] else 0
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad texts, exact and near copies, and benchmark passages, edited ones too."""
    rng = random.Random(21)
    items = [words(rng, 30) for _ in range(4)]
    good = [" ".join(words(rng, rng.randint(40, 90)).split()) + "." for _ in range(140)]
    bad = [words(rng, 6).upper() + "!!\n" + "same thing " * rng.randint(20, 40) for _ in range(60)]
    texts = good + bad
    texts += [good[i] for i in range(10)] + [good[i] + " more words" for i in range(10, 20)]
    for k, item in enumerate(items):
        edited = " ".join(w if i % 6 else "changed" for i, w in enumerate(item.split()))
        texts += [f"{words(rng, 30)} {x} {words(rng, 30)}." for x in (item, edited)]
    texts += [None, "", "two words"]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 140 <= i < 200), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline_equals_brute_force(spark, corpus):
    path, rows, items = corpus
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    model = quality.train(read("documents"), read("labels"))
    score = model.predict(np.array([brute_statistics(t) for _, t, _ in rows]))
    kept = [r for r, s in zip(rows, score) if s >= 0.7]
    assert sum(140 <= r[0] < 200 for r in kept) <= 2 and sum(r[0] < 140 for r in kept) >= 138
    docs = read("documents")
    docs = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, path), "test")
    assert sorted(r["doc_id"] for r in docs.collect()) == [r[0] for r in kept]

    label = brute_classes([t for _, t, _ in kept], True)
    kept = [r for k, r in enumerate(kept) if label[k] == k]
    docs = corpus_pipeline.materialize(corpus_pipeline.near_duplicates(spark, docs, path), "test")
    assert sorted(r["doc_id"] for r in docs.collect()) == [r[0] for r in kept]

    kept = [r for r in kept if not any(brute_shares(x, r[1] or "") for x in items)]
    docs = corpus_pipeline.materialize(corpus_pipeline.decontamination(spark, docs, path), "test")
    assert sorted(r["doc_id"] for r in docs.collect()) == [r[0] for r in kept] and not any(208 + 12 <= r[0] < 228 for r in kept)

    copies = brute_copies([(i, s, t) for i, t, s in kept])
    mixed = corpus_pipeline.materialize(corpus_pipeline.mixing(spark, docs, path), "test")
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r[0]: n for r, n in copies.items() if n})

    ids = {i: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in kept}
    want, start = [], 0
    for i in sorted(ids):
        for _ in range(next(n for r, n in copies.items() if r[0] == i)):
            want.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
            start += len(ids[i])
    got = sorted(map(tuple, corpus_pipeline.tokens(spark, mixed, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == got


def test_scores_equal_the_plain_model(spark, corpus):
    path, rows, _ = corpus
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(docs, labels)
    want = dict(zip((r[0] for r in rows), model.predict(np.array([brute_statistics(t) for _, t, _ in rows]))))
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]]) and r["predicted"] == int(want[r["doc_id"]] >= 0.7)


def test_equal_rows_share_their_copies(spark):
    """Rows without an id and rows repeated in full are placed and copied like others."""
    text = "a b c d e f"
    rows = [(None, "s", text)] * 700 + [(1, "s", text)] * 300 + [(i, "t", text) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    report = mixing.mix_report(docs).collect()
    assert len(report) == 2000 and all(r["taken"] <= 12 for r in report)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) * 6 == sum(r["taken"] for r in report)
    # 1.5 times 12000 words by weights 5 and 2, none above twice its 6000.
    assert (sum(r["source"] == "s" for r in mixed), sum(r["source"] == "t" for r in mixed)) == (2000, 1000)


def test_stages_leave_one_narrow_table(spark, corpus, tmp_path, monkeypatch):
    """What a stage wrote on its way is gone when it returns, though nobody discards it; its result still reads."""
    monkeypatch.setattr(common, "shared_root", lambda _: str(tmp_path))
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    known = set()
    for stage, kind in ((corpus_pipeline.near_duplicates, "kept-rows"), (corpus_pipeline.decontamination, "benchmark-rows"), (corpus_pipeline.mixing, "row-copies")):
        out = stage(spark, docs, path)
        left = {p.name for p in (tmp_path / "finweave").iterdir()} - known
        assert [name.rsplit("-", 1)[0] for name in left] == [kind]
        assert out.count() > 0
        known |= left


def test_stretches_are_shuffled_once(spark, corpus, monkeypatch):
    """The words of stretches meet the rarest and all other shared n-grams in one join; the pairs are those of a benchmark that is not sent."""
    path, _, _ = corpus
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    calls, aligned = [], decontaminate._aligned
    monkeypatch.setattr(decontaminate, "_aligned", lambda *a: calls.append(1) or aligned(*a))
    found = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert found and calls == [1]
    monkeypatch.setattr(decontaminate, "SENT_SEEDS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == found
