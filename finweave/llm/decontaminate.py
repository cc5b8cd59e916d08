"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Documents are read once.  A task keeps the stretches of words around those n-grams that a bounded bit
table of the benchmark's n-grams lets through; they are written with the n-grams they hold.  From then on all
are Spark joins on n-gram hashes and numbers of stretches, whatever the size of either table:

1. the n-grams of each item join stretches to items, once, and the item is aligned with the words around its
   rarest ones (by how often they stand in all documents);
2. a stretch that this leaves undecided, and that shares any other n-gram, is aligned around all it shares.

So no n-gram is left out: a pair counts exactly if an alignment around its shared n-grams reaches ``accept``;
edits, gaps and replaced words lower the score but do not break it.  A window that holds too few of the item's
words to reach it is ruled out by that bound, and equal windows of a batch are aligned once.

A score is the alignment's over that of a perfect copy, from 0 to 1; ``ACCEPT`` and above counts.  It is the best
around the rarest n-grams where that counts, else the best around all shared ones.
Words are lower-cased and stripped of marks.

The bit table has at most ``MAX_BITS`` bits; a benchmark of more n-grams lets more stretches through, which the join
then drops.  A stretch reaches as far as the longest item on both sides, and holds at most ``STRETCH_WORDS`` places of
n-grams (four times its reach if that is more), so stretches never hold more than 1.5 times the documents' words.

Edge cases: null texts are empty and match nothing; an item of fewer than ``SEED_WORDS`` words matches
the texts that are its words and no others, as a word or two stand in texts of any kind; equal items are each reported; repeated rows are judged alike; an empty
table on either side gives no pairs and drops nothing; all other columns are kept by
``decontaminate``, and none of their names clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finweave.llm.common import clean_text, discard, free_prefix, materialize, scratch_scope, shingle_hashes, text_pieces, word_hashes

SEED_WORDS = 3
ACCEPT = 0.5
MATCH, MISS, GAP = 2, -1, -1
#: N-grams of an item that count as its rarest.
RAREST = 4
#: Bits of the table that the scan looks n-grams up in, at most (8 MB).
MAX_BITS = 2**26
#: Places of n-grams that one stretch holds at most, unless items are longer than a fifth of it.
STRETCH_WORDS = 8192
#: Rows to drop that a join may send to all tasks; more are shuffled.
SENT = 1_000_000
#: The benchmark's n-grams that a join may send to all tasks.
SENT_SEEDS = 250_000
#: Cells of the alignment computed at once.
CELLS = 2_000_000


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of each item."""
    for batch in batches:
        rows = pa.array(np.arange(batch.num_rows))
        for index, texts in text_pieces(rows, batch.column("text")):
            words, offsets = word_hashes(texts, strip=True)
            seeds, seed_offsets = shingle_hashes(words, offsets, SEED_WORDS)
            keys = [batch.column(c).take(index) for c in ("item", "item_id")]
            yield pa.RecordBatch.from_arrays([*keys, _lists(words.view(np.int64), offsets), _lists(seeds.view(np.int64), seed_offsets)], names=["item", "item_id", "words", "seeds"])


def bit_table(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' low hash bits in 64-bit words: about 16 bits a seed, ``MAX_BITS`` at most."""
    n = seeds.agg(F.approx_count_distinct("seed").alias("n")).first()["n"]
    bits = min(MAX_BITS, max(2**16, 1 << int(16 * n).bit_length()))
    slot = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, CAST(seed & 63 AS INT))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def stretch_batches(batches: Iterator[pa.RecordBatch], table: np.ndarray, reach: int) -> Iterator[pa.RecordBatch]:
    """Stretches of words around the places whose n-gram may be a seed, with these places and n-grams."""
    mask, span = np.uint64(len(table) * 64 - 1), max(STRETCH_WORDS, 4 * reach)
    for batch in batches:
        rows = pa.array(np.arange(batch.num_rows))
        for index, texts in text_pieces(rows, batch.column("text")):
            words, offsets = word_hashes(texts, strip=True)
            shingles, shingle_offsets = shingle_hashes(words, offsets, SEED_WORDS)
            slot = shingles & mask
            found = np.flatnonzero((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
            if not len(found):
                continue
            text = np.searchsorted(shingle_offsets, found, "right") - 1
            place = found - shingle_offsets[text]
            begin = np.maximum(offsets[text], offsets[text] + place - reach)
            end = np.minimum(offsets[text + 1], offsets[text] + place + reach)
            apart = np.concatenate([[True], (text[1:] != text[:-1]) | (begin[1:] > end[:-1]) | (place[1:] // span != place[:-1] // span)])
            first = np.flatnonzero(apart)
            last = np.append(first[1:], len(apart)) - 1
            sizes = end[last] - begin[first]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            taken = np.arange(starts[-1]) - np.repeat(starts[:-1] - begin[first], sizes)
            hits = np.append(first, len(apart))
            keys = [batch.column(c).take(index.take(pa.array(text[first]))) for c in ("row", "doc_id", "digest")]
            columns = [pa.array(begin[first] - offsets[text[first]]), _lists(words[taken].view(np.int64), starts), _lists(place, hits), _lists(shingles[found].view(np.int64), hits)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=["row", "doc_id", "digest", "begin", "words", "places", "seeds"])


def align(item: np.ndarray, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item against windows, and the word each best alignment ends at.

    A row of the matrix is computed for all windows at once; a gap along the row is a running maximum.
    """
    scores, ends = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    order = np.argsort([len(w) for w in windows], kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(windows[order[to]]) <= CELLS:
            to += 1
        chosen = order[at:to]
        width = max(len(windows[i]) for i in chosen)
        words = np.zeros((len(chosen), width), np.uint64)
        real = np.zeros((len(chosen), width), bool)
        for r, i in enumerate(chosen):
            words[r, : len(windows[i])] = windows[i]
            real[r, : len(windows[i])] = True
        slope = np.arange(1, width + 1) * -GAP
        before = np.zeros((len(chosen), width + 1), np.int64)
        best, where = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
        for word in item:
            step = np.where((words == word) & real, MATCH, MISS)
            row = np.maximum(np.maximum(before[:, :-1] + step, before[:, 1:] + GAP), 0)
            row = np.maximum(np.maximum.accumulate(row + slope, axis=1) - slope, row)
            top = row.max(axis=1)
            better = top > best
            where[better] = row[better].argmax(axis=1)
            best = np.maximum(best, top)
            before[:, 1:] = row
        scores[chosen], ends[chosen] = best, where
        at = to
    return scores, ends


def _windows(shifts: np.ndarray, length: int, begin: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Where an item of ``length`` words may lie in a stretch, for starts ``shifts``; windows that overlap become one."""
    pad = length // 4 + 4
    low = np.sort(np.clip(shifts - pad, begin, begin + n_words))
    high = np.sort(np.clip(shifts + length + pad, begin, begin + n_words))
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    for a, b in zip(new, np.append(new[1:], len(low)) - 1):
        yield int(low[a]), int(high[b])


def _best_alignments(item: np.ndarray, rows: list[int], shifts: pa.Array, words: pa.Array, begins: np.ndarray, accept: float) -> dict[int, tuple[float, int]]:
    """Score and last word of the best alignment of ``rows`` around their ``shifts``, of those that reach ``accept``."""
    owner, where, windows = [], [], []
    for r in rows:
        stretch, begin = words[r].values.to_numpy().view(np.uint64), int(begins[r])
        for low, high in _windows(shifts[r].values.to_numpy(), len(item), begin, len(stretch)):
            owner.append(r)
            where.append(low)
            windows.append(stretch[low - begin : high - begin])
    if not windows:
        return {}
    # A score is at most MATCH for each of the window's words that the item has.
    known = np.add.reduceat(np.isin(np.concatenate(windows), item), np.cumsum([0, *map(len, windows[:-1])]), dtype=np.int64)
    enough = np.flatnonzero(known / len(item) >= accept).tolist()
    # Equal passages are aligned once.
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(windows[k].tobytes(), len(distinct)) for k in enough]
    found, at = align(item, [np.frombuffer(w, np.uint64) for w in distinct])
    out: dict[int, tuple[float, int]] = {}
    for k, n in zip(enough, which):
        score, end = float(found[n] / (MATCH * len(item))), int(where[k] + at[n])
        if score >= accept and (owner[k] not in out or (score, -end) > (out[owner[k]][0], -out[owner[k]][1])):
            out[owner[k]] = score, end
    return out


def align_batches(batches: Iterator[pa.RecordBatch], accept: float) -> Iterator[pa.RecordBatch]:
    """Best alignment of each stretch with its item around the rarest n-grams, else around all they share, if it reaches ``accept``."""
    for batch in batches:
        kept, scores, ends, rare = [], [], [], []
        words, items, all_shifts, rare_shifts = (batch.column(c) for c in ("words", "item_words", "shifts", "rare_shifts"))
        begins, numbers = batch.column("begin").to_numpy(), batch.column("item").to_numpy()
        n_all, n_rare = (np.asarray(c.value_lengths()) for c in (all_shifts, rare_shifts))
        for number in np.unique(numbers):
            mine = np.flatnonzero(numbers == number)
            item = items[int(mine[0])].values.to_numpy().view(np.uint64)
            first = _best_alignments(item, mine[n_rare[mine] > 0].tolist(), rare_shifts, words, begins, accept)
            rest = [r for r in mine[n_all[mine] > n_rare[mine]].tolist() if r not in first]
            for is_rare, found in ((True, first), (False, _best_alignments(item, rest, all_shifts, words, begins, accept))):
                for r, (score, end) in found.items():
                    kept.append(r)
                    scores.append(score)
                    ends.append(end)
                    rare.append(is_rare)
        index = pa.array(kept, pa.int64())
        keys = [batch.column(c).take(index) for c in ("row", "doc_id", "digest", "item")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(scores, pa.float64()), pa.array(ends, pa.int64()), pa.array(rare, pa.bool_())], names=["row", "doc_id", "digest", "item", "score", "end_word", "rare"])


def _aligned(hits: DataFrame, stretches: DataFrame, items: DataFrame, accept: float) -> DataFrame:
    """row, doc_id, digest, item, score, end_word of the pairs that count among ``hits`` (stretch, item, shift, rare)."""
    placed = hits.groupBy("stretch", "item").agg(F.collect_set("shift").alias("shifts"), F.collect_set(F.when(F.col("rare"), F.col("shift"))).alias("rare_shifts"))
    # The words are most of what is shuffled: they meet their hits once, and are not sorted for it.
    both = stretches.select("stretch", "row", "doc_id", "digest", "begin", "words").join(placed.hint("shuffle_hash"), "stretch").join(items.select("item", F.col("words").alias("item_words")), "item")
    kind = dict(stretches.dtypes)["doc_id"]
    both = both.select("row", "doc_id", "digest", "item", "begin", "words", "item_words", "shifts", "rare_shifts")
    found = both.mapInArrow(lambda it: align_batches(it, accept), f"row long, doc_id {kind}, digest long, item long, score double, end_word long, rare boolean")
    # The best match of a pair, the first of equal ones; one around rare n-grams before all others.
    match = F.struct("score", (-F.col("end_word")).alias("back"))
    pairs = found.groupBy("row", "doc_id", "digest", "item").agg(F.coalesce(F.max(F.when(F.col("rare"), match)), F.max(match)).alias("best"))
    return pairs.select("row", "doc_id", "digest", "item", F.col("best.score").alias("score"), (-F.col("best.back")).alias("end_word"))


def _pairs(docs: DataFrame, benchmark: DataFrame, accept: float) -> DataFrame:
    """row, doc_id, digest (of the text), item_id, score, end_word of every pair that counts, written."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", clean_text().alias("text"))
    items = materialize(items.mapInArrow(item_batches, f"item long, item_id {kinds[1]}, words array<long>, seeds array<long>"), "items")
    seeds = materialize(items.select("item", F.posexplode("seeds").alias("place", "seed")), "item-seeds")
    longest = items.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0
    reach, table = longest + longest // 4 + 4, spark.sparkContext.broadcast(bit_table(seeds))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(clean_text()).alias("digest"), clean_text().alias("text"))
    schema = f"row long, doc_id {kinds[0]}, digest long, begin long, words array<long>, places array<long>, seeds array<long>"
    stretches = rows.mapInArrow(lambda it: stretch_batches(it, table.value, reach), schema)
    stretches = materialize(stretches.withColumn("stretch", F.monotonically_increasing_id()), "stretches")

    places = stretches.select("stretch", F.explode(F.arrays_zip("places", "seeds")).alias("hit"))
    places = places.select("stretch", F.col("hit.places").alias("at"), F.col("hit.seeds").alias("seed"))
    often = places.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "place"))
    # Written, so that the join can split an n-gram that very many documents have; a benchmark's own n-grams may be few enough to be sent.
    known = materialize(seeds.join(often, "seed").select("seed", "item", "place", (rank <= RAREST).alias("rare")), "known-seeds")
    sent = F.broadcast(known) if known.count() <= SENT_SEEDS else known
    hits = places.join(sent, "seed").select("stretch", "item", (F.col("at") - F.col("place")).alias("shift"), "rare")
    out = materialize(_aligned(hits, stretches, items, accept).join(items.select("item", "item_id"), "item").drop("item"), "benchmark-pairs")
    discard(seeds, stretches, known, items)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, item_id, score, end_word of every pair of a document and an item that it copies or edits."""
    return _pairs(docs, benchmark, accept).select("doc_id", "item_id", "score", "end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no benchmark item."""
    p = free_prefix(docs, "b_")
    with scratch_scope(docs.sparkSession):
        gone = materialize(_pairs(docs, benchmark, accept).select(F.col("doc_id").alias(f"{p}doc"), F.col("digest").alias(f"{p}digest")).distinct(), "benchmark-rows")
    gone = F.broadcast(gone) if gone.count() <= SENT else gone.hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}doc")) & (F.xxhash64(clean_text()) == F.col(f"{p}digest"))
    return docs.join(gone, same, "left_anti")
