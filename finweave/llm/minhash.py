"""Near-duplicate classes by DartMinHash.

Signatures: every shingle owns a strip of the plane weight x rank on which hashed darts fall (one in
a unit of area on average).  A document sees the darts within its shingles' weights and below a rank
that leaves it about ``k (ln k + 3.5)`` of them; each dart belongs to one of ``k`` coordinates, and
each coordinate keeps its earliest dart.  Two documents keep the same dart with the probability of
their weighted Jaccard similarity.  The cost is one or two hashes for a shingle and a fixed number
of darts for a document, where plain MinHash takes ``k`` hashes for every shingle.  A document that
leaves a coordinate empty is thrown again with twice the rank; earlier darts stay.

A shingle weighs as often as it stands in the text, so the similarity is that of the texts' counts of
shingles; ``weighted=False`` makes all weights 1 and compares sets.

Classes: rows with equal shingle sets share a node.  Nodes with an equal band of the signature meet
in a bucket.  In each bucket all nodes are compared with one random hub, best hub first; components
of the links found so far are built; then, among the nodes of buckets that still hold several
components, every similar pair of different components is found by a prefix join: a set of ``n``
elements that is similar to another shares one of its ``n - ceil(0.8 n) + 1`` rarest elements with it, so
only those are joined, rare ones that stay in one component not at all.  So a group of copies, however
large, costs a few comparisons for each node, a group whose texts share half of their words costs next
to none, and no link is lost: a pair of a bucket that is never compared is in one component already or
is not similar.  Comparisons pass a size test and a parity sketch, both bounds that rule out nothing
similar, then exact similarity on whole sets.

The chance to miss a pair of similarity 0.8 is (1 - 0.8**5)**24 = 7e-5; it falls fast above.

Edge cases: null text is empty; texts without words form one class; texts below five words have one
shingle, all their words; repeated rows and rows that share an id are separate rows of the result;
a null id is kept and is larger than all others when a class is named; an empty table gives an empty
result; other columns are not carried by ``near_duplicates`` and are all kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import clean_text, discard, free_prefix, materialize, mix64, scratch_scope, shingle_hashes, text_pieces, word_hashes
from finweave.llm.components import components

WORDS, BANDS, ROWS = 5, 24, 5
THRESHOLD = (4, 5)  # 0.8 as a fraction
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (log(COORDINATES) + 3.5)
SETS_AT_ONCE = 512
POISSON = np.cumsum([exp(-1) / factorial(i) for i in range(18)])
UNIT = 2.0**-53


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * UNIT


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, most_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rank, dart) of all darts within the elements' weights and below their owner's rank.

    The strip of an element is cut into cells of area 1: weights and ranks double from level to
    level, and a cell of weight level ``nu`` and rank level ``rho`` is ``2**(nu - rho)`` wide and
    ``2**(rho - nu)`` high.  A cell's darts depend on the element and the cell alone.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    limit = most_rank[owner]
    nu = 0
    while (heavy := np.flatnonzero(weights > 2.0**nu - 1)).size:
        rho = 0
        while (near := heavy[limit[heavy] > 2.0**rho - 1]).size:
            cells = 2 ** (nu + rho)
            which = np.repeat(near, cells)
            number = np.tile(np.arange(cells), len(near))
            step_w, step_r = number >> nu, number & (2**nu - 1)
            width, height = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            w0, r0 = 2.0**nu - 1 + step_w * width, 2.0**rho - 1 + step_r * height
            inside = (w0 < weights[which]) & (r0 < limit[which])
            which, number, w0, r0 = which[inside], number[inside], w0[inside], r0[inside]
            cell = mix64(elements[which] ^ mix64(number.astype(np.uint64) + np.uint64((nu << 48) + (rho << 40) + 1)))
            count = np.searchsorted(POISSON, unit(cell), "right")
            dart = np.repeat(cell, count)
            place = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix64(dart + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            second = mix64(dart ^ np.uint64(0xD6E8FEB86659FD93))
            rank = np.repeat(r0, count) + height * unit(second)
            cut, which = which, np.repeat(which, count)
            kept = rank < limit[which]
            if (w0 + width > weights[cut]).any():
                kept &= np.repeat(w0, count) + width * unit(dart) < weights[which]
            out.append((owner[which[kept]], rank[kept], dart[kept]))
            rho += 1
        nu += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int = COORDINATES, n_darts: float = DARTS) -> np.ndarray:
    """(sets, k) earliest dart of each coordinate; a set without elements has zeros.

    A set costs its number of darts however short it is, so sets are taken ``SETS_AT_ONCE`` at a time.
    """
    out = [_signatures(elements[offsets[a] : offsets[b]], weights[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, n_darts) for a in range(0, len(offsets) - 1, SETS_AT_ONCE) for b in (min(a + SETS_AT_ONCE, len(offsets) - 1),)]
    return np.concatenate(out) if out else np.zeros((0, k), np.uint64)


def _signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int, n_darts: float) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weights=weights, minlength=n)
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero(total > 0)
    factor = 1.0
    while todo.size:
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        most = np.zeros(n)
        most[todo] = factor * n_darts / total[todo]
        who, rank, dart = darts(elements[mine], weights[mine], owner[mine], most)
        key = who * k + (mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(k)).astype(np.int64)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, key, rank)
        wins = rank == first[key]
        flat = out.reshape(-1)
        flat[key[wins]] = dart[wins]
        empty = np.isinf(first.reshape(n, k)[todo]).any(axis=1)
        todo, factor = todo[empty], factor * 2
    return out


def shingle_sets(texts: pa.Array, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, their weights, and the texts' offsets."""
    words, word_offsets = word_hashes(texts)
    shingles, offsets = shingle_hashes(words, word_offsets, WORDS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    weights = np.diff(np.append(start, len(shingles))).astype(float) if weighted else np.ones(len(start))
    counts = np.bincount(owner[start], minlength=len(offsets) - 1)
    return shingles[start], weights, np.concatenate([[0], np.cumsum(counts)])


def set_elements(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle that stands w times as w elements, so sets of elements have the weighted similarity, and their offsets."""
    times = weights.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    elements = mix64(np.repeat(shingles, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return elements, np.concatenate([[0], np.cumsum(times)])[offsets]


def set_keys(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit digest of each set, the same whatever the order; 0 for the empty set."""
    mixed = mix64(shingles * np.uint64(0xFF51AFD7ED558CCD) + weights.astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    return np.where(np.diff(offsets) > 0, mix64(total ^ np.diff(offsets).astype(np.uint64)), np.uint64(0))


SIGNED = np.int64
SIGN_SCHEMA = "row_hash long, node long, n int, bands array<long>, odd array<long>"
#: Words of 64 bits of the parity sketch.
ODD_WORDS = 16


def odd_sketches(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, ODD_WORDS) parity of the elements that fall on each bit.

    An element of one set only flips one bit, so two sketches differ in no more bits than the sets in
    elements: what this bound rules out is certainly not similar.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * ODD_WORDS)).astype(np.int64)
    parity = np.bincount(owner * 64 * ODD_WORDS + bit, minlength=n * 64 * ODD_WORDS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, -1), axis=1, bitorder="little").view(np.int64)


def sign_batches(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(np.arange(batch.num_rows))
        for index, texts in text_pieces(rows, batch.column("text")):
            shingles, weights, offsets = shingle_sets(texts, weighted)
            sig = signatures(shingles, weights, offsets)
            band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
            for r in range(ROWS):
                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, r::ROWS])
            full = np.diff(offsets) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(band[full].ravel().view(SIGNED)))
            elements, ends = set_elements(shingles, weights, offsets) if weighted else (shingles, offsets)
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * ODD_WORDS), pa.array(odd_sketches(elements, ends).ravel()))
            sizes = np.diff(ends)
            kept = [batch.column(name).take(index) for name in ("doc_id", "row_hash")]
            arrays = [*kept, pa.array(set_keys(shingles, weights, offsets).view(SIGNED)), pa.array(sizes.astype(np.int32)), lists, odd]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_hash", "node", "n", "bands", "odd"])


def set_batches(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    """(text) to (node, set)."""
    for batch in batches:
        for _, texts in text_pieces(batch.column("text"), batch.column("text")):
            shingles, weights, offsets = shingle_sets(texts, weighted)
            elements, ends = set_elements(shingles, weights, offsets) if weighted else (shingles, offsets)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(elements.view(SIGNED)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(shingles, weights, offsets).view(SIGNED)), lists], names=["node", "set"])


def sign(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, row_hash, node, size, bands and sketch of every row; written, as it is read many times."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(clean_text()).alias("row_hash"), clean_text().alias("text"))
    return materialize(rows.mapInArrow(lambda it: sign_batches(it, weighted), f"doc_id {kind}, {SIGN_SCHEMA}"), "signatures")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    above, below = THRESHOLD
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    common_ = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common_
    return both.where(common_ * below >= either * above).select("a", "b")


def may_be_similar(one: str, other: str) -> Column:
    """Size and parity tests of two nodes with columns n, odd behind the given prefixes; nothing similar fails them."""
    above, below = THRESHOLD
    c = lambda side, name: F.col(f"{side}_{name}")
    sizes = F.least(c(one, "n"), c(other, "n")) * below >= F.greatest(c(one, "n"), c(other, "n")) * above
    # Similar sets differ in at most (1 - s) / (1 + s) of their elements.
    return sizes & (differing(one, other) * (above + below) <= (c(one, "n") + c(other, "n")) * (below - above))


def differing(one: str, other: str) -> Column:
    """Bits in which two parity sketches differ: a lower bound of the elements that only one set has."""
    out = F.lit(0)
    for i in range(ODD_WORDS):
        out = out + F.bit_count(F.get(f"{one}_odd", F.lit(i)).bitwiseXOR(F.get(f"{other}_odd", F.lit(i))))
    return out


#: Columns of a node that its tests need.
NODE = ("n", "odd")


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in NODE])


def find_links(docs: DataFrame, signed: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, label), the component of every node that has a link to another, and the links (a, b)."""
    stood_by = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # One row for each node stands in the buckets; equal rows are equal in every column used.
    members = signed.where("n > 0").select("node", F.explode("bands").alias("bucket")).distinct()
    mixed = F.col("node").bitwiseXOR(F.col("bucket"))
    met = members.groupBy("bucket").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low != high")
    # Written, so that the join can split a bucket that very many nodes share.
    met = materialize(met.select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("b")), "met-buckets")
    # Buckets of one node are the bulk, and they end here.
    members = materialize(members.join(met, "bucket"), "buckets")
    discard(met)
    # Equal nodes have equal sketches; a maximum by word is a sum that aggregates before the shuffle.
    words = [F.max(F.get("odd", F.lit(i))).alias(f"o{i}") for i in range(ODD_WORDS)]
    nodes = signed.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), *words).select("node", "n", F.array(*[f"o{i}" for i in range(ODD_WORDS)]).alias("odd"))
    nodes = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    hubs = members.where("node != b").select(F.col("node").alias("a"), "b").distinct()
    hubs = hubs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(may_be_similar("a", "b"))
    hubs = materialize(hubs.select("a", "b", (differing("a", "b") / (F.col("a_n") + F.col("b_n"))).alias("differ")), "hub-pairs")
    # Whole sets of the nodes that met another one; the text's own digest tells rows apart that share an id.
    wanted = members.select("node").distinct().join(stood_by, "node").select(F.col("doc_id").alias("w_doc")).distinct()
    texts = docs.select("doc_id", clean_text().alias("text")).join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi")
    sets = texts.select("text").mapInArrow(lambda it: set_batches(it, weighted), "node long, set array<long>")
    # A second row with an id that stands for a node may bring a set that another row brings too.
    sets = materialize(sets.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")

    best = F.min(F.struct("differ", "b"))
    first = hubs.groupBy("a").agg(best.alias("best")).select("a", F.col("best.b").alias("b"))
    links = materialize(similar_pairs(first, sets), "links")
    labels = components(links)
    for pairs in (lambda lab: _apart(hubs.select("a", "b"), lab), lambda lab: _rare_pairs(members, nodes, sets, lab)):
        more = materialize(similar_pairs(materialize(pairs(labels), "pairs"), sets), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        labels = components(links)
    discard(members, nodes, hubs, sets)
    return labels, links


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Adds a node's label; a node without links is its own."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return rows.join(named, node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    both = _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb")
    return both.where("la != lb").select("a", "b")


def _rare_pairs(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that may be similar, among the nodes of buckets that hold several components.

    Elements stand in order of the number of these nodes that have them, rarest first; elements of one
    component only come before all others and pair with nothing.  Of two sets' first common element, at
    most the elements from its places on are common, so a pair whose places leave too few is no pair.
    """
    above, below = THRESHOLD
    rows = _labelled(members.select("bucket", "node"), labels, "node", "label")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    left = materialize(rows.join(mixed, "bucket", "left_semi").select("node", "label").distinct(), "mixed-nodes")
    elements = left.join(sets, "node").select("node", "label", F.size("set").alias("n"), F.explode("set").alias("element"))
    shared = elements.groupBy("element").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    shared = materialize(shared.select("element", "often"), "shared-elements")
    placed = elements.join(shared, "element").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("order"))
    # The prefix, less the elements that come before the shared ones.
    alone = F.col("n") - F.size("order")
    rare = F.col("n") - F.ceil(F.col("n") * F.lit(above) / F.lit(below)).cast("int") + 1 - alone
    prefix = placed.where(rare > 0).select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), rare)).alias("place", "e"))
    prefix = prefix.select("node", "label", F.col("e.element").alias("element"), (F.col("n") - F.col("alone") - F.col("place")).alias("rest"))
    prefix = materialize(prefix.join(nodes, "node"), "rare-elements")
    side = lambda s: prefix.select("element", *[F.col(c).alias(s if c == "node" else f"{s}_{c}") for c in ("node", "label", "rest", *NODE)])
    enough = F.least("a_rest", "b_rest") * (above + below) >= (F.col("a_n") + F.col("b_n")) * above
    met = side("a").join(side("b"), "element").where((F.col("a_label") < F.col("b_label")) & enough & may_be_similar("a", "b"))
    return met.select("a", "b").distinct()


def classes(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, row_hash, label, class_id, class_rows, n_links: every row's class, named by its smallest id.

    ``n_links`` counts the other texts that the row's text was compared with and found similar to.
    """
    signed = sign(docs, weighted)
    labels, links = find_links(docs, signed, weighted)
    # Ids of a node first, then of a component: neither holds a group's rows.
    per_node = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "class-nodes")
    named = labels.join(per_node, "node")
    per_label = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_rows"))
    # Two nodes may have stood as hubs for each other.
    once = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = once.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(per_label, "label").join(degree, "node").select("node", "label", "class_id", "class_rows", "n_links", F.lit(True).alias("is_linked"))
    known = per_node.join(linked, "node", "left")
    own = lambda name, alone: F.when(F.col("is_linked"), F.col(name)).otherwise(alone).alias(name)
    # Written, so that the join with the rows can split a node that very many rows share.
    known = materialize(known.select("node", own("label", F.col("node")), own("class_id", F.col("least")), own("class_rows", F.col("rows")), own("n_links", F.lit(0).cast("long"))), "classes")
    return signed.select("doc_id", "row_hash", "node").join(known, "node").drop("node")


def near_duplicates(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_rows, n_links for every row of ``docs`` (doc_id, text)."""
    return classes(docs, weighted).select("doc_id", "class_id", "class_rows", "n_links")


def keep_one(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """One row of each class, with all its columns: the row with the smallest id (ties by text digest)."""
    # Names that no column of the caller has.
    p = free_prefix(docs, "k_")
    named = lambda c: F.col(f"{p}{c}")
    # What is left of the search is one narrow row for each class.
    with scratch_scope(docs.sparkSession):
        rows = classes(docs, weighted)
        # Two plain minima instead of one over a struct: they aggregate before the shuffle.
        kept = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id").agg(F.min("row_hash").alias("row_hash"))
        times = rows.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("times"))
        kept = kept.select(F.col("doc_id").alias(f"{p}doc"), F.col("row_hash").alias(f"{p}hash"))
        times = times.select(F.col("doc_id").alias("t_doc"), F.col("row_hash").alias("t_hash"), F.col("times").alias(f"{p}times"))
        kept = materialize(kept.join(times, named("doc").eqNullSafe(F.col("t_doc")) & named("hash").eqNullSafe(F.col("t_hash"))).drop("t_doc", "t_hash"), "kept-rows")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.withColumn(f"{p}text", F.xxhash64(clean_text())).join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(named("doc")) & named("text").eqNullSafe(named("hash")))
    # Rows repeated in full are rare; only they pay for a deduplication by text digest.
    once = found.where(named("times") == 1).select(*columns)
    repeated = found.where(named("times") > 1).dropDuplicates([f"{p}doc", f"{p}hash"]).select(*columns)
    return once.unionByName(repeated)
