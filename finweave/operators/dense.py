"""Dense retrieval: a vector index of coarse cells and residual codes, with exact re-ranking, and an exact search.

Vectors are taken to unit length, so the inner product is the cosine; equal vectors stand once, with their ids
beside them, so that a vector that very many rows share costs one row in every step.

Index: centroids of the coarse cells, and a codebook of ``CODES`` values for each of the pieces that the residual
(vector less centroid) is cut into, are fitted by Lloyd's rounds on a sample of ``SAMPLE`` vectors by a digest, an
upper bound that is a parameter; every vector of the table gets its nearest cell and its codes.
How many cells a search looks at is settled on the sample: so many that these hold the share ``AIM`` of the ``TOP``
nearest vectors of ``TRIED`` of them (few where the table has clusters, most where its vectors lie evenly).
Search: each query scores the vectors of its nearest cells by lookup of the codes, keeps the best ``KEEP * k``, and these
are scored again by the whole vectors.

Cells may be of any size: a cell's rows and the queries that look at it are dealt by (cell, part of the rows,
part of the queries) into groups with a bound on both sides, and every group keeps its best alone.  The exact search
deals all rows and all queries in the same way.

Scores are in millionths, rounded to the nearest, so that they do not depend on the order of a sum.

Edge cases: null vectors, vectors of another length than most, of no finite number or of length 0 are not indexed
and get no rows as queries; ties go to the smaller id, null last; rows that share an id and a vector are one; an empty
index or no query gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.sources.tables import staged

SAMPLE, CELLS, CODES, PIECE, KEEP, ROUNDS = 20_000, 64, 256, 4, 16, 12
#: Share of the nearest vectors whose cells a search looks at, on the sample; vectors of the sample that are asked for this.
AIM, TRIED = 0.97, 400
#: Rows and queries of a group that are compared at once.
ROWS, QUERIES = 4096, 1024
UNIT, TOP = 1e6, 30


@dataclass(frozen=True)
class Codebook:
    """Centroids (cells, dimensions) and codes (pieces, codes, piece) of the residuals."""

    centroids: np.ndarray
    codes: np.ndarray


@dataclass(frozen=True)
class DenseIndex:
    """``rows``: vec, cell, codes; ``vectors``: vec, vector, least (its smallest id); ``ids``: vec, id; and the codebook."""

    rows: DataFrame
    vectors: DataFrame
    ids: DataFrame
    book: Codebook
    probe: int


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (digest of the vector), vector (unit length, doubles) of the rows that have a usable vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).withColumn("norm", norm)
    rows = rows.where(F.col("norm").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("vector")).withColumn("vec", F.xxhash64("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def lloyd(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most ``k`` clusters; a centroid that gets no point stays where it is."""
    rng = np.random.default_rng(seed)
    at = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        nearest = nearest_of(points, at)
        n = np.bincount(nearest, minlength=len(at))
        for d in range(points.shape[1]):
            total = np.bincount(nearest, weights=points[:, d], minlength=len(at))
            at[n > 0, d] = total[n > 0] / n[n > 0]
    return at


def nearest_of(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)


def fit(sample: np.ndarray, cells: int = CELLS, piece: int = PIECE, rounds: int = ROUNDS) -> Codebook:
    """A codebook of a sample of vectors; its number of dimensions is cut into pieces of ``piece``, the last may be shorter."""
    centroids = lloyd(sample, cells, rounds, 1)
    residual = sample - centroids[nearest_of(sample, centroids)]
    short = -residual.shape[1] % piece
    cut = np.pad(residual, ((0, 0), (0, short))).reshape(len(residual), -1, piece)
    books = [lloyd(cut[:, i], CODES, rounds, 2 + i) for i in range(cut.shape[1])]
    # Codebooks of a small sample have fewer codes; the rest repeat the first.
    return Codebook(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], CODES - len(b), 0)]) for b in books]))


def cells_to_probe(sample: np.ndarray, book: Codebook, k: int = TOP) -> int:
    """Nearest cells that hold the share ``AIM`` of the ``k`` nearest vectors, in the sample."""
    some = sample[:: max(1, len(sample) // TRIED)]
    near = np.argsort(-(some @ sample.T), axis=1)[:, :k]
    order = np.argsort((book.centroids**2).sum(1) - 2 * some @ book.centroids.T, axis=1)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, nearest_of(sample, book.centroids)[near], 1)
    return int(np.quantile(needed, AIM, method="higher")) + 1


def encode(vectors: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Cell and codes of every vector."""
    cell = nearest_of(vectors, book.centroids)
    residual = vectors - book.centroids[cell]
    pieces, _, piece = book.codes.shape
    cut = np.pad(residual, ((0, 0), (0, pieces * piece - residual.shape[1]))).reshape(len(residual), pieces, piece)
    return cell, np.stack([nearest_of(cut[:, i], book.codes[i]) for i in range(pieces)], 1).astype(np.uint8)


def _encode_batches(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell, codes = encode(_matrix(batch.column("vector"), batch.num_rows), book)
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec", "cell", "codes"])


def build_index(df: DataFrame, key: str = "id", vector: str = "vector", sample: int = SAMPLE, cells: int = CELLS) -> DenseIndex:
    """Index of every row of ``df``; the driver gets a sample of at most ``sample`` vectors for the fit."""
    rows = staged(unit_vectors(df, key, vector), "dense-unit")
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    rows = rows.where(F.size("vector") == (sizes["d"] if sizes else 0))
    vectors = staged(rows.groupBy("vec").agg(F.first("vector").alias("vector"), F.min("id").alias("least")), "dense-vectors")
    n = vectors.count()
    # A digest below a threshold, so that what is ordered is bounded too.
    some = vectors.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(2**31)) < F.lit(int(2**31 * min(1.0, 2.0 * sample / max(n, 1)))))
    picked = some.orderBy(F.xxhash64("vec", F.lit(1))).limit(sample).select("vector").toArrow()
    if not picked.num_rows:
        empty = Codebook(np.zeros((1, 1)), np.zeros((1, CODES, 1)))
        return DenseIndex(vectors.select("vec", F.lit(0).alias("cell"), F.lit(b"").alias("codes")).where("false"), vectors, rows.select("vec", "id"), empty, 1)
    points = _matrix(picked.column("vector"), picked.num_rows)
    book = fit(points, cells)
    coded = vectors.select("vec", "vector").mapInArrow(lambda it: _encode_batches(it, book), "vec long, cell int, codes binary")
    return DenseIndex(staged(coded, "dense-codes"), vectors, staged(rows.select("vec", "id").distinct(), "dense-ids"), book, cells_to_probe(points, book))


def _parts(rows: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
    """Adds ``name``: a part of the rows of a group, so that a part has about ``most`` rows, and ``{name}s``, the group's parts."""
    sizes = staged(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(f"{name}s")), f"dense-{name}s")
    return rows.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("vec", F.lit(7)), F.col(f"{name}s")).cast("int"))


def _met(rows: DataFrame, asked: DataFrame, score, k: int, schema: str) -> DataFrame:
    """Best ``k`` rows of every query by cell: groups of a part of a cell's rows and a part of its queries, each scored at once."""
    left, right = _parts(rows, ["cell"], ROWS, "part"), _parts(asked, ["cell"], QUERIES, "ask")
    counts = left.select("cell", "parts").distinct()
    asks = right.select("cell", "asks").distinct()
    left = left.join(asks, "cell").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("parts", "asks")
    right = right.join(counts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "asks")
    by = ["cell", "part", "ask"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _top(score(a, b), a, b, k), schema)


def _top(scores: np.ndarray, rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of a group by query, and whatever equals the last of them."""
    if not scores.size:
        return pa.table({"query": pa.array([], pa.int64()), "vec": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    whole = np.rint(scores * UNIT).astype(np.int64)
    k = min(k, whole.shape[1])
    least = np.partition(whole, whole.shape[1] - k, axis=1)[:, whole.shape[1] - k]
    q, r = np.nonzero(whole >= least[:, None])
    return pa.table({"query": asked.column("query").combine_chunks().take(pa.array(q)), "vec": rows.column("vec").combine_chunks().take(pa.array(r)), "score": pa.array(whole[q, r])})


def _by_codes(book: Codebook):
    def score(rows: pa.Table, asked: pa.Table) -> np.ndarray:
        if not rows.num_rows or not asked.num_rows:
            return np.zeros((0, 0))
        queries = _matrix(asked.column("vector"), asked.num_rows)
        pieces, _, piece = book.codes.shape
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, pieces)
        cut = np.pad(queries, ((0, 0), (0, pieces * piece - queries.shape[1]))).reshape(len(queries), pieces, piece)
        out = np.repeat(queries @ book.centroids[rows.column("cell")[0].as_py()][:, None], rows.num_rows, axis=1)
        for i in range(pieces):
            out += (cut[:, i] @ book.codes[i].T)[:, codes[:, i]]
        return out

    return score


def _by_vectors(rows: pa.Table, asked: pa.Table) -> np.ndarray:
    if not rows.num_rows or not asked.num_rows:
        return np.zeros((0, 0))
    return _matrix(asked.column("vector"), asked.num_rows) @ _matrix(rows.column("vector"), rows.num_rows).T


def _probe(batches: Iterator[pa.RecordBatch], book: Codebook, probe: int) -> Iterator[pa.RecordBatch]:
    """(query, vector) to (query, cell, vector) of the nearest cells."""
    for batch in batches:
        if batch.num_rows:
            points = _matrix(batch.column("vector"), batch.num_rows)
            n = min(probe, len(book.centroids))
            cells = np.argpartition((book.centroids**2).sum(1) - 2 * points @ book.centroids.T, n - 1, axis=1)[:, :n]
            again = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(again), pa.array(cells.ravel(), pa.int32()), batch.column("vector").take(again)], names=["query", "cell", "vector"])


def _asked(index: DenseIndex, queries: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors (query, vector), and the queries' ids beside them (query, query_id)."""
    rows = staged(unit_vectors(queries, key, vector), "dense-queries").where(F.size("vector") == F.lit(index.book.centroids.shape[1]))
    return rows.groupBy(F.col("vec").alias("query")).agg(F.first("vector").alias("vector")), rows.select(F.col("vec").alias("query"), F.col("id").alias("query_id"))


def _ranked(index: DenseIndex, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best ``k`` ids of every query id: by score, then id.

    The ``k`` best vectors by score and smallest id hold them; the smallest ``k`` ids of each are brought last.
    """
    found = _cut(found.join(index.vectors.select("vec", "least"), "vec"), k, F.col("score").desc(), F.col("least").asc_nulls_last())
    first = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    ids = index.ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    rows = _cut(found.join(ids, "vec"), k, F.col("score").desc(), F.col("id").asc_nulls_last())
    return asked.join(rows, "query").select("query_id", "place", "id", "score")


def _cut(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k)


def search(index: DenseIndex, queries: DataFrame, k: int = TOP, key: str = "query_id", vector: str = "vector", probe: int | None = None, keep: int = KEEP) -> DataFrame:
    """query_id, place, id, score: the best ``k`` among the candidates of the index, by their whole vectors."""
    probe = probe or index.probe
    vectors, asked = _asked(index, queries, key, vector)
    vectors = staged(vectors, "dense-asked")
    book = index.book
    probes = staged(vectors.mapInArrow(lambda it: _probe(it, book, probe), "query long, cell int, vector array<double>"), "dense-probes")
    schema = "query long, vec long, score long"
    near = _met(index.rows, probes.withColumn("vec", F.col("query")), _by_codes(book), keep * k, schema)
    near = staged(_cut(near, keep * k, F.col("score").desc(), F.col("vec")).select("query", "vec"), "dense-near")
    whole = near.join(index.vectors.drop("least"), "vec").join(vectors.withColumnRenamed("vector", "asked"), "query")
    product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _ranked(index, whole.select("query", "vec", F.round(product * UNIT).cast("long").alias("score")), asked, k)


def search_exactly(index: DenseIndex, queries: DataFrame, k: int = TOP, key: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, place, id, score: the best ``k`` of all rows; every query is compared with every vector, in blocks."""
    vectors, asked = _asked(index, queries, key, vector)
    one = staged(vectors.withColumns({"cell": F.lit(0), "vec": F.col("query")}), "dense-asked")
    found = _met(index.vectors.drop("least").withColumn("cell", F.lit(0)), one, _by_vectors, k, "query long, vec long, score long")
    return _ranked(index, found, asked, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_expected, n_found, recall: the share of the exact search's rows (query_id, id) that the other one has."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    met = exact.join(hit, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"))
    return met.withColumn("recall", F.col("n_found") / F.col("n_expected"))
