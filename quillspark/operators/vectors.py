"""Dense and sparse similarity search for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import written

from .search import SCALE, top_k

#: Vectors in a packed row, of the queries and of those searched.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Bytes of queries that are broadcast at most.
BROADCAST_BYTES = 32 << 20


#: Queries of a block whose scores are held at once.
TILE = 128
#: Parts that a cell's vectors are dealt to where the queries are too many to broadcast.
SALTS = 16


def _pack(size: int):
    """(ids, data, cell): rows of up to ``size`` vectors of one cell and length, out of (id, vector, cell)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(key: tuple, n: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(key)))
            if len(ids) > n:
                held[key] = [(ids[n:], vectors[n:])]
            return pa.RecordBatch.from_arrays([pa.array([ids[:n].tobytes()], pa.binary()), pa.array([vectors[:n].tobytes()], pa.binary()), pa.array([key[0]], pa.int32())], ["ids", "data", "cell"])

        for batch in batches:
            lists = batch.column(1)
            ids, cells, sizes = (np.asarray(x) for x in (batch.column(0).cast(pa.int64()), batch.column(2), pc.list_value_length(lists)))
            values, starts = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
            whole = sizes > 0
            if values.null_count:
                gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
                whole &= gaps[starts[1:]] == gaps[starts[:-1]]
            values = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            for cell, dim in sorted(set(zip(cells[whole].tolist(), sizes[whole].tolist()))):
                mine = np.flatnonzero(whole & (cells == cell) & (sizes == dim))
                held.setdefault((cell, dim), []).append((ids[mine].astype("<i8"), values[starts[mine][:, None] + np.arange(dim)].astype("<f8")))
                while sum(len(x) for x, _ in held.get((cell, dim), [])) >= size:
                    yield packed((cell, dim), size)
        for key in list(held):
            yield packed(key, size)

    return run


def _packed(vectors: DataFrame, size: int, cell: F.Column | None = None) -> DataFrame:
    rows = vectors.filter("id is not null and vector is not null").select("id", "vector", (F.lit(0) if cell is None else cell).cast("int").alias("cell"))
    return rows.mapInArrow(_pack(size), "ids binary, data binary, cell int")


def _nearest(k: int, metric: str):
    """(query_id, doc_id, score) of the k best, and of ties at the border, for each query of a pair of packed rows; a few queries' scores at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, queries, ids, vectors = (np.frombuffer(c[row].as_buffer(), kind) for c, kind in zip(batch.columns, ("<i8", "<f8", "<i8", "<f8")))
                queries, vectors = queries.reshape(len(names), -1), vectors.reshape(len(ids), -1)
                if queries.shape[1] != vectors.shape[1]:
                    continue
                if metric == "cosine":
                    queries, vectors = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] for x in (queries, vectors))
                squares = (vectors**2).sum(axis=1)
                for at in range(0, len(names), TILE):
                    some, own = queries[at : at + TILE], names[at : at + TILE]
                    scores = some @ vectors.T
                    if metric != "cosine":
                        scores *= 2
                        scores -= (some**2).sum(axis=1)[:, None] + squares[None]
                    np.round(scores, SCALE, out=scores)
                    scores[own[:, None] == ids[None]] = -np.inf
                    worst = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(own), -np.inf)
                    q, v = np.nonzero((scores >= worst[:, None]) & np.isfinite(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[v]), pa.array(np.abs(scores[q, v]) if metric == "l2" else scores[q, v])], ["query_id", "doc_id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest of all vectors to each query, itself excluded.

    ``queries`` and ``vectors`` are (id, vector). Cosine goes by the greatest
    score, squared L2 distance by the least. Rows without id, and vectors that
    are null, empty or hold nulls, take no part; lengths that differ never meet.

    Queries and vectors are packed, a block of them a row, and every block of
    the stated queries meets every block of vectors. Nothing comes to the
    driver; a pair of blocks leaves k rows a query, which alone are shuffled.
    """
    asked = _packed(queries, QUERY_BLOCK).select(F.col("ids").alias("names"), F.col("data").alias("queries"))
    blocks = _packed(vectors, VECTOR_BLOCK).select("ids", "data")
    found = asked.crossJoin(blocks).mapInArrow(_nearest(k, metric), "query_id long, doc_id long, score double")
    if metric == "cosine":
        return top_k(found, k)
    return top_k(found.withColumn("order", -F.col("score")), k, score="order").drop("order")


def vote_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, label): the most frequent label of a query's neighbours, the nearest first on ties."""
    joined = neighbours.join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id")
    counts = joined.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return counts.groupBy("query_id").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("near"))).alias("label"), F.max("n").alias("votes"))


@dataclass(frozen=True)
class CellIndex:
    """Vectors in k-means cells: vectors(id, vector, cell) and the cells' centres."""

    vectors: DataFrame
    centres: list[list[float]]

    def save(self, path: str) -> None:
        """Write the index, a folder per cell, so that a search reads only the cells it looks into."""
        spark = self.vectors.sparkSession
        self.vectors.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame(list(enumerate(self.centres)), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return CellIndex(spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int")), [r["centre"] for r in centres])

    def search(self, queries: DataFrame, k: int, probe: int) -> DataFrame:
        """The k nearest by squared L2 among the vectors of the ``probe`` cells nearest to each query; exact if these are all."""
        gaps = F.array(*[F.struct(_squared(F.col("vector"), c).alias("gap"), F.lit(i).alias("cell")) for i, c in enumerate(self.centres)])
        near = F.slice(F.array_sort(gaps), 1, probe)["cell"] if self.centres else F.array().cast("array<int>")
        asked = queries.filter("id is not null and vector is not null").select("id", "vector", F.explode(near).alias("cell"))
        size = queries.count() * probe * (8 * len(self.centres[0]) + 32) if self.centres else 0
        # packed by cell: blocks of queries meet the blocks of their cell, and a pair of blocks leaves k rows a query
        asked = _packed(asked, QUERY_BLOCK, F.col("cell")).select(F.col("ids").alias("names"), F.col("data").alias("queries"), "cell")
        blocks = _packed(self.vectors, VECTOR_BLOCK, F.col("cell"))
        if size <= BROADCAST_BYTES:
            pairs = blocks.join(F.broadcast(asked), "cell")
        else:
            pairs = blocks.withColumn("salt", F.monotonically_increasing_id() % SALTS).join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["cell", "salt"])
        found = pairs.select("names", "queries", "ids", "data").mapInArrow(_nearest(k, "l2"), "query_id long, doc_id long, score double")
        return top_k(found.withColumn("order", -F.col("score")), k, score="order").drop("order")


def cell_index(vectors: DataFrame, cells: int = 10, seed: int = 7) -> CellIndex:
    """Fit the cells by the library's distributed k-means and assign every vector (id, vector) to one; null vectors have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.filter("id is not null and vector is not null").select("id", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if data.isEmpty():
        return CellIndex(data.select("id", "vector", F.lit(0).alias("cell")), [])
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(data)
    return CellIndex(model.transform(data).select("id", "vector", F.col("prediction").alias("cell")), [[float(x) for x in c] for c in model.clusterCenters()])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, recall): the share of the exact neighbours (query_id, doc_id) that were found."""
    hit = found.select("query_id", "doc_id", F.lit(1.0).alias("hit"))
    return exact.select("query_id", "doc_id").join(hit, ["query_id", "doc_id"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def embed(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vector) by a model: a factory, called once a task, of a function from a list of texts to as many lists of numbers.

    Texts go to it by Arrow batch; a null text counts as empty.
    """
    @F.pandas_udf("array<double>")
    def vectors_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in run(texts.tolist())])

    return df.select(F.col(id_col).alias("id"), vectors_of(F.coalesce(text_col, F.lit(""))).alias("vector"))


def cosine_scores(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): cosine of each candidate with its own query; ``queries`` and ``docs`` are (id, vector).

    Candidates without either vector, or with a zero one, have a null score.
    """
    def dot(a: str, b: str) -> F.Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    # vectors that no candidate asks for go first: an outer join would shuffle them all
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).join(candidates.select("query_id").distinct(), "query_id", "left_semi")
    found = docs.select(F.col("id").alias("doc_id"), F.col("vector").alias("d")).join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = candidates.select("query_id", "doc_id").join(asked, "query_id", "left").join(found, "doc_id", "left")
    cosine = dot("q", "d") / F.nullif(F.sqrt(dot("q", "q")) * F.sqrt(dot("d", "d")), F.lit(0.0))
    return pairs.select("query_id", "doc_id", F.round(cosine, SCALE).alias("score"))


def _squared(vector: F.Column, centre: list[float]) -> F.Column:
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, centre)), lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x)


def sparse_dot(query_weights: DataFrame, doc_weights: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) from (query_id, term, q) and (doc_id, term, d): dot products over common terms.

    With ``candidates`` (query_id, doc_id) only theirs: their terms are written,
    and a document's other weights go before anything is shuffled.
    """
    on = ["term"]
    if candidates is not None:
        on = ["term", "doc_id"]
        query_weights = written(candidates.select("query_id", "doc_id").join(query_weights, "query_id"), "pairs")
    return query_weights.join(doc_weights, on).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q") * F.col("d")), SCALE).alias("score"))
