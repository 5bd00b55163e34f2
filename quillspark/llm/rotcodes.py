"""Embedding near-duplicates by randomised-rotation binary codes.

Every distinct unit vector gets the signs of its coordinates under a few random
rotations as a code, and for each rotation a correction factor: the inner
product of the rotated vector with its code. A code over its factor, rotated
back, is the vector itself on average over the rotations. So the inner product
of two vectors' codes under different rotations estimates their cosine without
bias; pairs whose confidence bound stays under the threshold are done with, all
others are computed again in double precision.

Pairs are looked for in hash tables keyed by bits of the codes. Key length
follows the number of vectors, the number of tables follows from the recall
asked for at the very threshold; closer pairs are found more surely. Codes and
factors alone go into the tables; vectors follow only where a pair is open.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .memory import tidy
from .scratch import Scratch


@dataclass(frozen=True)
class Search:
    """Parameters of the search; ``tables`` and ``bits`` come from ``plan``."""

    threshold: float = 0.9
    recall: float = 0.985  #: of pairs at the threshold itself
    bucket: int = 256  #: vectors in a bucket, on average
    block: int = 1024  #: larger buckets are compared block by block
    deviations: float = 5.0  #: width of the confidence bound
    seed: int = 20
    bits: int = 0
    tables: int = 0

    def plan(self, n: int) -> Search:
        """Key bits and tables for n vectors."""
        bits = max(4, math.ceil(math.log2(max(1, n / self.bucket))))
        together = (1 - math.acos(self.threshold) / math.pi) ** bits
        tables = math.ceil(math.log(1 - self.recall) / math.log(1 - together))
        return Search(**(self.__dict__ | {"bits": bits, "tables": tables}))


@lru_cache(maxsize=8)
def rotations(dim: int, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Random rotations, stacked, and the code bits that each table's key takes."""
    rng = np.random.default_rng(search.seed)
    count = max(4, -(-search.tables * search.bits // dim))
    stacked = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        stacked.append(q * np.sign(np.diag(r)))
    width = count * dim
    picks = np.stack([rng.permutation(width)[: search.bits] if search.bits <= width else rng.integers(0, width, search.bits) for _ in range(search.tables)])
    if search.tables * search.bits <= width:
        picks = rng.permutation(width)[: search.tables * search.bits].reshape(search.tables, search.bits)
    return np.stack(stacked), picks


def encode(units: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (n, rotations, dim) as booleans, correction factors (n, rotations), table keys (n, tables)."""
    turned, _ = rotations(units.shape[1], search)
    y = np.einsum("rij,nj->nri", turned, units)
    signs = y > 0
    factors = np.abs(y).sum(axis=2) / math.sqrt(units.shape[1])
    return signs, factors, keys_of(signs, search)


def keys_of(signs: np.ndarray, search: Search) -> np.ndarray:
    """Keys of all tables (n, tables) from the signs."""
    _, picks = rotations(signs.shape[2], search)
    weights = 1 << np.arange(search.bits, dtype=np.int64)
    return signs.reshape(len(signs), -1)[:, picks].astype(np.int64) @ weights


def estimates(signs: np.ndarray, factors: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all pairs, and the half-widths of their confidence bounds, from codes and factors alone.

    Rotations fall into two halves. A vector decoded from one half is met with
    the other decoded from the other half, both ways: their errors, of squared
    length 1 / factor^2 - 1 for a rotation, are independent.
    """
    dim = signs.shape[2]
    turned, _ = rotations(dim, search)
    decoded, errors = [], []
    for half in (slice(0, None, 2), slice(1, None, 2)):
        own, f = turned[half].astype(np.float32), factors[:, half]
        weights = np.where(signs[:, half], 1.0, -1.0).astype(np.float32) / (f * math.sqrt(dim))[:, :, None].astype(np.float32)
        decoded.append(np.einsum("nri,rij->nj", weights, own, optimize=True) / len(own))
        errors.append((np.maximum(0.0, 1 / f**2 - 1).sum(axis=1) / len(own) ** 2).astype(np.float32))
    (a, b), (p, q) = decoded, errors
    found = a @ b.T
    found = (found + found.T) / 2
    both = np.outer(p, q)
    spread = (p + q)[:, None] + (p + q)[None] + both + both.T
    return found, search.deviations * np.sqrt(spread / (4 * max(1, dim - 1)))


def open_pairs(signs: np.ndarray, factors: np.ndarray, search: Search, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b whose cosine may reach the threshold by their bound."""
    found, half = estimates(signs, factors, search)
    return np.nonzero(np.triu(found + half >= search.threshold - slack, 1))


def units_of(vectors: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in doubles, from stored vectors of one dimension."""
    rows = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _stored_rows(kind: str):
    """(id, digest, vector as it is); digest and vector null where a vector links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for values in batch.column(1).to_pylist():
                v = np.array(values, kind) if values and None not in values else None
                usable = v is not None and bool(np.isfinite(v).all()) and bool(v.any())
                vectors.append(v.tobytes() if usable else None)
                # 0.0 and -0.0 are equal
                digests.append(hashlib.blake2b((v + 0).tobytes(), digest_size=16).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["id", "digest", "vector"])

    return run


def _codes(search: Search, kind: str):
    """(id, code, keys): the code with its factors behind it, and the keys of all tables, from (id, vector)."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v) // size, []).append(i)
            for dim, rows in by_dim.items():
                signs, factors, keys = encode(units_of([vectors[i] for i in rows], kind), search)
                packed = np.packbits(signs.reshape(len(rows), -1), axis=1)
                codes = np.hstack((packed, factors.astype("<f4").view(np.uint8).reshape(len(rows), -1)))
                # vectors of different dimensions never meet
                keys = keys + (dim << 32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["id", "code", "keys"])

    return run


CODED = "id long, code binary, keys array<long>"
PLACED = "table int, key long, i int, j int, own int, id long, code binary"
FOUND = "u long, v long, n long"


def _decoded(codes: list[bytes], dim: int, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Signs and factors out of stored codes."""
    count = len(rotations(dim, search)[0])
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    bits = -(-count * dim // 8)
    signs = np.unpackbits(raw[:, :bits], axis=1)[:, : count * dim].astype(bool).reshape(len(codes), count, dim)
    return signs, np.ascontiguousarray(raw[:, bits:]).view("<f4").astype(np.float64)


def _pairs_of(rows: list[tuple], search: Search, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Open pairs of the rows of one cell that meet there first."""
    table, key, i, j = rows[0][:4]
    signs, factors = _decoded([r[6] for r in rows], key >> 32, search)
    a, b = open_pairs(signs, factors, search, slack)
    if i != j:
        side = np.array([r[4] for r in rows])
        a, b = a[side[a] != side[b]], b[side[a] != side[b]]
    if table and len(a):
        # a pair belongs to the first table in which it meets
        keys = keys_of(signs, search)[:, :table]
        new = np.ones(len(a), bool)
        for t in range(table):
            new &= keys[a, t] != keys[b, t]
        a, b = a[new], b[new]
    return a, b


def _cell_by_cell(solve):
    """A task function over rows sorted by cell; ``solve`` gets a cell's rows, of which there are two at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != cell:
                    if len(rows) > 1 and (out := solve(rows)) is not None:
                        yield out
                    cell, rows = row[:4], []
                rows.append(row)
        if len(rows) > 1 and (out := solve(rows)) is not None:
            yield out

    return run


def _open_rows(search: Search):
    """The rows of each cell that have an open pair there."""
    names = [c.split()[0] for c in PLACED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        chosen = np.unique(np.concatenate(_pairs_of(rows, search)))
        if not len(chosen):
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(rows[i] for i in chosen.tolist())), kinds)], names)

    return _cell_by_cell(solve)


def _links(search: Search, kind: str):
    """Links of each cell: counts (u, null, n), star edges (u, v, 0), and (null, null, pairs computed again)."""
    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        # sums may come out otherwise in the last digits than among all rows of the cell
        a, b = _pairs_of(rows, search, slack=1e-4)
        units = units_of([r[8] for r in rows], kind)
        cosine = np.empty(len(a))
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            cosine[part] = np.einsum("ij,ij->i", units[a[part]], units[b[part]])
        again = len(a)
        a, b = a[cosine >= search.threshold], b[cosine >= search.threshold]
        ids, copies = np.array([r[5] for r in rows], np.int64), np.array([r[7] for r in rows], np.int64)
        n = (np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))).astype(np.int64)
        some = np.flatnonzero(n)
        u, v = forest(ids[a], ids[b]) if len(a) else (a, b)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*ids[some].tolist(), *u.tolist(), None], pa.int64()),
                pa.array([None] * len(some) + v.tolist() + [None], pa.int64()),
                pa.array([*n[some].tolist(), *([0] * len(u)), again], pa.int64()),
            ],
            ["u", "v", "n"],
        )

    return _cell_by_cell(solve)


def near_links(distinct: DataFrame, search: Search, scratch: Scratch, kind: str) -> DataFrame:
    """(u, v, n) rows from rows (id, copies, vector): links per vector, v null; star edges, n 0; and, u null, pairs computed again."""
    coded = scratch.table(distinct.select("id", "vector").mapInArrow(tidy(_codes(search, kind)), CODED), "codes")
    entries = coded.select("id", "code", F.posexplode("keys").alias("table", "key"))
    hot = scratch.table(coded.select(F.posexplode("keys").alias("table", "key")).groupBy("table", "key").agg(F.count("*").alias("n")).filter(F.col("n") > search.block), "hot")
    placed = entries.join(hot, ["table", "key"], "left").withColumn("of", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / search.block)).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("of")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cells = placed.select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "code")
    order = ["table", "key", "i", "j"]
    opened = scratch.table(cells.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(tidy(_open_rows(search)), PLACED), "open")
    with_vectors = opened.join(distinct.select("id", "copies", "vector"), "id").select(*order, "own", "id", "code", "copies", "vector")
    return with_vectors.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(tidy(_links(search, kind)), FOUND)


def near_duplicates(vectors: DataFrame, scratch: Scratch, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: id, n_links, component_id, kept.

    Links join vectors with a cosine of at least ``search.threshold`` in double
    precision; component_id is the smallest id reachable, the own one included,
    and kept says whether it is the own one. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do rows
    without an id (component null, kept true) or vectors of another dimension.
    Equal vectors are searched for once, however many there are. Other columns
    are not read.

    All rows are in the tables. A bucket of more than ``search.block`` vectors
    is cut into blocks, a pair of blocks to a cell, so no task holds more than
    two blocks. A first pass over the cells has codes only and finds the rows
    with an open pair; these get their vectors for the second, which puts out
    counts and a forest, never all pairs of a group.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = scratch.table(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(tidy(_stored_rows(kind)), "id long, digest binary, vector binary"), "units")
    usable = rows.filter("digest is not null and id is not null")
    classes = scratch.table(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    found = scratch.table(near_links(classes.select(F.col("rep").alias("id"), "copies", "vector"), search.plan(classes.count()), scratch, kind), "found")
    counts = found.filter("u is not null and v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("v is not null").select("u", "v"), scratch).withColumnRenamed("node", "rep")
    solved = classes.select("digest", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    solved = solved.select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.withColumn("key", F.when(F.col("id").isNotNull(), F.col("digest"))).select("id", "key").join(solved.withColumnRenamed("digest", "key"), "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
