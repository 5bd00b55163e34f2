"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream into
chunks wherever its low bits are zero, so equal passages make equal chunks
wherever they stand. Unique chunks are stored once under their digest. Recipes
list the chunks of each document in ascending id order, and Merkle roots over
chunks, documents and parts verify a reconstruction.

A store is a folder of Parquet tables:

- ``chunks``: digest, ids (little-endian, 2 or 4 bytes each)
- ``recipes``: part, pos, id, offset, n_tokens, sizes, digests, root; sorted by id
- ``manifest``: part, base, n_docs, n_tokens, root

The ids of a document start at ``base + offset`` of the whole stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import hold, tidy
from .scratch import Scratch
from .wordstream import WordEncoder, flattened, text_slices

END_ID = 2
DIGEST = 16  #: bytes of a BLAKE2b digest
WINDOW, LEAST, MOST, MASK = 16, 64, 1024, 255


def digest_of(data) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over digests; an odd one out moves up unchanged, no leaves give the digest of nothing."""
    if not leaves:
        return digest_of(b"")
    while len(leaves) > 1:
        paired = [digest_of(a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = paired + leaves[len(leaves) & ~1 :]
    return leaves[0]


def _gear(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 32-bit value for each id."""
    x = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each position, a hash of the last WINDOW ids (fewer at the front)."""
    h = _gear(ids)
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] * np.uint32(pow(0x2545F491, span, 1 << 32))
        h = h + shifted
        span *= 2
    return h ^ (h >> np.uint32(16))


def chunk_ends(n: int, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks of n ids: at the first candidate after LEAST ids, after MOST at the latest."""
    ends, start = [], 0
    while n - start > LEAST:
        i = int(np.searchsorted(candidates, start + LEAST))
        stop = min(int(candidates[i]) if i < len(candidates) else n, start + MOST, n)
        ends.append(stop)
        start = stop
    if start < n:
        ends.append(n)
    return ends


#: Pieces that go to the library in one text.
JOINED = 2_000


class LibraryPieces:
    """Ids of pieces by the tokenizers library.

    Pieces of letters are words of their own wherever they stand, and the last
    token of a word has an id of its own kind; so many of them go in as one
    text, and its ids are told apart by these ends. Where the ends do not tell
    as many words as went in, and for all other pieces, each is a text.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self._ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self._ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (coded,) = self._tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        ends = np.flatnonzero(self._ends[np.minimum(ids, len(self._ends) - 1)])
        if len(ends) != len(pieces) or not len(ends) or ends[-1] != len(ids) - 1:
            return self._each(pieces)
        return ids, np.diff(ends, prepend=-1)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        rest, words = np.flatnonzero(~alone), np.flatnonzero(alone)
        parts = [(rest, self._each([pieces[i] for i in rest.tolist()]))] if len(rest) else []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            parts.append((some, self._joined([pieces[i] for i in some.tolist()])))
        n = np.zeros(len(pieces), np.int64)
        for rows, (_, sizes) in parts:
            n[rows] = sizes
        firsts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint32)
        for rows, (own, sizes) in parts:
            ids[np.repeat(firsts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))] = own
        return ids, n


def _library_coder(path: str) -> WordEncoder:
    return hold(("library", path), lambda: WordEncoder(LibraryPieces(path)))


@dataclass(frozen=True)
class TokenStore:
    """A written store; ``width`` is the number of bytes of a stored id."""

    spark: SparkSession
    uri: str
    width: int
    id_type: T.DataType

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("digest binary, ids binary").parquet(f"{self.uri}/chunks")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(_recipe_schema(self.id_type)).parquet(f"{self.uri}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("part int, base long, n_docs long, n_tokens long, root binary").parquet(f"{self.uri}/manifest")


def _recipe_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("pos", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("offset", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("digests", T.BinaryType()),
            T.StructField("root", T.BinaryType()),
        ]
    )


#: Digests of chunks that a task remembers, to put each out once; beyond, it starts anew.
SEEN_CHUNKS = 500_000


def _encode(docs: DataFrame, tokenizer: str, width: int) -> DataFrame:
    """``(id, n_tokens, sizes, digests, root, ids)``: a row per document, END_ID last, and one per chunk.

    A document's row has no ids. A chunk's row has nothing but its digest, in
    ``digests``, and its ids; a task puts out each chunk once.
    """
    id_type = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _library_coder(tokenizer)
        seen: set[bytes] = set()
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                bare, counts = coder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(bare, np.cumsum(counts), END_ID)
                counts = counts + 1
                ends = np.cumsum(counts)
                cuts = np.flatnonzero((rolling_hash(ids) & np.uint32(MASK)) == 0) + 1
                data = memoryview(ids.astype(f"<u{width}").tobytes())
                bounds = np.searchsorted(cuts, np.stack((ends - counts, ends)), side="right")
                sizes, digests, roots, chunks, payloads = [], [], [], [], []
                for start, n, lo, hi in zip((ends - counts).tolist(), counts.tolist(), *bounds.tolist()):
                    own = [0, *chunk_ends(n, cuts[lo:hi] - start)]
                    leaves = []
                    for i, j in zip(own, own[1:]):
                        piece = data[(start + i) * width : (start + j) * width]
                        leaves.append(key := digest_of(piece))
                        if key not in seen:
                            seen.add(key)
                            chunks.append(key)
                            payloads.append(bytes(piece))  # Arrow would keep hold of a view
                    sizes.append(np.diff(own).astype("<u4").tobytes())
                    digests.append(b"".join(leaves))
                    roots.append(merkle_root(leaves))
                if len(seen) > SEEN_CHUNKS:
                    seen.clear()
                own_ids = batch.column(0).slice(a, b - a)
                none = pa.nulls(len(chunks), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own_ids, pa.array(counts, pa.int64()), pa.array(sizes, pa.binary()), pa.array(digests, pa.binary()), pa.array(roots, pa.binary()), pa.nulls(b - a, pa.binary())], names
                )
                yield pa.RecordBatch.from_arrays([pa.nulls(len(chunks), own_ids.type), pa.nulls(len(chunks), pa.int64()), none, pa.array(chunks, pa.binary()), none, pa.array(payloads, pa.binary())], names)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "digests", "root", "ids"))])
    names = schema.names
    return docs.select("id", "text").mapInArrow(tidy(run, keeps=True), schema)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and running offset of recipes within their sorted partition."""
    pos = offset = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = offset + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), pa.array(np.arange(pos, pos + len(n))), batch.column("id"), pa.array(ends - n), *(batch.column(c) for c in ("n_tokens", "sizes", "digests", "root"))],
            ["part", "pos", "id", "offset", "n_tokens", "sizes", "digests", "root"],
        )
        pos += len(n)
        offset = int(ends[-1]) if len(n) else offset


#: Documents of a part under one inner node of its Merkle tree.
FAN_OUT = 1024


def _part_roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): SHA-256 over the nodes of runs of FAN_OUT documents, each over its documents' roots, in order."""
    node = F.sha2(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "root"))), F.unhex(F.lit("")), lambda done, x: F.concat(done, x["root"])), 256)
    nodes = recipes.groupBy("part", F.floor(F.col("pos") / FAN_OUT).alias("run")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), node.alias("node"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "node"))), lambda x: x["node"]), ""), 256)
    return nodes.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.unhex(whole).alias("root"))


def write_store(docs: DataFrame, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n_ids: int = 1 << 16) -> TokenStore:
    """Encode whole texts with the tokenizers library and write a store of their ids.

    Words cut at ASCII white space and borders of letters, where the file's own
    pre-tokenizer cuts too, are encoded once each. A null or empty text is the
    end id alone. Repeated rows and ids stay as documents of their own, ordered
    by id (nulls first), then length and content. ``n_ids`` bounds the ids: up
    to 65536, an id takes two bytes. Other columns are not read.

    Chunk payloads are shuffled once, after each task dropped its own repeats;
    a chunk that a third of all documents share is a row per task. Recipes are
    sorted by range of (id, length, content), so one id may fill many parts.
    """
    spark = docs.sparkSession
    width = 2 if n_ids <= 1 << 16 else 4
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    store = TokenStore(spark, scratch.uri, width, docs.schema["id"].dataType)
    encoded = scratch.table(_encode(docs, tokenizer, width), "encoded")

    # a task has put each of its chunks out once: a map-side combine would sort payloads for nothing
    chunks = encoded.filter("ids is not null").select(F.col("digests").alias("digest"), "ids").repartition("digest")
    scratch.table(chunks.groupBy("digest").agg(F.first("ids").alias("ids")), "chunks")
    order = ["id", "n_tokens", "digests"]
    ranged = encoded.filter("ids is null").select("id", "n_tokens", "sizes", "digests", "root").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(_place), _recipe_schema(store.id_type))
    recipes = scratch.table(placed, "recipes")
    scratch.drop("encoded")

    # one row per part from here on
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    scratch.table(_part_roots(recipes).select("part", base.alias("base"), "n_docs", "n_tokens", "root"), "manifest")
    return store


class StoreDamaged(ValueError):
    """A chunk, a recipe or a length does not agree with its digest."""


@lru_cache(maxsize=1)
def _crc_tables() -> np.ndarray:
    """[k, byte, value]: effect on a CRC-32 of 2**k 32-bit zero words, by the CRC's bytes."""
    import zlib

    def linear(images: np.ndarray) -> np.ndarray:
        table = np.zeros((4, 256), np.uint32)
        for b in range(32):
            byte, bit = divmod(b, 8)
            table[byte] ^= np.where(np.arange(256) >> bit & 1, images[b], np.uint32(0)).astype(np.uint32)
        return table

    # zlib's CRC is affine in its start value; the linear part moves a CRC over four zero bytes
    images = np.array([zlib.crc32(bytes(4), 1 << b) ^ zlib.crc32(bytes(4), 0) for b in range(32)], np.uint32)
    out = [linear(images)]
    for _ in range(40):
        images = _shift_once(out[-1], images)
        out.append(linear(images))
    return np.stack(out)


def _shift_once(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shift_crc(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """CRC-32 values moved over that many following 32-bit words.

    The CRC of a concatenation is the exclusive or of the parts' CRCs, each
    moved over what follows it.
    """
    crc, tables = crc.astype(np.uint32), _crc_tables()
    for k in range(int(words.max()).bit_length() if len(words) else 0):
        moved = np.flatnonzero(words >> k & 1)
        crc[moved] = _shift_once(tables[k], crc[moved])
    return crc


def _chunk_facts(width: int):
    """(digest, n, crc) of stored chunks whose content agrees with their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            sizes, crcs = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest_of(data) != key:
                    raise StoreDamaged(f"chunk {key.hex()}")
                ids = np.frombuffer(data, f"<u{width}")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return run


def _recipe_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, pos, digest, n, after) per chunk of verified recipes; ``after`` counts the ids behind it."""
    for batch in batches:
        lines, digests = [], []
        for sizes, d, root, total in zip(*(batch.column(c).to_pylist() for c in ("sizes", "digests", "root", "n_tokens"))):
            own = [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]
            n = np.frombuffer(sizes, "<u4").astype(np.int64)
            if merkle_root(own) != root or n.sum() != total or len(n) != len(own):
                raise StoreDamaged(f"recipe {root.hex()}")
            digests += own
            lines.append(n)
        counts = np.array([len(x) for x in lines])
        n = np.concatenate(lines) if lines else np.empty(0, np.int64)
        ends = np.cumsum(n)
        last = np.repeat(ends[np.cumsum(counts) - 1], counts) if len(n) else ends
        spread = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("part", "pos")]
        yield pa.RecordBatch.from_arrays([pa.array(spread[0], pa.int32()), pa.array(spread[1], pa.int64()), pa.array(digests, pa.binary()), pa.array(n), pa.array(last - ends)], ["part", "pos", "digest", "n", "after"])


def _lines(recipes: DataFrame) -> DataFrame:
    return recipes.select("part", "pos", "sizes", "digests", "root", "n_tokens").mapInArrow(tidy(_recipe_lines), "part int, pos long, digest binary, n long, after long")


def verify_parts(store: TokenStore) -> None:
    """Raise StoreDamaged unless the recipes of every part have the root, number and length that the manifest says."""
    told = store.manifest().select("part", F.struct("n_docs", "n_tokens", "root").alias("told"))
    met = _part_roots(store.recipes()).select("part", F.struct("n_docs", "n_tokens", "root").alias("met")).join(told, "part", "full")
    for row in met.filter(~F.col("told").eqNullSafe(F.col("met"))).limit(1).collect():
        raise StoreDamaged(f"part {row['part']}")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = shift_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("n"), pa.array(crc.astype(np.int64))], ["part", "pos", "n", "crc"])


def read_digests(store: TokenStore, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files.

    Every part is checked against its root in the manifest, every recipe
    against its own root and every chunk against its digest. A document's CRC
    is the exclusive or of its chunks' CRCs, each moved over the ids behind it,
    so ids themselves are not shuffled again. A missing chunk or a wrong length
    leaves a null, which raises.
    """
    verify_parts(store)
    facts = scratch.table(store.chunks().mapInArrow(tidy(_chunk_facts(store.width)), "digest binary, n long, crc long"), "facts")
    lines = _lines(store.recipes())
    # never broadcast: both sides grow with the documents, and a stage of two Python workers a task takes twice the memory
    met = lines.join(facts.hint("merge"), ["digest", "n"]).select("part", "pos", "n", "crc", "after")
    whole = met.mapInArrow(tidy(_moved), "part int, pos long, n long, crc long").groupBy("part", "pos").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    recipes = store.recipes().select("part", "pos", "id", "offset", "n_tokens")
    agreed = F.when(F.col("n") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("chunks missing of document "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    out = recipes.join(whole, ["part", "pos"], "left").join(F.broadcast(store.manifest().select("part", "base")), "part")
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", agreed.cast("long").alias("ids_crc32"))


def reconstruct(store: TokenStore, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids)``: the id streams (little-endian, 4 bytes each) of the documents in ``ids``, of all if None."""
    recipes = store.recipes()
    if ids is not None:
        recipes = recipes.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    pieces = _lines(recipes).join(store.chunks().withColumnRenamed("ids", "piece").hint("merge"), "digest").groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct(F.expr("-after").alias("at"), "piece"))).alias("pieces"))

    width = store.width

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(b"".join(p["piece"] for p in row), f"<u{width}").astype("<u4").tobytes() for row in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), pa.array(out, pa.binary())], ["part", "pos", "ids"])

    whole = pieces.mapInArrow(tidy(join_pieces), "part int, pos long, ids binary")
    return recipes.select("part", "pos", F.col("id").alias(id_col)).join(whole, ["part", "pos"]).select(id_col, "ids")
