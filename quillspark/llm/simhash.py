"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has two 32-bit segments. Of two fingerprints at most three bits
apart, one segment differs in at most one bit. So every fingerprint is entered
in a table under both segments, and probes the table with the 33 keys of the
Hamming ball of radius one around each of its own segments; what a probe finds
is verified over all 64 bits.

Work is on distinct fingerprints: exact copies, however many, are one entry.
Buckets with more than ``HOT_BUCKET`` fingerprints are cut into blocks that are
compared pairwise, a block pair to a task group, and put out only a spanning
forest of the links they hold, so that no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, forest
from .memory import tidy
from .scratch import Scratch
from .wordstream import text_slices

MAX_BITS = 3
HOT_BUCKET = 64
BLOCK = 1024


def shingle_hashes(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all word shingles of the texts, end to end, and how many each text has.

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased, joined
    by one space. Fewer words than ``width`` make one shingle, none make none.
    """
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    borders = split.offsets.to_numpy()
    words = split.values.slice(borders[0], borders[-1] - borders[0])
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    full = sizes > 0
    borders = np.concatenate(([0], np.cumsum(full)))[borders - borders[0]]
    words, sizes = words.filter(pa.array(full)), sizes[full].astype(np.int64)
    n_words = np.diff(borders)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), words), " ")
    spread = np.concatenate(([0], np.cumsum(sizes + 1)))
    offsets = np.frombuffer(joined.buffers()[1], np.int32).astype(np.int64)[joined.offset : joined.offset + len(joined) + 1]
    starts = spread[:-1] + np.repeat(offsets[:-1] - spread[borders[:-1]], n_words)
    ends = starts + sizes
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.repeat(borders[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = first + np.repeat(np.minimum(n_words, width) - 1, n)
    data = joined.buffers()[2].to_pybytes() if len(words) else b""
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[first].tolist(), ends[last].tolist())
    return np.fromiter((digest(data[a:b], 42) for a, b in spans), np.uint64, len(first)), n


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per text: the bits set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        half = counts[some]
        own = np.zeros(len(some), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            own |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
        out[some] = own
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: the fingerprint of each whole text as a signed 64-bit value; 0 for null or wordless texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                fp = majority_bits(*shingle_hashes(batch.column(1).slice(a, b - a), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def _keys(fp: str, flips: list[int]) -> F.Column:
    """Table keys of both segments of a fingerprint, each with every mask of ``flips``."""
    segments = [f"({fp} & 4294967295L)", f"shiftrightunsigned({fp}, 32)"]
    keys = [f"(({segment} ^ {flip}L) * 2 + {k})" for k, segment in enumerate(segments) for flip in flips]
    return F.expr(f"array({', '.join(keys)})")


def _block_links(rows: "pa.Table") -> "pa.Table":
    """Star edges of the links between the probes and the entries of one block pair."""
    fp, entry = rows["fp"].to_numpy(), rows["entry"].to_numpy(zero_copy_only=False)
    probes, entries = np.unique(fp[~entry]), np.unique(fp[entry])
    near = np.bitwise_count((probes[:, None] ^ entries[None, :]).view(np.uint64)) <= MAX_BITS
    i, j = np.nonzero(near)
    apart = probes[i] != entries[j]
    u, v = forest(probes[i[apart]], entries[j[apart]])
    return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})


def near_links(distinct: DataFrame, scratch: Scratch, hot_bucket: int = HOT_BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, with the components of all links at most MAX_BITS apart.

    Links in ordinary buckets are all there; those of a hot bucket as a forest.
    """
    masks = [0, *(1 << i for i in range(32))]
    table = distinct.select("fp", F.explode(_keys("fp", [0])).alias("key"))
    hot = scratch.table(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_bucket), "hot")
    any_hot = not hot.isEmpty()
    probes = distinct.select(F.col("fp").alias("a"), F.explode(_keys("fp", masks)).alias("key"))
    cool = table.join(hot, "key", "left_anti") if any_hot else table
    verified = (F.col("a") < F.col("fp")) & (F.bit_count(F.expr("a ^ fp")) <= MAX_BITS)
    links = probes.join(cool.hint("shuffle_hash"), "key").filter(verified).select("a", F.col("fp").alias("b"))
    if not any_hot:
        return links
    met = scratch.table(probes.join(hot, "key").select("key", F.col("a").alias("fp"), "n"), "met")
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / block).alias("i_of"), F.ceil(F.first("n") / block).alias("j_of"))
    spread = F.xxhash64("fp", F.lit(7))
    asking = met.join(sizes, "key").select("key", "fp", F.lit(False).alias("entry"), F.pmod(spread, "i_of").alias("i"), F.explode(F.expr("sequence(0L, j_of - 1)")).alias("j"))
    entered = table.join(sizes, "key").select("key", "fp", F.lit(True).alias("entry"), F.explode(F.expr("sequence(0L, i_of - 1)")).alias("i"), F.pmod(spread, "j_of").alias("j"))
    # written, so that what reads the links has one Python worker a task, not two
    return links.union(scratch.table(asking.union(entered).groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long"), "hot-links"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` of every document.

    Two documents are linked if their fingerprints differ in at most three
    bits; component_id is the smallest id reachable by links, the own one
    included. Null, empty and wordless texts have fingerprint 0 and link like
    any others. Rows with a null id take part and get their component's
    smallest id, null if there is none; repeated rows each get a row. Columns
    other than id and text are not read.
    """
    fps = scratch.table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    per_fp = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    links = near_links(scratch.table(fps.select("fp").distinct(), "distinct"), scratch)
    roots = connected_components(links, scratch).withColumnRenamed("node", "fp")
    rooted = per_fp.join(roots, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")
