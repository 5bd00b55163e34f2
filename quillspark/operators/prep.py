"""Preparation of training examples: chat text, balance, splits, contamination, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import byte_sentences, byte_tokens, tokens
from quillspark.shared import written

ROLE_NAMES = {"human": "user", "gpt": "assistant"}


def chat_text(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(conv_id, chat): turns in order as ``<|role|>\\ntext<|end|>\\n``; roles human and gpt are renamed."""
    role = F.col("role")
    for old, new in ROLE_NAMES.items():
        role = F.when(F.col("role") == old, new).otherwise(role)
    rows = turns.select(by, "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = F.transform(listed, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return rows.groupBy(by).agg(F.array_join(line, "").alias("chat"))


def balance(df: DataFrame, label: str, order: str) -> DataFrame:
    """All rows labelled 0 and as many of those labelled 1, the first by ``order`` (nulls first)."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n_false"))
    placed, _ = positions(df.filter(F.col(label) == 1), order)
    first = placed.crossJoin(F.broadcast(n)).filter(F.col("place") <= F.col("n_false")).drop("place", "n_false")
    return df.filter(F.col(label) == 0).unionByName(first)


def hash_key(column: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """``split`` is train, valid or test, in these shares within each label, by a seeded hash of the key.

    Rows are placed in the order of label and hash over the whole table, so a
    label with half of all rows is no task of its own; where each label begins
    is one row per label. A null label is a label.
    """
    placed, _ = positions(df.withColumn("_hash", hash_key(F.col(key), seed)), label, "_hash", key)
    sizes = placed.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    joined = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    place, n = F.col("place") - F.col("_first") + 1, F.col("_n")
    split = F.when(place <= F.floor(n * F.lit(train) + 1e-9), "train").when(place <= F.floor(n * F.lit(train + valid) + 1e-9), "valid").otherwise("test")
    return joined.select(*df.columns, split.alias("split"))


def positions(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with each row's ``place`` from 1 in ``order`` (nulls first), and the number of rows; no task orders all rows.

    Rows are range-partitioned, numbered within their partition and written
    once: a second run might draw other borders or join partitions. A row's
    place is its number plus the sizes of the partitions before it, one number
    per partition. Rows that ``order`` does not tell apart go either way.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    spread = written(spread.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "places")
    before, at = [], 0
    for part, n in sorted(map(tuple, spread.groupBy("_part").count().collect())):
        before.append((part, at))
        at += n
    bases = df.sparkSession.createDataFrame(before, "_part int, _base long")
    return spread.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_place") + F.col("_base") + 1).alias("place")), at


def sequential_split(df: DataFrame, order: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """``split`` by position in ``order``."""
    placed, total = positions(df, order)
    place = F.col("place")
    split = F.when(place <= int(total * train + 1e-9), "train").when(place <= int(total * (train + valid) + 1e-9), "valid").otherwise("test")
    return placed.withColumn("split", split).drop("place")


def row_range(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1 in ``order``, counted from 0."""
    placed, _ = positions(df, order)
    return placed.filter(F.col("place").between(start + 1, stop)).drop("place")


def drop_incomplete(df: DataFrame, docs: str, order: str) -> DataFrame:
    """All rows but the last in ``order`` if that has no documents."""
    last = df.orderBy(F.desc(order)).limit(1).filter((F.size(docs) <= 0) | F.col(docs).isNull()).select(order)
    return df.join(last, order, "left_anti")


def training_lines(ranked: DataFrame, text: str = "source") -> DataFrame:
    """(item_id, position, doc_id, line): a question's documents as lines of a context-training log."""
    line = F.concat(F.lit("[question index:]"), F.col("query_id").cast("string"), F.lit("\n[rag_doc:]"), (F.col("rank") - 1).cast("string"), F.lit(":"), F.col(text))
    return ranked.select(F.col("query_id").alias("item_id"), (F.col("rank") - 1).alias("position"), "doc_id", line.alias("line"))


def document_sets(ranked: DataFrame, sets: list[list[int]]) -> DataFrame:
    """(query_id, variant, docs): for each set of ranks, the ids of the documents that have them."""
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d"))
    picks = F.array(*[F.struct(F.lit(i).alias("variant"), F.array(*map(F.lit, s)).cast("array<int>").alias("ranks")) for i, s in enumerate(sets)])
    each = listed.withColumn("p", F.explode(picks))
    docs = F.transform(F.filter("d", lambda x: F.array_contains(F.col("p.ranks"), x["rank"])), lambda x: x["doc_id"].cast("string"))
    return each.select("query_id", F.col("p.variant").alias("variant"), F.array_join(docs, ",").alias("docs"))


def contaminated_prefix(test: DataFrame, train: DataFrame, prefix: int, text: str = "text") -> DataFrame:
    """Test rows whose first characters begin a train row too, with how many train rows that is."""
    heads = train.select(F.substring(text, 1, prefix).alias("head")).groupBy("head").agg(F.count("*").alias("n_matches"))
    return test.withColumn("head", F.substring(text, 1, prefix)).join(heads, "head").drop("head")


def contaminated_passage(items: DataFrame, docs: DataFrame, prefix: int | None = None, id_col: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, n_docs): in how many documents the text of an item (its first ``prefix`` characters) occurs anywhere.

    Passages are looked up by as many of their first words, five at most, from
    the second on (a document may run into the first and the last): document
    word n-grams of these lengths, without the texts, meet the items' in a hash
    join, and only the documents hit are compared as text. Only items of two
    words or fewer have no such word; they are compared with all documents.
    """
    words = 5
    whole = F.col(text) if prefix is None else F.substring(text, 1, prefix)
    keyed = items.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("item"), whole.alias("head"))
    size = F.least(F.size(tokens(F.col("head"))) - 2, F.lit(words))
    keyed = keyed.withColumn("size", size).withColumn("gram", F.when(F.col("size") > 0, F.array_join(F.slice(tokens(F.col("head")), F.lit(2), F.col("size")), " ")))
    every_size = [r[0] for r in keyed.select("size").distinct().collect()]
    sizes = [n for n in every_size if n > 0]
    bodies = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    split = bodies.select("doc", tokens(F.col("body")).alias("t"))

    def grams(n: int) -> Column:
        return F.expr(f"transform(sequence(1, greatest(size(t) - {n} + 1, 1)), i -> array_join(slice(t, i, {n}), ' '))")

    found = keyed.limit(0).select("item", F.col("item").alias("doc")) if not every_size else None
    if len(sizes) < len(every_size):
        found = bodies.join(keyed.filter("size <= 0"), F.contains("body", "head")).select("item", "doc")
    if sizes:
        exploded = split.select("doc", F.explode(F.array_distinct(F.concat(*map(grams, sizes)))).alias("gram"))
        hits = exploded.join(keyed.filter("size > 0"), "gram").select("doc", "item", "head").distinct()
        looked_up = hits.join(bodies, "doc").filter(F.contains("body", "head")).select("item", "doc")
        found = looked_up if found is None else found.union(looked_up)
    return found.groupBy(F.col("item").alias(id_col)).agg(F.count_distinct("doc").alias("n_docs"))


def context_variants(df: DataFrame, docs: str, counts: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """A row for each count n with the context of the first n documents."""
    n = df.withColumn("n_docs", F.explode(F.array(*map(F.lit, counts))))
    return n.withColumn("context", F.array_join(F.transform(F.slice(docs, F.lit(1), F.col("n_docs")), lambda d: F.concat(d, F.lit("\n\n"))), ""))


def _chunks(size: int, texts: bool):
    """(id, chunk_no, n_sentences, n_tokens), or (id, chunk_no, chunk), of (id, text): a pass over a document's sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows, nos, said, counts = [], [], [], []
            for row, text in enumerate(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()):
                before, last = 0, None
                for sentence in byte_sentences(text) if text else ():
                    n = len(byte_tokens(sentence))
                    if before // size != last:
                        last = before // size
                        rows.append(row)
                        nos.append(last)
                        said.append([])
                        counts.append(0)
                    said[-1].append(sentence if texts else None)
                    counts[-1] += n
                    before += n
            out = [ids.take(pa.array(rows, pa.int64())), pa.array(nos, pa.int64())]
            if texts:
                yield pa.RecordBatch.from_arrays([*out, pa.array([b" ".join(s) for s in said], pa.binary()).cast(pa.string())], ["id", "chunk_no", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([*out, pa.array(map(len, said), pa.int64()), pa.array(counts, pa.int64())], ["id", "chunk_no", "n_sentences", "n_tokens"])

    return run


def _chunked(docs: DataFrame, size: int, id_col: str, text_col: str, texts: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_chunks(size, texts), f"id {kind}, chunk_no long, " + ("chunk string" if texts else "n_sentences long, n_tokens long"))
    return found.withColumnRenamed("id", id_col)


def sentence_chunks(docs: DataFrame, size: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, n_sentences, n_tokens): sentences go to chunk floor(tokens before them / size).

    All within a document's row, no shuffle; time grows with the document's length.
    """
    return _chunked(docs, size, id_col, text_col, False)


def chunk_texts(docs: DataFrame, size: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk): the sentences of the chunks that ``sentence_chunks`` counts, joined by a space.

    All within a document's row; chunks come in order, numbers may leave gaps
    where a sentence alone is longer than ``size``.
    """
    return _chunked(docs, size, id_col, text_col, True)


def few_shot(df: DataFrame, n: int, seed: int, key: str, question: str, answer: str) -> DataFrame:
    """n examples by a seeded hash, each as ``## Question`` and ``## Answer`` sections."""
    picked = df.orderBy(hash_key(F.col(key), seed), key).limit(n)
    return picked.select(key, F.concat(F.lit("## Question: "), F.col(question), F.lit("\n## Answer: "), F.col(answer)).alias("example"))


def every_nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first of every n rows in ``order``."""
    placed, _ = positions(df, order)
    return placed.filter((F.col("place") - 1) % n == 0).drop("place")
