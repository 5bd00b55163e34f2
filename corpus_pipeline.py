"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it again for the next stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, langid, latent, simhash
from quillspark.llm.queries import WORD_BPE, tokenizer_file
from quillspark.llm.scratch import Scratch, read_table

#: Documents whose likeliest language has a lower calibrated probability are rejected.
MIN_LANGUAGE_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text or letters, and those in no learned language.

    The model learns from the labelled rows that are not held out. Where
    nothing is labelled there is no model, and only documents without a letter
    go. Other rows stay as they are, repeated ones and null ids too.
    """
    labelled = docs.filter(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "lang", "text")
    model = langid.train(labelled, Scratch(spark, "pipeline-language"))
    columns = docs.columns
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # other columns go under names of our own: theirs may clash with the prediction's
    own = {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in columns))
    judged = langid.predict(plain, model, "doc_id", tuple(own[c] for c in columns if c != "doc_id"))
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*(F.col(own[c]).alias(c) for c in columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component, that with the smallest doc_id.

    Rows that share a doc_id are one document, of which one row stays, if any of
    them is the smallest of its component. Rows without doc_id cannot be told
    apart by id and stay.
    """
    groups = simhash.near_duplicates(docs, Scratch(spark, "pipeline-simhash"))
    smallest = F.bool_or(F.col("doc_id") == F.col("component_id"))
    ids = groups.filter("doc_id is not null").groupBy("doc_id").agg(smallest.alias("chosen"), F.count("*").alias("n"))
    ids = Scratch(spark, "pipeline-ids").table(ids.filter("not chosen or n > 1"), "ids")
    kept = docs.join(ids.filter("not chosen").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = ids.filter("chosen").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark; rows without doc_id stay.

    The ids are written first: few of them are broadcast by their known size,
    many are joined by a shuffle.
    """
    scratch = Scratch(spark, "pipeline-benchmark")
    found = latent.contaminated(docs, read_table(spark, sf_dir, "benchmark"), scratch)
    ids = scratch.table(found.select("doc_id").filter("doc_id is not null").distinct(), "found")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document left."""
    return bpe.coded_digests(docs, tokenizer_file(WORD_BPE))


STAGES = [("language_id", identify), ("simhash_dedup", deduplicate), ("decontamination", decontaminate), ("bpe_coding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents under ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


#: A learned model, random projections and byte-pair merges are beyond SQL;
#: the tests hold each stage against a brute-force version.
ORACLE_SQL = None
