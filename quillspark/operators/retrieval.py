"""Multi-stage retrieval: re-ranking stages, thresholds, rank fusion and gates.

Candidates are rows (query_id, doc_id, score, rank). A scorer is a DataFrame
(query_id, doc_id, score): model scores come in as a table or a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import SCALE


@dataclass(frozen=True)
class Stage:
    """A re-ranking stage: its scores, how many it keeps, and a threshold on the score."""

    name: str
    scores: DataFrame
    keep: int
    threshold: float | None = None
    strict: bool = True


def rerank(candidates: DataFrame, scores: DataFrame, keep: int | None = None) -> DataFrame:
    """Candidates ordered by new scores; equal ones, and those without a score (last), keep their order."""
    joined = candidates.select("query_id", "doc_id", F.col("rank").alias("before")).join(scores, ["query_id", "doc_id"], "left")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "before")))
    return ranked.drop("before") if keep is None else ranked.filter(F.col("rank") <= keep).drop("before")


def over_threshold(ranked: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """Rows above the threshold, at it too if not strict; ranks keep their gaps."""
    return ranked.filter(F.col("score") > threshold if strict else F.col("score") >= threshold)


def cascade(candidates: DataFrame, stages: list[Stage]) -> DataFrame:
    """Each stage re-ranks and cuts what the one before it left; a stage that keeps 0 is skipped."""
    for stage in stages:
        if stage.keep > 0:
            candidates = rerank(candidates, stage.scores, stage.keep)
            if stage.threshold is not None:
                candidates = over_threshold(candidates, stage.threshold, stage.strict)
    return candidates


def fuse(ranked: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of rows (query_id, doc_id, stage, rank); stages without a weight are left out."""
    weight = F.lit(None).cast("double")
    for stage, w in weights.items():
        weight = F.when(F.col("stage") == stage, F.lit(float(w))).otherwise(weight)
    part = weight / (F.lit(float(k)) + F.col("rank"))
    fused = ranked.filter(F.col("stage").isin(*weights)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def fuse_surviving(surviving: DataFrame, ranked: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """The surviving list (query_id, doc_id, rank) put in the order of the fusion of its documents' ranks in the stages.

    A document has, for each stage that ranked it, weight / (k + rank); ranks
    are those that the stages gave. Equal sums keep the list's order.
    """
    fused = fuse(ranked.join(surviving.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), weights, k)
    return rerank(surviving, fused.select("query_id", "doc_id", "score"))


def best_only(ranked: DataFrame) -> DataFrame:
    """Each query's first document."""
    return ranked.filter(F.col("rank") == 1)


def stage_texts(questions: DataFrame, choices: str = "choices") -> DataFrame:
    """(query_id, question, question_and_choices): what first and sparse and dense stages ask, and what cross-encoders and list rankers do."""
    return questions.select("query_id", F.col("text").alias("question"), F.concat(F.col("text"), F.lit("\n"), F.col(choices)).alias("question_and_choices"))


def nth(ranked: DataFrame, n: int) -> DataFrame:
    """The document in place n, counted from 0; no row where there is none."""
    return ranked.filter(F.col("rank") == n + 1)


def pairwise(candidates: DataFrame, strength: str = "strength") -> DataFrame:
    """Re-rank by the sum of preferences over the other candidates of the query.

    A preference is strength over the sum of both strengths, one half where
    both are 0. Candidate lists are short (a few dozen of a query), so pairs
    are made within one query's list only.
    """
    a, b = candidates.alias("a"), candidates.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.doc_id") != F.col("b.doc_id")), "left")
    x, y = F.col(f"a.{strength}"), F.col(f"b.{strength}")
    won = F.when(y.isNull(), 0.0).when(x + y == 0, 0.5).otherwise(x / (x + y))
    scored = pairs.groupBy(F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("doc_id"), F.col("a.rank").alias("before")).agg(F.round(F.sum(won), SCALE).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before"))).drop("before")


def listwise(candidates: DataFrame, permute, window: int = 3) -> DataFrame:
    """Re-rank each query's list by a function (query_id, doc_ids) -> permutation, in windows from the end to the front."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows.sort_values("rank")["doc_id"].tolist()
        step = max(1, window // 2)
        for start in range(max(0, len(docs) - window), -step, -step):
            start = max(0, start)
            part = docs[start : start + window]
            docs[start : start + window] = [part[i] for i in permute(key[0], part)]
        return pd.DataFrame({"query_id": key[0], "doc_id": docs, "rank": range(1, len(docs) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank int")


def gate(candidates: DataFrame, useful: str = "useful", confidence: str = "confidence") -> DataFrame:
    """Of each query's useful documents the one with the greatest confidence, the first on ties; perhaps none."""
    best = F.max_by("doc_id", F.struct(F.col(confidence).alias("c"), (-F.col("rank")).alias("r")))
    return candidates.filter(useful).groupBy("query_id").agg(best.alias("doc_id"), F.max(confidence).alias("confidence"))


def concat_context(ranked: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, context): the documents' texts in rank order, each followed by an empty line."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["text"], F.lit("\n\n"))), "").alias("context"))


def score_pairs(candidates: DataFrame, queries: DataFrame, docs: DataFrame, model) -> DataFrame:
    """(query_id, doc_id, score) by a model: a function that takes lists of query and document texts and returns scores.

    ``model`` is a factory that a task calls once, so weights are loaded once
    per task; texts go to it by Arrow batch. ``queries`` is (query_id, query)
    and ``docs`` (doc_id, text).
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for query, text in batches:
            yield pd.Series(score(query.tolist(), text.tolist()), dtype="float64")

    pairs = candidates.select("query_id", "doc_id").join(queries, "query_id").join(docs, "doc_id")
    return pairs.select("query_id", "doc_id", scored("query", "text").alias("score"))
