"""Stand-ins: evaluation facts and responses that both engines can derive from the test tables.

There are no recorded model runs in the tables, so answers, scores and ranks
of five runs are arithmetic on the ids of ``labels``, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (0, 1, 2, 3, 4)
_COLUMNS = {
    "answer": "CASE WHEN (q + run_id * 13) % 17 = 0 THEN '[invalid]' WHEN (q * (run_id + 3) + run_id * 7) % 5 < 3 THEN substr('ABCD', cast((q * 11 + 3) % 4 AS int) + 1, 1) ELSE substr('ABCD', cast((q + run_id) % 4 AS int) + 1, 1) END",
    "correct_answer": "substr('ABCD', cast((q * 11 + 3) % 4 AS int) + 1, 1)",
    "score": "cast((q * 37 + run_id * 101) % 1000 AS double) / 1000",
    "bm25_rank": "cast((q * 13 + run_id * 29) % 150 + 1 AS int)",
    "splade_rank": "cast((q * 17 + run_id * 31) % 30 + 1 AS int)",
    "bm25_score": "cast((q * 53 + run_id * 71) % 500 AS double) / 10",
    "splade_score": "cast((q * 59 + run_id * 73) % 400 AS double) / 10",
}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (run_id, question_no, answer, correct_answer, is_correct, score, ranks, scores) for all labelled documents."""
    q = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("q"), F.explode(F.array(*map(F.lit, RUNS))).alias("run_id"))
    out = q.select("run_id", F.col("q").alias("question_no"), *(F.expr(e).alias(n) for n, e in _COLUMNS.items()))
    return out.withColumn("is_correct", F.col("answer") == F.col("correct_answer"))


FACTS_SQL = f"""f0 AS (SELECT run_id, doc_id AS q FROM labels, (SELECT unnest([0, 1, 2, 3, 4]) AS run_id)),
facts AS (SELECT *, answer = correct_answer AS is_correct FROM (SELECT run_id, q AS question_no, {", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items())} FROM f0))"""

#: Wordings of a response by the id's remainder.
_RESPONSES = [
    "'Therefore the answer is (' || l || ').'", "'The answer is: **[' || l || ']**'", "'Diagnosis (' || lower(l) || ') is likely'", "'I choose [' || l || '] over (A)'",
    "'no idea'", "'so $\\boxed{' || l || '}$ it is'", "'Answer: [' || l || '] done'", "'Options [A] and [' || l || ']'",
]
_LETTER = "substr('ABCD', cast(item_id % 4 AS int) + 1, 1)"


def _response(escape: bool) -> str:
    parts = [r.replace("\\", "\\\\") if escape else r for r in _RESPONSES]
    return "CASE cast(item_id % 8 AS int) " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, response) for every benchmark item."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.expr(_LETTER).alias("l")).select("item_id", F.expr(_response(True)).alias("response"))


RESPONSES_SQL = f"responses AS (SELECT item_id, {_response(False)} AS response FROM (SELECT item_id, {_LETTER} AS l FROM benchmark))"
