"""Run-log analytics: flips, thresholds, gates, weights and combinations of runs.

Facts are rows (run_id, question_no, answer, correct_answer, is_correct, score,
bm25_rank, splade_rank, bm25_score, splade_score).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flips(facts: DataFrame, base_run: int) -> DataFrame:
    """Per run and kind of flip against the base run: questions, mean scores and mean ranks."""
    base = facts.filter(F.col("run_id") == base_run).select("question_no", F.col("is_correct").alias("base_correct"))
    kind = F.when(~F.col("base_correct") & F.col("is_correct"), "wrong_to_right").when(F.col("base_correct") & ~F.col("is_correct"), "right_to_wrong").when(F.col("is_correct"), "right").otherwise("wrong")
    joined = facts.filter(F.col("run_id") != base_run).join(base, "question_no").withColumn("flip", kind)
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("score", "bm25_rank", "splade_rank", "bm25_score", "splade_score")]
    return joined.groupBy("run_id", "flip").agg(F.count("*").alias("n"), *means)


def grid(points: int) -> Column:
    """Array of evenly spaced values from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i.cast("double") / (points - 1))


def threshold_sweep(facts: DataFrame, with_run: int, base_run: int, points: int = 101) -> DataFrame:
    """(threshold, n_used, accuracy) when answers with a score over the threshold replace the base run's.

    Scores are counted per distinct value first, so the grid multiplies
    distinct scores, not questions.
    """
    base = facts.filter(F.col("run_id") == base_run).select("question_no", F.col("is_correct").cast("long").alias("b"))
    used = facts.filter(F.col("run_id") == with_run).select("question_no", "score", F.col("is_correct").cast("long").alias("r"))
    values = used.join(base, "question_no").groupBy("score").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("b").alias("b"))
    at = values.withColumn("threshold", F.explode(grid(points)))
    over = F.col("score") > F.col("threshold")
    return at.groupBy("threshold").agg(F.sum(F.when(over, F.col("n")).otherwise(0)).alias("n_used"), F.round(F.sum(F.when(over, F.col("r")).otherwise(F.col("b"))) / F.sum("n"), 6).alias("accuracy"))


def best(sweep: DataFrame, value: str = "accuracy", ties: str = "threshold") -> DataFrame:
    """The row with the greatest value, the smallest ``ties`` among equals."""
    return sweep.orderBy(F.desc(value), ties).limit(1)


def multi_doc_threshold(facts: DataFrame, threshold: float, max_docs: int, base_run: int = 0) -> DataFrame:
    """(question_no, n_docs, is_correct): run n answers where the first n scores reach the threshold, the base run for 0.

    Runs base_run + 1, ... use the 1, 2, ... best documents.
    """
    place = F.col("run_id") - base_run
    low = F.min(F.when((place > 0) & (F.col("score") < threshold), place))
    n = F.least(F.coalesce(low - 1, F.lit(max_docs)), F.lit(max_docs))
    chosen = facts.filter(place.between(0, max_docs)).groupBy("question_no").agg(n.alias("n_docs"))
    return chosen.join(facts.select("question_no", place.alias("n_docs"), "is_correct"), ["question_no", "n_docs"])


def local_ranks(facts: DataFrame) -> DataFrame:
    """Ranks of each question's runs among each other, and the score's lead over the next run."""
    per = Window.partitionBy("question_no")
    return facts.withColumns(
        {
            "bm25_local": F.row_number().over(per.orderBy("bm25_rank", "run_id")),
            "splade_local": F.row_number().over(per.orderBy("splade_rank", "run_id")),
            "lead": F.col("score") - F.lead("score").over(per.orderBy("run_id")),
        }
    )


def rank_gate(facts: DataFrame, base_run: int = 0) -> DataFrame:
    """(branch, n, n_correct): the first run if it stands out, else the second if it does, else the base run."""
    ranked = local_ranks(facts.filter(F.col("run_id") != base_run))

    def stands_out(run: int, rank: int, score: float, lead: float) -> Column:
        ok = (F.col("bm25_local") <= rank) & (F.col("splade_local") <= rank) & (F.col("score") > score) & (F.col("lead") > lead)
        return F.max(F.when(F.col("run_id") == base_run + run, ok))

    right = [F.max(F.when(F.col("run_id") == base_run + run, F.col("is_correct"))).alias(f"right_{run}") for run in (1, 2)]
    per_question = ranked.groupBy("question_no").agg(stands_out(1, 5, 0.8, 0.15).alias("first"), stands_out(2, 1, 0.0, 0.0).alias("second"), *right)
    base = facts.filter(F.col("run_id") == base_run).select("question_no", F.col("is_correct").alias("right_0"))
    joined = per_question.join(base, "question_no")
    branch = F.when(F.col("first"), "run_1").when(F.col("second"), "run_2").otherwise("base")
    correct = F.when(branch == "run_1", F.col("right_1")).when(branch == "run_2", F.col("right_2")).otherwise(F.col("right_0"))
    return joined.groupBy(branch.alias("branch")).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("n_correct"))


def min_max(facts: DataFrame, column: str, *by: str) -> DataFrame:
    """``facts`` with ``<column>_scaled``: 0 for the least value of its group, 1 for the greatest, 0 where all are equal."""
    per = Window.partitionBy(*by)
    low, high = F.min(column).over(per), F.max(column).over(per)
    return facts.withColumn(f"{column}_scaled", F.round(F.coalesce((F.col(column) - low) / F.nullif((high - low).cast("double"), F.lit(0.0)), F.lit(0.0)), 9))


def weighted_choice(facts: DataFrame, weights: list[tuple[float, float, float]], base_run: int = 0) -> DataFrame:
    """(w_bm25, w_splade, w_score, accuracy) when the run with the greatest weighted score answers; the first run on ties.

    A question's runs, few and known by their ids, are columns of one row, which
    meets the weights without a shuffle; each task then hands on one row per
    weights.
    """
    used = facts.filter(F.col("run_id") != base_run)
    runs = [r[0] for r in used.select("run_id").distinct().orderBy("run_id").collect()]
    if not runs:
        return facts.sparkSession.createDataFrame([], "w_bm25 double, w_splade double, w_score double, accuracy double")
    own = F.struct("bm25_score", "splade_score", "score", F.col("is_correct").cast("double").alias("right"))
    per = used.groupBy("question_no").agg(*(F.max(F.when(F.col("run_id") == r, own)).alias(f"run{i}") for i, r in enumerate(runs)))
    # the grid is a parameter, so the product is questions times a fixed number
    tries = facts.sparkSession.createDataFrame([tuple(map(float, w)) for w in weights], "w_bm25 double, w_splade double, w_score double")
    tried = per.crossJoin(F.broadcast(tries))
    blends = [F.round(0.01 * F.col(f"run{i}.bm25_score") * F.col("w_bm25") + 0.01 * F.col(f"run{i}.splade_score") * F.col("w_splade") + F.col(f"run{i}.score") * F.col("w_score"), 9).alias(f"s{i}") for i in range(len(runs))]
    blended = tried.select("w_bm25", "w_splade", "w_score", *blends, *(F.col(f"run{i}.right").alias(f"right{i}") for i in range(len(runs))))
    most = F.greatest(*(f"s{i}" for i in range(len(runs)))) if len(runs) > 1 else F.col("s0")
    right = F.coalesce(*(F.when(F.col(f"s{i}") == most, F.col(f"right{i}")) for i in range(len(runs))))
    return blended.groupBy("w_bm25", "w_splade", "w_score").agg(F.round(F.avg(right), 6).alias("accuracy"))


def vote_combinations(facts: DataFrame, runs: list[int], size: int) -> DataFrame:
    """(combo, accuracy): majority vote of every combination of so many runs, ties to the first seen.

    A question's answers are one row; the list of combinations is a literal,
    so the work is questions times combinations without a shuffle of either.
    """
    per = facts.filter(F.col("run_id").isin(*runs)).groupBy("question_no").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "answer"))).alias("answers"), F.max("correct_answer").alias("correct_answer"))
    tries = F.array(*[F.array(*(F.lit(r) for r in c)) for c in combinations(sorted(runs), size)])
    votes = per.withColumn("combo", F.explode(tries)).withColumn("votes", F.transform("combo", lambda r: F.element_at("answers", r)))
    counted = F.transform("votes", lambda v, i: F.struct((-F.size(F.filter("votes", lambda w: w == v))).alias("n"), i.alias("i"), v.alias("v")))
    right = F.element_at(F.array_sort(counted), 1)["v"] == F.col("correct_answer")
    named = votes.select(F.concat_ws("-", F.transform("combo", lambda r: r.cast("string"))).alias("combo"), right.cast("double").alias("right"))
    return named.groupBy("combo").agg(F.round(F.avg("right"), 6).alias("accuracy"))
