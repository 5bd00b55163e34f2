"""Answer evaluation: normalised questions, votes, accuracy and classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import INVALID

LETTERS = "ABCD"


def lettered(texts: Column) -> Column:
    """Array of (letter, text) of an array of option texts, lettered from A."""
    return F.transform(texts, lambda t, i: F.struct(F.char(i + 65).alias("letter"), t.alias("text")))


def normalise_flat(df: DataFrame, options: list[str], answer: str) -> DataFrame:
    """question, choices, answer_key of rows with an option per column and the answer's index; -1 is hidden (null)."""
    key = F.when(F.col(answer).between(0, len(options) - 1), F.char(F.col(answer) + 65))
    return df.withColumns({"choices": lettered(F.array(*options)), "answer_key": key})


def normalise_array(df: DataFrame, choices: str, answer: str) -> DataFrame:
    return df.withColumns({"choices": lettered(F.col(choices)), "answer_key": F.char(F.col(answer) + 65)})


def normalise_map(df: DataFrame, options: str, answer: str) -> DataFrame:
    """Options as a map from letter to text: put in the order of letters."""
    entries = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text"))))
    return df.withColumns({"choices": entries, "answer_key": F.col(answer)})


def normalise_yes_no(df: DataFrame, contexts: str, decision: str) -> DataFrame:
    """yes, no, maybe become A, B, C; contexts are joined by a line break."""
    key = F.when(F.col(decision) == "yes", "A").when(F.col(decision) == "no", "B").otherwise("C")
    return df.withColumns({"choices": lettered(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe"))), "answer_key": key, "context": F.array_join(contexts, "\n")})


def vote(answers: DataFrame, by: str = "question_no", answer: str = "answer", order: str = "run_id") -> DataFrame:
    """(by, answer, votes): the most frequent answer, the first seen on ties; invalid ones vote too."""
    counts = answers.groupBy(by, answer).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    winner = F.max_by(answer, F.struct("votes", (-F.col("first")).alias("early")))
    return counts.groupBy(by).agg(winner.alias(answer), F.max("votes").alias("votes"))


def accuracy(df: DataFrame, *by: str, correct: str = "is_correct") -> DataFrame:
    hits = F.sum(F.col(correct).cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("n_correct"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def run_summary(df: DataFrame, *by: str, correct: str = "is_correct", at: str = "ts") -> DataFrame:
    """Accuracy of each run, and the seconds from its first answer to its last."""
    hits = F.sum(F.col(correct).cast("long"))
    seconds = F.max(F.col(at).cast("double")) - F.min(F.col(at).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("n_correct"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"), F.round(seconds, 3).alias("seconds"))


def effective_accuracy(voted: DataFrame, truth: str = "correct_answer") -> DataFrame:
    """Accuracy over all and over those not voted invalid."""
    right = F.col("answer") == F.col(truth)
    return voted.agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.count_if(~right & (F.col("answer") == INVALID)).alias("n_invalid"),
        F.round(F.count_if(right) / F.nullif(F.count("*") - F.count_if(~right & (F.col("answer") == INVALID)), F.lit(0)), 6).alias("effective"),
    )


def confidence_interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and the 95 % interval mean +- 1.96 sd / sqrt(n), sd with n - 1."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"))


def classification_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("n_predicted"), F.sum("hit").alias("tp"))
    precision, recall = F.col("tp") / F.nullif(F.col("n_predicted"), F.lit(0)), F.col("tp") / F.nullif(F.col("support"), F.lit(0))
    f1 = 2.0 * F.col("tp") / F.nullif(F.col("n_predicted") + F.col("support"), F.lit(0))
    return sums.select("label", "support", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in (("precision", precision), ("recall", recall), ("f1", f1))))


def upper_bound(facts: DataFrame) -> DataFrame:
    """Share of questions that any run answers correctly."""
    return facts.groupBy("question_no").agg(F.bool_or("is_correct").alias("any")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("any").cast("double")), 6).alias("upper_bound"))


def accumulated_upper_bound(facts: DataFrame) -> DataFrame:
    """The same for the first 1, 2, ... runs."""
    upto = Window.partitionBy("question_no").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = facts.withColumn("any", F.max(F.col("is_correct").cast("int")).over(upto))
    return seen.groupBy("run_id").agg(F.round(F.avg(F.col("any").cast("double")), 6).alias("upper_bound"))


def runs_correct(facts: DataFrame) -> DataFrame:
    """Which runs are right about each question, as text in run order."""
    runs = F.array_sort(F.collect_list(F.when(F.col("is_correct"), F.col("run_id"))))
    return facts.groupBy("question_no").agg(F.concat_ws(",", F.transform(runs, lambda r: r.cast("string"))).alias("runs"), F.size(runs).cast("long").alias("n_right"))


def percentile_interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The interval between the 2.5th and the 97.5th percentile, interpolated."""
    return df.groupBy(*by).agg(F.round(F.percentile(value, 0.025), 6).alias("low"), F.round(F.percentile(value, 0.975), 6).alias("high"))


def split_answer_context(df: DataFrame, text: str) -> DataFrame:
    """answer and context of texts ``<answer> a <context> c``."""
    return df.withColumns({"answer": F.regexp_extract(text, r"(?s)^<answer> (.*) <context> ", 1), "context": F.regexp_extract(text, r"(?s) <context> (.*)$", 1)})
