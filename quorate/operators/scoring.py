"""Answers against expected ones, accuracy, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.numeric import round_1


def join_expected(answers: DataFrame, expected: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Add expected and correct; of expected rows that repeat a key the last in ``order`` counts, and
    correct is null where nothing is expected."""
    truth = expected
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        truth = expected.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn", order)
    return answers.join(truth.withColumnRenamed("answer", "expected"), key, "left").withColumn("correct", F.col("answer") == F.col("expected"))


def count_correct(answers: DataFrame, expected: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(correct): how many answers equal what is expected of their key, which is the last row in
    ``order`` where a key is repeated; see ``join_expected``."""
    return join_expected(answers, expected, key, order).agg(F.count_if("correct").alias("correct"))


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """One row; accuracy counts unlabelled problems as attempted, and is null without any label."""
    labelled = F.count("expected")
    return scored.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("correct")).alias("correct"),
        F.when(labelled > 0, F.count_if(F.col("correct")) / F.count("*")).alias("accuracy"),
        F.when(labelled > 0, F.count_if(F.col("correct")) / labelled).alias("accuracy_labelled"),
        F.sum("time_s").alias("total_time_s"),
    )


def throughput_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Generated tokens and tokens a second, and with the prompt's where there is one."""
    tokens, prompt, seconds = F.sum("generated_tokens"), F.sum("prompt_tokens"), F.sum("elapsed_s")
    return runs.groupBy(*keys).agg(
        tokens.alias("generated"),
        F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0)).alias("tokens_per_s"),
        F.when((prompt > 0) & (seconds > 0), (tokens + prompt) / seconds).alias("overall_per_s"),
    )


def score_record(scored: DataFrame, settings: dict, problems_total: int | None = None) -> DataFrame:
    """One row as a run's summary has it: the settings, problems_attempted, problems_total, correct and
    accuracy (null without any label), total_time_s to one decimal."""
    found = accuracy_summary(scored)
    labelled = F.col("accuracy").isNotNull()
    return found.select(
        *(F.lit(v).alias(k) for k, v in settings.items()),
        F.col("attempted").alias("problems_attempted"),
        (F.col("attempted") if problems_total is None else F.lit(problems_total).cast("long")).alias("problems_total"),
        F.when(labelled, F.col("correct")).alias("correct"),
        "accuracy",
        round_1(F.coalesce("total_time_s", F.lit(0.0))).alias("total_time_s"),
    )
