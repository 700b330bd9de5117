"""Votes over the attempts of a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_ranks(attempts: DataFrame, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """(problem, answer, votes, first_seq, rank): more votes first, then the answer seen first."""
    votes = attempts.where("answer is not null").groupBy(problem, "answer").agg(F.count("*").alias("votes"), F.min(order).alias("first_seq"))
    by = Window.partitionBy(problem).orderBy(F.desc("votes"), "first_seq")
    return votes.withColumn("rank", F.row_number().over(by))


def first_seen_rank(attempts: DataFrame, n: int, **options) -> DataFrame:
    return vote_ranks(attempts, **options).where(F.col("rank") <= n)


def majority_vote(attempts: DataFrame, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """(problem, answer, has_answer): 0 where no attempt has an answer."""
    top = vote_ranks(attempts, problem, order).where("rank = 1").select(problem, "answer")
    return attempts.select(problem).distinct().join(top, problem, "left").select(problem, F.coalesce("answer", F.lit(0)).alias("answer"), F.col("answer").isNotNull().alias("has_answer"))


def vote_histogram(attempts: DataFrame, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """(problem, answers, votes): answers in the order they were first seen, with their votes."""
    entry = F.array_sort(F.collect_list(F.struct("first_seq", "answer", "votes")))
    return (
        vote_ranks(attempts, problem, order)
        .groupBy(problem)
        .agg(entry.alias("e"))
        .select(problem, F.transform("e", lambda x: x["answer"]).alias("answers"), F.transform("e", lambda x: x["votes"]).alias("votes"))
    )


def early_stop_cut(attempts: DataFrame, k: int, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """Attempts up to the first, in order of completion, with which some answer has ``k`` votes."""
    running = Window.partitionBy(problem, "answer").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = attempts.withColumn("_votes", F.when(F.col("answer").isNotNull(), F.count("answer").over(running)))
    cut = F.min(F.when(F.col("_votes") >= k, F.col(order))).over(Window.partitionBy(problem))
    return counted.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut"))).drop("_votes", "_cut")


def vote_cuts(attempts: DataFrame, k: int, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """(problem, cut): where, in order of completion, some answer first has ``k`` votes; a row for each
    problem in which one has."""
    running = Window.partitionBy(problem, "answer").orderBy(order)
    votes = attempts.where("answer is not null").select(problem, "answer", order).withColumn("_votes", F.row_number().over(running))
    return votes.where(F.col("_votes") == k).groupBy(problem).agg(F.min(order).alias("cut"))


def select_answer(attempts: DataFrame, early_stop: int = 5, problem: str = "problem_id", order: str = "completion_seq") -> DataFrame:
    """(problem, answer): a consensus, else of the leading answer and a second one tied with it the
    one with the attempt of least finite entropy, else the leading one; 0 without answers."""
    ranks = vote_ranks(attempts, problem, order)
    lead = Window.partitionBy(problem)
    ranks = ranks.withColumn("top_votes", F.max("votes").over(lead)).where((F.col("rank") <= 2) & (F.col("votes") == F.col("top_votes")))
    finite = F.when(F.col("entropy") < float("inf"), F.struct("entropy", order, "answer"))
    chosen = (
        ranks.join(attempts.select(problem, "answer", "entropy", order), [problem, "answer"])
        .groupBy(problem)
        .agg(F.max("top_votes").alias("top_votes"), F.min(F.when(F.col("rank") == 1, F.col("answer"))).alias("top"), F.min(finite).alias("best"))
        .select(problem, F.when((F.col("top_votes") >= max(4, early_stop)) | F.col("best").isNull(), F.col("top")).otherwise(F.col("best.answer")).alias("answer"))
    )
    return attempts.select(problem).distinct().join(chosen, problem, "left").select(problem, F.coalesce("answer", F.lit(0)).alias("answer"))
