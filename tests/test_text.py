import re

import pytest
from pyspark.sql import functions as F

from quorate.functions import text as T


# How an answer is written.
def answer(text, colon=True):
    for pattern in (r"\\boxed\s*\{\s*([0-9,]+)\s*\}", rf"final\s+answer\s+is\s*{'[:\\s]*' if colon else ''}([0-9,]+)"):
        found = re.findall(pattern, text, re.IGNORECASE)
        if found:
            digits = found[-1].replace(",", "")
            if digits and int(digits) <= 99999:
                return int(digits)
    return None


REPLIES = [
    r"\boxed{12}", r"\boxed { 1,234 }", r"\boxed{1} \boxed{2}", r"\boxed{1} \boxed{100000}", r"\boxed{,} final answer is 4", r"\BOXED{7}", "final answer is: 9", "Final\u2003Anſwer ıs 8",
    "<think>\\boxed{5}</think> \\boxed{0}", "<think>x", "", "final answer is " + "9" * 45, "\\boxed{" + "0" * 45 + "3}", "final answer is\x1c7", "finalanswer is 3", "\\boxed{\u00a042\u2028}",
]


def test_extract_answer(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, r string")
    got = df.select("i", T.extract_answer(F.col("r")).alias("a"), T.extract_answer(F.col("r"), "strict").alias("s")).orderBy("i").collect()
    assert [(x.a, x.s) for x in got] == [(answer(r), answer(r, False)) for r in REPLIES]


def test_outer_zero_gives_way_unless_asked(spark):
    df = spark.createDataFrame([("<think>\\boxed{5}</think>final answer is 0",)], "r string")
    assert df.select(T.answer_clean_or_raw(F.col("r")), T.answer_clean_or_raw(F.col("r"), True)).first() == (5, 0)


@pytest.mark.parametrize(
    "out, err, plain, tool",
    [
        ("a \n", "b \n", "a\nb", "a\nb \n"),
        ("a \n", "", "a", "a \n"),
        (None, "b\n", "b", "b\n"),
        (" \n", None, T.NO_OUTPUT["plain"], T.NO_OUTPUT["tool"]),
        (" ", "e", "e", "\ne"),
    ],
)
def test_format_exec_output(spark, out, err, plain, tool):
    df = spark.createDataFrame([(out, err)], "o string, e string")
    assert tuple(df.select(*(T.format_exec_output(F.col("o"), F.col("e"), v) for v in ("plain", "tool"))).first()) == (plain, tool)


@pytest.mark.parametrize("code, want", [("", ""), ("x=1\n# c", "x=1\n# c"), ("sprint", "sprint"), ("  a\n  b ", "a\nprint(b)"), ("import x", "import x")])
def test_ensure_last_print(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(T.ensure_last_print(F.col("c"))).first()[0] == want


def test_split_problems(spark):
    text = "pre Problem 1 Problem: " + "a" * 21 + " Answer: 3 Problem 12\nProblem:  " + "b" * 20 + "\nSolution: x Problem 3 PROBLEM: " + "c" * 30
    got = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(T.split_problems(F.col("t")).alias("p")).collect()
    # "Problem 12" is followed by a body of exactly 20 characters, which is too short.
    assert [(p.num, p.problem) for p in got[0].p] == [(1, "a" * 21), (3, "c" * 30)] and got[1].p == []


def test_problem_blocks(spark):
    text = f"Problem 1.\nProblem: {'a' * 31}\nAnswer: 1\nProblem 123\nProblem: {'b' * 30}\nSolution\nProblem 4 . Problem: {'c' * 40}\nSolution: s"
    got = spark.createDataFrame([(text,)], "t string").select(T.extract_problem_blocks(F.col("t")).alias("p")).first().p
    assert [(p.id, p.problem) for p in got][0] == ("prob_01", "a" * 31)


def test_chat_reply(spark):
    rows = [('{"choices":[{"message":{"content":null,"reasoning_content":"r"}}]}',), ('{"choices":[{"message":{"content":"c"}}]}',), ('{"choices":[{"message":{}}]}',)]
    assert [r[0] for r in spark.createDataFrame(rows, "j string").select(T.chat_reply(F.col("j"))).collect()] == ["<think>r</think>\n", "c", ""]
