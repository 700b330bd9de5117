"""The scan of chunks carries only what braces look back on, in whatever order chunks come."""

import random

import pytest

from quorate.operators import attempts
from quorate.streaming.watch import answer_patterns, last_answer

SCHEMA = "p long, chunk_no int, n_tokens int, text string"


def turns(seed):
    rng = random.Random(seed)
    texts = ["x", " ", "7", "\\boxed{", "}", "", None, "12}"]
    rows = []
    for p in range(25):
        for no in range(rng.randrange(1, 160)):
            if rng.random() < 0.9:
                rows.append((p, no, rng.choice([0, 1, 1, 1, 2, None]), rng.choices(texts, [1, 60, 1, 2, 2, 2, 1, 1 if p % 2 else 0])[0]))
    return rows


def plain(rows, look_back):
    found = {}
    for p in sorted({r[0] for r in rows}):
        seen = [(no, text or "") for _, no, n, text in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]) if n and n > 0]
        for i, (no, text) in enumerate(seen):
            answer = last_answer("".join(t for _, t in seen[max(0, i + 1 - look_back) : i + 1]), answer_patterns()) if "}" in text else None
            if answer is not None:
                found[p] = (no, answer)
                break
    return found


@pytest.mark.parametrize("order", ["as they come", "mixed", "odd numbers last"])
@pytest.mark.parametrize("look_back", [3, 32])
def test_scan_in_any_order(spark, order, look_back):
    rows = turns(look_back)
    want = plain(rows, look_back)
    if order == "mixed":
        random.Random(5).shuffle(rows)
    elif order == "odd numbers last":
        rows.sort(key=lambda r: r[1] // 10 % 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if order == "mixed" else spark.createDataFrame(rows, SCHEMA).coalesce(2)
    got = {r.p: (r.chunk_no, r.answer) for r in attempts.rolling_chunk_scan(df, ["p"], look_back).collect()}
    assert got == want and want


def test_few_chunks_are_carried(spark):
    rows = [(p, no, 1, "}" if no == 700 else "word") for p in range(3) for no in range(1500)]
    near = attempts._near_braces(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["p"], 32)
    assert near.count() <= 3 * 32 * 4  # at a brace, at a turn's end, and at ends of Arrow batches
