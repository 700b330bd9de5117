import random
import re

import pytest

from quorate.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, n long, signature string"


def brute(rows):
    """(n_shingles, component) of each row, by comparing all pairs."""
    sets = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    links = [
        (rows[i][0], rows[j][0])
        for i in range(len(rows))
        for j in range(i)
        if None not in (rows[i][0], rows[j][0]) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted(((r[0], len(s), label.get(r[0])) for r, s in zip(rows, sets)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
    bases = [rng.choices(words, k=rng.choice([6, 9, 14, 40, 80, 200])) for _ in range(max(2, n // 8))]
    texts = []
    for _ in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            base[rng.randrange(len(base))] = rng.choice(words)
        text = " ".join(base)
        texts.append(f"{text} {rng.choice(passages)}" if rng.random() < 0.3 else text.upper() if rng.random() < 0.1 else text)
    return texts


@pytest.mark.parametrize("seed, frequent", [(1, 64), (2, 2), (3, 4), (4, 2)])
def test_same_components_as_all_pairs(spark, seed, frequent):
    rows = [(i * 7 % 1009, t, 1, "x") for i, t in enumerate(corpus(seed, 160))]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), least_frequent=frequent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_nulls_empty_short_long_and_repeated_rows(spark):
    long_text = " ".join(f"t{i}" for i in range(30_000))
    rows = [
        (5, None, 1, ""), (6, "", 1, ""), (7, " \t\n", 1, ""), (8, "one two", 1, ""), (3, "ONE two", 1, ""), (9, "one", 1, ""),
        (10, long_text, 1, ""), (11, long_text + " end", 1, ""), (12, "a b c d e f", 1, ""), (12, "a b c d e f", 1, ""), (None, "a b c d e f", 1, ""),
    ]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 1, 9), (10, 29_996, 10), (11, 29_997, 10), (12, 2, 12), (12, 2, 12), (None, 2, None)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
