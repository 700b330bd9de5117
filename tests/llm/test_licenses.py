from quorate.llm.licenses import RULES, SENTENCES, scan_licenses

SCHEMA = "doc_id long, text string, ids string, licences string"


def test_rules_in_order(spark):
    s = SENTENCES
    rows = [
        (1, f"Intro.\n{s[5]}\nmore", "x", "y"),
        (2, f"{s[16]}:\n1. {s[17]}\n * {s[18]}\n", "x", "y"),
        (3, f"{s[16]}:\n{s[17]} {s[18]}\nUnknown sentence here. {s[19]}", "x", "y"),
        (4, f"{s[18]}\n{s[17]}\n{s[16]}", "x", "y"),
        (5, f"{s[6].upper()}   {s[13]} {s[6]}", "x", "y"),
        (6, None, "x", "y"), (7, "", "x", "y"), (8, "word. " * 40_000 + s[14], "x", "y"), (8, "nothing", "x", "y"), (None, s[24], "x", "y"),
        (9, f"{s[10]}; {s[11]}", "x", "y"), (10, "SPDX-License-Identifier: Apache-2.0", "x", "y"),
    ]
    got = sorted(((r.doc_id, r.n_sentences, r.sentence_ids, r.licences) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [
        (1, 1, "5", "Apache-2.0"), (2, 3, "16 17 18", "BSD-2-Clause"), (3, 4, "16 17 18 19", "BSD-3-Clause"), (4, 3, "18 17 16", ""), (5, 3, "6 13 6", "CC-BY-NC-4.0,MIT"),
        (6, 0, "", ""), (7, 0, "", ""), (8, 1, "14", "CC-BY-4.0"), (8, 0, "", ""), (None, 1, "24", "Unlicense"), (9, 2, "10 11", "GPL-3.0-or-later"), (10, 0, "", "Apache-2.0"),
    ]
    assert got == sorted(want, key=str)


def test_every_rule_is_of_known_sentences():
    assert all(set(rule) <= set(SENTENCES) for _, rule in RULES)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
