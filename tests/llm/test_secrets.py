import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sievework.llm import secrets

SCHEMA = "doc_id long, text string, blob string, spans int"
TEXTS = [
    'password = "abcdef"', "PassWD:'short'", "token==abcdef", "my api_key : a b", "apikey=" + "k" * 2000, "x" * 50_000 + " secret: " + "0123456789abcdef" * 3,
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "Z" * 14 + "é AKIA" + "B" * 30, "é" * 7 + "deadbeef" * 3, "deadbeef" * 2, "DEADBEEF" * 4,
    "ghp_" + "a" * 36, "ghp_" + "a" * 35, "-----BEGIN RSA PRIVATE KEY-----", "postgres://me:pw@host/db", "ſecret=abcdefg", "toKen=abcdefg", "", None, "secret=\npassword=abc token=abcdefgh", "😀 token: 'zzzzzzz'",
]


def plain(text, rules):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


def spans_of(spark, rows, ledger, rules=None):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = secrets.findings_of(secrets.scan(table, ledger, rules, path="doc_id"), ledger, rules).collect()
    return sorted(((r.path, [tuple(s) for s in r.spans or ()]) for r in got), key=str)


def wanted(rows, rules=None):
    return sorted(((d, plain(t, rules or secrets.RULES)) for d, t in rows), key=str)


def test_spans_are_those_of_the_plain_search(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (None, TEXTS[0]), (3, TEXTS[4]), (0, TEXTS[0])]
    assert spans_of(spark, rows, secrets.Ledger(spark)) == wanted(rows)
    assert spans_of(spark, [], secrets.Ledger(spark)) == []


def test_only_unseen_contents_and_rule_versions_are_searched(spark):
    ledger = secrets.Ledger(spark)
    first = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, TEXTS[0]) for i in range(40)]
    assert spans_of(spark, first, ledger) == wanted(first)
    contents = len({t or "" for t in TEXTS})
    assert ledger.scans().count() == contents  # 40 paths of one content: one scan
    second = [*first, (500, "token = 'brandnew1'"), (501, TEXTS[0])]
    assert spans_of(spark, second, ledger) == wanted(second)
    assert ledger.scans().count() == contents + 1
    changed = [secrets.Rule("assign", secrets.ASSIGN, 3, 2, version=2), *secrets.RULES[1:]]
    assert spans_of(spark, second, ledger, changed) == wanted(second, changed)
    again = ledger.scans().filter(F.array_contains("rules", "assign@2"))
    assert again.count() == contents + 1 and {tuple(r.rules) for r in again.collect()} == {("assign@2",)}
    assert spans_of(spark, second, ledger) == wanted(second)  # what version 1 found is still there
    assert ledger.scans().count() == 2 * (contents + 1)


def test_a_run_that_broke_off_is_done_again(spark):
    ledger = secrets.Ledger(spark)
    rows = [(1, TEXTS[0]), (2, TEXTS[9])]
    lost = spark.createDataFrame([(bytearray(hashlib.sha256(TEXTS[0].encode()).digest()), "assign@1", 0, len(TEXTS[0]) - 1)], secrets.FINDINGS)
    lost.write.parquet(f"{ledger.folder}/findings")  # findings without a scan
    assert spans_of(spark, rows, ledger) == wanted(rows)


@pytest.mark.parametrize("rule", secrets.RULES)
def test_hints_lose_nothing(rule):
    hints = secrets.HINTS.get(rule.kind)
    for text in filter(None, TEXTS):
        if secrets.searcher(rule)(text) and hints:
            assert any(h in text for h in hints)


def test_every_version_of_a_path_counts(spark):
    ledger = secrets.Ledger(spark)
    rows = [(1, "token = 'first11'"), (1, "nothing"), (1, "token = 'second2' later")]
    assert spans_of(spark, rows, ledger) == wanted(rows)
