import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dataprobe.operators import audit, joins
from dataprobe.sources import readers


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def make(n, charset="ABCDEF", length=4, seed=2):
    """Records whose secret uses exactly two characters, with one hint per other character."""
    rng = random.Random(seed)
    records, secrets = [], {}
    for i in range(n):
        two = rng.sample(charset, 2)
        secret = "".join([*two, *(rng.choice(two) for _ in range(length - 2))])
        hints = []
        for c in charset:
            if c not in two:
                rest = [x for x in charset if x != c]
                rng.shuffle(rest)
                hints.append(sha("".join(rest)))
        records.append((i, sha(secret), charset, length, hints))
        secrets[i] = secret
    return records, secrets


SCHEMA = "id int, token string, charset string, length int, hints array<string>"


def test_hint_says_what_is_missing(spark, rows):
    df = spark.createDataFrame([(1, "-", "ABC", 2, [sha("CB"), sha("??")])], SCHEMA)
    assert rows(audit.resolve_hints(df)) == [("ABC", sha("CB"), "A")]


def test_tokens(spark):
    records, secrets = make(20)
    records += [(100, sha("never"), *records[0][2:]), (101, *records[0][1:]), (102, sha("BC"), "ABC", 2, [sha("CB")]),
                (103, sha("AAB"), "AB", 3, None), (104, sha("AB"), "ABC", 2, [sha("unknown")])]
    secrets |= {100: None, 101: secrets[0], 102: "BC", 103: "AAB", 104: "AB"}
    got = audit.resolve_tokens(spark.createDataFrame(records, SCHEMA)).collect()
    assert len(got) == len(records)
    assert {r["id"]: r["value"] for r in got} == secrets
    assert all(r["resolved"] == (r["value"] is not None) for r in got)


@pytest.mark.parametrize("hot_rows", [1, 1_000])
def test_same_result_beyond_the_broadcast_bound(spark, monkeypatch, hot_rows):
    records, secrets = make(12, seed=8)
    records += [(i, *records[0][1:]) for i in range(50, 60)]
    secrets |= {i: secrets[0] for i in range(50, 60)}
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    got = audit.resolve_tokens(spark.createDataFrame(records, SCHEMA))
    assert {r["id"]: r["value"] for r in got.collect()} == secrets


def test_supplied_domain(spark, rows):
    records = spark.range(6).select("id", F.sha2(F.col("id").cast("string"), 256).alias("token"))
    domain = spark.range(2, 5).select(F.col("id").alias("value"))
    got = {r["id"]: (r["value"], r["resolved"]) for r in audit.resolve_against(records, domain).collect()}
    assert got == {0: (None, False), 1: (None, False), 2: ("2", True), 3: ("3", True), 4: ("4", True), 5: (None, False)}


def test_records_in_file_order(spark, tmp_path):
    records, secrets = make(8, seed=5)
    lines = ["ID;Name;Chars;Length;Token;Hint1;Hint2;Hint3;Hint4"]
    lines += [";".join([str(i), f"n{i}", charset, str(length), token, *hints]) for i, token, charset, length, hints in records]
    (tmp_path / "records.csv").write_text("\n".join(lines))
    spec = readers.CsvSpec(str(tmp_path), name="records", ending=".csv", separator=";", infer=True)
    got = audit.resolve_tokens(audit.records_from_positions(readers.read_csv(spark, spec)))
    assert {r["id"]: r["value"] for r in got.collect()} == secrets


def test_repeated_and_many_characters(spark):
    """A repeated character is excluded in all its places; sets of over 63 and of over 20 characters don't stop the others."""
    printable = "".join(chr(c) for c in range(33, 128 - 1))
    records = [(1, sha("AA"), "BAB", 2, [sha("A")]), (2, sha("!~"), printable, 2, None), (3, sha("x"), printable, 1, [sha("unknown")]),
               (4, sha("BC"), "ABC", 2, [sha("CB")]), (5, sha("A"), "AB", None, None), (6, sha("A"), None, 1, None)]
    got = audit.resolve_tokens(spark.createDataFrame(records, SCHEMA)).collect()
    assert {r["id"]: r["value"] for r in got} == {1: "AA", 2: "!~", 3: "x", 4: "BC", 5: None, 6: None}


def test_outcomes_within_a_budget(spark):
    """Records beyond the budget say so, and the others are answered all the same."""
    records, secrets = make(12, seed=4)
    long = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    records += [(100, sha("x"), "ABCDEF", 60, None), (101, sha("never"), "AB", 3, None), (102, sha("AB"), long, 2, [sha("hint")]),
                (103, sha("QQ"), long, 2, None), (104, sha(""), None, 0, None), (105, sha("A"), "ABC", None, None), (106, None, "AB", 2, None)]
    got = {r["id"]: (r["value"], r["outcome"]) for r in audit.audit_tokens(spark.createDataFrame(records, SCHEMA), 10_000).collect()}
    assert len(got) == len(records)
    assert {i: got[i] for i in secrets} == {i: (secret, "resolved") for i, secret in secrets.items()}
    assert {i: got[i] for i in range(100, 104)} == {
        100: (None, "too large"), 101: (None, "unresolved"), 102: (None, "too large"), 103: ("QQ", "resolved")}
    assert {got[i][1] for i in (105, 106)} == {"unresolved"}


@pytest.mark.parametrize("ranks", [3, 1000])
def test_words_by_ranks_are_the_words(spark, rows, ranks):
    from dataprobe.operators.generate import words, words_in_ranges
    df = spark.createDataFrame([("ABC", 3), ("AAB", 2), ("é日", 4), ("X", 5), ("AB", 0), ("", 2), (None, 2), ("AB", None)], "charset string, n int")
    assert rows(words_in_ranges(df, "charset", "n", ranks)) == rows(words(df, "charset", "n"))
