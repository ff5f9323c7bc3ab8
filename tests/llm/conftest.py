import random

import pytest

from dataprobe.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves, in and out.
CLASHES = ["row", "id", "body", "FP", "node", "key", "size", "shard", "slot", "fingerprint", "component_id", "score", "predicted",
           "copy_no", "n_copies", "order_key", "n_words", "n_removed", "kept", "n_bytes", "n_tokens", "over_limit", "rate", "cell"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def prose(r, n):
    return " ".join(r.choice("of the and to in a is that for on with as it was be by at from this an are or".split()) if r.random() < .3
                    else "".join(r.choices("abcdefgh", k=r.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Random texts with copies, near copies, shared passages, nulls, empty texts and repeated rows."""
    r = random.Random(5)
    shared = prose(r, 30)
    rows, texts = [], []
    for i in range(60):
        kind = r.random()
        if texts and kind < .15:
            text = r.choice(texts)
        elif texts and kind < .3:
            words = r.choice(texts).split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind < .5:
            text = prose(r, r.randint(1, 30)) + "\n" + shared + "\t " + prose(r, r.randint(0, 30))
        else:
            text = prose(r, r.choice([1, 2, 5, 12, 13, 14, 60, 200]))
        texts.append(text)
        rows.append((i, text, "en", f"s{i % 3}" if i % 3 else "s0", len(text)))
    rows += [(100, None, None, None, None), (None, None, None, None, None), (101, "", "", "", 0), (102, " \n\t ", "en", "s1", 4),
             (None, texts[3], "en", "s1", 1), rows[7], rows[7], (103, "é日本 ÉÀ ß ﬁn", "fr", None, 9),
             (104, "x" * 70_000, "en", "s2", 70_000), (105, "word " * 20_000, "en", "s2", 100_000), (7, "other text for id 7", "en", "s0", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.limit(12).select("*", *[F.lit(f"old {c}").alias(c) for c in CLASHES])
