import hashlib
import math

import pytest
from pyspark.sql import functions as F

from dataprobe.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(leaves):
    """(root, for each leaf its siblings level by level)"""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, place in enumerate(at):
            run = list(range(place // 3 * 3, min(place // 3 * 3 + 3, len(level))))
            paths[leaf].append((place % 3, "".join(level[i] for i in run if i != place)))
            at[leaf] = place // 3
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: tree([leaf for *_, leaf in sorted(groups[name])]) for name in names}
    root, above = tree([trees[name][0] for name in names])
    out = []
    for name, upper in zip(names, above):
        for (given, doc_id, leaf), path in zip(sorted(groups[name]), trees[name][1]):
            out.append((doc_id if given else None, name, leaf, trees[name][0], root, [tuple(p) for p in path + upper]))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.slot, p.siblings) for p in r.path]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("levels", [1, 7])
def test_manifest(docs, levels):
    out = merkle.with_manifest(docs, "source", "doc_id", COLUMNS, levels)
    assert out.columns == docs.columns + ["leaf", "subroot", "root", "path"]
    assert found(out) == expected([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_every_size_of_a_group(spark, n):
    """Runs of one, two and three nodes at every level, over more rounds than one, with a hot group."""
    rows = [{"doc_id": i, "source": "hot", "lang": None, "n_chars": 1, "text": str(i)} for i in range(n)]
    rows += [{"doc_id": i, "source": None, "lang": "en", "n_chars": 1, "text": "é\n"} for i in range(3)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert found(merkle.with_manifest(df, "source", "doc_id", COLUMNS, 2)) == expected(rows)


def test_fold_shows_what_was_changed(docs):
    out = merkle.with_manifest(docs, "source", "doc_id", COLUMNS, 2).withColumn("changed", merkle.content_digest(
        *[F.col(c) for c in COLUMNS[:4]], F.concat("text", F.lit(" "))))
    for r in out.select("text", "leaf", "changed", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("same"),
                        merkle.fold(F.col("changed"), F.col("path")).alias("other"),
                        merkle.proof_digest(F.col("path")).alias("proof"), "path").collect():
        assert r.same == r.root
        assert (r.other == r.root) == (r.text is None)
        assert r.proof == sha("".join(p.siblings for p in r.path))


def test_empty_table_and_clashing_names(empty, docs, spark):
    assert merkle.with_manifest(empty, "source", "doc_id", COLUMNS).collect() == []
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "g", "n", "pos", "tie", "block", "top", "at", "task", "Leaf", "d0")])
    out = merkle.with_manifest(clashing, "source", "doc_id", COLUMNS, 2)
    assert "Leaf" not in out.columns and {"row", "block", "leaf"} <= set(out.columns)
    assert sorted(r.leaf for r in out.select("leaf").collect()) == sorted(leaf_of(r) for r in docs.collect())


def test_repeated_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "same")] * 5 + [(None, "s", None, None, None)],
                               "doc_id long, source string, lang string, n_chars long, text string")
    out = found(merkle.with_manifest(df, "source", "doc_id", COLUMNS))
    assert len(out) == 6 and out == expected([r.asDict() for r in df.collect()])
    assert {len(r[5]) for r in out} == {math.ceil(math.log(6, 3))}


def test_no_task_holds_a_whole_group(spark):
    """A window works on a block; a group is numbered over range partitions."""
    import dataprobe.session as session

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("x").alias("text"))
    session.PLANS = []
    try:
        merkle.with_manifest(df, "source", "doc_id", ["doc_id", "text"], 3)
        plans = session.PLANS
    finally:
        session.PLANS = None
    windows = [line for plan in plans for line in plan.splitlines() if "Window [" in line]
    assert windows and all("block#" in w or "sum(rows#" in w for w in windows)
    assert all("Python" not in plan for plan in plans)
