import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.operators import learn
from dataprobe.session import JobConfig, materialize, scratch_path
from dataprobe.sources import readers, sinks


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_header_and_inference(spark, tmp_path, rows):
    path = put(tmp_path / "e.csv", "Name,Age,Salary,Company\nAnn,97,1.5,X\nBob,3,2.5,Y\n")
    df = readers.read_csv(spark, readers.CsvSpec(path, infer=True))
    assert df.dtypes == [("Name", "string"), ("Age", "int"), ("Salary", "double"), ("Company", "string")]
    assert rows(df) == [("Ann", 97, 1.5, "X"), ("Bob", 3, 2.5, "Y")]


def test_without_header(spark, tmp_path, rows):
    path = put(tmp_path / "s.csv", '1,"a,b",p,G\n007,c,q,\n')
    df = readers.read_csv(spark, readers.CsvSpec(path, header=False), ["ID", "Name", "Password", "Gene"])
    assert rows(df) == [("007", "c", "q", None), ("1", "a,b", "p", "G")]


def test_descriptor(spark, tmp_path, rows):
    text = "id;word\n1;'ü;x'\n2;  y\nbad;z\n3;\n"
    put(tmp_path / "d.txt", text, "iso-8859-1")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("word", T.StringType())])
    spec = readers.CsvSpec(str(tmp_path), name="d", ending=".txt", schema=schema, separator=";", quote="'",
                           charset="ISO-8859-1", trim_leading_space=True, skip_bad_lines=True)
    assert spec.location.endswith("/d.txt")
    assert rows(readers.read_csv(spark, spec)) == [(1, "ü;x"), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        readers.CsvSpec("x", strict_quotes=True).options()


def test_folder_is_not_recursive(spark, tmp_path, rows):
    put(tmp_path / "a.csv", "x;y\n1;2\n")
    put(tmp_path / "b.csv", "z\nq\n")
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "c.csv", "w\n1\n")
    schema = T.StructType([T.StructField("z", T.StringType())])
    tables = readers.read_csv_folder(spark, str(tmp_path), schemas={"b": schema})
    assert sorted(tables) == ["a", "b"]
    assert rows(tables["a"]) == [(1, 2)] and rows(tables["b"]) == [("q",)]


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x:y", "t", driver="d", user="u", password="p", column="id", low=0, high=99, partitions=4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4" and options["upperBound"] == "99"
    assert set(readers.jdbc_options("jdbc:x:y", "t")) == {"url", "dbtable", "fetchsize"}
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x:y", "t", column="id")


def test_lines_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_lines(spark.createDataFrame([("b",), ("c",), ("a",), (None,)], "s string"), "s", path)
    parts = [open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-")]
    assert "".join(parts).split() == ["a", "b", "c"]
    assert readers.read_text(spark, path).count() == 3


def test_append_and_bounded_take(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_rows(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6
    assert len(sinks.take_rows(spark.range(100), 4)) == 4


def test_per_partition_action_and_prints(spark, tmp_path, capsys):
    folder = str(tmp_path)

    def note(part):
        with open(os.path.join(folder, f"n{os.getpid()}-{random.random()}"), "w") as out:
            out.write(str(sum(1 for _ in part)))

    sinks.for_each_partition(spark.range(10).repartition(3), note)
    assert sum(int((tmp_path / f).read_text()) for f in os.listdir(folder)) == 10
    sinks.show_rows(spark.range(1))
    sinks.explain_rows(spark.range(1))
    assert "id" in capsys.readouterr().out


def test_ranges_and_inline_rows(spark, rows):
    assert rows(readers.number_range(spark, 1, 3)) == [(1,), (2,), (3,)]
    assert readers.number_range(spark, 3, 2).count() == 0
    assert rows(readers.inline_rows(spark, [("Garfield", 5)], "name string, age int")) == [("Garfield", 5)]


def test_scratch_folder(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert one != two and one.startswith(named)
    assert materialize(spark.range(5), "r").count() == 5
    assert JobConfig(cores=6).shuffle_partitions == 12 and JobConfig(partitions=3).shuffle_partitions == 3


def test_libsvm_and_tree(spark, tmp_path):
    """Two clusters with one feature of few values: the tree must learn them."""
    rng = random.Random(1)
    data = [(i, i % 2, [float(i % 2 + rng.choice([0, 2])), rng.random() + 3 * (i % 2), rng.random()]) for i in range(200)]
    df = spark.createDataFrame(data, "id int, label int, v array<double>")
    path = str(tmp_path / "svm")
    learn.labelled_vectors(df, "label", "v").write.format("libsvm").save(path)
    back = readers.read_libsvm(spark, path, features=3)
    assert back.columns == ["label", "features"] and back.count() == 200
    assert list(learn.fit_indexer(back).categoryMaps) == [0]
    train, test = learn.split_by_hash(learn.labelled_vectors(df, "label", "v", "id"), "id", 0.7, 3)
    assert train.count() + test.count() == 200 and train.join(test, "id").count() == 0
    report = learn.train_tree(train, test)
    assert report.accuracy > 0.9 and abs(report.test_error - (1 - report.accuracy)) < 1e-12
    assert "If (feature" in report.tree
    row = learn.accuracy_table(report.predictions).first()
    assert abs(row["accuracy"] - report.accuracy) < 1e-9
    assert report.predictions.select(F.countDistinct("prediction")).first()[0] == 2


def test_line_breaks_inside_quotes(spark, tmp_path, rows):
    (tmp_path / "n.csv").write_text('k;text\n1;"one\ntwo"\n2;three\n')
    spec = readers.CsvSpec(str(tmp_path / "n.csv"), separator=";", multi_line=True, skip_bad_lines=True)
    assert rows(readers.read_csv(spark, spec)) == [("1", "one\ntwo"), ("2", "three")]


def test_folder_of_different_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("n\n1.5\n")
    (tmp_path / "_skip.csv").write_text("z\n")
    tables = readers.read_csv_folder(spark, str(tmp_path), schemas={"b": T.StructType([T.StructField("n", T.DoubleType())])})
    assert {n: t.dtypes for n, t in tables.items()} == {"a": [("k", "int"), ("v", "string")], "b": [("n", "double")]}


def test_scratch_goes_at_the_end_of_the_block(spark):
    from dataprobe.session import materialize, scratch

    before = spark.sparkContext.getCheckpointDir()
    with scratch(spark):
        kept = materialize(spark.range(3), "three")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 3
    assert not os.path.exists(path.removeprefix("file://"))
    assert spark.sparkContext.getCheckpointDir() == before


@pytest.mark.parametrize("split", ["40", "134217728"])
@pytest.mark.parametrize("quote, escape, ending", [('"', '"', "\n"), ('"', "\\", "\n"), ("'", "\\", "\r\n")])
def test_line_breaks_in_values_over_many_splits(spark, tmp_path, rows, conf, split, quote, escape, ending):
    """Values that hold breaks, quotes and separators, longer than a split; two files, each in many tasks."""
    from dataprobe.sources import records
    conf("spark.sql.files.maxPartitionBytes", split)
    conf("spark.sql.files.openCostInBytes", "0")
    rng = random.Random(3)
    data = []
    for i in range(60):
        text = "".join(rng.choice(["a", "b ", "\n", quote, ",", "\n\n", "x" * 30, "é", ""]) for _ in range(rng.randrange(0, 25)))
        data.append((i, f"t{text}.", rng.choice([None, "plain", "two\nlines"])))

    def field(value):
        if value is None:
            return ""
        return quote + str(value).replace(quote, escape + quote) + quote if not isinstance(value, int) else str(value)
    for k, part in enumerate((data[:25], data[25:])):
        lines = ["id,text,note"] + [",".join(map(field, row)) for row in part]
        (tmp_path / f"part{k}.csv").write_bytes((ending.join(lines) + ending).encode())
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])
    spec = readers.CsvSpec(str(tmp_path), schema=schema, quote=quote, escape=escape)
    df = records.read_csv_records(spark, spec)
    assert df.schema == schema and rows(df) == sorted(data, key=repr)
    assert (spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20) == (split == "40")


def test_records_without_schema_and_bad_ones(spark, tmp_path, rows):
    from dataprobe.sources import records
    put(tmp_path / "e.csv", 'a,b\n1,"x\ny"\n\n2,"z"\n')
    assert rows(records.read_csv_records(spark, readers.CsvSpec(str(tmp_path)))) == [("1", "x\ny"), ("2", "z")]
    kinds = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    put(tmp_path / "e.csv", '1,"x\ny"\nbad,"z\n"\n', "utf-8")
    spec = readers.CsvSpec(str(tmp_path), schema=kinds, header=False, skip_bad_lines=True)
    assert rows(records.read_csv_records(spark, spec)) == [(1, "x\ny")]
    with pytest.raises(ValueError):
        records.read_csv_records(spark, readers.CsvSpec("x", charset="UTF-16", schema=kinds))
