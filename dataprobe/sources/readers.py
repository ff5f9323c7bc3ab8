"""Readers: CSV by description, folders of CSV files, text, JSON, parquet, libsvm, JDBC,
inline rows and file streams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CsvSpec:
    """Where a CSV data set lies and how it is written.

    Without ``schema`` all columns are text, unless ``infer`` asks Spark for one more
    pass over the data. ``skip_bad_lines`` drops lines that do not fit the schema.
    ``multi_line`` lets quoted values hold line breaks; Spark then reads each file in one task.
    """

    path: str
    name: str | None = None
    ending: str | None = None
    header: bool = True
    schema: T.StructType | None = None
    infer: bool = False
    separator: str = ","
    quote: str = '"'
    escape: str = "\\"
    charset: str = "UTF-8"
    strict_quotes: bool = False
    trim_leading_space: bool = False
    skip_bad_lines: bool = False
    multi_line: bool = False

    @property
    def location(self) -> str:
        if self.name is None:
            return self.path
        return f"{self.path.rstrip('/')}/{self.name}{self.ending or ''}"

    def options(self) -> dict[str, str]:
        if self.strict_quotes:
            raise ValueError("Spark's CSV reader cannot ignore characters outside quotes")
        return {
            "header": str(self.header).lower(),
            "inferSchema": str(self.infer and self.schema is None).lower(),
            "sep": self.separator,
            "quote": self.quote,
            "escape": self.escape,
            "encoding": self.charset,
            "ignoreLeadingWhiteSpace": str(self.trim_leading_space).lower(),
            "nullValue": "",       # an unquoted empty field is null
            "emptyValue": "",
            "multiLine": str(self.multi_line).lower(),
            "mode": "DROPMALFORMED" if self.skip_bad_lines else "PERMISSIVE",
        }


def read_csv(spark: SparkSession, spec: CsvSpec, names: Sequence[str] | None = None) -> DataFrame:
    """Read by description; ``names`` renames the columns by position."""
    reader = spark.read.options(**spec.options())
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    df = reader.csv(spec.location)
    return df.toDF(*names) if names else df


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """The plain files of a folder (not its subfolders), by the storage's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(
        str(s.getPath().toString()) for s in system.listStatus(path)
        if s.isFile() and not s.getPath().getName().startswith(("_", "."))
    )


def read_csv_folder(spark: SparkSession, folder: str, separator: str = ";", infer: bool = True,
                    schemas: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """One table per plain file, named by the file without its ending. Tables listed in
    ``schemas`` are read by that schema and cost no inference pass."""
    tables = {}
    for path in list_files(spark, folder):
        name = path.rsplit("/", 1)[-1].split(".", 1)[0]
        schema = (schemas or {}).get(name)
        tables[name] = read_csv(spark, CsvSpec(path, separator=separator, infer=infer, schema=schema))
    return tables


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """``(label, features)``; with the number of features given, no pass is needed to find it."""
    reader = spark.read.format("libsvm")
    if features is not None:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)


def jdbc_options(url: str, table: str, driver: str | None = None, user: str | None = None,
                 password: str | None = None, column: str | None = None, low: int | None = None,
                 high: int | None = None, partitions: int | None = None, fetch_rows: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read; with ``column``, ``low``, ``high`` and ``partitions`` it is parallel."""
    cut = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": partitions}
    if any(v is not None for v in cut.values()) and any(v is None for v in cut.values()):
        raise ValueError("a parallel JDBC read needs column, low, high and partitions together")
    options = {"url": url, "dbtable": table, "driver": driver, "user": user, "password": password,
               "fetchsize": fetch_rows, **cut}
    return {k: str(v) for k, v in options.items() if v is not None}


def read_jdbc(spark: SparkSession, url: str, table: str, **how: object) -> DataFrame:
    """A database table; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **how)).load()


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def number_range(spark: SparkSession, low: int, high: int, name: str = "n",
                 partitions: int | None = None) -> DataFrame:
    """Whole numbers of [low, high], both ends included."""
    return spark.range(low, high + 1, 1, partitions).select(F.col("id").alias(name))


def stream_files(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
                 files_per_batch: int = 1, **options: str) -> DataFrame:
    """An unbounded table over the files of a folder, taken in batches."""
    return (
        spark.readStream.format(file_format).schema(schema)
        .option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)
    )
