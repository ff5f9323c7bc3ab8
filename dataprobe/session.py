"""Session set-up, timing and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JobConfig:
    """What a job run may set: input path, cores and shuffle partitions.

    ``partitions`` defaults to twice the cores. On a cluster leave ``master``
    unset so that ``spark-submit`` decides, and let AQE size the shuffles.
    """

    path: str | None = None
    cores: int = 4
    partitions: int | None = None
    master: str | None = None
    app_name: str = "dataprobe"

    @property
    def shuffle_partitions(self) -> int:
        return self.partitions or 2 * self.cores


def build_session(config: JobConfig = JobConfig(), **extra: str) -> SparkSession:
    """Build (or get) a session; ``extra`` maps ``spark__x__y`` to ``spark.x.y``."""
    builder = (
        SparkSession.builder.appName(config.app_name)
        .config("spark.sql.shuffle.partitions", str(config.shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if config.master:
        builder = builder.master(config.master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_SCRATCH: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder named in ``spark.checkpoint.dir``.

    The setting must name storage every executor can reach. Only a local session may go without it; it then
    gets a temporary folder, which leaves the caller's own settings as they are. What is written to such paths goes with
    ``release_scratch``, or at the end of the program.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="dataprobe-"))
        base = f"file://{_LOCAL_SCRATCH[0]}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def release_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables written so far (from number ``since`` on). Frames that read them fail from then on, so
    write down what is to stay first."""
    mine = [path for session, path in _WRITTEN[since:] if session is spark]
    _WRITTEN[since:] = [entry for entry in _WRITTEN[since:] if entry[0] is not spark]
    jvm = spark.sparkContext._jvm
    for name in mine:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside the block go at its end."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release_scratch(spark, since)


@atexit.register
def _release_at_exit() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        with contextlib.suppress(Exception):        # the session may have ended before
            release_scratch(spark)
    for folder in _LOCAL_SCRATCH:
        shutil.rmtree(folder, ignore_errors=True)


#: Set to a list, it gets the plan of each table that is written down (for tests).
PLANS: list[str] | None = None


def materialize(df: DataFrame, label: str, file_rows: int = 0, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: a cut in the lineage
    that outlives lost executors. ``file_rows`` bounds the rows of a file, ``codec`` compresses it
    in place of the session's."""
    path = scratch_path(df.sparkSession, label)
    if PLANS is not None:
        PLANS.append(df._jdf.queryExecution().executedPlan().toString())
    df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Distribute few or small rows that are about to grow (by ``explode``) over all tasks.

    AQE merges partitions by their present size, which says nothing about what
    comes out of them; an explicit number of partitions is left alone.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, 2 * spark.sparkContext.defaultParallelism), *columns)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_dataprobe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="dataprobe-"), "dataprobe.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("dataprobe", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._dataprobe_shipped = True


def run_timed(df: DataFrame) -> float:
    """Seconds to compute every row and column of ``df``, keeping nothing."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run ``text`` over ``tables``, which are views under their names meanwhile."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
