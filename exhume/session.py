"""Session settings the operators are written for, and the folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # binary chunks travel through Arrow; small batches keep a task's memory flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", app: str = "exhume", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: ContextVar[str | None] = ContextVar("own", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is named, one in the warehouse, which all executors share too."""
    if own := _own.get():
        return own
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    For intermediate results that several later steps read: the work behind them is done once, lost
    executors cost nothing, and joins are planned with the table's real size. The caller's job owns
    the folder and its clean-up.
    """
    return Scratch(df.sparkSession).write(df)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[str]:
    """Staged tables of the block, of this thread only, go to one folder, which is deleted at the end of the block.

    For work that repeats for as long as a stream runs: nothing of a round is left behind.
    """
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token = _own.set(folder)
    try:
        yield folder
    finally:
        _own.reset(token)
        drop_folder(spark, folder)


#: With it, Spark removes the shuffle files of a plan once the plan has run, instead of whenever the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What plans run in the block have shuffled is removed as each of them ends: for plans whose result is written and that nobody runs again.

    So a job takes the disk of its largest step, and not that of all its steps together.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


#: A row may hold a whole submission: a row group ends by its bytes and not after the hundred rows that are gathered before the first look.
BY_BYTES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


class Scratch:
    """Staged tables of one job, in a folder of their own below the shared one.

    ``drop`` removes tables no later step reads; what the result still reads stays for the owner of
    the shared folder.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._paths: list[tuple[DataFrame, str]] = []

    def path(self) -> str:
        """A new path below the folder."""
        return f"{self.folder}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        with shuffles_freed(self.spark):
            df.write.options(**BY_BYTES).parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((staged, path))
        return staged

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self._paths:
            if any(table is x for x in tables):
                drop_folder(self.spark, path)
        self._paths = [x for x in self._paths if not any(x[0] is y for y in tables)]
