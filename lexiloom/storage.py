"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset and the master is local, a folder of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lexiloom-")
    return "file://" + _OWN[app]


_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Executions started inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEAN_KEY, None)
    spark.conf.set(_CLEAN_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_KEY)
        else:
            spark.conf.set(_CLEAN_KEY, before)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_WRITERS_KEY = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def sorted_once(spark: SparkSession):
    """Bucketed writes started inside keep the order that their rows have, where each task has one bucket.

    Else Spark sorts the rows once more by the number of their bucket, which it computes anew for each comparison.
    """
    before = spark.conf.get(_WRITERS_KEY)
    spark.conf.set(_WRITERS_KEY, "1")
    try:
        yield
    finally:
        spark.conf.set(_WRITERS_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage at files that outlive any executor, so a lost machine costs one
    re-read rather than a recomputation of the whole plan. Once the table is written, the shuffle
    files that led to it are deleted.
    """
    return _written(df, name)[0]


class Scratch:
    """Intermediate tables of one operator: those that its result does not read are deleted as soon as it is built.

    Used as ``with Scratch(spark) as put``: ``put(df, name)`` materialises, ``put.keep(df)`` marks a table
    that the result reads lazily, and ``put.drop(df)`` deletes one that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.tables[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.pop(id(df), None)
        return df

    def give(self, df: DataFrame, to: Scratch) -> DataFrame:
        """Leave the deletion of a table to another scratch."""
        to.tables[id(df)] = self.tables.pop(id(df))
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.tables.pop(id(df), (None, None))
            if path is not None:
                self._delete(path)

    def folder(self, name: str) -> str:
        """A path of its own in the shared folder, deleted at the end with whatever is there then."""
        self.folders.append(f"{shared_folder(self.spark)}/lexiloom/{name}-{uuid.uuid4().hex}")
        return self.folders[-1]

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in list(self.tables.values())))
        for path in self.folders:
            self._delete(path)


#: Rows of an Arrow batch between the JVM and Python; of texts, the default of 10,000 takes tens of MB on either side.
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Use small Arrow batches in this session, unless its configuration names a size of its own."""
    if not spark.sparkContext.getConf().contains(_BATCH_KEY) and int(spark.conf.get(_BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Executions started inside use Arrow batches of so many rows, at most."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
