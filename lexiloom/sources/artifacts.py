"""Artefacts written once: folders that appear whole, manifests of file hashes, and models bound to theirs."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.checks import CheckFailed
from lexiloom.sources.records import file_listing, inventory_differences

_MANIFEST = "path string, bytes long, sha256 string"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def rename(spark: SparkSession, before: str, after: str) -> None:
    """Move a file or folder to a name that must be free; on HDFS and local disks this is one step."""
    source, system = _path(spark, before)
    target, _ = _path(spark, after)
    if system.exists(target) or not system.rename(source, target):
        raise CheckFailed({f"{after} is taken": 1})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole, under a name that must be free."""
    draft, system = _path(spark, path + ".draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, path + ".draft", path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


class IncrementalSink:
    """JSON lines by batches: each goes to a folder of its own under a partial name, ``finish`` gives the whole its name.

    A finished or a partial output that is already there is an error, so evidence of an earlier run is never lost. A
    batch written again, as after a lost executor, replaces itself. ``progress`` has the batches and rows so far.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.partial = spark, path, path + ".partial"
        for name in (path, self.partial):
            if exists(spark, name):
                raise CheckFailed({f"{name} is taken": 1})
        self.progress: dict[int, int] = {}

    def write(self, batch: DataFrame, number: int) -> None:
        """Usable as the function of ``foreachBatch``."""
        at = f"{self.partial}/batch={number}"
        batch.write.mode("overwrite").json(at)
        self.progress[number] = self.spark.read.text(at).count()

    def finish(self) -> int:
        """The rows written."""
        rename(self.spark, self.partial, self.path)
        return sum(self.progress.values())


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path relative to the folder, bytes, sha256 of its files."""
    files = file_listing(spark, path)
    return files.withColumn("path", F.regexp_replace("path", "^.*" + path.rstrip("/").rsplit("/", 1)[-1] + "/", ""))


def write_manifest(spark: SparkSession, path: str, **told) -> dict:
    """Beside a folder, ``<path>.manifest.json`` with its files' hashes and whatever else is told."""
    files = [r.asDict() for r in hashed_files(spark, path).orderBy("path").collect()]
    manifest = {"version": 1, "files": files, **told}
    write_text(spark, path.rstrip("/") + ".manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False, allow_nan=False))
    return manifest


def verified(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder whose files are all, and only, those that it names, unchanged; else CheckFailed."""
    manifest = json.loads(read_text(spark, path.rstrip("/") + ".manifest.json"))
    wanted = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in manifest["files"]], _MANIFEST)
    wrong = inventory_differences(hashed_files(spark, path), wanted).collect()
    if wrong:
        raise CheckFailed({f"{r.path}: {r.problem}": 1 for r in wrong})
    return manifest


def save_model(model: PipelineModel, path: str, **told) -> dict:
    """Save a model once, with a manifest of its files."""
    model.write().save(path)
    return write_manifest(SparkSession.active(), path, **told)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """The model whose files are those that were saved."""
    verified(spark, path)
    return PipelineModel.load(path)
