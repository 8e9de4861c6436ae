"""Stages: reliable cut points that survive the loss of an executor."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a local session (one machine, as in tests) gets a temporary folder; on a
    cluster that folder would exist once per machine, so there the setting is required.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and continue from it, for plans that are read several times.

    The copy lives on shared storage, so a lost executor only costs re-reading it, and its
    measured size lets Spark choose join strategies for whatever follows.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Leaves of a plan whose content its files do not tell, and functions that its text does not show.
_UNKNOWN = ("LogicalRDD", "LocalRelation", "ExternalRDD", "Python", "Arrow", "Pandas", "MapIn", "MapPartitions")
_PLAN_FIELDS = "spark.sql.debug.maxToStringFields"


def _fingerprint(df: DataFrame) -> str | None:
    """Of the plan and of the files it reads, with sizes and times; None if it cannot be told."""
    spark = df.sparkSession
    before = spark.conf.get(_PLAN_FIELDS)
    spark.conf.set(_PLAN_FIELDS, str(1 << 20))  # else long plans are cut and look alike
    try:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        spark.conf.set(_PLAN_FIELDS, before)
    paths = sorted(df.inputFiles())
    if not paths or any(leaf in plan for leaf in _UNKNOWN) or not _deterministic(df):
        return None
    files = spark.read.format("binaryFile").load(paths).select(
        "path", "length", "modificationTime"
    )
    content = [plan, str(df._jdf.semanticHash()), *map(str, sorted(map(tuple, files.collect())))]
    return hashlib.sha256("\n".join(content).encode()).hexdigest()


def _deterministic(df: DataFrame) -> bool:
    return bool(df._jdf.queryExecution().optimizedPlan().deterministic())


class NamedStages:
    """Relations that are written once under a name, and found again by later calls and runs.

    A relation is the same if its plan is and if the files it reads have not changed since. One
    whose content cannot be told (rows of the driver, Python functions, random values) is written
    anew each time. ``drop`` deletes what this object has written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/named"
        self.written: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{_fingerprint(df) or uuid.uuid4().hex}"
        if not self._exists(f"{path}/_SUCCESS"):  # absent too if a write broke off
            df.write.mode("overwrite").parquet(path)
            self.written.append(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        for path in self.written:
            self._file(path)[0].delete(self._file(path)[1], True)
        self.written = []

    def _file(self, path: str):
        context = self.spark.sparkContext
        file = context._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(context._jsc.hadoopConfiguration()), file

    def _exists(self, path: str) -> bool:
        system, file = self._file(path)
        return bool(system.exists(file))
