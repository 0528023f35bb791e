"""Where lineage is cut: a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, shared by all executors.

    Where the session names none, a local one (as in tests) gets a temporary
    folder; on a cluster, whose executors would not see it, that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


#: The scratch folder of each application.
_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application below the checkpoint folder, deleted when the driver's JVM ends.

    What plans still read can lie there, as no plan outlives the driver.
    """
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        path = f"{checkpoint_folder(spark).rstrip('/')}/run-{application}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _scratch[application] = path
    return _scratch[application]


def _run_folder(spark: SparkSession, run: str | None) -> str:
    """The folder of a named run, which stays, or a new one in the scratch folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/rounds-{run}" if run else f"{scratch(spark)}/rounds-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed and written to the checkpoint folder; plans of a loop start from it.

    A lost executor takes nothing with it, as it would with a local checkpoint.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the rounds in folder that were written to the end."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


class Rounds:
    """The states of a loop, one numbered table a round, of which the last two are kept.

    A named run lies in a folder of that name below the checkpoint folder. Where
    it holds complete rounds, as after a lost driver, the loop goes on from the
    last of them; a round that was cut off is written anew. A run without a name
    gets a folder of its own, which goes with the application. remove() deletes
    all, when the result is written.
    """

    def __init__(self, spark: SparkSession, run: str | None = None):
        self.spark = spark
        self.folder = _run_folder(spark, run)
        found = _complete(spark, self.folder) if run else []
        self.number = found[-1] if found else -1

    def last(self) -> DataFrame | None:
        """The last complete round's state, if there is one."""
        return self.spark.read.parquet(f"{self.folder}/{self.number}") if self.number >= 0 else None

    def settled(self, df: DataFrame) -> DataFrame:
        """df written as the next round and read again; the round before the last goes."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.mode("overwrite").parquet(path)
        if self.number >= 2:
            _remove(self.spark, f"{self.folder}/{self.number - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        _remove(self.spark, self.folder)


def forget_run(spark: SparkSession, run: str) -> None:
    """Delete what a named run left, when its result is written."""
    _remove(spark, _run_folder(spark, run))


class Layers:
    """A table that grows by a layer a round, each written once.

    The layers of a named run that were written to the end are found again, as
    after a lost driver. compact() puts all layers but the last together; where
    it is cut off between writing and deleting, rows are there twice, which the
    sums that layers are for don't change by.
    """

    def __init__(self, spark: SparkSession, run: str | None = None, columns: tuple[str, ...] = ("i", "j", "v")):
        self.spark, self.columns = spark, columns
        self.folder = _run_folder(spark, run)
        self.paths = [f"{self.folder}/{n}" for n in _complete(spark, self.folder)] if run else []
        bases = _complete(spark, f"{self.folder}/base") if run else []
        self.rounds = int(self.paths[-1].rpartition("/")[2]) + 1 if self.paths else 0
        if bases:
            self.paths = [f"{self.folder}/base/{bases[-1]}", *[p for p in self.paths if int(p.rpartition("/")[2]) > bases[-1]]]
        self.count, self.stale, self.rows = len(self.paths), 0, 0
        self.schemas: dict[str, StructType] = {}

    def append(self, df: DataFrame) -> tuple[int, int]:
        """Write df as the next layer: (its rows, those of them where the column improved holds)."""
        path = f"{self.folder}/{self.rounds}"
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        self.schemas[path] = df.schema
        self.rounds, self.count = self.rounds + 1, self.count + 1
        improved = F.count_if("improved") if "improved" in df.columns else F.lit(0)
        rows, better = self.last().agg(F.count("*"), improved).first()
        self.rows += rows
        return rows, better

    def last(self) -> DataFrame:
        return self._read(self.paths[-1])

    def _read(self, path: str) -> DataFrame:
        if path not in self.schemas:
            self.schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[path]).parquet(path)

    def all(self) -> DataFrame:
        """The rows (columns) of all layers."""
        return self._rows(self.paths)

    def _rows(self, paths: list[str]) -> DataFrame:
        return fold(DataFrame.union, [self._read(p).select(*self.columns) for p in paths])

    def compact(self, combine: Callable[[DataFrame], DataFrame]) -> None:
        if self.count < 3:
            return
        *old, last = self.paths
        path = f"{self.folder}/base/{self.rounds - 2}"
        combine(self._rows(old)).write.mode("overwrite").parquet(path)
        for p in old:
            _remove(self.spark, p)
        self.paths, self.count, self.stale = [path, last], 2, 0
        self.rows = self.all().count()
