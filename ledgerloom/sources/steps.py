"""Steps that are written to the shared folder and read again, so that no plan holds an earlier step and a lost executor costs no more than the last one."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a single machine; on a cluster that is an error."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _folders:
        _folders[sc.applicationId] = tempfile.mkdtemp(prefix="steps")
        atexit.register(shutil.rmtree, _folders[sc.applicationId], ignore_errors=True)
    return _folders[sc.applicationId]


def _home(spark: SparkSession) -> str:
    return posixpath.join(shared_folder(spark), f"steps-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_steps(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored. Results that still read them can't be computed any more."""
    _delete(spark, _home(spark))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it later reads the columns it needs, and knows how large it is."""
    return _written(df, posixpath.join(_home(df.sparkSession), uuid.uuid4().hex))


def saved(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, which costs less than a table where steps are many and narrow. Spark's cleaner deletes it if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Rounds:
    """The steps of a loop. Those that the loop needs no longer are deleted by keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, counted: str | None = None) -> tuple[DataFrame, int]:
        """df saved, and for how many of its rows the condition counted holds."""
        path = posixpath.join(_home(self.spark), uuid.uuid4().hex)
        out = _written(df, path)
        self.paths[id(out)] = (out, path)
        return out, out.where(counted).count() if counted else 0

    def keep(self, *tables: DataFrame) -> None:
        """Deletes the steps of this loop but for tables."""
        for key in [k for k in self.paths if not any(k == id(t) for t in tables)]:
            _delete(self.spark, self.paths.pop(key)[1])


@contextmanager
def whole_jobs(spark: SparkSession) -> Iterator[None]:
    """Inside, an action is one job. Adaptive execution runs each shuffle, and a join each broadcast, as a job of its own, which costs more than it gains
    where many small rounds follow each other; both settings are set back afterwards."""
    inside = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
