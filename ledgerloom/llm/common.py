"""Session helpers of the operators: checkpoints in the shared folder, partition counts, row keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder and read back, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one on a single machine (as in
    tests); on a cluster that is an error, since such a folder would lose rows there."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints")


#: A group of more than 1 / HOT of all rows is hot; there are fewer than HOT of them.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], copies: str, total: int) -> DataFrame:
    """rows inner-joined with groups on on, which is unique in groups and never null; copies is a column of groups with its number of rows out of
    total. The hot groups, fewer than HOT, are broadcast; the others are joined by a shuffle, so no task gets more than a small share."""
    limit = total // HOT + 1
    hot = saved(groups.where(F.col(copies) > limit))
    if not hot.take(1):
        return rows.join(groups, on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(groups.where(F.col(copies) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


REPEATS = 1024


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of df as often as its column times says. Rows repeated very often are first cut into runs of REPEATS, which are dealt to all tasks."""
    few = df.where(F.col(times) <= REPEATS).withColumn("_run", F.col(times))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEATS).cast("long")))
    many = df.where(F.col(times) > REPEATS).withColumn("_at", runs).repartition("_at", *[c for c, t in df.dtypes if t in ("bigint", "int")][:1])
    many = many.withColumn("_run", F.least(F.lit(REPEATS).cast("long"), F.col(times) - F.col("_at") * REPEATS)).drop("_at")
    return few.unionByName(many).withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_run")))).drop("_run", "_one")


#: Bytes of rows that cross to a Python worker at once: memory then follows the longest text, not the number of rows in a batch.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES (a smaller setting stays)."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
