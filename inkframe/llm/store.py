"""Where intermediate tables go, and a join that no hot key makes uneven."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has over 1 / HOT_KEYS of the rows, so there are fewer than HOT_KEYS; and this many rows at least.
HOT_KEYS, LEAST_HOT = 1000, 64


#: What this process has written, by session: removed by ``clean``.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where everything runs in one process is one made up."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="inkframe-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Removes all intermediate tables of this process, once its results have been consumed; how many there were."""
    n = len(_written)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, h: str, total: int, size: int) -> DataFrame:
    """About ``size`` of ``total`` rows, by their hash ``h`` (long); the same rows in any partitioning.

    Twice ``size`` is never exceeded, and no task passes on more than its share, unlike a sort with a limit.
    """
    if total <= size:
        return df
    return df.where(F.pmod(F.col(h), F.lit(1 << 30)) < F.lit(int(size / total * (1 << 30)))).limit(2 * size)


def hot_keys(small: DataFrame, weight: str, least: int = LEAST_HOT) -> DataFrame:
    """The rows of ``small`` (one a key) whose ``weight`` is over 1 / HOT_KEYS of the sum: fewer than HOT_KEYS, safe to broadcast."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    return small.where(F.col(weight) > max(least, total // HOT_KEYS))


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, least: int = LEAST_HOT) -> DataFrame:
    """Inner equi-join of ``big`` with ``small`` (one row a key) that no single key can make uneven.

    ``weight`` is how many rows of ``big`` each key of ``small`` has. Hot keys are broadcast and joined
    where they lie; the others shuffle, and none of those has both more than ``least`` rows and more than
    1 / HOT_KEYS of all. ``big`` and ``small`` are read more than once and should be written tables.
    """
    hot = hot_keys(small, weight, least)
    keys = F.broadcast(hot.select(key))
    near = big.join(F.broadcast(hot), key)
    far = big.join(keys, key, "left_anti").join(small.join(keys, key, "left_anti").hint("shuffle_merge"), key)
    return near.unionByName(far)
