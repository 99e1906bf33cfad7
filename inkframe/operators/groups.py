"""Dealing groups to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """``df`` by ``keys`` in ``spark.sql.shuffle.partitions`` tasks, or in ``tasks`` if those are more.

    For work in Python that is long for few bytes: adaptive execution goes by bytes and would put all groups into one
    task, but keeps a number that is asked for. Who knows how large the table is tells it by ``tasks``, so that a task doesn't grow with it.
    """
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
