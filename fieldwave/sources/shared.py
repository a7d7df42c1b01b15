"""Tables in the folder that the whole cluster shares, where long jobs end the lineage of their parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``, or in a local folder where the session names none and runs locally, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Settings of long jobs; the last one removes a query's shuffle files when it ends, which else stay until the driver happens to collect its garbage.
_LONG_JOBS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def joins_by_shuffle(spark: SparkSession) -> Iterator[None]:
    """While it is open, what is run joins by shuffle, but for one row that asks for it: no table is sent through the driver because its files or its shuffle are small when compressed.

    What a step has shuffled is removed when the step is written.
    """
    before = {k: spark.conf.get(k, None) for k in _LONG_JOBS}
    for k, v in _LONG_JOBS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
