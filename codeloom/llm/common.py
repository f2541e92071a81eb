"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import shared_dir, workers_find_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of this session that are still there, in the order of their making.
_made: list[str] = []


def clear(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Removes the tables that saved() made, but for the first `since` and the last `but` of them.

    Results read such tables when they are computed: call it once they are written."""
    for p in _made[since : len(_made) - but]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(p)


@contextmanager
def scratch(spark: SparkSession, own: int = 0) -> Iterator[None]:
    """Of the tables that are made inside, and the last `own` made before, the last alone stays."""
    since = len(_made) - own
    yield
    clear(spark, since, 1)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    workers_find_us(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
