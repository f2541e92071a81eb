"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_us(spark: SparkSession) -> None:
    """Python workers get this package's place on their path, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    held = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, held)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine that
    names none gets a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        found = tempfile.mkdtemp(prefix="codeloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written as a table in the shared folder, read back: no lineage before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that cut() made, which nothing reads from then on."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/cut-" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
