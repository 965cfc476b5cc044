"""Tables that cut lineage: written below spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this machine only where that is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gapwright-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df once and returns the written table. Lost executors cost no recomputation beyond it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._gapwright_path = path
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing will read again."""
    for table in tables:
        path = getattr(table, "_gapwright_path", None)
        if path:
            spark = table.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
