"""Graphs, models and reports on disk. Folders are keyed by run, so that one run's part is replaced without the others."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunKey:
    """What a run depends on; options are all further settings, so that a change of any of them is another run."""

    dataset: str
    balance: str = "no_balance"
    seed: int = 42
    rate: int = 0
    strategy: str = "none"
    options: tuple[tuple[str, str], ...] = ()

    @property
    def source(self) -> str:
        """clean, mcar_<rate> or mcar_<rate>_<strategy>."""
        if not self.rate:
            return "clean"
        return f"mcar_{self.rate}" + (f"_{self.strategy}" if self.strategy != "none" else "")

    @classmethod
    def of_source(cls, source: str, dataset: str, **more) -> RunKey:
        """The key that a source string names; unknown strategies raise."""
        from ..operators.imputers import STRATEGIES

        if source == "clean":
            return cls(dataset, **more)
        word, _, rest = source.partition("_")
        rate, _, strategy = rest.partition("_")
        strategy = strategy or "none"
        if word != "mcar" or not rate.isdigit() or strategy not in STRATEGIES:
            raise ValueError(f"unknown source {source!r}")
        return cls(dataset, rate=int(rate), strategy=strategy, **more)

    def replace(self, **changes) -> RunKey:
        return dataclasses.replace(self, **changes)

    def path(self, root: str, name: str) -> str:
        mark = hashlib.md5(json.dumps(self.options).encode()).hexdigest()[:8]
        return f"{root.rstrip('/')}/{self.dataset}_{self.balance}/{self.seed}_{self.source}_{mark}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written first where it isn't complete (no _SUCCESS) or force is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV table of the same columns in the same order; each part has one header."""
    spark = df.sparkSession
    if exists(spark, path):
        have = spark.read.csv(path, header=True).columns
        if have != df.columns:
            raise ValueError(f"{path} has the columns {have}")
    df.write.mode("append").csv(path, header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    """nodes (features, mask, label, split, group), edges and the metadata document."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta.write.mode("overwrite").json(f"{path}/metadata")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.json(f"{path}/metadata")


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (value) of a report, in order, as one file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def replace_runs(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows below their keys; parts of keys that df holds are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def checkpointed(spark: SparkSession, path: str, fit: Callable, force: bool = False) -> tuple[DataFrame, bool]:
    """Saved weights, and whether they were loaded; fit() trains where there are none or force is set."""
    loaded = not force and exists(spark, f"{path}/_SUCCESS")
    if not loaded:
        fit().weights.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), loaded


def map_target(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Targets as the whole numbers of the mapping; a value that it lacks, null included, raises."""
    pairs = F.create_map(*(F.lit(str(x)) if i % 2 == 0 else F.lit(x) for kv in mapping.items() for i, x in enumerate(kv)))
    value = F.try_element_at(pairs, F.col(column).cast("string"))
    return df.withColumn(column, F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{column} has no class for "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")).otherwise(value.cast("int")))
