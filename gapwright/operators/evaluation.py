"""Imputation over rates and strategies, and the evaluation of what was imputed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import written
from . import imputers, missing

REPORT = ("dataset", "seed", "rate", "strategy", "column", "col_type", "n_imputed", "exact_matches", "exact_match_rate", "sem_sim_mean")


def common_columns(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in the order of the first."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def alignable(*frames: DataFrame) -> bool:
    """Whether the frames have equally many rows; cells are compared only then."""
    return len({f.count() for f in frames}) == 1


def evaluate(truth: DataFrame, injected: DataFrame, imputed: DataFrame, id_col: str, categorical: list[str], numeric: list[str], **run) -> DataFrame | None:
    """The report rows (REPORT) of one run; run holds dataset, seed, rate and strategy. None where row counts differ."""
    if not alignable(truth, injected, imputed):
        return None
    have = common_columns(truth, injected, imputed)
    scores = missing.score_cells(truth, injected, imputed, id_col, [c for c in categorical if c in have], [c for c in numeric if c in have])
    return scores.select(*(F.lit(run.get(k)).alias(k) for k in REPORT[:4]), *REPORT[4:])


def impute_all(injected: dict[int, DataFrame], strategies: list[str], id_col: str, categorical: list[str], numeric: list[str]) -> tuple[dict[tuple[int, str], DataFrame], list[dict]]:
    """((rate, strategy) -> imputed, written; log rows with null counts before and after, or the error of a run that failed)."""
    done, log = {}, []
    cols = [*categorical, *numeric]
    nulls = lambda df: df.agg(sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))).first()[0]
    for rate, frame in injected.items():
        for strategy in strategies:
            row = {"rate": rate, "strategy": strategy, "nulls_before": None, "nulls_after": None, "error": None}
            try:
                out = written(imputers.impute(frame, strategy, id_col, categorical, numeric), f"imputed-{rate}-{strategy}")
                row |= {"nulls_before": nulls(frame), "nulls_after": nulls(out)}
                done[rate, strategy] = out
            except Exception as e:  # a run that fails must not end the others; its row says why
                row["error"] = str(e).splitlines()[0][:500]
            log.append(row)
    return done, log


def evaluate_all(truth: DataFrame, injected: dict[int, DataFrame], imputed: dict[tuple[int, str], DataFrame], id_col: str, categorical: list[str], numeric: list[str], dataset: str, seed: int) -> DataFrame:
    """evaluate() of all runs that are there; runs whose rows differ in number are skipped."""
    parts = [evaluate(truth, injected[r], f, id_col, categorical, numeric, dataset=dataset, seed=seed, rate=r, strategy=s) for (r, s), f in imputed.items()]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def ranked_columns(report: DataFrame, by: str = "exact_match_rate") -> DataFrame:
    """The rows of columns, best first."""
    return report.where("column <> '_ALL_'").orderBy(F.col(by).desc_nulls_last(), "column")


def embedding_similarity(cells: DataFrame, embed: Callable[[list[str]], np.ndarray] = imputers.hashed_embedding) -> DataFrame:
    """cells(column, a, b) with sim, the cosine of the embeddings of the distinct pairs (a, b); null texts are empty."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                u, v = (embed(p[c].fillna("").str.strip().tolist()) for c in ("a", "b"))
                yield p.assign(sim=np.round((u * v).sum(axis=1), 6))

    pairs = cells.groupBy("column", "a", "b").agg(F.count("*").alias("n"))
    return pairs.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pairs.schema)}, sim double")


def similarity_stats(cells: DataFrame) -> DataFrame:
    """(column, n, sim_mean, sim_std): weighted mean and population deviation of embedding_similarity() rows."""
    w, x = F.col("n"), F.col("sim")
    sums = cells.where("sim is not null").groupBy("column").agg(F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("column", "n", F.round(mean, 6).alias("sim_mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("sim_std"))
