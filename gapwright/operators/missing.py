"""Null injection, simple imputation and the scores of imputed cells."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import cut_offs, up_to


def check_rates(rates: list[int]) -> None:
    """Rates are whole per cents between 0 and 100, each larger than the one before."""
    if not rates or any(not isinstance(r, int) or not 0 < r < 100 for r in rates) or any(a >= b for a, b in zip(rates, rates[1:], strict=False)):
        raise ValueError(f"rates must be ascending whole numbers between 0 and 100: {rates}")


def check_columns(df: DataFrame, columns: list[str], target: str | None = None) -> None:
    """Columns that injection may empty exist and don't hold the target."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    if target in columns:
        raise ValueError(f"the target {target!r} takes no nulls")


def inject_rates(df: DataFrame, columns: list[str], rates: list[int], id_col: str, seed: int = 42) -> dict[int, DataFrame]:
    """rate -> df with round(n rate / 100) cells of each column set to null (ties to even); nulls of df don't count.

    Cells of a rate are empty at all higher ones. Columns follow one another: the cells that a rate adds go to the rows
    with the fewest nulls so far, at random among these. Rows are read to place the cuts; each result is a projection.
    """
    check_rates(rates)
    check_columns(df, columns)
    n, kept, out = df.count(), df.columns, {}
    state = df.withColumn("_nulls", F.lit(0))
    done = dict.fromkeys(columns, 0)
    for rate in rates:
        need = round(n * rate / 100)
        for c in columns:
            there, tag = F.col(c).isNotNull(), c if rate == rates[0] else f"{c}:{rate}"
            cut = cut_offs(state, {tag: (need - done[c], there)}, seed, id_col, F.col("_nulls")).get(tag)
            picked = there & (up_to(cut, seed, tag, id_col, F.col("_nulls")) if need > done[c] else F.lit(False))
            state = state.select("*", picked.alias("_picked")).withColumns({c: F.when(~F.col("_picked"), F.col(c)), "_nulls": F.col("_nulls") + F.col("_picked").cast("int")}).drop("_picked")
            done[c] = need
        out[rate] = state.select(*kept)
    return out


def inject(df: DataFrame, columns: list[str], rate: int, id_col: str, seed: int = 42) -> DataFrame:
    """inject_rates() at one rate."""
    return inject_rates(df, columns, [rate], id_col, seed)[rate]


def inject_seeds(df: DataFrame, columns: list[str], rates: list[int], id_col: str, seeds: list[int]) -> DataFrame:
    """All seeds and rates as one table with the columns seed and rate."""
    parts = [f.select(F.lit(s).alias("seed"), F.lit(r).alias("rate"), "*") for s in seeds for r, f in inject_rates(df, columns, rates, id_col, s).items()]
    return reduce(DataFrame.unionByName, parts)


def inject_independent(df: DataFrame, columns: list[str], rate: int, id_col: str, seed: int = 42) -> DataFrame:
    """Sets round(n rate / 100) cells of each column to null, completely at random; two scans place the cuts of all columns."""
    check_rates([rate])
    check_columns(df, columns)
    need = round(df.count() * rate / 100)
    cuts = cut_offs(df, {c: (need, F.lit(True)) for c in columns}, seed, id_col)
    return df.withColumns({c: F.when(~up_to(cuts[c], seed, c, id_col), F.col(c)) for c in columns if c in cuts})


def verify_injection(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(split, col, n, n_null, rate, as_asked) of the saved splits: val and test must have no nulls."""
    rows = [missing_summary(p, columns).select(F.lit(s).alias("split"), "*") for s, p in parts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("as_asked", (F.col("split") == "train") | (F.col("n_null") == 0))


def nulls_per_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """(nulls, n_rows): how many rows have so many nulls."""
    count = sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int"))
    return df.groupBy(count.alias("nulls")).agg(F.count("*").alias("n_rows"))


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, n, n_null, rate): one row a column."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = counts.unpivot(["n"], columns, "col", "n_null")
    return rows.select("col", "n", "n_null", F.round(F.coalesce(F.try_divide("n_null", "n"), F.lit(0.0)), 6).alias("rate"))


def impute_simple(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Nulls give way to the mode (the smallest at ties) of categorical and the median of numeric columns, which is rounded
    half to even for whole-number columns. A column of nulls stays so."""
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    fills = [F.mode(c, True).alias(c) for c in categorical] + [F.median(c).alias(c) for c in numeric]
    fill = df.agg(*fills).first().asDict()
    out = {}
    for c in (*categorical, *numeric):
        value = fill[c]
        if value is not None:
            value = round(value) if c in whole else value
            out[c] = F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of the stripped strings; null where one is null."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = difflib.SequenceMatcher(None, pair[0].strip(), pair[1].strip()).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def score_cells(truth: DataFrame, injected: DataFrame, imputed: DataFrame, id_col: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """(column, col_type, n_imputed, exact_matches, exact_match_rate, sem_sim_mean): a row for each column and one _ALL_.

    Only cells that injection emptied count. Numeric similarity is 1 - |t - i| / range of the truth, clipped to 0 to 1;
    that of strings is string_ratio. _ALL_ weighs the rounded column means by their cells.
    """
    spans = truth.agg(*((F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric)).first().asDict() if numeric else {}
    t, m, i = truth.alias("t"), injected.alias("m"), imputed.alias("i")
    joined = t.join(m, id_col).join(i, id_col)
    cells = []
    for c in (*categorical, *numeric):
        a, b = F.col(f"t.{c}"), F.col(f"i.{c}")
        if c in numeric:
            a, b = a.try_cast("double"), b.try_cast("double")
            sim = F.greatest(F.least(1 - F.abs(a - b) / F.lit(spans[c] or 1.0), F.lit(1.0)), F.lit(0.0))
            kind, text = "num", (F.lit(None).cast("string"), F.lit(None).cast("string"))
        else:
            sim, kind, text = F.lit(None).cast("double"), "cat", (a.cast("string"), b.cast("string"))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("col_type"), (F.col(f"m.{c}").isNull() & a.isNotNull()).alias("gone"), F.coalesce(a == b, F.lit(False)).alias("exact"), sim.alias("sim"), text[0].alias("a"), text[1].alias("b")))
    long = joined.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("gone")
    # equal pairs of strings are compared once
    pairs = long.groupBy("column", "col_type", "a", "b").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.sum("sim").alias("sim"), F.count("sim").alias("known"))
    pairs = pairs.withColumn("r", F.when(F.col("col_type") == "cat", string_ratio("a", "b")))
    each = pairs.groupBy("column", "col_type").agg(F.sum("n").alias("n_imputed"), F.sum("exact").alias("exact_matches"), F.round(F.coalesce(F.sum("sim"), F.sum(F.col("r") * F.col("n"))) / F.when(F.first("col_type") == "num", F.sum("known")).otherwise(F.sum(F.when(F.col("r").isNotNull(), F.col("n")))), 6).alias("sem_sim_mean"))
    return with_total(each.select("column", "col_type", "n_imputed", "exact_matches", F.round(F.col("exact_matches") / F.col("n_imputed"), 6).alias("exact_match_rate"), "sem_sim_mean"))


def with_total(each: DataFrame) -> DataFrame:
    """The rows of columns and one row _ALL_ of their sums and weighted mean."""
    known = F.when(F.col("sem_sim_mean").isNotNull(), F.col("n_imputed"))
    total = each.agg(F.sum("n_imputed").alias("n_imputed"), F.sum("exact_matches").alias("exact_matches"), F.round(F.sum(F.col("sem_sim_mean") * F.col("n_imputed")) / F.sum(known), 6).alias("sem_sim_mean"))
    row = total.select(F.lit("_ALL_").alias("column"), F.lit("all").alias("col_type"), "n_imputed", "exact_matches", F.round(F.try_divide("exact_matches", "n_imputed"), 6).alias("exact_match_rate"), "sem_sim_mean")
    return each.unionByName(row)
