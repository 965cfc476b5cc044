"""Deterministic random order: rows ranked by the md5 of seed, tag and id, without a window over a whole stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, tag: str, id_col: str) -> Column:
    """Hexadecimal digits that order rows at random, alike on every run and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(id_col).cast("string")))


def with_rank(df: DataFrame, by: list[str], seed: int, tag: str, id_col: str, lead: list[str] = ()) -> DataFrame:
    """df with rn, the place of each row in its stratum (from 1), and n, the stratum's rows.

    Rows are ordered by the lead columns, then the draw, then the id. The draw's first digits deal each stratum into 4,096
    even buckets; bucket counts give the places before a bucket, so a stratum of any size is ranked by many tasks.
    """
    keys = [*by, *lead, "_bucket"]
    df = df.withColumn("_draw", draw(seed, tag, id_col)).withColumn("_bucket", F.substring("_draw", 1, 3))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    order = Window.partitionBy(*by).orderBy(*lead, "_bucket")
    told = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.sum("_size").over(order) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("n"))
    inside = Window.partitionBy(*keys).orderBy("_draw", id_col)
    ranked = df.withColumn("_in", F.row_number().over(inside))
    same = [ranked[k].eqNullSafe(told[f"_k_{k}"]) for k in keys]
    joined = ranked.join(told, same).withColumn("rn", F.col("_before") + F.col("_in"))
    return joined.drop("_draw", "_bucket", "_size", "_before", "_in", *(f"_k_{k}" for k in keys))


def cut_offs(df: DataFrame, wanted: dict[str, tuple[int, Column]], seed: int, id_col: str, lead: Column | None = None) -> dict[str, tuple]:
    """tag -> (lead, draw, id) of the row that is the n-th by lead, draw and id, for wanted[tag] = (n, condition on rows).

    Two scans whatever the number of tags: one counts leads and buckets of the draws, the other ranks the rows of one
    bucket a tag. Tags whose condition holds for fewer rows are left out, those with n below 1 as well.
    """
    wanted = {t: w for t, w in wanted.items() if w[0] > 0}
    if not wanted:
        return {}
    cells = [F.when(rows, F.struct(F.lit(t).alias("tag"), F.lit(n).alias("need"), (lead if lead is not None else F.lit(0)).alias("lead"), draw(seed, t, id_col).alias("draw"))) for t, (n, rows) in wanted.items()]
    each = df.select(F.col(id_col).alias("id"), F.explode(F.array(*cells)).alias("x")).where("x is not null").select("id", "x.*").withColumn("bucket", F.substring("draw", 1, 4))
    sizes = each.groupBy("tag", "need", "lead", "bucket").agg(F.count("*").alias("rows"))  # 65,536 a tag and lead at most
    upto = sizes.withColumn("upto", F.sum("rows").over(Window.partitionBy("tag").orderBy("lead", "bucket")))
    cuts = upto.where("upto >= need and upto - rows < need").select("tag", "lead", "bucket", (F.col("need") - F.col("upto") + F.col("rows")).alias("nth")).collect()  # a row a tag
    if not cuts:
        return {}
    here = reduce(lambda a, b: a | b, ((F.col("tag") == c.tag) & (F.col("lead") == c.lead) & (F.col("bucket") == c.bucket) for c in cuts))
    place = F.row_number().over(Window.partitionBy("tag").orderBy("draw", "id"))
    nth = reduce(lambda a, b: a | b, ((F.col("tag") == c.tag) & (F.col("rn") == c.nth) for c in cuts))
    return {r.tag: (r["lead"], r.draw, r.id) for r in each.where(here).withColumn("rn", place).where(nth).collect()}


def up_to(cut: tuple | None, seed: int, tag: str, id_col: str, lead: Column | None = None) -> Column:
    """Whether a row stands at the cut of cut_offs() or before; without a cut all rows do."""
    if cut is None:
        return F.lit(True)
    own = draw(seed, tag, id_col)
    here = (own < cut[1]) | ((own == cut[1]) & (F.col(id_col) <= F.lit(cut[2])))
    return here if lead is None else (lead < cut[0]) | ((lead == cut[0]) & here)
