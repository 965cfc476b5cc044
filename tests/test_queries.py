"""Every query of the catalog against its SQL, at the smallest scale."""

import glob
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from gapwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, (str, bool)) else float(v)

    return sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in catalog.SQL:
        assert rows(found) == rows(duck.execute(catalog.SQL[name]).df())


def test_imputed_tables_are_whole_and_keep_what_was_known(spark):
    holes = catalog._parts_with_nulls(spark, SF).toPandas().set_index("p_partkey")
    for strategy in ("mode", "knn", "mice", "semantic"):
        full = catalog.impute_by(strategy)(spark, SF).toPandas().set_index("p_partkey").loc[holes.index]
        assert not full.isna().any().any()
        for c in ("p_type", "p_brand", "p_size"):
            known = holes[c].notna()
            assert (full[c][known] == holes[c][known]).all(), (strategy, c)


def test_cosines_are_told_for_every_link_of_every_customer(spark):
    found = catalog.QUERIES["neighbour_cosine"](spark, SF).toPandas().sort_values(["src", "rank"])
    links = catalog.QUERIES["knn_graph"](spark, SF).toPandas()
    both = set(zip(links.src, links.dst, strict=True)) | set(zip(links.dst, links.src, strict=True))
    assert len(found) == len(both) and set(zip(found.src, found.dst, strict=True)) == both
    assert found.src.nunique() == spark.read.parquet(f"{SF}/customer.parquet").count()
    x = {r.c_custkey: r.features for r in catalog._encoded_customers(spark, SF).collect()}
    for _, near in found.groupby("src"):
        assert list(near["rank"]) == list(range(1, len(near) + 1))
        assert list(zip(-near.cosine, near.dst, strict=True)) == sorted(zip(-near.cosine, near.dst, strict=True))
    for r in found.itertuples():
        a, b = x[r.src], x[r.dst]
        size = math.hypot(*a) * math.hypot(*b)
        assert abs(r.cosine - (sum(p * q for p, q in zip(a, b, strict=True)) / size if size else 0.0)) < 1e-6
