"""Published counts, hand-checked values and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.functions.ranking import with_rank
from gapwright.operators import balancing, components, graph, imputers, metrics, missing
from gapwright.sources import datasets

COUNTS = [("Female", 1, 1, 80), ("Female", 1, 0, 87), ("Female", 0, 1, 414), ("Female", 0, 0, 886), ("Male", 1, 1, 62), ("Male", 1, 0, 105), ("Male", 0, 1, 420), ("Male", 0, 0, 881)]


@pytest.fixture(scope="module")
def preds(spark):
    rows = [(g, a, b) for g, a, b, n in COUNTS for _ in range(n)]
    return spark.createDataFrame(rows, "g string, y_true int, y_pred int").cache()


def test_published_fairness(preds):
    groups = metrics.fairness_groups(preds)
    by = {r.g: r for r in groups.collect()}
    assert (by["Female"].tpr, by["Male"].tpr, by["Female"].fpr, by["Male"].fpr) == (0.479042, 0.371257, 0.318462, 0.322829)
    gaps = metrics.fairness_gaps(groups).first()
    assert (gaps.dp_pre, gaps.di_pre, gaps.dp_post, gaps.di_post) == (0.000078, 0.999315, 0.008404, 0.975043)
    assert (gaps.tpr_gap, gaps.fpr_gap, gaps.equal_opportunity, gaps.equalised_odds) == (0.107785, 0.004367, 0.107785, 0.107785)


def test_published_classification(preds):
    m = metrics.binary_metrics(preds).first()
    assert (round(m.accuracy, 4), round(m.f1_macro, 4), round(m.f1_weighted, 4)) == (0.6504, 0.4959, 0.7115)
    by = {r["class"]: r for r in metrics.class_report(preds).collect()}
    assert [round(by[1][k], 4) for k in ("precision", "recall", "f1")] == [0.1455, 0.4251, 0.2168] and by[0].support == 2601


def test_published_total_of_scores(spark):
    names = ["age", "education_num", "capital_gain", "capital_loss", "hours_per_week"]
    rows = [(c, "num", 1369, m, round(m / 1369, 6), s) for c, m, s in zip(names, (7, 50, 967, 1116, 68), (0.846911, 0.873555, 0.989859, 0.972478, 0.914862))]
    each = spark.createDataFrame(rows, "column string, col_type string, n_imputed long, exact_matches long, exact_match_rate double, sem_sim_mean double")
    total = missing.with_total(each).where("column = '_ALL_'").first()
    assert (total.n_imputed, total.exact_matches, total.exact_match_rate, total.sem_sim_mean) == (6845, 2208, 0.322571, 0.919533)


def test_auc(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]
    assert metrics.roc_auc(spark.createDataFrame(rows, "y_true int, score double")).first().auc == 0.75
    assert metrics.roc_auc(spark.createDataFrame([(0, 1.0), (1, 1.0)], "y_true int, score double")).first().auc == 0.5
    assert metrics.roc_auc(spark.createDataFrame([(1, 1.0)], "y_true int, score double")).first().auc is None


def test_null_aware_distance(spark):
    x = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 2], [0, 0, 0], [1, 1, 0]], float)
    o = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 1], [0, 0, 0], [1, 1, 0]], bool)
    got = graph.null_aware_distances(x, o, x, o)
    want = [[0, 1, 2.828427, 0, 1.414214], [1, 0, 2, 0, 0], [2.828427, 2, 0, 0, 1], [0, 0, 0, np.inf, 0], [1.414214, 0, 1, 0, 0]]
    assert np.allclose(got, want, atol=1e-6)


def test_propagation_of_a_path(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "id long, x double")
    edges = graph.symmetric(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    assert {r.id: r.x for r in graph.propagate(nodes, edges, "x").collect()} == {0: 0.908248, 1: 1.14983, 2: 0.908248}


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 11), (11, 10)], "src long, dst long")
    got = {r.id: r.component for r in components.components(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}


def test_split_sizes_and_ranks(spark):
    df = spark.range(1500).withColumn("g", F.lit("a"))
    sizes = {r["split"]: r["count"] for r in balancing.stratified_split(df, ["g"], "id").groupBy("split").count().collect()}
    assert sizes == {"train": 1050, "val": 225, "test": 225}
    ranks = sorted(r.rn for r in with_rank(df, ["g"], 1, "t", "id").collect())
    assert ranks == list(range(1, 1501))


def test_two_stage_gap_is_zero(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'f', 'm') as g", "cast(id % 7 < if(id % 3 = 0, 2, 4) as int) as y")
    rates = {r.g: (r.n, r.rate) for r in balancing.group_report(balancing.two_stage(df, "g", "f", "y", "id"), "g", "y").collect()}
    assert rates["f"] == rates["m"]


def test_injection_nests_and_spreads(spark):
    df = spark.range(200).selectExpr("id", "cast(id as double) as a", "cast(id as string) as b")
    five, ten = (missing.inject(df, ["a", "b"], r, "id").toPandas().set_index("id") for r in (5, 10))
    assert five.a.isna().sum() == 10 and ten.a.isna().sum() == 20 and ten.b.isna().sum() == 20
    assert set(five.index[five.a.isna()]) <= set(ten.index[ten.a.isna()])
    assert not (ten.a.isna() & ten.b.isna()).any()
    with pytest.raises(ValueError):
        missing.inject(df, ["a"], 0, "id")


def test_simple_imputation_and_ratio(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 2), (3, "b", 4), (4, "a", 10), (5, None, None)], "id long, c string, x long")
    last = missing.impute_simple(df, ["c"], ["x"]).where("id = 5").first()
    assert (last.c, last.x) == ("a", 3)
    pairs = spark.createDataFrame([("Private", "Private"), ("Private", "Self-emp"), ("Bachelors", "Masters"), ("", "x")], "a string, b string")
    assert [round(r[0], 6) for r in pairs.select(missing.string_ratio("a", "b")).collect()] == [1.0, 0.133333, 0.5, 0.0]
    with pytest.raises(ValueError):
        imputers.impute(df, "unknown", "id", ["c"], ["x"])


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b", 1.0, "train"), (2, "a", 3.0, "train"), (3, None, None, "test"), (4, "z", 3.0, "test")], "id long, c string, x double, split string")
    got = {r.id: list(r.features) for r in graph.encode(df, "id", ["c"], ["x"]).collect()}
    assert got == {1: [1.0, -1.0], 2: [0.0, 1.0], 3: [-1.0, 0.0], 4: [0.0, 1.0]}


def test_raw_files(spark, tmp_path):
    spec = datasets.DatasetSpec("d", ("a", "b"), ("a",), "b", "y", "b")
    df = spark.createDataFrame([(1.0, "y"), (None, "n")], spec.schema)
    datasets.write_raw(df, spec, str(tmp_path / "raw"))
    back = datasets.read_table(spark, spec, str(tmp_path / "raw"), header=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sorted(r[0] for r in back.select(spec.label()).collect()) == [0, 1]


def test_ranks_of_a_node_of_many_links_go_on_from_range_to_range(spark):
    nodes = spark.range(3000).select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("features"))
    edges = graph.symmetric(spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.neighbour_cosine(nodes, edges).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cosine = lambda i: round(1 / math.sqrt(1 + (i % 7) ** 2), 6)
    want = [(0, i, cosine(i), n + 1) for n, i in enumerate(sorted(range(1, 3000), key=lambda i: (-cosine(i), i)))]
    assert sorted(map(tuple, got)) == sorted(want + [(i, 0, cosine(i), 1) for i in range(1, 3000)])
