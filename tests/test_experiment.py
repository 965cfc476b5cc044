"""Injection over rates, semantic phases, evaluation, artefacts, fits and whole runs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright import __main__ as shell
from gapwright.operators import evaluation, gcn, graph, imputers, missing, reports
from gapwright.sources import artefacts

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"k{rng.integers(4)}", int(rng.integers(30)), float(rng.integers(900)) / 10) for i in range(90)]
    return spark.createDataFrame(rows, "id long, a string, b int, c double").coalesce(2)


def empty_cells(df):
    return {(r.id, c) for r in df.collect() for c in COLS if r[c] is None}


def test_lower_rates_are_subsets_in_all_columns(table):
    frames = missing.inject_rates(table, COLS, [10, 25, 60], "id", seed=3)
    cells = {r: empty_cells(f) for r, f in frames.items()}
    assert cells[10] < cells[25] < cells[60]
    for r, own in cells.items():
        assert all(sum(c == col for _, c in own) == round(90 * r / 100) for col in COLS)
    assert max(sum(i == row for i, _ in cells[25]) for row in range(90)) == 1  # spread: no row takes two while others have none
    for bad in ([], [0], [20, 10], [5.5]):
        with pytest.raises(ValueError):
            missing.inject_rates(table, COLS, bad, "id")
    with pytest.raises(ValueError):
        missing.check_columns(table, ["a"], target="a")


def plain_semantic(rows, k, local, embed):
    """The four phases over lists of rows (id, a, b, c) in plain Python; ties as in the operator."""
    rows = [list(r) for r in rows]

    def near(now, most):
        texts = [" ".join("" if v is None else repr(v) if isinstance(v, float) else str(v) for v in r[1:]) for r in now]
        v = embed(texts)
        sims = np.round(v @ v.T, 9)
        return [sorted((j for j in range(len(now)) if j != i), key=lambda j: (-sims[i, j], now[j][0]))[:most] for i in range(len(now))], sims

    order, sims = near(rows, k)
    new = [list(r) for r in rows]
    for i, r in enumerate(rows):
        if r[1] is None:
            have = [j for j in order[i] if rows[j][1] is not None]
            copy = [j for j in have if sims[i, j] >= imputers.COPY]
            votes = {}
            for j in have:
                if sims[i, j] >= imputers.VOTE:
                    votes[rows[j][1]] = votes.get(rows[j][1], 0.0) + sims[i, j]
            new[i][1] = rows[copy[0]][1] if copy else max(votes, key=votes.get) if votes else None
    rows, (order, sims) = new, near(new, k)
    new = [list(r) for r in rows]
    for i, r in enumerate(rows):
        for c in (2, 3):
            have = [j for j in order[i] if rows[j][c] is not None and sims[i, j] >= imputers.VOTE]
            if r[c] is None and have:
                value = sum(rows[j][c] * sims[i, j] for j in have) / sum(sims[i, j] for j in have)
                new[i][c] = round(value) if c == 2 else value
    rows, (order, sims) = new, near(new, local)
    new = [list(r) for r in rows]
    for i, r in enumerate(rows):
        for c in (1, 2, 3):
            have = [rows[j][c] for j in order[i] if rows[j][c] is not None]
            if r[c] is None and have:
                new[i][c] = max(sorted(set(have)), key=have.count) if c == 1 else round(float(np.median(have))) if c == 2 else float(np.median(have))
    return {r[0]: r[1:] for r in new}


def test_semantic_phases_equal_plain_ones(spark, table):
    holes = missing.inject(table, COLS, 20, "id")
    stats = []

    def embed(texts):  # without the last column, as engines write long fractions differently
        return imputers.hashed_embedding([" ".join(t.split(" ")[:2]) for t in texts])

    got = {r.id: [r.a, r.b, r.c] for r in imputers.impute_semantic(holes, "id", ["a"], ["b", "c"], embed, k=12, local=6, block=40, stats=stats).collect()}
    expected = plain_semantic([tuple(r) for r in holes.orderBy("id").collect()], 12, 6, embed)
    assert {i: (v[0], v[1]) for i, v in got.items()} == {i: (v[0], v[1]) for i, v in expected.items()}
    assert all(abs(v[2] - expected[i][2]) < 1e-6 for i, v in got.items())
    assert [s["phase"] for s in stats][0] == "categorical" and stats[0]["n_total"] == 90


def test_runs_that_fail_leave_rows_and_the_rest(table):
    holes = missing.inject_rates(table, COLS, [10], "id")
    filled, log = evaluation.impute_all(holes, ["mode", "no such"], "id", ["a"], ["b", "c"])
    assert list(filled) == [(10, "mode")] and [r["error"] is None for r in log] == [True, False] and log[0]["nulls_before"] == 27 and log[0]["nulls_after"] == 0
    report = evaluation.evaluate_all(table, holes, filled, "id", ["a"], ["b", "c"], "t", 42)
    assert tuple(report.columns) == evaluation.REPORT
    rows = {r.column: r for r in report.collect()}
    truth, out, gone = ({r.id: r for r in d.collect()} for d in (table, filled[10, "mode"], holes[10]))
    for c in ("b", "c"):
        at = [i for i in gone if gone[i][c] is None]
        span = max(r[c] for r in truth.values()) - min(r[c] for r in truth.values())
        assert rows[c].n_imputed == 9 == len(at) and rows[c].exact_matches == sum(truth[i][c] == out[i][c] for i in at)
        assert abs(rows[c].sem_sim_mean - np.mean([min(max(1 - abs(truth[i][c] - out[i][c]) / span, 0), 1) for i in at])) < 1e-6
    assert rows["_ALL_"].n_imputed == 27
    assert evaluation.evaluate(table, holes[10], table.limit(3), "id", ["a"], [], rate=1) is None
    assert [r.column for r in evaluation.ranked_columns(report).collect()][0] == max("abc", key=lambda c: (rows[c].exact_match_rate, -ord(c)))


def test_saved_weights_predict_alike(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), np.arange(60) % 3
    x[np.arange(60), y] += 3
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), ("train", "val", "test")[i % 5 % 3]) for i in range(60)], "id long, features array<double>, label int, split string")
    edges = graph.symmetric(graph.nearest(nodes.withColumn("mask", F.transform("features", lambda v: F.lit(False))), "id", 3))
    fit = gcn.fit(nodes, edges, layers=1, hidden=8, epochs=25)
    assert fit.parameters == 4 * 8 + 8 + 8 * 3 + 3 and fit.history.count() == 25
    best = fit.history.orderBy(F.col("val_acc").desc(), "epoch").first()
    assert best.epoch == fit.best_epoch
    path = str(tmp_path / "model")
    weights, loaded = artefacts.checkpointed(spark, path, lambda: fit)
    again, told = artefacts.checkpointed(spark, path, lambda: pytest.fail("trained again"))
    assert (loaded, told) == (False, True)
    assert gcn.predict(nodes, edges, again).orderBy("id").collect() == fit.predictions.orderBy("id").collect()
    assert sum(r.y_true == r.y_pred for r in fit.predictions.collect()) > 45


def test_gradient_step_lowers_the_loss(spark):
    """With one class apart and no dropout the loss falls below that of a coin."""
    nodes = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2, "train") for i in range(20)], "id long, features array<double>, label int, split string")
    edges = spark.createDataFrame([(i, (i + 2) % 20) for i in range(20)], "src long, dst long")
    losses = [r.loss for r in gcn.fit(nodes, graph.symmetric(edges), layers=1, hidden=8, epochs=60, dropout=0.0).history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] / 2


def test_sources_and_keys(spark, tmp_path):
    key = artefacts.RunKey.of_source("mcar_10_knn", "adult")
    assert (key.rate, key.strategy, key.source) == (10, "knn", "mcar_10_knn") and key.replace(seed=1).path("/r", "x") != key.path("/r", "x")
    for bad in ("mcar_ten", "mcar_10_magic", "dirty"):
        with pytest.raises(ValueError):
            artefacts.RunKey.of_source(bad, "adult")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "seed int, v string")
    path = str(tmp_path / "runs")
    artefacts.replace_runs(rows, path, ["seed"])
    artefacts.replace_runs(spark.createDataFrame([(2, "z")], "seed int, v string"), path, ["seed"])
    assert {(r.seed, r.v) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "z")}
    csv = str(tmp_path / "csv")
    artefacts.append_csv(rows, csv)
    artefacts.append_csv(rows, csv)
    assert spark.read.csv(csv, header=True).count() == 4
    with pytest.raises(ValueError):
        artefacts.append_csv(rows.select("v", "seed"), csv)
    made = []
    for _ in range(2):
        artefacts.cached(spark, str(tmp_path / "once"), lambda: made.append(1) or rows)
    assert made == [1]
    mapped = artefacts.map_target(rows, "v", {"x": 1, "y": 0})
    assert [r.v for r in mapped.orderBy("seed").collect()] == [1, 0]
    with pytest.raises(Exception, match="no class"):
        artefacts.map_target(rows, "v", {"x": 1}).collect()


def test_shell_runs_a_batch(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    header = ",".join(shell.ADULT.columns)
    lines = [",".join(str(v) for v in (int(rng.integers(20, 60)), "w", "e", int(rng.integers(1, 16)), "m", "o", "r", "x", ("Male", "Female")[i % 2], int(rng.integers(9)), 0, 40, "c", (">50K", "<=50K")[int(rng.integers(2))])) for i in range(80)]
    data = tmp_path / "clean.csv"
    data.write_text("\n".join([header, *lines]) + "\n")
    shell.main(["batch", "--data", str(data), "--root", str(tmp_path / "out"), "--sources", "clean", "mcar_10_mode", "mcar_10_magic", "--epochs", "3", "--log", str(tmp_path / "log")], spark)
    out = capsys.readouterr().out
    assert out.count("|ok") == 2 and "unknown source" in out and (tmp_path / "log").exists()
    assert reports.batch_rows(spark, []).count() == 0


def test_neighbour_sums_in_parts_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    n, src, dst = 300, rng.integers(0, 300, 2000), np.r_[rng.integers(0, 300, 1500), np.zeros(500, int)]
    x, a = rng.normal(size=(n, 4)), np.zeros((n, n))
    np.add.at(a, (np.r_[dst, np.arange(n)], np.r_[src, np.arange(n)]), 1.0)
    degree = np.bincount(np.r_[src, np.arange(n)], minlength=n)
    want = (a / np.sqrt(degree[:, None] * degree[None, :])) @ x
    for part in (4, 64, 100_000):  # node 0 has over 64 x 4 neighbours
        monkeypatch.setattr(gcn, "PART", part)
        assert np.allclose(gcn._matrix(n, src, dst)(x), want)


def test_training_holds_no_object_for_each_value(spark, monkeypatch):
    """The driver's Python took some 100 bytes for each feature and edge end before, and one row of each edge in one array."""
    import tracemalloc

    n = 20_000
    nodes = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("features"), (F.col("id") % 2).cast("int").alias("label"), F.lit("train").alias("split"))
    edges = graph.symmetric(spark.range(n).select(F.col("id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (F.col("id") * i + 1) % n)).alias("dst")))
    tracemalloc.start()
    gcn.fit(nodes, edges, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * n * 64 * 8


def test_training_keeps_no_gradient_of_the_step_before(spark):
    """Seven arrays of a value for each node and feature were held at once from the second epoch on."""
    import tracemalloc

    n = 20_000
    nodes = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("features"), (F.col("id") % 2).cast("int").alias("label"), F.lit("train").alias("split"))
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % n, (F.col("id") + n - 1) % n)).alias("dst"))
    tracemalloc.start()
    gcn.fit(nodes, edges, epochs=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6.5 * n * 64 * 8
