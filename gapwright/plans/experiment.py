"""Runs from a clean table to fairness: one, a batch over seeds and sources, and a sweep over layer counts."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balancing, evaluation, gcn, graph, imputers, metrics, missing, reports
from ..sources import artefacts
from ..sources.artefacts import RunKey
from ..sources.datasets import DatasetSpec

log = logging.getLogger("gapwright")
LAYERS = (3, 4, 5, 6, 7)


def balanced(df: DataFrame, strategy: str, group: str, label: str, id_col: str, protected: str | None, seed: int) -> DataFrame:
    """The table by a balance strategy: no_balance (as it is), twostage, stratified or redistribution."""
    if strategy == "no_balance":
        return df
    if strategy == "twostage":
        if protected is None:
            raise ValueError("two-stage balancing needs the protected group")
        return balancing.two_stage(df, group, protected, label, id_col, seed)
    if strategy == "stratified":
        return balancing.downsample(df, group, id_col, seed)
    if strategy == "redistribution":
        return balancing.redistribute(df, group, id_col, seed)
    raise ValueError(f"unknown balance strategy {strategy!r}")


class Experiment:
    """One clean table (id, columns, sensitive, target) with roles by its spec; artefacts go below root, keyed by run."""

    def __init__(self, clean: DataFrame, spec: DatasetSpec, root: str, id_col: str = "row_id", protected: str | None = None, k: int = 5, **training):
        self.clean, self.spec, self.root, self.id_col, self.protected, self.k, self.training = clean, spec, root, id_col, protected, k, training
        self.spark: SparkSession = clean.sparkSession
        self.numeric = list(spec.numeric)
        self.categorical = [c for c in spec.categorical]

    def key(self, source: str, **more) -> RunKey:
        options = tuple(sorted((k, str(v)) for k, v in {"k": self.k, **self.training}.items()))
        return RunKey.of_source(source, self.spec.name, **more).replace(options=options)

    def splits(self, key: RunKey, force: bool = False) -> DataFrame:
        """(id, features, group, label, split) of the balanced table; nulls in val or test can't arise, as only train is injected."""
        base = RunKey(key.dataset, key.balance, key.seed)

        def make() -> DataFrame:
            labelled = self.clean.withColumns({"label": self.spec.label(), "group": F.col(self.spec.sensitive).cast("string")})
            rows = balanced(labelled, key.balance, "group", "label", self.id_col, self.protected, key.seed)
            return balancing.stratified_split(rows, ["group", "label"], self.id_col, key.seed)

        return artefacts.cached(self.spark, base.path(self.root, "splits"), make, force)

    def rows(self, key: RunKey, force: bool = False) -> DataFrame:
        """The splits with injected and imputed training rows, as the key says."""
        whole = self.splits(key, force)
        if not key.rate:
            return whole
        train = whole.where("split = 'train'")
        holes = missing.inject(train, [*self.categorical, *self.numeric], key.rate, self.id_col, key.seed)
        rest = whole.where("split <> 'train'")
        if key.strategy == "none":
            return graph.stack_splits({"train": holes}).unionByName(rest)
        path = key.path(self.root, "imputed")
        own = [self.id_col, *self.categorical, *self.numeric]
        filled = artefacts.cached(self.spark, path, lambda: imputers.impute(holes.select(*own), key.strategy, self.id_col, self.categorical, self.numeric), force)
        return train.select(self.id_col, "group", "label", "split").join(filled, self.id_col).unionByName(rest, allowMissingColumns=True)

    def graph(self, key: RunKey, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        path = key.path(self.root, "graph")
        if force or not artefacts.exists(self.spark, f"{path}/metadata/_SUCCESS"):
            rows = self.rows(key, force)
            encoded = graph.encode(rows, self.id_col, self.categorical, self.numeric)
            told = rows.select(F.col(self.id_col).alias("_id"), "group", "label", "split")
            nodes = encoded.join(told, encoded[self.id_col] == told["_id"]).select(F.col(self.id_col).cast("long").alias("id"), "features", "mask", "group", "label", "split")
            edges = graph.or_chain(graph.symmetric(graph.nearest(nodes, "id", self.k)), nodes, "id")
            names = [*self.categorical, *self.numeric]
            nodes = graph.with_indicators(nodes)
            artefacts.write_graph(nodes, edges, graph.metadata(nodes, edges, self.k, [*names, *(f"{c}_nan" for c in names)]), path)
        return artefacts.read_graph(self.spark, path)

    def run(self, source: str, force_graph: bool = False, force_train: bool = False, layers: int | None = None, **more) -> dict:
        """One run: a batch row of metrics and fairness on test nodes; artefacts of earlier runs of the same key are reused."""
        began, key = time.time(), self.key(source, **more)
        options = dict(self.training) | ({"layers": layers, "seed": hash((key.seed, layers)) % 2**31} if layers else {"seed": key.seed})
        nodes, edges, _ = self.graph(key, force_graph)
        weights, loaded = artefacts.checkpointed(self.spark, key.path(self.root, f"model_{layers or 'default'}"), lambda: gcn.fit(nodes, edges, **options), force_train)
        preds = gcn.predict(nodes, edges, weights)
        log.info("%s: weights %s", key.source, "loaded" if loaded else "trained")
        by_split = {r.split: r for r in metrics.split_metrics(preds).collect()}  # a row a split
        tested = preds.where("split = 'test'").join(nodes.select("id", F.col("group").alias("g")), "id")
        groups = metrics.fairness_groups(tested)
        each, gaps = groups.collect(), metrics.fairness_gaps(groups).first()  # a row a group
        test = by_split.get("test")
        of = lambda c: {r.g: r[c] for r in each}
        return {"seed": key.seed, "source": key.source, "imputation": key.strategy, "test_acc": test and test.acc, "test_f1": test and test.f1_macro, "test_auc": test and test.roc_auc, "pre": of("rate_pre"), "dp_pre": gaps.dp_pre, "post": of("rate_post"), "dp_post": gaps.dp_post, "tpr": of("tpr"), "fpr": of("fpr"), "tpr_parity_gap": gaps.tpr_gap, "fpr_parity_gap": gaps.fpr_gap, "equal_opportunity_diff": gaps.equal_opportunity, "equalized_odds_diff": gaps.equalised_odds, "elapsed_sec": round(time.time() - began, 1), "error": None}

    def batch(self, sources: list[str], seeds: list[int], **more) -> DataFrame:
        """run() for all seeds and sources; one that fails gives a row with its error."""
        rows = []
        for seed in seeds:
            for source in sources:
                try:
                    rows.append(self.run(source, seed=seed, **more))
                except Exception as e:  # a run that fails must not end the others; its row says why
                    log.exception("%s, seed %s", source, seed)
                    rows.append({"seed": seed, "source": source, "imputation": "", "error": str(e).splitlines()[0][:500]})
        return reports.batch_rows(self.spark, rows)

    def sweep(self, sources: list[str], layers: tuple[int, ...] = LAYERS, seeds: tuple[int, ...] = (42,)) -> DataFrame:
        """A row with no_layers for each seed, source and layer count; the graph is built once a source."""
        rows = [self.run(s, layers=n, seed=seed) | {"no_layers": n} for seed in seeds for s in sources for n in layers]
        out = reports.batch_rows(self.spark, rows)
        told = self.spark.createDataFrame([(r["seed"], r["source"], r["no_layers"], r["elapsed_sec"]) for r in rows], "seed int, source string, no_layers int, elapsed_sec double")
        return out.join(told, ["seed", "source", "elapsed_sec"]).dropDuplicates(["seed", "source", "no_layers"])

    def evaluation(self, rates: list[int], strategies: list[str], seed: int = 42, balance: str = "no_balance") -> tuple[DataFrame, list[dict]]:
        """The imputation report over rates and strategies, and the log of the runs."""
        cols = [self.id_col, *self.categorical, *self.numeric]
        train = self.splits(RunKey(self.spec.name, balance, seed)).where("split = 'train'").select(*cols)
        holes = missing.inject_rates(train, cols[1:], rates, self.id_col, seed)
        filled, runs = evaluation.impute_all(holes, strategies, self.id_col, self.categorical, self.numeric)
        return evaluation.evaluate_all(train, holes, filled, self.id_col, self.categorical, self.numeric, self.spec.name, seed), runs


COMMANDS: dict[str, Callable] = {}


def command(f: Callable) -> Callable:
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


@command
def main_run(e: Experiment, a) -> DataFrame:
    return reports.batch_rows(e.spark, [e.run(s, a.force_graph, a.force_train, balance=a.balance, seed=a.seeds[0]) for s in a.sources[:1]])


@command
def batch(e: Experiment, a) -> DataFrame:
    return reports.comparison(e.batch(a.sources, a.seeds, force_graph=a.force_graph, force_train=a.force_train, balance=a.balance))


@command
def layers(e: Experiment, a) -> DataFrame:
    return e.sweep(a.sources, tuple(a.layers), tuple(a.seeds))


@command
def split(e: Experiment, a) -> DataFrame:
    return e.splits(e.key("clean", balance=a.balance, seed=a.seeds[0]), not a.skip_download).groupBy("split", "group", "label").count()


@command
def inject(e: Experiment, a) -> DataFrame:
    cols = [c for c in (*e.categorical, *e.numeric) if c not in a.exclude]
    seeds = a.seeds[:1] if a.single_seed else a.seeds
    train = e.splits(e.key("clean", balance=a.balance, seed=seeds[0])).where("split = 'train'")
    return missing.missing_summary(missing.inject_seeds(train, cols, a.rates, e.id_col, seeds), cols)


@command
def impute(e: Experiment, a) -> DataFrame:
    runs = [r | {"seed": s} for s in (a.seeds[:1] if a.single_seed else a.seeds) for r in e.evaluation(a.rates, a.strategies, s, a.balance)[1]]
    return e.spark.createDataFrame(runs, "error string, nulls_after long, nulls_before long, rate int, seed int, strategy string")


@command
def evaluate(e: Experiment, a) -> DataFrame:
    report, _ = e.evaluation(a.rates, a.strategies, a.seeds[0], a.balance)
    path = e.key("clean").path(e.root, "imputation_evaluation")
    report.write.mode("overwrite").csv(path, header=True) if a.overwrite else artefacts.append_csv(report, path)
    return report


@command
def build_graph(e: Experiment, a) -> DataFrame:
    return e.graph(e.key(a.sources[0], balance=a.balance, seed=a.seeds[0]), a.force_graph)[2]


@command
def train(e: Experiment, a) -> DataFrame:
    nodes, edges, _ = e.graph(e.key(a.sources[0], balance=a.balance, seed=a.seeds[0]))
    return gcn.fit(nodes, edges, **e.training).history
