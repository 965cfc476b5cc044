"""Every registered query and its DuckDB SQL, over the driver's tables in the roles of FIXTURES.md."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import with_rank
from ..operators import balancing, components, evaluation, gcn, graph, imputers, metrics, missing, reports
from ..sources.artefacts import map_target

SEED, RATE, K = 42, 10, 5
PART = (["p_type", "p_brand"], ["p_size", "p_retailprice"])
CUSTOMER = (["c_mktsegment"], ["c_acctbal", "c_nationkey"])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(F.col("lang").alias("g"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"), F.col("n_chars").alias("score"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("o_orderpriority") == "5-LOW", "5-LOW").otherwise("OTHER")
    return _table(spark, sf_dir, "orders").select("o_orderkey", group.alias("g"), (F.col("o_totalprice") > 200000).cast("int").alias("y"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", *PART[0], *PART[1])


def _parts_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.inject_independent(_parts(spark, sf_dir), [*PART[0], *PART[1]], RATE, "p_partkey", SEED)


def _encoded_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", *CUSTOMER[0], *CUSTOMER[1])
    holes = missing.inject_independent(rows, [*CUSTOMER[0], *CUSTOMER[1]], RATE, "c_custkey", SEED)
    return graph.encode(holes, "c_custkey", *CUSTOMER, train="true")


def _customer_graph(spark: SparkSession, sf_dir: str, asked: str = "true") -> DataFrame:
    return graph.nearest(_encoded_customers(spark, sf_dir), "c_custkey", K, asked=asked)


def _vector_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("int").alias("label"))
    nodes = balancing.stratified_split(vectors, ["label"], "id", SEED)
    edges = graph.nearest(nodes.withColumn("mask", F.transform("features", lambda x: F.lit(False))), "id", K)
    return nodes, graph.symmetric(edges)


def gcn_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _vector_graph(spark, sf_dir)
    return gcn.train(nodes, edges, epochs=60)


def gcn_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").alias("value"))
    return graph.propagate(customers, graph.symmetric(_customer_graph(spark, sf_dir)), "value")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    return components.components(nodes, _customer_graph(spark, sf_dir))


def impute_by(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = imputers.impute(_parts_with_nulls(spark, sf_dir), strategy, "p_partkey", *PART)
        return out.select("p_partkey", *PART[0], "p_size", F.round("p_retailprice", 4).alias("p_retailprice"))

    return run


def imputation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, holes = _parts(spark, sf_dir), _parts_with_nulls(spark, sf_dir)
    return missing.score_cells(truth, holes, missing.impute_simple(holes, *PART), "p_partkey", *PART)


def numeric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, holes = _parts(spark, sf_dir), _parts_with_nulls(spark, sf_dir)
    return missing.score_cells(truth, holes, missing.impute_simple(holes, *PART), "p_partkey", [], PART[1])


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _encoded_customers(spark, sf_dir)
    return rows.select("c_custkey", *(F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(3)), *(F.get("mask", F.lit(i)).cast("int").alias(f"m{i}") for i in range(3)))


def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph.cosine_search(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", K)


RATES, SEEDS = [20, 50], [1, 2]


def injected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = missing.inject_rates(_parts(spark, sf_dir), [*PART[0], *PART[1]], RATES, "p_partkey", SEED)
    return reduce(DataFrame.unionByName, (f.withColumn("rate", F.lit(r)) for r, f in frames.items()))


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("label < 8").select(F.col("label").cast("int").alias("y_true"), F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 4)).alias("scores"))


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    third = F.get(F.array(*map(F.lit, reports.PARTS)), (F.col("doc_id") % 3).cast("int"))
    return labels.join(docs, "doc_id").select(third.alias("split"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"), F.col("n_chars").cast("double").alias("p1"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _encoded_customers(spark, sf_dir).select(F.col("c_custkey").cast("long").alias("id"), "features", "mask")
    pairs = _customer_graph(spark, sf_dir, "id <= 50")
    return graph.explain_pairs(nodes, pairs, [*CUSTOMER[0], *CUSTOMER[1]])


def graph_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _encoded_customers(spark, sf_dir).select(F.col("c_custkey").cast("long").alias("id"), "features")
    return graph.neighbour_cosine(nodes, graph.symmetric(_customer_graph(spark, sf_dir)))


def indicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.with_indicators(_encoded_customers(spark, sf_dir))
    return rows.select("c_custkey", *(F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(6)))


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer")
    return graph.or_chain(spark.createDataFrame([], "src long, dst long"), nodes, "c_custkey")


def duplicates_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return graph.match_duplicates(rows, rows.where("c_custkey % 3 = 0"), ["c_mktsegment", "c_nationkey"], "c_custkey", "c_custkey")


def graph_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _vector_graph(spark, sf_dir)
    return graph.metadata(nodes, edges, K, [f"x{i}" for i in range(64)]).select("num_nodes", "num_features", "k_neighbors", F.to_json("split").alias("split"), F.to_json("class_distribution").alias("class_distribution"))


def _runs(spark: SparkSession, sf_dir: str, numeric_only: bool) -> tuple[DataFrame, DataFrame]:
    cat, num = ([], PART[1]) if numeric_only else PART
    truth = _parts(spark, sf_dir)
    holes = missing.inject_rates(truth, [*PART[0], *PART[1]], [10, 20], "p_partkey", SEED)
    filled, log = evaluation.impute_all(holes, ["none", "mode", "unheard-of"], "p_partkey", *PART)
    told = spark.createDataFrame([(r["rate"], r["strategy"], r["nulls_before"], r["nulls_after"], r["error"] is not None) for r in log], "rate int, strategy string, nulls_before long, nulls_after long, failed boolean")
    return evaluation.evaluate_all(truth, holes, filled, "p_partkey", cat, num, "part", SEED), told


def semantic_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats: list[dict] = []
    imputers.impute_semantic(_parts_with_nulls(spark, sf_dir), "p_partkey", *PART, stats=stats)
    return spark.createDataFrame([tuple(r.values()) for r in stats], "phase string, n_total long, n_context int, dim int, avg_norm double, filled long")


def embedded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, holes = _parts(spark, sf_dir), _parts_with_nulls(spark, sf_dir)
    filled = missing.impute_simple(holes, *PART)
    t, m, i = truth.alias("t"), holes.alias("m"), filled.alias("i")
    cells = t.join(m, "p_partkey").join(i, "p_partkey").where("m.p_type is null").select(F.lit("p_type").alias("column"), F.col("t.p_type").alias("a"), F.col("i.p_type").alias("b"))
    return evaluation.similarity_stats(evaluation.embedding_similarity(cells))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table of one run a document source, each judged by its labels; one has failed."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scores = labels.join(docs, "doc_id").groupBy("source").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("acc")).collect()  # a row a source
    rows = [{"seed": SEED, "source": r.source, "imputation": "none", "test_acc": r.acc, "error": None} for r in scores]
    return reports.comparison(reports.batch_rows(spark, [*rows, {"seed": SEED, "source": "mcar_10", "imputation": "knn", "error": "no such file"}]))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    preds = labels.join(docs, "doc_id").select((F.col("doc_id") % 3 + 3).cast("int").alias("no_layers"), F.col("lang").alias("g"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    groups = reduce(DataFrame.unionByName, (metrics.fairness_groups(preds.where(f"no_layers = {n}")).withColumn("no_layers", F.lit(n)) for n in (3, 4, 5)))
    return reports.sweep_rows(groups, "no_layers", ("rate_post", "tpr"))


def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _vector_graph(spark, sf_dir)
    fit = gcn.fit(nodes, edges, epochs=20)
    meta = graph.metadata(nodes, edges, K, [f"x{i}" for i in range(64)])
    return reports.as_json(reports.summary(metrics.split_metrics(fit.predictions), meta, fit.history, dataset="embeddings", source="clean", imputation="none", epochs=20, parameters=fit.parameters))


QUERIES: dict = {
    "fairness_groups": lambda s, d: metrics.fairness_groups(_preds(s, d)),
    "fairness_gaps": lambda s, d: metrics.fairness_gaps(metrics.fairness_groups(_preds(s, d))),
    "class_report": lambda s, d: metrics.class_report(_preds(s, d)).select("class", "precision", "recall", "f1", "support"),
    "binary_metrics": lambda s, d: metrics.binary_metrics(_preds(s, d)),
    "roc_auc": lambda s, d: metrics.roc_auc(_preds(s, d)),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(_preds(s, d)),
    "group_report": lambda s, d: balancing.group_report(_orders(s, d), "g", "y"),
    "stratified_split": lambda s, d: balancing.stratified_split(_orders(s, d), ["g", "y"], "o_orderkey", SEED),
    "balance_two_stage": lambda s, d: balancing.two_stage(_orders(s, d), "g", "5-LOW", "y", "o_orderkey", SEED),
    "balance_downsample": lambda s, d: balancing.downsample(_orders(s, d), "g", "o_orderkey", SEED),
    "balance_redistribute": lambda s, d: balancing.redistribute(_orders(s, d), "g", "o_orderkey", SEED),
    "null_injection": lambda s, d: missing.inject(_parts(s, d), [*PART[0], *PART[1]], RATE, "p_partkey", SEED),
    "null_injection_independent": _parts_with_nulls,
    "missing_summary": lambda s, d: missing.missing_summary(_parts_with_nulls(s, d), [*PART[0], *PART[1]]),
    "impute_mode_median": impute_by("mode"),
    "impute_knn": impute_by("knn"),
    "impute_mice": impute_by("mice"),
    "impute_semantic": impute_by("semantic"),
    "imputation_scores": imputation_scores,
    "imputation_scores_numeric": numeric_scores,
    "encode_features": encoded,
    "knn_graph": lambda s, d: _customer_graph(s, d).withColumn("dist", F.round("dist", 6)),
    "degree_stats": lambda s, d: graph.degree_stats(_table(s, d, "customer"), graph.symmetric(_customer_graph(s, d)), "c_custkey"),
    "graph_components": graph_components,
    "gcn_propagate": gcn_propagate,
    "gcn_train": gcn_train,
    "cosine_neighbours": cosine_neighbours,
    "null_injection_rates": injected_rates,
    "null_injection_seeds": lambda s, d: missing.inject_seeds(_parts(s, d), [*PART[0], *PART[1]], [RATE], "p_partkey", SEEDS),
    "nulls_per_row": lambda s, d: missing.nulls_per_row(_parts_with_nulls(s, d), [*PART[0], *PART[1]]),
    "injection_verified": lambda s, d: missing.verify_injection({"train": _parts_with_nulls(s, d), "val": _parts(s, d)}, [*PART[0], *PART[1]]),
    "class_report_full": lambda s, d: metrics.full_report(_preds(s, d)),
    "class_report_lines": lambda s, d: reports.class_lines(metrics.full_report(_preds(s, d))),
    "multiclass_auc": lambda s, d: metrics.multiclass_auc(class_scores(s, d)),
    "split_metrics": lambda s, d: metrics.split_metrics(split_scores(s, d)),
    "group_gap": lambda s, d: metrics.group_gap(balancing.group_report(_orders(s, d), "g", "y")),
    "groups_by_size": lambda s, d: reports.groups_by_size(_table(s, d, "orders"), "o_orderpriority"),
    "balance_identity": _orders,
    "target_map": lambda s, d: map_target(_table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 0, "O": 1, "P": 2}),
    "shuffle_position": lambda s, d: with_rank(_table(s, d, "customer").select("c_custkey"), [], SEED, "shuffle", "c_custkey").select("c_custkey", F.col("rn").alias("position")),
    "distance_explained": explained,
    "neighbour_cosine": graph_cosines,
    "feature_indicators": indicated,
    "chain_fallback": chained,
    "duplicates_matched": duplicates_matched,
    "graph_metadata": graph_metadata,
    "evaluation_report": lambda s, d: _runs(s, d, False)[0],
    "evaluation_report_numeric": lambda s, d: _runs(s, d, True)[0],
    "evaluation_lines": lambda s, d: reports.evaluation_lines(_runs(s, d, True)[0]),
    "imputation_log": lambda s, d: _runs(s, d, True)[1],
    "columns_by_match": lambda s, d: evaluation.ranked_columns(_runs(s, d, True)[0]),
    "semantic_phases": semantic_phases,
    "embedding_similarity": embedded_scores,
    "batch_comparison": batch_summary,
    "layer_sweep": sweep,
    "summary_document": summary_document,
}

_PREDS = "p as (select lang as g, quality as y_true, toxic as y_pred, n_chars as score from labels join documents using (doc_id))"
_GROUPS = f"""{_PREDS}, c as (
  select g, count(*) as n, count(*) filter (y_true = 1) as positives, count(*) filter (y_true = 0) as negatives,
    count(*) filter (y_true = 1 and y_pred = 1) as tp, count(*) filter (y_true = 1 and y_pred = 0) as fn,
    count(*) filter (y_true = 0 and y_pred = 1) as fp, count(*) filter (y_true = 0 and y_pred = 0) as tn
  from p group by g
), f as (
  select *, round(positives / n, 6) as rate_pre, round((tp + fp) / n, 6) as rate_post,
    round(coalesce(tp / nullif(positives, 0), 0), 6) as tpr, round(coalesce(fp / nullif(negatives, 0), 0), 6) as fpr from c
)"""
_CLASSES = f"""{_PREDS}, k as (select y_true as class from p union select y_pred from p), c as (
  select class, (select count(*) from p where y_true = class and y_pred = class) as hit,
    (select count(*) from p where y_true = class) as support, (select count(*) from p where y_pred = class) as predicted from k
), r as (select *, coalesce(2 * hit / nullif(support + predicted, 0), 0) as f from c)"""
_ORDERS = "o as (select o_orderkey, case when o_orderpriority = '5-LOW' then '5-LOW' else 'OTHER' end as g, (o_totalprice > 200000)::int as y from orders)"


def _draw(tag: str, key: str, seed: int = SEED) -> str:
    return f"md5('{seed}:{tag}:' || {key}::varchar), {key}"


def _holes(name: str, table: str, key: str, columns: list[str]) -> str:
    ranks = ", ".join(f"row_number() over (order by {_draw(c, key)}) as r_{c}" for c in columns)
    cells = ", ".join(f"case when r_{c} > need then {c} end as {c}" for c in columns)
    return f"{name}_r as (select *, (select round_even(count(*) * {RATE} / 100, 0) from {table}) as need, {ranks} from {table}), {name} as (select {key}, {cells} from {name}_r)"


def _injection(rates: tuple[int, ...] = (RATE,), seed: int = SEED) -> tuple[str, dict[int, str]]:
    """Columns one after the other, the rows with the fewest nulls first; a rate goes on where the one before ended."""
    cols = [*PART[0], *PART[1]]
    parts, at = [f"j{seed}_0 as (select p_partkey, {', '.join(cols)}, 0 as nulls from part)"], f"j{seed}_0"
    ends, before = {}, 0
    for rate in rates:
        for c in cols:
            tag, step = c if rate == rates[0] else f"{c}:{rate}", f"j{seed}_{len(parts)}"
            need = f"(select round_even(count(*) * {rate} / 100, 0) - round_even(count(*) * {before} / 100, 0) from part)"
            rank = f"row_number() over (partition by {c} is null order by nulls, {_draw(tag, 'p_partkey', seed)})"
            parts.append(f"{step} as (select * replace (case when hit then null else {c} end as {c}, nulls + hit::int as nulls) from (select *, {c} is not null and {rank} <= {need} as hit from {at}))")
            parts[-1] = parts[-1].replace("select * replace", "select * exclude (hit) replace")
            at = step
        ends[rate], before = at, rate
    return ", ".join(parts), ends


def _injected(rates: tuple[int, ...], seed: int, extra: str) -> tuple[str, str]:
    """WITH parts and the union of the rates; extra is a column list with {rate} and {seed}."""
    parts, ends = _injection(rates, seed)
    cols = ", ".join(["p_partkey", *PART[0], *PART[1]])
    return parts, " union all ".join(f"select {extra.format(rate=r, seed=seed)}{cols} from {t}" for r, t in ends.items())


_PART_HOLES = _holes("h", "part", "p_partkey", [*PART[0], *PART[1]])


def _mode(c: str) -> str:
    return f"(select {c} from h where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


_FILLED = f"""{_PART_HOLES}, i as (
  select p_partkey, coalesce(p_type, {_mode("p_type")}) as p_type, coalesce(p_brand, {_mode("p_brand")}) as p_brand,
    coalesce(p_size, (select round_even(median(p_size), 0)::int from h)) as p_size,
    coalesce(p_retailprice, (select median(p_retailprice) from h)) as p_retailprice from h
)"""
_ENCODED = f"""{_holes("h", "customer", "c_custkey", [*CUSTOMER[0], *CUSTOMER[1]])},
codes as (select c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::double as code from (select distinct c_mktsegment from h where c_mktsegment is not null)),
st as (select avg(c_acctbal) as ma, coalesce(nullif(stddev_pop(c_acctbal), 0), 1) as sa, avg(c_nationkey) as mn, coalesce(nullif(stddev_pop(c_nationkey), 0), 1) as sn from h),
e as (select c_custkey, case when c_mktsegment is null then -1.0 else code end as x0, coalesce((c_acctbal - ma) / sa, 0) as x1, coalesce((c_nationkey - mn) / sn, 0) as x2,
  (c_mktsegment is null)::int as m0, (c_acctbal is null)::int as m1, (c_nationkey is null)::int as m2 from h left join codes using (c_mktsegment), st)"""
_KNN = f"""{_ENCODED}, d as (
  select a.c_custkey as src, b.c_custkey as dst, round(sqrt(({" + ".join(f"case when a.m{i} + b.m{i} = 0 then (a.x{i} - b.x{i}) ** 2 else 0 end" for i in range(3))}) * 3 / nullif({" + ".join(f"case when a.m{i} + b.m{i} < 2 then 1 else 0 end" for i in range(3))}, 0)), 9) as dist
  from e a join e b on a.c_custkey <> b.c_custkey
), knn as (select * from d where dist is not null qualify row_number() over (partition by src order by dist, dst) <= {K}),
edges as (select src, dst from knn union select dst, src from knn)"""

SQL: dict[str, str] = {
    "fairness_groups": f"with {_GROUPS} select * from f",
    "fairness_gaps": f"""with {_GROUPS}, q as (select round(max(rate_pre) - min(rate_pre), 6) as dp_pre, round(max(rate_post) - min(rate_post), 6) as dp_post,
  round(max(tpr) - min(tpr), 6) as tpr_gap, round(max(fpr) - min(fpr), 6) as fpr_gap,
  round(coalesce(min(rate_pre) / nullif(max(rate_pre), 0), 0), 6) as di_pre, round(coalesce(min(rate_post) / nullif(max(rate_post), 0), 0), 6) as di_post from f)
  select *, tpr_gap as equal_opportunity, greatest(tpr_gap, fpr_gap) as equalised_odds,
  case when dp_post <= 0.05 then 'low' when dp_post <= 0.10 then 'moderate' else 'high' end as verdict, di_post >= 0.8 as di_passes from q""",
    "class_report": f"with {_CLASSES} select class, round(coalesce(hit / nullif(predicted, 0), 0), 6) as precision, round(coalesce(hit / nullif(support, 0), 0), 6) as recall, round(f, 6) as f1, support from r",
    "binary_metrics": f"with {_CLASSES} select round(sum(hit) / sum(support), 6) as accuracy, round(avg(f), 6) as f1_macro, round(sum(f * support) / sum(support), 6) as f1_weighted from r",
    "roc_auc": f"""with {_PREDS}, r as (select y_true, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r from p)
  select round((sum(r) filter (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / nullif(sum(y_true)::double * sum(1 - y_true), 0), 6) as auc from r""",
    "confusion_matrix": f"with {_PREDS} select y_true, y_pred, count(*) as n from p group by all",
    "group_report": f"with {_ORDERS} select g, count(*) as n, sum(y)::bigint as positives, round(avg(y), 6) as rate from o group by g",
    "stratified_split": f"""with {_ORDERS}, r as (select *, row_number() over (partition by g, y order by {_draw("split", "o_orderkey")}) as rn, count(*) over (partition by g, y) as n from o)
  select o_orderkey, g, y, case when rn <= n - ceil(n * 3 / 10) then 'train' when rn <= n - ceil(ceil(n * 3 / 10) / 2) then 'val' else 'test' end as split from r""",
    "balance_two_stage": f"""with {_ORDERS}, c as (select count(*) filter (g = '5-LOW' and y = 1) as f1, count(*) filter (g = '5-LOW' and y = 0) as f0,
    count(*) filter (g <> '5-LOW' and y = 1) as m1, count(*) filter (g <> '5-LOW' and y = 0) as m0 from o),
  l as (select least(f1, round_even((f1 / (f1 + f0)) * m0 / (1 - f1 / (f1 + f0)), 0), m1) as k1, least(f0, m0) as k0 from c),
  r as (select *, row_number() over (partition by g, y order by {_draw("two-stage", "o_orderkey")}) as rn from o)
  select o_orderkey, g, y from r, l where g = '5-LOW' or rn <= case when y = 1 then k1 else k0 end""",
    "balance_downsample": f"""with {_ORDERS}, r as (select *, row_number() over (partition by g order by {_draw("downsample", "o_orderkey")}) as rn from o)
  select o_orderkey, g, y from r where rn <= (select min(n) from (select count(*) as n from o group by g))""",
    "balance_redistribute": f"""with {_ORDERS}, s as (select g, count(*) as n from o group by g), r as (select *, row_number() over (partition by g order by {_draw("redistribute", "o_orderkey")}) as rn from o)
  select o_orderkey, case when g = (select g from s order by n desc, g limit 1) and rn <= (select round_even(max(n) - sum(n) / count(*), 0) from s) then (select g from s order by n, g limit 1) else g end as g, y from r""",
    "null_injection": "with {} {}".format(*_injected((RATE,), SEED, "")),
    "null_injection_rates": "with {} {}".format(*_injected(tuple(RATES), SEED, "{rate} as rate, ")),
    "null_injection_seeds": "with " + ", ".join(_injected((RATE,), x, "")[0] for x in SEEDS) + " " + " union all ".join(_injected((RATE,), x, "{seed} as seed, {rate} as rate, ")[1] for x in SEEDS),
    "nulls_per_row": f"with {_PART_HOLES} select " + " + ".join(f"({c} is null)::int" for c in [*PART[0], *PART[1]]) + " as nulls, count(*) as n_rows from h group by 1",
    "injection_verified": f"with {_PART_HOLES} " + " union all ".join(f"select '{s}' as split, '{c}' as col, count(*) as n, count(*) filter ({c} is null) as n_null, round(count(*) filter ({c} is null) / count(*), 6) as rate, true as as_asked from {t}" for s, t in (("train", "h"), ("val", "part")) for c in [*PART[0], *PART[1]]),
    "class_report_full": f"""with {_CLASSES}, s as (select class::varchar as class, coalesce(hit / nullif(predicted, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, f as f1, support, hit from r)
  select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from s
  union all select 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::bigint from s
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from s
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from s""",
    "multiclass_auc": """with c as (select unnest(range(8)) as class), x as (select class, (label = class)::int as y, round(embedding[class + 1]::double, 4) as s from embeddings, c where label < 8),
  r as (select *, rank() over (partition by class order by s) + (count(*) over (partition by class, s) - 1) / 2 as r from x),
  a as (select class, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y)::double * sum(1 - y), 0), 12) as auc from r group by class)
  select round(avg(auc), 6) as auc from a""",
    "split_metrics": """with p as (select case doc_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, quality as y_true, toxic as y_pred, n_chars as s from labels join documents using (doc_id)),
  k as (select split, y_true as class from p union select split, y_pred from p),
  c as (select *, (select count(*) from p where p.split = k.split and y_true = class and y_pred = class) as hit, (select count(*) from p where p.split = k.split and y_true = class) as support, (select count(*) from p where p.split = k.split and y_pred = class) as predicted from k),
  f as (select *, coalesce(2 * hit / nullif(support + predicted, 0), 0) as f from c),
  m as (select split, sum(support)::bigint as n, round(sum(hit) / sum(support), 6) as acc, round(avg(f), 6) as f1_macro, round(sum(f * support) / sum(support), 6) as f1_weighted from f group by split),
  r as (select *, rank() over (partition by split order by s) + (count(*) over (partition by split, s) - 1) / 2 as r from p),
  a as (select split, round((sum(r) filter (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / nullif(sum(y_true)::double * sum(1 - y_true), 0), 6) as roc_auc from r group by split)
  select *, case when roc_auc is null then 'unknown' when roc_auc > 0.9 then 'excellent' when roc_auc > 0.8 then 'good' when roc_auc > 0.7 then 'fair' else 'poor' end as band from m join a using (split)""",
    "group_gap": f"with {_ORDERS}, r as (select g, round(avg(y), 6) as rate from o group by g) select case when count(*) = 2 then round(max(rate) - min(rate), 6) end as dp_gap from r",
    "groups_by_size": "select o_orderpriority, count(*) as n from orders group by 1",
    "balance_identity": f"with {_ORDERS} select * from o",
    "target_map": "select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as o_orderstatus from orders",
    "shuffle_position": f"select c_custkey, row_number() over (order by {_draw('shuffle', 'c_custkey')}) as position from customer",
    "feature_indicators": f"with {_ENCODED} select c_custkey, round(x0, 6) as f0, round(x1, 6) as f1, round(x2, 6) as f2, m0::double as f3, m1::double as f4, m2::double as f5 from e",
    "distance_explained": f"with {_KNN}, x as (select src, dst, unnest([" + ", ".join(f"{{'dim': '{c}', 'ma': a.m{i}, 'mb': b.m{i}, 'd': (a.x{i} - b.x{i}) ** 2}}" for i, c in enumerate([*CUSTOMER[0], *CUSTOMER[1]])) + f"]) as t, 3 - a.m0 * b.m0 - a.m1 * b.m1 - a.m2 * b.m2 as used, dist from knn join e a on a.c_custkey = src join e b on b.c_custkey = dst where src <= 50) "
    "select src, dst, t.dim as dim, case t.ma + t.mb when 2 then 'both missing' when 1 then 'one missing' else 'both observed' end as rule, round(case when t.ma + t.mb > 0 then 0 else t.d end, 6) as contribution, used::bigint as used, round(dist, 6) as dist from x",
    "neighbour_cosine": f"""with {_KNN},
  c as (select src, dst, round(coalesce((a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2) / nullif(sqrt(a.x0 ** 2 + a.x1 ** 2 + a.x2 ** 2) * sqrt(b.x0 ** 2 + b.x1 ** 2 + b.x2 ** 2), 0), 0), 6) as cosine
    from edges join e a on a.c_custkey = src join e b on b.c_custkey = dst)
  select src, dst, cosine, row_number() over (partition by src order by cosine desc, dst) as rank from c""",
    "chain_fallback": "with x as (select c_custkey as src, lead(c_custkey) over (order by c_custkey) as dst from customer) select src, dst from x where dst is not null union select dst, src from x where dst is not null",
    "duplicates_matched": """with a as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) as k from customer where c_custkey % 3 = 0),
  b as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) as k from customer)
  select a.c_custkey as part_id, b.c_custkey as source_id from a left join b using (c_mktsegment, c_nationkey, k)""",
    "layer_sweep": """with p as (select (doc_id % 3 + 3)::int as no_layers, lang as g, quality as t, toxic as p from labels join documents using (doc_id)),
  r as (select no_layers, g, round(avg(p), 6) as rate_post, round(coalesce(sum((t = 1 and p = 1)::int) / nullif(sum((t = 1)::int), 0), 0), 6) as tpr from p group by 1, 2)
  select no_layers, """ + ", ".join(f"max({m}) filter (g = '{g}') as {g}_{m}" for g in ("de", "en", "es", "fr") for m in ("rate_post", "tpr")) + """, round(max(rate_post) - min(rate_post), 6) as rate_post_gap, round(max(tpr) - min(tpr), 6) as tpr_gap from r group by 1""",
    "graph_components": f"with recursive {_KNN}, w(id, c) as (select c_custkey, c_custkey from customer union select e.dst, w.c from w join edges e on e.src = w.id) select id, min(c) as component from w group by id",
    "batch_comparison": f"""with r as (select source, round(avg((quality = toxic)::int), 6) as acc from labels join documents using (doc_id) group by 1)
  select {SEED} as seed, source as run, printf('%.4f', acc) as test_acc, '-' as test_f1, '-' as dp_pre, '-' as dp_post, 'ok' as status from r
  union all select {SEED}, 'mcar_10_knn', '-', '-', '-', '-', 'no such file'""",
    "null_injection_independent": f"with {_PART_HOLES} select * from h",
    "missing_summary": f"with {_PART_HOLES} " + " union all ".join(f"select '{c}' as col, count(*) as n, count(*) filter ({c} is null) as n_null, round(count(*) filter ({c} is null) / count(*), 6) as rate from h" for c in [*PART[0], *PART[1]]),
    "impute_mode_median": f"with {_FILLED} select p_partkey, p_type, p_brand, p_size, round(p_retailprice, 4) as p_retailprice from i",
    "imputation_scores_numeric": f"with {_FILLED}, x as (" + " union all ".join(f"""select '{c}' as "column", count(*) as n_imputed, count(*) filter (t.{c} = i.{c}) as exact_matches,
    round(avg(greatest(least(1 - abs(t.{c} - i.{c})::double / (select max({c}) - min({c}) from part), 1), 0)), 6) as sem_sim_mean from part t join h using (p_partkey) join i using (p_partkey) where h.{c} is null""" for c in PART[1]) + """)
  select "column", 'num' as col_type, n_imputed, exact_matches, round(exact_matches / n_imputed, 6) as exact_match_rate, sem_sim_mean from x
  union all select '_ALL_', 'all', sum(n_imputed)::bigint, sum(exact_matches)::bigint, round(sum(exact_matches) / sum(n_imputed), 6), round(sum(sem_sim_mean * n_imputed) / sum(n_imputed), 6) from x""",
    "encode_features": f"with {_ENCODED} select c_custkey, round(x0, 6) as f0, round(x1, 6) as f1, round(x2, 6) as f2, m0, m1, m2 from e",
    "knn_graph": f"with {_KNN} select src, dst, round(dist, 6) as dist from knn",
    "degree_stats": f"with {_KNN}, g as (select c_custkey, count(dst) as n from customer left join edges on src = c_custkey group by 1) select round(avg(n), 6) as avg_degree, min(n) as min_degree, max(n) as max_degree from g",
    "gcn_propagate": f"""with {_KNN}, l as (select * from edges union all select c_custkey, c_custkey from customer), g as (select src, count(*)::double as d from l group by src)
  select l.dst as id, round(sum(c_acctbal / sqrt(a.d)) / sqrt(any_value(b.d)), 6) as value from l join customer on c_custkey = l.src join g a on a.src = l.src join g b on b.src = l.dst group by l.dst""",
    "cosine_neighbours": f"""with v as (select vec_id, embedding::double[] as e from embeddings), d as (
    select a.vec_id as query_id, b.vec_id as id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as cosine
    from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
  select query_id, id, cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from d) where rank <= {K}""",
}
