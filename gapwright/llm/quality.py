"""Document quality and toxicity by text evidence and hierarchical empirical Bayes over sites (operator 7).

Text evidence is the log likelihood ratio of a logistic model over words (hashed to 64 bits) and binned shape ratios
whose presence differs significantly between the labelled classes. Each document's text posterior is averaged by host and by path
within host; credibility weights, estimated from all hosts and paths, shrink sparse paths to their host and sparse
hosts to the global mean. A document's prior is its path's shrunk mean without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._workspace import materialise, release

#: Labelled documents that the classifier is fitted on, those of the smallest hashed ids: the bound of the sample.
SAMPLE = 20_000
#: A feature counts if its presence differs by so many standard errors, in so many documents at least.
LEAST_Z, LEAST_DOCS = 4.0, 4
#: Most features of a model, the most significant ones.
FEATURES = 50_000
#: Largest weight of one feature, and log odds between which posteriors are kept.
CAP, LIMIT = 5.0, 25.0
TARGETS = ("low", "toxic")

_U = np.uint64
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BREAKS = K.table_of(b" \t\n\x0b\x0c\r" + _PUNCTUATION)
_MARKS = K.table_of(bytes(set(_PUNCTUATION) - set(b".,'-")))
_UPPER, _ASCII_LETTER = K.table_of(bytes(range(65, 91))), K.table_of(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = K.table_of(b"0123456789")
_EDGES = np.array([0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of each row's distinct words and shape bins."""
    low = np.append(K.LOWER[data], np.zeros(8, np.uint8))
    starts, ends, rows = K.spans(data, offsets, _BREAKS)
    h = K.xxh64(low, starts, ends - starts, 7)
    words, size = rows[1:] - rows[:-1], np.maximum(offsets[1:] - offsets[:-1], 1)
    doc = np.repeat(np.arange(len(words)), words)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    letters = np.maximum(K.segment_sums(_ASCII_LETTER[data].astype(np.int64), offsets), 1)
    shapes = [
        K.segment_sums(again, rows) / np.maximum(words, 1),
        K.segment_sums(_UPPER[data].astype(np.int64), offsets) / letters,
        K.segment_sums(_MARKS[data].astype(np.int64), offsets) / size,
        K.segment_sums(_DIGIT[data].astype(np.int64), offsets) / size,
    ]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    distinct = np.bincount(doc, minlength=len(words)) / np.maximum(words, 1)
    shapes.append(distinct * np.minimum(words, 200) ** 0.2 / 2)
    bins = np.stack([np.searchsorted(_EDGES, s) + 16 * k for k, s in enumerate(shapes)], axis=1)
    shape_hash = K.mix(bins.ravel().astype(_U) + _U(0x5A17))
    return np.concatenate([doc, np.repeat(np.arange(len(words)), len(shapes))]), np.concatenate([h, shape_hash])


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights by target, the targets' prior log odds and what every text adds to these."""

    hashes: np.ndarray
    weights: np.ndarray
    prior: tuple[float, ...]
    base: tuple[float, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct labelled texts; the labels joined are at most sample rows, so they are broadcast."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = clean.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).dropDuplicates(["text"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Logistic models over significant features from labels(id, quality 0/1, toxic 0/1).

    Ids with several labels take the worst. Without labelled documents the model has no features and even odds against
    rejection stay at the floor, so that nothing is rejected. Counts come together by feature, map-side first; the
    driver receives FEATURES rows at most.
    """
    train = materialise(labelled_sample(docs, labels, sample, id_col, text_col).select("text", (F.col("quality") == 0).cast("long").alias("low"), F.col("toxic").cast("long").alias("toxic")), "labelled")
    n, *ones = train.agg(F.count("*"), *(F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS)).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            y = np.stack([batch.column(t).to_numpy() for t in TARGETS])
            for i, j in K.chunks(offsets):
                row, h = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((h, y[:, i:j][:, row]))
        if held:
            h, y = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1)
            keys, at, number = np.unique(h, return_inverse=True, return_counts=True)
            sums = [np.bincount(at, weights=v, minlength=len(keys)).astype(np.int64) for v in y]
            for s in range(0, len(keys), 50_000):
                e = s + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(keys[s:e].view(np.int64)), pa.array(number[s:e]), *(pa.array(x[s:e]) for x in sums)], names=["h", "n", *TARGETS])

    counts = train.mapInArrow(count, "h long, n long, low long, toxic long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", *TARGETS))).where(F.col("n") >= LEAST_DOCS)
    best = [_significance(F.col(t), F.col("n"), k, n) for t, k in zip(TARGETS, ones, strict=True)]
    rows = counts.withColumn("z", F.greatest(*best)).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "h").limit(FEATURES).toPandas()
    hashes = np.sort(rows["h"].to_numpy(np.int64).view(_U))
    found = train.select("text", *TARGETS).mapInArrow(_hits(hashes), "f array<int>, " + ", ".join(f"{t} long" for t in TARGETS)).toPandas()  # sample rows at most
    release(train)
    fits = [_logistic(found["f"], found[t].to_numpy(float), len(hashes)) if k and n > k else (np.zeros(len(hashes)), -LIMIT) for t, k in zip(TARGETS, ones, strict=True)]
    prior = tuple(float(np.log((k + 0.5) / (n - k + 0.5))) if k and n > k else -LIMIT for k in ones)
    return Model(hashes, np.stack([w for w, _ in fits], axis=1), prior, tuple(b - p for (_, b), p in zip(fits, prior, strict=True)))


def _hits(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            out: list[np.ndarray] = []
            for i, j in K.chunks(offsets):
                row, h = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                good = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                row, at = row[good], at[good]
                order = np.argsort(row, kind="stable")
                out += np.split(at[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=j - i))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), *(batch.column(t) for t in TARGETS)], names=["f", *TARGETS])

    return run


def _logistic(rows: pd.Series, y: np.ndarray, width: int, rounds: int = 300, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression on sets of features, by Adam on the whole sample."""
    sizes = np.array([len(x) for x in rows])
    column = np.concatenate([np.asarray(x, np.int64) for x in rows]) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    first, second, n = np.zeros(width + 1), np.zeros(width + 1), max(len(y), 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[column], minlength=len(y)) + b
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(column, weights=r[row], minlength=width)[:width] / n + ridge * w / n * 10, r.mean())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.clip(w, -CAP, CAP), float(b)


def _significance(with_: Column, all_: Column, ones: int, n: int) -> Column:
    p = F.greatest(F.least(all_ / F.lit(float(max(n, 1))), F.lit(1 - 1e-12)), F.lit(1e-12))
    spread = F.sqrt(p * (1 - p) * F.lit(1 / max(ones, 1) + 1 / max(n - ones, 1)))
    return F.abs(with_ / F.lit(float(max(ones, 1))) - (all_ - with_) / F.lit(float(max(n - ones, 1)))) / spread


def text_evidence(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """(*keep, llr_low, llr_toxic): sums of log likelihood ratios over the whole text; null is empty."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    bits = 22
    bitmap = np.zeros(1 << bits, bool)
    bitmap[model.hashes & _U((1 << bits) - 1)] = True
    packed = np.packbits(bitmap)
    hashes, weights, base = model.hashes, model.weights, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).astype(bool)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("_text"))
            total = np.tile(np.array(base), (batch.num_rows, 1))
            for i, j in K.chunks(offsets):
                if not len(hashes):
                    break
                row, h = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = maybe[h & _U((1 << bits) - 1)]
                row, h = row[hit], h[hit]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                good = hashes[at] == h
                for k in range(len(TARGETS)):
                    total[i:j, k] += np.bincount(row[good], weights=weights[at[good], k], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(total[:, k]) for k in range(len(TARGETS)))], names=[*keep, *(f"llr_{t}" for t in TARGETS)])

    source = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return source.mapInArrow(run, f"{kinds}, " + ", ".join(f"llr_{t} double" for t in TARGETS))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (1 - q))


def _posterior(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(log_odds, F.lit(LIMIT)), F.lit(-LIMIT))))


def credibility(groups: DataFrame, parent: DataFrame | float, by: str | None, t: str) -> float:
    """Pseudo-count of the parent's mean: the variance within groups over the variance between them (Buhlmann).

    groups(n, s, q) are counts, sums and sums of squares of a posterior; parent holds its mean m by the column by, or is the one mean of all.
    """
    n, s, q = F.col("n"), F.col(f"s_{t}"), F.col(f"q_{t}")
    joined = groups.join(parent, by) if by else groups.withColumn("m", F.lit(parent))
    dev = F.pow(s / n - F.col("m"), 2) * n
    within, between, total, groups_n, squares = joined.agg(F.sum(q - s * s / n), F.sum(dev), F.sum(n), F.count("*"), F.sum(n.cast("double") * n)).first()
    if not groups_n or total <= groups_n:
        return 10.0
    w = max(within / (total - groups_n), 1e-9)
    room = total - squares / total
    tau = max((between - (groups_n - 1) * w) / room, 0.0) if room > 0 else 0.0
    return float(min(max(w / tau if tau > 0 else 1e4, 1.0), 1e4))


def site_posteriors(evidence: DataFrame, model: Model, host: str, path: str) -> DataFrame:
    """(host, path, n_path, and for each target its sum, prior mean and pseudo-count): one row a path."""
    scored = evidence.select(host, path, *(_posterior(F.col(f"llr_{t}") + F.lit(p)).alias(t) for t, p in zip(TARGETS, model.prior, strict=True)))
    sums = [F.count("*").alias("n")] + [f for t in TARGETS for f in (F.sum(t).alias(f"s_{t}"), F.sum(F.col(t) * F.col(t)).alias(f"q_{t}"))]
    paths = materialise(scored.groupBy(host, path).agg(*sums), "paths")
    again = [F.sum(c).alias(c) for c in ("n", *(f"{x}_{t}" for t in TARGETS for x in "sq"))]
    hosts = materialise(paths.groupBy(host).agg(*again), "hosts")
    out = paths
    shrunk = hosts.select(host)
    for t in TARGETS:
        mean = hosts.agg(F.sum(f"s_{t}") / F.sum("n")).first()[0]
        if mean is None:
            return paths.select(host, path, F.col("n").alias("n_path"), *(F.lit(0.0).alias(f"{x}_{t}") for t in TARGETS for x in ("sum", "prior", "count")))
        k_host = credibility(hosts, mean, None, t)
        level = hosts.select(host, ((F.col(f"s_{t}") + F.lit(k_host * mean)) / (F.col("n") + F.lit(k_host))).alias("m"))
        k_path = credibility(paths, level, host, t)
        shrunk = shrunk.join(level.withColumnRenamed("m", f"prior_{t}"), host)
        out = out.withColumn(f"count_{t}", F.lit(k_path)).withColumnRenamed(f"s_{t}", f"sum_{t}")
    return out.join(shrunk, host).select(host, path, F.col("n").alias("n_path"), *(f"{x}_{t}" for t in TARGETS for x in ("sum", "prior", "count")))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, p_text_*, site_*, p_*, keep) for each row of docs, * being low and toxic.

    host and path are strings; null ones form a site of their own, ''. A path lies within its host. keep is false
    where p_low or p_toxic exceeds the threshold. Null and empty texts have no evidence but their shape. Repeated rows
    are judged alike; no rows give none; other columns are not read.
    """
    site = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    own = F.concat_ws("/", site, F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    source = docs.select(F.col(id_col), F.col(text_col), site.alias("host"), own.alias("path"))
    evidence = materialise(text_evidence(source, model, [id_col, "host", "path"], text_col), "evidence")
    sites = materialise(site_posteriors(evidence, model, "host", "path").drop("host"), "sites")
    out = evidence.join(sites, "path")
    for t, prior in zip(TARGETS, model.prior, strict=True):
        text = _posterior(F.col(f"llr_{t}") + F.lit(prior))
        k = F.col(f"count_{t}")
        out = out.withColumn(f"p_text_{t}", text)
        out = out.withColumn(f"site_{t}", (F.col(f"sum_{t}") - F.col(f"p_text_{t}") + k * F.col(f"prior_{t}")) / (F.col("n_path") - 1 + k))
        out = out.withColumn(f"p_{t}", _posterior(F.col(f"llr_{t}") + _logit(F.col(f"site_{t}"))))
    out = out.withColumn("keep", (F.col("p_low") <= threshold) & (F.col("p_toxic") <= threshold))
    return out.select(id_col, "host", "path", *(f"{x}_{t}" for x in ("p_text", "site", "p") for t in TARGETS), "keep")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs without the ids that classify() rejects, by a model fitted on labels. Rows with a null id stay."""
    judged = classify(docs, fit(docs, labels, sample, id_col, text_col), id_col, text_col, host_col, path_col)
    gone = judged.where(~F.col("keep")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
