"""SimHash near-duplicate classes found by the generalised pigeonhole principle (operator 10).

Bits that go together share a partition; a dynamic program gives the m partitions unequal radii t_i >= -1 with
sum(t_i) = radius - m + 1, so any two fingerprints within the radius agree within t_i on some partition i. Both the
number of partitions and the radii are those of least estimated cost. Probes find pairs that share a key; the full
distance verifies them. A key that many fingerprints share is not paired out: its members are dealt anew by the points
of balls of half the radius and linked there, which is exact for the classes and linear in the members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._workspace import materialise, release
from .components import connected_components

#: Above so many rows under one probe key, links go through ball points and not through pairs.
PAIRWISE = 512
_U = np.uint64


def fingerprint_batches(words: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(text_col))
            prints = [np.zeros(0, _U)]
            for i, j in K.chunks(offsets):
                raw = K.LOWER[data[offsets[i] : offsets[j]]]
                joined, starts, ends, rows = K.single_spaced(raw, offsets[i : j + 1] - offsets[i], K.SPACES)
                first, last, ptr = K.shingle_ranges(rows, words)
                prints.append(K.majority_bits(K.xxh64(joined, starts[first], ends[last] - starts[first]), ptr))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.concatenate(prints).view(np.int64))], names=[id_col, "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp LONG): bit set where over half of the hashes of the word shingles set it.

    Words are maximal runs without ASCII white space, A-Z in lower case; shingles repeat; a text of fewer words is one
    shingle; a text without words (null and empty too) has fingerprint 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(fingerprint_batches(words, id_col, text_col), f"`{id_col}` {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(64, dtype=_U)) & _U(1)).astype(np.float64)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and the 64 x 64 joint counts of set bits, over all of them; 64 rows a task come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((64, 64))
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy(zero_copy_only=False).view(_U))
            n, joint = n + len(x), joint + x.T @ x
        if n:
            i, j = np.indices((64, 64))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), 64)), pa.array(np.append(j.ravel(), 64)), pa.array(np.append(joint.ravel(), n))], names=["i", "j", "v"])

    rows = distinct.select("fp").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # 4,097 rows at most
    joint, n = np.zeros((64, 64)), 0
    for i, j, v in rows:
        if i == 64:
            n = int(v)
        else:
            joint[i, j] = v
    return n, joint


def correlated_partitions(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits: each starts with the most correlated free pair and takes the free bit nearest to its members."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    free, groups = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        if k == m - 1:
            groups.append(sorted(free))
            break
        rest = sorted(free)
        sub = corr[np.ix_(rest, rest)]
        a, b = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [rest[a], rest[b]]
        while len(group) < width:
            rest = [x for x in sorted(free) if x not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(axis=1).argmax())])
        free -= set(group)
        groups.append(sorted(group))
    return groups


def estimated_pairs(n: int, joint: np.ndarray, group: list[int], most: int) -> list[float]:
    """Expected pairs within distance 0..most on these bits: a Poisson-binomial law of bit disagreements, whose effective
    number of bits is lowered to the entropy that correlation leaves."""
    p = np.diag(joint)[group] / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    cov = (joint / max(n, 1) - np.outer(np.diag(joint), np.diag(joint)) / max(n, 1) ** 2)[np.ix_(group, group)]
    spread = np.linalg.eigvalsh(cov + np.eye(len(group)) * 1e-9)
    effective = spread.sum() ** 2 / max((spread**2).sum(), 1e-12) / len(group)
    law = np.zeros(len(group) + 1)
    law[0] = 1
    for q in differ:
        law[1:] = law[1:] * (1 - q) + law[:-1] * q
        law[0] *= 1 - q
    cum = np.minimum(np.cumsum(law), 1) ** min(1.0, effective)
    return [n * (n - 1) / 2 * cum[t] for t in range(most + 1)]


def allocate(n: int, joint: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """The radii of least estimated cost by dynamic programming over partitions and the sum of radii left."""
    total, best = radius - len(groups) + 1, {0: (0.0, [])}
    for k, group in enumerate(groups):
        pairs, step = estimated_pairs(n, joint, group, radius), {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                probes = sum(len(list(itertools.combinations(range(len(group)), d))) for d in range(t + 1)) if t >= 0 else 0
                if probes > 5000:
                    break
                now = (cost + (pairs[t] if t >= 0 else 0) + 4.0 * n * probes, [*chosen, t])
                if (key := spent + t) not in step or now < step[key]:
                    step[key] = now
        best = {s: v for s, v in step.items() if s + (-1) * (len(groups) - k - 1) <= total}
    return best[total]


def choose_plan(n: int, joint: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, radius) of each probed partition, of the cheapest number of partitions from 2 to radius + 1."""
    plans = []
    for m in range(2, max(2, radius + 1) + 1):
        groups = correlated_partitions(n, joint, m)
        cost, radii = allocate(n, joint, groups, radius)
        plans.append((cost, [(g, t) for g, t in zip(groups, radii, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _flips(group: list[int], t: int) -> np.ndarray:
    return np.array([reduce(lambda a, b: a | 1 << b, c, 0) for d in range(t + 1) for c in itertools.combinations(group, d)], _U)


def probe_batches(plan: list[tuple[list[int], int]]):
    masks = [(_U(reduce(lambda a, b: a | 1 << b, g, 0)), _flips(g, t)) for g, t in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(_U)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                for k, (mask, flips) in enumerate(masks):
                    value = (part & mask)[:, None] ^ flips[None, :]
                    key = K.mix(value ^ K.mix(np.array([k + 1], _U)))
                    own = np.zeros(value.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(own.ravel())], names=["key", "fp", "own"])

    return run


def link_batches(radius: int, pairwise: int = PAIRWISE):
    """(a, b) of links under keys that at most pairwise rows share; (member, null) for each member of the others.

    Rows must come sorted by key. Only the last key's rows wait for the next batch, pairwise of them at most: a key
    known to be crowded hands its rows on at once.
    """

    def pairs_of(keys: np.ndarray, fps: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes, heads = np.diff(cut), cut[:-1]
        for size in np.unique(sizes[sizes > 1]):
            at = heads[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, 2_000_000 // len(i))
            for s in range(0, len(at), step):
                x, y = (at[s : s + step, None] + i[None, :]).ravel(), (at[s : s + step, None] + j[None, :]).ravel()
                ok = (own[x] | own[y]) & (fps[x] != fps[y])
                ok[ok] = np.bitwise_count(fps[x[ok]] ^ fps[y[ok]]) <= radius
                yield fps[x[ok]], fps[y[ok]]

    def crowded(keys: np.ndarray, known: int | None) -> np.ndarray:
        _, at, sizes = np.unique(keys, return_inverse=True, return_counts=True)
        return (sizes > pairwise)[at] | (np.full(len(keys), False) if known is None else keys == known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool))
        known = None
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            if not last:
                if not batch.num_rows:
                    continue
                fresh = (batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(_U), batch.column("own").to_numpy(zero_copy_only=False))
                wait = tuple(np.concatenate(x) for x in zip(wait, fresh, strict=True))
            keys, fps, own = wait
            if not len(keys):
                continue
            many = crowded(keys, known)
            if many.any():
                member = np.unique(fps[many]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(member), pa.nulls(len(member), pa.int64())], names=["a", "b"])
            known = int(keys[-1]) if many[-1] else None
            later = ~many & (keys == keys[-1]) & (not last)
            now = ~many & ~later
            for a, b in pairs_of(keys[now], fps[now], own[now]):
                if len(a):
                    a, b = np.maximum(a, b), np.minimum(a, b)
                    pair = np.unique(np.stack([a, b]), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])
            wait = (keys[later], fps[later], own[later])

    return run


def ball_batches(radius: int):
    """(point, fp, inner) for all points within half the radius of each fingerprint, rounded up; inner where rounded down."""
    wide, narrow = _flips(list(range(64)), (radius + 1) // 2), _flips(list(range(64)), radius // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // len(wide))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(_U)
            for at in range(0, len(fps), step):
                part = fps[at : at + step]
                points = (part[:, None] ^ wide[None, :]).ravel()
                inner = np.tile(np.arange(len(wide)) < len(narrow), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(wide)).view(np.int64)), pa.array(inner)], names=["point", "fp", "inner"])

    return run


def star_links(crowd: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join exactly what steps of at most radius join among crowd(fp), each fingerprint once there.

    Two within the radius have a point in common that is inner to one of them; all that have a point link to the least
    one it is inner to. A point is had by as many fingerprints as there are flips at most, so no key is hot.
    """
    points = crowd.mapInArrow(ball_batches(radius), "point long, fp long, inner boolean")
    heads = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    return points.join(heads.select("point", "head"), "point").where("fp <> head").select(F.greatest("fp", "head").alias("a"), F.least("fp", "head").alias("b"))


def fingerprint_components(distinct: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(node, component) over the fingerprints that have a link within radius; distinct(fp) holds each one once."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be from 0 to 6")
    n, joint = bit_statistics(distinct)
    plan = choose_plan(n, joint, radius)
    probes = distinct.select("fp").mapInArrow(probe_batches(plan), "key long, fp long, own boolean").repartition("key").sortWithinPartitions("key")
    found = materialise(probes.mapInArrow(link_batches(radius, pairwise), "a long, b long").distinct(), "links")
    crowd = materialise(found.where("b is null").select(F.col("a").alias("fp")).distinct(), "crowd")
    edges = found.where("b is not null")
    return connected_components(edges if crowd.isEmpty() else edges.unionAll(star_links(crowd, radius)))


def simhash_components(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp LONG, component_id): near-duplicate classes; component_id is the smallest id that links reach.

    Equal fingerprints are one node, so copies cost nothing. Rows with a null id get a fingerprint and, if they are
    alone, a null class. Repeated rows stay. Other columns of docs are not read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "nodes")
    reach = fingerprint_components(nodes, radius)
    labelled = nodes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    classes = labelled.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the first (smallest id) of their class. Of repeated rows of that id all stay."""
    found = simhash_components(docs, radius, words, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
