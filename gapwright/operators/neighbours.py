"""Exact nearest rows where some values are missing: equal rows are searched once, blocks too far away are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import written

#: Points whose splits lay out the blocks (all points are dealt into these), patterns of missing values with blocks of
#: their own, and rows that ask in one task.
SAMPLE, PATTERNS, ASKING = 20_000, 64, 32_768
#: Rows of a block, in few dimensions (no more than FEW), where distance rules most blocks out, and in many.
BLOCK, WIDE_BLOCK, FEW = 1024, 8192, 16

_POINT = "point long, x binary, m binary"


def distinct_points(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """points(point, x, mask, ids) and members(id, point) of rows(id, x ARRAY<DOUBLE>, mask ARRAY<BOOLEAN>).

    A point is one combination of values, missing ones aside, named by its smallest id; ids are its keep smallest.
    """
    plain = F.zip_with("x", "mask", lambda v, m: F.when(m | (v == 0), 0.0).otherwise(v.cast("double")))
    rows = written(rows.select(F.col("id").cast("long").alias("id"), plain.alias("x"), "mask"), "rows")
    place = F.row_number().over(Window.partitionBy("x", "mask").orderBy("id"))
    least = rows.withColumn("_r", place).where(F.col("_r") <= keep)
    points = written(least.groupBy("x", "mask").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    names = points.select(F.col("x").alias("_x"), F.col("mask").alias("_m"), "point")
    members = rows.join(names, (F.col("x") == F.col("_x")) & (F.col("mask") == F.col("_m"))).select("id", "point")
    return points, members


def _packed(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(p)
    return np.frombuffer(b"".join(p["x"]), float).reshape(n, -1), np.frombuffer(b"".join(p["m"]), bool).reshape(n, -1)


def _splits(x: np.ndarray, dims: np.ndarray, most: float) -> tuple | None:
    """(dimension, value, lower, upper) down to parts of at most so many of the sampled points; None for a leaf."""
    if len(x) <= most or not len(dims):
        return None
    spread = np.ptp(x[:, dims], axis=0)
    d = int(dims[spread.argmax()])
    values = np.unique(x[:, d])
    if len(values) < 2:
        return None
    at = min(np.median(x[:, d]), values[-2])
    low = x[:, d] <= at
    return d, float(at), _splits(x[low], dims, most), _splits(x[~low], dims, most)


def _leaves(tree: tuple | None, x: np.ndarray, first: int = 0) -> tuple[np.ndarray, int]:
    """The leaf of each row, numbered from first, and the number after the last leaf."""
    if tree is None:
        return np.full(len(x), first), first + 1
    d, at, low, high = tree
    out, left = np.empty(len(x), int), x[:, d] <= at
    out[left], mid = _leaves(low, x[left], first)
    out[~left], end = _leaves(high, x[~left], mid)
    return out, end


def _counted(own: np.ndarray, other: np.ndarray, either: bool) -> np.ndarray:
    """Dimensions that either has, or that both have, of masks that tell what is missing."""
    return (~(own & other) if either else ~own & ~other).sum(axis=-1)


def _box_distances(x: np.ndarray, m: np.ndarray, boxes: dict, either: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from each row to the points of each box; both infinite where nothing counts."""
    near, far = np.full((len(x), len(boxes["n"])), np.inf), np.full((len(x), len(boxes["n"])), np.inf)
    for pattern in np.unique(m, axis=0):
        at = np.flatnonzero((m == pattern).all(axis=1))
        used = _counted(pattern[None, :], boxes["m"], either)
        a, b = np.zeros((len(at), len(used))), np.zeros((len(at), len(used)))
        for d in np.flatnonzero(~pattern):
            have, v = ~boxes["m"][:, d], x[at, d][:, None]
            lo, hi = v - boxes["hi"][None, :, d], boxes["lo"][None, :, d] - v
            a += np.where(have, np.maximum(np.maximum(lo, hi), 0.0) ** 2, 0.0)
            b += np.where(have, np.maximum(-lo, -hi) ** 2, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            near[at] = np.where(used > 0, np.sqrt(a * x.shape[1] / used), np.inf)
            far[at] = np.where(used > 0, np.sqrt(b * x.shape[1] / used), np.inf)
    near[:, boxes["mixed"]] = 0.0
    far[:, boxes["mixed"]] = np.inf
    return near, far


def _found(asks: pd.DataFrame, others: pd.DataFrame, k: int, either: bool, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the asking row, id, distance): its k nearest by distance, then id, as far as its bound."""
    others = others.sort_values("point")
    (x, mx), (y, my), bound = _packed(asks), _packed(others), asks["bound"].to_numpy()
    ids = [np.frombuffer(b, np.int64) for b in others["ids"]]
    size = np.array([len(i) for i in ids])
    flat, start, d = np.concatenate(ids), np.cumsum(size) - size, x.shape[1]
    kinds, kind = np.unique(my, axis=0, return_inverse=True)
    out = []
    for pattern in np.unique(mx, axis=0):
        mine = np.flatnonzero((mx == pattern).all(axis=1))
        for j, other in enumerate(kinds):
            used, theirs = int(_counted(pattern, other, either)), np.flatnonzero(kind.ravel() == j)
            if not used:
                continue
            both = np.flatnonzero(~pattern & ~other)
            v = y[theirs][:, both]
            squares = (v * v).sum(axis=1)
            step = max(1, 2**19 // len(theirs))
            for i in range(0, len(mine), step):
                rows = mine[i : i + step]
                u = x[rows][:, both]
                if len(both) > FEW:
                    own = (u * u).sum(axis=1)
                    sums = np.maximum(own[:, None] + squares[None, :] - 2 * u @ v.T, 0.0)
                    slack = 1e-13 * (own + squares.max()) * d  # of the squares, by cancellation
                else:
                    sums, slack = np.zeros((len(rows), len(theirs))), np.zeros(len(rows))
                    for c in range(len(both)):
                        sums += (u[:, c][:, None] - v[None, :, c]) ** 2

                def most(far: np.ndarray, slack=slack, used=used) -> np.ndarray:  # the squares that may round to far
                    return ((far * (1 + 1e-12) + 2e-9) ** 2) * used / d + 2 * slack

                limit = most(bound[rows])
                hit = sums <= limit[:, None]
                crowded = np.flatnonzero(hit.sum(axis=1) > 4 * k + 16)
                if len(crowded) and len(theirs) > k:
                    kth = np.partition(sums[crowded], k - 1, axis=1)[:, k - 1]
                    limit[crowded] = np.minimum(limit[crowded], most(np.sqrt((kth + slack[crowded]) * d / used), slack[crowded]))
                    hit[crowded] = sums[crowded] <= limit[crowded, None]
                r, c = np.nonzero(hit)
                exact = ((u[r] - v[c]) ** 2).sum(axis=1) if len(both) > FEW else sums[r, c]
                dist = np.sqrt(exact * d / used)
                out.append((rows[r], theirs[c], dist if digits is None else np.round(dist, digits)))
    if not out:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    row, point, dist = map(np.concatenate, zip(*out, strict=True))

    def first(row: np.ndarray, *by: np.ndarray) -> np.ndarray:
        order = np.lexsort((*by[::-1], row))
        r = row[order]
        head = np.r_[True, r[1:] != r[:-1]][: len(r)]
        run = np.arange(len(r)) - np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
        return order[run < k]

    keep = first(row, dist, point)  # points are in the order of their smallest ids
    row, point, dist = row[keep], point[keep], dist[keep]
    n = size[point]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, one, dist = np.repeat(row, n), flat[np.repeat(start[point], n) + inner], np.repeat(dist, n)
    keep = first(row, dist, one)
    return row[keep], one[keep], dist[keep]


def search(asks: DataFrame, base: DataFrame, k: int, either: bool = True, digits: int | None = 9, block: int | None = None) -> DataFrame:
    """(point, near, dist): the k nearest ids of base(point, x, mask, ids) for each row of asks(point, x, mask), ties to
    the smaller id; a base point stands for its k smallest ids at least. Its own id is not left out.

    The distance is sqrt(sum of squares over dimensions both have, times d / dimensions that either has, or that both
    have); infinite where there are none. Base points are dealt into blocks of one pattern of missing values and near
    values. Each row first meets the block whose farthest corner is nearest, which bounds its k-th distance, then all
    blocks that have a corner or side within that bound, so nothing nearer is left out.
    """
    spark = base.sparkSession
    head = base.select("x").first()
    schema = "point long, near long, dist double"
    if head is None or not len(head.x):
        return spark.createDataFrame([], schema)
    d, n = len(head.x), base.count()
    block = block or (BLOCK if d <= FEW else WIDE_BLOCK)
    sample = base.orderBy(F.xxhash64("point", F.lit(7))).limit(SAMPLE).select("x", "mask").toPandas()
    sx, sm = np.stack(sample["x"].to_numpy()).astype(float), np.stack(sample["mask"].to_numpy()).astype(bool)
    kinds, of, seen = np.unique(sm, axis=0, return_inverse=True, return_counts=True)
    trees, first, of = {}, 0, of.ravel()
    for j in np.argsort(-seen, kind="stable")[:PATTERNS]:
        tree = _splits(sx[of == j], np.flatnonzero(~kinds[j]), max(1.0, block * len(sx) / n))
        trees[kinds[j].tobytes()] = (tree, first)
        first = _leaves(tree, sx[:0], first)[1]
    rest = max(1, -(-n // (block * 8)))  # blocks of all other patterns, which no distance rules out

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            x, m = np.stack(p["x"].to_numpy()).astype(float), np.stack(p["mask"].to_numpy()).astype(bool)
            at = first + p["point"].to_numpy() % rest
            for pattern in np.unique(m, axis=0):
                if pattern.tobytes() in trees:
                    rows = np.flatnonzero((m == pattern).all(axis=1))
                    at[rows] = _leaves(trees[pattern.tobytes()][0], x[rows], trees[pattern.tobytes()][1])[0]
            ids = [np.asarray(i, np.int64).tobytes() for i in p["ids"]]
            yield pd.DataFrame({"block": at, "point": p["point"], "x": [r.tobytes() for r in x], "m": [r.tobytes() for r in m], "ids": ids})

    def boxed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x, m = _packed(p)
        rows = sum(len(b) for b in p["ids"]) // 8
        return pd.DataFrame({"block": [key[0]], "n": [rows], "lo": [x.min(axis=0).tobytes()], "hi": [x.max(axis=0).tobytes()], "m": [m[0].tobytes()]})

    blocks = written(base.select("point", "x", "mask", "ids").mapInPandas(dealt, f"block long, {_POINT}, ids binary"), "blocks")
    told = blocks.groupBy("block").applyInPandas(boxed, "block long, n long, lo binary, hi binary, m binary").orderBy("block").toPandas()  # a row a block
    names = told["block"].to_numpy()
    boxes = {"n": told["n"].to_numpy(), "mixed": names >= first, "m": np.frombuffer(b"".join(told["m"]), bool).reshape(-1, d)} | {c: np.frombuffer(b"".join(told[c]), float).reshape(-1, d) for c in ("lo", "hi")}
    step = max(1, 2**21 // len(names))

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for i in range(0, len(whole), step):
                p = whole.iloc[i : i + step]
                x, m = np.stack(p["x"].to_numpy()).astype(float), np.stack(p["mask"].to_numpy()).astype(bool)
                near, far = _box_distances(x, m, boxes, either)
                far = np.where(np.isfinite(near) & (boxes["n"] < k), 1e300, np.where(np.isfinite(near) & ~np.isfinite(far), 1e301, far))
                at = far.argmin(axis=1)
                ok = np.isfinite(far[np.arange(len(x)), at])
                yield pd.DataFrame({"block": names[at], "point": p["point"], "x": [r.tobytes() for r in x], "m": [r.tobytes() for r in m], "bound": np.inf})[ok]

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for i in range(0, len(whole), step):
                p = whole.iloc[i : i + step]
                near, _ = _box_distances(*_packed(p), boxes, either)
                row, at = np.nonzero((near <= (p["bound"].to_numpy() * (1 + 1e-12) + 2e-9)[:, None]) & np.isfinite(near))
                yield p.iloc[row].assign(block=names[at])

    def met(asking: DataFrame, run, out: str) -> DataFrame:
        """run() over each block and the rows that ask there, at most about ASKING at a time."""
        parts = {r.block: -(-r["count"] // ASKING) for r in asking.groupBy("block").count().where(f"count > {ASKING}").collect()}  # a row a block
        many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in parts.items() for v in kv)), "block"), F.lit(1)) if parts else F.lit(1)
        left = asking.withColumn("part", F.pmod(F.xxhash64("point"), many.cast("long")))
        right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, out)

    def bounded(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return a[["point", "x", "m", "bound"]]
        row, _, dist = _found(a, b, k, either, digits)
        count, bound = np.bincount(row, minlength=len(a)), np.full(len(a), np.inf)
        np.maximum.at(last := np.full(len(a), -np.inf), row, dist)
        bound[count >= k] = last[count >= k]
        return a[["point", "x", "m"]].assign(bound=bound)

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"point": np.zeros(0, int), "near": np.zeros(0, int), "dist": np.zeros(0)})
        row, near, dist = _found(a, b, k, either, digits)
        return pd.DataFrame({"point": a["point"].to_numpy()[row], "near": near, "dist": dist})

    ask = f"{_POINT}, bound double"
    opening = asks.select("point", "x", "mask").mapInPandas(opened, f"block long, {ask}")
    limits = written(met(opening, bounded, ask), "bounds")
    found = met(limits.select(F.lit(0).cast("long").alias("block"), "*").mapInPandas(routed, f"block long, {ask}"), compared, schema)
    place = F.row_number().over(Window.partitionBy("point").orderBy("dist", "near"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
