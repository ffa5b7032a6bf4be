"""Spectral grouping of a weighted graph with self-tuned rotations, and k-means."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tokens import rescaled_exp
from tokenloom.sources.shared import checkpointed

_log = logging.getLogger(__name__)

#: Vertices up to which a graph is solved densely (one task, eight bytes an entry).
DENSE_VERTICES = 3000

#: Vertices on which the rotation is learnt, about; it has dims * (dims - 1) / 2 numbers and turns every vertex.
ROTATED_VERTICES = 20_000


def affinity(edges: DataFrame, bottom: float = 0.3, top: float = 20.0) -> DataFrame:
    """(i, j, w), symmetric and without a diagonal: exp of the scores scaled to bottom..top.

    edges: (x, y, score), each pair once or in both directions with equal scores.
    """
    once = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "score").where("x <> y").groupBy("x", "y").agg(F.max("score").alias("score"))
    ends = once.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    w = rescaled_exp(F.col("score"), F.lit(float(ends["low"] or 0)), F.lit(float(ends["high"] or 0)), bottom, top)
    a = once.select(F.col("x").alias("i"), F.col("y").alias("j"), w.alias("w"))
    return a.union(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def normalised(aff: DataFrame) -> DataFrame:
    """(i, j, w) with each weight divided by the roots of its ends' degrees."""
    degree = aff.groupBy("i").agg(F.sum("w").alias("d"))
    other = degree.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    return aff.join(degree, "i").join(other, "j").select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("dj"))).alias("w"))


def eigenvectors(matrix: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns by falling eigenvalue, at most dims; and the eigenvalues."""
    values, vectors = np.linalg.eigh(matrix)
    by = np.argsort(-values, kind="stable")[: min(dims, len(values))]
    return vectors[:, by], values[by]


def rotate(x: np.ndarray, rounds: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """x turned so that each row has one large entry, the quality of that (1: perfect) and the turn's matrix.

    Gradient steps on the Givens angles of all pairs of columns, one angle at a time; a
    step counts only if the quality rises, and is tried longer and shorter if it doesn't.
    """
    n, g = x.shape
    pairs = [(a, b) for a in range(g) for b in range(a + 1, g)]
    angles = np.zeros(len(pairs))

    def givens(k, t, slope=False):
        a, b = pairs[k]
        m = np.zeros((g, g)) if slope else np.eye(g)
        c, s = np.cos(t), np.sin(t)
        m[a, a], m[a, b], m[b, a], m[b, b] = (-s, -c, c, -s) if slope else (c, -s, s, c)
        return m

    def turn(t, slope=None):
        m = np.eye(g)
        for k in range(len(pairs)):
            m = m @ givens(k, t[k], k == slope)
        return m

    def quality(y):
        top = np.abs(y).max(1, keepdims=True)
        top[top == 0] = 1
        return 1 - (np.square(y / top).sum() / n - 1) / g

    def gradient(t, k, y):
        a = x @ turn(t, k)
        at = np.abs(y).argmax(1)
        top = y[np.arange(n), at]
        top = np.where(top == 0, 1, top)
        part = (a * y).sum(1) / top**2 - a[np.arange(n), at] * np.square(y).sum(1) / top**3
        return 2 * part.sum() / (n * g)

    y = x @ turn(angles)
    q = quality(y)

    def sweep(steps) -> None:
        nonlocal angles, y, q
        for k in range(len(pairs)):
            for step in steps(k):
                trial = angles.copy()
                trial[k] += step
                z = x @ turn(trial)
                if (now := quality(z)) > q:
                    angles, y, q = trial, z, now
                    break

    def downhill(k):
        slope = gradient(angles, k, y)
        return (-slope, -8 * slope, -slope / 8)

    for _ in range(rounds):
        before = q
        sweep(downhill)
        sweep(downhill)
        if q - before < tolerance:
            # Rows with two equal entries have no slope; fixed turns lead away from there.
            sweep(lambda k: (np.pi / 4, -np.pi / 4, 0.1, -0.1))
            if q - before < tolerance:
                break
    return y, q, turn(angles)


def rotation(vectors: np.ndarray, values: np.ndarray | None = None, near: float = 1e-3) -> np.ndarray:
    """Matrix that turns the columns so that a row's group is its largest entry; rotations of the first 2, 3, ... columns are compared, and the last within `near` of the best one counts.

    values: the eigenvalues, if known; columns that share the greatest one belong to parts
    of the graph without a connection, any mixture of them is as good, and so they are
    only looked at together.
    """
    n, dims = vectors.shape
    found = np.eye(dims)[:, :1]
    if n < 2 or dims < 2:
        return found
    first = 2 if values is None else max(2, int((values > values[0] - 1e-6).sum()))
    so_far, best = np.eye(dims)[:, : first - 1], -np.inf
    for g in range(first, dims + 1):
        so_far = np.column_stack([so_far, np.eye(dims)[:, g - 1]])
        _, q, turn = rotate(vectors @ so_far)
        so_far = so_far @ turn
        if q >= best - near:
            found = so_far
        best = max(best, q)
    return found


def group(vectors: np.ndarray, values: np.ndarray | None = None, near: float = 1e-3) -> np.ndarray:
    """Group of each row by the rotation of the columns."""
    return np.unique(np.abs(vectors @ rotation(vectors, values, near)).argmax(1), return_inverse=True)[1]


def spectral_clusters(edges: DataFrame, dims: int = 16, dense: int = DENSE_VERTICES) -> DataFrame:
    """(cluster, read_id, rank, distance): groups of the graph's vertices, ordered by their distance to the group's mean.

    Vertices are those of edges.  A graph of up to `dense` vertices is solved in one task,
    a larger one by products of matrix and vectors over the edges; there the rotation is
    learnt on about ROTATED_VERTICES vertices, by a hash, and turns all.
    """
    n = edges.select("x").union(edges.select("y")).distinct().count()
    lap = normalised(affinity(edges))
    if n > dense:
        vectors, values = leading(checkpointed(lap), dims)
        share = F.pmod(F.xxhash64("i"), F.lit(1 << 53)) / float(1 << 53)
        some = sorted(vectors.where(share < ROTATED_VERTICES / n).collect())  # about ROTATED_VERTICES rows of dims numbers
        turn = rotation(np.array([r["v"] for r in some]), values)
        turned = F.array(*(sum((F.col("v")[a] * F.lit(float(c)) for a, c in enumerate(column)), F.lit(0.0)) for column in turn.T))
        at = F.array_position(F.transform(turned, F.abs), F.array_max(F.transform(turned, F.abs))) - 1
        points = vectors.select(at.cast("bigint").alias("cluster"), F.col("i").alias("read_id"), "v")
        return by_centroid_distance(points, "cluster", "read_id", "v").select("cluster", "read_id", (F.col("rank") - 1).cast("bigint").alias("rank"), "distance")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows["i"])
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])] = rows["w"]
        v, values = eigenvectors((m + m.T) / 2, dims)
        out = pd.DataFrame({"read_id": ids, "cluster": group(v, values)})
        return pd.concat([out, pd.DataFrame(v, columns=[f"v{k}" for k in range(v.shape[1])])], axis=1).pipe(_ordered)

    return lap.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "cluster bigint, read_id bigint, rank bigint, distance double")


def leading(matrix: DataFrame, dims: int, degree: int = 6, rounds: int = 60, tolerance: float = 1e-4, spare: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(i, v): the eigenvectors of the dims greatest eigenvalues, one number each; and the eigenvalues.

    matrix: (i, j, w), symmetric, with eigenvalues from -1 to 1, not all entries of a row 0.
    Subspace rounds: Chebyshev polynomials of the matrix damp all below the least Ritz value
    kept, and a Rayleigh-Ritz step turns the vectors (their products, numbers by dims + spare
    squared, come to the driver; the vectors stay where they are).  Rounds end when no wanted
    pair's residual is above tolerance; if they run out, that is logged.
    """
    width = dims + spare
    now, old = [f"v{k}" for k in range(width)], [f"u{k}" for k in range(width)]
    loops = matrix.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(None).cast("double").alias("w"))
    links = checkpointed(matrix.where("i <> j").select("i", "j", "w").union(loops))

    def step(rows: DataFrame, scale: float, own: float, before: float) -> DataFrame:
        """v: scale * matrix * v + own * v + before * u; u: the former v.  Rows without a weight stand for the diagonal."""
        met = links.join(rows.withColumnRenamed("i", "j"), "j")
        new = (F.sum(F.when(F.col("w").isNull(), F.col(a) * own + F.col(b) * before).otherwise(F.col("w") * F.col(a) * scale)).alias(a) for a, b in zip(now, old))
        return met.groupBy("i").agg(*new, *(F.sum(F.when(F.col("w").isNull(), F.col(a))).alias(b) for a, b in zip(now, old)))

    def columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])

    def products(batches):
        total = np.zeros((3, width, width))
        for rb in batches:
            v, u = columns(rb, now), columns(rb, old)
            total += np.stack([u.T @ u, u.T @ v, v.T @ v])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    rows = loops.select("i", *((F.pmod(F.xxhash64("i", F.lit(k)), F.lit(2_000_003)) / 1_000_001.0 - 1).alias(c) for k, c in enumerate(now)), *(F.lit(0.0).alias(c) for c in old))
    for turn in range(rounds):
        rows = checkpointed(step(rows, 1.0, 0.0, 0.0))
        total = np.zeros(3 * width * width)
        for r in rows.mapInArrow(products, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # 3 * width * width numbers
            total[r["at"]] = r["x"]
        g, h, m = total.reshape(3, width, width)
        size, axes = np.linalg.eigh(g)
        sound = size > size[-1] * 1e-13
        white = axes[:, sound] / np.sqrt(size[sound])
        h = white.T @ ((h + h.T) / 2) @ white
        values, inner = np.linalg.eigh((h + h.T) / 2)
        values, mix = values[::-1], white @ inner[:, ::-1]
        left = np.sqrt(np.maximum(np.einsum("ak,ab,bk->k", mix, m, mix) - values**2, 0))[:dims]
        done = left.max() <= tolerance or turn == rounds - 1
        if done:
            break
        low = max(0.0, float(values[-1]))
        centre, half = (low - 1) / 2, (low + 1) / 2
        full = np.zeros((width, width))
        full[:, : mix.shape[1]] = mix

        def turned(batches, full=full):
            for rb in batches:
                v = columns(rb, old) @ full
                yield pa.RecordBatch.from_arrays([rb.column("i"), *(pa.array(c) for c in np.ascontiguousarray(v.T)), *[pa.array(np.zeros(len(v)))] * width], ["i", *now, *old])

        rows = rows.select("i", *now, *old).mapInArrow(turned, rows.select("i", *now, *old).schema)
        rows = step(rows, 1 / half, -centre / half, 0.0)
        for _ in range(degree - 1):
            rows = step(rows, 2 / half, -2 * centre / half, -1.0)
        rows = checkpointed(rows)
    if left.max() > tolerance:
        _log.warning("eigenvectors after %d rounds: residual %g", rounds, left.max())
    final = mix[:, :dims]

    def vectors(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("i"), pa.array(list(columns(rb, old) @ final), pa.list_(pa.float64()))], ["i", "v"])

    return checkpointed(rows.select("i", *now, *old).mapInArrow(vectors, "i bigint, v array<double>")), values[:dims]


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    cols = [c for c in rows if c.startswith("v")]
    mean = rows.groupby("cluster")[cols].transform("mean")
    rows["distance"] = np.square(rows[cols] - mean).sum(axis=1)
    rows["rank"] = rows.sort_values(["distance", "read_id"]).groupby("cluster").cumcount()
    return rows[["cluster", "read_id", "rank", "distance"]]


def by_centroid_distance(points: DataFrame, key: str, item: str, values: str) -> DataFrame:
    """(key, item, distance, rank): items by squared distance to the mean of their group; values: an array column."""
    from pyspark.sql import Window as W

    each = points.select(key, item, F.posexplode(values).alias("k", "v"))
    mean = each.groupBy(key, "k").agg(F.avg("v").alias("mean"))
    d = each.join(mean, [key, "k"]).groupBy(key, item).agg(F.sum(F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("distance"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("distance", item)))


def kmeans_step(points: DataFrame, centres: list[list[float]], item: str, values: str) -> DataFrame:
    """(item, values, cluster, distance): nearest centre by squared distance, the first among equals."""
    def to(c):
        return F.aggregate(F.zip_with(F.col(values), F.array(*(F.lit(float(v)) for v in c)), lambda a, b: F.pow(a.cast("double") - b, F.lit(2))), F.lit(0.0), lambda s, v: s + v)

    best = F.array_min(F.array(*(F.struct(to(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres))))
    return points.select(item, values, best.alias("__b__")).select(item, values, "__b__.cluster", "__b__.distance")


def kmeans(points: DataFrame, k: int, item: str, values: str, rounds: int = 100, tolerance: float = 1e-10) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's rounds from the k distinct points of the lowest hashes; each round is one aggregation."""
    start = points.groupBy(values).agg(F.min(F.xxhash64(item)).alias("h")).orderBy("h").limit(k).collect()  # k rows
    centres = [[float(v) for v in r[values]] for r in start]
    for _ in range(rounds):
        means = kmeans_step(points, centres, item, values).select("cluster", F.posexplode(values).alias("d", "v")).groupBy("cluster", "d").agg(F.avg("v").alias("m")).collect()  # k centres
        new = [list(c) for c in centres]
        for r in means:
            new[r["cluster"]][r["d"]] = r["m"]
        moved = max((sum((a - b) ** 2 for a, b in zip(p, q)) for p, q in zip(centres, new)), default=0.0)
        centres = new
        if moved <= tolerance:
            break
    return kmeans_step(points, centres, item, values), centres
