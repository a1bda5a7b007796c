"""k-means, logistic regression and least squares steps: sums over all rows, combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance


def means(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, center): element-wise means."""
    parts = points.select(cluster, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def nearest(points: DataFrame, vector: str, centers: list[tuple[int, list[float]]]) -> DataFrame:
    """Adds cluster and distance (squared); ties go to the smallest id. Centers are few and ride along as literals."""
    if not centers:
        raise ValueError("no centers")
    v = F.col(vector).cast("array<double>")
    each = [F.struct(squared_distance(v, F.array(*map(F.lit, c))).alias("distance"), F.lit(k).cast("bigint").alias("cluster")) for k, c in sorted(centers)]
    best = F.array_min(F.array(*each))
    return points.withColumn("_best", best).withColumns({"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop("_best")


def kmeans(points: DataFrame, vector: str, centers: list[tuple[int, list[float]]], rounds: int) -> list[tuple[int, list[float]]]:
    """Lloyd's rounds; a cluster that loses all its points keeps its center."""
    for _ in range(rounds):
        moved = {r.cluster: list(r.center) for r in means(nearest(points, vector, centers), "cluster", vector).collect()}  # one row a cluster
        centers = [(k, moved.get(k, c)) for k, c in centers]
    return centers


def kmeans_cost(points: DataFrame, vector: str, centers: list[tuple[int, list[float]]]) -> DataFrame:
    return nearest(points, vector, centers).agg(F.sum("distance").alias("cost"))


def bisecting_kmeans(points: DataFrame, vector: str, clusters: int, rounds: int = 4, seed: int = 1) -> list[tuple[int, list[float]]]:
    """Splits the cluster of largest cost in two until there are ``clusters``."""
    whole = means(points.withColumn("cluster", F.lit(0).cast("bigint")), "cluster", vector).first()
    centers = [(0, list(whole.center))]
    while len(centers) < clusters:
        tagged = nearest(points, vector, centers)
        worst = tagged.groupBy("cluster").agg(F.sum("distance").alias("cost"), F.count("*").alias("n")).where("n > 1").orderBy(F.desc("cost"), "cluster").first()
        if worst is None or worst.cost == 0:
            return centers
        mine = tagged.where(F.col("cluster") == worst.cluster)
        seeds = mine.orderBy(F.rand(seed)).limit(2).select(vector).collect()
        new = max(k for k, _ in centers) + 1
        pair = kmeans(mine.drop("cluster", "distance"), vector, [(worst.cluster, [float(x) for x in seeds[0][0]]), (new, [float(x) for x in seeds[1][0]])], rounds)
        centers = [c for c in centers if c[0] != worst.cluster] + pair
    return sorted(centers)


def gradient(rows: DataFrame, features: list[Column], target: Column, prediction) -> DataFrame:
    """One row: sum of (prediction - target) * feature for each feature, and n. ``prediction``: features -> column."""
    error = prediction(features) - target
    sums = [F.sum(error * x).alias(f"g{i}") for i, x in enumerate(features)]
    return rows.agg(*sums, F.count("*").alias("n"))


def logistic_step(rows: DataFrame, features: list[Column], target: Column, weights: list[float], rate: float) -> DataFrame:
    """Weights after one full-batch step: columns w0, w1, ..."""
    score = lambda xs: 1 / (1 + F.exp(-sum((F.lit(w) * x for w, x in zip(weights, xs)), F.lit(0.0))))
    g = gradient(rows, features, target, score)
    return g.select(*((F.lit(w) - rate * F.col(f"g{i}") / F.col("n")).alias(f"w{i}") for i, w in enumerate(weights)))


def least_squares_step(rows: DataFrame, features: list[Column], target: Column, weights: list[float], rate: float) -> DataFrame:
    linear = lambda xs: sum((F.lit(w) * x for w, x in zip(weights, xs)), F.lit(0.0))
    g = gradient(rows, features, target, linear)
    return g.select(*((F.lit(w) - rate * F.col(f"g{i}") / F.col("n")).alias(f"w{i}") for i, w in enumerate(weights)))


def mini_batch_descent(rows: DataFrame, features: list[Column], target: Column, weights: list[float], rate: float, batches: list[Column]) -> list[float]:
    """Least squares by one step a batch, the i-th (from 1) at ``rate / sqrt(i)``. ``batches``: conditions that pick rows.

    A step reads one row of sums; a batch without rows leaves the weights alone.
    """
    for i, batch in enumerate(batches, 1):
        step = least_squares_step(rows.where(batch), features, target, weights, rate / i**0.5).first()
        weights = [w if new is None else new for w, new in zip(weights, step)]
    return weights
