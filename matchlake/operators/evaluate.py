"""Retrieval metrics, calibration, intervals and folds, all from one row a query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import tables as T


def retrieval_metrics(rows: DataFrame, threshold: float = T.VISUAL["threshold"], margin: float = T.VISUAL["margin"]) -> DataFrame:
    """One row of metrics from (query_id, rank_of_truth, score, margin, correct).

    rank_of_truth is null where the truth was not found; accepted: score and margin reach
    the thresholds.
    """
    ok = (F.col("score") >= threshold) & (F.col("margin") >= margin)
    n = F.count("*")
    hit = lambda k: F.round(F.sum(F.when(F.col("rank_of_truth") <= k, 1).otherwise(0)) / n, 6)
    accepted, false = F.sum(ok.cast("int")).cast("long"), F.sum((ok & ~F.col("correct")).cast("int")).cast("long")
    return rows.agg(
        n.alias("queries"), hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"), F.round(F.avg(F.coalesce(1 / F.col("rank_of_truth"), F.lit(0.0))), 6).alias("mrr"),
        accepted.alias("accepted"), F.round(accepted / n, 6).alias("coverage"), F.round(1 - false / F.when(accepted > 0, accepted), 6).alias("precision"), false.alias("false_accepts"),
    )


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share; 0 without trials."""
    p = k / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, bound).otherwise(F.lit(0.0))


def threshold_grid(rows: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """(threshold, margin, accepted, right) for each pair: one pass over the rows, then sums over the grid.

    Each row counts once, at the highest threshold and margin it reaches; a grid cell sums the
    cells over it, so rows are not multiplied by the grid.
    """
    step = lambda c, grid: F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: F.col(c) >= g - 1e-9))
    cells = rows.groupBy(step("score", thresholds).alias("i"), step("margin", margins).alias("j")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("ok"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i + 1, j + 1, float(t), float(m)) for i, t in enumerate(thresholds) for j, m in enumerate(margins)], "gi int, gj int, threshold double, margin double")
    # at most (thresholds + 1) x (margins + 1) cells on the other side
    both = grid.join(F.broadcast(cells), (F.col("i") >= F.col("gi")) & (F.col("j") >= F.col("gj")), "left")
    return both.groupBy("threshold", "margin").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("accepted"), F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("right"))


def choose_threshold(grid: DataFrame, least: int = 20, precision: float = 0.98, wilson: float = 0.90) -> DataFrame:
    """The cell that accepts most under the constraints; ties to precision, then to lower thresholds."""
    p, w = F.col("right") / F.when(F.col("accepted") > 0, F.col("accepted")), wilson_lower(F.col("right"), F.col("accepted"))
    rows = grid.withColumn("precision", F.round(p, 6)).withColumn("wilson", F.round(w, 6)).where((F.col("accepted") >= least) & (F.col("precision") >= precision) & (F.col("wilson") >= wilson))
    return rows.orderBy(F.desc("accepted"), F.desc("precision"), "threshold", "margin").limit(1)


def threshold_curve(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, precision): share of rows at or over each threshold, and how many of them are right."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    n = rows.agg(F.count("*").alias("n"))
    each = rows.select("correct", F.explode(F.filter(grid, lambda t: F.col("score") >= t)).alias("threshold"))
    sums = each.groupBy("threshold").agg(F.count("*").alias("k"), F.sum(F.col("correct").cast("int")).alias("ok"))
    return sums.join(F.broadcast(n)).select("threshold", F.round(F.col("k") / F.col("n"), 6).alias("kept"), F.round(F.col("ok") / F.col("k"), 6).alias("precision"))


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median and 95th percentile by linear interpolation."""
    return rows.groupBy(key).agg(F.count("*").alias("samples"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.percentile(value, 0.95), 6).alias("p95"))


def status_pivot(rows: DataFrame, key: str, status: str, names: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(status, names).agg(F.count(F.lit(1))).na.fill(0)


def folds(rows: DataFrame, key: Column, n: int, seed: str = "fold") -> DataFrame:
    """fold 0..n-1 by a hash of the key: no shuffle, and the same at any size."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def paired_bootstrap(rows: DataFrame, group: str, a: str, b: str, samples: int = 2000, seed: int = 7) -> DataFrame:
    """(low, mean, high): 95 % interval of mean(b) - mean(a), groups drawn with replacement.

    Each group gets a Poisson(1) weight for each resample; sums of weighted differences are
    partial aggregates, and only the resamples' means are sorted.
    """
    per = rows.groupBy(group).agg(F.sum(F.col(b) - F.col(a)).alias("d"), F.count("*").alias("n"))

    def draw(batches):
        d_sum, n_sum = np.zeros(samples), np.zeros(samples)
        for pdf in batches:
            for key, d, n in zip(pdf["key"], pdf["d"], pdf["n"]):
                w = np.random.default_rng([seed, int(key) & 0x7FFFFFFF]).poisson(1.0, samples)
                d_sum += w * d
                n_sum += w * n
        yield pd.DataFrame({"sample": np.arange(samples), "d": d_sum, "n": n_sum})

    drawn = per.select(F.xxhash64(group).alias("key"), F.col("d").cast("double").alias("d"), F.col("n").cast("double").alias("n")).mapInPandas(draw, "sample long, d double, n double")
    means = drawn.groupBy("sample").agg((F.sum("d") / F.sum("n")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("high"))


def conditional_logit(rows: DataFrame, features: list[str], l2: float = 0.05, steps: int = 30, start: list[float] | None = None) -> list[float]:
    """Weights of a softmax over each query's candidates that make ``correct`` likely.

    rows (query_id, correct, features..). Newton steps on sums that each task makes of whole
    queries; a step moves features x features numbers to the driver.
    """
    k = len(features)
    w = np.array(start if start is not None else [1.0, *[0.0] * (k - 1)], float)
    packed = rows.select("query_id", F.struct(F.col("correct").cast("int").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).alias("r")).groupBy("query_id").agg(F.collect_list("r").alias("rows")).cache()
    for _ in range(steps):
        weights = w.copy()

        def sums(batches, weights=weights):
            g, h, n = np.zeros(k), np.zeros((k, k)), 0
            for pdf in batches:
                for own in pdf["rows"]:
                    x, y = np.array([r["x"] for r in own]), np.array([r["y"] for r in own], bool)
                    if not y.any():
                        continue
                    z = x @ weights
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    mean = p @ x
                    g += x[y].mean(axis=0) - mean
                    h += (x * p[:, None]).T @ x - np.outer(mean, mean)
                    n += 1
            yield pd.DataFrame({"i": np.arange(k * k + k + 1), "v": np.concatenate((g, h.reshape(-1), [n]))})

        found = {r["i"]: r["v"] for r in packed.mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        if not found or not found[k * k + k]:
            break
        n = found[k * k + k]
        g = np.array([found[i] for i in range(k)]) / n - l2 * w
        h = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / n + l2 * np.eye(k)
        move = np.linalg.solve(h, g)
        w = w + move * min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    packed.unpersist()
    return w.tolist()


def adapter(vectors: Column, w1: np.ndarray, w2: np.ndarray) -> Column:
    """Residual adapter on vectors: normalise(x + W2 gelu(W1 x))."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        hidden = x @ w1.T
        hidden = 0.5 * hidden * (1 + np.vectorize(math.erf)(hidden / math.sqrt(2)))
        x = x + hidden @ w2.T
        return pd.Series(list(x / np.linalg.norm(x, axis=1, keepdims=True)))

    return apply(vectors)


def runs(rows: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, first, last, length) of each unbroken run of true in ``order``."""
    by = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(by)).withColumn("_f", flag)
    island = F.col("_n") - F.row_number().over(W.partitionBy(key, "_f").orderBy(order))
    return rows.withColumn("_i", island).where("_f").groupBy(key, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_i")


def greedy_nms(boxes: DataFrame, key: str = "image", limit: float = 0.72) -> DataFrame:
    """Boxes (image, box, priority, ..) that no kept box of higher priority overlaps by more than ``limit``."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("priority", ascending=False, kind="stable")
        kept: list = []
        for i, b in zip(pdf.index, pdf["box"]):
            size = (b[2] - b[0]) * (b[3] - b[1])
            for _, c in kept:
                common = max(0.0, min(b[2], c[2]) - max(b[0], c[0])) * max(0.0, min(b[3], c[3]) - max(b[1], c[1]))
                if common / max(size + (c[2] - c[0]) * (c[3] - c[1]) - common, 1e-8) > limit:
                    break
            else:
                kept.append((i, b))
        return pdf.loc[[i for i, _ in kept]]

    return boxes.groupBy(key).applyInPandas(keep, boxes.schema)
