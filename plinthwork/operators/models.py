"""Logistic models by Newton steps on aggregated normal equations, out-of-fold predictions, and ranges of errors.

Rows never leave the executors: each step sums gradients and second derivatives, a few numbers a model, and only these
are solved on the driver. Any number of models (one for each held-out fold, and one of all rows) step together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = -1


def fold_of(group, folds: int) -> Column:
    """Fold of a group by the first 32 bits of its MD5: all rows of a group are in one; a null group is in fold 0."""
    digest = F.conv(F.substring(F.md5((F.col(group) if isinstance(group, str) else group).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(digest % folds, F.lit(0).cast("long"))


def standard(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with each feature centred and scaled by its population deviation (a constant one is only centred), under ``z_`` names."""
    stats = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    return df.withColumns({f"z_{c}": (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"sd_{c}"] or 1.0) for c in features})


def _linear(weights: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], features):
        out = out + F.col(c) * float(w)
    return out


def logistic(df: DataFrame, features: list[str], label: str, fold: str | None = None, folds: int = 0, ridge: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """Intercept and coefficients of each model: ``ALL`` rows, and with ``fold`` one for each fold that is left out.

    ``ridge`` is the penalty on half the squared coefficients, none on the intercept. Rows with a null are left out.
    A model without both labels keeps its start of zeros.
    """
    models = [ALL, *range(folds)] if fold else [ALL]
    given = df.where(" and ".join(f"`{c}` is not null" for c in [*features, label])).select(*features, F.col(label).cast("double").alias("__y"), *([F.col(fold).alias("__fold")] if fold else []))
    k = 1 + len(features)
    weights = {m: np.zeros(k) for m in models}
    stopped: set[int] = set()
    for _ in range(rounds):
        running = [m for m in models if m not in stopped]
        if not running:
            break
        # Weights are data, not code: every round runs the same compiled plan.
        told = F.array(*[F.struct(F.lit(m).alias("m"), *[F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(weights[m])]) for m in running])
        each = given.withColumn("__m", F.explode(told))
        each = each.where((F.col("__m.m") == ALL) | (F.col("__fold") != F.col("__m.m"))) if fold else each
        z = F.col("__m.w0")
        for i, c in enumerate(features):
            z = z + F.col(c) * F.col(f"__m.w{i + 1}")
        x = [F.lit(1.0), *[F.col(c) for c in features]]
        p, y = F.col("__p"), F.col("__y")
        sums = [F.sum((y - p) * x[i]).alias(f"g_{i}") for i in range(k)] + [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)]
        rows = each.withColumn("__p", 1 / (1 + F.exp(-z))).groupBy("__m.m").agg(*sums, F.sum("__y").alias("y"), F.count(F.lit(1)).alias("n")).collect()  # a few numbers a model
        found = {r["m"]: r for r in rows}
        for m in running:
            got = found.get(m)
            if got is None or got["y"] in (0.0, float(got["n"])):
                stopped.add(m)
                continue
            penalty = np.full(k, ridge)
            penalty[0] = 0.0
            g = np.array([got[f"g_{i}"] for i in range(k)]) - penalty * weights[m]
            h = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    h[i, j] = h[j, i] = got[f"h_{i}_{j}"]
            step = np.linalg.lstsq(h + np.diag(penalty), g, rcond=None)[0]
            weights[m] = weights[m] + step
            if np.abs(step).max() < tolerance:
                stopped.add(m)
    return weights


def scored_out_of_fold(df: DataFrame, features: list[str], weights: dict[int, np.ndarray], fold: str, name: str = "probability") -> DataFrame:
    """``df`` with the probability of the model that never saw the row's fold; null features give null."""
    out = None
    for m, w in sorted(weights.items()):
        if m != ALL:
            p = 1 / (1 + F.exp(-_linear(w, features)))
            out = F.when(F.col(fold) == m, p) if out is None else out.when(F.col(fold) == m, p)
    return df.withColumn(name, out)


def suggested_weights(coefficients: dict[str, float], total: float = 10.0) -> dict[str, float]:
    """Shares of the absolute coefficients, of a total; of all zeros, zeros."""
    size = sum(abs(c) for c in coefficients.values())
    return {n: (total * abs(c) / size if size else 0.0) for n, c in coefficients.items()}


def error_ranges(df: DataFrame, cells: tuple[str, str], category: str, error: str, shares: tuple[float, float] = (0.15, 0.85), width: float = 0.01, least: int = 30) -> DataFrame:
    """``cell1, cell2, category, n, low, high``: quantiles of the error by both cells, by either one ('*'), and over all.

    Errors are counted in bins of ``width`` (at their centres); counts of wider cells are sums of those of narrower ones, so that
    one shuffle of counts serves all, and a quantile is within half a width of the exact one (linear between ranks).
    Cells of fewer than ``least`` errors are left out. Null errors do not count; null cells are cells of their own.
    """
    a, b = cells
    bins = df.where(F.col(error).isNotNull()).groupBy(F.col(a).cast("string").alias("cell1"), F.col(b).cast("string").alias("cell2"), F.col(category).alias("category"), F.floor(F.col(error) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    star = F.array(F.struct("cell1", "cell2"), F.struct("cell1", F.lit("*").alias("cell2")), F.struct(F.lit("*").alias("cell1"), "cell2"), F.struct(F.lit("*").alias("cell1"), F.lit("*").alias("cell2")))
    wide = bins.select(F.explode(star).alias("c"), "category", "bin", "n").groupBy("c.cell1", "c.cell2", "category", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("cell1", "cell2", "category")
    ranked = wide.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).where(F.col("all") >= least)

    def at(rank):
        """Centre of the bin with the given rank from 0."""
        return F.min(F.when(F.col("upto") > rank, (F.col("bin") + 0.5) * width))

    parts = []
    for i, share in enumerate(shares):
        h = (F.col("all") - 1) * share
        parts += [at(F.floor(h)).alias(f"a{i}"), at(F.ceil(h)).alias(f"b{i}"), F.max(h - F.floor(h)).alias(f"f{i}")]
    got = ranked.groupBy("cell1", "cell2", "category").agg(F.max("all").alias("n"), *parts)
    value = lambda i: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")
    return got.select("cell1", "cell2", "category", "n", value(0).alias("low"), value(1).alias("high"))
