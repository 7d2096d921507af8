"""Paired statistics: alignment, t-tests, bootstrap intervals, comparison tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("evidence_overlap", "rouge_l", "semantic_sim", "bert_score_f1")


def align(left: DataFrame, right: DataFrame, metric: str, order: str = "seq") -> DataFrame:
    """(user_id, movie_id, left_value, right_value) on common pairs; of repeated pairs the last by ``order`` counts."""

    def last(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("user_id", "movie_id").orderBy(F.desc(order))
        return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "movie_id", F.col(metric).alias(name))

    return last(left, "left_value").join(last(right, "right_value"), ["user_id", "movie_id"])


def paired_t(aligned: DataFrame) -> DataFrame:
    """One row: pair_count, means, mean difference, t statistic (null without spread)."""
    d = F.col("left_value") - F.col("right_value")
    agg = aligned.agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg("left_value").alias("left_mean"), F.avg("right_value").alias("right_mean"),
        F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"),
    )
    t = F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt("pair_count")))
    return agg.withColumn("t_statistic", t).drop("sd")


def t_p_value(t: float, n: int) -> float:
    """Two-sided p of Student's t with n - 1 degrees of freedom."""
    if n < 2 or t is None or math.isnan(t):
        return float("nan")
    df = n - 1
    return _beta_regular(df / (df + t * t), df / 2, 0.5)


def _beta_regular(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(min(max(x, 0.0), 1.0))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_regular(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (d if abs(d := 1 + num * d) > tiny else tiny)
        c = 1 + num / c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def bootstrap_ci(diffs: np.ndarray, rounds: int = 2000, seed: int = 42, batch: int = 50) -> tuple[float, float]:
    """2.5 and 97.5 percent quantiles of resampled means; bounded batches of draws."""
    diffs = np.asarray(diffs, float)
    if not len(diffs):
        return float("nan"), float("nan")
    rng, means = np.random.default_rng(seed), []
    for at in range(0, rounds, batch):
        draw = rng.integers(0, len(diffs), size=(min(batch, rounds - at), len(diffs)))
        means.append(diffs[draw].mean(axis=1))
    lo, hi = np.quantile(np.concatenate(means), [0.025, 0.975])
    return float(lo), float(hi)


#: Upper ends of u for Poisson(1) weights 0 to 7; beyond the last the weight is 8.
POISSON_ENDS = tuple(math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8))


def bootstrap_distributed(aligned: DataFrame, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """(ci_low, ci_high) by a Poisson bootstrap, for pair tables of any size.

    Each row draws a Poisson(1) weight per round from an md5 of its key (four
    rounds a hash), so tasks send one weighted sum per round only, and reruns, in
    any engine, give the same numbers.
    """
    d = F.col("left_value") - F.col("right_value")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // 4) - 1))).alias("block")
    rows = aligned.select(d.alias("d"), blocks, "user_id", "movie_id")
    hashed = F.md5(F.encode(F.concat_ws(":", "user_id", "movie_id", F.col("block").cast("string"), F.lit(str(seed))), "UTF-8"))
    drawn = rows.select("d", "block", hashed.alias("h")).select("d", (F.col("block") * 4).alias("first"), F.posexplode(F.array(*[F.substring("h", 8 * k + 1, 8) for k in range(4)])).alias("k", "x"))
    u = (F.conv("x", 16, 10).cast("double") + 0.5) / float(1 << 32)
    weight = sum(((u > end).cast("int") for end in POISSON_ENDS), F.lit(0))
    sums = drawn.filter(F.col("first") + F.col("k") < rounds).groupBy((F.col("first") + F.col("k")).alias("round"))
    means = sums.agg(F.try_divide(F.sum(weight * F.col("d")), F.sum(weight)).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))


def comparison_matrix(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A row per label pair and metric of the long table (label, user_id, movie_id, metric, value)."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame(pairs, "left_label string, right_label string")
    left = scores.select(F.col("label").alias("left_label"), "user_id", "movie_id", "metric", F.col("value").alias("l"))
    right = scores.select(F.col("label").alias("right_label"), "user_id", "movie_id", "metric", F.col("value").alias("r"))
    rows = left.join(F.broadcast(wanted), "left_label").join(right, ["right_label", "user_id", "movie_id", "metric"])
    d = F.col("l") - F.col("r")
    by = rows.groupBy("left_label", "right_label", "metric").agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd")
    )
    return by.withColumn("t_statistic", F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt("pair_count")))).drop("sd")


def significance_row(aligned: DataFrame, left_label: str, right_label: str, metric: str) -> dict:
    """A report row; the p-value and the interval finish on the driver from bounded numbers."""
    s = paired_t(aligned).first().asDict()
    ci = bootstrap_distributed(aligned).first()
    return {"left_label": left_label, "right_label": right_label, "metric": metric} | s | {"ci_low": ci.ci_low, "ci_high": ci.ci_high, "p_value": t_p_value(s["t_statistic"], s["pair_count"])}
