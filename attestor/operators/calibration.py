"""Expected calibration error and temperature scaling. Rows: y, pred, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.scalars import logit, predicted_class_confidence, scaled

BINS = 15


def coarse_grid() -> list[float]:
    """61 temperatures from 0.1 to 10, evenly spaced in the logarithm."""
    return [0.1 * 100 ** (k / 60) for k in range(61)]


def fine_grid(best: float) -> list[float]:
    """61 temperatures around the best coarse one."""
    return [0.7 * best + k * (0.7 * best) / 60 for k in range(61)]


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Bins are (i / bins, (i + 1) / bins]; the first also takes exactly 0."""
    lower = F.array(*[F.lit(i / bins) for i in range(bins)])
    return F.greatest(F.size(F.filter(lower, lambda e: e < confidence)) - 1, F.lit(0))


def reliability(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, bin_low, bin_high, count, confidence, accuracy) for every bin; empty bins have NaN means."""
    confidence = predicted_class_confidence(F.col("score"))
    graded = rows.select(confidence.alias("confidence"), (F.col("y") == F.col("pred")).cast("double").alias("correct"))
    found = graded.groupBy(bin_of(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))
    edges = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("bin_low"), ((F.col("id") + 1) / bins).alias("bin_high"))
    nan = F.lit(float("nan"))
    return edges.join(found, "bin", "left").select("bin", "bin_low", "bin_high", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("confidence", nan).alias("confidence"), F.coalesce("accuracy", nan).alias("accuracy"))


def expected_calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    full = reliability(rows, bins).where("count > 0")
    gap = F.sum(F.col("count") * F.abs(F.col("confidence") - F.col("accuracy")))
    return full.agg((gap / F.sum("count")).alias("ece"))


def losses(rows: DataFrame, temperatures: list[float]) -> DataFrame:
    """(t, nll) for each of some constant temperatures: one pass, combined by partition."""
    p = scaled(F.col("score"), F.col("t"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    each = rows.select("y", "score", F.explode(F.array(*map(F.lit, temperatures))).alias("t"))
    return each.groupBy("t").agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("nll"))


def fit_temperature(rows: DataFrame, split: str) -> float:
    """Temperature of least loss on two grids, the first minimum of each; for the validation split only."""
    if split != "val":
        raise ValueError(f"temperature is fitted on the validation split, not on {split!r}")
    least = lambda grid: losses(rows, grid).orderBy("nll", "t").first()["t"]
    return least(fine_grid(least(coarse_grid())))


def apply_temperature(rows: DataFrame, temperature: float) -> DataFrame:
    return rows.withColumn("score", scaled(F.col("score"), F.lit(temperature))).withColumn("pred", (F.col("score") > 0.5).cast("int"))


__all__ = ["apply_temperature", "bin_of", "coarse_grid", "expected_calibration_error", "fine_grid", "fit_temperature", "logit", "losses", "reliability"]
