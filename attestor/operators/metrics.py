"""Evaluation metrics: point values, slices, rank AUROC, bootstrap intervals, paired deltas.

Rows to evaluate: id, y (0/1), pred (0/1), score, and where needed a slice column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.ranking import global_row_number, global_running_sum

BOOTSTRAP_SEED = 20260803
RESAMPLES = 1000
METRICS = ["accuracy", "precision", "recall", "macro_f1"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def cells(y: Column, pred: Column) -> list[Column]:
    """Conditional counts tn, fp, fn, tp."""
    n = lambda a, b, name: F.count(F.when((y == a) & (pred == b), 1)).alias(name)
    return [n(0, 0, "tn"), n(0, 1, "fp"), n(1, 0, "fn"), n(1, 1, "tp")]


def from_cells() -> list[Column]:
    """accuracy, precision, recall (of class 1) and macro F1 of the columns tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1 = lambda hit, a, b: _ratio(2 * hit, 2 * hit + a + b)
    return [
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
    ]


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*cells(F.col("y"), F.col("pred")))


def basic_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Metrics of all rows, or of each slice with its size n."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), *cells(F.col("y"), F.col("pred")))
    return counted.select(*by, "n", *from_cells())


def _auc_of(rank: Column) -> list[Column]:
    ones = F.sum(F.col("y").cast("double"))
    return [F.sum(F.when(F.col("y") == 1, rank)).alias("ranks"), ones.alias("ones"), (F.count("*") - ones).alias("zeros")]


def _auc() -> Column:
    """Mann-Whitney; null where a class is missing."""
    ones, zeros = F.col("ones"), F.col("zeros")
    return F.when((ones > 0) & (zeros > 0), (F.col("ranks") - ones * (ones + 1) / 2) / (ones * zeros))


def rank_auc(rows: DataFrame) -> DataFrame:
    """One row, auroc: ordinal ranks by (score, id), so that ties keep the order of the ids."""
    ranked = global_row_number(rows.select("id", "y", "score"), "score", "id")
    return ranked.agg(*_auc_of(F.col("rn"))).select(_auc().alias("auroc"))


def rank_auc_tied(rows: DataFrame) -> DataFrame:
    """One row, auroc with tied scores sharing their mean rank: needs counts by score only."""
    by_score = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    ranked = global_running_sum(by_score, "n", "score", name="upto")
    mean = ranked.select("ones", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    total = mean.agg(F.sum(F.col("ones") * F.col("rank")).alias("ranks"), F.sum("ones").cast("double").alias("ones"), (F.sum("n") - F.sum("ones")).cast("double").alias("zeros"))
    return total.select(_auc().alias("auroc"))


def folded_auc(rows: DataFrame, *by: str) -> DataFrame:
    """EDA: max(auc, 1 - auc) by slice, slices with both classes only, four decimals.

    Ranks are global over (slice, score, id); a slice's own start after its smallest, so that a slice
    with very many rows is no task of its own.
    """
    ranked = global_row_number(rows.select("id", "y", "score", *by), *by, "score", "id")
    sums = ranked.groupBy(*by).agg(*_auc_of(F.col("rn")), F.min("rn").alias("first"))
    auc = sums.withColumn("ranks", F.col("ranks") - F.col("ones") * (F.col("first") - 1)).withColumn("auc", _auc()).where("auc IS NOT NULL")
    return auc.select(*by, F.round(F.greatest("auc", 1 - F.col("auc")), 4).alias("auc"))


def resamples(rows: DataFrame, count: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(r, i, y, pred, score, ...): ``count`` resamples with replacement, each as large as rows.

    Draw i of resample r is row (first 32 bits of md5("seed:r:i")) mod n in the order of the ids: the
    same in any engine and for any partitioning. Made by explode on the rows' own partitions.
    """
    numbered = global_row_number(rows, "id", name="k").withColumn("k", F.col("k") - 1)
    n = numbered.count()
    draws = numbered.select(F.col("k").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("r"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string")).cast("binary"))
    draws = draws.withColumn("k", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n or 1)))
    return draws.join(numbered, "k").drop("k")


def bootstrap_by(rows: DataFrame, by: str, count: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(by, n, metric, value, ci_low, ci_high): metrics with intervals of each slice, resampled within it.

    Draw i of resample r in a slice of n rows is row (first 32 bits of md5("seed:slice:r:i")) mod n in the
    order of the ids. The AUROC of a slice without both classes is null.
    """
    numbered = global_row_number(rows.select(by, "id", "y", "pred", "score"), by, "id", name="k")
    slices = numbered.groupBy(by).agg(F.min("k").alias("first"), F.count("*").alias("n"))
    placed = numbered.join(F.broadcast(slices), by).withColumn("k", F.col("k") - F.col("first")).drop("first")  # a row for each slice
    draws = placed.select(by, "n", F.col("k").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("r"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), by, F.col("r").cast("string"), F.col("i").cast("string")).cast("binary"))
    drawn = draws.withColumn("k", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), "n")).drop("n").join(placed.drop("id", "n"), [by, "k"])
    rank = lambda *within: F.row_number().over(Window.partitionBy(by, *within[:-1]).orderBy("score", within[-1]))
    measured = lambda df, *keys: df.groupBy(by, *keys).agg(F.count("*").alias("n"), *cells(F.col("y"), F.col("pred")), *_auc_of(F.col("rn"))).select(by, "n", *from_cells(), _auc().alias("auroc"))
    names = [*METRICS, "auroc"]
    ci = measured(drawn.withColumn("rn", rank("r", "i")), "r").groupBy(by).agg(*[c for m in names for c in _interval(m)])
    point = measured(placed.drop("n").withColumn("rn", rank("id")))
    return point.join(ci, by).select(by, "n", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_low").alias("ci_low"), F.col(f"{m}_high").alias("ci_high")) for m in names])))


def _interval(name: str) -> list[Column]:
    # draws without both classes have no AUROC and take no part in its bounds
    bounds = F.percentile(name, F.array(F.lit(0.025), F.lit(0.975)))
    return [bounds[0].alias(f"{name}_low"), bounds[1].alias(f"{name}_high")]


def bootstrap_metrics(rows: DataFrame, count: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(metric, value, ci_low, ci_high) for the basic metrics and AUROC: percentile intervals, linear interpolation."""
    drawn = resamples(rows.select("id", "y", "pred", "score"), count, seed)
    rank = F.row_number().over(Window.partitionBy("r").orderBy("score", "i"))
    each = drawn.withColumn("rn", rank).groupBy("r").agg(*cells(F.col("y"), F.col("pred")), *_auc_of(F.col("rn"))).select(*from_cells(), _auc().alias("auroc"))
    names = [*METRICS, "auroc"]
    ci = each.agg(*[c for m in names for c in _interval(m)])
    point = basic_metrics(rows).crossJoin(rank_auc(rows))  # one row each
    joined = point.crossJoin(ci)
    return joined.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_low").alias("ci_low"), F.col(f"{m}_high").alias("ci_high")) for m in names])))


def paired_delta(a: DataFrame, b: DataFrame, metric: str = "macro_f1", names: tuple[str, str] = ("a", "b"), count: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """One row: metric of a minus metric of b on the same resamples; an exact tie favours b."""
    both = a.select("id", "y", F.col("pred").alias("pred_a")).join(b.select("id", F.col("pred").alias("pred_b")), "id")
    value = lambda df, p: df.groupBy("r").agg(*cells(F.col("y"), F.col(p))).select("r", dict(zip(METRICS, from_cells(), strict=True))[metric].alias(p))
    drawn = resamples(both, count, seed)
    each = value(drawn, "pred_a").join(value(drawn, "pred_b"), "r").select((F.col("pred_a") - F.col("pred_b")).alias("d"))
    bounds = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    point = value(both.withColumn("r", F.lit(0)), "pred_a").join(value(both.withColumn("r", F.lit(0)), "pred_b"), "r").select((F.col("pred_a") - F.col("pred_b")).alias("delta"))
    out = point.crossJoin(each.agg(bounds[0].alias("ci_low"), bounds[1].alias("ci_high")))  # one row each
    return out.select(F.lit(metric).alias("metric"), "delta", "ci_low", "ci_high", F.when(F.col("delta") > 0, names[0]).otherwise(names[1]).alias("favors"))


def force_failures_wrong(rows: DataFrame) -> DataFrame:
    """Failed predictions count as the wrong class; scores stay."""
    return rows.withColumn("pred", F.when(F.col("failed"), 1 - F.col("y")).otherwise(F.col("pred")))


def failure_taxonomy(rows: DataFrame) -> DataFrame:
    return rows.where("failed").groupBy("failure").count()
