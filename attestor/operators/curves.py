"""Ghost curves in columns: the strongest interior dip of an array of errors by quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.kernels import QUALITIES


def strongest_dips(curves: DataFrame, curve: str = "curve", qualities: list[int] = QUALITIES) -> DataFrame:
    """(all columns, quality, depth): the first deepest dip relative to the mean, else the minimum's quality and 0."""
    c = F.col(curve)
    mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    inner = F.slice(c, 2, F.size(c) - 2)

    def depth(x: Column, i: Column) -> Column:
        lift = F.least(F.get(c, i), F.get(c, i + 2)) - x
        return F.when(lift > 0, lift / (mean + 1e-12)).otherwise(0.0)

    depths = F.transform(inner, depth)
    most = F.array_max(depths)
    names = F.array(*[F.lit(float(q)) for q in qualities])
    at = F.when(most > 0, F.array_position(depths, most) + 1).otherwise(F.array_position(c, F.array_min(c)))
    return curves.withColumn("quality", F.element_at(names, at.cast("int"))).withColumn("depth", most)
