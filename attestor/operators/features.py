"""Feature vectors from the signal store and embeddings; scaler; semi-joins and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.scalars import check_feature_names


def feature_name():
    return F.concat_ws("__", "signal", "region")


def structured_matrix(store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(sha256, one column a signal and region) sorted by name; names: those of the vocabulary, if known."""
    named = store.withColumn("feature", feature_name())
    if names is None:
        names = [r["feature"] for r in named.select("feature").distinct().collect()]  # the vocabulary: some hundreds
    names = check_feature_names(sorted(names))
    return named.groupBy("sha256").pivot("feature", names).agg(F.min("value")) if names else named.select("sha256").distinct()


def assemble(keys: DataFrame, embeddings: DataFrame, store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(sha256, features array<float>): embedding, then signals by name, of every key; a missing part raises."""
    wide = structured_matrix(store, names)
    joined = keys.select("sha256").join(embeddings, "sha256", "left").join(wide, "sha256", "left")
    parts = F.array(*[F.col(f"`{c}`").cast("float") for c in wide.columns if c != "sha256"])
    gone = F.raise_error(F.concat(F.lit("no features for "), F.col("sha256")))
    lacks = F.col("embedding").isNull() | F.exists(parts, lambda x: x.isNull())
    return joined.select("sha256", F.when(lacks, gone.cast("array<float>")).otherwise(F.concat("embedding", parts)).alias("features"))


def incomplete(keys: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Keys without an embedding."""
    return keys.select("sha256").join(embeddings.select("sha256"), "sha256", "left_anti")


def only_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("sha256").distinct(), "sha256", "left_semi")


def fit_scaler(vectors: DataFrame, column: str = "features") -> DataFrame:
    """(pos, mean, std): population deviation, 1.0 where it is below 1e-8. Long form: no aggregate a dimension."""
    values = vectors.select(F.posexplode(column).alias("pos", "x"))
    fitted = values.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    return fitted.select("pos", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("std"))


def scaler_row(fitted: DataFrame) -> DataFrame:
    """The scaler as one row struct(mean, std); its length is the vectors' dimension."""
    both = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return fitted.agg(both.alias("s")).select(F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["std"]).alias("std"))


def transform(vectors: DataFrame, scaler: DataFrame, column: str = "features") -> DataFrame:
    """Scaled vectors; the scaler is one row, so it travels with the plan."""
    one = scaler.first()
    mean, std = (F.array(*map(F.lit, one[c])) for c in ("mean", "std"))
    centred = F.zip_with(F.col(column), mean, lambda x, m: x.cast("double") - m)
    return vectors.withColumn(column, F.zip_with(centred, std, lambda x, s: x / s))
