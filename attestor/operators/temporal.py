"""Clips: scene changes, frame sampling, temporal aggregation of frame verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTOGRAM_BINS = 32
SCENE_CHANGE = 0.35
DEFAULT_FRAMES = 8


def histogram(pixels: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """Shares of gray values 0..255 in equal bins, the last one closed."""
    at = lambda p: F.least(F.floor(p * bins / 255.0), F.lit(bins - 1)).cast("int")
    counts = F.aggregate(pixels, F.array_repeat(F.lit(0), bins), lambda acc, p: F.transform(acc, lambda c, i: c + (i == at(p)).cast("int")))
    return F.transform(counts, lambda c: c / F.size(pixels))


def scene_changes(frames: DataFrame, threshold: float = SCENE_CHANGE) -> DataFrame:
    """Frames (clip, frame_index, hist) at which half the L1 distance to the frame before exceeds the threshold."""
    before = F.lag("hist").over(Window.partitionBy("clip").orderBy("frame_index"))
    apart = F.aggregate(F.zip_with("hist", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2
    moved = frames.withColumn("before", before).withColumn("distance", F.when(F.col("before").isNotNull(), apart))
    return moved.where(F.col("distance") > threshold).select("clip", "frame_index", "distance")


def uniform_indices(n: Column, count: int = DEFAULT_FRAMES) -> Column:
    """Evenly spaced frame numbers of n frames, truncated; the first and the last included."""
    m = F.least(F.lit(count).cast("long"), n.cast("long"))
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(0.0)
    last = F.when(m > 1, n - 1).otherwise(0).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda k: F.when(k == m - 1, last).otherwise(F.floor(k * step)))


def sample_frames(clips: DataFrame, cuts: DataFrame, count: int = DEFAULT_FRAMES) -> DataFrame:
    """(clip, frame_index, is_scene_boundary) of uniform samples of clips (clip, n) and of cuts; a cut on a sample is no boundary."""
    uniform = clips.where("n > 0").select("clip", F.explode(uniform_indices(F.col("n"), count)).alias("frame_index")).distinct()
    extra = cuts.select("clip", F.col("frame_index").cast("long").alias("frame_index")).distinct().join(uniform, ["clip", "frame_index"], "left_anti")
    return uniform.withColumn("is_scene_boundary", F.lit(False)).unionByName(extra.withColumn("is_scene_boundary", F.lit(True)))


def aggregate_clips(frames: DataFrame) -> DataFrame:
    """One verdict for each clip from its frames' verdicts (clip, frame_index, ok, label, confidence, cited).

    The label of more summed confidence wins (ties: manipulated); its share is damped by how often
    the label flips between neighbouring parsed frames. Drift is the mean Jaccard distance of
    neighbours' citations, where they cite anything. Clips without a parsed frame: manipulated, 0.5.
    """
    parsed = F.col("ok") & F.col("label").isNotNull()
    order = Window.partitionBy("clip", "parsed").orderBy("frame_index")
    rows = frames.withColumn("parsed", F.coalesce(parsed, F.lit(False)))
    rows = rows.withColumn("before", F.lag("label").over(order)).withColumn("cited_before", F.lag("cited").over(order))
    union = F.size(F.array_union("cited", "cited_before"))
    drift = 1 - F.size(F.array_intersect("cited", "cited_before")) / union
    p = F.col("parsed")
    weight = lambda label: F.coalesce(F.sum(F.when(p & (F.col("label") == label), F.col("confidence"))), F.lit(0.0))
    sums = rows.groupBy("clip").agg(
        F.count(F.when(p, 1)).alias("parsed_frames"), F.count(F.when(~p, 1)).alias("failed_frames"), weight("manipulated").alias("m"), weight("authentic").alias("a"),
        F.count(F.when(p & (F.col("before") != F.col("label")), 1)).alias("flips"), F.avg(F.when(p & F.col("cited_before").isNotNull() & (union > 0), drift)).alias("drift"),
    )
    flip = F.when(F.col("parsed_frames") > 1, F.col("flips") / (F.col("parsed_frames") - 1)).otherwise(0.0)
    total = F.col("m") + F.col("a")
    share = F.when(total > 0, F.greatest("m", "a") / total).otherwise(0.5)
    none = F.col("parsed_frames") == 0
    return sums.select(
        "clip", F.when(none | (F.col("m") >= F.col("a")), "manipulated").otherwise("authentic").alias("label"), F.when(none, 0.5).otherwise(share * (1 - flip / 2)).alias("confidence"),
        flip.alias("flip_rate"), F.coalesce("drift", F.lit(0.0)).alias("signal_drift"), "parsed_frames", "failed_frames",
    )
