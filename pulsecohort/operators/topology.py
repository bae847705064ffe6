"""Where branches lie: quadrant by pixel majority, overlapping regions, region medians, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quadrants in the order in which a tie is settled.
QUADRANTS = ("NE", "NW", "SW", "SE")


def flip_y(y: Column, height: Column) -> Column:
    return height - 1 - y


def quadrant(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.concat(F.when(y < cy, "S").otherwise("N"), F.when(x < cx, "W").otherwise("E"))


def quadrant_majority(pixels: DataFrame, branch: str = "label") -> DataFrame:
    """The quadrant with most of a branch's pixels; ``pixels`` is (acq, branch, x, y, cx, cy)."""
    counts = pixels.withColumn("quadrant", quadrant(*(F.col(c) for c in ("x", "y", "cx", "cy")))).groupBy("acq", branch, "quadrant").agg(F.count(F.lit(1)).alias("pixels"))
    order = F.array_position(F.array(*map(F.lit, QUADRANTS)), F.col("quadrant"))
    return counts.groupBy("acq", branch).agg(F.max_by(F.struct("quadrant", "pixels"), F.struct("pixels", -order)).alias("b")).select("acq", branch, "b.quadrant", "b.pixels")


def regions(of_branch: DataFrame) -> DataFrame:
    """Each branch in its quadrant and in the two halves that hold it."""
    q = F.col("quadrant")
    return of_branch.withColumn("region", F.explode(F.array(q, F.substring(q, 1, 1), F.substring(q, 2, 1))))


def region_medians(metrics: DataFrame, placed: DataFrame, names: list[str], branch: str = "branch") -> DataFrame:
    """Per region and beat the median over its branches and radii; ``placed`` is (acq, branch, region)."""
    return metrics.join(placed.select("acq", branch, "region"), ["acq", branch]).groupBy("acq", "region", "beat").agg(*[F.median(m).alias(m) for m in names])


def unmatched(labels: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side has and the other lacks, with the side that lacks them."""
    a, b = labels.select(*keys).distinct(), branches.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_in", F.lit("branches")).unionByName(b.join(a, keys, "left_anti").withColumn("missing_in", F.lit("labels")))


def validate(pixels: DataFrame, branches: DataFrame, periods: DataFrame) -> DataFrame:
    """Failed checks as rows (acq, check, n): labels without a branch and the reverse, repeated ids, pixels outside the frame, bad periods."""
    pairs = unmatched(pixels.where("label > 0").select("acq", F.col("label").alias("branch")), branches.select("acq", "branch"), ["acq", "branch"])
    found = pairs.groupBy("acq", F.concat(F.lit("missing in "), F.col("missing_in")).alias("check")).agg(F.count(F.lit(1)).alias("n"))
    twice = branches.groupBy("acq", "branch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("acq").agg(F.count(F.lit(1)).alias("n")).select("acq", F.lit("repeated branch").alias("check"), "n")
    outside = pixels.where("x < 0 or y < 0 or x >= width or y >= height").groupBy("acq").agg(F.count(F.lit(1)).alias("n")).select("acq", F.lit("outside the frame").alias("check"), "n")
    bad = periods.where("T is null or isnan(T) or not (T > 0)").groupBy("acq").agg(F.count(F.lit(1)).alias("n")).select("acq", F.lit("bad period").alias("check"), "n")
    return found.unionByName(twice).unionByName(outside).unionByName(bad)


def reuse_or_recompute(stored: DataFrame, computed: DataFrame, n_metrics: int) -> DataFrame:
    """Stored metrics of an acquisition if all are there, else the computed ones: no mixing."""
    whole = stored.groupBy("acq").agg(F.countDistinct("metric").alias("k")).where(F.col("k") == n_metrics).select("acq")
    return stored.join(whole, "acq", "left_semi").unionByName(computed.join(whole, "acq", "left_anti"))


def label_raster(pixels: DataFrame) -> DataFrame:
    """Labels for display: the disc is -1, axes through its centre are -2, max(3, round(min(width, height) / 128)) pixels thick."""
    thick = F.greatest(F.lit(3.0), F.round(F.least("width", "height") / 128))
    axis = (F.abs(F.col("x") - F.col("cx")) < thick / 2) | (F.abs(F.col("y") - F.col("cy")) < thick / 2)
    return pixels.withColumn("shown", F.when(F.col("label") > 0, F.col("label")).when(F.col("in_disc"), F.lit(-1)).when(axis, F.lit(-2)).otherwise(F.lit(0)))
