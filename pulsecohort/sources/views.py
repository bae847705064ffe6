"""Waveform tables: the schema of the engine, and views of it over plain relational tables.

One row is one waveform: acq, cohort, vessel, representation, beat, branch,
radius, T (period) and v (array<double>, null where a sample is missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsecohort.functions import wave

WAVEFORM = "acq long, cohort string, vessel string, representation string, beat int, branch int, radius int, T double, v array<double>"
#: Ids that one task ranks within a group.
RANGE = 1_000_000
KEYS = ["acq", "cohort", "vessel", "representation", "beat", "branch", "radius"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shaped(df: DataFrame, **columns) -> DataFrame:
    given = {"cohort": F.lit("control"), "vessel": F.lit("artery"), "representation": F.lit("raw"), "beat": F.lit(0), "branch": F.lit(0), "radius": F.lit(0), "T": F.lit(1.0)} | columns
    kinds = dict(x.split(" ") for x in WAVEFORM.split(", "))
    return df.select(*[given[c].cast(kinds[c]).alias(c) for c in kinds])


def ranked_within(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rank from 0 of the whole number ``order`` in its group, by ranges of it, so that a large group is many tasks.

    Only a row for each range passes through a window of the whole group. A null
    group is a group; null orders come first, equal ones in any order.
    """
    ranges = df.withColumn("_range", F.floor(F.col(order) / RANGE))
    counts = ranges.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranges.withColumn(name, F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1)
    joined = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & placed["_range"].eqNullSafe(starts["_r"]))
    return joined.withColumn(name, F.col(name) + F.col("_start")).drop("_g", "_r", "_start", "_range")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors as one acquisition: beat, branch and radius from the rank of vec_id in the label."""
    ranked = ranked_within(load(spark, sf_dir, "embeddings"), "label", "vec_id", "r")
    return _shaped(
        ranked, acq=F.col("label"), cohort=F.when(F.col("label") < 5, "control").otherwise("pathology"),
        beat=F.col("r") % 5, branch=F.floor(F.col("r") / 5) % 3, radius=F.floor(F.col("r") / 15), v=wave.clean(F.col("embedding")),
    )


def corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with rows as files have them: a period of zero (beat 0), a NaN (1), an infinity (2), no sample at all (3, branch 0)."""
    def broken(x, i):
        at = i == 3
        bad = F.when((F.col("beat") == 1) & at, F.lit(float("nan"))).when((F.col("beat") == 2) & at, F.lit(float("inf")))
        return F.when((F.col("beat") == 3) & (F.col("branch") == 0), F.lit(None).cast("double")).otherwise(F.coalesce(bad, x))

    return embeddings(spark, sf_dir).withColumn("v", F.transform("v", broken)).withColumn("T", F.when(F.col("beat") == 0, F.lit(0.0)).otherwise(F.col("T")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values in time order; the period is the time that they span, in seconds."""
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    grouped = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return _shaped(
        grouped, acq=F.col("user_id"), cohort=F.when(F.col("user_id") % 2 == 0, "control").otherwise("pathology"),
        T=F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 1e6, v=wave.clean(F.transform("s", lambda x: x["value"])),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's monthly revenue by year (beat), return flag (branch) and status (radius); a month without lines is missing."""
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus"]
    months = rows.groupBy(*keys, F.month("l_shipdate").alias("m")).agg(F.sum("l_extendedprice").alias("x"))
    grouped = months.groupBy("l_suppkey", "year", "l_returnflag", "l_linestatus").agg(F.map_from_entries(F.collect_list(F.struct("m", "x"))).alias("by"))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return _shaped(
        grouped, acq=F.col("l_suppkey"), cohort=F.when(F.col("l_suppkey") % 2 == 0, "control").otherwise("pathology"), beat=F.col("year"), branch=flag,
        radius=F.when(F.col("l_linestatus") == "F", 0).otherwise(1), v=F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at("by", m)),
    )


def vessel_pairs(waveforms: DataFrame) -> DataFrame:
    """Branch 0 as the artery and branch 1 as the vein of one acquisition, joined on what is left of the key."""
    keys = ["acq", "cohort", "beat", "radius"]
    a = waveforms.where("branch = 0").select(*keys, "T", F.col("v").alias("qa"))
    b = waveforms.where("branch = 1").select(*keys, F.col("v").alias("qv"))
    return a.join(b, keys).where("size(qa) = size(qv)")


def with_bandlimited(waveforms: DataFrame, highest: int = 10) -> DataFrame:
    """Each waveform beside what its harmonics up to ``highest`` make of it: raw and band."""
    spectrum = waveforms.withColumn("c", wave.spectrum(wave.filled(F.col("v")), highest))
    return spectrum.withColumn("band", wave.reconstruct(F.col("c"), F.size("v"))).withColumnRenamed("v", "raw").drop("c")
