"""Null-aware reductions and two-sample statistics as grouped aggregates and windows.

Every reduction skips null; nothing but nulls gives null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecohort.functions import wave

EPS = 1e-12
#: z at 97.5 percent, as the interval is defined.
Z95 = 1.96


def std1(x: str) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def cv1(x: str) -> Column:
    return std1(x) / (F.abs(F.avg(x)) + EPS)


def cv(x: str) -> Column:
    return F.try_divide(F.stddev_pop(x), F.abs(F.avg(x)))


def iqr(x: str) -> Column:
    return F.percentile(x, 0.75) - F.percentile(x, 0.25)


def arg(x: str, i: str, greatest: bool = True) -> Column:
    """First position of the extreme, -1 if there is none."""
    key = F.struct(F.col(x) if greatest else -F.col(x), -F.col(i))
    return F.coalesce(F.max_by(F.when(F.col(x).isNotNull(), F.col(i)), F.when(F.col(x).isNotNull(), key)), F.lit(-1))


def with_deviation(df: DataFrame, keys: list[str], x: str, name: str = "deviation") -> DataFrame:
    """|x - median of the group| beside every row; its median by group is the unscaled MAD."""
    centre = df.groupBy(*keys).agg(F.median(x).alias("_m")).toDF(*[f"_{k}" for k in keys], "_m")
    on = None
    for k in keys:
        c = df[k].eqNullSafe(centre[f"_{k}"])
        on = c if on is None else on & c
    return df.join(centre, on).withColumn(name, F.abs(F.col(x) - F.col("_m"))).drop("_m", *[f"_{k}" for k in keys])


def axis_statistics(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """median, std, iqr, mad and cv of x by group: one aggregate over the rows and their deviations."""
    return with_deviation(df, keys, x).groupBy(*keys).agg(
        F.median(x).alias("median"), std1(x).alias("std"), iqr(x).alias("iqr"), F.median("deviation").alias("mad"), cv1(x).alias("cv")
    )


def block_statistics(x: str) -> list[Column]:
    """median, std, iqr, mad and cv of x in one aggregate, for groups that an acquisition's geometry bounds.

    The values of a group are held as one sorted array; ``axis_statistics`` is for groups of any size.
    """
    values = F.sort_array(F.collect_list(x))

    def at(s: Column, q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    def spread(s: Column) -> Column:
        return wave.let(at(s, 0.5), lambda m: at(F.sort_array(F.transform(s, lambda y: F.abs(y - m))), 0.5))

    of = lambda f: wave.let(values, f)
    return [of(lambda s: at(s, 0.5)).alias("median"), std1(x).alias("std"), of(lambda s: at(s, 0.75) - at(s, 0.25)).alias("iqr"), of(spread).alias("mad"), cv1(x).alias("cv")]


def summarise(x: str) -> list[Column]:
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), std1(x).alias("std"), F.median(x).alias("median"), iqr(x).alias("iqr")]


def two_groups(df: DataFrame, keys: list[str], x: str, pathology: str) -> DataFrame:
    """n, mean, variance and median of x for the control (c) and the other group (g); ``pathology`` is a boolean column."""
    pick = lambda yes: F.when(F.col(pathology) if yes else ~F.col(pathology), F.col(x))
    out = []
    for name, yes in (("c", False), ("g", True)):
        v = pick(yes)
        out += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}"), F.median(v).alias(f"median_{name}")]
    return df.groupBy(*keys).agg(*out)


def cohen_d() -> Column:
    """From the columns of ``two_groups``; null under two values a group or without variance."""
    pooled = ((F.col("n_c") - 1) * F.col("var_c") + (F.col("n_g") - 1) * F.col("var_g")) / (F.col("n_c") + F.col("n_g") - 2)
    return F.when((F.col("n_c") >= 2) & (F.col("n_g") >= 2) & (pooled > 0), (F.col("mean_g") - F.col("mean_c")) / F.sqrt(pooled))


def difference_ci95() -> tuple[Column, Column]:
    centre = F.col("mean_g") - F.col("mean_c")
    half = Z95 * F.sqrt(F.col("var_c") / F.col("n_c") + F.col("var_g") / F.col("n_g"))
    ok = (F.col("n_c") >= 2) & (F.col("n_g") >= 2)
    return F.when(ok, centre - half), F.when(ok, centre + half)


def ranked_counts(df: DataFrame, keys: list[str], x: str, pathology: str) -> DataFrame:
    """One row a distinct value: how many controls and others have it, and how many lie at or below.

    Grouping by value first makes the window see distinct values only.
    """
    grouped = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(F.when(F.col(pathology), 0).otherwise(1)).alias("c"), F.sum(F.when(F.col(pathology), 1).otherwise(0)).alias("g"))
    run = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return grouped.withColumns({"c_to": F.sum("c").over(run), "g_to": F.sum("g").over(run), "c_all": F.sum("c").over(whole), "g_all": F.sum("g").over(whole)})


def rank_statistics(df: DataFrame, keys: list[str], x: str, pathology: str) -> DataFrame:
    """U, AUC, tie sum and KS distance of each group of rows, from ranks and not from pairs."""
    r = ranked_counts(df, keys, x, pathology)
    # a value's others beat the controls below it and tie with those at it
    wins = F.sum(F.col("g") * (F.col("c_to") - F.col("c") + F.col("c") / 2))
    t = (F.col("c") + F.col("g")).cast("double")
    gap = F.max(F.abs(F.col("c_to") / F.nullif("c_all", F.lit(0)) - F.col("g_to") / F.nullif("g_all", F.lit(0))))
    out = r.groupBy(*keys).agg(F.max("c_all").alias("n_c"), F.max("g_all").alias("n_g"), wins.alias("u"), F.sum(t * t * t - t).alias("ties"), gap.alias("ks"))
    return out.withColumn("auc", F.try_divide("u", F.col("n_c") * F.col("n_g")))


def best_threshold(df: DataFrame, keys: list[str], x: str, pathology: str, sentinels: bool = False) -> DataFrame:
    """Threshold between distinct values with the greatest Youden index, by one cumulative sweep.

    direction 1 predicts the other group at or above the threshold, -1 at or
    below. Without sentinels the direction follows the medians and the smallest
    best threshold wins; a single distinct value is its own threshold with
    direction 0 and nothing else. With sentinels both directions compete over
    the midpoints and one point outside either end, by Youden index, then balanced accuracy,
    then direction 1 before -1, then the smaller threshold.
    """
    r = ranked_counts(df, keys, x, pathology)
    ordered = Window.partitionBy(*keys).orderBy(x)
    nxt = F.lead(x).over(ordered)
    above = r.withColumn("threshold", (F.col(x) + nxt) / 2)
    steps = above.where("threshold is not null").select(*keys, "threshold", "c_to", "g_to", "c_all", "g_all")
    if sentinels:
        ends = r.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.max("c_all").alias("c_all"), F.max("g_all").alias("g_all"))
        low = ends.select(*keys, (F.col("lo") - 1).alias("threshold"), F.lit(0).cast("long").alias("c_to"), F.lit(0).cast("long").alias("g_to"), "c_all", "g_all")
        high = ends.select(*keys, (F.col("hi") + 1).alias("threshold"), F.col("c_all").alias("c_to"), F.col("g_all").alias("g_to"), "c_all", "g_all")
        steps = steps.unionByName(low).unionByName(high)
    steps = steps.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    if not sentinels:
        medians = df.groupBy(*keys).agg(F.median(F.when(F.col(pathology), F.col(x))).alias("mg"), F.median(F.when(~F.col(pathology), F.col(x))).alias("mc"))
        wanted = medians.select(*keys, F.when(F.col("mg") >= F.col("mc"), 1).otherwise(-1).alias("direction"))
        steps = steps.join(wanted, [*keys, "direction"])
    up = F.col("direction") == 1
    steps = steps.withColumn("sensitivity", F.try_divide(F.when(up, F.col("g_all") - F.col("g_to")).otherwise(F.col("g_to")), "g_all"))
    steps = steps.withColumn("specificity", F.try_divide(F.when(up, F.col("c_to")).otherwise(F.col("c_all") - F.col("c_to")), "c_all"))
    steps = steps.withColumn("youden", F.round(F.col("sensitivity") + F.col("specificity") - 1, 12)).withColumn("balanced", F.round((F.col("sensitivity") + F.col("specificity")) / 2, 12))
    best = F.max_by(F.struct("threshold", "direction", "sensitivity", "specificity", "youden"), F.struct("youden", "balanced", "direction", -F.col("threshold")))
    out = steps.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    if not sentinels:
        single = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min(x).alias("threshold")).where("k = 1")
        nothing = F.lit(None).cast("double")
        out = out.unionByName(single.select(*keys, "threshold", F.lit(0).alias("direction"), nothing.alias("sensitivity"), nothing.alias("specificity"), nothing.alias("youden")))
    return out
