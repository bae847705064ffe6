"""Quality flags and status of the delay and RC estimates of an acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecohort.operators.windkessel import METHODS

#: The limits beyond which a flag is raised.
LEAST_BEATS, LEAST_CONSENSUS, LEAST_REASONABLE = 3, 0.50, 0.50
MOST_TAU_RANGE, MOST_DELAY_RANGE, MOST_RESIDUAL = 0.50, 0.050, 1.00


def flags(summary: DataFrame) -> DataFrame:
    """``summary`` (of ``windkessel.summaries``) with its flags and a status: ok, warn, or fail for a severe flag."""
    over = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    raised = [
        ("low_consensus_fraction", F.coalesce(F.col("consensus_available_fraction") < LEAST_CONSENSUS, F.lit(True)), True),
        ("high_tau_intermethod_disagreement", over("tau_intermethod_rel_range_median", MOST_TAU_RANGE), True),
        ("high_delay_intermethod_disagreement", over("delay_intermethod_range_median", MOST_DELAY_RANGE), True),
    ]
    for m in METHODS:
        raised += [(f"{m}_too_few_valid_beats", F.col(f"{m}_tau_n_valid") < LEAST_BEATS, True), (f"{m}_high_residual_norm", over(f"{m}_residual_norm_median", MOST_RESIDUAL), True)]
        raised += [(f"{m}_{w}_reasonable_low_reasonable_fraction", F.coalesce(F.col(f"{m}_{w}_reasonable_fraction") < LEAST_REASONABLE, F.lit(False)), False) for w in ("tau", "delay")]
    out = summary.withColumn("flags", F.array_compact(F.array(*[F.when(c, n) for n, c, _ in raised])))
    severe = F.arrays_overlap("flags", F.array(*[F.lit(n) for n, _, s in raised if s]))
    return out.withColumn("status", F.when(F.size("flags") == 0, "ok").when(severe, "fail").otherwise("warn"))


def overall(by_representation: DataFrame, keys: list[str]) -> DataFrame:
    """The worst status of an acquisition's representations."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return by_representation.groupBy(*keys).agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), worst + 1).alias("overall_status"))
