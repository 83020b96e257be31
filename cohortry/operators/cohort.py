"""From edges to one leakage-safe row per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import jaccard
from cohortry.operators.ordering import first_by
from cohortry.specs import CohortSpec

DROP_REASONS = ("no_years", "adv_no_years", "too_recent", "implausible_t0", "span_gt_max", "sparse_windows")


def drop_reason(spec: CohortSpec) -> Column:
    """First failing check of an edge row, null when it survives."""
    w = spec.windows
    checks = [
        F.col("t0").isNull(),
        F.col("source_first").isNull(),
        F.col("t0") + w.late > w.observed_until,
        F.col("t0") < w.first_valid,
        (F.col("last_period") - F.col("t0") > w.max_span)
        | (F.col("source_last") - F.col("source_first") > w.max_span),
        (F.col("early_prod") < spec.min_events) | (F.col("late_prod") < spec.min_events)
        | (F.coalesce("source_prod", F.lit(0)) < spec.min_source_events),
    ]
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(zip(DROP_REASONS, checks))):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def subject_bounds(activity: DataFrame, spec: CohortSpec) -> DataFrame:
    """t0, last period and event counts in the early and late window per subject.

    ``activity`` is one row per (subject, period) with ``n_events``; undated or zero periods must be
    filtered out before.
    """
    w = spec.windows
    b = activity.groupBy("subject").agg(F.min("period").alias("t0"), F.max("period").alias("last_period"))
    early = F.col("period") <= F.col("t0") + w.early
    late = (F.col("period") > F.col("t0") + w.early) & (F.col("period") <= F.col("t0") + w.late)
    return (activity.join(b, "subject").groupBy("subject", "t0", "last_period").agg(
        F.sum(F.when(early, F.col("n_events")).otherwise(0)).cast("int").alias("early_prod"),
        F.sum(F.when(late, F.col("n_events")).otherwise(0)).cast("int").alias("late_prod")))


def one_row_per_subject(survivors: DataFrame, keep: list[str]) -> DataFrame:
    """One edge per subject: highest early_prod, then lowest source id.

    ``early_prod`` belongs to the subject, so several sources tie; the id makes the choice total.
    """
    return first_by(survivors, ["subject"], [-F.col("early_prod"), F.col("source")], keep)


def label(late: Column, source: Column, theta: float) -> Column:
    """1 when the late overlap exceeds theta (unrounded)."""
    return (jaccard(late, source) > F.lit(theta)).cast("int")


def guard_violations(rows: DataFrame, spec: CohortSpec, allowed: set[str], banned: set[str]) -> DataFrame:
    """One row per invariant with the number of rows (or columns) that break it. All zero means safe."""
    w = spec.windows
    cols = set(rows.columns)
    data = rows.agg(
        F.count_if(F.col("t0") + w.late > w.observed_until).alias("right_censored"),
        F.count_if(F.col("t0") < w.first_valid).alias("implausible_t0"),
        F.count_if((F.col("late_overlap") > spec.theta).cast("int") != F.col("y")).alias("label_mismatch"),
        (F.count(F.lit(1)) - F.count_distinct("subject")).alias("duplicate_subjects"),
        F.count_if(F.col("interaction_n") < 0).alias("missing_interactions"),
        F.lit(len(cols & banned)).cast("bigint").alias("banned_columns"),
        F.lit(len(cols - allowed)).cast("bigint").alias("unclassified_columns"))
    names = data.columns
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return data.selectExpr(f"stack({len(names)}, {pairs}) as (invariant, violations)")
