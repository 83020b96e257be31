"""Audits as ordinary jobs: each returns counts of violations or agreement, never a bare yes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.operators.ordering import quantiles
from cohortry.operators.stats import confusion


def compare_versions(frozen: DataFrame, rebuilt: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null-safe comparison of two builds of the same rows: (column, rows, violations).

    A row present on one side only violates every column.
    """
    a = frozen.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    b = rebuilt.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    j = a.join(b, list(keys), "full")
    bad = [F.count_if(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns]
    one = j.agg(F.count(F.lit(1)).alias("_n"), *bad)
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr("_n as n_rows", f"stack({len(columns)}, {pairs}) as (feature, violations)").select("feature", "n_rows", "violations")


def drift(both: DataFrame, group: Sequence[str], a: str, b: str, theta: float) -> DataFrame:
    """Agreement of two versions of an overlap: share within 1e-6, size of the differences, label kappa."""
    d = both.withColumn("_d", F.abs(F.col(a) - F.col(b))).withColumn("_ya", (F.col(a) > theta).cast("int")).withColumn("_yb", (F.col(b) > theta).cast("int"))
    m = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_d") < 1e-6).cast("int")).alias("match"), F.avg("_d").alias("mean_abs"), F.max("_d").alias("max_abs"),
                              F.avg("_ya").alias("base_a"), F.avg("_yb").alias("base_b"))
    q = quantiles(d, group, "_d", {"median_abs": 0.5, "p90_abs": 0.9})
    k = confusion(d, group, "_ya", "_yb").select(*group, "kappa")
    return m.join(q, list(group)).join(k, list(group))


def check_rows(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) from named one-column, one-row counts."""
    out = None
    for name, df in checks.items():
        one = df.toDF("violations").select(F.lit(name).alias("check"), F.col("violations").cast("bigint").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def quoted_values(lines: DataFrame, column: str, pattern: str) -> DataFrame:
    """(name, quoted): what a text says of each name; ``pattern`` has one group for the name and one for the number.
    A line that says nothing is passed over."""
    got = lines.select(F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("said"))
    return got.where("said <> ''").select("name", F.col("said").cast("double").alias("quoted"))


def result_tree(spark: SparkSession, scores: str, metrics: str, expected: DataFrame, models: Sequence[str], seeds: int, tolerance: float = 1e-3) -> DataFrame:
    """Checks of a folder of score files (model=/seed= folders of parquet) and metric files (nested JSON, a run per seed)
    against ``expected`` (field, expected rows): cells without files, cells of another size, stored metrics that a
    recompute does not give, fields whose runs come from more than one environment."""
    from cohortry.operators import metrics as M
    keys = ["field", "model", "seed"]
    held = spark.read.parquet(scores)
    cells = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = expected.select("field", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    runs = (spark.read.schema("field string, model string, runs array<struct<seed: int, auc_pr: double, environment: string>>").json(metrics)
            .select("field", "model", F.explode("runs").alias("r")).select("field", "model", "r.*"))
    off = M.average_precision(held, keys).join(runs, keys).where(F.abs(F.col("ap") - F.col("auc_pr")) > tolerance)
    mixed = runs.groupBy("field").agg(F.count_distinct("environment").alias("k")).where("k > 1")
    n = F.count(F.lit(1)).alias("n")
    return check_rows({"grid_complete": grid.join(cells, keys, "left_anti").agg(n), "rows_match_cohort": cells.join(expected, "field").where("n <> expected").agg(n),
                       "ceiling_match": off.agg(n), "one_environment": mixed.agg(n)})
