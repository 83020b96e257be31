"""The first end-to-end query: label base rate per field from the raw tables."""

from pyspark.sql import functions as F

from cohortry.functions.columns import r6, render
from cohortry.plans import stages as S
from cohortry.plans.registry import query


@query("cohort_base_rate", """
SELECT field, count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate, sum(late_overlap::DECIMAL(18,6))::DOUBLE / count(*) AS mean_late_overlap
FROM t_cohort GROUP BY field""")
def cohort_base_rate(spark, sf):
    return S.cohort(spark, sf).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("base_rate"),
        # exact sum: the mean is the same on any layout, so it is not rounded
        (F.sum(F.col("late_overlap").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("mean_late_overlap"))


@query("cohort_table", """
SELECT field, subject, source, institution, region, t0, early_prod, early_breadth, source_prod, source_breadth, source_age,
       early_overlap, interacted, interaction_n, y, late_overlap, late_prod, array_to_string(early_tags, '; ') AS early_tags,
       array_to_string(source_tags, '; ') AS source_tags, array_to_string(late_tags, '; ') AS late_tags FROM t_cohort""")
def cohort_table(spark, sf):
    c = S.cohort(spark, sf)
    tags = ("early_tags", "source_tags", "late_tags")
    return c.select(*[render(F.col(x)).alias(x) if x in tags else x for x in c.columns])


@query("split_rows", "SELECT field, subject, t0, split FROM t_split")
def split_rows(spark, sf):
    return S.split(spark, sf).select("field", "subject", "t0", "split")


@query("score_rows", "SELECT field, split, subject, source, t0, model, seed, y, score FROM t_scores")
def score_rows(spark, sf):
    return S.scores(spark, sf)
