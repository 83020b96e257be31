"""The star-schema tables in the roles of the cohort model, as shared stage tables.

customer = subject, supplier = source, order = event, order line = tag occurrence,
market segment = field, year*4+quarter = period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.functions.columns import jaccard
from cohortry.operators import cohort as C, many_models as ML, profiles as P
from cohortry.session import materialise, stage
from cohortry.specs import CohortSpec

SPEC = CohortSpec()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def period(ts) -> F.Column:
    return F.year(ts) * 4 + F.quarter(ts)


def events(spark, sf):
    """One row per order: subject, event, period, cites (an integer weight), status."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("subject"),
        period("o_orderdate").alias("period"), F.col("o_orderdate").alias("event_date"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("cites"))


def lines(spark, sf):
    """Slim fact table: one row per order line with its tag, score, source, subject and period."""
    def build():
        ev = events(spark, sf).select("event_id", "subject", "period")
        tags = table(spark, sf, "part").select(
            F.col("p_partkey").alias("part"),
            F.concat_ws("/", "p_type", (F.col("p_size") % 5).cast("string")).alias("tag"),
            F.col("p_type").alias("coarse"), F.col("p_brand").alias("brand"))
        li = table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("line"),
            (F.col("l_quantity") / 50).alias("score"))
        return li.join(ev, "event_id").join(tags, "part")
    return stage(spark, sf, "lines", build)


def subject_tags(spark, sf):
    return stage(spark, sf, "subject_tags", lambda: P.collapse_tags(
        lines(spark, sf), ["subject", "event_id", "period"], "tag", "score",
        ["line", "part", "source"], SPEC.min_score, SPEC.tags_per_event))


def source_tags(spark, sf):
    return stage(spark, sf, "source_tags", lambda: P.collapse_tags(
        lines(spark, sf), ["source", "event_id", "period"], "tag", "score",
        ["line", "part"], SPEC.min_score, SPEC.tags_per_event))


def pair_activity(spark, sf):
    """Joint events per (subject, source, period), with the earliest one."""
    return stage(spark, sf, "pair_activity", lambda: (
        lines(spark, sf).select("subject", "source", "period", "event_id").repartition("subject", "source").distinct()
        .groupBy("subject", "source", "period")
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))))


def subject_activity(spark, sf):
    return (events(spark, sf).where(F.col("period").isNotNull() & (F.col("period") != 0))
            .groupBy("subject", "period").agg(F.count(F.lit(1)).alias("n_events")))


def source_activity(spark, sf):
    return stage(spark, sf, "source_activity", lambda: (
        lines(spark, sf).select("source", "period", "event_id").repartition("source", "period").distinct()
        .groupBy("source", "period").agg(F.count(F.lit(1)).alias("n_events"))))


def subjects(spark, sf):
    """Per subject: bounds, early and late profile."""
    def build():
        w = SPEC.windows
        bounds = C.subject_bounds(subject_activity(spark, sf), SPEC)
        t0 = F.col("t0")
        prof = P.windowed_profiles(
            subject_tags(spark, sf), bounds.select("subject", "t0"), "subject",
            {"early": (t0, t0 + w.early), "late": (t0 + w.early + 1, t0 + w.late)}, SPEC.top_k)
        none = F.array().cast("array<string>")

        def side(name):
            return prof.where(F.col("win") == name).select(
                "subject", F.col("tags").alias(f"{name}_tags"), F.col("tags_breadth").alias(f"{name}_breadth"))
        return (bounds.join(side("early"), "subject", "left").join(side("late"), "subject", "left")
                .select("subject", "t0", "last_period", "early_prod", "late_prod",
                        F.coalesce("early_breadth", F.lit(0)).alias("early_breadth"),
                        F.coalesce("late_breadth", F.lit(0)).alias("late_breadth"),
                        F.coalesce("early_tags", none).alias("early_tags"),
                        F.coalesce("late_tags", none).alias("late_tags")))
    return stage(spark, sf, "subjects", build)


def edges(spark, sf):
    """Distinct (subject, source) pairs with the time of their first joint event."""
    return pair_activity(spark, sf).groupBy("subject", "source").agg(
        F.min(F.struct("period", "first_event")).alias("f")).select(
        "subject", "source", F.col("f.period").alias("first_period"), F.col("f.first_event").alias("first_event"))


def source_asof(spark, sf):
    """As-of profile of every (source, t0+5) that some edge asks for."""
    def build():
        cuts = (edges(spark, sf).join(subjects(spark, sf).select("subject", "t0"), "subject")
                .select("source", (F.col("t0") + SPEC.windows.early).alias("cut")).distinct())
        return P.asof_profiles(P.history_steps(source_tags(spark, sf), "source"),
                               source_activity(spark, sf), cuts, "source", SPEC.top_k)
    return stage(spark, sf, "source_asof", build)


def funnel(spark, sf):
    """Every edge with its first failing check (null = survives)."""
    def build():
        span = source_activity(spark, sf).groupBy("source").agg(
            F.min("period").alias("source_first"), F.max("period").alias("source_last"))
        asof = source_asof(spark, sf).select("source", "cut", F.col("prod").alias("source_prod"))
        field = table(spark, sf, "customer").select(
            F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("field"))
        subj = subjects(spark, sf).select("subject", "t0", "last_period", "early_prod", "late_prod")
        rows = (edges(spark, sf).join(subj, "subject", "left")
                .withColumn("cut", F.col("t0") + SPEC.windows.early)
                .join(asof, ["source", "cut"], "left").join(span, "source", "left")
                .join(field, "subject"))
        return rows.select("field", "subject", "source", "t0", "cut", "last_period", "early_prod", "late_prod",
                           "source_prod", "source_first", "source_last",
                           C.drop_reason(SPEC).alias("drop_reason"))
    return stage(spark, sf, "funnel", build)


def cohort(spark, sf):
    """The modelling table: one row per subject."""
    def build():
        w = SPEC.windows
        kept = C.one_row_per_subject(funnel(spark, sf).where(F.col("drop_reason").isNull()),
                                     ["field", "source", "cut"])
        joint = pair_activity(spark, sf)
        subj = subjects(spark, sf)
        src = source_asof(spark, sf).select(
            "source", "cut", F.col("prod").alias("source_prod"), F.col("breadth").alias("source_breadth"),
            F.col("first_period").alias("source_first"), F.col("tags").alias("source_tags"))
        base = kept.join(subj, "subject").join(src, ["source", "cut"])
        pairs = (joint.join(base.select("subject", "source", "t0"), ["subject", "source"])
                 .where(F.col("period").between(F.col("t0"), F.col("t0") + w.early))
                 .groupBy("subject").agg(F.sum("n_events").cast("int").alias("interaction_n")))
        nation = table(spark, sf, "nation")
        inst = (table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("n_nationkey"))
                .join(nation, "n_nationkey").select("subject", F.col("n_name").alias("institution"),
                                                    F.col("n_regionkey").alias("region")))
        rows = base.join(pairs, "subject", "left").join(inst, "subject", "left")
        n = F.coalesce("interaction_n", F.lit(0))
        return rows.select(
            "field", "subject", "source", "institution", "region", "t0", "early_prod", "early_breadth",
            "source_prod", "source_breadth", (F.col("t0") - F.col("source_first")).alias("source_age"),
            F.round(jaccard(F.col("early_tags"), F.col("source_tags")), 4).alias("early_overlap"),
            (n > 0).alias("interacted"), n.alias("interaction_n"),
            C.label(F.col("late_tags"), F.col("source_tags"), SPEC.theta).alias("y"),
            F.round(jaccard(F.col("late_tags"), F.col("source_tags")), 4).alias("late_overlap"),
            "late_prod", "early_tags", "source_tags", "late_tags")
    return stage(spark, sf, "cohort", build)


def split(spark, sf):
    """The cohort with its temporal split (train / val / test by field)."""
    from cohortry.operators.draws import split_temporal
    return stage(spark, sf, "split", lambda: split_temporal(cohort(spark, sf), ["field"]))


MODELS = {"overlap": ("early_overlap", "early_breadth"), "reach": ("source_breadth", "source_age"), "volume": ("early_prod", "source_prod")}
SEEDS = 10


def scores(spark, sf):
    """Validation and test scores of three fitted models under ten seeds: per field, a penalised logistic model of two
    columns each. A seed leaves out its own 15 % of the training rows; all fields, models and seeds are fitted in one job a round.
    """
    def build():
        models = F.array(*[F.struct(F.lit(m).alias("model"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")) for m, cols in MODELS.items()])
        rows = split(spark, sf).select("field", "split", "subject", "source", "t0", "y", F.explode(models).alias("m"))
        rows = rows.select("field", "split", "subject", "source", "t0", "y", "m.model", F.concat_ws("|", "field", "m.model").alias("grp"), "m.x")
        train = rows.where("split = 'train'").select("grp", F.col("y").cast("double").alias("y"), "x", ML.parts_of("subject", SEEDS).alias("members"))
        fitted = ML.fit_logits(materialise(train, "logit_rows"), 2)
        out = ML.predicted(rows.where("split <> 'train'"), fitted, ["field", "split", "subject", "source", "t0", "model", "y"], 2)
        return out.select("field", "split", "subject", "source", "t0", "model", F.col("part").alias("seed"), "y", F.round("score", 4).alias("score"))
    return stage(spark, sf, "scores", build)
