"""Tag profiles over inclusive windows: collapse, top-k, productivity, breadth, as-of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.operators.ordering import top_k


def collapse_tags(occurrences: DataFrame, event_keys: Sequence[str], tag: str, score: str,
                  stored: Sequence[str], min_score: float, limit: int | None) -> DataFrame:
    """Tags of an event with score >= ``min_score``, first ``limit`` in stored order.

    Stored order is score descending, then the columns in ``stored``. A tag repeated inside an
    event keeps its best place. Adds ``tag_pos`` (1-based) and ``tag_score``.
    """
    place = F.struct((-F.col(score)).alias("s"), *[F.col(c) for c in stored])
    tags = (occurrences.where(F.col(score) >= F.lit(min_score)).repartition(*event_keys)  # both steps below stay in place
            .groupBy(*event_keys, tag).agg(F.min(place).alias("_place"))
            .withColumn("tag_score", -F.col("_place.s")))
    if limit is None:
        w = W.partitionBy(*event_keys).orderBy("_place", tag)
        return tags.withColumn("tag_pos", F.row_number().over(w)).drop("_place")
    return top_k(tags, event_keys, [F.col("_place"), F.col(tag)], limit, "tag_pos").drop("_place")


def tag_counts(tagged: DataFrame, keys: Sequence[str], period: str = "period",
               event: str = "event_id", tag: str = "tag", pos: str = "tag_pos") -> DataFrame:
    """Occurrences per (keys, tag) and the first place the tag appears in event order."""
    return tagged.groupBy(*keys, tag).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col(period).alias("p"), F.col(event).alias("e"), F.col(pos).alias("i"))).alias("first"))


def profile(counts: DataFrame, keys: Sequence[str], k: int, out: str = "tags",
            ties: str = "first", tag: str = "tag") -> DataFrame:
    """Top-k tags (sorted array) and breadth per key.

    ``ties='first'`` breaks equal counts by first appearance, ``ties='name'`` by tag name.
    Breadth counts all distinct tags, before the cut.
    """
    order = [F.col("n").desc(), F.col("first").asc() if ties == "first" else F.col(tag).asc()]
    top = (top_k(counts, keys, order, k)
           .groupBy(*keys).agg(F.sort_array(F.collect_list(tag)).alias(out)))
    breadth = counts.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias(f"{out}_breadth"))
    return top.join(breadth, list(keys))


def profile_grid(counts: DataFrame, keys: Sequence[str], ks: Sequence[int], out: str = "tags", tag: str = "tag") -> DataFrame:
    """Top-k tags for several k at once: ranks are computed once, each k is a filter on them."""
    order = [F.col("n").desc(), F.col("first").asc()]
    ranked = top_k(counts, keys, order, max(ks), "_rank")
    per_k = ranked.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("_rank"))))
    return per_k.groupBy(*keys, "k").agg(F.sort_array(F.collect_list(tag)).alias(out))


def windowed_profiles(tagged: DataFrame, anchors: DataFrame, key: str, windows: dict[str, tuple[Column, Column]],
                      k: int, ties: str = "first") -> DataFrame:
    """Profiles of each key inside windows given relative to its anchor row (one row per key and window)."""
    label = F.lit(None).cast("string")
    for name, (lo, hi) in windows.items():
        label = F.when(F.col("period").between(lo, hi), F.lit(name)).otherwise(label)
    rows = (tagged.join(anchors, key).withColumn("win", label).where(F.col("win").isNotNull()))
    return profile(tag_counts(rows, [key, "win"]), [key, "win"], k, "tags", ties)


def history_steps(tagged: DataFrame, key: str) -> DataFrame:
    """Running tag counts of a history as validity intervals ``[period, until)``.

    The history is aggregated to one row per (key, tag, period) first; an as-of cut then meets
    exactly one interval per tag, so no event is read twice for two cut-offs. ``since`` is the count before.
    """
    steps = tagged.repartition(key).groupBy(key, "tag", "period").agg(  # all that follows, joins too, stays in place
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("event_id").alias("e"), F.col("tag_pos").alias("i"))).alias("f"))
    w = W.partitionBy(key, "tag").orderBy("period")
    return steps.select(
        key, "tag", "period",
        F.lead("period").over(w).alias("until"),
        F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"),
        F.when(F.lag("period").over(w).isNull(), F.lit(0)).otherwise(
            F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("bigint").alias("since"),
        F.first(F.struct(F.col("period").alias("p"), F.col("f.e").alias("e"), F.col("f.i").alias("i")))
        .over(w.rowsBetween(W.unboundedPreceding, 0)).alias("first"))


def asof_counts(steps: DataFrame, cuts: DataFrame, key: str, cut: str = "cut") -> DataFrame:
    """Tag counts of each (key, cut): equi join on the key, validity interval as residual condition. Where ``cuts``
    has ``_least``, only tags with that count or more."""
    least = [c for c in cuts.columns if c == "_least"]
    c = cuts.select(F.col(key).alias("_key"), F.col(cut), *least)
    hit = ((F.col("_key") == F.col(key)) & (F.col("period") <= F.col(cut))
           & (F.col("until").isNull() | (F.col("until") > F.col(cut))))
    if least:
        hit = hit & (F.col("n") >= F.col("_least"))
    return c.join(steps, hit).select(key, cut, "tag", "n", "first")


def history_totals(steps: DataFrame, activity: DataFrame, key: str, k: int) -> DataFrame:
    """Running totals of a history as validity intervals ``[period, until)``, one row per (key, period): events so far
    (``prod``), first active period, tags so far (``breadth``) and ``_least``, the count that ``k`` tags have reached.

    A tag's count never falls, so once k tags have reached a count, a tag below it is in no top k from then on.
    """
    w = W.partitionBy(key, "level").orderBy("period")
    upto = W.partitionBy(key).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    levels = steps.where(F.col("period").isNotNull()).select(
        key, "period", "first", F.explode(F.sequence(F.col("since") + 1, F.col("n"))).alias("level"))
    levels = (levels.groupBy(key, "level", "period").agg(F.count("first").alias("c"))  # reads what the join reads: one shuffle serves both
              .withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))))
    none = F.lit(None).cast("bigint")
    marks = levels.groupBy(key, "period").agg(
        F.sum(F.when(F.col("level") == 1, F.col("c"))).alias("new"),
        F.max(F.when(F.col("upto") >= k, F.col("level"))).alias("level"))
    rows = (activity.where(F.col("period").isNotNull()).select(key, "period", F.col("n_events").cast("bigint").alias("n_events"), none.alias("new"), none.alias("level"))
            .unionByName(marks.withColumn("n_events", none)))
    rows = rows.groupBy(key, "period").agg(*[f(c).alias(c) for c, f in (("n_events", F.sum), ("new", F.sum), ("level", F.max))])
    return rows.select(
        key, "period", F.lead("period").over(W.partitionBy(key).orderBy("period")).alias("until"),
        F.sum("n_events").over(upto).cast("int").alias("prod"),
        F.min(F.when(F.col("n_events").isNotNull(), F.col("period"))).over(upto).alias("first_period"),
        F.coalesce(F.sum("new").over(upto), F.lit(0)).cast("int").alias("breadth"),
        F.coalesce(F.max("level").over(upto), F.lit(1)).alias("_least"))


def asof_profiles(steps: DataFrame, activity: DataFrame, cuts: DataFrame, key: str, k: int,
                  ties: str = "first") -> DataFrame:
    """As-of profile per (key, cut): tags, breadth, events so far, first period.

    ``activity`` is one row per (key, period) with ``n_events``. A cut meets one row of running totals, and of
    the tags only those that can be among the first k: no history is repeated for every cut.
    """
    c, steps = cuts.select(F.col(key).alias("_key"), "cut"), steps.where(F.col(key).isNotNull())
    at = c.join(history_totals(steps, activity, key, k), (F.col("_key") == F.col(key)) & (F.col("period") <= F.col("cut"))
                & (F.col("until").isNull() | (F.col("until") > F.col("cut"))))
    at = at.where(F.col("prod").isNotNull()).select(key, "cut", "prod", "first_period", "breadth", "_least")
    order = [F.col("n").desc(), F.col("first").asc() if ties == "first" else F.col("tag").asc()]
    tags = (top_k(asof_counts(steps, at, key), [key, "cut"], order, k)
            .groupBy(key, "cut").agg(F.sort_array(F.collect_list("tag")).alias("tags")))
    return at.join(tags, [key, "cut"], "left").select(
        key, "cut", "prod", "first_period", "breadth",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
