"""Identity resolution by shared works or by scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions import textids as X
from cohortry.operators.ordering import top_k

# fixed values: default weights and threshold of the candidate score
WEIGHTS = {"lastname": 2.0, "firstinit": 0.5, "inst": 2.0, "field": 1.5, "works_ok": 0.5}
THRESHOLD = 3.0


def anchors(links: DataFrame, min_score: float = 0.3, n: int = 25) -> DataFrame:
    """Top-n links per person by score (ties by work id) with normalised ids."""
    ok = links.where(F.col("score_total") >= min_score)
    best = top_k(ok, ["pid"], [F.col("score_total").desc(), F.col("pubid")], n)
    return best.select("pid", "pubid", X.norm_doi(F.col("doi")).alias("doi"), X.norm_digits(F.col("pmid")).alias("pmid"))


def anchor_keys(anchor: DataFrame) -> DataFrame:
    """(pid, work key): one row per usable id, so a work with both ids speaks twice."""
    keys = F.array(F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")),
                   F.when(F.col("pmid") != "", F.concat(F.lit("pmid:"), "pmid")))
    return (anchor.select("pid", "pubid", F.explode(F.array_compact(keys)).alias("k")).distinct())


def resolve_by_anchor(keys: DataFrame, work_authors: DataFrame, persons: DataFrame, min_hits: int = 2,
                      dedupe_work: bool = False) -> DataFrame:
    """Tally authors of a person's works whose name holds the surname; the winner needs ``min_hits``
    hits, or one when it is the only candidate. Ties go to the lowest author id.

    ``work_authors`` is (k, aid, name). ``dedupe_work`` counts a work once even if both ids match.
    """
    surname = X.fold_name(F.col("lastname"))
    j = (keys.join(work_authors, "k").join(persons.select("pid", "lastname"), "pid")
         .where((surname != "") & F.contains(X.fold_name(F.col("name")), surname)))
    hits = F.count_distinct("pubid") if dedupe_work else F.count(F.lit(1))
    tally = j.groupBy("pid", "aid").agg(hits.alias("hits"))
    best = tally.groupBy("pid").agg(
        F.min_by(F.struct("aid", "hits"), F.struct((-F.col("hits")).alias("h"), "aid")).alias("w"),
        F.count(F.lit(1)).alias("candidates"))
    ok = (F.col("w.hits") >= min_hits) | (F.col("candidates") == 1)
    return persons.select("pid").join(best, "pid", "left").select(
        "pid", F.when(ok, F.col("w.aid")).alias("aid"),
        F.when(ok, "pubid").otherwise("pubid_nohit").alias("method"),
        F.when(ok, F.col("w.hits")).otherwise(F.lit(0)).cast("bigint").alias("hits"))


def score_candidates(cands: DataFrame, weights: dict[str, float] | None = None) -> Column:
    w = weights or WEIGHTS
    total = F.lit(0.0)
    for name, value in w.items():
        total = total + F.lit(float(value)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


def resolve_by_features(cands: DataFrame, threshold: float = THRESHOLD, weights: dict[str, float] | None = None) -> DataFrame:
    """Best candidate per person by weighted features; a hard id hit short-cuts with confidence 99."""
    s = F.when(F.col("orcid_hit"), F.lit(99.0)).otherwise(score_candidates(cands, weights))
    best = cands.withColumn("s", s).groupBy("pid").agg(
        F.min_by(F.struct("aid", "s", "orcid_hit"), F.struct((-F.col("s")).alias("n"), "aid")).alias("b"))
    ok = F.col("b.s") >= threshold
    return best.select(
        "pid", F.when(ok, F.col("b.aid")).alias("aid"),
        F.when(F.col("b.orcid_hit"), "orcid").when(ok, "name").otherwise("below_threshold").alias("method"),
        F.round("b.s", 3).alias("confidence"))


def apply_resolution(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Attach resolved ids to both ends of every edge."""
    def side(role, key):
        return resolved.select(F.col("pid").alias(key), F.col("aid").alias(f"{role}_aid"),
                               F.col("method").alias(f"{role}_method"), F.col("hits").alias(f"{role}_hits"))
    return edges.join(side("source", "source"), "source", "left").join(side("subject", "subject"), "subject", "left")


def classify_disagreement(sim_resolved: Column, sim_recorded: Column, same: float = 0.85, low: float = 0.5) -> Column:
    return (F.when(sim_resolved.isNull(), "human_unindexed").when(sim_resolved >= same, "id_split")
            .when(sim_recorded >= same, "resolver_error")
            .when((sim_recorded < low) & (sim_resolved < low), "original_id_error").otherwise("human_ambiguous"))
