"""Feature tables: relational TF-IDF and assembled vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.operators.ordering import attach, top_k


def documents(tags: str) -> Column:
    """Tags as tokens: lower case, blanks to underscores."""
    return F.transform(tags, lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("_"))))


def tfidf(docs: DataFrame, group: Sequence[str], key: str, tokens: str, fit: Column, max_features: int = 2000) -> DataFrame:
    """(group, key, token, weight) with the vocabulary and idf fitted on the rows where ``fit`` holds.

    Vocabulary: the ``max_features`` tokens with most occurrences (ties by token). Weight: count x
    (ln((1+n)/(1+df)) + 1), scaled to length one per row; tokens outside the vocabulary are dropped.
    """
    g = list(group)
    tf = docs.select(*g, key, fit.alias("_fit"), F.explode(tokens).alias("token")).groupBy(*g, key, "_fit", "token").agg(F.count(F.lit(1)).alias("tf"))
    seen = tf.where("_fit").groupBy(*g, "token").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    vocab = top_k(seen, g, [F.col("total").desc(), F.col("token")], max_features).select(*g, "token", "df")
    n = docs.where(fit).groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    idf = attach(vocab, n, g).select(*g, "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, [*g, "token"]).withColumn("_w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*g, key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return w.join(norm, [*g, key]).select(*g, key, "token", (F.col("_w") / F.col("_n")).alias("weight"))


def assemble(rows: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """One vector column, booleans as doubles."""
    kinds = dict(rows.dtypes)
    cast = rows
    for c in columns:
        if kinds[c] == "boolean":
            cast = cast.withColumn(c, F.col(c).cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(cast)
