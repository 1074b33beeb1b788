"""Detected spans against the truth: exact ranges, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(detected: DataFrame, truth: DataFrame, by: str | None = None, key: str = "doc_id") -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall, f1 over all documents, or for each value of `by`.

    Both have key, character_start, character_end; repeated ranges count once. Shares of nothing are 0.
    """
    on = [key, "character_start", "character_end"]
    left = detected.select(*on).distinct().withColumn("__d", F.lit(1))
    right = truth.select(*on).distinct().withColumn("__t", F.lit(1))
    both = left.join(right, on, "full")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    d, t = F.col("__d").isNotNull(), F.col("__t").isNotNull()
    sums = both.groupBy(*([by] if by else [])).agg(count(d & t).alias("true_positives"), count(d & ~t).alias("false_positives"), count(~d & t).alias("false_negatives"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp = F.col("true_positives")
    rated = sums.withColumn("precision", share(tp, tp + F.col("false_positives"))).withColumn("recall", share(tp, tp + F.col("false_negatives")))
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
