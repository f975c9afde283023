"""Raw measurements of extractors to the public metrics M1 and M2, and their totals.

An extractor reports parts: M1 and any number of further ones. A part is undefined (success null), failed, or a
value with an ideal and a scale, or a ratio that is its own score. The further parts are one public metric, M2:
it succeeds if all of them do, and its score is their geometric mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.scores import clip01, finite, strict_gm

#: What a recognised metric counts without, and with, its physics.
RECOGNISED, PHYSICS = 0.15, 0.85


def part_score(value: Column, ideal: Column, scale: Column, is_ratio: Column) -> Column:
    """A ratio's own clipped value, or 1 / (1 + |value - ideal| / scale)."""
    return F.when(is_ratio, clip01(value)).otherwise(1 / (1 + F.abs(finite(value) - F.coalesce(ideal, F.lit(0.0))) / scale))


def public_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric_id (M1, M2), defined, success, value (null for a metric of several parts) and score of each sample.

    parts: keys, part, success, value, ideal, scale, is_ratio.
    """
    seen = parts.withColumn("fine", F.col("success") & finite(F.col("value")).isNotNull())
    score = F.when(F.col("fine"), part_score(F.col("value"), F.col("ideal"), F.col("scale"), F.col("is_ratio")))
    seen = seen.withColumns({"metric_id": F.when(F.col("part") == "M1", "M1").otherwise("M2"), "score": score}).filter("success is not null")
    found = seen.groupBy(*keys, "metric_id").agg(F.bool_and("fine").alias("success"), F.when(F.count("*") == 1, F.max("value")).alias("value"), strict_gm(F.col("score")).alias("score"))
    every = parts.select(*keys).distinct().withColumn("metric_id", F.explode(F.array(F.lit("M1"), F.lit("M2"))))
    out = every.join(found, [*keys, "metric_id"], "left").withColumn("defined", F.col("success").isNotNull())
    kept = lambda c: F.when(F.coalesce("success", F.lit(False)), F.col(c)).alias(c)
    return out.select(*keys, "metric_id", "defined", "success", kept("value"), kept("score"))


def proxy_totals(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """total (the mean over defined metrics of 0.15 + 0.85 score, 0 for failed ones), recognised and status of each sample."""
    own = F.when(F.col("defined"), F.coalesce(RECOGNISED + PHYSICS * F.col("score"), F.lit(0.0)))
    out = metrics.groupBy(*keys).agg(F.coalesce(F.avg(own), F.lit(0.0)).alias("total"), F.count_if(F.col("success")).alias("recognised"), F.count_if("defined").alias("defined"))
    status = F.when((F.col("defined") > 0) & (F.col("recognised") == F.col("defined")), "complete").when(F.col("recognised") > 0, "partial").otherwise("unavailable")
    return out.select(*keys, "total", "recognised", status.alias("status"))
