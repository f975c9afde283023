"""The driver's tables as what the engine works on: tracks, records, fit points and judgments.

Every view has a SQL text that gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user of events: frame number, seconds, value; error events count as unobserved, and frames without a time come last."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("us").asc_nulls_last(), F.col("event_id").asc_nulls_last()))
    return e.select(F.col("user_id").alias("track"), i.alias("i"), (F.col("us") / 1e6).alias("t"), F.col("value").alias("y"), (F.col("event_type") != "error").alias("valid"), "event_type")


SERIES = """series AS (SELECT user_id AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS INTEGER) AS i,
    epoch_us(ts) / 1e6 AS t, value AS y, event_type <> 'error' AS valid, event_type FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: model, task, sample, gate score, two errors (the second missing at times), status and flags."""
    k = F.col("o_orderkey")
    status = F.when(k % 29 == 0, "execution_error").when(k % 31 == 0, "input_error").when(k % 23 == 0, "consistency_error").otherwise("complete")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), F.concat(F.lit("P"), (1 + F.col("o_custkey") % 40).cast("string")).alias("task"), k.alias("sample"),
        (((k * 37) % 101) / 100).alias("c"), ((F.col("o_totalprice") % 1000) / 1000).alias("e1"), F.when(k % 7 != 0, (F.col("o_totalprice") % 700) / 700).alias("e2"),
        status.alias("status"), F.lit(0.8).alias("threshold"), (k % 13 == 0).alias("forced"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("day"),
    )


RECORDS = """records AS (SELECT o_orderpriority AS model, 'P' || (1 + o_custkey % 40) AS task, o_orderkey AS sample, ((o_orderkey * 37) % 101) / 100 AS c,
    (o_totalprice % 1000) / 1000 AS e1, CASE WHEN o_orderkey % 7 <> 0 THEN (o_totalprice % 700) / 700 END AS e2,
    CASE WHEN o_orderkey % 29 = 0 THEN 'execution_error' WHEN o_orderkey % 31 = 0 THEN 'input_error' WHEN o_orderkey % 23 = 0 THEN 'consistency_error' ELSE 'complete' END AS status,
    0.8::DOUBLE AS threshold, o_orderkey % 13 = 0 AS forced, o_custkey AS owner, o_orderdate AS day FROM orders)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit points per supplier: x quantity, y price in thousands, w discount weight, row order k."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (1 + F.col("l_discount") * 100).alias("w"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_tax").alias("tax"),
    )


POINTS = "points AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice / 1000 AS y, 1 + l_discount * 100 AS w, l_orderkey AS k, l_linenumber AS n, l_tax AS tax FROM lineitem)"


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with physics from two residual scores, total and gate verdict."""
    from tarnwick.functions.scores import residual_score
    from tarnwick.operators.records import totals

    r = records(spark, sf_dir)
    q1, q2 = residual_score(F.col("e1"), 0.1), residual_score(F.col("e2"), 0.05)
    return totals(r.withColumn("physics", (q1 + F.coalesce(q2, F.lit(0.0))) / 2))


SCORED = (
    RECORDS
    + """, scored AS (SELECT *, (1 / (1 + abs(e1) / 0.1) + coalesce(1 / (1 + abs(e2) / 0.05), 0)) / 2 AS physics, status NOT IN ('consistency_error', 'execution_error', 'input_error') AS fine FROM records),
    judged AS (SELECT *, fine AND c >= threshold AND NOT forced AS passed FROM scored),
    totals AS (SELECT *, CASE WHEN fine AND passed THEN 0.15 * c + 0.85 * physics WHEN fine THEN 0.15 * c END AS total FROM judged)"""
)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate replies per labelled document: seven severities and three flags."""
    d = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    names = ["identity", "flicker", "scene", "clarity", "subject", "event", "order"]
    return d.select("doc_id", *[((k * (2 * j + 3) + j) % 17 % 5).cast("int").alias(n) for j, n in enumerate(names)], (F.col("toxic") == 1).alias("multiple_balls"), (F.col("quality") == 0).alias("poor_quality"), (k % 11 == 0).alias("background_flicker"))


JUDGMENTS = "judgments AS (SELECT doc_id, " + ", ".join(
    f"CAST((doc_id * {2 * j + 3} + {j}) % 17 % 5 AS INTEGER) AS \"{n}\"" for j, n in enumerate(["identity", "flicker", "scene", "clarity", "subject", "event", "order"])
) + ", toxic = 1 AS multiple_balls, quality = 0 AS poor_quality, doc_id % 11 = 0 AS background_flicker FROM labels)"
