"""Records of evaluated samples: identity, missingness, gate, totals and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.scores import composite, defined_mean

#: States of runs and metrics.
ERROR_STATES = ("consistency_error", "execution_error", "input_error")
RUN_STATES = ("complete", "partial", "unavailable", "scored_with_zero", "consistency_rejected", "consistency_error", "execution_error", "input_error")
METRIC_STATES = ("measured", "unmeasurable", "not_observed", "not_run", "not_applicable", "error")
KEY = ["model", "task", "sample"]


def is_error(status: Column) -> Column:
    return status.isin(*ERROR_STATES)


def zero_policy(metrics: DataFrame) -> DataFrame:
    """not_observed metrics with evidence, of samples that passed the gate and completed, score an explicit 0; raw stays null."""
    zero = (F.col("status") == "not_observed") & F.col("evidence") & F.col("passed") & F.col("completed")
    return metrics.withColumns({"physics_score": F.when(zero, F.lit(0.0)).otherwise(F.col("physics_score")), "zeroed": F.coalesce(zero, F.lit(False))})


def physics_of(metrics: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """physics, defined_metrics, measured_metrics and coverage of each sample from its metric rows."""
    scored = F.col("defined") & F.col("physics_score").isNotNull()
    out = metrics.groupBy(*keys).agg(defined_mean(F.col("physics_score"), F.col("defined")).alias("physics"), F.sum(F.col("defined").cast("int")).alias("defined_metrics"), F.sum(scored.cast("int")).alias("measured_metrics"))
    return out.withColumn("coverage", F.try_divide(F.col("measured_metrics").cast("double"), F.col("defined_metrics").cast("double")))


def run_status(evaluated: Column, passed: Column, failed: Column, defined: Column, measured: Column, zeroed: Column) -> Column:
    """The state of a run from its gate and its metrics."""
    physics = F.when((defined > 0) & (measured == defined), F.when(zeroed > 0, "scored_with_zero").otherwise("complete")).when(measured > 0, "partial").otherwise("unavailable")
    return F.when(~evaluated, "consistency_error").when(~passed, "consistency_rejected").when(failed, "execution_error").otherwise(physics)


def judgment(event_failed: Column, physics: Column, coverage: Column, threshold: Column) -> Column:
    """The axis beside the score: an explicit failed event, else the score against a threshold, else too little evidence."""
    return F.when(event_failed, "task_failed").when(physics.isNull() | (coverage < 1), "evidence_insufficient").when(physics >= threshold, "physics_pass").otherwise("physics_fail")


def totals(records: DataFrame) -> DataFrame:
    """total and passed of each record from c, physics, gate threshold and forced rejection."""
    evaluated = ~is_error(F.col("status")) & F.col("c").isNotNull()
    passed = evaluated & (F.col("c") >= F.col("threshold")) & ~F.col("forced")
    return records.withColumns({"passed": passed, "total": composite(F.col("c"), F.col("physics"), evaluated, passed)})


def summary_columns() -> list[Column]:
    """The columns of a summary of records: means over rows without error, counts over all."""
    fine = ~is_error(F.col("status"))
    mean = lambda x: F.avg(F.when(fine, F.col(x)))
    return [
        F.count("*").alias("videos"), F.sum(fine.cast("int")).alias("evaluated"), F.sum((~fine).cast("int")).alias("errors"),
        F.count(F.when(fine, F.col("total"))).alias("scored"), mean("total").alias("total_mean"),
        F.sum((fine & F.coalesce(F.col("passed"), F.lit(False))).cast("int")).alias("consistency_passed"), mean("c").alias("consistency_mean"),
        F.count(F.when(fine & F.col("passed"), F.col("physics"))).alias("physics_evaluated"), F.avg(F.when(fine & F.col("passed"), F.col("physics"))).alias("physics_mean_attempted"),
    ]


def summarize(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(*summary_columns())


def grouped_summaries(records: DataFrame) -> DataFrame:
    """Overall, by model and by task in one aggregation: GROUPING SETS ((), (model), (task))."""
    sets = records.groupingSets([[], [F.col("model")], [F.col("task")]], "model", "task")
    return sets.agg(*summary_columns(), F.grouping_id().alias("level"))


def status_counts(records: DataFrame, *keys: str) -> DataFrame:
    """A map from status to count, statuses in order."""
    counted = records.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))


def leaderboard(records: DataFrame) -> DataFrame:
    """The unweighted mean over tasks of each task's mean total, and on how many tasks every sample passed."""
    tasks = records.filter(~is_error(F.col("status"))).groupBy("model", "task").agg(F.avg("total").alias("m"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_pass"))
    return tasks.groupBy("model").agg(F.avg("m").alias("average"), F.count("*").alias("tasks"), F.sum(F.col("all_pass").cast("int")).alias("tasks_all_pass"))


def dedup_conflicts(rows: DataFrame, keys: list[str], content: list[str], order: str) -> DataFrame:
    """First row of each key, how many rows it has, and whether their contents differ."""
    rows = rows.withColumn("_h", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_h").alias("variants"), F.min(order).alias("first"))
    return out.withColumn("conflict", F.col("variants") > 1)


def missing_tasks(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(model, task) of the selected tasks that a model has no record of. Models and tasks are small dimensions."""
    wanted = records.select("model").distinct().crossJoin(F.broadcast(tasks.select("task").distinct()))
    return wanted.join(records.select("model", "task").distinct(), ["model", "task"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(new.columns))


def to_run(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished record of the same key and signature."""
    return jobs.join(done, [*keys, "signature"], "left_anti")


def plan(models: DataFrame, tasks: DataFrame, seeds: list[int]) -> DataFrame:
    """Every model, task and seed with its sample name; dimensions are small."""
    wide = models.crossJoin(F.broadcast(tasks)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return wide.withColumn("sample", F.concat_ws("_", "model", "task", F.concat(F.lit("seed"), "seed")))


def violations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each record and broken rule; a rule whose value is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return records.withColumn("rule", F.explode(broken))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def with_catalog(jobs: DataFrame, catalog: DataFrame, key: str = "task") -> DataFrame:
    """Jobs with their catalog columns, and known: whether the catalog has the key. The catalog is a dimension of some rows."""
    return jobs.join(F.broadcast(catalog.withColumn("known", F.lit(True))), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def overridden(jobs: DataFrame, own: DataFrame, template: DataFrame, keys: list[str], template_key: str, column: str) -> DataFrame:
    """The column from a job's own row if there is one, else from its template, else null; origin says which."""
    out = jobs.join(own.select(*keys, F.col(column).alias("_own")), keys, "left").join(template.select(template_key, F.col(column).alias("_template")), template_key, "left")
    origin = F.when(F.col("_own").isNotNull(), "own").when(F.col("_template").isNotNull(), "template").otherwise("none")
    return out.withColumns({column: F.coalesce("_own", "_template"), "origin": origin}).drop("_own", "_template")


def associated(samples: DataFrame, metadata: DataFrame, key: str, digest: str) -> DataFrame:
    """state of each sample's metadata by a common key: matched, missing, ambiguous (several rows) or changed (another digest)."""
    found = metadata.groupBy(key).agg(F.count("*").alias("_n"), F.min(digest).alias("_d"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("_d").eqNullSafe(F.col(digest)), "matched").otherwise("changed")
    return samples.join(found, key, "left").withColumn("state", state).drop("_n", "_d")


def identity_mismatches(jobs: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Results that differ from their job in any of the columns that name it: key and the names of those columns."""
    back = results.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return jobs.join(back, key).withColumn("mismatch", wrong).filter(F.size("mismatch") > 0).select(key, "mismatch")


def cached(jobs: DataFrame, cache: DataFrame, signature: list[str]) -> DataFrame:
    """Jobs with the tracks that a cache holds under exactly their signature; of repeated cache rows of one signature the first."""
    return jobs.join(cache.dropDuplicates(signature), signature)
