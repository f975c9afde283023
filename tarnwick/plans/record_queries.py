"""Manifests, identity, missingness and summaries over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as X
from tarnwick.operators import records as R
from tarnwick.plans.registry import query, r6
from tarnwick.plans.views import RECORDS, SCORED, records, scored_records, table
from tarnwick.streaming.incremental import event_windows

SUMMARY = """count(*) AS videos, CAST(sum(CASE WHEN fine THEN 1 ELSE 0 END) AS BIGINT) AS evaluated, CAST(sum(CASE WHEN fine THEN 0 ELSE 1 END) AS BIGINT) AS errors, count(total) FILTER (fine) AS scored, round(avg(total) FILTER (fine), 6) AS total_mean,
    CAST(sum(CASE WHEN fine AND passed THEN 1 ELSE 0 END) AS BIGINT) AS consistency_passed, round(avg(c) FILTER (fine), 6) AS consistency_mean, count(physics) FILTER (fine AND passed) AS physics_evaluated, round(avg(physics) FILTER (fine AND passed), 6) AS physics_mean_attempted"""
MEANS = ("total_mean", "consistency_mean", "physics_mean_attempted")


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in MEANS})


@query(f"WITH {SCORED} SELECT model, {SUMMARY} FROM totals GROUP BY model")
def by_model_summary(spark, sf_dir):
    return rounded(R.summarize(scored_records(spark, sf_dir), "model"))


@query(f"WITH {SCORED} SELECT {SUMMARY} FROM totals")
def batch_aggregate(spark, sf_dir):
    return rounded(R.summarize(scored_records(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT model, task, {SUMMARY}, CAST(grouping(model, task) AS BIGINT) AS level FROM totals GROUP BY GROUPING SETS ((), (model), (task))")
def by_model_task_grouping_sets(spark, sf_dir):
    return rounded(R.grouped_summaries(scored_records(spark, sf_dir)))


@query(f"WITH {SCORED}, t AS (SELECT model, task, avg(total) AS m, bool_and(coalesce(passed, false)) AS p FROM totals WHERE fine GROUP BY model, task) SELECT model, round(avg(m), 6) AS average, count(*) AS tasks, CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) AS BIGINT) AS tasks_all_pass FROM t GROUP BY model")
def leaderboard_avg_of_avg(spark, sf_dir):
    return R.leaderboard(scored_records(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(f"WITH {SCORED} SELECT model, task, bool_and(c >= 0.3) AS all_pass FROM totals WHERE fine GROUP BY model, task")
def all_pass_flag(spark, sf_dir):
    return scored_records(spark, sf_dir).filter(~R.is_error(F.col("status"))).groupBy("model", "task").agg(F.bool_and(F.col("c") >= 0.3).alias("all_pass"))


@query(f"WITH {RECORDS} SELECT model, status, count(*) AS n FROM records GROUP BY model, status")
def status_counts(spark, sf_dir):
    return R.status_counts(records(spark, sf_dir), "model").select("model", F.explode("counts").alias("status", "n"))


@query(f"""WITH {SCORED}, m AS (SELECT *, CASE WHEN e2 IS NULL THEN 1 ELSE 2 END AS measured FROM totals),
s AS (SELECT sample, CASE WHEN NOT fine THEN 'consistency_error' WHEN NOT passed THEN 'consistency_rejected' WHEN sample % 19 = 0 THEN 'execution_error' WHEN measured = 2 THEN CASE WHEN sample % 5 = 0 THEN 'scored_with_zero' ELSE 'complete' END ELSE 'partial' END AS run_status,
    CASE WHEN sample % 97 = 0 THEN 'task_failed' WHEN measured < 2 THEN 'evidence_insufficient' WHEN physics >= 0.5 THEN 'physics_pass' ELSE 'physics_fail' END AS judgment FROM m) SELECT * FROM s""")
def status_classify(spark, sf_dir):
    r = scored_records(spark, sf_dir).withColumn("measured", F.when(F.col("e2").isNull(), 1).otherwise(2))
    k = F.col("sample")
    status = R.run_status(~R.is_error(F.col("status")), F.col("passed"), k % 19 == 0, F.lit(2), F.col("measured"), (k % 5 == 0).cast("int"))
    return r.select("sample", status.alias("run_status"), R.judgment(k % 97 == 0, F.col("physics"), F.col("measured") / 2, F.lit(0.5)).alias("judgment"))


@query(f"""WITH {SCORED}, m AS (SELECT sample, passed, CASE WHEN e2 IS NULL THEN 'not_observed' ELSE 'measured' END AS status, 1 / (1 + e2 / 0.05) AS q FROM totals)
SELECT sample, round(CASE WHEN status = 'not_observed' AND sample % 2 = 0 AND passed AND sample % 3 <> 0 THEN 0 ELSE q END, 6) AS physics_score, status = 'not_observed' AND sample % 2 = 0 AND passed AND sample % 3 <> 0 AS zeroed FROM m""")
def zero_policy(spark, sf_dir):
    from tarnwick.functions.scores import residual_score

    k = F.col("sample")
    m = scored_records(spark, sf_dir).select("sample", "passed", F.when(F.col("e2").isNull(), "not_observed").otherwise("measured").alias("status"), residual_score(F.col("e2"), 0.05).alias("physics_score"), (k % 2 == 0).alias("evidence"), (k % 3 != 0).alias("completed"))
    return R.zero_policy(m).select("sample", r6("physics_score"), "zeroed")


@query(f"WITH {RECORDS} SELECT model, task, owner, count(*) AS n, count(DISTINCT c) AS variants, min(sample) AS first, count(DISTINCT c) > 1 AS conflict FROM records GROUP BY model, task, owner")
def dedup_conflicts(spark, sf_dir):
    return R.dedup_conflicts(records(spark, sf_dir), ["model", "task", "owner"], ["c"], "sample")


@query(f"WITH {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY c DESC, sample) AS k FROM records) SELECT model, task, sample, c FROM k WHERE k = 1")
def first_by_order(spark, sf_dir):
    return R.first_by(records(spark, sf_dir), ["model", "task"], [F.col("c").desc(), F.col("sample")]).select("model", "task", "sample", "c")


@query(f"WITH {RECORDS}, have AS (SELECT DISTINCT model, task FROM records WHERE c >= 0.98), m AS (SELECT DISTINCT model FROM have), t AS (SELECT DISTINCT task FROM records) SELECT m.model, t.task FROM m, t WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.model = m.model AND h.task = t.task)")
def missing_tasks_anti(spark, sf_dir):
    r = records(spark, sf_dir)
    return R.missing_tasks(r.filter("c >= 0.98"), r)


@query(f"WITH {RECORDS}, n AS (SELECT sample, 1.0::DOUBLE AS c FROM records WHERE e2 IS NULL) SELECT sample, c FROM n UNION ALL SELECT sample, c FROM records WHERE status = 'complete' AND sample NOT IN (SELECT sample FROM n)")
def manifest_upsert(spark, sf_dir):
    r = records(spark, sf_dir)
    old, new = r.filter("status = 'complete'").select("sample", "c"), r.filter("e2 IS NULL").select("sample", F.lit(1.0).alias("c"))
    return R.upsert(old, new, ["sample"])


@query(f"WITH {RECORDS} SELECT sample FROM records WHERE NOT (status = 'complete' AND e2 IS NOT NULL)")
def resume_left_anti(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("signature", X.canonical_hash(F.col("c"), F.col("e1")))
    done = r.filter("status = 'complete'").select("sample", F.when(F.col("e2").isNotNull(), F.col("signature")).otherwise(F.lit("changed")).alias("signature"))
    return R.to_run(r.select("sample", "signature"), done, ["sample"]).select("sample")


@query("SELECT r_name AS model, 'P' || n_nationkey AS task, s.seed::INTEGER AS seed, r_name || '_P' || n_nationkey || '_seed' || s.seed AS sample FROM region, nation, (VALUES (42), (43), (44), (45)) AS s(seed)")
def plan_cartesian(spark, sf_dir):
    models = table(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    tasks = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("task"))
    return R.plan(models, tasks, [42, 43, 44, 45])


@query(f"""WITH {RECORDS} SELECT sample, coalesce(regexp_extract('m_' || task || '_seed' || (sample % 50) || '.mp4', '(?:^|[_-])(P[0-9]+[a-z]?)(?:[_.-]|$)', 1), '') AS task_id, CAST(sample % 50 AS INTEGER) AS seed, CAST(substr(task, 2) AS INTEGER) AS number FROM records""")
def task_id_regex(spark, sf_dir):
    name = F.concat(F.lit("m_"), F.col("task"), F.lit("_seed"), (F.col("sample") % 50).cast("string"), F.lit(".mp4"))
    return records(spark, sf_dir).select("sample", F.get(X.task_ids(name), F.lit(0)).alias("task_id"), X.seed_of(name).alias("seed"), X.task_number(F.col("task")).alias("number"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS by_name, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS by_brand FROM part")
def safe_name_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.is_safe_name(F.col("p_name")).alias("by_name"), X.is_safe_name(F.col("p_brand")).alias("by_brand"))


@query(r"""WITH f AS (SELECT page_id, list_last(string_split(url, '/')) AS file FROM pages) SELECT page_id, file, regexp_replace(file, '[.][^.]*$', '') AS stem, regexp_extract(file, '([.][^.]*)$', 1) AS suffix FROM f""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.file_name(u).alias("file"), X.stem(u).alias("stem"), X.suffix(u).alias("suffix"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(f), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')) AS body, length(f) AS n FROM (SELECT conv_id, turn, '```json' || chr(10) || replace(text, '`', '') || chr(10) || '```' AS f FROM conversations)""")
def fence_removal(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.replace("text", F.lit("`"), F.lit("")), F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_fences(fenced).alias("body"), F.length(fenced).cast("bigint").alias("n"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def sha256_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query(f"WITH {RECORDS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY CAST(substr(task, 2) AS INTEGER), sample) AS INTEGER) AS place FROM records) SELECT model, task, sample, place FROM k")
def numeric_task_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("model").orderBy(X.task_number(F.col("task")), "sample")
    return records(spark, sf_dir).select("model", "task", "sample", F.row_number().over(order).alias("place"))


@query(f"""WITH {SCORED}, b AS (SELECT sample, unnest(['c_in_range', 'total_is_sum', 'errors_have_no_total', 'physics_in_range', 'passed_has_physics']) AS rule,
    unnest([c BETWEEN 0.05 AND 0.95, CASE WHEN fine AND passed THEN abs(0.15 * c + 0.85 * physics - total) <= 1e-9 ELSE true END, fine OR total IS NULL, physics BETWEEN 0 AND 0.8, NOT passed OR e2 IS NOT NULL]) AS ok FROM totals) SELECT sample, rule FROM b WHERE NOT coalesce(ok, false)""")
def validator_violations(spark, sf_dir):
    c, p, t = F.col("c"), F.col("physics"), F.col("total")
    rules = {
        "c_in_range": c.between(0.05, 0.95), "total_is_sum": F.when(F.col("passed"), F.abs(0.15 * c + 0.85 * p - t) <= 1e-9).otherwise(F.lit(True)),
        "errors_have_no_total": ~R.is_error(F.col("status")) | t.isNull(), "physics_in_range": p.between(0, 0.8), "passed_has_physics": ~F.col("passed") | F.col("e2").isNotNull(),
    }
    return R.violations(scored_records(spark, sf_dir), rules).select("sample", "rule")


@query("SELECT task FROM (SELECT DISTINCT 'P' || n_nationkey AS task FROM nation) EXCEPT SELECT 'P' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0")
def set_difference(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("task"), "n_nationkey")
    return n.select("task").subtract(n.filter("n_nationkey % 3 = 0").select("task"))


@query("SELECT 'P' || n_nationkey AS task FROM nation WHERE n_nationkey % 3 = 0 INTERSECT SELECT 'P' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def set_intersection(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("task"), "n_nationkey")
    return n.filter("n_nationkey % 3 = 0").select("task").intersect(n.filter("n_nationkey % 2 = 0").select("task"))


@query("""WITH d AS (SELECT doc_id, n_chars % 900 + 1 AS n_frames FROM documents), f AS (SELECT DISTINCT doc_id, CAST(round_even(k * (n_frames - 1) / 23.0::DOUBLE, 0) AS INTEGER) AS frame FROM d, (SELECT unnest(range(24)) AS k)) SELECT doc_id, frame, round(frame / 24.0::DOUBLE, 6) AS second FROM f""")
def frame_sampling(spark, sf_dir):
    from tarnwick.sources.files import even_frames

    meta = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 900 + 1).alias("n_frames"), F.lit(24.0).alias("fps"))
    return even_frames(meta, 24).select("doc_id", "frame", r6("second"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows_daily(spark, sf_dir):
    return event_windows(table(spark, sf_dir, "events")).withColumns({"start": F.date_format("start", "yyyy-MM-dd"), "total": F.round("total", 2)})


@query("""SELECT o_orderkey AS sample, n.n_name AS name, n.n_nationkey IS NOT NULL AS known FROM orders LEFT JOIN nation n ON n.n_nationkey = o_custkey % 31""")
def catalog_join(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 31).cast("int").alias("task"))
    catalog = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), F.col("n_name").alias("name"))
    return R.with_catalog(jobs, catalog).select("sample", "name", "known")


@query("""SELECT c_custkey AS sample, coalesce(o.s_name, n.n_name) AS name, CASE WHEN o.s_name IS NOT NULL THEN 'own' WHEN n.n_name IS NOT NULL THEN 'template' ELSE 'none' END AS origin
FROM customer LEFT JOIN supplier o ON o.s_suppkey = c_custkey LEFT JOIN nation n ON n.n_nationkey = c_nationkey + 3""")
def annotation_override(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), (F.col("c_nationkey") + 3).alias("task"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_name").alias("name"))
    template = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), F.col("n_name").alias("name"))
    return R.overridden(jobs, own, template, ["sample"], "task", "name").select("sample", "name", "origin")


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderpriority) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS sample, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN d IS NOT DISTINCT FROM CASE WHEN c_nationkey < 12 THEN '1-URGENT' ELSE '5-LOW' END THEN 'matched' ELSE 'changed' END AS state FROM customer LEFT JOIN m ON m.k = c_custkey""")
def metadata_association(spark, sf_dir):
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_nationkey") < 12, "1-URGENT").otherwise("5-LOW").alias("digest"))
    meta = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("digest"))
    return R.associated(samples, meta, "sample", "digest").select("sample", "state")


@query(f"""WITH {RECORDS}, b AS (SELECT sample, CASE WHEN e2 IS NULL THEN 'other' ELSE model END AS model, CASE WHEN forced THEN 'P0' ELSE task END AS task FROM records WHERE status = 'complete'),
w AS (SELECT r.sample, list_filter([CASE WHEN r.model <> b.model THEN 'model' END, CASE WHEN r.task <> b.task THEN 'task' END], lambda x: x IS NOT NULL) AS w FROM records r JOIN b USING (sample)) SELECT sample, array_to_string(w, ';') AS mismatch FROM w WHERE len(w) > 0""")
def identity_mismatches(spark, sf_dir):
    r = records(spark, sf_dir)
    back = r.filter("status = 'complete'").select("sample", F.when(F.col("e2").isNull(), "other").otherwise(F.col("model")).alias("model"), F.when(F.col("forced"), "P0").otherwise(F.col("task")).alias("task"))
    return R.identity_mismatches(r.select("sample", "model", "task"), back, "sample", ["model", "task"]).select("sample", F.array_join("mismatch", ";").alias("mismatch"))
