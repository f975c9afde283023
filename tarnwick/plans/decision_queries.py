"""Judgments, acceptance and quality of evidence over records, tracks and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import decisions as D
from tarnwick.operators import kernels as K
from tarnwick.plans.registry import query, r6
from tarnwick.plans.series_queries import DAY, RUNS, _kernel
from tarnwick.plans.views import RECORDS, SCORED, SERIES, records, scored_records, series, table


@query(f"""WITH {SCORED}, m AS (SELECT sample, task, unnest(['M1', 'M2']) AS metric_id, unnest([1 / (1 + abs(e1) / 0.1), 1 / (1 + abs(e2) / 0.05)]) AS q, unnest([true, owner % 3 <> 0]) AS d, passed, sample % 101 = 0 AS failed FROM totals),
j AS (SELECT *, CASE WHEN NOT passed THEN 'evidence_insufficient' WHEN failed THEN 'task_failed' WHEN q IS NULL THEN 'evidence_insufficient' WHEN q >= CASE task WHEN 'P25' THEN 0.65 WHEN 'P40' THEN 0.5 ELSE 0.8 END THEN 'physics_pass' ELSE 'physics_fail' END AS judgment FROM m)
SELECT sample, CASE WHEN bool_or(judgment = 'task_failed') THEN 'task_failed' WHEN bool_and(judgment = 'physics_pass') THEN 'physics_pass' WHEN bool_and(judgment IN ('physics_pass', 'physics_fail')) THEN 'physics_fail' ELSE 'evidence_insufficient' END AS judgment,
    round(avg(CASE WHEN judgment IN ('physics_pass', 'physics_fail') THEN 1 ELSE 0 END), 6) AS coverage FROM j WHERE d GROUP BY sample""")
def result_judgments(spark, sf_dir):
    from tarnwick.functions.scores import residual_score

    two = F.array(
        F.struct(F.lit("M1").alias("metric_id"), residual_score(F.col("e1"), 0.1).alias("q"), F.lit(True).alias("defined")),
        F.struct(F.lit("M2").alias("metric_id"), residual_score(F.col("e2"), 0.05).alias("q"), (F.col("owner") % 3 != 0).alias("defined")),
    )
    m = scored_records(spark, sf_dir).select("sample", "task", "passed", F.explode(two).alias("m")).select("sample", "task", "passed", "m.*")
    said = D.metric_judgment(F.col("passed"), F.col("sample") % 101 == 0, F.col("q").isNotNull(), F.col("q"), D.pass_threshold(F.col("task")))
    return D.result_judgments(m.withColumn("judgment", said), ["sample"]).select("sample", "judgment", r6("coverage"))


@query(f"""WITH {RECORDS}, b AS (SELECT sample, task, CASE task WHEN 'P9' THEN [CASE WHEN e1 > 0.1 THEN 'time_ratio_relative_error_gt_10pct' END]
    WHEN 'P11' THEN [CASE WHEN e1 > 0.1 THEN 'acceleration_ratio_relative_error_gt_10pct' END, CASE WHEN NOT coalesce(e2 > 0.4, false) THEN 'return_time_not_longer' END, CASE WHEN sample % 4 = 0 THEN 'ramp_angle_fallback' END]
    WHEN 'P13' THEN [CASE WHEN e1 > 0.05 THEN 'period_ratio_error_gt_0.05' END, CASE WHEN NOT coalesce(e2 > 0.5, false) THEN 't30_not_greater_than_t15' END, CASE WHEN e2 > 0.25 THEN 'sinusoid_residual_gt_0.25' END]
    WHEN 'P20' THEN [CASE WHEN e1 > 0.05 THEN 'index_cv_gt_0.05' END, CASE WHEN NOT coalesce(sample % 6 >= 3, false) THEN 'pair_count_lt_3' END, CASE WHEN sample % 2 <> 1 THEN 'total_reflection_not_verified' END]
    WHEN 'P28' THEN [CASE WHEN sample % 2 <> 1 THEN 'crushed_not_faster' END] ELSE ['unknown_task'] END AS r FROM records), f AS (SELECT sample, task, list_filter(r, lambda x: x IS NOT NULL) AS r FROM b)
SELECT sample, task, array_to_string(r, ';') AS reasons, len(r) = 0 AS accepted FROM f""")
def acceptance_bands(spark, sf_dir):
    k = F.col("sample")
    values = {
        "m1": F.col("e1"), "pairs": k % 6, "verified": k % 2, "lead": k % 2, "t30": F.col("e2"), "t15": F.when(F.col("e2").isNotNull(), F.lit(0.5)), "fit_residual": F.col("e2"),
        "t_down": F.col("e2"), "t_up": F.when(F.col("e2").isNotNull(), F.lit(0.4)), "angle_fallback": (k % 4 == 0).cast("int"),
    }
    m = records(spark, sf_dir).select("sample", "task", F.create_map(*[p for n, v in values.items() for p in (F.lit(n), v.cast("double"))]).alias("quantities"))
    return D.accepted(m).select("sample", "task", F.array_join("reasons", ";").alias("reasons"), "accepted")


@query(f"""WITH {SERIES}, few AS (SELECT track, i, t / {DAY} - 19700 AS t, y FROM series), s AS (SELECT a.track, median((b.y - a.y) / (b.t - a.t)) AS slope FROM few a JOIN few b ON a.track = b.track AND a.i < b.i WHERE abs(b.t - a.t) > 1e-9 GROUP BY a.track),
c AS (SELECT f.track, max(slope) AS slope, median(y - slope * t) AS icpt FROM few f JOIN s USING (track) GROUP BY f.track),
r AS (SELECT f.track, CAST(count(*) AS INTEGER) AS n, max(slope) AS slope, sqrt(avg((y - slope * t - icpt) ** 2)) AS rms, max(t) - min(t) AS span FROM few f JOIN c USING (track) GROUP BY f.track)
SELECT track, n, round(slope, 4) AS slope, round(rms, 4) AS rms, n >= 3 AND span > 0 AND rms <= greatest(0.75, 0.15 * abs(slope) * span) AND abs(slope) * span >= 3 * greatest(0.35, rms) AS usable FROM r""")
def velocity_quality(spark, sf_dir):
    days = series(spark, sf_dir).withColumn("t", F.col("t") / DAY - 19700)
    return D.velocity_quality(days, ["track"]).select("track", "n", F.round("slope", 4).alias("slope"), F.round("rms", 4).alias("rms"), "usable")


@query(RUNS + """, f AS (SELECT r.track, r.start, r.stop, r.n, max(s.y) - arg_min(s.y, s.i) AS fall FROM runs r JOIN series s ON s.track = r.track AND s.i BETWEEN r.start AND r.stop GROUP BY r.track, r.start, r.stop, r.n),
a AS (SELECT track, min(start) AS start FROM f WHERE n >= 6 AND fall >= 150 GROUP BY track), b AS (SELECT track, start, stop, row_number() OVER (PARTITION BY track ORDER BY n DESC, start) AS k FROM f)
SELECT b.track, coalesce(a.start, b.start) AS start, CAST(coalesce(fa.stop, b.stop) + 1 AS BIGINT) AS stop FROM b LEFT JOIN a USING (track) LEFT JOIN f fa ON fa.track = b.track AND fa.start = a.start WHERE b.k = 1""")
def first_descent(spark, sf_dir):
    return D.first_descent(series(spark, sf_dir), 6, 150).select("track", F.col("start").cast("int").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query(f"""WITH {SERIES}, b AS (SELECT track, min(t) AS t0, max(t) AS t1 FROM series GROUP BY track), e AS (SELECT track, k::INTEGER AS edge, t0 + (t1 - t0) * k / 8 AS at_ FROM b, (SELECT unnest(range(9)) AS k)),
n AS (SELECT track, t, y, lead(t) OVER w AS tn, lead(y) OVER w AS yn FROM series WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT e.track, e.edge, round(CASE WHEN n.tn IS NULL OR n.tn = n.t THEN n.y ELSE n.y + (n.yn - n.y) * (e.at_ - n.t) / (n.tn - n.t) END, 4) AS value FROM e JOIN n ON n.track = e.track AND e.at_ >= n.t AND (e.at_ < n.tn OR n.tn IS NULL)""")
def resample_edges(spark, sf_dir):
    return D.resampled(series(spark, sf_dir), 9).select("track", "edge", F.round("value", 4).alias("value"))


@query(f"""WITH {SERIES}, p AS (SELECT *, (i - 1) // 6 AS part FROM series), c AS (SELECT *, y - avg(y) OVER (PARTITION BY track, part) AS c FROM p WHERE valid), n AS (SELECT *, lead(c) OVER w AS cn, lead(t) OVER w AS tn FROM c WINDOW w AS (PARTITION BY track, part ORDER BY i)),
x AS (SELECT track, part, CASE WHEN c = 0 THEN t ELSE t + (tn - t) * c / (c - cn) END AS tc FROM n WHERE cn IS NOT NULL AND (c = 0 OR c * cn < 0)), r AS (SELECT track, part, 2 * (max(tc) - min(tc)) AS rough FROM x GROUP BY track, part HAVING count(*) = 2 AND max(tc) > min(tc)),
e AS (SELECT track, part, arg_min(y, i) AS y0, min(t) AS t0, min(y) AS lo, max(y) AS hi FROM p GROUP BY track, part),
f AS (SELECT r.track, r.part, abs(y - y0) AS off, abs(t - t0 - rough) AS far, t - t0 AS since, t - t0 >= 0.98 * rough AND t - t0 <= 1.25 * rough AND abs(y - y0) <= 0.02 * (hi - lo) AND abs(y0 - (lo + hi) / 2) >= 0.45 * (hi - lo) AS fits FROM r JOIN e USING (track, part) JOIN p USING (track, part)),
k AS (SELECT *, row_number() OVER (PARTITION BY track, part ORDER BY off, far, since) AS k FROM f WHERE fits) SELECT r.track, CAST(r.part AS BIGINT) AS part, round(k.since, 3) AS period FROM r LEFT JOIN k ON k.track = r.track AND k.part = r.part AND k.k = 1""")
def release_return(spark, sf_dir):
    parts = series(spark, sf_dir).withColumn("part", F.floor((F.col("i") - 1) / 6))
    return D.release_return(parts, ["track", "part"]).select("track", "part", F.round("period", 3).alias("period"))


@query(f"""WITH {SERIES}, f AS (SELECT *, y - first_value(y) OVER (PARTITION BY track ORDER BY i) AS d FROM series WHERE track % 5 <> 0), m AS (SELECT i, median(d) AS drift FROM f GROUP BY i)
SELECT s.track, s.i, round(s.y - coalesce(m.drift, 0), 6) AS still FROM series s LEFT JOIN m USING (i) WHERE s.track % 5 = 0""")
def camera_drift(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("sample", F.lit("s")).withColumn("object", F.col("track"))
    return D.without_drift(s.filter("track % 5 = 0"), s.filter("track % 5 <> 0")).select("track", "i", r6("still"))


@query("SELECT doc_id, [CAST(round_even(v, 0) AS INTEGER) FOR v IN [(doc_id % 97) * 1.5, (doc_id % 89) * 0.5, (n_chars % 61) * 1.5, (n_chars % 53) * 0.5]]::VARCHAR AS box FROM documents")
def annotation_rescale(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars")
    box = F.array(*[v.cast("double") for v in (d % 97, d % 89, n % 61, n % 53)])
    out = D.rescaled(box, F.lit(1.5), F.lit(0.5))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(out, ", "), F.lit("]")).alias("box"))


PHRASES = (" The event did Not Occur.", " The task was not  completed!", " conditions are invalid", " A prevented task.", " condition not satisfied", " The event did not occurred.", " TASK FAILED", " the event never occurred")


@query(f"""SELECT conv_id, turn, regexp_matches(text || {list(PHRASES)!r}[turn % 8 + 1], '(?i)\\b(?:event|task)\\s+(?:was\\s+)?(?:not\\s+completed|did\\s+not\\s+occur|failed)\\b|\\b(?:condition|conditions)\\s+(?:are\\s+)?(?:invalid|not\\s+satisfied|failed)\\b') AS failed FROM conversations""")
def event_phrases(spark, sf_dir):
    said = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("turn") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", D.states_failure(said).alias("failed"))


@query(f"""WITH {SERIES}, l AS (SELECT track, list(y ORDER BY i) AS v FROM series GROUP BY track) SELECT track, CAST(len(v) AS INTEGER) AS n, round(v[1], 6) AS first, round(v[len(v)], 6) AS last, CAST(CASE WHEN len(v) > 24 THEN 6 ELSE len(v) END AS INTEGER) AS kept FROM l""")
def series_summary(spark, sf_dir):
    lists = series(spark, sf_dir).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("p"))
    s = lists.select("track", D.shortened(F.transform("p", lambda x: x["y"])).alias("s"))
    return s.select("track", "s.n", r6(F.get("s.head", F.lit(0)), "first"), r6(F.element_at(F.coalesce("s.tail", "s.head"), -1), "last"), F.size("s.head").alias("kept"))


@query("(SELECT n_regionkey AS k, 'left' AS side FROM nation EXCEPT SELECT o_custkey % 4, 'left' FROM orders) UNION (SELECT o_custkey % 9, 'right' FROM orders EXCEPT SELECT n_regionkey, 'right' FROM nation)")
def symmetric_difference(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("k"))
    orders = table(spark, sf_dir, "orders")
    a = left.subtract(orders.select((F.col("o_custkey") % 4).alias("k"))).withColumn("side", F.lit("left"))
    return a.unionByName(orders.select((F.col("o_custkey") % 9).alias("k")).subtract(left).withColumn("side", F.lit("right")))


@query("""WITH j AS (SELECT doc_id, doc_id % 6 AS a, doc_id % 5 AS b, doc_id % 3 AS e, doc_id % 4 AS w, doc_id % 13 = 0 AS bad FROM labels),
r AS (SELECT doc_id, a, bad, CASE WHEN bad THEN ['not_a_reply'] ELSE list_filter([CASE WHEN w = 0 THEN 'visual_keys' END, CASE WHEN a > 4 THEN 'severity_range' END, CASE WHEN e = 0 AND (a > 0 OR b > 0) THEN 'evidence_missing' END, CASE WHEN e = 2 AND w = 3 THEN 'evidence_order' END, CASE WHEN e > 0 AND b = 4 THEN 'evidence_outside' END], lambda x: x IS NOT NULL) END AS broken FROM j)
SELECT doc_id, CASE WHEN NOT bad THEN a::INTEGER END AS identity, array_to_string(broken, ';') AS broken FROM r""")
def reply_rules(spark, sf_dir):
    from tarnwick.operators import replies as P

    k = F.col("doc_id")
    a, b, e, w = k % 6, k % 5, k % 3, k % 4
    start, end = F.when((e == 2) & (w == 3), 2.0).otherwise(0.5), F.when(b == 4, 9.0).otherwise(1.0)
    start = F.when((e == 2) & (w == 3), end + 1).otherwise(start)
    proof = F.when(e == 0, F.lit("[]")).otherwise(F.format_string('[{"start_seconds": %s, "end_seconds": %s, "description": "d"}]', start.cast("string"), end.cast("string")))
    item = lambda n, v: F.format_string('"%s": {"severity": %s, "evidence": %s}', F.lit(n), v.cast("string"), proof)
    first = F.when(w == 0, F.lit("other")).otherwise(F.lit("clarity"))
    visual = F.concat_ws(", ", item("identity", a), item("flicker", b), item("scene", F.lit(0)), F.format_string('"%s": {"severity": 0, "evidence": %s}', first, proof))
    task = F.concat_ws(", ", *[item(n, F.lit(0)) for n in P.TASK])
    text = F.concat(F.lit('```json\n{"reason": "r", "assessment": {'), visual, F.lit('}, "task_assessment": {'), task, F.lit('}, "quality_checks": {"multiple_balls": false}}\n```'))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(k % 13 == 0, F.lit("no reply")).otherwise(text).alias("reply"), F.lit(5.0).alias("seconds"))
    out = P.checked(rows, "reply", "seconds")
    return out.select("doc_id", P.severity(F.col("judgment"), "assessment", "identity").alias("identity"), F.array_join("broken", ";").alias("broken"))


@query()
def shrink_events(spark, sf_dir):
    import numpy as np

    def event(c):
        area = 1000 * np.exp(-np.arange(len(c["y"])) / 30) + c["y"] / 50
        return [K.shrink_event(area, c["valid"], float(np.median(area[:5])))]

    return _kernel(spark, sf_dir, event, "frame double, depth double")


@query(f"""WITH {SERIES}, p AS (SELECT track, i, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, sum(y) OVER (PARTITION BY track ORDER BY i) AS c FROM series), e AS (SELECT track, arg_min(c, i) AS lo, arg_max(c, i) AS hi, count(*) AS n FROM p GROUP BY track),
k AS (SELECT p.track, min(p.i) AS k, max((lo + hi) / 2) AS half FROM p JOIN e USING (track) WHERE n >= 4 AND hi - lo > 3 AND c >= (lo + hi) / 2 GROUP BY p.track)
SELECT e.track, round(a.t + (b.t - a.t) * (half - a.c) / (b.c - a.c), 6) AS days FROM e LEFT JOIN k USING (track) LEFT JOIN p b ON b.track = k.track AND b.i = k.k LEFT JOIN p a ON a.track = k.track AND a.i = k.k - 1""")
def rise_half_time(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(None if at is None else round(at, 6),) for at in [K.rise_half_time((c["t"] - c["t"][0]) / DAY, c["y"].cumsum(), 1.0)]], "days double")


@query(f"""WITH {SERIES}, p AS (SELECT track, CAST(i - 1 AS INTEGER) AS i, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, 5000 - sum(y) OVER (PARTITION BY track ORDER BY i) AS h, greatest(3, least(8, count(*) OVER (PARTITION BY track) // 8)) AS head FROM series),
b AS (SELECT track, median(h) FILTER (i < head) AS base FROM p GROUP BY track), m AS (SELECT p.track, max(base) AS base, max(base) - 3 * greatest(1e-9, 1.4826 * median(abs(h - base)) FILTER (i < head)) AS limit_ FROM p JOIN b USING (track) GROUP BY p.track),
k AS (SELECT a.track, a.i FROM p a JOIN m ON m.track = a.track JOIN p f ON f.track = a.track AND f.t >= a.t AND f.t <= a.t + 2.0 + 1e-9 WHERE a.i >= a.head AND a.h < limit_ GROUP BY a.track, a.i HAVING avg(CASE WHEN f.h < limit_ THEN 1 ELSE 0 END) >= 0.8)
SELECT m.track, min(k.i)::DOUBLE AS frame FROM m LEFT JOIN k USING (track) GROUP BY m.track""")
def discharge_onset(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(K.discharge_onset((c["t"] - c["t"][0]) / DAY, 5000 - c["y"].cumsum(), 2.0),)], "frame double")


@query()
def shared_vertex(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [K.shared_vertex((c["t"] - c["t"][0]) / DAY, (250 - c["y"]).cumsum()) or (None, None, None)], "turn double, before double, after double")
