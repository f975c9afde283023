"""Pass rules, validators, pools, leftovers and names over records, tracks, points and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import scores as C
from tarnwick.functions import text as X
from tarnwick.operators import adapters as A
from tarnwick.operators import envelopes as V
from tarnwick.operators import kernels as K
from tarnwick.operators import rules as R
from tarnwick.plans.registry import query, r6
from tarnwick.plans.views import POINTS, RECORDS, SERIES, points, records, series, table


@query(f"""WITH {RECORDS} SELECT sample, CASE WHEN e2 IS NULL THEN 0.01 ELSE round(greatest(0.01, 1 / (1 + greatest(0, 0.8 - e2) / 0.2)), 6) END AS high, CASE WHEN e2 IS NULL THEN 0.01 ELSE round(greatest(0.01, least(1, e2 / 0.4)), 6) END AS fraction,
round(coalesce(e2 / (e2 + 0.3), 0), 6) AS evidence, CASE WHEN e2 IS NULL THEN 0 ELSE round(least(1, e2 / 0.5), 6) END AS support,
round(CASE WHEN abs(e1 * 20 - 8) + abs(12 - c * 30) = 0 THEN 0 ELSE (1 - least(1, abs(e1 * 20 - 8 + 12 - c * 30) / (abs(e1 * 20 - 8) + abs(12 - c * 30)))) * least(1, least(abs(e1 * 20 - 8), abs(12 - c * 30)) / 3) END, 6) AS balance FROM records""")
def evidence_scores(spark, sf_dir):
    e2 = F.col("e2")
    return records(spark, sf_dir).select(
        "sample", r6(C.high_quality(e2, 0.8, 0.2), "high"), r6(C.evidence_fraction(e2, 0.4), "fraction"), r6(C.evidence_quality(e2, 0.3), "evidence"), r6(C.support_quality(e2, 0.5), "support"),
        r6(C.deflection_balance(F.col("e1") * 20 - 8, 12 - F.col("c") * 30, 3.0), "balance"),
    )


@query(f"""WITH {RECORDS}, v AS (SELECT sample, [e1, c, e2] AS r, e1 AS m1, c AS a, e2 AS b, (c + e1) / 2 AS o FROM records),
f AS (SELECT sample, m1, o, list_filter([CASE WHEN a < 0.3 THEN 'shape' END, CASE WHEN b < 0.3 THEN 'drift' END], lambda x: x IS NOT NULL) AS low, coalesce(r[1] < 0.9 AND r[2] < 0.9 AND r[3] < 0.9, false) AS falls FROM v)
SELECT sample, array_to_string(list_filter([CASE WHEN NOT falls THEN 'rebound_heights_not_strictly_decreasing' END, CASE WHEN NOT (m1 <= 0.5) THEN 'height_time_restitution_consistency_failed' END,
    CASE WHEN len(low) > 0 THEN 'low_dimensions:' || array_to_string(low, ',') END, CASE WHEN NOT (o >= 0.4) THEN 'overall_score_below_threshold' END], lambda x: x IS NOT NULL), ';') AS reasons FROM f""")
def rebound_rules(spark, sf_dir):
    e1, c, e2 = F.col("e1"), F.col("c"), F.col("e2")
    found = R.rebound_failures(F.array(e1, c, e2), e1, {"shape": c, "drift": e2}, (c + e1) / 2, 0.5, 0.3, 0.4, 0.9)
    return records(spark, sf_dir).select("sample", F.array_join(found, ";").alias("reasons"))


@query(f"WITH {RECORDS} SELECT sample, coalesce(e1 <= 0.3 AND e2 <= 0.6 AND c >= 0.2, false) AS pendulum, coalesce(sample % 50 >= 12 AND c >= 0.25 AND e1 <= 0.7 AND e2 BETWEEN 0.1 AND 0.8, false) AS line, coalesce(c >= 0.3 AND e1 <= 0.6 AND abs(e2 - 0.5) <= 0.3, false) AS surface FROM records")
def quality_gates(spark, sf_dir):
    e1, c, e2 = F.col("e1"), F.col("c"), F.col("e2")
    return records(spark, sf_dir).select(
        "sample", R.pendulum_passes(e1, e2, c, 0.3, 0.6, 0.2).alias("pendulum"), R.line_is_sound(F.col("sample") % 50, c, e1, e2, 12, 0.25, 0.7, (0.1, 0.8)).alias("line"),
        R.surface_is_sound(c, e1, e2 - 0.5, 0.3, 0.6, 0.3).alias("surface"),
    )


@query(f"""WITH {SERIES}, s AS (SELECT track, i, y, lag(i) OVER w AS f, lag(y) OVER w AS p FROM series WHERE valid WINDOW w AS (PARTITION BY track ORDER BY i)) SELECT track, f AS "from", i AS "to", round(abs(y - p) / greatest(1, i - f), 6) AS speed, 90.0::DOUBLE AS "limit" FROM s WHERE abs(y - p) / greatest(1, i - f) > 90""")
def tail_switches(spark, sf_dir):
    return R.switches(series(spark, sf_dir), R.tube_limit(45.0, 1000.0), ["track"]).select("track", "from", "to", r6("speed"), "limit")


@query(f"""WITH {POINTS}, l AS (SELECT g, n, count(*) AS c FROM points WHERE k % 7 = 0 GROUP BY g, n), u AS (SELECT DISTINCT g, n FROM points WHERE k % 7 <> 0 AND (g + n) % 7 <> 3), f AS (SELECT g, n, c FROM l ANTI JOIN u USING (g, n)) SELECT g, n, c FROM f QUALIFY count(*) OVER (PARTITION BY g) = 1""")
def isolated_leftover(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = p.filter("k % 7 = 0").groupBy("g", "n").agg(F.count("*").alias("c"))
    pairs = p.filter("k % 7 <> 0 and (g + n) % 7 <> 3").select("g", F.col("n").alias("taken"))
    return R.leftovers(rows, pairs, ["g"], "taken", "n").select("g", "n", "c")


@query(f"""WITH {SERIES}, k AS (SELECT track, i, event_type = 'purchase' AS complete, y, row_number() OVER (PARTITION BY track ORDER BY event_type = 'purchase' DESC, y DESC, i) AS k FROM series) SELECT track, i, complete, y FROM k WHERE k = 1""")
def quality_pool(spark, sf_dir):
    return R.best_frame(series(spark, sf_dir), ["track"], F.col("event_type") == "purchase", "y", "i")


@query("SELECT count(*) AS missing, count(*) = 0 AS subset FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders EXCEPT SELECT DISTINCT n_nationkey FROM nation)")
def subset_check(spark, sf_dir):
    part = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("k"))
    return R.is_subset(part, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")), ["k"])


@query(f"WITH {POINTS} SELECT g, round(median(abs(y - x)) / abs(median(y)), 6) AS nmae FROM points GROUP BY g")
def nmae(spark, sf_dir):
    return points(spark, sf_dir).groupBy("g").agg(r6(R.nmae(F.col("y") - F.col("x"), F.col("y")), "nmae"))


@query("SELECT label, CAST(k AS INTEGER) AS place, round(median(x), 6) AS x, count(x) AS frames FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, k")
def median_picture(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    return R.median_picture(pixels, ["label"], ["place"], "x").select("label", "place", r6("x"), "frames")


@query("""WITH s AS (SELECT doc_id, ['local', 'http', 'vllm', 'other'][doc_id % 4 + 1] AS backend, ['images', 'native_video', 'static_sheets', 'static_frames', 'tape'][doc_id % 5 + 1] AS mode, (doc_id % 12) / 10.0::DOUBLE AS threshold, doc_id % 70 AS frames, 640 AS edge,
    CASE WHEN doc_id % 3 = 0 THEN 3072 ELSE doc_id % 5000 END AS tokens, doc_id % 9 - 1 AS timeout, CASE WHEN doc_id % 2 = 0 THEN 'https://a' ELSE 'ftp://a' END AS url FROM labels)
SELECT doc_id, array_to_string(list_filter([CASE WHEN backend = 'other' THEN 'backend' END, CASE WHEN mode = 'tape' THEN 'input_mode' END, CASE WHEN mode = 'native_video' AND backend NOT IN ('local', 'vllm') THEN 'native_video' END,
    CASE WHEN backend = 'vllm' AND NOT (mode IN ('native_video', 'static_sheets', 'static_frames') AND frames = 24) THEN 'audited' END, CASE WHEN mode LIKE 'static%' AND NOT (backend = 'vllm' AND tokens = 3072) THEN 'static' END,
    CASE WHEN threshold > 1 THEN 'threshold' END, CASE WHEN frames NOT BETWEEN 2 AND 64 THEN 'size' END, CASE WHEN tokens NOT BETWEEN 32 AND 4096 OR timeout <= 0 THEN 'limits' END, CASE WHEN backend = 'http' AND url LIKE 'ftp%' THEN 'base_url' END], lambda x: x IS NOT NULL), ';') AS broken FROM s""")
def settings_rules(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", pick("local", "http", "vllm", "other").alias("backend"), pick("images", "native_video", "static_sheets", "static_frames", "tape").alias("input_mode"), ((k % 12) / 10).alias("threshold"), (k % 70).alias("frames"),
        F.lit(640).alias("max_edge"), F.when(k % 3 == 0, 3072).otherwise(k % 5000).alias("max_new_tokens"), (k % 9 - 1).cast("double").alias("timeout"), pick("https://a", "ftp://a").alias("base_url"), F.lit("cuda:0").alias("device"),
    )
    return rows.select("doc_id", F.array_join(R.settings_failures(rows), ";").alias("broken"))


@query("""WITH p AS (SELECT page_id, 'out/output_videos/' || ['MiniMax_H3', 'b', 'minimax_h3'][page_id % 3 + 1] || '/P' || page_id || '_seed' || page_id % 5 || '.mp4' AS path, ['MiniMax_H3', 'b', 'minimax_h3'][page_id % 3 + 1] AS model FROM pages)
SELECT page_id, CASE WHEN lower(model) = 'minimax_h3' THEN 'minimax-h3' ELSE model END AS model, model || '/videos/P' || page_id || '_seed' || page_id % 5 || '.mp4' AS video, 'first_frames/gpt/P' || page_id || '.png' AS image, (page_id % 5)::BIGINT AS number,
    'run --image first_frames/gpt/P' || page_id || '.png --seed=' || page_id % 5 AS command FROM p""")
def public_names(spark, sf_dir):
    k = F.col("page_id")
    model = F.element_at(F.array(F.lit("MiniMax_H3"), F.lit("b"), F.lit("minimax_h3")), (k % 3 + 1).cast("int"))
    name = F.concat(F.lit("P"), k.cast("string"), F.lit("_seed"), (k % 5).cast("string"))
    p = table(spark, sf_dir, "pages").select("page_id", model.alias("model"), F.concat(F.lit("out/output_videos/"), model, F.lit("/"), name, F.lit(".mp4")).alias("path"), F.concat(F.lit("/data/first_frames/gpt/P"), k.cast("string"), F.lit(".png")).alias("picture"))
    image, number = X.public_image(F.col("picture")), X.last_integer(X.stem(F.col("path")))
    words = X.command(["run", "--image", "{image}", "--seed={seed}"], image=image, seed=number)
    return p.select("page_id", X.public_model(F.col("model")).alias("model"), X.public_video(F.col("path")).alias("video"), image.alias("image"), number.alias("number"), F.array_join(words, " ").alias("command"))


@query("""WITH r AS (SELECT conv_id, CAST(turn AS BIGINT) AS frame, turn / 2.0::DOUBLE AS second, text AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT *, unnest(CASE WHEN k = 0 THEN [0, 1, 2, 3] ELSE [CAST(floor((k - 1) * 4 / greatest(1, n - 1)) AS INTEGER)] END) AS "window" FROM r)
SELECT conv_id, "window", CAST(count(*) AS INTEGER) AS frames, string_agg(printf('[%.3f s] ', second) || o, chr(10) ORDER BY frame) AS text FROM w GROUP BY conv_id, "window\"""")
def evidence_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("frame"), (F.col("turn") / 2).alias("second"), F.col("text").alias("observation"))
    return R.evidence_text(rows, ["conv_id"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"a": ' || doc_id || ', "b": true}' WHEN doc_id % 4 = 0 THEN NULL ELSE '{"a": ' || doc_id || ', "b": true} ' END AS reply FROM labels""")
def repaired_replies(spark, sf_dir):
    k = F.col("doc_id")
    good = F.concat(F.lit('{"a": '), k.cast("string"), F.lit(', "b": true}'))
    first = F.when(k % 3 == 0, good).otherwise(F.concat(F.lit('{"a": '), k.cast("string"), F.lit(', "b": true')))
    second = F.when(k % 4 == 0, F.replace(good, F.lit("true"), F.lit("false"))).otherwise(F.concat(good, F.lit(" ")))
    return table(spark, sf_dir, "labels").select("doc_id", R.repaired(first, second).alias("reply"))


PARTS = f"""{RECORDS}, parts AS (SELECT sample, unnest(['M1', 'M2', 'M3']) AS part, unnest([sample % 11 <> 0, e2 IS NOT NULL, CASE WHEN sample % 3 <> 0 THEN c > 0.1 END]) AS ok, unnest([e1, e2, c]) AS v, unnest([0.2, 0.0, 0.0]) AS ideal, unnest([0.1, 0.05, 1.0]) AS a, unnest([false, false, true]) AS r FROM records),
s AS (SELECT sample, CASE part WHEN 'M1' THEN 'M1' ELSE 'M2' END AS metric_id, ok AND v IS NOT NULL AS fine, v, CASE WHEN ok AND v IS NOT NULL THEN CASE WHEN r THEN greatest(0, least(1, v)) ELSE 1 / (1 + abs(v - ideal) / a) END END AS q FROM parts WHERE ok IS NOT NULL),
m AS (SELECT sample, metric_id, bool_and(fine) AS success, CASE WHEN count(*) = 1 THEN max(v) END AS v, CASE WHEN count(q) < count(*) THEN NULL WHEN min(q) = 0 THEN 0 ELSE exp(avg(ln(nullif(q, 0)))) END AS q FROM s GROUP BY sample, metric_id),
metrics AS (SELECT sample, metric_id, success IS NOT NULL AS defined, success, CASE WHEN success THEN v END AS value, CASE WHEN success THEN q END AS score FROM (SELECT sample, unnest(['M1', 'M2']) AS metric_id FROM records) LEFT JOIN m USING (sample, metric_id))"""


def parts(spark, sf_dir):
    k = F.col("sample")
    part = lambda n, ok, v, ideal, scale, ratio: F.struct(F.lit(n).alias("part"), ok.alias("success"), v.alias("value"), F.lit(ideal).alias("ideal"), F.lit(scale).alias("scale"), F.lit(ratio).alias("is_ratio"))
    every = F.array(
        part("M1", k % 11 != 0, F.col("e1"), 0.2, 0.1, False), part("M2", F.col("e2").isNotNull(), F.col("e2"), 0.0, 0.05, False),
        part("M3", F.when(k % 3 != 0, F.col("c") > 0.1), F.col("c"), 0.0, 1.0, True),
    )
    return records(spark, sf_dir).select("sample", F.explode(every).alias("p")).select("sample", "p.*")


@query(f"WITH {PARTS} SELECT sample, metric_id, defined, success, round(value, 6) AS value, round(score, 6) AS score FROM metrics")
def public_metrics(spark, sf_dir):
    return A.public_metrics(parts(spark, sf_dir), ["sample"]).select("sample", "metric_id", "defined", "success", r6("value"), r6("score"))


@query(f"""WITH {PARTS}, t AS (SELECT sample, coalesce(avg(CASE WHEN defined THEN coalesce(0.15 + 0.85 * score, 0) END), 0) AS total, count_if(success) AS recognised, count_if(defined) AS d FROM metrics GROUP BY sample)
SELECT sample, round(total, 6) AS total, recognised::BIGINT AS recognised, CASE WHEN d > 0 AND recognised = d THEN 'complete' WHEN recognised > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM t""")
def proxy_totals(spark, sf_dir):
    return A.proxy_totals(A.public_metrics(parts(spark, sf_dir), ["sample"]), ["sample"]).select("sample", r6("total"), "recognised", "status")


@query("SELECT o_orderkey AS sample, o_custkey % 50 AS signature, c_custkey AS track FROM orders JOIN customer ON o_custkey % 50 = c_custkey")
def cached_tracks(spark, sf_dir):
    from tarnwick.operators.records import cached

    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 50).alias("signature"))
    cache = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("signature"), F.col("c_custkey").alias("track"))
    return cached(jobs, cache, ["signature"])


@query()
def similarities(spark, sf_dir):
    def fit(c):
        x, y = c["x"], c["y"]
        found = K.similarity(x, y, 1.2 * x - 0.3 * y + 4 + (c["k"] % 9 == 0) * 50, 0.3 * x + 1.2 * y - 7, 3.0)
        return [found] if found else []

    return K.grouped(points(spark, sf_dir), ["g"], ["k", "n"], fit, "g long, scale double, degrees double, dx double, dy double, inliers int, residual double")


RESULTS = f"""{RECORDS}, r AS (SELECT sample, model, task, c, e1, e2, c >= 0.8 AS att, CASE WHEN sample % 11 = 0 THEN NOT c >= 0.8 ELSE c >= 0.8 END AS passed, sample % 17 = 0 AS failed, CASE WHEN c >= 0.8 THEN (1 / (1 + e1 / 0.1) + coalesce(1 / (1 + e2 / 0.05), 0)) / 2 END AS phys FROM records),
results AS (SELECT *, 0.15 * c + coalesce(0.85 * phys, 0) + CASE WHEN sample % 7 = 0 THEN 0.1 ELSE 0 END AS total FROM r)"""


def results(spark, sf_dir):
    """A published result in JSON per record: good ones, and some with another total, decision, count or state."""
    k, c, e1, e2 = (F.col(n) for n in ("sample", "c", "e1", "e2"))
    attempted = c >= 0.8
    only = lambda x: F.when(attempted, x)
    q1, q2 = 1 / (1 + e1 / 0.1), 1 / (1 + e2 / 0.05)
    physics = only((q1 + F.coalesce(q2, F.lit(0.0))) / 2)
    total = 0.15 * c + F.coalesce(0.85 * physics, F.lit(0.0)) + F.when(k % 7 == 0, 0.1).otherwise(0.0)
    metric = lambda n, state, raw, q: F.struct(F.lit(n).alias("id"), F.lit(True).alias("defined"), state.alias("status"), attempted.alias("measurement_attempted"), raw.alias("raw_value"), q.alias("physics_score"))
    state = lambda ok: F.when(attempted & ok, "measured").when(attempted, "unmeasurable").otherwise("not_run")
    measured = F.when(attempted, 1 + e2.isNotNull().cast("int")).otherwise(0) + (k % 13 == 0).cast("int")
    parts = {
        "schema_version": F.lit(V.VERSION), "task": F.struct(F.col("task").alias("id")), "sample": F.struct(k.cast("string").alias("id"), F.col("model"), F.lit(1).alias("seed")),
        "status": F.when(k % 17 == 0, "execution_error").when(attempted, "complete").otherwise("consistency_rejected"),
        "consistency": F.struct(F.lit("evaluated").alias("status"), c.alias("score"), F.lit(0.8).alias("threshold"), (attempted != (k % 11 == 0)).alias("passed")),
        "physics": F.struct(attempted.alias("attempted"), physics.alias("score"), F.lit("physical").alias("judgment"), F.lit(2).alias("defined_metrics"), measured.alias("measured_metrics")),
        "metrics": F.struct(metric("M1", state(F.lit(True)), only(e1), only(q1)).alias("M1"), metric("M2", state(e2.isNotNull()), only(e2), only(q2)).alias("M2")),
        "score": F.struct(total.alias("total"), (0.15 * c).alias("consistency_contribution"), (0.85 * physics).alias("physics_contribution")), "failures": F.array(), "provenance": F.struct(F.lit("v4").alias("evaluator_version")),
    }
    return records(spark, sf_dir).select("sample", F.to_json(F.struct(*[v.alias(n) for n, v in parts.items()])).alias("text"))


@query(f"""WITH {RESULTS} SELECT sample, array_to_string(list_filter([CASE WHEN passed <> att THEN 'gate_decision' END, CASE WHEN att AND NOT passed THEN 'physics_without_gate' END, CASE WHEN sample % 13 = 0 THEN 'measured_count' END, CASE WHEN failed THEN 'error_total' END, CASE WHEN failed THEN 'error_physics' END,
    CASE WHEN failed THEN 'error_shares' END, CASE WHEN failed AND att THEN 'error_metrics' END, CASE WHEN NOT failed AND total > 1 THEN 'total_range' END, CASE WHEN NOT failed AND sample % 7 = 0 THEN 'total_equation' END], lambda x: x IS NOT NULL), ';') AS broken FROM results""")
def result_rules(spark, sf_dir):
    return V.checked(results(spark, sf_dir), "text").select("sample", F.array_join("broken", ";").alias("broken"))


@query(f"""WITH {RESULTS} SELECT task, model, CAST(sample AS VARCHAR) AS sample, CASE WHEN sample % 5 > 0 THEN round(total, 6) END AS total, CASE WHEN sample % 5 = 0 THEN CASE WHEN att THEN 'execution_error' ELSE 'consistency_error' END WHEN failed THEN 'execution_error' WHEN att THEN 'complete' ELSE 'consistency_rejected' END AS status,
    CASE WHEN sample % 5 > 0 OR att THEN c END AS c, CASE WHEN sample % 5 > 0 OR att THEN passed END AS passed, CASE WHEN sample % 5 > 0 THEN round(phys, 6) END AS physics, att AS attempted FROM results""")
def results_after_errors(spark, sf_dir):
    read = V.checked(results(spark, sf_dir), "text")
    lost = read.withColumn("result", V.after_error(F.col("result"), F.when(F.col("sample") % 5 == 0, "lost")))
    return V.short_form(lost).select("task", "model", "sample", r6("total"), "status", "c", "passed", r6("physics"), "attempted")
