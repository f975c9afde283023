"""Score maps, gate and metrics over records, judgments and fit points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import geometry as G
from tarnwick.functions import scores as C
from tarnwick.operators import gate, metrics
from tarnwick.plans.registry import query, r6
from tarnwick.plans.views import JUDGMENTS, POINTS, RECORDS, SCORED, judgments, points, records, scored_records, table


@query(f"WITH {RECORDS} SELECT sample, round(1 / (1 + abs(e1) / 0.1), 6) AS q1, round(1 / (1 + abs(e2 - 0.5) / 0.05), 6) AS q2 FROM records")
def residual_score(spark, sf_dir):
    return records(spark, sf_dir).select("sample", r6(C.residual_score(F.col("e1"), 0.1), "q1"), r6(C.residual_score(F.col("e2") - 0.5, 0.05), "q2"))


@query(f"WITH {RECORDS} SELECT sample, round(0.2 / (0.2 + e2), 6) AS half, round(greatest(0, least(1, 1 - e2 / 0.6)), 6) AS linear FROM records WHERE e2 IS NOT NULL UNION ALL SELECT sample, NULL, NULL FROM records WHERE e2 IS NULL")
def half_score(spark, sf_dir):
    return records(spark, sf_dir).select("sample", r6(C.half_score(F.col("e2"), 0.2), "half"), r6(C.error_score(F.col("e2"), 0.6), "linear"))


@query(f"WITH {RECORDS}, r AS (SELECT *, CASE WHEN sample % 17 = 0 THEN 0 ELSE e1 END AS d FROM records) SELECT sample, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN e2 IS NULL THEN NULL ELSE round(greatest(0, least(1, (1 - e2 / d) / 0.2)), 6) END AS score FROM r")
def saturated_ratio(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("d", F.when(F.col("sample") % 17 == 0, F.lit(0.0)).otherwise(F.col("e1")))
    return r.select("sample", r6(C.saturated_ratio(F.col("e2"), F.col("d"), 0.2), "score"))


@query(f"WITH {RECORDS} SELECT sample, CAST(e2 - 0.5 > 0 AS DOUBLE) AS rises, CAST(-(e2 - 0.5) > 0 AS DOUBLE) AS falls FROM records")
def direction_score(spark, sf_dir):
    v = F.col("e2") - 0.5
    return records(spark, sf_dir).select("sample", C.direction_score(v).alias("rises"), C.direction_score(v, -1).alias("falls"))


@query(f"WITH {RECORDS} SELECT sample, CASE WHEN owner % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(sample % 7 < owner % 5 AS DOUBLE) END AS score, round((1 - cos(radians(e1 * 360))) / 2, 6) AS turned FROM records")
def count_and_angle(spark, sf_dir):
    return records(spark, sf_dir).select("sample", C.count_direction(F.col("sample") % 7, F.col("owner") % 5).alias("score"), r6(C.angle_score(F.col("e1") * 360), "turned"))


@query(f"""WITH {RECORDS} SELECT sample, round(greatest(0.01, 1 / (1 + e1 / 0.2)), 6) AS floored, round(greatest(0.01, 1 / (1 + greatest(0, 0.7 - e1) / 0.3)), 6) AS high, round(100 * greatest(0, least(1, (0.9 - e1) / (0.9 - 0.1))), 6) AS piecewise,
CASE WHEN e2 IS NULL THEN 0.0::DOUBLE ELSE round(0.15 + 0.85 * (1 / (1 + e2 / 0.1)), 6) END AS recognised, CASE WHEN e2 IS NOT NULL THEN round(0.7 * least(c, e1, e2) + 0.3 * (c + e1 + e2) / 3, 6) END AS worst, round(0.5 * CAST(sample % 2 = 0 AS DOUBLE) + 0.5 * coalesce(CAST(e2 > 0.5 AS DOUBLE), 0), 6) AS halves FROM records""")
def legacy_scores(spark, sf_dir):
    e1, e2 = F.col("e1"), F.col("e2")
    return records(spark, sf_dir).select(
        "sample", r6(C.floored_quality(e1, 0.2), "floored"), r6(C.high_quality(e1, 0.7, 0.3), "high"), r6(C.piecewise_score(e1, 0.1, 0.9), "piecewise"), r6(C.recognised(C.residual_score(e2, 0.1)), "recognised"),
        r6(C.worst_and_mean([F.col("c"), e1, e2]), "worst"), r6(C.two_halves(F.col("sample") % 2 == 0, e2 > 0.5), "halves"),
    )


@query(f"""WITH {RECORDS}, q AS (SELECT owner, CASE WHEN owner % 10 = 0 AND sample % 5 = 0 THEN NULL WHEN owner % 10 = 1 AND sample % 3 = 0 THEN 0 ELSE 1 / (1 + e1 / 0.3) END AS q FROM records)
SELECT owner, CASE WHEN count(q) < count(*) THEN NULL WHEN min(q) = 0 THEN 0 ELSE round(exp(avg(ln(nullif(q, 0)))), 6) END AS gm FROM q GROUP BY owner""")
def strict_gm(spark, sf_dir):
    k, s = F.col("owner") % 10, F.col("sample")
    q = F.when((k == 0) & (s % 5 == 0), F.lit(None)).when((k == 1) & (s % 3 == 0), F.lit(0.0)).otherwise(C.residual_score(F.col("e1"), 0.3))
    return records(spark, sf_dir).withColumn("q", q).groupBy("owner").agg(r6(C.strict_gm(F.col("q")), "gm"))


@query(f"WITH {POINTS}, v AS (SELECT g, greatest(0.01, least(coalesce(tax * 15, 0), 1)) AS x, CASE WHEN w > 1 THEN w END AS w FROM points) SELECT g, round(exp(sum(w * ln(x)) / sum(w)), 6) AS gm FROM v GROUP BY g")
def weighted_gm_floor(spark, sf_dir):
    return points(spark, sf_dir).groupBy("g").agg(r6(C.weighted_gm(F.col("tax") * 15, F.col("w") - F.when(F.col("w") > 1, F.lit(0.0)).otherwise(F.col("w"))), "gm"))


@query(f"WITH {RECORDS}, m AS (SELECT sample, unnest([1 / (1 + e1 / 0.1), 1 / (1 + e2 / 0.05)]) AS q, unnest([true, sample % 3 <> 0]) AS d FROM records) SELECT sample, round(sum(CASE WHEN d THEN coalesce(q, 0) END) / sum(CASE WHEN d THEN 1 ELSE 0 END), 6) AS physics, CAST(sum(CASE WHEN d THEN 1 ELSE 0 END) AS BIGINT) AS defined_metrics FROM m GROUP BY sample")
def defined_metric_mean(spark, sf_dir):
    two = F.array(F.struct(C.residual_score(F.col("e1"), 0.1).alias("q"), F.lit(True).alias("d")), F.struct(C.residual_score(F.col("e2"), 0.05).alias("q"), (F.col("sample") % 3 != 0).alias("d")))
    rows = records(spark, sf_dir).select("sample", F.explode(two).alias("m")).select("sample", "m.*")
    return rows.groupBy("sample").agg(r6(C.defined_mean(F.col("q"), F.col("d")), "physics"), F.sum(F.col("d").cast("int")).alias("defined_metrics"))


@query(f"WITH {SCORED} SELECT sample, passed, round(total, 6) AS total FROM totals")
def composite_total(spark, sf_dir):
    return scored_records(spark, sf_dir).select("sample", "passed", r6("total"))


@query(f"""WITH {JUDGMENTS}, p AS (SELECT *, [0.0, 0.05, 0.15, 0.30, 0.50]::DOUBLE[] AS pen, [1.0, 0.85, 0.65, 0.40, 0.15]::DOUBLE[] AS ceil FROM judgments),
s AS (SELECT *, round(greatest(0, 1 - (pen[identity + 1] + pen[flicker + 1] + pen[scene + 1] + pen[clarity + 1])), 6) AS v, least(ceil[subject + 1], ceil[event + 1], ceil["order" + 1]) AS c,
    identity >= 3 OR flicker >= 3 OR scene >= 3 OR clarity >= 4 OR subject >= 3 OR event >= 3 OR "order" >= 3 OR multiple_balls OR background_flicker OR (poor_quality AND clarity >= 3) AS forced FROM p)
SELECT doc_id, round(CASE WHEN forced THEN least(v, c, 0.49) ELSE least(v, c) END, 6) AS score, forced, (CASE WHEN forced THEN least(v, c, 0.49) ELSE least(v, c) END) >= 0.8 AND NOT forced AS passed FROM s""")
def gate_score(spark, sf_dir):
    j = judgments(spark, sf_dir)
    cols = lambda *names: {n: F.col(n) for n in names}
    flags = {"multiple_balls": F.col("multiple_balls"), "background_flicker": F.col("background_flicker"), "poor_quality": F.col("poor_quality") & (F.col("clarity") >= 3)}
    score, reasons = gate.gate_score(cols("identity", "flicker", "scene", "clarity"), cols("subject", "event", "order"), flags)
    return j.select("doc_id", score.alias("score"), reasons.alias("reasons")).select("doc_id", r6("score"), (F.size("reasons") > 0).alias("forced"), gate.passes(F.col("score"), F.col("reasons")).alias("passed"))


#: Quantities that are flags or have a value of their own in the synthetic measurements below.
FLAGS = ("single_motion", "both_stationary", "ascent_only", "ice_remains", "straight", "entered", "lit", "lead", "configuration")


def measurements(spark, sf_dir):
    """A measurement for each record: its task's quantities are values between 0 and 60 that the sample's number decides; each eleventh is missing."""
    place = {n: j for j, n in enumerate(metrics.QUANTITIES)}
    k = F.col("sample")
    own = [x for task, formula in metrics.FORMULAS.items() for x in (F.lit(task), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(place[n]).alias("j"), F.lit(n in FLAGS).alias("flag")) for n in metrics.needs(formula)]))]

    def value(q):
        v = k * (q["j"] + 3) + q["j"] * 7
        return F.when((k + q["j"]) % 11 != 0, F.when(q["flag"], (v % 2).cast("double")).otherwise((v % 599 + 1) / 10))

    r = records(spark, sf_dir).select("sample", "task", F.try_element_at(F.create_map(*own), F.col("task")).alias("own"))
    return r.select("sample", "task", F.map_from_arrays(F.transform("own", lambda q: q["n"]), F.transform("own", value)).alias("quantities"))


def _metrics_sql() -> str:
    """The forty metrics written out in SQL over one column for each quantity."""
    cols = []
    for j, n in enumerate(metrics.QUANTITIES):
        value = f"((sample * {j + 3} + {j * 7}) % 2)::DOUBLE" if n in FLAGS else f"((sample * {j + 3} + {j * 7}) % 599 + 1) / 10.0::DOUBLE"
        cols.append(f"CASE WHEN (sample + {j}) % 11 <> 0 THEN {value} END AS {n}")
    q = lambda e, a: f"(1 / (1 + abs({e}) / {a}::DOUBLE))"
    gm = lambda *v: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in v)} THEN NULL WHEN {' OR '.join(f'({x}) = 0' for x in v)} THEN 0 ELSE pow({' * '.join(f'({x})' for x in v)}, 1.0::DOUBLE / {len(v)}) END"
    one = lambda c: f"CAST(({c}) AS DOUBLE)"
    clip = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN greatest(0, least(1, {e})) END"
    fix = lambda flag, s, e: f"CASE WHEN coalesce({flag}, 0) = 1 THEN {s} ELSE {e} END"
    t13, water = repr(G.PERIOD_RATIO_30_15), repr(G.WATER_INDEX)
    m = {
        "P1": (fix("single_motion", 0.1, gm(q("height_time", 0.18), q("passive_excess", 0.15))), fix("single_motion", 0.1, f"CASE WHEN cor_cv IS NULL THEN {q('height_rise', 0.15)} ELSE {gm(q('height_rise', 0.15), q('cor_cv', 0.35))} END")),
        "P2": (q("cv_dv", 0.1), q("thirds_rms", 0.1)), "P3": (q("r30 / r60 - 1", 0.15), gm(q("rmse30", 0.3), q("rmse60", 0.3), q("speed_error", 0.2))),
        "P4": (q('coalesce(height / "range", height / (2 * apex_x)) - 0.25', 0.1), gm(q("cv_vx", 0.1), q("cv_dvy", 0.1), q("rms_over_range", 0.05))), "P5": (q("(v1_after + v2_after) / v1 - 1", 0.1), None),
        "P6": (fix("both_stationary", 0.7, q("(onset_left - onset_right) / frames", 1)), fix("both_stationary", 0.7, q("angle_gap", 90))), "P7": (q("rmse / sag", 0.1), q("support_dy / span", 0.02)),
        "P8": (q("way / (radius * turned) - 1", 0.25), q("slip", 0.35)), "P9": (q("time_ratio / sqrt(10.0::DOUBLE / 7) - 1", 0.1), None),
        "P10": (f"CASE WHEN rotation >= 5 THEN {q('greatest("pivot", contact, shape)', 0.02)} WHEN rotation IS NOT NULL THEN 0 END", None),
        "P11": (fix("ascent_only", 0.1, q("(a_up / a_down) / ((sin(radians(angle)) + 0.2 * cos(radians(angle))) / nullif(sin(radians(angle)) - 0.2 * cos(radians(angle)), 0)) - 1", 0.1)), None),
        "P12": (q("t_heavy / t_light - 1", 0.1), q("abs(l_left - l_right) / ((l_left + l_right) / 2)", 0.1)), "P13": (q(f"t30 / t15 - {t13}", 0.05), clip(f"(t30 / t15 - 1) / ({t13} - 1)")),
        "P14": (q("(t_short / t_long) ** 2 / (l_short / l_long) - 1", 0.2), gm(q("cv_short", 0.2), q("cv_long", 0.2))), "P15": (q("t_left / t_right - 1", 0.1), gm(q("sine_left", 0.1), q("sine_right", 0.1))),
        "P16": (q("cv", 0.1), q("collinearity", 0.05)), "P17": (q(f"sin(radians(incident)) / sin(radians(refracted)) - {water}", 0.12), q("dx / width", 0.025)), "P18": (q("incident - reflected", 90), q("contact_error / diagonal", 1)),
        "P19": (q("line_rms / diagonal", 0.05), q("mean_sd / diagonal", 0.05)), "P20": (f"CASE WHEN estimates >= 2 THEN {q('index_cv', 0.05)} END", None), "P21": (q("(level_left - level_right) / height", 1), q("slope / height", 1)),
        "P22": (q("submerged - 0.917", 0.1), q("dy / width", 0.05)), "P23": (q("angle - 90", 5), gm(q("surface_rms", 3), q("path_rms", 8))), "P24": (q("h_ice / h_water - 1000 / 917.0::DOUBLE", 1), q("abs(w_end - w_start) / w_start", 1)),
        "P25": (q("d_level / height", 0.05), q("d_width / width", 0.05)), "P26": (f"CASE WHEN abs(change) > uncertainty THEN {one('change < 0')} END", None),
        "P27": (one("rise > uncertainty"), f"CASE WHEN coalesce(ice_remains, 0) = 1 THEN 0 ELSE {clip('1 - residual')} END"), "P28": ("lead", None), "P29": (one("t_metal / t_plain > 1"), one("v_metal / v_plain < 1")),
        "P30": ("CASE WHEN entered IS NOT NULL THEN 0.5 * entered + 0.5 * coalesce(lit, 0) END", None), "P31": (q("angle_gap", 90) + " * configuration", q("ln(d_left / d_right)", 1) + " * configuration"), "P32": ("(1 - cos(radians(direction))) / 2", None),
        "P33": (f"CASE WHEN h_closed = 0 THEN 0 ELSE {clip('(1 - h_open / h_closed) / 0.2')} END", None), "P34": (f"CASE WHEN n_slotted = 0 THEN 0 ELSE {one('n_solid < n_slotted')} END", None), "P35": (q("angle_small / angle_large - 1", 1), q("asymmetry", 90)),
        "P36": (q("abs(beta_water - 0.5) + abs(beta_sand)", 1), None), "P37": (one("rise > greatest(1, mad, rms)"), None),
        "P38": (f"CASE WHEN greatest(r1 / r2, 1 / (r1 / r2)) >= 1.1 THEN {q('(v1 / v2) / (r1 / r2) ** 2 - 1', 1)} END", None), "P39": (fix("straight", 0, q("radius_error", 1)), None), "P40": (q("r_final ** 3 / (r1 ** 3 + r2 ** 3) - 1", 0.1), q("roundness_change", 0.1)),
    }
    for t, (a, b) in list(m.items()):
        m[t] = (a.replace("range", "range"), b)
    case = lambda k: "CASE task " + " ".join(f"WHEN '{t}' THEN ({v[k]})::DOUBLE" for t, v in m.items() if v[k]) + " END"
    columns = ", ".join(c.replace(" AS range", ' AS "range"').replace(" AS lead", ' AS "lead"').replace(" AS pivot", ' AS "pivot"') for c in cols)
    text = f"WITH {RECORDS}, m AS (SELECT sample, task, {columns} FROM records) SELECT sample, task, round({case(0)}, 6) AS m1, round({case(1)}, 6) AS m2, task IN ({', '.join(repr(t) for t, v in m.items() if v[1])}) AS has_m2 FROM m"
    return text.replace("THEN (lead)", 'THEN ("lead")')


@query(_metrics_sql())
def forty_metrics(spark, sf_dir):
    return metrics.scored(measurements(spark, sf_dir)).select("sample", "task", r6("m1"), r6("m2"), "has_m2")


@query(f"""SELECT sample, task, metric_id, defined, CASE WHEN NOT defined THEN 'not_applicable' WHEN score IS NULL THEN 'unmeasurable' ELSE 'measured' END AS status, score AS physics_score
FROM (SELECT sample, task, 'M1' AS metric_id, true AS defined, m1 AS score FROM ({_metrics_sql()}) UNION ALL SELECT sample, task, 'M2', has_m2, m2 FROM ({_metrics_sql()}))""")
def metric_rows(spark, sf_dir):
    return metrics.metric_rows(measurements(spark, sf_dir)).select("sample", "task", "metric_id", "defined", "status", r6("physics_score"))


@query(f"""WITH {POINTS}, p AS (SELECT k, n, x - 25 AS ax, y - 30 AS ay, w - 5 AS bx, tax * 100 - 4 AS "by" FROM points), c AS (SELECT *, (ax * bx + ay * "by") / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + "by" * "by"), 0) AS c FROM p),
a AS (SELECT *, degrees(acos(greatest(-1, least(1, c)))) AS a FROM c WHERE c IS NOT NULL UNION ALL SELECT *, NULL FROM c WHERE c IS NULL)
SELECT k, n, round(a, 4) AS angle, round(CASE WHEN a IS NOT NULL THEN least(a, 180 - a) END, 4) AS line_angle, round(sqrt((bx - ax) ** 2 + ("by" - ay) ** 2), 6) AS apart FROM a""")
def angles_and_distances(spark, sf_dir):
    p = points(spark, sf_dir).select("k", "n", (F.col("x") - 25).alias("ax"), (F.col("y") - 30).alias("ay"), (F.col("w") - 5).alias("bx"), (F.col("tax") * 100 - 4).alias("by"))
    v = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return p.select("k", "n", F.round(G.vector_angle(*v), 4).alias("angle"), F.round(G.line_angle(*v), 4).alias("line_angle"), r6(G.distance(*v), "apart"))


@query("""WITH q AS (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) // 4 - 1)) AS quad FROM embeddings), s AS (SELECT vec_id, quad, list_sort(list_transform(embedding[4 * quad + 1 : 4 * quad + 4], lambda x: round(x, 3)::DOUBLE)) AS s FROM q)
SELECT vec_id, CAST(quad AS INTEGER) AS quad, round((a - c) * (b - d) / nullif((b - c) * (a - d), 0), 4) AS ratio FROM (SELECT vec_id, quad, s[1] AS a, s[2] + 0.1 AS b, s[3] + 0.2 AS c, s[4] + 0.3 AS d FROM s)""")
def cross_ratio(spark, sf_dir):
    """Of every four places in a row of a vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), (F.floor(F.size("embedding") / 4) - 1).cast("int"))).alias("quad"))
    s = F.array_sort(F.transform(F.slice("embedding", 4 * F.col("quad") + 1, F.lit(4)), lambda x: F.round(x, 3).cast("double")))
    at = [F.element_at(F.col("s"), k + 1) + 0.1 * k for k in range(4)]
    return e.select("vec_id", "quad", s.alias("s")).select("vec_id", "quad", F.round(G.cross_ratio(*at), 4).alias("ratio"))
