"""Time-series operators over the tracks of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import kernels as K
from tarnwick.operators import series as S
from tarnwick.plans.registry import query, r6, rounded
from tarnwick.plans.views import SERIES, series

DAY = 86_400.0


@query(f"""WITH {SERIES}, v AS (SELECT *, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS v FROM series WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT track, i, round(v, 6) AS v, round((v - lag(v) OVER w) / (t - lag(t) OVER w), 6) AS a FROM v WINDOW w AS (PARTITION BY track ORDER BY i)""")
def diff_velocity(spark, sf_dir):
    return series(spark, sf_dir).transform(S.velocity).select("track", "i", r6("v"), r6("a"))


@query(f"""WITH {SERIES} SELECT track, i, round(sum(y) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM series""")
def moving_avg_same(spark, sf_dir):
    return series(spark, sf_dir).transform(S.moving_average_same).select("track", "i", r6("smooth"))


@query(f"""WITH {SERIES}, n AS (SELECT track, max(i) AS n FROM series GROUP BY track), k AS (SELECT unnest(range(-2, 3)) AS k)
SELECT a.track, a.i, round(avg(b.y), 6) AS smooth FROM series a JOIN n USING (track) CROSS JOIN k JOIN series b ON b.track = a.track AND b.i = least(n.n, greatest(1, a.i + k.k)) GROUP BY a.track, a.i""")
def moving_avg_padded(spark, sf_dir):
    return series(spark, sf_dir).transform(S.moving_average_padded).select("track", "i", r6("smooth"))


@query(f"""WITH {SERIES} SELECT track, i, round(median(y) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS med FROM series""")
def rolling_median_rows(spark, sf_dir):
    return series(spark, sf_dir).transform(S.rolling_median_rows).select("track", "i", r6("med"))


@query(f"""WITH {SERIES} SELECT a.track, a.i, round(median(b.y) FILTER (b.valid), 6) AS med FROM series a JOIN series b ON a.track = b.track AND abs(a.t - b.t) <= {DAY / 2} + 1e-9 GROUP BY a.track, a.i""")
def rolling_median_time(spark, sf_dir):
    return series(spark, sf_dir).transform(S.rolling_median_time, DAY).select("track", "i", r6("med"))


RUNS = f"""WITH {SERIES}, marked AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) - row_number() OVER (PARTITION BY track, valid ORDER BY i) AS grp FROM series),
runs AS (SELECT track, min(i) AS start, max(i) AS stop, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM marked WHERE valid GROUP BY track, grp)"""


@query(RUNS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, start) AS k FROM runs) SELECT track, start, CAST(stop + 1 AS BIGINT) AS stop FROM ranked WHERE k = 1")
def longest_finite_run(spark, sf_dir):
    return S.longest_run(series(spark, sf_dir), F.col("valid"))


@query(RUNS + f" SELECT track, start, stop AS \"end\", n, round(t1 - t0, 6) AS seconds FROM runs WHERE t1 - t0 >= {3 * DAY} - 1e-9")
def sustained_intervals(spark, sf_dir):
    return S.sustained(series(spark, sf_dir), F.col("valid"), 3 * DAY).select("track", "start", "end", "n", r6(F.col("t1") - F.col("t0"), "seconds"))


@query(f"""WITH {SERIES}, b AS (SELECT *, CASE WHEN valid THEN y END AS yo, CASE WHEN valid THEN i END AS io FROM series),
f AS (SELECT *, last_value(yo IGNORE NULLS) OVER p AS y0, last_value(io IGNORE NULLS) OVER p AS i0, first_value(yo IGNORE NULLS) OVER n AS y1, first_value(io IGNORE NULLS) OVER n AS i1 FROM b
    WINDOW p AS (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, i, round(CASE WHEN valid THEN y WHEN y0 IS NOT NULL AND y1 IS NOT NULL AND i1 - i0 - 1 <= 2 THEN y0 + (y1 - y0) * ((i - i0)::DOUBLE / (i1 - i0)) END, 6) AS filled FROM f""")
def gap_interpolate(spark, sf_dir):
    return series(spark, sf_dir).transform(S.fill_gaps, 2).select("track", "i", r6("filled"))


@query(f"""WITH {SERIES} SELECT track, i, round(coalesce(last_value(CASE WHEN valid THEN y END IGNORE NULLS) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    min(CASE WHEN valid THEN y END) OVER (PARTITION BY track)), 6) AS filled FROM series""")
def forward_fill(spark, sf_dir):
    return series(spark, sf_dir).transform(S.forward_fill).select("track", "i", r6("filled"))


CROSSED = f"""WITH {SERIES}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY track) AS c FROM series WHERE valid),
n AS (SELECT *, lead(c) OVER (PARTITION BY track ORDER BY i) AS cn, lead(t) OVER (PARTITION BY track ORDER BY i) AS tn FROM c),
crossed AS (SELECT track, i, sign(c) AS side, CASE WHEN c = 0 THEN t ELSE t + (tn - t) * c / (c - cn) END AS tc FROM n WHERE cn IS NOT NULL AND (c = 0 OR c * cn < 0))"""


@query(CROSSED + " SELECT track, i, round(tc, 3) AS tc FROM crossed")
def zero_crossings(spark, sf_dir):
    return S.crossings(series(spark, sf_dir)).select("track", "i", rounded(F.col("tc"), 3).alias("tc"))


@query(CROSSED + ", g AS (SELECT track, 2 * (tc - lag(tc) OVER (PARTITION BY track ORDER BY tc)) AS g FROM crossed) SELECT track, count(*) AS n_crossings, CASE WHEN count(*) >= 3 THEN round(median(g), 3) END AS period FROM g GROUP BY track")
def period_from_crossings(spark, sf_dir):
    return S.crossing_period(series(spark, sf_dir)).select("track", "n_crossings", rounded(F.col("period"), 3).alias("period"))


@query(CROSSED + ", g AS (SELECT track, tc - lag(tc) OVER (PARTITION BY track, side ORDER BY tc) AS g FROM crossed) SELECT track, count(g) AS n_cycles, round(median(g), 3) AS period FROM g GROUP BY track")
def full_cycle_period(spark, sf_dir):
    return S.full_cycles(series(spark, sf_dir)).select("track", "n_cycles", rounded(F.col("period"), 3).alias("period"))


@query(f"""WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM series), h AS (SELECT *, greatest(3, least(8, n // 8)) AS head FROM n),
b AS (SELECT track, median(y) AS base FROM h WHERE i <= head GROUP BY track),
m AS (SELECT h.track, 1.4826 * median(abs(y - base)) AS noise FROM h JOIN b USING (track) WHERE i <= head GROUP BY h.track),
o AS (SELECT h.*, CASE WHEN abs(y - base) > greatest(0.01 * 640, 5 * noise, 3.0) THEN 1 ELSE 0 END AS off FROM h JOIN b USING (track) JOIN m USING (track)),
k AS (SELECT *, off + lead(off) OVER w + lead(off, 2) OVER w AS k FROM o WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT track, min(CASE WHEN i > head AND k = 3 THEN i END) AS onset FROM k GROUP BY track""")
def onset_3(spark, sf_dir):
    return S.onset(series(spark, sf_dir), 640)


@query(f"""WITH {SERIES}, d AS (SELECT track, i - 1 AS p, count(*) OVER (PARTITION BY track) AS n, abs(lead(y) OVER (PARTITION BY track ORDER BY i) - y) AS d FROM series),
s AS (SELECT *, CASE WHEN n - 1 >= 5 THEN sum(d) OVER (PARTITION BY track ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE d END AS s FROM d WHERE p < n - 1),
l AS (SELECT track, max(n) AS n, min(p) FILTER (s > 0.15 * m AND n >= 4) AS a, max(p) FILTER (s > 0.15 * m AND n >= 4) AS b FROM (SELECT *, max(s) OVER (PARTITION BY track) AS m FROM s) GROUP BY track)
SELECT track, CAST(coalesce(a, 0) AS INTEGER) AS start, CAST(coalesce(least(n, b + 2), n) AS INTEGER) AS stop FROM l""")
def moving_phase(spark, sf_dir):
    return S.moving_phase(series(spark, sf_dir))


@query(f"""WITH {SERIES}, d AS (SELECT track, i - 1 AS p, count(*) OVER (PARTITION BY track) AS n, coalesce(abs(y - lag(y) OVER (PARTITION BY track ORDER BY i)), 0) AS d FROM series),
k AS (SELECT unnest(range(-2, 3)) AS k),
m AS (SELECT a.track, a.p, max(a.n) AS n, median(coalesce(b.d, 0)) AS m FROM d a CROSS JOIN k LEFT JOIN d b ON b.track = a.track AND b.p = a.p + k.k GROUP BY a.track, a.p),
s AS (SELECT *, sum(CASE WHEN m > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM m)
SELECT track, CAST(greatest(0, min(p) FILTER (s >= 3) - 2) AS INTEGER) AS start, CAST(least(max(n) - 1, max(p) FILTER (s >= 3) + 2) AS INTEGER) AS "end" FROM s GROUP BY track HAVING min(p) FILTER (s >= 3) IS NOT NULL""")
def motion_interval(spark, sf_dir):
    return S.motion_interval(series(spark, sf_dir), 150)


@query(f"""WITH {SERIES}, m AS (SELECT *, max(y) OVER (PARTITION BY track ORDER BY i) AS m FROM series), l AS (SELECT *, lag(m) OVER w AS m0, lag(t) OVER w AS t0 FROM m WINDOW w AS (PARTITION BY track ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) AS k FROM l WHERE m >= 400)
SELECT s.track, round(CASE WHEN f.m0 IS NULL THEN f.t ELSE f.t0 + CASE WHEN f.m > f.m0 THEN greatest(0, least(1, (400 - f.m0) / (f.m - f.m0))) ELSE 0 END * (f.t - f.t0) END, 3) AS reached
FROM (SELECT DISTINCT track FROM series) s LEFT JOIN f ON f.track = s.track AND f.k = 1""")
def level_crossing_time(spark, sf_dir):
    return S.level_time(series(spark, sf_dir), F.lit(400.0)).select("track", rounded(F.col("at"), 3).alias("reached"))


@query(f"""WITH {SERIES}, m AS (SELECT *, max(y) OVER (PARTITION BY track ORDER BY i) AS m FROM series), l AS (SELECT *, lag(m) OVER w AS m0, lag(t) OVER w AS t0 FROM m WINDOW w AS (PARTITION BY track ORDER BY i)),
g AS (SELECT l.*, v.level FROM l CROSS JOIN (VALUES (100.0::DOUBLE), (250.0::DOUBLE), (400.0::DOUBLE), (480.0::DOUBLE)) AS v(level)), f AS (SELECT *, row_number() OVER (PARTITION BY track, level ORDER BY i) AS k FROM g WHERE m >= level)
SELECT track, level, round(CASE WHEN m0 IS NULL THEN t ELSE t0 + CASE WHEN m > m0 THEN greatest(0, least(1, (level - m0) / (m - m0))) ELSE 0 END * (t - t0) END, 3) AS reached FROM f WHERE k = 1""")
def virtual_gates(spark, sf_dir):
    return S.gates(series(spark, sf_dir), [100, 250, 400, 480]).filter("at is not null").select("track", "level", rounded(F.col("at"), 3).alias("reached"))


@query(f"""WITH {SERIES}, d AS (SELECT track, i, y, coalesce(((y - lag(y) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS d FROM series WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT track, i, round(first_value(y) OVER w + sum(d) OVER w, 6) AS turned FROM d WINDOW w AS (PARTITION BY track ORDER BY i)""")
def angle_unwrap(spark, sf_dir):
    return series(spark, sf_dir).transform(S.unwrapped).select("track", "i", r6("turned"))


@query(f"""WITH {SERIES}, d AS (SELECT track, i, sqrt((i / 100.0::DOUBLE - (lag(i) OVER w) / 100.0::DOUBLE) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM series WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT track, i, round(sum(coalesce(d, 0)) OVER (PARTITION BY track ORDER BY i), 6) AS length FROM d""")
def path_length(spark, sf_dir):
    return series(spark, sf_dir).withColumn("x", F.col("i") / 100).transform(S.path_length).select("track", "i", r6("length"))


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i DESC) AS k FROM series WHERE valid)
SELECT track, count(*) AS n, round(median(y), 6) AS level, round(max(y) - min(y), 6) AS spread, count(*) = 8 AND max(y) - min(y) <= 400 AS stable FROM k WHERE k <= 8 GROUP BY track""")
def stable_tail(spark, sf_dir):
    return S.tail(series(spark, sf_dir), 8, 400).select("track", "n", r6("level"), r6("spread"), "stable")


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) AS k, count(*) OVER (PARTITION BY track) AS n FROM series WHERE valid), s AS (SELECT *, greatest(5, least(12, n // 8)) AS s FROM k)
SELECT track, round(median(y) FILTER (k <= s), 6) AS head, round(median(y) FILTER (k > n - s), 6) AS tail, round(median(y) FILTER (k > n - s) - median(y) FILTER (k <= s), 6) AS change FROM s GROUP BY track""")
def head_tail_change(spark, sf_dir):
    return S.head_tail(series(spark, sf_dir)).select("track", r6("head"), r6("tail"), r6("change"))


@query(f"""WITH {SERIES}, p AS (SELECT a.track, a.i, CASE WHEN a.valid AND b.valid THEN a.y - b.y END AS d FROM series a JOIN series b ON b.track = a.track + 1 AND b.i = a.i WHERE a.track % 2 = 0),
u AS (SELECT track, i, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM p WHERE d > 20), un AS (SELECT track, max(n) AS n FROM (SELECT track, count(*) AS n FROM u GROUP BY track, g) GROUP BY track),
j AS (SELECT track, i, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM p WHERE d IS NOT NULL), jn AS (SELECT track, max(n) AS n FROM (SELECT track, count(*) AS n FROM j GROUP BY track, g) GROUP BY track)
SELECT t.track, coalesce(un.n, 0) AS longest_lead, coalesce(jn.n, 0) AS longest_joint, CASE WHEN un.n >= 5 THEN 1 WHEN jn.n >= 8 THEN 0 END AS lead FROM (SELECT DISTINCT track FROM p) t LEFT JOIN un USING (track) LEFT JOIN jn USING (track)""")
def sustained_lead(spark, sf_dir):
    s = series(spark, sf_dir)
    a, b = s.filter("track % 2 = 0"), s.select((F.col("track") - 1).alias("track"), "i", F.col("y").alias("yb"), F.col("valid").alias("vb"))
    pairs = a.join(b, ["track", "i"]).withColumn("d", F.when(F.col("valid") & F.col("vb"), F.col("y") - F.col("yb")))
    return S.sustained_lead(pairs, F.lit(20.0), 5, 8)


@query(f"""WITH {SERIES}, d AS (SELECT track, i, t, sum(y) OVER (PARTITION BY track ORDER BY i) AS d FROM series), a AS (SELECT track, min(CASE WHEN d >= 4000 THEN i END) AS arrival FROM d GROUP BY track)
SELECT d.track, max(a.arrival) AS arrival, CASE WHEN count(*) FILTER (i <= arrival AND d >= 800) >= 3 THEN round(regr_slope(d, t) FILTER (i <= arrival AND d >= 800), 9) END AS speed FROM d JOIN a USING (track) GROUP BY d.track""")
def arrival_speed(spark, sf_dir):
    return S.arrival(S.way(series(spark, sf_dir).filter("track is not null")), 4000).select("track", "arrival", F.round("speed", 9).alias("speed"))


@query(f"""WITH {SERIES} SELECT track, i, round(y / lag(y) OVER w, 6) AS ratio, round(sqrt(y / lag(y) OVER w), 6) AS root FROM series WINDOW w AS (PARTITION BY track ORDER BY i)""")
def successive_ratio(spark, sf_dir):
    return series(spark, sf_dir).transform(S.successive_ratios).select("track", "i", r6("ratio"), r6("root"))


@query(f"""WITH {SERIES}, p AS (SELECT track, t, (t - lag(t) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM series WINDOW w AS (PARTITION BY track ORDER BY i)) SELECT track, round(sum(a), 2) AS area, round(max(t) - min(t), 6) AS span FROM p GROUP BY track""")
def trapezoid(spark, sf_dir):
    return series(spark, sf_dir).transform(S.trapezoid).select("track", F.round("area", 2).alias("area"), r6("span"))


@query(f"""WITH {SERIES} SELECT track, i, round((coalesce(t - lag(t) OVER w, 0) + coalesce(lead(t) OVER w - t, 0)) / 2, 6) AS dt FROM series WINDOW w AS (PARTITION BY track ORDER BY i)""")
def frame_durations(spark, sf_dir):
    return series(spark, sf_dir).transform(S.frame_durations).select("track", "i", r6("dt"))


EXTREMA = f"""WITH {SERIES}, l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM series WINDOW w AS (PARTITION BY track ORDER BY i)),
e AS (SELECT track, i, t, y - 250 AS y, CASE WHEN y > a AND y > b THEN 1 WHEN y < a AND y < b THEN -1 END AS polarity FROM l)"""


@query(EXTREMA + """, s AS (SELECT * FROM e WHERE polarity * y >= 60), n AS (SELECT *, CASE WHEN polarity = lag(polarity) OVER (PARTITION BY track ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY i) AS g FROM n), c AS (SELECT track, count(DISTINCT g) AS extrema FROM g GROUP BY track) SELECT track, extrema, CAST((extrema - 1) // 2 AS BIGINT) AS cycles FROM c""")
def cycle_count(spark, sf_dir):
    return S.cycle_count(series(spark, sf_dir).withColumn("y", F.col("y") - 250), 60)


@query(EXTREMA + """, n AS (SELECT *, CASE WHEN polarity = lag(polarity) OVER (PARTITION BY track ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM e WHERE polarity IS NOT NULL), g AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY i) AS g FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY track, g ORDER BY abs(y) DESC, i) AS k FROM g) SELECT track, i, round(y, 6) AS y, polarity FROM k WHERE k = 1""")
def alternating_extrema(spark, sf_dir):
    extrema = S.local_extrema(series(spark, sf_dir).withColumn("y", F.col("y") - 250))
    return S.alternating_extrema(extrema).select("track", F.col("i").cast("int").alias("i"), r6("y"), "polarity")


@query(f"""WITH {SERIES}, p AS (SELECT track, max(y) AS top, arg_max(i, y) AS frame FROM series GROUP BY track),
o AS (SELECT s.*, top, p.frame, abs(y - top) > 60 AS off FROM series s JOIN p USING (track)), e AS (SELECT track, max(i) FILTER (off AND i < frame) AS l, min(i) FILTER (off AND i > frame) AS r, max(t) FILTER (i = frame) AS tp FROM o GROUP BY track),
x AS (SELECT o.track, max(top) AS top, max(frame) AS frame, max(tp) AS tp, max(t) FILTER (i > coalesce(l, -1) AND i < coalesce(r, 2147483647)) - min(t) FILTER (i > coalesce(l, -1) AND i < coalesce(r, 2147483647)) AS w,
    bool_or(t > tp AND y < top - 180) AS descent FROM o JOIN e USING (track) GROUP BY o.track)
SELECT track, frame, round(top, 6) AS peak, w >= {DAY} AS plateau, descent, NOT (w >= {DAY} OR descent) AS right_censored FROM x""")
def height_peak(spark, sf_dir):
    return S.height_peak(series(spark, sf_dir), 60, DAY).select("track", "frame", r6("peak"), "plateau", "descent", "right_censored")


@query(f"""WITH {SERIES}, e AS (SELECT track, arg_min(y, i) AS a, arg_max(y, i) AS b, min(i) AS lo, max(i) AS hi, max(y) - min(y) AS span FROM series GROUP BY track),
s AS (SELECT s.track, s.i, greatest(y - greatest(a, b), least(a, b) - y) AS s, span, row_number() OVER (PARTITION BY s.track ORDER BY greatest(y - greatest(a, b), least(a, b) - y) DESC, i) AS k FROM series s JOIN e USING (track) WHERE i > lo AND i < hi)
SELECT track, CASE WHEN s >= 0.18 * span THEN i END AS turn, round(span, 6) AS span FROM s WHERE k = 1""")
def turning_point(spark, sf_dir):
    return S.turning_point(series(spark, sf_dir)).select("track", "turn", r6("span"))


@query(f"""WITH {SERIES}, f AS (SELECT track, i, CASE WHEN y > 60 THEN 1 ELSE 0 END AS f, count(*) OVER (PARTITION BY track) AS n FROM series),
s AS (SELECT *, sum(f) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS run, avg(f) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pure,
    last_value(f) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS final FROM f)
SELECT track, min(CASE WHEN run = 6 AND pure >= 0.8 AND final = 1 AND i - 1 < n - 6 THEN i END) AS merged FROM s GROUP BY track""")
def merge_frame(spark, sf_dir):
    return S.merge_frame(series(spark, sf_dir), F.col("y") > 60)


@query(f"""WITH {SERIES} SELECT track, i, last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t_before FROM series""")
def as_of_last(spark, sf_dir):
    return series(spark, sf_dir).transform(S.as_of_last, F.col("event_type") == "purchase").select("track", "i", "t_before")


@query(f"""WITH {SERIES} SELECT track, i, CASE WHEN coalesce(abs(y - lag(y) OVER (PARTITION BY track ORDER BY i)) > 200, false) THEN NULL ELSE y END AS kept FROM series""")
def jump_reject(spark, sf_dir):
    return series(spark, sf_dir).transform(S.reject_jumps, 200).select("track", "i", "kept")


@query(f"""WITH {SERIES}, s AS (SELECT *, t - lag(t) OVER w AS step, CASE WHEN valid THEN t - last_value(CASE WHEN valid THEN t END IGNORE NULLS) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM series WINDOW w AS (PARTITION BY track ORDER BY i)),
a AS (SELECT track, arg_min(valid, i) AS first, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS fraction, max(gap) AS gap, median(step) AS usual, max(t) - max(t) FILTER (valid) AS lost, count(*) FILTER (valid) AS n FROM s GROUP BY track)
SELECT track, round(fraction, 6) AS fraction, round(gap, 6) AS gap, first AND fraction >= 0.7 AND n >= 2 AND gap <= {2 * DAY} + usual + 1e-6 AND lost <= {2 * DAY} AS accepted FROM a""")
def track_acceptance(spark, sf_dir):
    return S.accepted_tracks(series(spark, sf_dir), 0.7, 2 * DAY).select("track", r6("fraction"), r6("gap"), "accepted")


@query(f"""WITH {SERIES}, q AS (SELECT *, y - avg(y) OVER (PARTITION BY track) AS c FROM series), k AS (SELECT track, i, y, CAST(floor((i - 1) / 8) AS BIGINT) AS part FROM q)
SELECT track, part, round(arg_max(y, i) - arg_min(y, i), 6) AS step FROM k GROUP BY track, part""")
def interval_steps(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("part", F.floor((F.col("i") - 1) / 8).cast("bigint"))
    return s.groupBy("track", "part").agg(r6(F.max_by("y", "i") - F.min_by("y", "i"), "step"))


def _kernel(spark, sf_dir, kernel, schema):
    return K.grouped(series(spark, sf_dir), ["track"], ["i"], kernel, "track long, " + schema)


@query(f"""WITH {SERIES}, n AS (SELECT track, count(*) AS n FROM series GROUP BY track), c AS (SELECT s.track, s.i AS k, sum(w.y * (7 - (w.i - s.i) ** 2)) / 21 AS a0, sum(w.y * (w.i - s.i)) / 28 AS a1, sum(w.y * ((w.i - s.i) ** 2 - 4)) / 84 AS a2
    FROM series s JOIN series w ON s.track = w.track AND w.i BETWEEN s.i - 3 AND s.i + 3 JOIN n ON n.track = s.track WHERE s.i BETWEEN 4 AND n.n - 3 GROUP BY s.track, s.i),
p AS (SELECT s.track, s.i, CAST(greatest(4, least(n.n - 3, s.i)) AS INTEGER) AS k, s.i - greatest(4, least(n.n - 3, s.i)) AS u FROM series s JOIN n USING (track))
SELECT track, i, round(a0 + a1 * u + a2 * u * u, 6) AS smooth, round(a1 + 2 * a2 * u, 6) AS slope FROM p LEFT JOIN c USING (track, k)""")
def savgol(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: {"i": c["i"], "smooth": K.savgol(c["y"], 7, 2).round(6), "slope": K.savgol(c["y"], 7, 2, 1).round(6)}, "i int, smooth double, slope double")


@query(f"""WITH RECURSIVE {SERIES}, g AS (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY track ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM series), h AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY i) AS run FROM g),
flat AS (SELECT track, run, y, min(i) AS a, max(i) AS b FROM h GROUP BY track, run, y), tops AS (SELECT track, (a + b) // 2 AS p, y FROM (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM flat WINDOW w AS (PARTITION BY track ORDER BY run)) WHERE y > l AND y > r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY y DESC, p DESC) AS k FROM tops), kept AS (SELECT track, 1::BIGINT AS k, [p] AS ps FROM ranked WHERE k = 1
    UNION ALL SELECT kept.track, r.k, CASE WHEN len(list_filter(ps, lambda q: abs(q - r.p) < 3)) = 0 THEN list_append(ps, r.p) ELSE ps END FROM kept JOIN ranked r ON r.track = kept.track AND r.k = kept.k + 1),
final AS (SELECT track, unnest(arg_max(ps, k)) AS p FROM kept GROUP BY track), w AS (SELECT f.track, f.p, t.y, coalesce(max(s.i) FILTER (s.i < f.p AND s.y > t.y), 0) AS lo, coalesce(min(s.i) FILTER (s.i > f.p AND s.y > t.y), 2147483647) AS hi FROM final f JOIN tops t ON t.track = f.track AND t.p = f.p JOIN series s ON s.track = f.track GROUP BY f.track, f.p, t.y),
z AS (SELECT w.track, w.p, w.y - greatest(min(s.y) FILTER (s.i <= w.p AND s.i > lo), min(s.y) FILTER (s.i >= w.p AND s.i < hi)) AS rise FROM w JOIN series s USING (track) GROUP BY w.track, w.p, w.y)
SELECT track, CAST(p AS INTEGER) AS i, round(rise, 6) AS prominence FROM z WHERE rise >= 100""")
def peaks_prominence(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(int(c["i"][p]), round(v, 6)) for p, v in K.peaks(c["y"], 100, 3)], "i int, prominence double")


@query(f"""WITH {SERIES}, c AS (SELECT track, i, y, sum(y) OVER (PARTITION BY track ORDER BY i) AS c FROM series), p AS (SELECT a.track, a.i AS a, b.i AS b, (b.c - a.c + a.y) / (b.i - a.i + 1) AS v FROM c a JOIN c b ON a.track = b.track AND a.i <= b.i),
m AS (SELECT track, a, b AS i, min(v) OVER w AS lo, max(v) OVER w AS hi FROM p WINDOW w AS (PARTITION BY track, a ORDER BY b DESC))
SELECT track, i, round(max(lo), 9) AS rising, round(min(hi), 9) AS falling FROM m GROUP BY track, i""")
def isotonic(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: {"i": c["i"], "rising": K.isotonic(c["y"]).round(9), "falling": K.isotonic(c["y"], False).round(9)}, "i int, rising double, falling double")


@query()
def irls_fit(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [K.irls_line(c["t"] - c["t"][0], c["y"])], "slope double, intercept double, scale double")


@query()
def fft_period(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(K.spectral_period((c["t"] - c["t"][0]) / DAY, c["y"]),)], "days double")


@query(f"""WITH RECURSIVE {SERIES}, p AS (SELECT track, i, t, y AS h, sqrt(greatest(0, y)) * (1 + i % 3 / 10) AS q FROM series WHERE y > 0), k AS (SELECT track, min(i) AS i FROM p GROUP BY track
    UNION ALL SELECT k.track, (SELECT min(n.i) FROM p n WHERE n.track = k.track AND n.i > k.i AND n.t >= a.t + {DAY} - 1e-9) FROM k JOIN p a ON a.track = k.track AND a.i = k.i WHERE k.i IS NOT NULL),
s AS (SELECT p.track, ln(p.h) AS x, ln(p.q) AS z FROM k JOIN p USING (track, i)), f AS (SELECT track, count(*) AS n, regr_slope(z, x) AS b, regr_sxx(z, x) AS sxx, regr_syy(z, x) AS syy FROM s GROUP BY track)
SELECT track, CAST(n AS INTEGER) AS n, CASE WHEN n >= 5 THEN round(b, 6) END AS beta, CASE WHEN n >= 5 THEN round(sqrt(greatest(0, syy - b * b * sxx) / greatest(1, n - 2) / sxx), 6) END AS beta_se FROM f""")
def discharge_exponent(spark, sf_dir):
    import numpy as np

    return _kernel(spark, sf_dir, lambda c: [tuple(v if v is None else round(v, 6) for v in K.discharge_exponent(c["t"], c["y"], np.sqrt(np.maximum(0, c["y"])) * (1 + c["i"] % 3 / 10), 0 * c["y"], 3, DAY, 5))], "n int, beta double, beta_se double")


@query()
def discharge_integral(spark, sf_dir):
    import numpy as np

    return _kernel(spark, sf_dir, lambda c: [K.discharge_integral((c["t"] - c["t"][0]) / DAY, 500 - c["y"], np.cumsum(c["y"]))], "beta double, rmse double")


@query(f"""WITH RECURSIVE {SERIES}, l AS (SELECT track, coalesce(list(t ORDER BY i) FILTER (event_type = 'click'), []) AS r, coalesce(list(t ORDER BY i) FILTER (event_type = 'view'), []) AS f FROM series GROUP BY track),
s AS (SELECT track, 1 AS a, 1 AS b, 0 AS hits FROM l UNION ALL SELECT s.track, CASE WHEN abs(r[a] - f[b]) <= {DAY} / 2 + 1e-10 OR r[a] < f[b] THEN a + 1 ELSE a END, CASE WHEN abs(r[a] - f[b]) <= {DAY} / 2 + 1e-10 OR r[a] >= f[b] THEN b + 1 ELSE b END,
    hits + CASE WHEN abs(r[a] - f[b]) <= {DAY} / 2 + 1e-10 THEN 1 ELSE 0 END FROM s JOIN l USING (track) WHERE a <= len(r) AND b <= len(f)), h AS (SELECT track, max(hits) AS hits FROM s GROUP BY track)
SELECT track, CAST(hits AS INTEGER) AS hits, CAST(len(f) - hits AS INTEGER) AS false_alarms, CAST(len(r) - hits AS INTEGER) AS misses, CASE WHEN len(r) = 0 OR len(f) = 0 THEN 0.0 ELSE round(2 * hits / (len(r) + len(f))::DOUBLE, 9) END AS f1 FROM h JOIN l USING (track)""")
def event_match_f1(spark, sf_dir):
    def match(c):
        at = lambda kind: c["t"][c["event_type"] == kind]
        return [(*counts, round(f1, 9)) for *counts, f1 in [K.match_events(at("click"), at("view"), DAY / 2)]]

    return _kernel(spark, sf_dir, match, "hits int, false_alarms int, misses int, f1 double")


def terminal_sql(points: str, seconds: float, change: float) -> str:
    """All windows of steady speed, one by one, in SQL: `points` ends with a table p (track, i, t, y); found has track, a, b, span and v."""
    return f"""WITH {points},
w AS (SELECT a.track, a.i AS a, b.i AS b, b.t - a.t AS span FROM p a JOIN p b ON a.track = b.track AND b.i >= a.i + 3), m AS (SELECT w.track, w.a, w.b, max(span) AS span, avg(p.t) AS mt FROM w JOIN p ON p.track = w.track AND p.i BETWEEN w.a AND w.b GROUP BY w.track, w.a, w.b),
s AS (SELECT m.track, m.a, m.b, max(span) AS span, count(*) AS n, sum((t - mt) ** 2) AS m2, sum((t - mt) ** 3) AS m3, sum((t - mt) ** 4) AS m4, sum((t - mt) * y) AS mv, sum((t - mt) ** 2 * y) AS mmv, avg(y) AS my, var_pop(y) * count(*) AS vv FROM m JOIN p ON p.track = m.track AND p.i BETWEEN m.a AND m.b GROUP BY m.track, m.a, m.b),
f AS (SELECT *, mv / m2 AS v, greatest(0, vv - mv * mv / m2) AS ss, (mmv - m2 * my - m3 * mv / m2) / (m4 - m2 * m2 / n - m3 * m3 / m2) AS q FROM s), e AS (SELECT *, greatest(sqrt(ss / greatest(1, n - 2) / m2), 0.5 / sqrt(m2)) AS se, sqrt(ss / n) AS rms FROM f),
l AS (SELECT track, a, b, v - 1.96 * se AS lo, v + 1.96 * se AS hi FROM (SELECT *, row_number() OVER (PARTITION BY track, a ORDER BY b) AS k FROM e WHERE span >= {seconds} - 1e-9) WHERE k = 1 AND v > 0 AND 1.96 * se <= 0.5 * {change} * v),
o AS (SELECT * FROM e WHERE span >= {seconds} AND v > 0 AND v * span >= 10 AND v >= 3.0 * se AND rms <= greatest(1.0, 0.15 * v * span) AND abs(2 * q * span) <= {change} * v),
i AS (SELECT o.track, o.a, o.b, count(l.a) AS c, max(lo) - min(hi) AS apart FROM o LEFT JOIN l ON l.track = o.track AND l.a >= o.a AND l.b <= o.b GROUP BY o.track, o.a, o.b),
found AS (SELECT track, a, b, span, v FROM o JOIN i USING (track, a, b) WHERE c < 2 OR apart <= {change} * v)"""


@query(terminal_sql(f"{SERIES}, p AS (SELECT track, CAST(i - 1 AS INTEGER) AS i, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, sum(y) OVER (PARTITION BY track ORDER BY i) AS y FROM series)", 3.0, 0.3)
    + 'SELECT track, a AS start, b AS "end", round(span, 6) AS duration, round(v, 4) AS speed, 5.0::DOUBLE AS radius FROM found')
def terminal_windows(spark, sf_dir):
    def steady(c):
        import numpy as np

        t = (c["t"] - c["t"][0]) / DAY
        return [(a, b, round(span, 6), round(v, 4), r) for a, b, span, v, r in K.terminal_windows(t, np.cumsum(c["y"]), 0 * t + 5, t >= 0, 3.0, 0.3, 1.0, 3.0)]

    return _kernel(spark, sf_dir, steady, "start int, end int, duration double, speed double, radius double")


@query(f"""WITH {SERIES}, p AS (SELECT track, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, sum(y) OVER (PARTITION BY track ORDER BY i) AS y, i FROM series), d AS (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY i) AS d FROM p),
g AS (SELECT track, median(d) / 2 AS step, max(t) AS last FROM d GROUP BY track), t AS (SELECT track, step, unnest(generate_series(0, CAST(ceil((last - 4 * step) / step) AS INTEGER) - 1)) AS k FROM g),
f AS (SELECT t.track, t.k, t.k * t.step AS t0, regr_slope(p.y, greatest(0, p.t - t.k * t.step) ** 2 / 2) AS a, sqrt(greatest(0, regr_syy(p.y, greatest(0, p.t - t.k * t.step) ** 2 / 2) - regr_sxy(p.y, greatest(0, p.t - t.k * t.step) ** 2 / 2) ** 2 / regr_sxx(p.y, greatest(0, p.t - t.k * t.step) ** 2 / 2)) / count(*)) AS e
    FROM t JOIN p USING (track) GROUP BY t.track, t.k, t.step), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(e, 6), k) AS k2 FROM f)
SELECT track, round(t0, 4) AS release, round(a, 3) AS acceleration, round(e, 3) AS rmse FROM k WHERE k2 = 1""")
def released_motion(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(round(t0, 4), round(a, 3), round(e, 3)) for t0, a, e in [K.released_motion((c["t"] - c["t"][0]) / DAY, c["y"].cumsum())]], "release double, acceleration double, rmse double")


@query(f"""WITH {SERIES}, p AS (SELECT track, i, i::DOUBLE AS x, sum(y) OVER (PARTITION BY track ORDER BY i) AS y, count(*) OVER (PARTITION BY track) AS n FROM series),
c AS (SELECT a.track, a.i AS cut, b.i > a.i AS later, count(*) AS m, var_pop(b.x) * count(*) AS xx, var_pop(b.y) * count(*) AS yy, covar_pop(b.y, b.x) * count(*) AS xy FROM p a JOIN p b ON a.track = b.track WHERE a.i BETWEEN 5 AND a.n - 5 GROUP BY a.track, a.i, b.i > a.i),
e AS (SELECT track, cut, sqrt(sum((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy)) / sum(m)) AS e FROM c GROUP BY track, cut), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(e, 9), cut) AS k FROM e)
SELECT track, cut, round(e, 3) AS rmse FROM k WHERE k = 1 UNION ALL SELECT track, NULL, NULL FROM p GROUP BY track HAVING count(*) < 10""")
def path_split(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: [(cut, round(e, 3) if cut else None) for cut, e in [K.split_path(c["i"].astype(float), c["y"].cumsum(), 5)]], "cut int, rmse double")


@query(f"""WITH {SERIES}, r AS (SELECT *, i - row_number() OVER (PARTITION BY track, y > 60 ORDER BY i) AS g, max(i) OVER (PARTITION BY track) AS n FROM series),
a AS (SELECT track, min(i) AS lo, max(i) AS hi, max(y) AS height, max(n) AS n FROM r WHERE y > 60 GROUP BY track, g HAVING count(*) >= 3)
SELECT a.track, CAST(a.lo - 2 AS INTEGER) AS start, CAST(min(s.i) FILTER (s.y = a.height AND s.i BETWEEN a.lo AND a.hi) - 1 AS INTEGER) AS apex, CAST(a.hi AS INTEGER) AS "end", a.height, max(s.t) FILTER (s.i = a.hi + 1) - max(s.t) FILTER (s.i = a.lo - 1) AS duration
FROM a JOIN series s USING (track) WHERE a.lo > 1 AND a.hi < a.n GROUP BY a.track, a.lo, a.hi, a.height""")
def bounce_arcs(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda c: K.bounce_arcs(c["t"], c["y"], 60.0), "start int, apex int, end int, height double, duration double")
