"""Rises, starts of discharges, chains of bounces and fits with rejection on the tracks of events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarnwick.operators import events as V
from tarnwick.operators import fits
from tarnwick.operators import kernels as K
from tarnwick.operators import measures as M
from tarnwick.operators import stats as T
from tarnwick.plans.measure_queries import long
from tarnwick.plans.registry import query, r6
from tarnwick.plans.series_queries import DAY, _kernel
from tarnwick.plans.task_queries import dealt
from tarnwick.plans.views import SERIES, series

#: A surface that rises by some pixels a frame from frame 8 to frame 33, how fast by track, with a few hundredths of noise; its rare misses come from events.
RISING = f"""{SERIES}, s AS (SELECT track, i, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, 200 - (track % 7) * 0.5::DOUBLE * greatest(0, least(25, i - 8)) + y / (CASE WHEN track % 5 = 0 THEN 100 ELSE 1000 END) AS y, valid OR i % 3 > 0 AS valid FROM series)"""


def rising(spark, sf_dir):
    s = series(spark, sf_dir)
    first = F.min("t").over(V.all_rows())
    level = 200 - (F.col("track") % 7) * 0.5 * F.greatest(F.lit(0), F.least(F.lit(25), F.col("i") - 8)) + F.col("y") / F.when(F.col("track") % 5 == 0, 100).otherwise(1000)
    return s.select("track", "i", ((F.col("t") - first) / DAY).alias("t"), level.alias("y"), (F.col("valid") | (F.col("i") % 3 > 0)).alias("valid"))


@query(f"""WITH {RISING}, k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY track) AS n, CASE WHEN valid THEN y END AS v FROM s WINDOW w AS (PARTITION BY track ORDER BY i)),
l AS (SELECT track, count(v) AS seen, max(n) AS n, max(t) - min(t) AS span, CASE WHEN count(v) FILTER (k < 6) >= 5 AND max(v) FILTER (k < 6) - min(v) FILTER (k < 6) <= 2 THEN median(v) FILTER (k < 6) END AS a,
    CASE WHEN count(v) FILTER (k >= n - 6) >= 5 AND max(v) FILTER (k >= n - 6) - min(v) FILTER (k >= n - 6) <= 2 THEN median(v) FILTER (k >= n - 6) END AS b FROM k GROUP BY track),
v AS (SELECT track, k, v, lag(v) OVER w AS v0, lag(k) OVER w AS k0 FROM k WHERE v IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY k)),
g AS (SELECT track, bool_or(coalesce(k - k0 - 1 > 1 AND (abs(v - v0) > 4 OR coalesce((a + b) / 2 BETWEEN least(v, v0) AND greatest(v, v0), true)), false)) AS gap, max(abs(v - v0)) AS step FROM v JOIN l USING (track) GROUP BY track),
h AS (SELECT track, i, t, lag(v) OVER w > m AND v <= m AND lead(v) OVER w <= m AND lead(v, 2) OVER w <= m AS c FROM (SELECT k.*, (a + b) / 2 AS m FROM k JOIN l USING (track)) WINDOW w AS (PARTITION BY track ORDER BY k)),
f AS (SELECT track, min(i) FILTER (c) AS half, arg_min(t, i) FILTER (c) AS at_ FROM h GROUP BY track),
q AS (SELECT l.track, a, b, a - b AS rise, half, at_, span, list_filter([CASE WHEN a IS NULL THEN 'first_level' END, CASE WHEN b IS NULL THEN 'last_level' END, CASE WHEN a - b < 8 THEN 'small_rise' END, CASE WHEN gap THEN 'long_gap' END, CASE WHEN seen < greatest(8, floor(n * 0.65)) THEN 'coverage' END,
    CASE WHEN a - b >= 8 AND step > greatest(5, 0.15 * (a - b)) THEN 'abrupt_step' END, CASE WHEN a - b >= 8 AND half IS NULL THEN 'no_half_crossing' END], lambda x: x IS NOT NULL) AS flags FROM l JOIN g USING (track) JOIN f USING (track))
SELECT track, round(a, 6) AS first_level, round(b, 6) AS last_level, round(rise, 6) AS rise, CASE WHEN len(flags) = 0 THEN half::DOUBLE END AS half_frame, CASE WHEN len(flags) = 0 THEN round(at_, 6) END AS half_time, CASE WHEN len(flags) = 0 AND span > 0 THEN round(rise / span, 6) END AS rate, array_to_string(flags, ',') AS flags FROM q""")
def rise_events(spark, sf_dir):
    found = V.rise_events(rising(spark, sf_dir), window=6, gap=1)
    return found.select("track", r6("first_level"), r6("last_level"), r6("rise"), F.col("half_frame").cast("double").alias("half_frame"), r6("half_time"), r6("rate"), F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {SERIES}, p AS (SELECT track, i, (t - min(t) OVER (PARTITION BY track)) / {DAY} AS t, 5000 - CASE WHEN track % 4 = 0 THEN y * i / 10 ELSE (i > 10 + track % 20)::INT * 40 * (i - 10 - track % 20) + y / 5 END AS y FROM series WHERE valid),
k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS k, max(t) OVER (PARTITION BY track) AS t1, min(t) OVER (PARTITION BY track) AS t0, max(abs(y)) OVER (PARTITION BY track) AS top FROM p), e AS (SELECT * FROM k WHERE t <= t0 + 3 + 1e-9),
l AS (SELECT track, count(*) AS n, max(k) AS kf, regr_slope(y, t) AS s, sqrt(greatest(0, regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / greatest(1, count(*) - 2) / nullif(regr_sxx(y, t), 0)) AS se, median(y) AS m FROM e GROUP BY track),
d AS (SELECT e.track, median(abs(y - m)) AS mad FROM e JOIN l USING (track) GROUP BY e.track), r AS (SELECT k.*, n, kf, y < m - 3 * greatest(1.4826 * mad, 2.220446049250313e-14 * greatest(1, top)) AS low FROM k JOIN l USING (track) JOIN d USING (track)),
w AS (SELECT *, avg(low::INT) OVER a AS share, min(CASE WHEN low THEN k END) OVER a AS c FROM r WINDOW a AS (PARTITION BY track ORDER BY t RANGE BETWEEN CURRENT ROW AND 3.000000001 FOLLOWING)),
f AS (SELECT track, arg_min(c, k) FILTER (k >= kf AND t1 - t >= 3 - 1e-9 AND share >= 0.8) AS c, min(i) AS i0 FROM w GROUP BY track),
q AS (SELECT f.track, f.i0, greatest(0, c - 1) AS at_, CASE WHEN n < 3 THEN 'few_frames' WHEN -s > 3 * se THEN 'falling_at_first' WHEN c IS NULL THEN 'no_start_seen' ELSE 'after_wait' END AS reason FROM f JOIN l USING (track))
SELECT q.track, CASE WHEN reason = 'after_wait' THEN k.i ELSE q.i0 END AS start, reason FROM q LEFT JOIN k ON k.track = q.track AND k.k = q.at_""")
def discharge_starts(spark, sf_dir):
    s = series(spark, sf_dir)
    late = F.col("i") - 10 - F.col("track") % 20
    fall = F.when(F.col("track") % 4 == 0, F.col("y") * F.col("i") / 10).otherwise((late > 0).cast("int") * 40 * late + F.col("y") / 5)
    t = (F.col("t") - F.min(F.when(F.col("valid"), F.col("t"))).over(V.all_rows())) / DAY
    return V.discharge_starts(s.select("track", "i", t.alias("t"), (5000 - fall).alias("y"), "valid"), window=3.0)


@query(f"""WITH {SERIES}, r AS (SELECT *, i - row_number() OVER (PARTITION BY track, y > 60 ORDER BY i) AS g, max(i) OVER (PARTITION BY track) AS n FROM series),
a AS (SELECT track, min(i) - 2 AS s, max(i) AS e, max(y) AS height, count(*) AS m, max(n) AS n FROM r WHERE y > 60 GROUP BY track, g), b AS (SELECT * FROM a WHERE m >= 2 AND s >= 0 AND e < n),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY s) AS c FROM (SELECT *, CASE WHEN s <> lag(e) OVER (PARTITION BY track ORDER BY s) THEN 1 ELSE 0 END AS fresh FROM b)),
h AS (SELECT track, min(s) AS start, max(e) AS "end", count(*) AS arcs, sum(height) AS height FROM c GROUP BY track, c)
SELECT track, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", arcs, round(height, 6) AS height FROM h QUALIFY row_number() OVER (PARTITION BY track ORDER BY arcs DESC, height DESC, start) = 1""")
def bounce_chains(spark, sf_dir):
    arcs = _kernel(spark, sf_dir, lambda c: K.bounce_arcs(c["t"], c["y"], 60.0, 2), "start int, apex int, end int, height double, duration double")
    return V.longest_chains(arcs).select("track", "start", "end", "arcs", r6("height"))


def _p(a: str, b: str) -> str:
    return f"(covar_pop({a}, {b}) - covar_pop({a}, t) * covar_pop({b}, t) / nullif(var_pop(t), 0))"


@query(f"""WITH {SERIES}, w AS (SELECT track, y, t / {DAY} - 19700 AS t, cos((t / {DAY} - 19700) * (2 * pi() / 7)) AS c, sin((t / {DAY} - 19700) * (2 * pi() / 7)) AS s FROM series WHERE valid),
m AS (SELECT track, count(*) AS n, {_p('c', 'c')} AS cc, {_p('c', 's')} AS cs, {_p('s', 's')} AS ss, {_p('c', 'y')} AS cy, {_p('s', 'y')} AS sy, {_p('y', 'y')} AS yy, covar_pop(t, y) AS ty, covar_pop(c, t) AS ct, covar_pop(s, t) AS st, var_pop(t) AS tt FROM w GROUP BY track),
z AS (SELECT *, CASE WHEN n >= 5 AND cc * ss - cs * cs > 1e-12 THEN (cy * ss - sy * cs) / (cc * ss - cs * cs) END AS a, CASE WHEN n >= 5 AND cc * ss - cs * cs > 1e-12 THEN (sy * cc - cy * cs) / (cc * ss - cs * cs) END AS b FROM m)
SELECT track, n, round((ty - a * ct - b * st) / nullif(tt, 0), 6) AS trend, round(sqrt(a * a + b * b), 6) AS amplitude, round(atan2(a, b), 6) AS phase, CASE WHEN a IS NOT NULL THEN round(sqrt(greatest(0, yy - a * cy - b * sy)), 6) END AS rmse FROM z""")
def sinusoid_trends(spark, sf_dir):
    s = series(spark, sf_dir).filter("valid").withColumn("t", F.col("t") / DAY - 19700)
    found = T.sinusoid_trend(s, ["track"], "t", "y", 7.0)
    return found.select("track", "n", *map(r6, ("trend", "amplitude", "phase", "rmse")))


@query()
def release_models(spark, sf_dir):
    def fit(c):
        k = np.arange(len(c["y"]))
        found = fits.release_model(0.3 * np.maximum(0, k - c["track"][0] % 6) ** 2 + c["y"] / 50, 6)
        return [(found["release"], found["cubic"], found["rms"], found["noise"], found["model"])] if found else []

    return _kernel(spark, sf_dir, fit, "release double, cubic double, rms double, noise double, model string")


@query()
def vertex_fits(spark, sf_dir):
    def fit(c):
        k = np.arange(len(c["y"]), dtype=float)
        found = fits.vertex(k, -((k - len(k) / 2) ** 2) / 3 + c["y"] / 40)
        return [(found["turn"], found["before"], found["after"], found["kept"], found["quality"][0]["rmse"], found["quality"][1]["rmse"])] if found else []

    return _kernel(spark, sf_dir, fit, "turn double, before double, after double, kept double, rmse_before double, rmse_after double")


@query()
def discharge_fits(spark, sf_dir):
    def fit(c):
        v = 5000 - 20.0 * np.arange(len(c["y"])) - c["y"] / 50
        found = fits.discharge_fit((c["t"] - c["t"][0]) / DAY, np.sqrt(np.maximum(v, 1.0)), v, 0.5, 6)
        return [(found.get("beta"), found.get("se"), found.get("n"), found.get("reason"))]

    return _kernel(spark, sf_dir, fit, "beta double, se double, n double, reason string")


@query()
def measured_inclines(spark, sf_dir):
    k = F.col("k")
    return long(M.incline(dealt(spark, sf_dir, "block", x=F.lit(400.0) - (k - 12) * (k - 12) / 4 + F.col("v") / 100, t=k / 8), 30.0))


@query()
def measured_pendulums(spark, sf_dir):
    j = F.floor(F.col("k") / 2)
    return long(M.spectral_periods(dealt(spark, sf_dir, "t30", "t15", y=10 * F.cos(j * F.when(F.col("k") % 2 == 0, 0.7).otherwise(0.75)) + F.col("v") / 200, t=j / 8)))


@query()
def measured_discharges(spark, sf_dir):
    j = F.floor(F.col("k") / 2).cast("double")
    fallen = F.when(F.col("k") % 2 == 0, 100 * (1 - F.pow(1 - j / 200, F.lit(2.0)))).otherwise(j / 2) + F.col("v") / 2000
    return long(M.discharge(dealt(spark, sf_dir, "water", "sand", x=fallen, y=F.greatest(F.lit(1.0), 100 - fallen), t=j / 8), window=0.25, least=6))
