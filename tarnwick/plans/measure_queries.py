"""Quantities measured on pairs of tracks: the tracks 2k and 2k + 1 of events are the objects a and b of sample k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import measures as M
from tarnwick.operators import series as S
from tarnwick.plans.registry import query, rounded
from tarnwick.plans.views import SERIES, series

DAY = 86_400.0


def observations(spark, sf_dir):
    s = series(spark, sf_dir)
    obj = F.when(F.col("track") % 2 == 0, "a").otherwise("b")
    return s.select(F.expr("track div 2").cast("string").alias("sample"), obj.alias("object"), "i", (F.col("t") / DAY - 19700).alias("t"), F.col("i").cast("double").alias("x"), "y", F.lit(1.0).alias("r"), "valid")


OBS = f"""{SERIES}, obs AS (SELECT CAST(track // 2 AS VARCHAR) AS sample, CASE WHEN track % 2 = 0 THEN 'a' ELSE 'b' END AS object, i, t / {DAY} - 19700 AS t, i::DOUBLE AS x, y, valid FROM series)"""


def long(df):
    return df.select("sample", F.explode("quantities").alias("name", "value")).withColumn("value", rounded(F.col("value"), 4))


@query(f"""WITH {OBS}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY sample, object) AS c FROM obs WHERE valid), n AS (SELECT *, lead(c) OVER w AS cn, lead(t) OVER w AS tn FROM c WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
x AS (SELECT sample, object, CASE WHEN c = 0 THEN t ELSE t + (tn - t) * c / (c - cn) END AS tc FROM n WHERE cn IS NOT NULL AND (c = 0 OR c * cn < 0)), g AS (SELECT sample, object, 2 * (tc - lag(tc) OVER (PARTITION BY sample, object ORDER BY tc)) AS g FROM x),
p AS (SELECT sample, object, CASE WHEN count(*) >= 3 THEN median(g) END AS p FROM g GROUP BY sample, object) SELECT sample, CASE object WHEN 'a' THEN 't_heavy' ELSE 't_light' END AS name, round(p, 4) AS value FROM p WHERE p IS NOT NULL""")
def measured_periods(spark, sf_dir):
    return long(M.periods(observations(spark, sf_dir), {"a": "t_heavy", "b": "t_light"}))


@query(f"""WITH {OBS}, few AS (SELECT * FROM obs), s AS (SELECT p.sample, p.object, median((q.y - p.y) / (q.x - p.x)) AS s FROM few p JOIN few q ON p.sample = q.sample AND p.object = q.object AND p.i < q.i GROUP BY p.sample, p.object)
SELECT sample, CASE object WHEN 'a' THEN 'v1' ELSE 'v1_after' END AS name, round(s, 4) AS value FROM s""")
def measured_collision(spark, sf_dir):
    few = observations(spark, sf_dir).withColumns({"t": F.col("x"), "x": F.col("y"), "object": F.when(F.col("object") == "a", "before").otherwise("first_after")})
    return long(M.collision(few))


@query(f"""WITH {OBS}, v AS (SELECT sample, object, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS share FROM obs GROUP BY sample, object), k AS (SELECT *, row_number() OVER (PARTITION BY sample, object ORDER BY i DESC) AS k FROM obs WHERE valid),
f AS (SELECT sample, object, median(y) AS level, abs(regr_slope(y, t)) AS slope, count(*) AS n FROM k WHERE k <= 12 GROUP BY sample, object), u AS (SELECT f.* FROM f JOIN v USING (sample, object) WHERE share >= 0.75 AND n >= 5),
w AS (SELECT sample, max(level) FILTER (object = 'a') AS la, max(level) FILTER (object = 'b') AS lb, greatest(max(slope) FILTER (object = 'a'), max(slope) FILTER (object = 'b')) AS s FROM u GROUP BY sample),
q AS (SELECT sample, unnest(['level_left', 'level_right', 'slope', 'height']) AS name, unnest([la, lb, s, 100.0::DOUBLE]) AS value FROM w) SELECT sample, name, round(value, 4) AS value FROM q WHERE value IS NOT NULL""")
def measured_vessels(spark, sf_dir):
    named = observations(spark, sf_dir).withColumn("object", F.when(F.col("object") == "a", "left").otherwise("right"))
    return long(M.vessels(named, 100.0))


@query(f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample, object ORDER BY i) AS k, count(*) OVER (PARTITION BY sample, object) AS n FROM obs WHERE valid), s AS (SELECT *, greatest(5, least(12, n // 8)) AS s FROM k),
h AS (SELECT sample, object, median(y) FILTER (k <= s) AS head, median(y) FILTER (k > n - s) AS tail FROM s GROUP BY sample, object)
SELECT sample, 'h_water' AS name, round(head, 4) AS value FROM h WHERE object = 'a' UNION ALL SELECT sample, 'h_ice', round(tail, 4) FROM h WHERE object = 'b'""")
def measured_head_tail(spark, sf_dir):
    return long(M.head_tail_levels(observations(spark, sf_dir), {"a": ("h_water", None), "b": (None, "h_ice")}))


@query(f"""WITH {OBS}, d AS (SELECT sample, object, i, t, sum(y) OVER (PARTITION BY sample, object ORDER BY i) AS d FROM obs), a AS (SELECT sample, object, min(i) FILTER (d >= 3000) AS arrival FROM d GROUP BY sample, object),
s AS (SELECT d.sample, d.object, max(a.arrival) AS t, CASE WHEN count(*) FILTER (i <= arrival AND d >= 600) >= 3 THEN regr_slope(d, d.t) FILTER (i <= arrival AND d >= 600) END AS v FROM d JOIN a USING (sample, object) GROUP BY d.sample, d.object),
q AS (SELECT sample, CASE object WHEN 'a' THEN 't_metal' ELSE 't_plain' END AS name, t::DOUBLE AS value FROM s UNION ALL SELECT sample, CASE object WHEN 'a' THEN 'v_metal' ELSE 'v_plain' END, v FROM s) SELECT sample, name, round(value, 4) AS value FROM q WHERE value IS NOT NULL""")
def measured_arrivals(spark, sf_dir):
    way = S.way(observations(spark, sf_dir).filter("sample is not null"), M.KEYS)
    named = way.withColumn("object", F.when(F.col("object") == "a", "metal").otherwise("plain"))
    return long(M.arrivals(named, 3000))


@query(f"""WITH {OBS}, w AS (SELECT sample, i, max(y) FILTER (object = 'a') - max(y) FILTER (object = 'b') AS d FROM obs WHERE valid GROUP BY sample, i), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i DESC) AS k FROM w WHERE d IS NOT NULL),
m AS (SELECT sample, median(d) AS med FROM k WHERE k <= 12 GROUP BY sample), s AS (SELECT k.sample, max(med) AS med, 1.4826 * median(abs(d - med)) AS mad FROM k JOIN m USING (sample) WHERE k <= 12 GROUP BY k.sample)
SELECT sample, unnest(['rise', 'mad', 'rms']) AS name, unnest([round(med, 4), round(mad, 4), 0.0::DOUBLE]) AS value FROM s""")
def measured_capillaries(spark, sf_dir):
    named = observations(spark, sf_dir).withColumn("object", F.when(F.col("object") == "a", "narrow").otherwise("wide"))
    return long(M.capillaries(named))


@query(f"""WITH {OBS}, e AS (SELECT sample, object, i, y - 250 AS y, CASE WHEN y > lag(y) OVER w AND y > lead(y) OVER w THEN 1 WHEN y < lag(y) OVER w AND y < lead(y) OVER w THEN -1 END AS p FROM obs WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
s AS (SELECT *, CASE WHEN p = lag(p) OVER (PARTITION BY sample, object ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM e WHERE p * y >= 60), c AS (SELECT sample, object, (sum(fresh) - 1) // 2 AS c FROM s GROUP BY sample, object),
k AS (SELECT sample, coalesce(max(c) FILTER (object = 'a'), 0) AS a, coalesce(max(c) FILTER (object = 'b'), 0) AS b FROM c GROUP BY sample) SELECT sample, unnest(['n_solid', 'n_slotted']) AS name, unnest([a::DOUBLE, b::DOUBLE]) AS value FROM k""")
def measured_swings(spark, sf_dir):
    named = observations(spark, sf_dir).withColumns({"y": F.col("y") - 250, "object": F.when(F.col("object") == "a", "solid").otherwise("slotted")})
    return long(M.swing_counts(named, 60))


@query(f"""WITH {SERIES}, s AS (SELECT CAST(track AS VARCHAR) AS sample, i, t / {DAY} - 19700 AS t, y, valid FROM series), r AS (SELECT *, i - row_number() OVER (PARTITION BY sample, valid ORDER BY i) AS g FROM s),
n AS (SELECT sample, g, min(i) AS lo, max(i) AS hi FROM r WHERE valid GROUP BY sample, g HAVING count(*) >= 3 AND max(t) - min(t) >= 1 - 1e-9),
d AS (SELECT sample, i, y, (coalesce(t - lag(t) OVER w, 0) + coalesce(lead(t) OVER w - t, 0)) / 2 AS dt FROM s WINDOW w AS (PARTITION BY sample ORDER BY i)),
u AS (SELECT d.* FROM d JOIN n ON n.sample = d.sample AND d.i BETWEEN n.lo AND n.hi), c AS (SELECT sample, y, sum(dt) OVER (PARTITION BY sample ORDER BY y) AS c, sum(dt) OVER (PARTITION BY sample) AS s FROM u)
SELECT sample, 'radius_error' AS name, round(min(y) FILTER (c >= s / 2), 4) AS value FROM c GROUP BY sample""")
def measured_bubbles(spark, sf_dir):
    films = series(spark, sf_dir).select(F.col("track").cast("string").alias("sample"), F.lit("film").alias("object"), "i", (F.col("t") / DAY - 19700).alias("t"), "y", "valid")
    return long(M.bubble_film(films, 3, 1.0))
