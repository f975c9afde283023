"""Estimators over the fit points of suppliers and over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarnwick.operators import kernels as K
from tarnwick.operators import stats as T
from tarnwick.plans.registry import query, r6
from tarnwick.plans.views import POINTS, SERIES, points, series, table

G = ["g"]


@query(f"WITH {POINTS} SELECT g, round(stddev_samp(y) / abs(avg(y)), 6) AS cv FROM points GROUP BY g")
def cv_sample(spark, sf_dir):
    return points(spark, sf_dir).groupBy("g").agg(r6(T.cv_sample(F.col("y")), "cv"))


@query(f"WITH {POINTS} SELECT g, round(stddev_pop(y) / avg(y), 6) AS cv FROM points GROUP BY g")
def cv_population(spark, sf_dir):
    return points(spark, sf_dir).groupBy("g").agg(r6(T.cv_population(F.col("y")), "cv"))


MAD = f"WITH {POINTS}, m AS (SELECT g, median(y) AS med FROM points GROUP BY g), s AS (SELECT g, max(med) AS med, 1.4826 * median(abs(y - med)) AS scale, count(*) AS n FROM points JOIN m USING (g) GROUP BY g)"


@query(MAD + " SELECT g, round(med, 6) AS med, round(scale, 6) AS scale, n FROM s")
def mad_scale(spark, sf_dir):
    return T.mad(points(spark, sf_dir), G, "y").select("g", r6("med"), r6("scale"), "n")


@query(MAD + " SELECT g, n, CASE WHEN n >= 4 THEN round(scale / nullif(med, 0), 6) END AS robust_cv FROM s")
def robust_cv(spark, sf_dir):
    return T.robust_cv(points(spark, sf_dir), G, "y", 4).select("g", "n", r6("robust_cv"))


@query(MAD + " SELECT p.g, p.k, p.n, p.y FROM points p JOIN s USING (g) WHERE abs(p.y - s.med) <= 1.5 * s.scale")
def outlier_reject(spark, sf_dir):
    return T.reject_outliers(points(spark, sf_dir), G, "y", 1.5).select("g", "k", "n", "y")


@query(f"WITH {POINTS} SELECT g, round(quantile_cont(x, 0.95), 4) AS p95, round(median(y), 6) AS p50, round(max(y) - min(y), 6) AS span, round(sqrt(avg(y * y)), 6) AS rms, round(avg(CASE WHEN tax >= 0.04 THEN 1 ELSE 0 END), 6) AS share FROM points GROUP BY g")
def percentile_exact(spark, sf_dir):
    y = F.col("y")
    return points(spark, sf_dir).groupBy("g").agg(
        F.round(F.percentile("x", F.lit(0.95)), 4).alias("p95"), r6(F.median("y"), "p50"), r6(F.max(y) - F.min(y), "span"), r6(T.rms(y), "rms"), r6(F.avg((F.col("tax") >= 0.04).cast("int")), "share")
    )


@query(f"WITH {POINTS}, c AS (SELECT g, y, sum(w) OVER (PARTITION BY g ORDER BY y) AS c, sum(w) OVER (PARTITION BY g) AS t FROM points) SELECT g, round(min(CASE WHEN c >= t / 2 THEN y END), 6) AS weighted_median FROM c GROUP BY g")
def weighted_median(spark, sf_dir):
    return T.weighted_median(points(spark, sf_dir), G, "y", "w").select("g", r6("weighted_median"))


@query(f"""WITH {POINTS}, s AS (SELECT g, regr_count(y, x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM points GROUP BY g),
e AS (SELECT *, sqrt(greatest(0, syy - b * sxy) / greatest(1, n - 2) / sxx) AS se FROM s)
SELECT g, CAST(n AS BIGINT) AS n, round(b, 6) AS slope, round(a, 6) AS intercept, round(sqrt(greatest(0, syy - b * sxy) / n), 6) AS rmse, round(se, 6) AS slope_se, round(b - 1.96 * se, 6) AS low, round(b + 1.96 * se, 6) AS high FROM e""")
def ols_ci(spark, sf_dir):
    return T.ols(points(spark, sf_dir), G, "x", "y").select("g", "n", *[r6(c) for c in ("slope", "intercept", "rmse", "slope_se", "low", "high")])


@query(f"""WITH {SERIES}, d AS (SELECT track, i, t / 86400 - 19700 AS t, y FROM series), s AS (SELECT a.track, median((b.y - a.y) / (b.t - a.t)) AS slope FROM d a JOIN d b ON a.track = b.track AND a.i < b.i WHERE abs(b.t - a.t) > 1e-9 GROUP BY a.track)
SELECT d.track, CAST(count(*) AS INTEGER) AS n, round(max(s.slope), 5) AS slope, round(median(d.y - s.slope * d.t), 4) AS intercept FROM d LEFT JOIN s USING (track) GROUP BY d.track""")
def theil_sen(spark, sf_dir):
    days = series(spark, sf_dir).withColumn("t", F.col("t") / 86400 - 19700)
    return T.theil_sen(days, ["track"], "t", "y").select("track", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _solve(basis: str, y: str) -> str:
    """SQL of the normal equations of three basis columns b0, b1, b2 by Cramer's rule."""
    sums = ", ".join(f"sum(b{r} * b{c}) AS m{r}{c}" for r in range(3) for c in range(r, 3)) + ", " + ", ".join(f"sum(b{r} * {y}) AS v{r}" for r in range(3))
    det = lambda m: f"(({m[0][0]}) * (({m[1][1]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][1]})) - ({m[0][1]}) * (({m[1][0]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][0]})) + ({m[0][2]}) * (({m[1][0]}) * ({m[2][1]}) - ({m[1][1]}) * ({m[2][0]})))"
    m = [[f"m{min(r, c)}{max(r, c)}" for c in range(3)] for r in range(3)]
    swap = lambda k: det([[f"v{r}" if c == k else m[r][c] for c in range(3)] for r in range(3)])
    found = ", ".join(f"{swap(k)} / nullif({det(m)}, 0) AS c{k}" for k in range(3))
    return f"basis AS ({basis}), sums AS (SELECT g, count(*) AS n, sum({y} * {y}) AS yy, {sums} FROM basis GROUP BY g), solved AS (SELECT *, {found} FROM sums), fit AS (SELECT *, sqrt(greatest(0, yy - c0 * v0 - c1 * v1 - c2 * v2) / n) AS rmse FROM solved)"


@query(f"WITH {POINTS}, " + _solve("SELECT g, y, 1.0::DOUBLE AS b0, x - avg(x) OVER (PARTITION BY g) AS b1, (x - avg(x) OVER (PARTITION BY g)) ** 2 AS b2 FROM points", "y") + " SELECT g, n, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(rmse, 4) AS rmse FROM fit")
def poly2_fit(spark, sf_dir):
    return T.parabola(points(spark, sf_dir), G, "x", "y").select("g", "n", *[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2", "rmse")])


@query(f"WITH {POINTS}, " + _solve("SELECT g, y, 1.0::DOUBLE AS b0, cos(2 * 3.141592653589793 * x / 20) AS b1, sin(2 * 3.141592653589793 * x / 20) AS b2 FROM points", "y") + " SELECT g, n, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(rmse, 4) AS rmse, round(sqrt(c1 * c1 + c2 * c2), 4) AS amplitude FROM fit")
def sinusoid_fit(spark, sf_dir):
    return T.sinusoid(points(spark, sf_dir), G, "x", "y", 20).select("g", "n", *[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2", "rmse", "amplitude")])


@query(f"WITH {POINTS}, means AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM points GROUP BY g), " + _solve("SELECT g, (x - mx) ** 2 + (y - my) ** 2 AS z, 1.0::DOUBLE AS b0, x - mx AS b1, y - my AS b2 FROM points JOIN means USING (g)", "z") + " SELECT g, n, round(mx + c1 / 2, 4) AS cx, round(my + c2 / 2, 4) AS cy, round(sqrt(greatest(0, c0 + c1 * c1 / 4 + c2 * c2 / 4)), 4) AS radius FROM fit JOIN means USING (g)")
def circle_fit_alg(spark, sf_dir):
    return T.circle(points(spark, sf_dir), G, "x", "y").select("g", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")])


@query(f"""WITH {POINTS}, m AS (SELECT g, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(y, x) AS c FROM points GROUP BY g), h AS (SELECT *, sqrt(((a - b) / 2) ** 2 + c * c) AS h FROM m)
SELECT g, n, round(degrees(atan2(2 * c, a - b)) / 2, 4) AS angle, round(sqrt((a + b) / 2 + h), 4) AS along, round(sqrt(greatest(0, (a + b) / 2 - h)), 4) AS across FROM h""")
def pca_axis(spark, sf_dir):
    return T.principal_axis(points(spark, sf_dir), G, "x", "y").select("g", "n", *[F.round(c, 4).alias(c) for c in ("angle", "along", "across")])


LINES = f"WITH {SERIES}, lines AS (SELECT track AS g, i AS k, cos(i) AS a, sin(i) AS b, y AS c FROM series)"


@query(LINES + """, s AS (SELECT g, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc, sum(c * c) AS cc FROM lines GROUP BY g),
p AS (SELECT *, (ac * bb - bc * ab) / nullif(aa * bb - ab * ab, 0) AS px, (aa * bc - ab * ac) / nullif(aa * bb - ab * ab, 0) AS py FROM s) SELECT g, n, round(px, 4) AS px, round(py, 4) AS py, round(sqrt(greatest(0, cc - px * ac - py * bc) / n), 4) AS rms FROM p""")
def lines_common_point(spark, sf_dir):
    return T.common_point(_lines(spark, sf_dir), G, "a", "b", "c").select("g", "n", *[F.round(c, 4).alias(c) for c in ("px", "py", "rms")])


def _lines(spark, sf_dir):
    return series(spark, sf_dir).select(F.col("track").alias("g"), F.col("i").alias("k"), F.cos("i").alias("a"), F.sin("i").alias("b"), F.col("y").alias("c"))


@query(LINES + """, x AS (SELECT p.g, p.a * q.b - q.a * p.b AS d, p.c * q.b - q.c * p.b AS x, p.a * q.c - q.a * p.c AS y FROM lines p JOIN lines q ON p.g = q.g AND (p.k, p.a, p.b, p.c) < (q.k, q.a, q.b, q.c)
    WHERE abs(p.a * q.b - q.a * p.b) >= sin(radians(20)) * sqrt(p.a * p.a + p.b * p.b) * sqrt(q.a * q.a + q.b * q.b))
SELECT g, count(*) AS pairs, round(median(x / d), 4) AS x, round(median(y / d), 4) AS y FROM x GROUP BY g""")
def pairwise_intersections(spark, sf_dir):
    return T.pairwise_intersections(_lines(spark, sf_dir), G, "a", "b", "c").select("g", "pairs", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


#: Curves of a grid over the width 100 and the span of each track: c its points, k the curves in order of their rmse.
CATENARY = """c AS (SELECT track, i::DOUBLE AS x, y FROM series WHERE valid), b AS (SELECT track, min(x) AS lo, max(x) - min(x) AS span FROM c GROUP BY track),
grid AS (SELECT b.track, s AS sign, 8.0::DOUBLE * (180.0::DOUBLE / 8.0::DOUBLE) ** (j / 29.0::DOUBLE) AS a, lo + span * (0.15 + 0.07 * k)::DOUBLE AS x0 FROM b, (VALUES (1), (-1)) AS s(s), range(30) AS j(j), range(11) AS k(k)),
r AS (SELECT track, sign, a, x0, y - sign * a * cosh((x - x0) / a) AS r FROM c JOIN grid USING (track)), m AS (SELECT track, sign, a, x0, median(r) AS o FROM r GROUP BY track, sign, a, x0),
f AS (SELECT track, sign, a, x0, max(o) AS o, round(sqrt(avg((r - o) ** 2)), 9) AS e FROM r JOIN m USING (track, sign, a, x0) GROUP BY track, sign, a, x0), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY e, sign DESC, a, x0) AS k FROM f)"""


@query(f"""WITH {SERIES}, {CATENARY} SELECT track, sign, round(a, 4) AS a, round(x0, 4) AS x0, round(o, 4) AS "offset", round(e, 4) AS rmse FROM k WHERE k = 1""")
def catenary_grid(spark, sf_dir):
    chain = series(spark, sf_dir).filter("valid").withColumn("x", F.col("i").cast("double"))
    return T.catenary(chain, ["track"], "x", "y", width=100).select("track", "sign", *[F.round(c, 4).alias(c) for c in ("a", "x0", "offset", "rmse")])


@query(f"WITH {POINTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY y DESC, k, n) AS INTEGER) AS rank FROM points) SELECT g, k, n, y, rank FROM r WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    return T.top_k(points(spark, sf_dir), G, [F.col("y").desc(), F.col("k"), F.col("n")], 3).select("g", "k", "n", "y", "rank")


@query()
def radial_circle(spark, sf_dir):
    return K.grouped(points(spark, sf_dir), G, ["k", "n"], lambda c: [K.radial_circle(c["x"], c["y"])], "g long, cx double, cy double, radius double, rms double")


@query(f"""WITH {POINTS}, p AS (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY k, n) AS r FROM points), n AS (SELECT a.g, a.r, count(*) AS size FROM p a JOIN p b ON a.g = b.g AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8 GROUP BY a.g, a.r),
best AS (SELECT g, r, size FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC, r) AS k FROM n) WHERE k = 1)
SELECT a.g, median(b.x) AS x, round(median(b.y), 6) AS y, CAST(max(best.size) AS INTEGER) AS size FROM best JOIN p a USING (g, r) JOIN p b ON a.g = b.g AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8 GROUP BY a.g""")
def consensus(spark, sf_dir):
    return K.grouped(points(spark, sf_dir), G, ["k", "n"], lambda c: [(x, round(y, 6), n) for x, y, n in [K.consensus(c["x"], c["y"], 8.0)]], "g long, x double, y double, size int")


@query(f"""WITH RECURSIVE {POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y DESC, k, n) AS rank FROM points),
s AS (SELECT g, rank, [{{'x': x, 'y': y, 'w': w, 'k': k, 'n': n}}] AS kept FROM p WHERE rank = 1
    UNION ALL SELECT s.g, p.rank, CASE WHEN len(list_filter(kept, lambda q: sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) < 0.42 * q.w)) = 0 THEN list_append(kept, {{'x': p.x, 'y': p.y, 'w': p.w, 'k': p.k, 'n': p.n}}) ELSE kept END FROM s JOIN p ON p.g = s.g AND p.rank = s.rank + 1),
f AS (SELECT g, unnest(arg_max(kept, rank)) AS q FROM s GROUP BY g) SELECT g, q.k AS k, CAST(q.n AS INTEGER) AS n FROM f""")
def suppressed(spark, sf_dir):
    return K.grouped(points(spark, sf_dir), G, ["k", "n"], lambda c: [(int(c["k"][i]), int(c["n"][i])) for i in K.suppress(c["x"], c["y"], c["w"], c["y"])], "g long, k long, n int")


@query()
def greedy_pairs(spark, sf_dir):
    def pair(c):
        left, right = np.flatnonzero(c["n"] % 2 == 0), np.flatnonzero(c["n"] % 2 == 1)
        cost = np.abs(c["y"][left][:, None] - c["y"][right][None, :])
        return [(int(c["k"][left[i]]), int(c["k"][right[j]]), float(cost[i, j])) for i, j in K.greedy_pairs(cost, 5.0)]

    return K.grouped(points(spark, sf_dir), G, ["k", "n"], pair, "g long, left_k long, right_k long, cost double")


@query(f"""WITH RECURSIVE {SERIES}, c AS (SELECT track, dense_rank() OVER (PARTITION BY track ORDER BY i // 4) - 1 AS f, y AS px, (i % 4) * 10.0::DOUBLE AS py, row_number() OVER (PARTITION BY track, i // 4 ORDER BY i) - 1 AS k FROM series),
s AS (SELECT track, -1::BIGINT AS f, px AS ax, py AS ay, NULL::BIGINT AS k FROM c WHERE f = 0 AND k = 0
    UNION ALL SELECT track, f, CASE WHEN d <= 60 THEN n.px ELSE ax END, CASE WHEN d <= 60 THEN n.py ELSE ay END, CASE WHEN d <= 60 THEN n.k END
    FROM (SELECT s.track, c.f, max(s.ax) AS ax, max(s.ay) AS ay, min(sqrt((c.px - s.ax) ** 2 + (c.py - s.ay) ** 2)) AS d, arg_min({{'px': c.px, 'py': c.py, 'k': c.k}}, (sqrt((c.px - s.ax) ** 2 + (c.py - s.ay) ** 2), c.k)) AS n FROM s JOIN c ON c.track = s.track AND c.f = s.f + 1 GROUP BY s.track, c.f))
SELECT track, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS candidate FROM s WHERE f >= 0""")
def frame_association(spark, sf_dir):
    tracks = series(spark, sf_dir).withColumn("block", F.floor(F.col("i") / 4).cast("int"))

    def run(c):
        frames = [np.c_[c["y"][c["block"] == b], c["i"][c["block"] == b] % 4 * 10.0] for b in np.unique(c["block"])]
        found = K.follow(frames, frames[0][0], 60.0)
        return [(k, v) for k, v in enumerate(found)]

    return K.grouped(tracks, ["track"], ["i"], run, "track long, frame int, candidate int")


@query("SELECT label, CAST(k AS INTEGER) AS place, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS deviation FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, k")
def vector_summary(spark, sf_dir):
    places = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    return places.groupBy("label", "place").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("deviation"))


@query(f"""WITH {SERIES}, p AS (SELECT track, i, i::DOUBLE AS x, sum(y) OVER (PARTITION BY track ORDER BY i) / 100 AS y FROM series), e AS (SELECT track, arg_min(x, i) AS xa, arg_max(x, i) AS xb, arg_min(y, i) AS ya, arg_max(y, i) AS yb, count(*) AS n FROM p GROUP BY track),
w AS (SELECT track, n, ((x - (xa + xb) / 2) * (xb - xa) + (y - (ya + yb) / 2) * (yb - ya)) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS u, ((y - (ya + yb) / 2) * (xb - xa) - (x - (xa + xb) / 2) * (yb - ya)) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS v FROM p JOIN e USING (track) WHERE n >= 5),
c AS (SELECT *, avg(u) OVER (PARTITION BY track) AS mu FROM w), m AS (SELECT track, max(n) AS n, max(mu) AS mu, sum((u - mu) ** 2) AS m2, sum((u - mu) ** 3) AS m3, sum((u - mu) ** 4) AS m4, sum((u - mu) * v) AS mv, sum((u - mu) ** 2 * v) AS mmv, avg(v) AS av, var_pop(v) * count(*) AS vv FROM c GROUP BY track),
q AS (SELECT *, m4 - m2 * m2 / n - m3 * m3 / m2 AS k, (mmv - m2 * av - m3 * mv / m2) / (m4 - m2 * m2 / n - m3 * m3 / m2) AS c2 FROM m), f AS (SELECT *, mv / m2 - c2 * m3 / m2 - 2 * c2 * mu AS c1, sqrt(greatest(0, vv - mv * mv / m2 - c2 * c2 * k) / greatest(1, n - 3)) AS sigma FROM q),
z AS (SELECT track, 2 * c2 / (1 + c1 * c1) ** 1.5 AS curve, 2 * sigma / sqrt(k) AS error FROM f)
SELECT e.track, CASE WHEN NOT (abs(curve) <= 3 * error OR abs(curve) < 1e-12) THEN round(1 / curve, 2) END AS radius, round(error, 8) AS error, coalesce(abs(curve) <= 3 * error OR abs(curve) < 1e-12, false) AS straight FROM e LEFT JOIN z USING (track)""")
def signed_arcs(spark, sf_dir):
    def arc(c):
        radius, error, straight = K.signed_arc(c["i"].astype(float), c["y"].cumsum() / 100)
        return [(None if radius is None else round(radius, 2), round(error, 8), straight)]

    return K.grouped(series(spark, sf_dir), ["track"], ["i"], arc, "track long, radius double, error double, straight boolean")
