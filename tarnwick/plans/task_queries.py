"""Quantities of further tasks: the frames of each track are dealt in turn to the objects that a task looks at."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import measures as M
from tarnwick.plans.fit_queries import CATENARY
from tarnwick.plans.measure_queries import DAY, long
from tarnwick.plans.registry import query
from tarnwick.plans.series_queries import terminal_sql
from tarnwick.plans.views import SERIES, series


def dealt(spark, sf_dir, *names: str, **columns):
    """observations of objects `names`, with further columns in place of x, y and r; v is the value, k the row's number."""
    s = series(spark, sf_dir)
    k, n = F.col("i") - 1, len(names)
    obj = F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    out = s.select(F.col("track").cast("string").alias("sample"), obj.alias("object"), F.floor(k / n).cast("int").alias("i"), (F.col("t") / DAY - 19700).alias("t"), F.col("y").alias("v"), k.alias("k"), "valid")
    given = {"x": F.col("v"), "y": F.col("v"), "r": F.lit(1.0)} | columns
    return out.withColumns({c: e.cast("double") for c, e in given.items()})


def obs(*names: str, x: str = "v", y: str = "v", r: str = "1") -> str:
    """The same in SQL."""
    n = len(names)
    return f"""{SERIES}, dealt AS (SELECT CAST(track AS VARCHAR) AS sample, {list(names)!r}[(i - 1) % {n} + 1] AS object, CAST((i - 1) // {n} AS INTEGER) AS i, t / {DAY} - 19700 AS t, y AS v, i - 1 AS k, valid FROM series),
    obs AS (SELECT sample, object, i, t, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({r})::DOUBLE AS r, valid FROM dealt)"""


def rows(source: str, **quantities: str) -> str:
    """name and value of each quantity that is not null."""
    parts = [f"SELECT sample, '{n}' AS name, round(({e})::DOUBLE, 4) AS value FROM {source} WHERE ({e}) IS NOT NULL" for n, e in quantities.items()]
    return " UNION ALL ".join(parts)


def wide(source: str, value: str, *names: str) -> str:
    return f"SELECT sample, " + ", ".join(f"max({value}) FILTER (object = '{n}') AS \"{n}\"" for n in names) + f" FROM {source} GROUP BY sample"  # noqa: F541


@query(f"""WITH {obs('left', 'right')}, n AS (SELECT *, row_number() OVER w AS at_, count(*) OVER (PARTITION BY sample, object) AS n, greatest(3, least(8, count(*) OVER (PARTITION BY sample, object) // 8)) AS head FROM obs WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
b AS (SELECT sample, object, median(y) AS base FROM n WHERE at_ <= head GROUP BY sample, object), m AS (SELECT n.sample, n.object, 1.4826 * median(abs(y - base)) AS noise FROM n JOIN b USING (sample, object) WHERE at_ <= head GROUP BY n.sample, n.object),
o AS (SELECT n.*, CASE WHEN abs(y - base) > greatest(0.01 * 640, 5 * noise, 3.0) THEN 1 ELSE 0 END AS off FROM n JOIN b USING (sample, object) JOIN m USING (sample, object)), k AS (SELECT *, off + lead(off) OVER w + lead(off, 2) OVER w AS c FROM o WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
s AS (SELECT sample, object, min(CASE WHEN at_ > head AND c = 3 THEN i END) AS onset FROM k GROUP BY sample, object), w AS (SELECT *, (SELECT count(DISTINCT i) FROM obs WHERE obs.sample = q.sample) AS frames FROM ({wide('s', 'onset', 'left', 'right')}) q)
{rows('w', onset_left='"left"', onset_right='"right"', frames='frames', both_stationary='CASE WHEN "left" IS NULL AND "right" IS NULL THEN 1 END')}""")
def measured_onsets(spark, sf_dir):
    return long(M.onsets(dealt(spark, sf_dir, "left", "right"), 640))


@query(f"""WITH {obs('a', 'b')}, m AS (SELECT *, max(y) OVER (PARTITION BY sample, object ORDER BY i) AS m FROM obs), l AS (SELECT *, lag(m) OVER w AS m0, lag(t) OVER w AS t0 FROM m WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
g AS (SELECT l.*, level FROM l CROSS JOIN (VALUES (20.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), (200.0::DOUBLE)) AS v(level)), f AS (SELECT *, row_number() OVER (PARTITION BY sample, object, level ORDER BY i) AS k FROM g WHERE m >= level),
h AS (SELECT sample, object, level, CASE WHEN m0 IS NULL THEN t ELSE t0 + CASE WHEN m > m0 THEN greatest(0, least(1, (level - m0) / (m - m0))) ELSE 0 END * (t - t0) END AS reached FROM f WHERE k = 1),
p AS (SELECT sample, level, max(reached) FILTER (object = 'a') AS a, max(reached) FILTER (object = 'b') AS b FROM h GROUP BY sample, level), q AS (SELECT sample, median(b / a) AS r, count(*) AS n FROM p WHERE a > 0 AND b IS NOT NULL GROUP BY sample)
{rows('q', time_ratio='CASE WHEN n >= 2 THEN r END')}""")
def measured_gates(spark, sf_dir):
    return long(M.descent_gates(dealt(spark, sf_dir, "a", "b"), [20, 50, 100, 200]))


@query(f"""WITH {obs('a', 'b', 'c', 'd', x='v + 1000 * (k % 4)', y='2 * v + k % 3')}, w AS (SELECT sample, i, {', '.join(f"max(x) FILTER (object = '{n}') AS {n}" for n in 'abcd')} FROM obs WHERE valid GROUP BY sample, i),
c AS (SELECT sample, (c - a) * (d - b) / nullif((c - b) * (d - a), 0) AS k FROM w), f AS (SELECT sample, i, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(y, x) AS xy FROM obs WHERE valid GROUP BY sample, i),
o AS (SELECT sample, sqrt(greatest(0, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy))) / nullif(sqrt((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy)), 0) AS off FROM f),
q AS (SELECT c.sample, CASE WHEN count(k) >= 12 AND abs(avg(k)) >= 1e-12 THEN stddev_samp(k) / abs(avg(k)) END AS cv, (SELECT avg(off) FROM o WHERE o.sample = c.sample) AS off FROM c GROUP BY c.sample)
{rows('q', cv='cv', collinearity='off')}""")
def measured_points(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return long(M.collinear_points(dealt(spark, sf_dir, "a", "b", "c", "d", x=v + 1000 * (k % 4), y=2 * v + k % 3)))


@query(f"""WITH {obs('in', 'out', 'spot', x='k', y='v / 6')}, q AS (SELECT sample, CASE WHEN count(*) FILTER (object = 'in') >= 3 THEN median(y) FILTER (object = 'in') END AS i, CASE WHEN count(*) FILTER (object = 'out') >= 3 THEN median(y) FILTER (object = 'out') END AS o,
CASE WHEN count(*) FILTER (object = 'spot') >= 3 THEN median(x) FILTER (object = 'spot') END AS d FROM obs WHERE valid GROUP BY sample) {rows('q', incident='i', refracted='o', dx='d', width='100')}""")
def measured_rays(spark, sf_dir):
    seen = dealt(spark, sf_dir, "in", "out", "spot", x=F.col("k"), y=F.col("v") / 6)
    return long(M.medians(seen, {"incident": ("in", "y"), "refracted": ("out", "y"), "dx": ("spot", "x")}, width=100.0))


@query(f"""WITH {obs('l1', 'l2', 'l3', 'l4', 'l5', x='cos(k)', y='sin(k)', r='v')}, s AS (SELECT sample, i, count(*) AS n, sum(x * x) AS aa, sum(x * y) AS ab, sum(y * y) AS bb, sum(x * r) AS ac, sum(y * r) AS bc, sum(r * r) AS cc FROM obs WHERE valid GROUP BY sample, i),
p AS (SELECT *, (ac * bb - bc * ab) / nullif(aa * bb - ab * ab, 0) AS px, (aa * bc - ab * ac) / nullif(aa * bb - ab * ab, 0) AS py FROM s WHERE n >= 3), m AS (SELECT *, sqrt(greatest(0, cc - px * ac - py * bc) / n) AS rms FROM p WHERE px IS NOT NULL),
q AS (SELECT sample, median(rms) AS rms, (stddev_pop(px) + stddev_pop(py)) / 2 AS sd FROM m GROUP BY sample) {rows('q', line_rms='rms', mean_sd='sd', diagonal='800')}""")
def measured_shadows(spark, sf_dir):
    k = F.col("k")
    return long(M.shadow_lines(dealt(spark, sf_dir, "l1", "l2", "l3", "l4", "l5", x=F.cos(k), y=F.sin(k), r=F.col("v")), 800.0))


@query(f"""WITH {obs('r1', 'r2', 'r3', x='10 + v / 10', y='8 + (v / 10 + k % 3) / 1.4')}, f AS (SELECT sample, i, count(*) AS n, stddev_pop(sin(radians(x)) / sin(radians(y))) / avg(sin(radians(x)) / sin(radians(y))) AS cv FROM obs WHERE valid GROUP BY sample, i),
b AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, i) AS k FROM f), q AS (SELECT * FROM b WHERE k = 1) {rows('q', estimates='n', index_cv='cv')}""")
def measured_indices(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return long(M.ray_indices(dealt(spark, sf_dir, "r1", "r2", "r3", x=10 + v / 10, y=8 + (v / 10 + k % 3) / 1.4)))


@query(f"""WITH {obs('top', 'bottom', 'left', 'right', y='CASE k % 4 WHEN 0 THEN 600 + v WHEN 1 THEN v / 5 ELSE 500 + v / 4 END')}, w AS (SELECT sample, i, {', '.join(f"max(y) FILTER (object = '{n}') AS {a}" for n, a in (('top', 'a'), ('bottom', 'b'), ('left', 'l'), ('right', 'r')))} FROM obs WHERE valid GROUP BY sample, i),
h AS (SELECT sample, ((l + r) / 2 - b) / nullif(a - b, 0) AS h, abs(l - r) AS d FROM w), q AS (SELECT sample, median(h) AS h, median(d) AS d FROM h WHERE h > 0 AND h < 1 GROUP BY sample) {rows('q', submerged='h', dy='d', width='50')}""")
def measured_ice(spark, sf_dir):
    v = F.col("v")
    y = F.when(F.col("k") % 4 == 0, 600 + v).when(F.col("k") % 4 == 1, v / 5).otherwise(500 + v / 4)
    return long(M.ice_column(dealt(spark, sf_dir, "top", "bottom", "left", "right", y=y), 50.0))


@query(f"""WITH {obs('level')}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) AS k, count(*) OVER (PARTITION BY sample) AS n FROM obs WHERE valid), s AS (SELECT *, greatest(5, least(12, n // 8)) AS s FROM k),
h AS (SELECT sample, median(y) FILTER (k <= s) AS head, median(y) FILTER (k > n - s) AS tail FROM s GROUP BY sample), m AS (SELECT s.sample, 1.4826 * median(abs(y - head)) FILTER (k <= s) AS noise FROM s JOIN h USING (sample) GROUP BY s.sample),
q AS (SELECT sample, tail - head AS change, greatest(0.5, 3 * noise) AS u FROM h JOIN m USING (sample)) {rows('q', change='change', rise='change', uncertainty='u')}""")
def measured_changes(spark, sf_dir):
    return long(M.level_change(dealt(spark, sf_dir, "level"), 0.5))


@query(f"""WITH {obs('magnet', 'lamp', y="CASE WHEN k % 2 = 0 THEN v - 250 ELSE v END")}, mg AS (SELECT *, valid AND abs(y) <= 150 AS f FROM obs WHERE object = 'magnet'), mr AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) - row_number() OVER (PARTITION BY sample, f ORDER BY i) AS g FROM mg),
e AS (SELECT DISTINCT sample FROM (SELECT sample, g FROM mr WHERE f GROUP BY sample, g HAVING max(t) - min(t) >= 3 - 1e-9)), l AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) AS k FROM obs WHERE object = 'lamp' AND valid),
b AS (SELECT sample, median(y) AS base FROM l WHERE k <= 8 GROUP BY sample), n AS (SELECT l.sample, max(base) AS base, 1.4826 * median(abs(y - base)) AS noise FROM l JOIN b USING (sample) WHERE k <= 8 GROUP BY l.sample), z AS (SELECT l.*, y > base + greatest(1, 5 * noise) AS f FROM l JOIN n USING (sample)),
zr AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) - row_number() OVER (PARTITION BY sample, f ORDER BY i) AS g FROM z), s AS (SELECT DISTINCT sample FROM (SELECT sample, g FROM zr WHERE f GROUP BY sample, g HAVING max(t) - min(t) >= 3 - 1e-9)),
q AS (SELECT obs.sample, CASE WHEN bool_or(object = 'magnet' AND valid) THEN CASE WHEN obs.sample IN (SELECT sample FROM e) THEN 1 ELSE 0 END END AS entered, CASE WHEN bool_or(object = 'lamp' AND valid) THEN CASE WHEN obs.sample IN (SELECT sample FROM s) THEN 1 ELSE 0 END END AS lit FROM obs GROUP BY obs.sample)
{rows('q', entered='entered', lit='lit')}""")
def measured_entries(spark, sf_dir):
    v = F.col("v")
    return long(M.entry_and_light(dealt(spark, sf_dir, "magnet", "lamp", y=F.when(F.col("k") % 2 == 0, v - 250).otherwise(v)), 150.0, 3.0))


@query(f"WITH {obs('needle')}, q AS (SELECT sample, median(y) AS y, count(*) AS n FROM obs WHERE valid AND i > (SELECT max(i) FROM obs o WHERE o.sample = obs.sample) - 5 GROUP BY sample) {rows('q', direction='CASE WHEN n >= 2 THEN y END')}")
def measured_directions(spark, sf_dir):
    return long(M.final_direction(dealt(spark, sf_dir, "needle")))


@query(f"""WITH {obs('open', 'closed')}, v AS (SELECT * FROM obs WHERE valid), p AS (SELECT sample, object, max(y) AS top, arg_min(i, -y) AS frame FROM v GROUP BY sample, object), o AS (SELECT v.*, top, frame, abs(y - top) > 60 AS off FROM v JOIN p USING (sample, object)),
e AS (SELECT sample, object, max(i) FILTER (off AND i < frame) AS lo, min(i) FILTER (off AND i > frame) AS hi, max(t) FILTER (i = frame) AS tp FROM o GROUP BY sample, object),
x AS (SELECT o.sample, o.object, max(top) AS top, coalesce(max(t) FILTER (i > coalesce(lo, -1) AND i < coalesce(hi, 2147483647)) - min(t) FILTER (i > coalesce(lo, -1) AND i < coalesce(hi, 2147483647)) >= 1, false) OR bool_or(t > tp AND y < top - 180) AS fine FROM o JOIN e USING (sample, object) GROUP BY o.sample, o.object),
w AS ({wide('x', 'CASE WHEN fine THEN greatest(0, top) END', 'open', 'closed')}) {rows('w', h_open='"open"', h_closed='closed')}""")
def measured_heights(spark, sf_dir):
    return long(M.peak_heights(dealt(spark, sf_dir, "open", "closed"), 60.0, 1.0))


@query(f"""WITH {obs('small_left', 'small_right', 'large_left', 'large_right')}, k AS (SELECT *, row_number() OVER (PARTITION BY sample, object ORDER BY i DESC) AS k FROM obs WHERE valid), m AS (SELECT sample, object, median(y) AS y FROM k WHERE k <= 12 GROUP BY sample, object),
w AS ({wide('m', 'y', 'small_left', 'small_right', 'large_left', 'large_right')})
{rows('w', angle_small='(small_left + small_right) / 2', angle_large='(large_left + large_right) / 2', asymmetry='CASE WHEN abs(small_left - small_right) IS NULL THEN abs(large_left - large_right) WHEN abs(large_left - large_right) IS NULL THEN abs(small_left - small_right) ELSE greatest(abs(small_left - small_right), abs(large_left - large_right)) END')}""")
def measured_piles(spark, sf_dir):
    return long(M.pile_angles(dealt(spark, sf_dir, "small_left", "small_right", "large_left", "large_right")))


@query(f"""WITH {obs('ball', y='v - 60')}, r AS (SELECT *, i - row_number() OVER (PARTITION BY sample, y > 0 ORDER BY i) AS g, max(i) OVER (PARTITION BY sample) AS n FROM obs),
a AS (SELECT sample, min(i) AS lo, max(i) AS hi, max(y) AS h FROM r WHERE y > 0 GROUP BY sample, g HAVING count(*) >= 3 AND min(i) > 0 AND max(i) < max(n)), d AS (SELECT a.sample, a.lo, a.h, max(t) FILTER (i = hi + 1) - max(t) FILTER (i = lo - 1) AS d FROM a JOIN obs USING (sample) GROUP BY a.sample, a.lo, a.hi, a.h),
s AS (SELECT *, h / lag(h) OVER w AS ratio, d / lag(d) OVER w AS dd FROM d WINDOW w AS (PARTITION BY sample ORDER BY lo)),
q AS (SELECT sample, count(*) AS n, avg(abs(sqrt(ratio) - dd)) AS ht, avg(greatest(0, sqrt(ratio) - 1)) FILTER (ratio IS NOT NULL) AS pe, avg(greatest(0, ratio - 1)) FILTER (ratio IS NOT NULL) AS hr, stddev_samp(sqrt(ratio)) / avg(sqrt(ratio)) AS cv FROM s GROUP BY sample)
{rows('q', height_time='ht', passive_excess='pe', height_rise='hr', cor_cv='CASE WHEN n > 2 THEN cv END', single_motion='CASE WHEN n = 1 THEN 1 END')}""")
def measured_bounces(spark, sf_dir):
    return long(M.bounces(dealt(spark, sf_dir, "ball", y=F.col("v") - 60)))


@query(f"""WITH {SERIES}, {CATENARY}, e AS (SELECT track, max(y) - min(y) AS sag, max(x) - min(x) AS span, abs(arg_max(y, x) - arg_min(y, x)) AS dy FROM c GROUP BY track), q AS (SELECT CAST(track AS VARCHAR) AS sample, e AS rmse, sag, span, dy FROM k JOIN e USING (track) WHERE k = 1)
{rows('q', rmse='rmse', sag='sag', span='span', support_dy='dy')}""")
def measured_chains(spark, sf_dir):
    chain = dealt(spark, sf_dir, "chain", x=F.col("k") + 1).filter("valid")
    return long(M.hanging_chain(chain, width=100))


@query(f"""WITH {obs('a', 'b')}, c AS (SELECT sample, i, count(*) AS n FROM obs WHERE valid GROUP BY sample, i), f AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY sample ORDER BY i) - 1 AS at_, count(*) OVER (PARTITION BY sample) AS m FROM c),
s AS (SELECT *, sum(f) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS run, avg(f) OVER w AS pure, last_value(f) OVER w AS final FROM f WINDOW w AS (PARTITION BY sample ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT sample, min(CASE WHEN run = 6 AND pure >= 0.8 AND final = 1 AND at_ < m - 6 THEN i END) AS merged FROM s GROUP BY sample), r AS (SELECT obs.sample, CASE WHEN i >= merged THEN 'final' ELSE object END AS object, median(r) AS r FROM obs JOIN g USING (sample) WHERE valid GROUP BY 1, 2),
w AS ({wide('r', 'r', 'a', 'b', 'final')}) {rows('w', r1='a', r2='b', r_final='final')}""".replace("AS r, valid FROM dealt", "AS r, valid AND (k % 2 = 0 OR k < 30) AS valid FROM dealt").replace("({r})", "(v)").replace("(1)::DOUBLE AS r", "(v)::DOUBLE AS r"))
def measured_droplets(spark, sf_dir):
    seen = dealt(spark, sf_dir, "a", "b", r=F.col("v")).withColumn("valid", F.col("valid") & ((F.col("k") % 2 == 0) | (F.col("k") < 30)))
    return long(M.droplets(seen))


@query(terminal_sql(f"""{obs('large', 'small')}, p AS (SELECT sample || object AS track, i, t, sum(y) OVER (PARTITION BY sample, object ORDER BY i) AS y, sample, object FROM obs)""", 3.0, 0.3) + """, top AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(span, 9) DESC, a) AS k FROM found),
d AS (SELECT DISTINCT track, sample, object FROM p), u AS (SELECT sample, object, v FROM top JOIN d USING (track) WHERE k = 1)
SELECT sample, CASE object WHEN 'large' THEN 'v1' ELSE 'v2' END AS name, round(v, 4) AS value FROM u UNION ALL SELECT sample, CASE object WHEN 'large' THEN 'r1' ELSE 'r2' END, 5.0 FROM u""")
def measured_settling(spark, sf_dir):
    from pyspark.sql import Window

    way = F.sum("v").over(Window.partitionBy("sample", "object").orderBy("i"))
    falls = dealt(spark, sf_dir, "large", "small").withColumns({"y": way, "r": F.lit(5.0), "valid": F.lit(True)})
    return long(M.settling(falls, seconds=3.0, change=0.3, diameters=1.0, snr=3.0))


def parabola_sql(name: str, source: str, v: str, u: str = "i") -> str:
    """q (the quadratic coefficient over u) and rms of the parabola of a column, by moments about the middle, as a table."""
    return f"""{name} AS (SELECT sample, q, sqrt(greatest(0, vv - mv * mv / m2 - q * q * (m4 - m2 * m2 / n - m3 * m3 / m2)) / n) AS rms FROM (SELECT *, (mmv - m2 * my - m3 * mv / m2) / (m4 - m2 * m2 / n - m3 * m3 / m2) AS q FROM
    (SELECT sample, count(*) AS n, sum(u ** 2) AS m2, sum(u ** 3) AS m3, sum(u ** 4) AS m4, sum(u * w) AS mv, sum(u * u * w) AS mmv, avg(w) AS my, var_pop(w) * count(*) AS vv FROM (SELECT sample, {u} - avg({u}) OVER (PARTITION BY sample) AS u, {v} AS w FROM {source}) GROUP BY sample)))"""


@query(f"""WITH {obs('ball', 'surface', x='k // 2 + v / 200', y='CASE WHEN k % 2 = 0 THEN k * k / 8.0 + v / 20 ELSE 300 + k / 10.0 + v / 50 END')}, ball AS (SELECT *, i - row_number() OVER (PARTITION BY sample, valid ORDER BY i) AS g FROM obs WHERE object = 'ball'),
runs AS (SELECT sample, min(i) AS a, max(i) AS b, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, min(i)) AS k FROM ball WHERE valid GROUP BY sample, g), seen AS (SELECT ball.* FROM ball JOIN runs ON runs.sample = ball.sample AND runs.k = 1 AND i BETWEEN a AND b),
st AS (SELECT *, row_number() OVER w - 1 AS at_, count(*) OVER (PARTITION BY sample) AS n, abs(lead(y) OVER w - y) AS d FROM seen WINDOW w AS (PARTITION BY sample ORDER BY i)), sm AS (SELECT *, CASE WHEN n - 1 >= 5 THEN sum(d) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE d END AS s FROM st WHERE at_ < n - 1),
mv AS (SELECT sample, coalesce(min(at_) FILTER (s > 0.15 * p AND n >= 4), 0) AS start FROM (SELECT *, max(s) OVER (PARTITION BY sample) AS p FROM sm) GROUP BY sample), f AS (SELECT sample, min(i) AS first, arg_min(i, (-y, i)) AS low FROM seen GROUP BY sample),
fall AS (SELECT seen.* FROM seen JOIN mv USING (sample) JOIN f USING (sample) WHERE i >= first + start AND i <= greatest(low, first + start + 3)), size AS (SELECT sample FROM fall GROUP BY sample HAVING count(*) >= 12 AND arg_max(y, i) - arg_min(y, i) >= 25),
{parabola_sql('px', 'fall', 'x')}, {parabola_sql('py', 'fall', 'y')}, sf AS (SELECT sample, regr_slope(y, x) AS tilt, sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)) AS rms FROM obs WHERE object = 'surface' AND valid GROUP BY sample),
fits AS (SELECT size.sample, px.q AS ax, py.q AS ay, py.rms AS path FROM size JOIN px USING (sample) JOIN py USING (sample)), q AS (SELECT sample, ax, ay, path, tilt, rms AS srms FROM fits FULL JOIN sf USING (sample))
{rows('q', angle='CASE WHEN 2 * sqrt(ax * ax + ay * ay) >= 1e-3 THEN degrees(acos(least(1, abs(ax + ay * tilt) / (sqrt(ax * ax + ay * ay) * sqrt(1 + tilt * tilt))))) END', surface_rms='srms', path_rms='path')}""")
def measured_surfaces(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    seen = dealt(spark, sf_dir, "ball", "surface", x=F.floor(k / 2) + v / 200, y=F.when(k % 2 == 0, k * k / 8.0 + v / 20).otherwise(300 + k / 10.0 + v / 50))
    return long(M.liquid_surface(seen))


FLIGHT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY sample) AS n FROM obs WHERE valid),
top AS (SELECT sample, arg_max(j, (y, -j)) AS top, arg_min(y, j) AS y0, arg_min(x, j) AS x0, max(y) AS high, max(n) AS n FROM r GROUP BY sample), back AS (SELECT r.sample, min(j) AS k FROM r JOIN top USING (sample) WHERE j >= greatest(1, top) AND y <= y0 GROUP BY r.sample),
land AS (SELECT top.sample, y0, x0, high, top.n, k, coalesce(k + 1, top.n) AS stop, max(r.x) FILTER (j = top) - x0 AS apex_x, max(r.x) FILTER (j = k - 1) AS xa, max(r.x) FILTER (j = k) AS xb, max(r.y) FILTER (j = k - 1) AS ya, max(r.y) FILTER (j = k) AS yb
    FROM top LEFT JOIN back USING (sample) JOIN r USING (sample) GROUP BY top.sample, y0, x0, high, top.n, k, top),
way AS (SELECT *, CASE WHEN k IS NOT NULL THEN xa + (xb - xa) * CASE WHEN ya > yb THEN (ya - y0) / (ya - yb) ELSE 0 END - x0 END AS reach, greatest(8, stop // 6) AS every FROM land), path AS (SELECT r.* FROM r JOIN way USING (sample) WHERE j < stop)"""


@query(f"""WITH {obs('ball', x='3 * k + v / 100', y='20 * k - 0.35 * k * k + v / 100')}, {FLIGHT}, {parabola_sql('fit', 'path', 'y', 't')},
e AS (SELECT r.sample, j, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS vx, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS vy FROM r JOIN way USING (sample) WHERE j < stop AND j % every = 0 AND stop > 3 * every WINDOW w AS (PARTITION BY r.sample ORDER BY j)),
d AS (SELECT *, vy - lag(vy) OVER (PARTITION BY sample ORDER BY j) AS dvy FROM e), c AS (SELECT sample, CASE WHEN count(vx) > 1 AND abs(avg(vx)) > 1e-12 THEN stddev_samp(vx) / abs(avg(vx)) END AS cx, CASE WHEN count(dvy) > 1 AND abs(avg(dvy)) > 1e-12 THEN stddev_samp(dvy) / abs(avg(dvy)) END AS cy FROM d GROUP BY sample),
q AS (SELECT way.sample, high - y0 AS height, reach, CASE WHEN k IS NULL THEN apex_x END AS apex, cx, cy, rms / abs(nullif(coalesce(reach, 2 * apex_x), 0)) AS off FROM way JOIN fit USING (sample) LEFT JOIN c USING (sample) WHERE way.n >= 16)
{rows('q', height='height', range='reach', apex_x='apex', cv_vx='cx', cv_dvy='cy', rms_over_range='off')}""")
def measured_flights(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return long(M.projectile(dealt(spark, sf_dir, "ball", x=3 * k + v / 100, y=20 * k - 0.35 * k * k + v / 100)))


@query(f"""WITH {obs('ball', x='k * k / 4.0 + v / 21', y='k * k / 10.0 + v / 30', r='2 + k % 3')}, n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) AS j, count(*) OVER (PARTITION BY sample) AS n, t - lag(t) OVER (PARTITION BY sample ORDER BY i) AS dt FROM obs),
c AS (SELECT a.sample, a.j AS m, sum(w.x * (w.j - a.j)) / 28 AS x1, sum(w.x * ((w.j - a.j) ** 2 - 4)) / 84 AS x2, sum(w.y * (w.j - a.j)) / 28 AS y1, sum(w.y * ((w.j - a.j) ** 2 - 4)) / 84 AS y2 FROM n a JOIN n w ON a.sample = w.sample AND w.j BETWEEN a.j - 3 AND a.j + 3 WHERE a.j BETWEEN 4 AND a.n - 3 GROUP BY a.sample, a.j),
p AS (SELECT sample, j, greatest(4, least(n - 3, j)) AS m, j - greatest(4, least(n - 3, j)) AS u FROM n WHERE n >= 7), z AS (SELECT sample, median(dt) AS step, median(r) AS r FROM n GROUP BY sample),
s AS (SELECT p.sample, abs(x1 + 2 * x2 * u) / step AS v, abs(y1 + 2 * y2 * u) / step AS w, r FROM p JOIN c USING (sample, m) JOIN z USING (sample)), f AS (SELECT *, max(v) OVER (PARTITION BY sample) AS top FROM s),
q AS (SELECT sample, median(abs(v - w * r) / v) AS slip FROM f WHERE v > 0.15 * top AND top > 0 GROUP BY sample), d AS (SELECT sample, sum(abs(dx)) AS way, sum(abs(dy)) AS turned FROM (SELECT sample, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM n WINDOW w AS (PARTITION BY sample ORDER BY j)) GROUP BY sample),
o AS (SELECT q.sample, slip, way, turned, r FROM q JOIN d USING (sample) JOIN z USING (sample)) {rows('o', way='way', turned='turned', radius='r', slip='slip')}""")
def measured_rolling(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return long(M.rolling(dealt(spark, sf_dir, "ball", x=k * k / 4.0 + v / 21, y=k * k / 10.0 + v / 30, r=2 + k % 3)))


#: confirmed: the frame at which each piece of ice is confirmed to shrink, band after band, in the first run of frames that shows it.
MELTING = """ice AS (SELECT sample, object, i, CASE WHEN valid THEN y END AS a, row_number() OVER w AS at_, count(*) OVER (PARTITION BY sample, object) AS n FROM obs WHERE object IN ('left_ice', 'right_ice') WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
base AS (SELECT sample, object, median(a) AS base FROM ice WHERE at_ <= greatest(3, least(12, n // 8)) GROUP BY sample, object), z AS (SELECT ice.*, lag(a) OVER w AS p FROM ice WINDOW w AS (PARTITION BY sample, object ORDER BY i)),
cut AS (SELECT *, sum(CASE WHEN a > 0 AND p > 0 AND abs(a - p) <= greatest(0.35 * least(a, p), 3.5 * sqrt(least(a, p))) THEN 0 ELSE 1 END) OVER (PARTITION BY sample, object ORDER BY i) AS run FROM z),
raw AS (SELECT sample, object, run, i, a / base AS r, row_number() OVER w AS j, lag(a / base) OVER w AS l, lead(a / base) OVER w AS f FROM cut JOIN base USING (sample, object) WHERE a > 0 AND base > 0 WINDOW w AS (PARTITION BY sample, object, run ORDER BY i)),
sm AS (SELECT *, list_sort([coalesce(l, r), r, coalesce(f, r)])[2] AS s FROM raw), st AS (SELECT *, s - lag(s) OVER (PARTITION BY sample, object, run ORDER BY j) AS d FROM sm),
ok AS (SELECT sample, object, run FROM st GROUP BY sample, object, run HAVING count(*) >= 8 AND arg_min(r, j) BETWEEN 0.75 AND 1.25 AND arg_min(s, j) - min(s) >= 0.3 AND min(s) <= 0.72 AND avg(CASE WHEN d <= 0.035 THEN 1 ELSE 0 END) FILTER (d IS NOT NULL) >= 0.7 AND max(d) <= 0.12),
b AS (SELECT sample, object, run, i, j, min(s) OVER two >= 0.8 AND max(s) OVER two < 0.95 AND j >= 2 AS b1, min(s) OVER two >= 0.65 AND max(s) OVER two < 0.8 AND j >= 2 AS b2, min(s) OVER four >= 0 AND max(s) OVER four < 0.7 AND j >= 4 AS b3 FROM st JOIN ok USING (sample, object, run)
    WINDOW two AS (PARTITION BY sample, object, run ORDER BY j ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), four AS (PARTITION BY sample, object, run ORDER BY j ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
e1 AS (SELECT sample, object, run, min(j) FILTER (b1) AS e1 FROM b GROUP BY sample, object, run), e2 AS (SELECT b.sample, b.object, b.run, max(e1) AS e1, min(j) FILTER (b2 AND j - 1 > coalesce(e1, 0)) AS e2 FROM b JOIN e1 USING (sample, object, run) GROUP BY b.sample, b.object, b.run),
e3 AS (SELECT b.sample, b.object, b.run, max(e1) AS e1, max(e2) AS e2, min(j) FILTER (b3 AND j - 3 > coalesce(e2, e1, 0)) AS e3 FROM b JOIN e2 USING (sample, object, run) GROUP BY b.sample, b.object, b.run),
found AS (SELECT *, coalesce(e3, e2) AS last FROM e3 WHERE (e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT >= 2), confirmed AS (SELECT f.sample, f.object, arg_min(b.i, f.run) AS frame FROM found f JOIN b ON b.sample = f.sample AND b.object = f.object AND b.run = f.run AND b.j = f.last GROUP BY f.sample, f.object)"""


@query(f"""WITH {obs('left', 'right', 'left_ice', 'right_ice', y='CASE WHEN k % 4 < 2 THEN 0.05 + v / 700 + k % 2 / 20.0 ELSE 1000 * exp(-(k // 4) / 10.0) + v / 20 END').replace(f't / {DAY} - 19700 AS t', '((i - 1) // 4) / 8.0::DOUBLE AS t').replace('i - 1 AS k, valid', "i - 1 AS k, valid OR (i - 1) % 4 > 1 AS valid")}, {MELTING},
m AS (SELECT sample, max(frame) AS melting FROM confirmed GROUP BY sample HAVING count(*) = 2), w AS (SELECT sample, i, max(CASE WHEN i >= melting AND y > 0.06 AND y < 1 THEN y END) FILTER (object = 'right') - max(CASE WHEN i >= melting AND y > 0.06 AND y < 1 THEN y END) FILTER (object = 'left') AS d
    FROM obs JOIN m USING (sample) WHERE valid AND object IN ('left', 'right') GROUP BY sample, i),
f AS (SELECT *, coalesce(d > 0.02, false) AS up, d IS NOT NULL AS seen FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY i) - row_number() OVER (PARTITION BY sample, up ORDER BY i) AS gu, row_number() OVER (PARTITION BY sample ORDER BY i) - row_number() OVER (PARTITION BY sample, seen ORDER BY i) AS gs FROM f),
q AS (SELECT s.sample, (SELECT max(c) FROM (SELECT count(*) AS c FROM r WHERE r.sample = s.sample AND up GROUP BY gu)) AS u, (SELECT max(c) FROM (SELECT count(*) AS c FROM r WHERE r.sample = s.sample AND seen GROUP BY gs)) AS j FROM (SELECT DISTINCT sample FROM w) s)
{rows('q', lead='CASE WHEN u >= 3 THEN 1 WHEN j >= 5 THEN 0 END')}""")
def measured_leads(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    y = F.when(k % 4 < 2, 0.05 + v / 700 + k % 2 / 20).otherwise(1000 * F.exp(-F.floor(k / 4) / 10) + v / 20)
    seen = dealt(spark, sf_dir, "left", "right", "left_ice", "right_ice", y=y, t=F.floor(k / 4) / 8).withColumn("valid", F.col("valid") | (k % 4 > 1))
    return long(M.level_lead(seen, 0.02, 8, 0.06))


@query(f"""WITH {obs('ball30', 'ball60', x='(3 + k % 2) * (k // 2) + v / 100', y='(20 + 4 * (k % 2)) * (k // 2) - 0.8 * (k // 2) * (k // 2) + v / 100', r='4 + k % 3').replace('obs AS (SELECT sample, object, i', "obs AS (SELECT sample || '/' || object AS sample, i").replace('r, valid FROM dealt', 'r, true AS valid FROM dealt')}, {FLIGHT},
g AS (SELECT path.sample, t - avg(t) OVER w AS u, min(t) OVER w - avg(t) OVER w AS u0, t, x, y FROM path JOIN way USING (sample) WHERE k IS NOT NULL AND way.n >= 8 WINDOW w AS (PARTITION BY path.sample)),
m AS (SELECT sample, count(*) AS n, max(u0) AS u0, sum(u ** 2) AS m2, sum(u ** 3) AS m3, sum(u ** 4) AS m4, sum(u * y) AS mv, sum(u * u * y) AS mmv, avg(y) AS my, var_pop(y) * count(*) AS vv, regr_slope(x, t) AS vx FROM g GROUP BY sample),
z AS (SELECT *, (mmv - m2 * my - m3 * mv / m2) / (m4 - m2 * m2 / n - m3 * m3 / m2) AS q FROM m), f AS (SELECT sample, sqrt(greatest(0, vv - mv * mv / m2 - q * q * (m4 - m2 * m2 / n - m3 * m3 / m2)) / n) AS rms, sqrt(vx ** 2 + (mv / m2 - q * m3 / m2 + 2 * q * u0) ** 2) AS speed FROM z),
o AS (SELECT split_part(f.sample, '/', 1) AS sample, split_part(f.sample, '/', 2) AS object, reach, rms / (2 * (SELECT median(r) FROM obs WHERE obs.sample = f.sample)) AS e, speed FROM f JOIN way USING (sample)),
q AS (SELECT sample, max(reach) FILTER (object = 'ball30') AS r30, max(reach) FILTER (object = 'ball60') AS r60, max(e) FILTER (object = 'ball30') AS e30, max(e) FILTER (object = 'ball60') AS e60, abs(max(speed) FILTER (object = 'ball30') / max(speed) FILTER (object = 'ball60') - 1) AS gap FROM o GROUP BY sample HAVING count(*) = 2)
{rows('q', r30='r30', r60='r60', rmse30='e30', rmse60='e60', speed_error='gap')}""")
def measured_throws(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    j = F.floor(k / 2)
    return long(M.two_flights(dealt(spark, sf_dir, "ball30", "ball60", x=(3 + k % 2) * j + v / 100, y=(20 + 4 * (k % 2)) * j - 0.8 * j * j + v / 100, r=4 + k % 3)))


@query(f"""WITH {obs('c0', 'c1', 'c2', 'c3', x="100 + CASE WHEN k % 4 IN (0, 3) THEN -20 ELSE 0 END + v / 50", y="CASE WHEN k % 4 < 2 THEN 140 ELSE 200 END - (k // 4) * (k % 4) + v / 40", r='0.1 + k % 7 / 10.0').replace('valid FROM dealt', 'valid OR k % 5 > 0 AS valid FROM dealt').replace(f't / {DAY} - 19700 AS t', '((i - 1) // 4) / 8.0::DOUBLE AS t')},
f AS (SELECT sample, i, max(t) AS t, max(r) AS r, {', '.join(f"max({c}) FILTER (valid AND object = 'c{n}') AS {c}{n}" for n in range(4) for c in 'xy')} FROM obs GROUP BY sample, i),
w AS (SELECT * FROM f WHERE {' AND '.join(f'x{n} IS NOT NULL' for n in range(4))}), g AS (SELECT *, sum(CASE WHEN i - p <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY sample ORDER BY i) AS p FROM w)),
l AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY sample, g) >= 4 AND max(t) OVER (PARTITION BY sample, g) - min(t) OVER (PARTITION BY sample, g) >= 0.3 - 1e-9),
e AS (SELECT *, {', '.join(f'sqrt((x{n} - x{(n + 1) % 4}) ** 2 + (y{n} - y{(n + 1) % 4}) ** 2) AS e{n}' for n in range(4))}, sqrt((x0 - x2) ** 2 + (y0 - y2) ** 2) AS d, degrees(atan2(x0 + x1 - x2 - x3, y2 + y3 - y0 - y1)) AS lean FROM l),
b AS (SELECT sample, {', '.join(f'arg_min({c}, i) AS {c}' for c in ('x2', 'y2', 'd', 'e0', 'e1', 'e2', 'e3'))} FROM e GROUP BY sample),
c AS (SELECT e.sample, quantile_cont(sqrt((e.x2 - b.x2) ** 2 + (e.y2 - b.y2) ** 2), 0.95) AS drift, quantile_cont(abs(e.y2 - 200), 0.95) AS off, quantile_cont(greatest({', '.join(f'abs(e.e{n} / b.e{n} - 1)' for n in range(4))}), 0.95) AS st, 2 * greatest(0.5, quantile_cont(r, 0.95)) AS tw, max(b.d) AS d, greatest(1, least({', '.join(f'max(b.e{n})' for n in range(4))})) AS s FROM e JOIN b USING (sample) GROUP BY e.sample),
t AS (SELECT sample, g, lean - lag(lean) OVER w AS s, i FROM e WINDOW w AS (PARTITION BY sample, g ORDER BY i)), u AS (SELECT sample, g, sum(coalesce(s - 360 * floor((s + 180) / 360), 0)) OVER (PARTITION BY sample, g ORDER BY i) AS u FROM t),
v AS (SELECT sample, max(r) AS turn FROM (SELECT sample, g, max(u) - min(u) AS r FROM u GROUP BY sample, g) GROUP BY sample), q AS (SELECT c.*, turn FROM c JOIN v USING (sample) WHERE d >= 10)
{rows('q', rotation='turn', pivot='greatest(0, drift - tw) / d', contact='greatest(0, off - tw) / d', shape='greatest(0, st - tw / s)')}""")
def measured_topples(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    x = 100 + F.when((k % 4).isin(0, 3), -20).otherwise(0) + v / 50
    y = F.when(k % 4 < 2, 140).otherwise(200) - F.floor(k / 4) * (k % 4) + v / 40
    seen = dealt(spark, sf_dir, "c0", "c1", "c2", "c3", x=x, y=y, r=0.1 + k % 7 / 10, t=F.floor(k / 4) / 8).withColumn("valid", F.col("valid") | (k % 5 > 0))
    return long(M.toppling(seen, (0.0, 200.0, 400.0, 200.0)))


@query(f"""WITH {obs('ball', x='v', y='k * k + v / 40').replace(f't / {DAY} - 19700 AS t', '(i - 1) / 8.0::DOUBLE AS t')}, n AS (SELECT sample, t, y, row_number() OVER w AS j, count(*) OVER (PARTITION BY sample) AS n FROM obs WINDOW w AS (PARTITION BY sample ORDER BY i)),
z AS (SELECT sample, max(n) AS n, max(t) AS t1, min(t) AS t0, arg_max(y, j) - arg_min(y, j) AS way FROM n GROUP BY sample HAVING max(n) >= 5), u AS (SELECT n.sample, j, y, (t - (t0 + t1) / 2) / ((t1 - t0) / 2) AS u FROM n JOIN z USING (sample)),
m AS (SELECT sample, count(*)::DOUBLE AS n, sum(u * u) AS a, sum(u ** 4) AS b, sum(u ** 6) AS c, sum(y) AS y0, sum(u * y) AS y1, sum(u * u * y) AS y2, sum(u ** 3 * y) AS y3 FROM u GROUP BY sample),
c AS (SELECT sample, (y0 * b - y2 * a) / (n * b - a * a) AS c0, (y1 * c - y3 * b) / (a * c - b * b) AS c1, (y2 * n - y0 * a) / (n * b - a * a) AS c2, (y3 * a - y1 * b) / (a * c - b * b) AS c3 FROM m),
o AS (SELECT u.sample, y - c0 - c1 * u - c2 * u * u - c3 * u ** 3 AS o FROM u JOIN c USING (sample)), d AS (SELECT sample, greatest(0.25, 1.4826 * median(abs(o - med))) AS noise FROM (SELECT *, median(o) OVER (PARTITION BY sample) AS med FROM o) GROUP BY sample),
s AS (SELECT sample, noise, t0, t1, least(6, greatest(3, (n - 1) // 2)) AS k FROM z JOIN d USING (sample) WHERE way >= greatest(6, 6 * noise)),
cuts AS (SELECT sample, noise, t0 + (t1 - t0) * e / k AS t, e, false AS third, k FROM s, range(7) r(e) WHERE e <= k UNION ALL SELECT sample, noise, t0 + (t1 - t0) * e / 3, e, true, 3 FROM s, range(4) r(e)),
y AS (SELECT a.sample, third, e, k, noise, max(p.y + (q.y - p.y) * greatest(0, least(1, (a.t - p.t) / (q.t - p.t)))) FILTER (a.t BETWEEN p.t - 1e-12 AND q.t + 1e-12) AS y FROM cuts a JOIN n p USING (sample) JOIN n q ON q.sample = p.sample AND q.j = p.j + 1 GROUP BY ALL),
w AS (SELECT *, y - lag(y) OVER (PARTITION BY sample, third ORDER BY e) AS w FROM y), g AS (SELECT *, w - lag(w) OVER (PARTITION BY sample, third ORDER BY e) AS g FROM w WHERE w IS NOT NULL),
f AS (SELECT sample, max(noise) AS noise, abs(avg(g)) AS m, stddev_samp(g) AS ss, stddev_pop(g) AS sp FROM g WHERE NOT third AND g IS NOT NULL GROUP BY sample), h AS (SELECT sample, max(noise) AS noise, max(w) FILTER (e = 1) AS a, max(w) FILTER (e = 2) AS b, max(w) FILTER (e = 3) AS c FROM w WHERE third GROUP BY sample),
q AS (SELECT f.sample, CASE WHEN m > sqrt(2::DOUBLE) * f.noise THEN ss / m ELSE greatest(1, sp / (sqrt(2::DOUBLE) * f.noise)) END AS cv, CASE WHEN a > h.noise THEN sqrt(((b / a / 3 - 1) ** 2 + (c / a / 5 - 1) ** 2) / 2) END AS th FROM f JOIN h USING (sample))
{rows('q', cv_dv='cv', thirds_rms='th')}""")
def measured_falls(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return long(M.free_fall(dealt(spark, sf_dir, "ball", y=k * k + v / 40, t=k / 8)))
