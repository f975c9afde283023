"""Masks, edges, lines, surfaces, targets and turns on pictures: 32 successive vectors of embeddings are the rows of a picture of 64 columns, eight pictures a clip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick.functions import colour as C
from tarnwick.operators import edges as E
from tarnwick.operators import masks as M
from tarnwick.operators import optics as O
from tarnwick.operators import surfaces as U
from tarnwick.operators import templates as P
from tarnwick.operators import turns as R
from tarnwick.operators import votes as V
from tarnwick.plans.registry import query, r6
from tarnwick.plans.views import table


def pictures(spark, sf_dir):
    """sample, frame, x, y, value."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(v / 256).alias("sample"), F.floor(v % 256 / 32).cast("int").alias("frame"), (v % 32).cast("int").alias("y"), F.posexplode("embedding").alias("x", "value"),
    )
    return rows.select("sample", "frame", "x", "y", F.col("value").cast("double").alias("value"))


PICTURES = """pictures AS MATERIALIZED (SELECT vec_id // 256 AS sample, CAST(vec_id % 256 // 32 AS INTEGER) AS frame, CAST(vec_id % 32 AS INTEGER) AS y,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


@query(f"""WITH RECURSIVE {PICTURES}, m AS MATERIALIZED (SELECT sample, frame, x, y FROM pictures WHERE value > 0.1),
reach AS (SELECT sample, frame, x, y, x AS u, y AS v FROM m UNION SELECT r.sample, r.frame, r.x, r.y, m.x, m.y FROM reach r JOIN m ON r.sample = m.sample AND r.frame = m.frame AND abs(r.u - m.x) <= 1 AND abs(r.v - m.y) <= 1),
roots AS (SELECT sample, frame, x, y, min(v * 64 + u) AS root FROM reach GROUP BY sample, frame, x, y)
SELECT sample, frame, CAST(dense_rank() OVER (PARTITION BY sample, frame ORDER BY root) AS INTEGER) AS component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
    round(round(avg(x * x) - avg(x) * avg(x), 6) + 0.0, 6) AS mxx, round(round(avg(x * y) - avg(x) * avg(y), 6) + 0.0, 6) AS mxy, round(round(avg(y * y) - avg(y) * avg(y), 6) + 0.0, 6) AS myy FROM roots GROUP BY sample, frame, root""")
def mask_components(spark, sf_dir):
    found = M.components(M.mask_runs(pictures(spark, sf_dir), F.col("value") > 0.1))
    plain = lambda c: (F.round(c, 6) + 0.0).alias(c)  # noqa: E731  no negative zero
    return found.select("sample", "frame", "component", "area", "x0", "y0", "x1", "y1", *map(r6, ("cx", "cy")), *map(plain, ("mxx", "mxy", "myy")))


#: Rows of runs from pixels with a flag `on`, and the least or greatest flag over a box of three by three.
RUNS_OF = "SELECT sample, frame, y, min(x) AS a, max(x) AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY sample, frame, y ORDER BY x) AS k FROM {0} WHERE f) GROUP BY sample, frame, y, k"
BOX = """{0}_ AS (SELECT sample, frame, x, y, {2}(f) OVER (PARTITION BY sample, frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM {1}),
{0} AS (SELECT sample, frame, x, y, {2}(f) OVER (PARTITION BY sample, frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM {0}_)"""


def _morphed(spark, sf_dir, level, operation):
    p = pictures(spark, sf_dir)
    return operation(M.mask_runs(p, F.col("value") > level), M.picture_rows(p), M.rectangle(1, 1))


@query(f"WITH {PICTURES}, f AS (SELECT *, value > -0.2 AS f FROM pictures), {BOX.format('thin', 'f', 'min')}, {BOX.format('back', 'thin', 'max')} {RUNS_OF.format('back')}")
def mask_opening(spark, sf_dir):
    return _morphed(spark, sf_dir, -0.2, M.opened)


@query(f"WITH {PICTURES}, f AS (SELECT *, value > 0.2 AS f FROM pictures), {BOX.format('wide', 'f', 'max')}, {BOX.format('back', 'wide', 'min')} {RUNS_OF.format('back')}")
def mask_closing(spark, sf_dir):
    return _morphed(spark, sf_dir, 0.2, M.closed)


#: Sobel differences with the border repeated, their size, and thin edges: the pixel against its two neighbours along the gradient.
EDGES = f"""{PICTURES}, wide AS (SELECT sample, frame, x, y, coalesce(lead(value) OVER r, value) - coalesce(lag(value) OVER r, value) AS dx, coalesce(lead(value) OVER c, value) - coalesce(lag(value) OVER c, value) AS dy
    FROM pictures WINDOW r AS (PARTITION BY sample, frame, y ORDER BY x), c AS (PARTITION BY sample, frame, x ORDER BY y)),
grad AS (SELECT sample, frame, x, y, coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx) AS gx, coalesce(lag(dy) OVER r, dy) + 2 * dy + coalesce(lead(dy) OVER r, dy) AS gy
    FROM wide WINDOW r AS (PARTITION BY sample, frame, y ORDER BY x), c AS (PARTITION BY sample, frame, x ORDER BY y)),
sized AS (SELECT *, sqrt(gx * gx + gy * gy) AS size, CASE WHEN abs(gy) <= (sqrt(2::DOUBLE) - 1) * abs(gx) THEN 0 WHEN abs(gx) <= (sqrt(2::DOUBLE) - 1) * abs(gy) THEN 1 WHEN gx * gy > 0 THEN 2 ELSE 3 END AS sector FROM grad),
beside AS (SELECT *, coalesce(lag(size) OVER r, 0) AS b0, coalesce(lead(size) OVER r, 0) AS a0, coalesce(lag(size) OVER c, 0) AS b1, coalesce(lead(size) OVER c, 0) AS a1,
    coalesce(lag(size) OVER d, 0) AS b2, coalesce(lead(size) OVER d, 0) AS a2, coalesce(lag(size) OVER e, 0) AS b3, coalesce(lead(size) OVER e, 0) AS a3
    FROM sized WINDOW r AS (PARTITION BY sample, frame, y ORDER BY x), c AS (PARTITION BY sample, frame, x ORDER BY y), d AS (PARTITION BY sample, frame, x - y ORDER BY x), e AS (PARTITION BY sample, frame, x + y ORDER BY x)),
thin AS MATERIALIZED (SELECT sample, frame, x, y, gx, gy, size FROM beside WHERE size > 0.7 AND CASE sector WHEN 0 THEN size > b0 AND size >= a0 WHEN 1 THEN size > b1 AND size >= a1 WHEN 2 THEN size > b2 AND size >= a2 ELSE size > b3 AND size >= a3 END),
reach AS (SELECT sample, frame, x, y FROM thin WHERE size > 1.1 UNION SELECT t.sample, t.frame, t.x, t.y FROM reach r JOIN thin t ON r.sample = t.sample AND r.frame = t.frame AND abs(r.x - t.x) <= 1 AND abs(r.y - t.y) <= 1),
edges AS MATERIALIZED (SELECT thin.* FROM thin JOIN reach USING (sample, frame, x, y))"""


def edge_pixels(spark, sf_dir):
    return E.edges(pictures(spark, sf_dir), 0.7, 1.1)


@query(f"WITH RECURSIVE {EDGES} SELECT sample, frame, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(size, 6) AS size FROM edges")
def picture_edges(spark, sf_dir):
    return edge_pixels(spark, sf_dir).select("sample", "frame", "x", "y", r6("gx"), r6("gy"), r6("size"))


LINES = f"""{EDGES}, turn AS (SELECT k::INTEGER AS angle, round(1000000 * cos(pi() * k / 90))::BIGINT AS c, round(1000000 * sin(pi() * k / 90))::BIGINT AS s FROM range(90) t(k)),
votes AS MATERIALIZED (SELECT sample, frame, angle, CAST(floor((2 * (x * c + y * s) + 1000000) / 2000000.0::DOUBLE) AS INTEGER) AS rho, count(*) AS votes FROM edges, turn GROUP BY ALL),
cells AS (SELECT * FROM votes WHERE votes >= 12), near AS (SELECT c.*, (c.angle + a.d + 90) % 90 AS na, CASE WHEN c.angle + a.d BETWEEN 0 AND 89 THEN c.rho + b.d ELSE -(c.rho + b.d) END AS nr FROM cells c, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d) WHERE a.d <> 0 OR b.d <> 0),
lost AS (SELECT DISTINCT n.sample, n.frame, n.angle, n.rho FROM near n JOIN cells c ON c.sample = n.sample AND c.frame = n.frame AND c.angle = na AND c.rho = nr WHERE c.votes > n.votes OR (c.votes = n.votes AND (c.angle, c.rho) < (n.angle, n.rho))),
peaks AS (SELECT * FROM cells ANTI JOIN lost USING (sample, frame, angle, rho))"""


def _lines(points):
    return V.line_peaks(V.line_votes(points, angles=90), 12, angles=90)


@query(f"WITH RECURSIVE {LINES} SELECT sample, frame, angle, rho, votes::BIGINT AS votes, angle * 2.0::DOUBLE AS degrees, rho::DOUBLE AS distance FROM peaks")
def hough_lines(spark, sf_dir):
    return _lines(edge_pixels(spark, sf_dir))


SEGMENTS = f"""{LINES}, own AS (SELECT p.sample, p.frame, p.angle, p.rho, x, y, y * cos(radians(p.angle * 2.0::DOUBLE)) - x * sin(radians(p.angle * 2.0::DOUBLE)) AS along FROM peaks p JOIN edges e ON p.sample = e.sample AND p.frame = e.frame
    AND abs(x * cos(radians(p.angle * 2.0::DOUBLE)) + y * sin(radians(p.angle * 2.0::DOUBLE)) - p.rho) <= 0.9),
cut AS (SELECT *, coalesce(CAST(along - lag(along) OVER w > 6.05 AS INTEGER), 0) AS fresh FROM own WINDOW w AS (PARTITION BY sample, frame, angle, rho ORDER BY along, x, y)),
part AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY sample, frame, angle, rho ORDER BY along, x, y) AS INTEGER) AS part FROM cut),
segments AS (SELECT sample, frame, angle, rho, part, arg_min(x, along) AS x0, arg_min(y, along) AS y0, arg_max(x, along) AS x1, arg_max(y, along) AS y1, count(*) AS n, max(along) - min(along) AS length FROM part GROUP BY sample, frame, angle, rho, part HAVING max(along) - min(along) >= 10.003)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT * REPLACE (round(length, 6) AS length) FROM segments")
def hough_segments(spark, sf_dir):
    points = edge_pixels(spark, sf_dir)
    return V.segments(points, _lines(points), near=0.9, gap=6.05, least_length=10.003).withColumn("length", F.round("length", 6))


@query(f"""WITH RECURSIVE {EDGES}, votes AS (SELECT sample, frame, CAST(floor(x + r * (gx / size) + 0.5) AS INTEGER) AS cx, CAST(floor(y + r * (gy / size) + 0.5) AS INTEGER) AS cy, count(*) AS votes FROM edges, (SELECT unnest([4, 5, 6, 7, 8, -4, -5, -6, -7, -8])::DOUBLE AS r) GROUP BY ALL),
cells AS (SELECT * FROM votes WHERE votes >= 7), lost AS (SELECT DISTINCT n.sample, n.frame, n.cx, n.cy FROM cells n JOIN cells c ON c.sample = n.sample AND c.frame = n.frame AND abs(c.cx - n.cx) <= 1 AND abs(c.cy - n.cy) <= 1 WHERE c.votes > n.votes OR (c.votes = n.votes AND (c.cx, c.cy) < (n.cx, n.cy))),
peaks AS (SELECT * FROM cells ANTI JOIN lost USING (sample, frame, cx, cy)),
off AS (SELECT sample, frame, cx, cy, votes, CAST(floor(sqrt((x - cx) ** 2 + (y - cy) ** 2) + 0.5) AS INTEGER) AS r FROM peaks JOIN edges USING (sample, frame)),
rings AS (SELECT sample, frame, cx, cy, votes, r, count(*) AS n FROM off WHERE r BETWEEN 4 AND 8 GROUP BY sample, frame, cx, cy, votes, r)
SELECT sample, frame, cx, cy, votes::BIGINT AS votes, r, n, round(n / (2 * pi() * r), 6) AS cover FROM rings QUALIFY row_number() OVER (PARTITION BY sample, frame, cx, cy ORDER BY n / (2 * pi() * r) DESC, r) = 1 AND n / (2 * pi() * r) >= 0.2""")
def hough_circles(spark, sf_dir):
    points = edge_pixels(spark, sf_dir)
    centres = V.centre_peaks(V.centre_votes(points, 4, 8), 7)
    return V.circles(points, centres, 4, 8, 0.2).withColumn("cover", F.round("cover", 6))


@query(f"""WITH RECURSIVE {PICTURES}, small AS (SELECT sample, frame, x, y, value::FLOAT::DOUBLE AS value FROM pictures),
tpl AS (SELECT sample, x - 32 AS dx, y - 16 AS dy, value - avg(value) OVER (PARTITION BY sample) AS t FROM small WHERE frame = 0 AND x BETWEEN 28 AND 36 AND y BETWEEN 12 AND 20),
scores AS MATERIALIZED (SELECT p.sample, p.frame, p.x - dx AS cx, p.y - dy AS cy, sum(value * t) / sqrt((sum(value * value) - sum(value) ** 2 / 81) * sum(t * t)) AS s FROM small p JOIN tpl USING (sample) WHERE p.frame > 0 GROUP BY ALL HAVING count(*) = 81),
frames AS (SELECT DISTINCT sample, frame FROM pictures),
track AS (SELECT sample, frame, 32 AS x, 16 AS y, 1.0::DOUBLE AS score, frame AS lf, 32 AS lx, 16 AS ly, NULL::INTEGER AS mx, NULL::INTEGER AS my, NULL::INTEGER AS ox, NULL::INTEGER AS oy, 0 AS misses FROM frames WHERE frame = 0 UNION ALL
    SELECT sample, frame, CASE WHEN hit THEN best.x END, CASE WHEN hit THEN best.y END, CASE WHEN hit THEN best.s END, CASE WHEN hit THEN frame ELSE lf END, CASE WHEN hit THEN best.x ELSE lx END, CASE WHEN hit THEN best.y ELSE ly END,
        CASE WHEN hit THEN lx ELSE mx END, CASE WHEN hit THEN ly ELSE my END, CASE WHEN hit THEN mx ELSE ox END, CASE WHEN hit THEN my ELSE oy END, CASE WHEN hit THEN 0 ELSE misses + 1 END
    FROM (SELECT *, coalesce(best.s >= CASE WHEN misses < 2 THEN 0.30 ELSE 0.24 END AND sqrt((best.x - ex) ** 2 + (best.y - ey) ** 2) <= 1.15 * reach, false) AS hit
    FROM (SELECT e.sample, e.frame, lf, lx, ly, mx, my, ox, oy, misses, ex, ey, reach, max({{'s': s, 'ny': -cy, 'nx': -cx, 'x': cx, 'y': cy}}) AS best
    FROM (SELECT t.sample, f.frame, lf, lx, ly, mx, my, ox, oy, misses, lx + coalesce((lx - ox) / 2.0::DOUBLE, 0) * (f.frame - lf) AS ex, ly + coalesce((ly - oy) / 2.0::DOUBLE, 0) * (f.frame - lf) AS ey, floor(6 * (1 + least(1.5::DOUBLE, 0.45::DOUBLE * misses))) AS reach
        FROM track t JOIN frames f ON f.sample = t.sample AND f.frame = t.frame + 1) e
    LEFT JOIN scores s ON s.sample = e.sample AND s.frame = e.frame AND cx BETWEEN floor(ex - reach) AND ceil(ex + reach) AND cy BETWEEN floor(ey - reach) AND ceil(ey + reach) GROUP BY ALL)))
SELECT sample, frame, x::DOUBLE AS x, y::DOUBLE AS y, round(score, 6) AS score, x IS NOT NULL AS valid FROM track""")
def template_tracks(spark, sf_dir):
    p = pictures(spark, sf_dir)
    starts = p.select("sample").distinct().select("sample", F.lit(32).alias("x"), F.lit(16).alias("y"))
    return P.template_tracks(p, starts, half=4, search=6).withColumn("score", F.round("score", 6))


def coloured(spark, sf_dir):
    """sample, frame, x, y and three channels of 0 to 255: bright at the top, tinted more and more from row 14 on by what the vectors hold."""
    p = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    rows = p.select(F.floor(v / 256).alias("sample"), F.floor(v % 256 / 32).cast("int").alias("frame"), (v % 32).cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"), F.col("embedding").alias("v"))
    at = lambda n: F.get("v", (F.col("x") + n) % 64).cast("double")
    level = lambda n, e: F.least(F.greatest(F.floor(150 + 100 * e + n * F.when(F.col("y") >= 14, 20).otherwise(0)), F.lit(0)), F.lit(255)).cast("double")
    return rows.select("sample", "frame", "x", "y", level(-2, F.col("e").cast("double")).alias("red"), level(0, at(21)).alias("green"), level(2, at(42)).alias("blue"))


LAB = """coloured AS (SELECT sample, frame, x, y, greatest(0, least(255, floor(150 + 100 * e - 2 * t)))::DOUBLE AS red, greatest(0, least(255, floor(150 + 100 * v[(x + 21) % 64 + 1]::DOUBLE)))::DOUBLE AS green, greatest(0, least(255, floor(150 + 100 * v[(x + 42) % 64 + 1]::DOUBLE + 2 * t)))::DOUBLE AS blue
    FROM (SELECT vec_id // 256 AS sample, CAST(vec_id % 256 // 32 AS INTEGER) AS frame, CAST(vec_id % 32 AS INTEGER) AS y, CASE WHEN vec_id % 32 >= 14 THEN 20 ELSE 0 END AS t, embedding AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, unnest(embedding)::DOUBLE AS e FROM embeddings)),
flat AS (SELECT sample, frame, x, y, unnest([0, 1, 2]) AS c, unnest([red, green, blue]) / 255.0::DOUBLE AS s FROM coloured),
light AS (SELECT sample, frame, x, y, c, CASE WHEN s > 0.04045::DOUBLE THEN pow((s + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE s / 12.92::DOUBLE END AS l FROM flat),
xyz AS (SELECT sample, frame, x, y, sum(l * ([0.412453, 0.357580, 0.180423]::DOUBLE[])[c + 1]) / 0.950456::DOUBLE AS tx, sum(l * ([0.212671, 0.715160, 0.072169]::DOUBLE[])[c + 1]) AS ty, sum(l * ([0.019334, 0.119193, 0.950227]::DOUBLE[])[c + 1]) / 1.088754::DOUBLE AS tz FROM light GROUP BY sample, frame, x, y),
roots AS (SELECT sample, frame, x, y, ty, list_transform([tx, ty, tz], lambda t: CASE WHEN t > 0.008856::DOUBLE THEN pow(t, 1 / 3::DOUBLE) ELSE t * 7.787::DOUBLE + 16 / 116::DOUBLE END) AS f FROM xyz),
lab AS MATERIALIZED (SELECT sample, frame, x, y, CASE WHEN ty > 0.008856::DOUBLE THEN 116 * f[2] - 16 ELSE 903.3::DOUBLE * ty END AS l, 500 * (f[1] - f[2]) AS a, 200 * (f[2] - f[3]) AS b FROM roots)"""


def lab_pixels(spark, sf_dir):
    light, a, b = C.lab(F.col("red"), F.col("green"), F.col("blue"))
    return coloured(spark, sf_dir).select("sample", "frame", "x", "y", light.alias("l"), a.alias("a"), b.alias("b"))


@query(f"WITH {LAB} SELECT sample, frame, y, round(avg(l), 6) AS l, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(max(sqrt(a * a + b * b)), 6) AS chroma FROM lab GROUP BY sample, frame, y")
def lab_rows(spark, sf_dir):
    return lab_pixels(spark, sf_dir).groupBy("sample", "frame", "y").agg(*[r6(F.avg(c), c) for c in ("l", "a", "b")], r6(F.max(C.chroma(F.col("a"), F.col("b"))), "chroma"))


@query("""WITH c AS (SELECT vec_id, floor(128 + 300 * embedding[1]) AS red, floor(128 + 300 * embedding[2]) AS green, floor(128 + 300 * embedding[3]) AS blue FROM embeddings), d AS (SELECT *, greatest(red, green, blue)::DOUBLE AS m, (greatest(red, green, blue) - least(red, green, blue))::DOUBLE AS d FROM c),
h AS (SELECT vec_id, m, 30 * CASE WHEN d = 0 THEN 0 WHEN m = red THEN (green - blue) / d WHEN m = green THEN (blue - red) / d + 2 ELSE (red - green) / d + 4 END AS h, CASE WHEN m = 0 THEN 0 ELSE 255 * d / m END AS s FROM d),
k AS (SELECT vec_id, m, s, CASE WHEN h < 0 THEN h + 180 ELSE h END AS h FROM h) SELECT vec_id, round(h, 6) AS hue, round(s, 6) AS saturation, m AS value, least(abs(h - 170), 180 - abs(h - 170)) <= 14 AND s >= 40 AND m >= 60 AS reddish FROM k""")
def colour_masks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    of, by = F.lit(128.0).cast("float"), F.lit(300.0).cast("float")  # single precision like the vectors
    red, green, blue = (F.floor(of + by * F.col("embedding")[k]).cast("double") for k in range(3))
    hue, saturation, value = C.hsv(red, green, blue)
    rows = e.select("vec_id", hue.alias("hue"), saturation.alias("saturation"), value.alias("value"))
    return rows.select("vec_id", r6("hue"), r6("saturation"), "value", C.of_colour(F.col("hue"), F.col("saturation"), F.col("value"), 170.0, 14.0, 40.0, 60.0).alias("reddish"))


@query(f"""WITH {LAB}, med AS (SELECT sample, frame, y, median(a) AS a, median(b) AS b FROM lab GROUP BY sample, frame, y),
band AS (SELECT sample, frame, y, avg(a) OVER u AS au, avg(b) OVER u AS bu, avg(a) OVER d AS ad, avg(b) OVER d AS bd, max(y) OVER (PARTITION BY sample, frame) AS last FROM med WINDOW u AS (PARTITION BY sample, frame ORDER BY y ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING), d AS (PARTITION BY sample, frame ORDER BY y ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)),
gain AS (SELECT sample, frame, y, sqrt((ad - au) ** 2 + (bd - bu) ** 2) * sign(sqrt(ad ** 2 + bd ** 2) - sqrt(au ** 2 + bu ** 2)) AS g FROM band WHERE y >= 6 AND y < least(24, last - 5)),
g AS (SELECT *, row_number() OVER (PARTITION BY sample, frame ORDER BY y) AS k, count(*) OVER (PARTITION BY sample, frame) AS n FROM gain),
taps AS (SELECT p.sample, p.frame, p.y, avg(q.g) AS g FROM g p, (VALUES (-2), (-1), (0), (1), (2)) o(d) JOIN g q ON q.sample = p.sample AND q.frame = p.frame AND q.k = CASE WHEN p.k + d < 1 THEN 2 - (p.k + d) WHEN p.k + d > p.n THEN 2 * p.n - (p.k + d) ELSE p.k + d END WHERE p.n >= 8 GROUP BY ALL),
best AS (SELECT sample, frame, min_by(y, {{'g': -g, 'y': y}}) AS place, max(g) AS step FROM taps GROUP BY sample, frame HAVING max(g) >= 2),
tint AS (SELECT l.sample, l.frame, x, y, sqrt(a * a + b * b) AS c FROM lab l JOIN best USING (sample, frame) WHERE abs(y - place) <= 5),
rise AS (SELECT *, greatest(0, lead(c) OVER (PARTITION BY sample, frame, x ORDER BY y) - c) AS r FROM tint), pts AS (SELECT sample, frame, x, sum(r * (y + 0.5)) / sum(r) AS h FROM rise WHERE r IS NOT NULL GROUP BY sample, frame, x HAVING sum(r) > 1e-6),
fit AS (SELECT sample, frame, count(*) AS n, regr_slope(h, x) AS s, regr_intercept(h, x) AS i, sqrt(greatest(0, regr_syy(h, x) - regr_slope(h, x) * regr_sxy(h, x)) / count(*)) AS rms, (min(x) + max(x)) / 2 AS m FROM pts GROUP BY sample, frame)
SELECT sample, frame, place AS row, round(step, 6) AS step, n AS columns, round(CASE WHEN n >= 12 THEN degrees(atan(s)) ELSE 0 END, 6) AS tilt, round(CASE WHEN n >= 12 THEN i + s * m ELSE place END, 6) AS height, round(CASE WHEN n >= 12 THEN rms ELSE 0 END, 6) AS rms FROM best JOIN fit USING (sample, frame)""")
def tint_surfaces(spark, sf_dir):
    found = U.tint_surfaces(lab_pixels(spark, sf_dir), (0.0, 30.0), band=5)
    return found.select("sample", "frame", "row", r6("step"), "columns", r6("tilt"), r6("height"), r6("rms"))


def discs(spark, sf_dir):
    """Six pictures of 23 by 23 for each vector: 36 sectors of a disc hold its first numbers, and turn by 7 degrees and more from picture to picture. With the discs' places.

    Frames are dealt out before they become pixels: a file of vectors is one task, and its pixels, a thousand times as many bytes, need no shuffle then.
    """
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"), "embedding")
    frames = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample", "frame")
    places = frames.select("sample", "frame").distinct().select("sample", "frame", F.lit(11.0).alias("cx"), F.lit(11.0).alias("cy"), F.lit(10.0).alias("r"))
    spots = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("x"))
    turned = F.degrees(F.atan2(F.col("y") - 11.0, F.col("x") - 11.0)) - F.col("frame") * (7 + F.col("sample") % 5)
    sector = F.floor(F.pmod(F.round(turned, 6), F.lit(360.0)) / 10).cast("int")
    return spots.select("sample", "frame", "x", "y", (128 + 400 * F.get("embedding", sector).cast("double")).alias("value")), places


@query("""WITH spots AS MATERIALIZED (SELECT vec_id AS sample, frame::INTEGER AS frame, x, y, (128 + 400 * embedding[CAST(floor(((round(degrees(atan2(y - 11.0::DOUBLE, x - 11.0::DOUBLE)) - frame * (7 + vec_id % 5), 6) % 360) + 360) % 360 / 10) AS INTEGER) + 1]::DOUBLE)::FLOAT::DOUBLE AS value
    FROM embeddings, range(6) f(frame), range(23) r(y), range(23) c(x)),
at_ AS (SELECT ring, k, 11 + 10 * (0.24 + 0.63 * ring / 3) * cos(pi() * k / 18) AS x, 11 + 10 * (0.24 + 0.63 * ring / 3) * sin(pi() * k / 18) AS y FROM range(4) a(ring), range(36) b(k)),
raw AS (SELECT s.sample, s.frame, ring, k, sum(value * (1 - abs(a.x - s.x)) * (1 - abs(a.y - s.y))) AS v FROM at_ a JOIN spots s ON s.x BETWEEN floor(a.x) AND floor(a.x) + 1 AND s.y BETWEEN floor(a.y) AND floor(a.y) + 1 GROUP BY ALL),
polar AS (SELECT sample, frame, ring, k, v - avg(v) OVER (PARTITION BY sample, frame, ring) AS v FROM raw), rings AS MATERIALIZED (SELECT sample, frame, ring, list(v ORDER BY k) AS v FROM polar GROUP BY sample, frame, ring),
size AS (SELECT sample, frame, sum(list_inner_product(v, v)) AS e FROM rings GROUP BY sample, frame),
c AS (SELECT b.sample, b.frame, s, sum(list_inner_product(b.v, a.v[37 - s:] || a.v[:36 - s])) / sqrt(max(x.e) * max(y.e)) AS c FROM rings a JOIN rings b ON a.sample = b.sample AND a.ring = b.ring AND b.frame = a.frame + 1 JOIN size x ON x.sample = a.sample AND x.frame = a.frame JOIN size y ON y.sample = b.sample AND y.frame = b.frame, range(36) r(s) WHERE x.e >= 576 AND y.e >= 576 GROUP BY b.sample, b.frame, s),
d AS (SELECT *, (s * 10 + 180) % 360 - 180 AS g, max(c) OVER (PARTITION BY sample, frame) AS top FROM c), best AS (SELECT sample, frame, arg_max(s, c) AS s, max(c) AS c, max(top) AS top FROM d WHERE abs(g) <= 45 GROUP BY sample, frame),
n AS (SELECT best.*, p.c AS lo, q.c AS hi FROM best JOIN c p ON p.sample = best.sample AND p.frame = best.frame AND p.s = (best.s + 35) % 36 JOIN c q ON q.sample = best.sample AND q.frame = best.frame AND q.s = (best.s + 1) % 36)
SELECT sample, frame, round((s * 10 + 180) % 360 - 180 + CASE WHEN lo - 2 * c + hi < -1e-12 THEN 10 * greatest(-0.5, least(0.5, 0.5 * (lo - hi) / (lo - 2 * c + hi))) ELSE 0 END, 5) AS step, round(c, 6) AS score, top - c > 0.05 AS doubtful FROM n""")
def texture_steps(spark, sf_dir):
    p, places = discs(spark, sf_dir)
    read = R.polar_pictures(p, places, 36, 4).withColumn("before", F.lag("polar").over(Window.partitionBy("sample").orderBy("frame"))).filter("before is not null and polar is not null")
    return R.steps_between(read, 36, 4).select("sample", "frame", F.round("step", 5).alias("step"), r6("score"), "doubtful")


@query()
def texture_turns(spark, sf_dir):
    p, places = discs(spark, sf_dir)
    found = R.texture_turns(p, places, 72, 8)
    return found.select("sample", "frame", r6("degrees"), r6("chained"), r6("direct"), r6("score"), "valid")


@query(f"""WITH RECURSIVE {SEGMENTS}, d AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS s, (y0 + y1) / 2.0::DOUBLE - 16 AS off, 32 - (x0 + x1) / 2.0::DOUBLE AS place FROM segments WHERE x1 <> x0 OR y1 <> y0),
r AS (SELECT *, (y1 - y0) / s AS across, (x0 - x1) / s AS side_way FROM d WHERE abs((y1 - y0) / s) >= 0.02)
SELECT sample, frame, angle AS line, rho, part, CASE WHEN off < 0 THEN 'first' ELSE 'second' END AS side, round(place - off * side_way / across, 5) + 0.0 AS along, round(degrees(acos(least(1, abs(across)))), 5) AS degrees, round(side_way / across, 5) + 0.0 AS lean FROM r""")
def ray_angles(spark, sf_dir):
    points = edge_pixels(spark, sf_dir)
    parts = V.segments(points, _lines(points), near=0.9, gap=6.05, least_length=10.003).withColumnRenamed("angle", "line")
    found = O.rays(parts, (32.0, 16.0, 0.0, 1.0))
    plain = lambda c, n: (F.round(c, 5) + 0.0).alias(n)  # noqa: E731  no negative zero
    return found.select("sample", "frame", "line", "rho", "part", "side", plain("along", "along"), plain("angle", "degrees"), plain("lean", "lean"))


@query(f"""WITH {PICTURES}, p AS (SELECT sample, frame, x AS i, avg(value) * 100 AS y FROM pictures GROUP BY sample, frame, x), c AS (SELECT *, abs(y - median(y) OVER (PARTITION BY sample, frame)) AS c FROM p), t AS (SELECT *, max(c) OVER (PARTITION BY sample, frame) AS top FROM c),
k AS (SELECT *, i - row_number() OVER (PARTITION BY sample, frame ORDER BY i) AS k FROM t WHERE top >= 1 AND c > greatest(1, 0.45 * top)), b AS (SELECT sample, frame, min(i) AS start, max(i) AS stop, sum(c * i) / sum(c) AS centre, max(c) AS peak FROM k GROUP BY sample, frame, k HAVING count(*) >= 2)
SELECT sample, frame, CAST(row_number() OVER (PARTITION BY sample, frame ORDER BY start) AS INTEGER) AS ridge, start, stop, round(centre, 6) AS centre, round(peak, 6) AS peak FROM b""")
def profile_ridges(spark, sf_dir):
    columns = pictures(spark, sf_dir).groupBy("sample", "frame", F.col("x").alias("i")).agg((F.avg("value") * 100).alias("y"))
    return O.ridges(columns, ["sample", "frame"], least=1.0).select("sample", "frame", "ridge", "start", "stop", r6("centre"), r6("peak"))
