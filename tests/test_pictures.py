"""Operators on pictures against drawn ones and plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import colour as C
from tarnwick.operators import edges as E
from tarnwick.operators import masks as M
from tarnwick.operators import optics as O
from tarnwick.operators import surfaces as U
from tarnwick.operators import templates as P
from tarnwick.operators import turns as R
from tarnwick.operators import votes as V

PIXELS = "sample string, frame int, x int, y int, value double"


def pixels(spark, *pictures, sample="s"):
    return spark.createDataFrame([(sample, f, x, y, float(p[y, x])) for f, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])], PIXELS)


def painted(runs, shape, frame=0):
    out = np.zeros(shape, bool)
    for r in runs.filter(F.col("frame") == frame).collect():
        assert not out[r.y, max(0, r.a - 1) : r.b + 2].any()  # runs of a row do not touch
        out[r.y, r.a : r.b + 1] = True
    return out


def flooded(mask, diagonal):
    """Component numbers by flooding, in row order."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not dy * dx)]
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                stack += [(y + dy, x + dx) for dy, dx in steps]
    return out


@pytest.mark.parametrize("share, diagonal", [(0.3, True), (0.55, True), (0.55, False), (0.0, True), (1.0, False)])
def test_components_equal_flooding(spark, share, diagonal):
    masks = [np.random.default_rng(k).random((11, 17)) < share for k in range(3)]
    runs = M.mask_runs(pixels(spark, *masks), F.col("value") > 0.5)
    found = {(r.frame, r.component): r for r in M.components(runs, diagonal=diagonal).collect()}
    count = 0
    for f, mask in enumerate(masks):
        numbers = flooded(mask, diagonal)
        for n in range(1, numbers.max() + 1):
            y, x = np.nonzero(numbers == n)
            r = found[f, n]
            count += 1
            assert (r.area, r.x0, r.y0, r.x1, r.y1) == (len(x), x.min(), y.min(), x.max(), y.max())
            assert (r.cx, r.cy, r.mxx, r.mxy, r.myy) == pytest.approx((x.mean(), y.mean(), x.var(), ((x - x.mean()) * (y - y.mean())).mean(), y.var()), abs=1e-9)
    assert count == len(found)


def spread(mask, shape, most):
    """Dilation by looking at every pixel; with most False, erosion."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            near = [mask[y + dy, x + dx] for dy, half in shape for dx in range(-half, half + 1) if 0 <= y + dy < h and 0 <= x + dx < w]
            out[y, x] = any(near) if most else all(near)
    return out


@pytest.mark.parametrize("shape", [M.rectangle(1, 1), M.rectangle(0, 2), M.rectangle(2, 0), M.ellipse(2, 2), M.ellipse(3, 1)])
def test_morphology_equals_looking_at_every_pixel(spark, shape):
    mask = np.random.default_rng(len(shape)).random((12, 15)) < 0.6
    p = pixels(spark, mask)
    runs, rows = M.mask_runs(p, F.col("value") > 0.5), M.picture_rows(p)
    wide, thin = spread(mask, shape, True), spread(mask, shape, False)
    assert (painted(M.dilated(runs, rows, shape), mask.shape) == wide).all()
    assert (painted(M.eroded(runs, rows, shape), mask.shape) == thin).all()
    assert (painted(M.opened(runs, rows, shape), mask.shape) == spread(thin, shape, True)).all()
    assert (painted(M.closed(runs, rows, shape), mask.shape) == spread(wide, shape, False)).all()


def test_empty_and_full_masks_and_null_flags(spark):
    p = pixels(spark, np.zeros((4, 5)), np.ones((4, 5)))
    rows = M.picture_rows(p)
    runs = M.mask_runs(p.withColumn("value", F.when((F.col("x") == 2) & (F.col("y") == 1), None).otherwise(F.col("value"))), F.col("value") > 0.5)
    assert not painted(runs, (4, 5)).any() and painted(runs, (4, 5), 1).sum() == 19
    assert painted(M.complement(runs, rows), (4, 5)).all() and painted(M.complement(runs, rows), (4, 5), 1).sum() == 1
    assert painted(M.closed(runs, rows, M.rectangle(1, 1)), (4, 5), 1).all()
    assert M.components(runs.filter("frame = 9")).collect() == []


def test_orientation_and_the_tracked_component(spark):
    picture = np.zeros((40, 40))
    for k in range(20):
        picture[8 + k // 2, 5 + k : 8 + k] = 1  # a bar that sinks by a half per column
    picture[30:33, 30:33] = 1
    parts = M.components(M.mask_runs(pixels(spark, picture, np.zeros((40, 40))), F.col("value") > 0.5))
    bar = M.orientation(parts).orderBy(F.desc("area")).first()
    assert bar["degrees"] == pytest.approx(26.5, abs=3) and bar["elongation"] > 5
    near = [F.hypot(F.col("cx") - 31, F.col("cy") - 31)]
    (row,) = M.tracked_component(parts, ["sample", "frame"], 5, near).collect()
    assert (row.x, row.y, row.valid) == (31, 31, True) and row.r == pytest.approx((9 / np.pi) ** 0.5)
    (row,) = M.tracked_component(parts, ["sample", "frame"], 50, near).collect()
    assert row.x is None and not row.valid


def drawn_line(degrees, distance, shape=(40, 50)):
    """Pixels within half a pixel of a line."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    turn = np.radians(degrees)
    return np.abs(x * np.cos(turn) + y * np.sin(turn) - distance) <= 0.5


def spots(spark, *pictures):
    return pixels(spark, *pictures).filter("value > 0.5")


@pytest.mark.parametrize("degrees, distance", [(0, 20), (90, 12), (45, 30), (135, -5), (30, 25), (178, -15)])
def test_lines_are_found_within_one_cell(spark, degrees, distance):
    points = spots(spark, drawn_line(degrees, distance))
    best = V.line_peaks(V.line_votes(points), 15).orderBy(F.desc("votes"), "angle", "rho").first()
    off = (best["degrees"] - degrees + 90) % 180 - 90
    turned = abs(best["degrees"] - degrees) > 90
    assert abs(off) <= 1 and abs((-1 if turned else 1) * best["distance"] - distance) <= 1


def test_votes_equal_counting_points_one_by_one(spark):
    picture = np.random.default_rng(3).random((9, 14)) < 0.3
    cos, sin = V.direction_table(12)
    plain = {}
    for y, x in zip(*np.nonzero(picture)):
        for k in range(12):
            cell = (k, int(np.floor((x * cos[k] + y * sin[k]) / 2e6 + 0.5)))
            plain[cell] = plain.get(cell, 0) + 1
    points = spots(spark, picture).repartition(3)
    assert {(r.angle, r.rho): r.votes for r in V.line_votes(points, angles=12, step=2.0).collect()} == plain
    assert V.line_votes(points.limit(0)).collect() == [] == V.line_votes(points.withColumn("x", F.lit(None).cast("int"))).collect()


def test_of_neighbouring_cells_one_stands_over_half_a_turn_too(spark):
    votes = spark.createDataFrame([("s", 0, 0, 10, 30), ("s", 0, 179, -10, 30), ("s", 0, 179, -11, 31), ("s", 0, 50, 5, 40), ("s", 0, 50, 6, 40), ("s", 0, 90, 1, 9), ("s", 1, 50, 6, 12)], "sample string, frame int, angle int, rho int, votes long")
    assert sorted((r.frame, r.angle, r.rho) for r in V.line_peaks(votes, 10).collect()) == [(0, 50, 5), (0, 179, -11), (1, 50, 6)]


def test_segments_end_at_gaps(spark):
    picture = np.zeros((30, 60))
    picture[12, 2:20] = picture[12, 22:25] = picture[12, 35:58] = 1
    points = spots(spark, picture)
    lines = V.line_peaks(V.line_votes(points), 30)
    found = sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in V.segments(points, lines, gap=4).filter("angle = 90").collect())
    assert [sorted((a, b)) for a, _, b, _, _ in found] == [[2, 24], [35, 57]] or [sorted((a, b)) for a, _, b, _, _ in found] == [[35, 57], [2, 24]]
    assert V.segments(points, lines, gap=4, least_length=22.5).collect() == []


@pytest.mark.parametrize("cx, cy, r", [(25, 20, 9), (18, 22, 12)])
def test_circles_are_found_within_a_pixel(spark, cx, cy, r):
    y, x = np.mgrid[:45, :50]
    discs = [1 / (1 + np.exp(np.hypot(x - cx, y - cy) - r)), np.zeros((45, 50))]
    points = E.edges(pixels(spark, *discs), 0.3, 0.8)
    centres = V.centre_peaks(V.centre_votes(points, 6, 15), 20)
    best = V.circles(points, centres, 6, 15, 0.6).orderBy(F.desc("cover")).collect()
    assert {b.frame for b in best} == {0}
    assert abs(best[0].cx - cx) <= 1 and abs(best[0].cy - cy) <= 1 and abs(best[0].r - r) <= 1


def test_edges_of_a_step_and_of_a_frame_without_any(spark):
    step = np.zeros((8, 10))
    step[:, 6:] = 1
    rows = E.edges(pixels(spark, step, np.zeros((8, 10)), np.ones((8, 10))), 1.0, 3.0).collect()
    assert {(r.frame, r.y) for r in rows} == {(0, y) for y in range(8)} and {r.x for r in rows} in ({5}, {6}) and all((r.gx, r.gy) == (4, 0) for r in rows)
    assert E.profile_edge(step, 1) == (5, 5.5)


@pytest.mark.parametrize("seed", range(6))
def test_hysteresis_equals_flooding_from_strong_pixels(seed):
    draw = np.random.default_rng(seed)
    weak = draw.random((13, 16)) < 0.4
    strong = weak & (draw.random(weak.shape) < 0.05)
    numbers = flooded(weak, True)
    assert (E.reached(weak, strong) == np.isin(numbers, np.unique(numbers[strong])) & weak).all()


def test_thinning_keeps_ridges_of_each_direction():
    y, x = np.mgrid[:40, :40]
    for degrees in range(0, 180, 15):
        turn = np.radians(degrees)
        ramp = 1 / (1 + np.exp(-(x - 20) * np.cos(turn) - (y - 20) * np.sin(turn)))
        found = E.canny(ramp, 0.3, 0.8)[3][6:-6, 6:-6]
        off = np.abs((x - 20) * np.cos(turn) + (y - 20) * np.sin(turn))[6:-6, 6:-6][found]
        assert 20 <= found.sum() <= 60 and off.max() <= 1.01


def direct(p, t):
    """Normalised cross-correlation, place by place."""
    h, w = t.shape
    out = np.zeros((p.shape[0] - h + 1, p.shape[1] - w + 1))
    for y, x in np.ndindex(out.shape):
        a, b = p[y : y + h, x : x + w] - p[y : y + h, x : x + w].mean(), t - t.mean()
        if (a * a).sum() > 1e-12:
            out[y, x] = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_correlation_equals_the_direct_sum_on_every_place(seed):
    draw = np.random.default_rng(seed)
    p = draw.random((15, 19)) * 255 + seed * 1000
    p[:6, :6] = 7.0  # flat
    t = p[8:13, 9:13]
    found = P.correlation(p, t)
    assert found == pytest.approx(direct(p, t), abs=1e-7) and found[8, 9] == pytest.approx(1)
    assert P.correlation(p[:3], t).size == 0 and not P.correlation(p, np.ones((3, 3))).any()


def blob(cx, cy, shape=(60, 90), seen=True, seed=0):
    noise = np.random.default_rng(seed).random(shape) * 8
    y, x = np.mgrid[: shape[0], : shape[1]]
    return noise + seen * (200 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 18) - 90 * np.exp(-((x - cx - 2) ** 2 + (y - cy) ** 2) / 4))


def test_a_drifting_target_is_followed_and_a_lost_one_found_again(spark):
    way = [(15 + 3 * k, 12 + 2 * k) for k in range(14)]
    hidden = (6, 7, 8)
    p = pixels(spark, *[blob(x, y, seen=k not in hidden, seed=k) for k, (x, y) in enumerate(way)])
    starts = spark.createDataFrame([("s", 15, 12)], "sample string, x int, y int")
    for outlines in (False, True):
        rows = P.template_tracks(p, starts, half=6, search=5, outlines=outlines).orderBy("frame").collect()
        assert len(rows) == 14 and [r.frame for r in rows if not r.valid] == list(hidden)
        assert all(abs(r.x - way[r.frame][0]) <= 1 and abs(r.y - way[r.frame][1]) <= 1 and r.score > 0.8 for r in rows if r.valid)


def test_targets_at_the_border_and_windows_outside(spark):
    p = pixels(spark, blob(10, 10, (20, 30)), blob(10, 10, (8, 8)))
    starts = spark.createDataFrame([("s", 3, 10)], "sample string, x int, y int")
    assert [r.valid for r in P.template_tracks(p, starts, half=5, search=4).collect()] == [False, False]
    starts = spark.createDataFrame([("s", 10, 10)], "sample string, x int, y int")
    assert [r.valid for r in P.template_tracks(p, starts, half=5, search=4).orderBy("frame").collect()] == [True, False]


def test_lab_and_hsv_of_known_colours(spark):
    known = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (255, 0, 0): (53.24, 80.09, 67.20), (0, 255, 0): (87.73, -86.18, 83.18), (0, 0, 255): (32.30, 79.19, -107.86), (119, 119, 119): (50.03, 0, 0)}
    df = spark.createDataFrame([tuple(map(float, k)) for k in known], "r double, g double, b double")
    lab = df.select(F.struct(*"rgb").alias("rgb"), F.array(*C.lab(*map(F.col, "rgb"))).alias("lab"), F.array(*C.hsv(*map(F.col, "rgb"))).alias("hsv"))
    rows = {tuple(map(int, r.rgb)): r for r in lab.collect()}
    for k, value in known.items():
        assert rows[k].lab == pytest.approx(value, abs=0.05)
    assert [rows[k].hsv for k in ((255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0))] == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 0]]
    red = df.select(C.of_colour(*C.hsv(F.col("r"), F.col("g"), F.col("b")), 175.0, least_saturation=50).alias("red")).collect()
    assert [r.red for r in red] == [False, False, True, False, False, False]


def tank(level, slope=0.0, tint=18.0, shape=(60, 40), block=None):
    """The colour plane of a vessel whose liquid, tinted, stands below a line; with a floating block without colour."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    share = np.clip(y + 0.5 - (level + slope * (x - (shape[1] - 1) / 2)), 0, 1)
    if block:
        share[:, block[0] : block[1]] = 0
    return [("s", 0, int(u), int(v), float(-tint * k), float(0.5 * tint * k)) for v, u, k in zip(y.ravel(), x.ravel(), share.ravel())]


@pytest.mark.parametrize("level, slope, block", [(25.0, 0.0, None), (30.4, 0.05, None), (22.7, -0.03, None), (28.0, 0.0, (5, 12))])
def test_surfaces_of_drawn_tanks(spark, level, slope, block):
    p = spark.createDataFrame(tank(level, slope, block=block), "sample string, frame int, x int, y int, a double, b double")
    (r,) = U.tint_surfaces(p, (0.0, 60.0)).collect()
    assert abs(r.row - level) <= 2 and r.step == pytest.approx(18 * 1.25**0.5, rel=0.2)
    assert r.height == pytest.approx(level, abs=0.15) and r.tilt == pytest.approx(np.degrees(np.arctan(slope)), abs=0.3) and r.rms < 0.2
    assert r["columns"] == (33 if block else 40)


def test_untinted_liquid_an_upper_tint_and_low_vessels_have_no_surface(spark):
    schema = "sample string, frame int, x int, y int, a double, b double"
    for rows in (tank(25.0, tint=0.5), [(s, f, x, 59 - y, a, b) for s, f, x, y, a, b in tank(30.0)], tank(9.0, shape=(26, 20))):
        assert U.tint_surfaces(spark.createDataFrame(rows, schema), (0.0, float(max(r[3] for r in rows) + 1))).collect() == []


def test_means_are_mirrored_at_both_ends(spark):
    for n in (5, 6, 9):
        v = np.random.default_rng(n).random(n)
        df = spark.createDataFrame([("s", 0, k, float(x)) for k, x in enumerate(v)], "sample string, frame int, y int, v double")
        found = [r.m for r in df.select("y", U.smoothed(df, "v", 2, M.KEYS).alias("m")).orderBy("y").collect()]
        q = np.pad(v, 2, mode="reflect")
        assert found == pytest.approx([q[k : k + 5].mean() for k in range(n)])


def textured(degrees, seed=3, size=61, r=26.0, fade=0.0):
    """A disc with smooth random texture, turned."""
    draw = np.random.default_rng(seed)
    waves = [(draw.integers(1, 9), draw.random() * 6.28, draw.uniform(20, 60), draw.uniform(0.5, 3)) for _ in range(9)]
    y, x = np.mgrid[:size, :size] - (size - 1) / 2
    turn, away = np.arctan2(y, x) - np.radians(degrees), np.hypot(x, y) / r
    return (away <= 1.1) * (120 + (1 - fade) * sum(a * np.sin(k * turn + p + q * away) for k, p, a, q in waves) / 3)


def turned(spark, pictures, r=26.0):
    p = pixels(spark, *pictures)
    places = spark.createDataFrame([("s", f, 30.0, 30.0, r) for f in range(len(pictures))], "sample string, frame int, cx double, cy double, r double")
    return R.texture_turns(p, places).orderBy("frame").collect()


@pytest.mark.parametrize("step", [17.3, -31.0, 0.4])
def test_turns_of_known_angle_also_beyond_half_a_turn(spark, step):
    rows = turned(spark, [textured(step * k) for k in range(14)])
    assert all(r.valid and abs(r.degrees - step * r.frame) <= 0.5 for r in rows)


def test_turns_with_frames_that_cannot_be_read(spark):
    angles = [0, 20, 40, 60, 80, 100, 120, 140]
    pictures = [textured(a) for a in angles]
    pictures[2], pictures[5] = textured(0, fade=1.0), 120 + 60 * np.random.default_rng(5).random((61, 61))  # without texture; something else
    rows = turned(spark, pictures)
    assert [r.valid for r in rows] == [True, True, False, True, True, False, True, True]
    assert all(abs(r.degrees - angles[r.frame]) <= 0.5 for r in rows if r.valid)
    assert not any(r.valid for r in turned(spark, [textured(0)], r=40.0)) and not any(r.valid for r in turned(spark, [textured(0)], r=5.0))


def test_the_chain_breaks_after_two_frames_and_repeated_marks_are_not_told_apart(spark):
    pictures = [textured(0), textured(10)] + [textured(0, fade=1.0)] * 3 + [textured(40)]
    assert [r.valid for r in turned(spark, pictures)] == [True, True] + [False] * 4
    y, x = np.mgrid[:61, :61] - 30.0
    spokes = lambda a: 100 + 50 * np.cos(3 * (np.arctan2(y, x) - np.radians(a)))
    assert [round(r.degrees) for r in turned(spark, [spokes(0), spokes(30), spokes(60)])] == [0, 30, 60]


def test_correlation_around_equals_shifting():
    draw = np.random.default_rng(1)
    a, b = draw.standard_normal((2, 5, 24))
    plain = [(a * np.roll(b, s, axis=1)).sum() / np.sqrt((a * a).sum() * (b * b).sum()) for s in range(24)]
    assert R.around(a, b) == pytest.approx(plain)


def test_rays_at_an_interface(spark):
    # a level interface at y = 50: one ray comes down at 30 degrees, one goes on at 20, one runs along it
    t30, t20 = float(np.tan(np.radians(30))), float(np.tan(np.radians(20)))
    rows = [("s", 0, 40 - 30 * t30, 20.0, 40 - 10 * t30, 40.0), ("s", 0, 40 + 10 * t20, 60.0, 40 + 40 * t20, 90.0), ("s", 0, 0.0, 50.0, 30.0, 50.1), ("s", 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, frame int, x0 double, y0 double, x1 double, y1 double")
    a, b = O.rays(df, (10.0, 50.0, 0.0, 1.0)).orderBy("side").collect()
    assert (a.side, b.side) == ("first", "second") and (a.angle, b.angle) == pytest.approx((30, 20)) and (a.along, b.along) == pytest.approx((-30, -30))
    assert (a.lean, b.lean) == pytest.approx((-t30, -t20))
    turned = df.selectExpr("sample", "frame", "y0 as x0", "x0 as y0", "y1 as x1", "x1 as y1")  # an upright interface
    assert [r.angle for r in O.rays(turned, (50.0, 10.0, 1.0, 0.0)).orderBy("side").collect()] == pytest.approx([30, 20])


def test_edges_of_a_beam_are_one_ray_and_beams_apart_two(spark):
    rows = [("s", 0, "first", 100.0, 30.0, 0.5, 50.0), ("s", 0, "first", 108.0, 31.0, 0.5, 100.0), ("s", 0, "first", 160.0, 30.0, 0.5, 20.0), ("s", 0, "first", 104.0, 30.0, -0.5, 20.0), ("s", 0, "second", 104.0, 30.0, 0.5, 20.0)]
    df = spark.createDataFrame(rows, "sample string, frame int, side string, along double, angle double, lean double, length double")
    found = {(r.side, r.cluster): r for r in O.ray_clusters(df, 400).collect()}
    assert len(found) == 4 and (found["first", 0].n, found["first", 0].length) == (2, 100.0)
    assert found["first", 0].along == pytest.approx((100 * 108 + 50 * 100) / 150) and found["first", 0].angle == pytest.approx((100 * 31 + 50 * 30) / 150)


def test_ridges_bright_and_dark(spark):
    y = np.full(60, 100.0)
    y[10:14] = [120, 150, 150, 120]
    y[30:32] = 60
    y[50] = 200  # a single place is no band
    rows = [("a", i, float(v)) for i, v in enumerate(np.where(np.arange(60) == 50, 150, y))] + [("b", i, 5.0) for i in range(9)]
    found = O.ridges(spark.createDataFrame(rows, "k string, i int, y double"), ["k"]).orderBy("start").collect()
    assert [(r.k, r.ridge, r.start, r.stop) for r in found] == [("a", 1, 11, 12), ("a", 2, 30, 31)] and [r.centre for r in found] == pytest.approx([11.5, 30.5])


def test_walls_of_a_drawn_vessel(spark):
    p = np.full((80, 120), 200.0)
    p[20:70, 30] = p[20:70, 85] = 40
    p[10:14, :] = 90  # a level line is no wall
    p[40:46, 57] = 60  # nor is a short mark
    (r,) = O.vessel_walls(pixels(spark, p, np.full((80, 120), 9.0))).collect()
    assert r.frame == 0 and abs(r.x0 - 30) <= 2 and abs(r.x1 - 85) <= 2 and abs(r.y0 - 20) <= 2 and abs(r.y1 - 69) <= 2
    near = np.full((80, 120), 200.0)
    near[20:70, 30] = near[20:70, 40] = 40  # too near each other
    assert O.walls(near) is None


def test_polar_pictures_hold_few_pictures_at_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"frame": list(range(1000))})
    found = list(R.parts([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert max(b.num_rows for b in found) == 256 and [k for b in found for k in b.column("frame").to_pylist()] == [*range(1000), 0, 1, 2]


def test_frames_are_dealt_out_before_they_become_pixels(spark):
    from tarnwick.plans import picture_queries as Q

    pixels, places = Q.discs(spark, "/root/testdata/sf0.001")
    assert pixels.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert places.count() * 23 * 23 == pixels.count()
    plan = pixels.groupBy("sample", "frame").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode", plan.index("HashAggregate")) < plan.index("Exchange hashpartitioning")
