"""Estimators per group: spreads, medians, line, parabola, sine and circle fits in closed form.

All are aggregations with map-side partial sums except the exact medians. Times are centred
before powers are summed. What needs iterations is in operators.kernels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.kernels import catenary_grid, crossings, grouped
from tarnwick.operators.kernels import theil_sen as theil_sen_kernel

MAD_SCALE = 1.4826


def cv_sample(x: Column) -> Column:
    """Sample deviation over |mean|; null below two values or at a mean of 0."""
    return F.when((F.count(x) >= 2) & (F.abs(F.avg(x)) >= 1e-12), F.try_divide(F.stddev_samp(x), F.abs(F.avg(x))))


def cv_population(x: Column) -> Column:
    return F.when((F.count(x) >= 1) & (F.abs(F.avg(x)) >= 1e-12), F.try_divide(F.stddev_pop(x), F.avg(x)))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def with_median(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """The group's exact median on every row."""
    return df.withColumn(name, F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*keys)))


def mad(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """med, and scale: 1.4826 times the median distance from it."""
    out = with_median(df, keys, x, "_m").groupBy(*keys)
    return out.agg(F.max("_m").alias("med"), (MAD_SCALE * F.percentile(F.abs(F.col(x) - F.col("_m")), F.lit(0.5))).alias("scale"), F.count(x).alias("n"))


def robust_cv(df: DataFrame, keys: list[str], x: str, least: int = 2) -> DataFrame:
    """scale over the median of the positive values, of `least` at least."""
    out = mad(df.filter(F.col(x) > 0), keys, x)
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.try_divide(F.col("scale"), F.col("med"))).alias("robust_cv"))


def reject_outliers(df: DataFrame, keys: list[str], x: str, k: float) -> DataFrame:
    """Rows within k robust deviations of their group's median."""
    part = Window.partitionBy(*keys)
    df = with_median(df, keys, x, "_m")
    df = df.withColumn("_s", MAD_SCALE * F.percentile(F.abs(F.col(x) - F.col("_m")), F.lit(0.5)).over(part))
    return df.filter(F.abs(F.col(x) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")


def weighted_median(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """The first value, in order, at which the weights so far reach half of all."""
    order, part = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    df = df.withColumns({"_c": F.sum(w).over(order), "_t": F.sum(w).over(part)})
    return df.groupBy(*keys).agg(F.min(F.when(F.col("_c") >= F.col("_t") / 2, F.col(x))).alias("weighted_median"))


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, slope, intercept, rmse, slope_se and the 95 % bounds of the slope."""
    a, b = F.col(x), F.col(y)
    out = df.groupBy(*keys).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"),
    )
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    se = F.sqrt(F.try_divide(left / F.greatest(F.lit(1), F.col("n") - 2), F.col("sxx")))
    out = out.withColumns({"rmse": F.sqrt(left / F.col("n")), "slope_se": se})
    return out.select(*keys, "n", "slope", "intercept", "rmse", "slope_se", (F.col("slope") - 1.96 * F.col("slope_se")).alias("low"), (F.col("slope") + 1.96 * F.col("slope_se")).alias("high"))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, slope (the median over pairs of a group's points) and intercept (the median of what it leaves).

    A group is the frames of a clip. Its pairs are made in blocks inside its own task, so that no pair is ever a row and
    memory is bounded for any length.
    """
    kinds = dict(df.select(*keys).dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, slope double, intercept double"
    points = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    return grouped(points, keys, ["_x", "_y"], lambda c: [theil_sen_kernel(c["_x"], c["_y"])], schema)


def centred(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Each column less its group's mean."""
    part = Window.partitionBy(*keys)
    return df.withColumns({f"_{c}": F.col(c) - F.avg(c).over(part) for c in columns})


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """Cramer's rule; null where the matrix is singular."""
    whole = det3(m)
    swap = lambda k: det3([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])
    return [F.try_divide(swap(k), whole) for k in range(3)]


def normal3(df: DataFrame, keys: list[str], basis: list[Column], y: Column) -> DataFrame:
    """c0, c1, c2 of the least-squares combination of three basis columns, n and rmse."""
    return normal3s(df, keys, basis, {"": y}).select(*keys, "n", "c0", "c1", "c2", "rmse")


def normal3s(df: DataFrame, keys: list[str], basis: list[Column], ys: dict[str, Column], *more: Column) -> DataFrame:
    """n, c0, c1, c2 and rmse, each with the name of its y behind it, by one aggregation for all ys, and further aggregates with it."""
    sums = {f"m{r}{c}": F.sum(basis[r] * basis[c]) for r in range(3) for c in range(r, 3)}
    for name, y in ys.items():
        sums |= {f"n{name}": F.count(y), f"yy{name}": F.sum(y * y)} | {f"v{r}{name}": F.sum(basis[r] * y) for r in range(3)}
    out = df.groupBy(*keys).agg(*[s.alias(k) for k, s in sums.items()], *more)
    m = [[F.col(f"m{min(r, c)}{max(r, c)}") for c in range(3)] for r in range(3)]
    for name in ys:
        v = [F.col(f"v{r}{name}") for r in range(3)]
        out = out.withColumns({f"c{k}{name}": c for k, c in enumerate(solve3(m, v))})
        left = F.col(f"yy{name}") - F.col(f"c0{name}") * v[0] - F.col(f"c1{name}") * v[1] - F.col(f"c2{name}") * v[2]
        out = out.withColumn(f"rmse{name}", F.sqrt(F.try_divide(F.greatest(F.lit(0.0), left), F.col(f"n{name}"))))
    return out.drop(*sums.keys() - {f"n{name}" for name in ys})


def parabola(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = c0 + c1 u + c2 u u with u = x less its mean."""
    df = centred(df, keys, x)
    u = F.col(f"_{x}")
    return normal3(df, keys, [F.lit(1.0), u, u * u], F.col(y))


def sinusoid(df: DataFrame, keys: list[str], t: str, y: str, period: float) -> DataFrame:
    """y = c0 + c1 cos + c2 sin at a given period, with amplitude."""
    phase = 2 * 3.141592653589793 * F.col(t) / period
    out = normal3(df, keys, [F.lit(1.0), F.cos(phase), F.sin(phase)], F.col(y))
    return out.withColumn("amplitude", F.hypot("c1", "c2"))


def sinusoid_trend(df: DataFrame, keys: list[str], t: str, y: str, period: float) -> DataFrame:
    """n, trend, amplitude, phase and rmse of y = a + trend t + amplitude sin(2 pi t / period + phase); null where the points do not determine them.

    Offset and trend are taken out of the wave and of y by covariances with t, which leaves two unknowns.
    """
    turn = 2 * math.pi / period
    df = df.withColumns({"_c": F.cos(F.col(t) * turn), "_s": F.sin(F.col(t) * turn)})
    pairs = {f"{a}{b}": (ca, cb) for a, ca in (("c", "_c"), ("s", "_s"), ("y", y), ("t", t)) for b, cb in (("c", "_c"), ("s", "_s"), ("y", y), ("t", t)) if a <= b}
    m = df.groupBy(*keys).agg(F.count(y).alias("n"), *[F.covar_pop(a, b).alias(f"_{n}") for n, (a, b) in pairs.items()])
    cov = lambda a, b: F.col(f"_{min(a, b)}{max(a, b)}")
    p = lambda a, b: cov(a, b) - F.try_divide(cov(a, "t") * cov(b, "t"), F.col("_tt"))
    det = p("c", "c") * p("s", "s") - p("c", "s") * p("c", "s")
    fine = (F.col("n") >= 5) & (det > 1e-12)
    cos, sin = (F.when(fine, x / det) for x in (p("c", "y") * p("s", "s") - p("s", "y") * p("c", "s"), p("s", "y") * p("c", "c") - p("c", "y") * p("c", "s")))
    m = m.withColumns({"_a": cos, "_b": sin})
    left = F.greatest(F.lit(0.0), p("y", "y") - F.col("_a") * p("c", "y") - F.col("_b") * p("s", "y"))
    trend = F.try_divide(cov("t", "y") - F.col("_a") * cov("c", "t") - F.col("_b") * cov("s", "t"), F.col("_tt"))
    return m.select(*keys, "n", trend.alias("trend"), F.hypot("_a", "_b").alias("amplitude"), F.atan2("_a", "_b").alias("phase"), F.when(F.col("_a").isNotNull(), F.sqrt(left)).alias("rmse"))


def circle(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """cx, cy, radius of the algebraic least-squares circle (x x + y y = 2 cx x + 2 cy y + d)."""
    part = Window.partitionBy(*keys)
    df = centred(df, keys, x, y).withColumns({"_mx": F.avg(x).over(part), "_my": F.avg(y).over(part)})
    a, b = F.col(f"_{x}"), F.col(f"_{y}")
    means = df.groupBy(*keys).agg(F.max("_mx").alias("mx"), F.max("_my").alias("my"))
    out = normal3(df, keys, [F.lit(1.0), a, b], a * a + b * b).join(means, keys)
    cx, cy = F.col("c1") / 2, F.col("c2") / 2
    return out.select(*keys, "n", (F.col("mx") + cx).alias("cx"), (F.col("my") + cy).alias("cy"), F.sqrt(F.greatest(F.lit(0.0), F.col("c0") + cx * cx + cy * cy)).alias("radius"))


def principal_axis(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """angle (degrees, of the direction of most variance), along and across: deviations in and perpendicular to it."""
    out = df.groupBy(*keys).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"), F.count("*").alias("n"))
    half, mean = F.hypot((F.col("a") - F.col("b")) / 2, F.col("c")), (F.col("a") + F.col("b")) / 2
    angle = F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2
    return out.select(*keys, "n", angle.alias("angle"), F.sqrt(mean + half).alias("along"), F.sqrt(F.greatest(F.lit(0.0), mean - half)).alias("across"))


def common_point(df: DataFrame, keys: list[str], nx: str, ny: str, c: str) -> DataFrame:
    """px, py: the point with the least sum of squared distances to lines n p = c, and the rms distance."""
    a, b, d = F.col(nx), F.col(ny), F.col(c)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * d).alias("ad"), F.sum(b * d).alias("bd"), F.sum(d * d).alias("dd"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    out = out.withColumns({"px": F.try_divide(F.col("ad") * F.col("bb") - F.col("bd") * F.col("ab"), det), "py": F.try_divide(F.col("aa") * F.col("bd") - F.col("ab") * F.col("ad"), det)})
    left = F.col("dd") - F.col("px") * F.col("ad") - F.col("py") * F.col("bd")
    return out.select(*keys, "n", "px", "py", F.sqrt(F.greatest(F.lit(0.0), left) / F.col("n")).alias("rms"))


def pairwise_intersections(df: DataFrame, keys: list[str], nx: str, ny: str, c: str, least_degrees: float = 20.0) -> DataFrame:
    """For each group the number of its line pairs that cross at least_degrees or more, and the median crossing point.

    Lines of a group (the rays of one picture) are paired in blocks inside its own task. Groups without such a pair are left out.
    """
    kinds = dict(df.select(*keys).dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pairs long, x double, y double"
    lines = df.select(*keys, *[F.col(k).cast("double").alias(n) for k, n in ((nx, "_a"), (ny, "_b"), (c, "_c"))])
    return grouped(lines, keys, ["_a", "_b", "_c"], lambda g: [crossings(g["_a"], g["_b"], g["_c"], least_degrees)], schema).filter("pairs > 0")


def catenary(df: DataFrame, keys: list[str], x: str, y: str, width: float = 0.0, shapes: list[float] | None = None, centres: list[float] | None = None, signs: tuple[int, ...] = (1, -1)) -> DataFrame:
    """The best of a grid of hanging and standing curves y = sign a cosh((x - x0) / a) + offset, by rmse about the median offset.

    Without shapes and centres the grid has 30 shapes by the width of the picture and 11 centres by the span of x. All
    curves of a group are tried at once; of equally good ones the first by sign (in the order given), a and x0 is taken.
    """
    kinds = dict(df.select(*keys).dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sign int, a double, x0 double, offset double, rmse double"
    points = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    return grouped(points, keys, ["_x", "_y"], lambda c: [catenary_grid(c["_x"], c["_y"], width, shapes, centres, signs)], schema)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ties are broken by the order given."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
