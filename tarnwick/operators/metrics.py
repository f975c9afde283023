"""The metrics of forty experiments: from measured quantities to M1 and M2.

A measurement row holds a sample's task and its quantities, map<string, double>. Every metric is a
column expression over that map, so all tasks are scored in one projection without a shuffle. A
metric whose quantities are missing is unmeasurable (null score); a metric that a task does not have
is undefined and is no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.geometry import ICE_DENSITY, PERIOD_RATIO_30_15, ROLLING_RATIO, WATER_INDEX, incline_ratio
from tarnwick.functions.scores import angle_score, clip01, count_direction, residual_score, saturated_ratio, strict_gm_of, two_halves

Get = Callable[[str], Column]


def q(error: Column, scale: float) -> Column:
    return residual_score(error, scale)


def gm(*values: Column) -> Column:
    return strict_gm_of(list(values))


def fixed(flag: Column, score: float, otherwise: Column) -> Column:
    """An observed outcome with a score of its own."""
    return F.when(F.coalesce(flag, F.lit(0.0)) == 1, F.lit(score)).otherwise(otherwise)


def indicator(condition: Column) -> Column:
    return condition.cast("double")


def p1(m: Get):
    cor = F.when(m("cor_cv").isNotNull(), gm(q(m("height_rise"), 0.15), q(m("cor_cv"), 0.35))).otherwise(q(m("height_rise"), 0.15))
    return fixed(m("single_motion"), 0.1, gm(q(m("height_time"), 0.18), q(m("passive_excess"), 0.15))), fixed(m("single_motion"), 0.1, cor)


def p4(m: Get):
    shape = F.coalesce(F.try_divide(m("height"), m("range")), F.try_divide(m("height"), 2 * m("apex_x")))
    return q(shape - 0.25, 0.1), gm(q(m("cv_vx"), 0.1), q(m("cv_dvy"), 0.1), q(m("rms_over_range"), 0.05))


def p6(m: Get):
    return fixed(m("both_stationary"), 0.7, q(F.try_divide(m("onset_left") - m("onset_right"), m("frames")), 1)), fixed(m("both_stationary"), 0.7, q(m("angle_gap"), 90))


def p13(m: Get):
    r = F.try_divide(m("t30"), m("t15"))
    return q(r - PERIOD_RATIO_30_15, 0.05), clip01((r - 1) / (PERIOD_RATIO_30_15 - 1))


def p14(m: Get):
    r = F.try_divide(m("t_short"), m("t_long"))
    return q(F.try_divide(r * r, F.try_divide(m("l_short"), m("l_long"))) - 1, 0.20), gm(q(m("cv_short"), 0.20), q(m("cv_long"), 0.20))


def p27(m: Get):
    melted = F.when(F.coalesce(m("ice_remains"), F.lit(0.0)) == 1, F.lit(0.0)).otherwise(clip01(1 - m("residual")))
    return indicator(m("rise") > m("uncertainty")), melted


def p38(m: Get):
    r = F.try_divide(m("r1"), m("r2"))
    return F.when(F.greatest(r, F.try_divide(F.lit(1.0), r)) >= 1.1, q(F.try_divide(F.try_divide(m("v1"), m("v2")), r * r) - 1, 1)), None


#: M1 and M2 (None: undefined) of each task.
FORMULAS: dict[str, Callable[[Get], tuple[Column, Column | None]]] = {
    "P1": p1,
    "P2": lambda m: (q(m("cv_dv"), 0.1), q(m("thirds_rms"), 0.1)),
    "P3": lambda m: (q(F.try_divide(m("r30"), m("r60")) - 1, 0.15), gm(q(m("rmse30"), 0.30), q(m("rmse60"), 0.30), q(m("speed_error"), 0.20))),
    "P4": p4,
    "P5": lambda m: (q(F.try_divide(m("v1_after") + m("v2_after"), m("v1")) - 1, 0.1), None),
    "P6": p6,
    "P7": lambda m: (q(F.try_divide(m("rmse"), m("sag")), 0.10), q(F.try_divide(m("support_dy"), m("span")), 0.02)),
    "P8": lambda m: (q(F.try_divide(m("way"), m("radius") * m("turned")) - 1, 0.25), q(m("slip"), 0.35)),
    "P9": lambda m: (q(m("time_ratio") / ROLLING_RATIO - 1, 0.10), None),
    "P10": lambda m: (F.when(m("rotation") >= 5, q(F.greatest(m("pivot"), m("contact"), m("shape")), 0.02)).when(m("rotation").isNotNull(), F.lit(0.0)), None),
    "P11": lambda m: (fixed(m("ascent_only"), 0.1, q(F.try_divide(F.try_divide(m("a_up"), m("a_down")), incline_ratio(m("angle"), 0.20)) - 1, 0.10)), None),
    "P12": lambda m: (q(F.try_divide(m("t_heavy"), m("t_light")) - 1, 0.1), q(F.try_divide(F.abs(m("l_left") - m("l_right")), (m("l_left") + m("l_right")) / 2), 0.1)),
    "P13": p13,
    "P14": p14,
    "P15": lambda m: (q(F.try_divide(m("t_left"), m("t_right")) - 1, 0.1), gm(q(m("sine_left"), 0.1), q(m("sine_right"), 0.1))),
    "P16": lambda m: (q(m("cv"), 0.1), q(m("collinearity"), 0.05)),
    "P17": lambda m: (q(F.try_divide(F.sin(F.radians(m("incident"))), F.sin(F.radians(m("refracted")))) - WATER_INDEX, 0.12), q(F.try_divide(m("dx"), m("width")), 0.025)),
    "P18": lambda m: (q(m("incident") - m("reflected"), 90), q(F.try_divide(m("contact_error"), m("diagonal")), 1)),
    "P19": lambda m: (q(F.try_divide(m("line_rms"), m("diagonal")), 0.05), q(F.try_divide(m("mean_sd"), m("diagonal")), 0.05)),
    "P20": lambda m: (F.when(m("estimates") >= 2, q(m("index_cv"), 0.05)), None),
    "P21": lambda m: (q(F.try_divide(m("level_left") - m("level_right"), m("height")), 1), q(F.try_divide(m("slope"), m("height")), 1)),
    "P22": lambda m: (q(m("submerged") - ICE_DENSITY, 0.1), q(F.try_divide(m("dy"), m("width")), 0.05)),
    "P23": lambda m: (q(m("angle") - 90, 5), gm(q(m("surface_rms"), 3), q(m("path_rms"), 8))),
    "P24": lambda m: (q(F.try_divide(m("h_ice"), m("h_water")) - 1000 / 917, 1), q(F.try_divide(F.abs(m("w_end") - m("w_start")), m("w_start")), 1)),
    "P25": lambda m: (q(F.try_divide(m("d_level"), m("height")), 0.05), q(F.try_divide(m("d_width"), m("width")), 0.05)),
    "P26": lambda m: (F.when(F.abs(m("change")) > m("uncertainty"), indicator(m("change") < 0)), None),
    "P27": p27,
    "P28": lambda m: (m("lead"), None),
    "P29": lambda m: (indicator(F.try_divide(m("t_metal"), m("t_plain")) > 1), indicator(F.try_divide(m("v_metal"), m("v_plain")) < 1)),
    "P30": lambda m: (two_halves(m("entered"), m("lit")), None),
    "P31": lambda m: (q(m("angle_gap"), 90) * m("configuration"), q(F.ln(F.try_divide(F.when(m("d_left") > 0, m("d_left")), F.when(m("d_right") > 0, m("d_right")))), 1) * m("configuration")),
    "P32": lambda m: (angle_score(m("direction")), None),
    "P33": lambda m: (saturated_ratio(m("h_open"), m("h_closed"), 0.2), None),
    "P34": lambda m: (count_direction(m("n_solid"), m("n_slotted")), None),
    "P35": lambda m: (q(F.try_divide(m("angle_small"), m("angle_large")) - 1, 1), q(m("asymmetry"), 90)),
    "P36": lambda m: (q(F.abs(m("beta_water") - 0.5) + F.abs(m("beta_sand")), 1), None),
    "P37": lambda m: (indicator(m("rise") > F.greatest(F.lit(1.0), m("mad"), m("rms"))), None),
    "P38": p38,
    "P39": lambda m: (fixed(m("straight"), 0.0, q(m("radius_error"), 1)), None),
    "P40": lambda m: (q(F.try_divide(F.pow(m("r_final"), 3), F.pow(m("r1"), 3) + F.pow(m("r2"), 3)) - 1, 0.1), q(m("roundness_change"), 0.1)),
}
SECOND_UNDEFINED = tuple(t for t, f in FORMULAS.items() if t in ("P5", "P9", "P10", "P11", "P20", "P26", "P28", "P30", "P32", "P33", "P34", "P36", "P37", "P38", "P39"))

#: The quantities that the formulas read.
QUANTITIES = tuple(
    """
    cor_cv height_rise single_motion height_time passive_excess cv_dv thirds_rms r30 r60 rmse30 rmse60 speed_error height range apex_x cv_vx cv_dvy
    rms_over_range v1_after v2_after v1 both_stationary onset_left onset_right frames angle_gap rmse sag support_dy span way radius turned slip
    time_ratio rotation pivot contact shape ascent_only a_up a_down angle t_heavy t_light l_left l_right t30 t15 t_short t_long l_short l_long cv_short
    cv_long t_left t_right sine_left sine_right cv collinearity incident refracted dx width reflected contact_error diagonal line_rms mean_sd estimates
    index_cv level_left level_right slope submerged dy surface_rms path_rms h_ice h_water w_end w_start d_level d_width change uncertainty ice_remains
    residual rise lead t_metal t_plain v_metal v_plain entered lit configuration d_left d_right direction h_open h_closed n_solid n_slotted angle_small
    angle_large asymmetry beta_water beta_sand mad rms r1 r2 v2 straight radius_error r_final roundness_change
    """.split()
)


@cache
def needs(formula: Callable[[Get], tuple[Column, Column | None]]) -> list[str]:
    """The quantities that a formula reads, in order."""
    read: dict[str, None] = {}
    formula(lambda name: read.setdefault(name) or F.lit(1.0))
    return list(read)


def scored(measurements: DataFrame, quantities: str = "quantities", task: str = "task") -> DataFrame:
    """m1, m2 and has_m2 beside each measurement row; unknown tasks get nulls.

    Only the few quantities of a row's own task are looked up; every formula reads them by their place.
    """
    wanted = {name: needs(formula) for name, formula in FORMULAS.items()}
    by_task = F.create_map(*[x for name, names in wanted.items() for x in (F.lit(name), F.array(*map(F.lit, names)))])
    held = F.transform(F.try_element_at(by_task, F.col(task)), lambda n: F.try_element_at(F.col(quantities), n))
    places = [f"_q_{k}" for k in range(max(map(len, wanted.values())))]
    wide = measurements.select("*", held.alias("_q")).select(*measurements.columns, *[F.get("_q", F.lit(k)).alias(c) for k, c in enumerate(places)])
    both = {name: formula(dict(zip(wanted[name], map(F.col, places))).__getitem__) for name, formula in FORMULAS.items()}

    def chosen(k: int) -> Column:
        out = F
        for name, pair in both.items():
            if pair[k] is not None:
                out = out.when(F.col(task) == name, pair[k])
        return out.otherwise(F.lit(None).cast("double"))

    known, without = F.col(task).isin(*FORMULAS), F.col(task).isin(*SECOND_UNDEFINED)
    return wide.select(*measurements.columns, chosen(0).alias("m1"), chosen(1).alias("m2"), (known & ~without).alias("has_m2"))


def metric_rows(measurements: DataFrame, quantities: str = "quantities") -> DataFrame:
    """One row for each sample and defined metric: metric_id, status and physics_score."""
    rows = scored(measurements, quantities).filter(F.col("task").isin(*FORMULAS))
    first = F.struct(F.lit("M1").alias("metric_id"), F.lit(True).alias("defined"), F.col("m1").alias("physics_score"))
    second = F.struct(F.lit("M2").alias("metric_id"), F.col("has_m2").alias("defined"), F.col("m2").alias("physics_score"))
    rows = rows.withColumn("m", F.explode(F.array(first, second))).select(*measurements.columns, "m.*")
    status = F.when(~F.col("defined"), "not_applicable").when(F.col("physics_score").isNull(), "unmeasurable").otherwise("measured")
    return rows.withColumn("status", status)
