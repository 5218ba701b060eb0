"""Speed calibration: robust bounded fits of ride times, for all groups in the same passes.

Bus: tt = c (n + 1) + hold [boarded at the terminal] + b d; subway: tt = a + c n + b d, with b = 3.6 / v.
The loss is the soft L1 of the residuals. A pass is one aggregation for every group, of the sums of two kinds of steps: Newton's,
by the loss's own curvature, and that of reweighted least squares, which never makes the loss grow. The driver solves both,
one to three bounded variables a group; the next pass looks at both points and goes on from the better one. Newton's takes
over near the end, so a handful of passes do. Rows are collapsed to distinct values first and written once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import period
from fareflow.operators.quantiles import quantiles

#: Bounds of speed (km/h), time per stop, hold and intercept (s), and the residual scale.
SPEED_KMH = {"bus": (4.0, 80.0), "subway": (15.0, 90.0)}
DWELL_S, HOLD_S, INTERCEPT_S = (5.0, 180.0), (0.0, 900.0), (0.0, 1800.0)
SCALE_S = {"bus": 90.0, "subway": 120.0}
DWELL_PRIOR_S = {"bus": 25.0, "subway": 35.0}


def prepare(matched: DataFrame) -> DataFrame:
    """Rides on one line with plausible times: tt, period, is_terminal and the columns the fits need."""
    tt = F.when(F.col("mode") == "subway", F.col("tt_adj_s")).otherwise(F.col("tt_s"))
    rides = matched.where("same_line and route_name is not null and route_dist_m > 300").withColumns({
        "tt": tt, "period": period(F.col("dep_s")), "is_terminal": (F.col("o_idx") == 0).cast("double"), "kmh": F.col("route_dist_m") / tt * 3.6})
    top = F.when(F.col("mode") == "bus", 80.0).otherwise(120.0)
    return rides.where(F.col("tt").between(60, 7200) & (F.col("kmh") >= 2) & (F.col("kmh") <= top))


def groups(prepared: DataFrame, min_mode: int = 500, min_line: int = 150, min_std: float = 300) -> DataFrame:
    """(mode, route_name, period, n): groups large enough for a fit; null and "all" stand for all lines and times."""
    counted = prepared.groupingSets(
        [["mode"], ["mode", "period"], ["mode", "route_name"], ["mode", "route_name", "period"]], "mode", "route_name", "period",
    ).agg(F.count("*").alias("n"), F.stddev_samp("route_dist_m").alias("sd"), F.grouping("route_name").alias("g"))
    enough = F.when(F.col("g") == 1, F.col("n") >= min_mode).otherwise((F.col("n") >= min_line) & (F.col("sd") >= min_std))
    return counted.where(enough).select("mode", "route_name", F.coalesce("period", F.lit("all")).alias("period"), "n")


def solved(xx: np.ndarray, xy: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least squares solution within bounds, by trying each set of active bounds."""
    best, least = np.clip(np.zeros(len(xy)), low, high), np.inf
    for state in itertools.product((0, -1, 1), repeat=len(xy)):
        at = np.array(state)
        x = np.where(at < 0, low, np.where(at > 0, high, 0.0))
        free = at == 0
        if free.any():
            try:
                x[free] = np.linalg.solve(xx[np.ix_(free, free)], xy[free] - xx[np.ix_(free, ~free)] @ x[~free])
            except np.linalg.LinAlgError:
                continue
        if (x < low - 1e-9).any() or (x > high + 1e-9).any():
            continue
        value = x @ xx @ x - 2 * xy @ x
        if value < least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0):
            best, least = x, value
    return np.clip(best, low, high)


def collapsed(prepared: DataFrame) -> DataFrame:
    """Distinct rides with their count, once for each period and for "all"."""
    rows = prepared.select("mode", "route_name", F.explode(F.array("period", F.lit("all"))).alias("period"), F.col("route_dist_m").alias("d"), F.col("n_intermediate").cast("double").alias("n"), F.col("is_terminal").alias("h"), "tt")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("w"))


def robust_fit(rows: DataFrame, keys: list[str], starts: dict[tuple, dict], passes: int = 30, tolerance: float = 1e-10) -> dict[tuple, np.ndarray]:
    """rows: keys, x0, x1, x2, y, w. starts: by key, x (first values), low, high, scale. One aggregation a pass.

    A group is done when Newton's step from its point is below the tolerance, or its loss falls no more.
    """
    spark, best = rows.sparkSession, {}
    tried = {k: [np.clip(np.array(v["x"], float), v["low"], v["high"])] for k, v in starts.items()}
    kinds = ", ".join([*(f"`{k}` string" for k in keys), "point int, p0 double, p1 double, p2 double, scale double"])
    square = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(passes):
        if not tried:
            break
        points = [(*k, n, *x.tolist(), starts[k]["scale"]) for k, xs in sorted(tried.items()) for n, x in enumerate(xs)]
        joined = rows.join(F.broadcast(spark.createDataFrame(points, kinds)), keys)  # twice as many rows as groups of modes, periods and lines
        r = F.col("y") - sum(F.col(f"p{i}") * F.col(f"x{i}") for i in range(3))
        z = F.col("r") / F.col("scale")
        seen = joined.withColumn("r", r).withColumn("q", F.sqrt(1 + z * z)).withColumns({"v": F.col("w") / F.col("q"), "u": F.col("w") / (F.col("q") * F.col("q") * F.col("q"))})
        sums = [F.sum(F.col(c) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"{c}{i}{j}") for c in "vu" for i, j in square]
        sums += [F.sum(F.col("v") * F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(3)]
        # sqrt(1 + z^2) - 1 without the loss of digits at small z
        sums.append(F.sum(F.col("w") * z * z / (F.col("q") + 1)).alias("loss"))
        found = {(tuple(row[c] for c in keys), row["point"]): row for row in seen.groupBy(*keys, "point").agg(*sums).collect()}
        after = {}
        for k, xs in tried.items():
            low, high = (np.array(starts[k][c]) for c in ("low", "high"))
            at = min((n for n in range(len(xs)) if (k, n) in found), key=lambda n: found[k, n]["loss"], default=None)
            if at is None:  # a group without rows stays where it began
                best.setdefault(k, (np.inf, xs[0]))
                continue
            row, x = found[k, at], xs[at]
            if k in best and row["loss"] >= best[k][0] * (1 - 1e-15):
                continue
            best[k] = row["loss"], x
            steps = []
            for c in "uv":
                xx = np.zeros((3, 3))
                for i, j in square:
                    xx[i, j] = xx[j, i] = row[f"{c}{i}{j}"]
                steps.append(solved(xx, xx @ x + np.array([row[f"g{i}"] for i in range(3)]), low, high))
            if np.abs(steps[0] - x).max() > tolerance * max(1.0, np.abs(x).max()):
                after[k] = steps
        tried = after
    return {k: x for k, (_, x) in best.items()}


def _b(mode: str) -> tuple[float, float]:
    return 3.6 / SPEED_KMH[mode][1], 3.6 / SPEED_KMH[mode][0]


def _design(rows: DataFrame, keys: list[str]) -> DataFrame:
    """x0: the dwell's factor; x1: hold (bus) or intercept (subway); x2: metres."""
    bus = F.col("mode") == "bus"
    return rows.select(*keys, F.when(bus, F.col("n") + 1).otherwise(F.col("n")).alias("x0"), F.when(bus, F.col("h")).otherwise(1.0).alias("x1"), F.col("d").alias("x2"), F.col("tt").alias("y"), "w")


def fit(prepared: DataFrame, cut: Callable[[DataFrame], DataFrame], min_mode: int = 500, min_line: int = 150, min_std: float = 300) -> DataFrame:
    """(scope, key, mode, period, dwell_s, terminal_hold_s, intercept_s, b, speed_kmh, n_obs) of all groups.

    Modes first; lines then take the time per stop of their mode's period, and the hold of its "all". `cut` writes the
    collapsed rides, which all passes read, and reads them back.
    """
    spark, small = prepared.sparkSession, cut(collapsed(prepared))
    sizes = {(r["mode"], r["route_name"], r["period"]): r["n"] for r in groups(prepared, min_mode, min_line, min_std).collect()}
    starts = {}
    for mode, line, when in sizes:
        if line is None:
            fixed = DWELL_PRIOR_S["subway"]
            low, high = ((DWELL_S[0], HOLD_S[0]), (DWELL_S[1], HOLD_S[1])) if mode == "bus" else ((fixed, INTERCEPT_S[0]), (fixed, INTERCEPT_S[1]))
            first = (25.0, 60.0, 0.18) if mode == "bus" else (fixed, 300.0, 0.09)
            starts[mode, when] = {"x": first, "low": (*low, _b(mode)[0]), "high": (*high, _b(mode)[1]), "scale": SCALE_S[mode]}
    modes = robust_fit(_design(small, ["mode", "period"]), ["mode", "period"], starts)
    starts = {}
    for mode, line, when in sizes:
        if line is not None and (mode, "all") in modes:
            c, hold = modes.get((mode, when), modes[mode, "all"])[0], modes[mode, "all"][1] if mode == "bus" else 0.0
            middle = (hold, hold) if mode == "bus" else INTERCEPT_S
            starts[mode, line, when] = {"x": (c, hold if mode == "bus" else 300.0, 0.15), "low": (c, middle[0], _b(mode)[0]), "high": (c, middle[1], _b(mode)[1]), "scale": SCALE_S[mode]}
    keys = ["mode", "route_name", "period"]
    lines = robust_fit(_design(small, keys), keys, starts)
    rows = []
    for k, (c, middle, b) in {**{(m, None, p): v for (m, p), v in modes.items()}, **lines}.items():
        mode, line, when = k
        hold, a = (float(modes[mode, "all"][1]) if (mode, "all") in modes else float(middle), 0.0) if mode == "bus" else (0.0, float(middle))
        rows.append(("mode" if line is None else "line", line or mode, mode, when, float(c), float(middle) if mode == "bus" else 0.0, hold, a, float(b), 3.6 / float(b), sizes[k]))
    return spark.createDataFrame(rows, "scope string, key string, mode string, period string, dwell_s double, fitted_hold_s double, terminal_hold_s double, intercept_s double, b double, speed_kmh double, n_obs long")


def predict(prepared: DataFrame, fits: DataFrame) -> DataFrame:
    """prepared rides with their mode's all-day prediction and residual. A fit per mode goes to every task, so a mode's rides stay in many."""
    p = fits.where("scope = 'mode' and period = 'all'").select("mode", F.col("dwell_s").alias("_c"), F.col("fitted_hold_s").alias("_h"), F.col("intercept_s").alias("_a"), F.col("b").alias("_b"))
    stops = F.col("n_intermediate") + F.when(F.col("mode") == "bus", 1).otherwise(0)
    made = F.col("_a") + F.col("_c") * stops + F.col("_h") * F.col("is_terminal") + F.col("_b") * F.col("route_dist_m")
    return prepared.join(F.broadcast(p), "mode").withColumn("pred", made).withColumn("resid", F.col("tt") - F.col("pred")).drop("_a", "_b", "_c", "_h")


def _diagonal_of_inverse(s: dict[tuple[int, int], Column]) -> list[Column]:
    """Of a symmetric matrix of three rows, by its minors; null where it has no inverse."""
    minors = [s[1, 1] * s[2, 2] - s[1, 2] * s[1, 2], s[0, 0] * s[2, 2] - s[0, 2] * s[0, 2], s[0, 0] * s[1, 1] - s[0, 1] * s[0, 1]]
    det = s[0, 0] * minors[0] - s[0, 1] * (s[0, 1] * s[2, 2] - s[1, 2] * s[0, 2]) + s[0, 2] * (s[0, 1] * s[1, 2] - s[1, 1] * s[0, 2])
    return [F.when(det > 0, m / det) for m in minors]


def fit_quality(prepared: DataFrame, fits: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per fit: n, rmse, mae, median residual, the robust scale 1.4826 MAD, and standard errors, over collapsed rides.

    `cut` writes the rides' residuals, which are read three times, and reads them back.

    The errors are the scale times the roots of the diagonal of the inverse of J'J, where J has the fitted variables only and
    is weighted as the loss has it: (1 + z^2)^-1.5 in the square, z being the residual over SCALE_S. Fixed variables have none.
    """
    small = collapsed(prepared)
    both = small.select(F.explode(F.array(F.col("mode"), F.col("route_name"))).alias("key"), "*")
    f = fits.select("key", F.col("mode").alias("_m"), F.col("period").alias("_p"), "scope", "dwell_s", "fitted_hold_s", "intercept_s", "b", F.col("n_obs"))
    joined = both.join(f.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & (F.col("mode") == F.col("_m")) & (F.col("period") == F.col("_p")))
    bus, whole = F.col("mode") == "bus", F.col("scope") == "mode"
    stops = F.col("n") + F.when(bus, 1).otherwise(0)
    r = F.col("tt") - F.col("intercept_s") - F.col("dwell_s") * stops - F.col("fitted_hold_s") * F.col("h") - F.col("b") * F.col("d")
    keys = ["scope", "key", "mode", "period"]
    # a fixed variable is 0 in all rows and has 1 on the diagonal
    x = [F.when(bus & whole, stops).otherwise(0.0), F.when(bus & whole, F.col("h")).when(~bus, 1.0).otherwise(0.0), F.col("d")]
    rows = joined.select(*keys, "b", r.alias("r"), "w", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    z = F.col("r") / F.when(bus, SCALE_S["bus"]).otherwise(SCALE_S["subway"])
    rows = cut(rows.withColumn("v", F.col("w") * F.pow(1 + z * z, F.lit(-1.5))))
    n = F.sum("w")
    sums = [F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)]
    one = rows.groupBy(*keys).agg(
        n.alias("n"), F.sqrt(F.sum(F.col("w") * F.col("r") ** 2) / n).alias("rmse_s"), (F.sum(F.col("w") * F.abs("r")) / n).alias("mae_s"), F.max("b").alias("b"), *sums)
    middle = quantiles(rows, keys, "r", (0.5,), weight="w").select(*keys, F.col("r").alias("median_resid_s"))
    one = one.join(middle, keys)
    off = rows.join(middle, keys).withColumn("off", F.abs(F.col("r") - F.col("median_resid_s")))
    mad = quantiles(off, keys, "off", (0.5,), weight="w").select(*keys, (1.4826 * F.col("off")).alias("scale_s"))
    free = [bus & whole, ~bus | whole, F.lit(True)]
    s = {(i, j): F.when(free[i], F.col(f"s{i}{j}")).otherwise(1.0) if i == j else F.col(f"s{i}{j}") for i in range(3) for j in range(i, 3)}
    se = [F.when(ok, F.sqrt(c) * F.col("scale_s")) for ok, c in zip(free, _diagonal_of_inverse(s), strict=True)]
    return one.join(mad, keys).select(
        *keys, "n", "rmse_s", "mae_s", "median_resid_s", "scale_s", se[0].alias("se_dwell_s"), F.when(bus, se[1]).alias("se_hold_s"), F.when(~bus, se[1]).alias("se_intercept_s"), (3.6 / F.col("b") ** 2 * se[2]).alias("se_speed_kmh"))


def speed_table(fits: DataFrame) -> DataFrame:
    """Rows of the speed table: the time per stop is split in a dwell, the prior at most, and a delay."""
    dwell = F.least(F.when(F.col("mode") == "bus", DWELL_PRIOR_S["bus"]).otherwise(DWELL_PRIOR_S["subway"]), F.col("dwell_s"))
    return fits.select("scope", "key", "period", "speed_kmh", dwell.alias("dwell_s"), F.greatest(F.lit(0.0), F.col("dwell_s") - dwell).alias("stop_delay_s"), F.col("dwell_s").alias("per_stop_time_s"), "terminal_hold_s", "intercept_s", "n_obs")
