"""Queries of speed fits and route choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.operators import choice, speed
from fareflow.plans import base
from fareflow.plans.registry import BLOCKS, KEYS, ora_period, query
from fareflow.plans.times import rounded
from fareflow.sources import fixtures

BLOCKS |= {
    "prepared": f"""select *, route_dist_m / tt * 3.6 as kmh from (select *, case when mode = 'subway' then tt_adj_s else tt_s end as tt, {ora_period('((dep_s % 86400) / 3600.0)')} as period, cast(o_idx = 0 as double) as is_terminal from matched
      where same_line and route_name is not null and route_dist_m > 300) where tt between 60 and 7200 and route_dist_m / tt * 3.6 >= 2 and route_dist_m / tt * 3.6 <= case mode when 'bus' then 80 else 120 end""",
    "options": "select *, in_vehicle_time + 1.5 * expected_wait + 1.5 * walk_time + 300.0 * num_transfers as cost from fx_route_options",
    "probs": "select *, w / sum(w) over (partition by od) as prob from (select *, exp(-0.005 * (cost - min(cost) over (partition by od))) as w from options)",
}


def prepared(spark, sf):
    """Not written: fits read it once and write the distinct rides."""
    return speed.prepare(base.matched(spark, sf))


@base.shared
def fits(spark, sf):
    return speed.fit(prepared(spark, sf), base.cut)


@query("speed_prepare", f"select {KEYS}, mode, route_name, period, tt, is_terminal from prepared")
def speed_prepare(spark, sf):
    return prepared(spark, sf).select(*base.ROW, "mode", "route_name", "period", "tt", "is_terminal")


@query("speed_groups", """select mode, route_name, coalesce(period, 'all') as period, n from (select mode, route_name, period, count(*) as n, stddev_samp(route_dist_m) as sd, grouping(route_name) as g from prepared
  group by grouping sets ((mode), (mode, period), (mode, route_name), (mode, route_name, period))) where case when g = 1 then n >= 500 else n >= 150 and sd >= 300 end""")
def speed_groups(spark, sf):
    return speed.groups(prepared(spark, sf))


@query("speed_fit_mode")
def speed_fit_mode(spark, sf):
    return rounded(fits(spark, sf).where("scope = 'mode'"))


@query("speed_fit_line")
def speed_fit_line(spark, sf):
    return rounded(fits(spark, sf).where("scope = 'line'"))


#: Fits that both engines make alike: of modes by period, and of all lines.
_FITS = """select distinct 'mode' as scope, mode as key, mode, period, case mode when 'bus' then 40.0 else 35.0 end as dwell_s, case mode when 'bus' then 30.0 else 0.0 end as fitted_hold_s,
  case mode when 'bus' then 0.0 else 250.0 end as intercept_s, case mode when 'bus' then 0.15 else 0.09 end as b from (select mode, period from prepared union all select mode, 'all' from prepared) p
  union all select distinct 'line', route_name, mode, 'all', case mode when 'bus' then 20.0 else 35.0 end, case mode when 'bus' then 45.0 else 0.0 end, case mode when 'bus' then 0.0 else 300.0 end, case mode when 'bus' then 0.2 else 0.11 end from prepared"""
BLOCKS |= {
    "given_fits": "select scope, key, mode, period, cast(dwell_s as double) as dwell_s, cast(fitted_hold_s as double) as fitted_hold_s, cast(intercept_s as double) as intercept_s, cast(b as double) as b from (" + _FITS + ")",
    "fit_rows": """select f.*, tt - intercept_s - dwell_s * (n_intermediate + case p.mode when 'bus' then 1 else 0 end) - fitted_hold_s * is_terminal - b * route_dist_m as r,
      case when p.mode = 'bus' and scope = 'mode' then n_intermediate + 1 else 0 end as x0, case when p.mode = 'subway' then 1 when scope = 'mode' then is_terminal else 0 end as x1, route_dist_m as x2
      from given_fits f join prepared p on p.mode = f.mode and (f.key = p.mode or f.key = p.route_name) and (f.period = 'all' or f.period = p.period)""",
    "fit_weights": "select *, power(1 + power(r / case mode when 'bus' then 90 else 120 end, 2), -1.5) as v from fit_rows",
    "fit_sums": """select scope, key, mode, period, max(b) as b, count(*) as n, sqrt(sum(r * r) / count(*)) as rmse_s, sum(abs(r)) / count(*) as mae_s, quantile_cont(r, 0.5) as median_resid_s, mad(r) * 1.4826 as scale_s,
      case when mode = 'bus' and scope = 'mode' then sum(v * x0 * x0) else 1 end as s00, sum(v * x0 * x1) as s01, sum(v * x0 * x2) as s02, case when mode = 'subway' or scope = 'mode' then sum(v * x1 * x1) else 1 end as s11, sum(v * x1 * x2) as s12, sum(v * x2 * x2) as s22
      from fit_weights group by scope, key, mode, period""",
    "fit_dets": "select *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) as det from fit_sums",
}


@base.shared
def ride_kinds(spark, sf):
    return prepared(spark, sf).select("mode", "period", "route_name").distinct()


def given_fits(spark, sf):
    return spark.sql(BLOCKS["given_fits"].replace("prepared", "{rides}"), rides=ride_kinds(spark, sf))


@query("speed_fit_quality", """select scope, key, mode, period, n, round(rmse_s, 5) as rmse_s, round(mae_s, 5) as mae_s, round(median_resid_s, 5) as median_resid_s, round(scale_s, 5) as scale_s,
  case when mode = 'bus' and scope = 'mode' and det > 0 then round(sqrt((s11 * s22 - s12 * s12) / det) * scale_s, 5) end as se_dwell_s, case when mode = 'bus' and scope = 'mode' and det > 0 then round(sqrt((s00 * s22 - s02 * s02) / det) * scale_s, 5) end as se_hold_s,
  case when mode = 'subway' and det > 0 then round(sqrt((s00 * s22 - s02 * s02) / det) * scale_s, 5) end as se_intercept_s, case when det > 0 then round(3.6 / (b * b) * sqrt((s00 * s11 - s01 * s01) / det) * scale_s, 5) end as se_speed_kmh from fit_dets""")
def speed_fit_quality(spark, sf):
    fits = given_fits(spark, sf).withColumn("n_obs", F.lit(0).cast("long"))
    return rounded(speed.fit_quality(prepared(spark, sf), fits, base.cut), digits=5)


@query("speed_table_of_fits", """select scope, key, period, round(3.6 / b, 6) as speed_kmh, least(case mode when 'bus' then 25.0 else 35.0 end, dwell_s) as dwell_s, greatest(0.0, dwell_s - case mode when 'bus' then 25.0 else 35.0 end) as stop_delay_s,
  dwell_s as per_stop_time_s, fitted_hold_s as terminal_hold_s, intercept_s, (select count(*) from prepared p where p.mode = f.mode and (f.key = p.mode or f.key = p.route_name) and (f.period = 'all' or f.period = p.period)) as n_obs from given_fits f""")
def speed_table_of_fits(spark, sf):
    rides = prepared(spark, sf).select("mode", F.explode(F.array("mode", "route_name")).alias("key"), F.explode(F.array("period", F.lit("all"))).alias("period"))
    sizes = rides.groupBy("mode", "key", "period").agg(F.count("*").alias("n_obs"))
    found = given_fits(spark, sf).join(sizes, ["mode", "key", "period"]).withColumns({"speed_kmh": 3.6 / F.col("b"), "terminal_hold_s": F.col("fitted_hold_s")})
    return rounded(speed.speed_table(found))


@query("speed_table")
def speed_table(spark, sf):
    return rounded(speed.speed_table(fits(spark, sf)))


_GIVEN = "mode string, scope string, period string, dwell_s double, fitted_hold_s double, intercept_s double, b double"


@query("speed_predict", """select mode, cast(floor(pred / 60) as bigint) as pred_bin, cast(floor(tt / 60) as bigint) as obs_bin, count(*) as n, round(sum(tt - pred) * 7 / 9, 3) as resid from (select mode, tt,
  case mode when 'bus' then 40.0 * (n_intermediate + 1) + 30.0 * is_terminal + 0.15 * route_dist_m else 250.0 + 35.0 * n_intermediate + 0.09 * route_dist_m end as pred from prepared) group by all""")
def speed_predict(spark, sf):
    given = spark.createDataFrame([("bus", "mode", "all", 40.0, 30.0, 0.0, 0.15), ("subway", "mode", "all", 35.0, 0.0, 250.0, 0.09)], _GIVEN)
    made = speed.predict(prepared(spark, sf), given)
    # scaled so that no sum of these times lies half way between two rounded values
    density = made.groupBy("mode", F.floor(F.col("pred") / 60).alias("pred_bin"), F.floor(F.col("tt") / 60).alias("obs_bin"))
    return rounded(density.agg(F.count("*").alias("n"), (F.sum("resid") * 7 / 9).alias("resid")), digits=3)


def options(spark, sf):
    return choice.generalized_cost(fixtures.load(spark, sf, "fx_route_options"))


@query("choice_cost", "select od, rnk, round(cast(cost as double), 6) as cost from options")
def choice_cost(spark, sf):
    return rounded(options(spark, sf).select("od", "rnk", F.col("cost").cast("double").alias("cost")))


@query("choice_logit", "select od, rnk, round(prob, 9) as prob from probs")
def choice_logit(spark, sf):
    return rounded(choice.logit(options(spark, sf)).select("od", "rnk", "prob"), digits=9)


@query("choice_shortest", "select od, rnk, cast(1 as double) as prob from (select *, row_number() over (partition by od order by cost, rnk) as r from options) where r = 1")
def choice_shortest(spark, sf):
    return choice.shortest_choice(options(spark, sf)).select("od", "rnk", "prob")


#: A draw that both engines make alike.
_U = "((o_orderkey * 7919 + o_custkey * 104729) % 10007 / 10007.0)"
_LADDER = f"select o_orderkey, o_custkey, od, {_U} as u from (select *, o_orderkey as od from orders)"
_CHOSEN = """select t.o_orderkey, t.o_custkey, t.od, coalesce(min(p.rnk) filter (round(p.cum, 12) >= round(u, 12)), max(p.rnk)) as chosen
  from draws t left join (select *, sum(prob) over (partition by od order by rnk) as cum from probs) p on p.od = t.od group by all"""
BLOCKS |= {"draws": _LADDER, "chosen": _CHOSEN}


def draws(spark, sf):
    orders = fixtures.given(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("od"))
    return orders.distinct()


def _u():
    return (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 10007 / F.lit(10007.0)


@query("choice_assign", "select distinct o_orderkey, o_custkey, chosen from chosen")
def choice_assign(spark, sf):
    return choice.assign(draws(spark, sf), choice.logit(options(spark, sf)), _u()).select("o_orderkey", "o_custkey", "chosen")


@query("choice_override", """select distinct c.o_orderkey, c.o_custkey, case when c.o_orderkey % 2 = 0 and c.chosen is not null then l.last else c.chosen end as chosen from chosen c left join (select od, max(rnk) as last from options group by od) l on l.od = c.od""")
def choice_override(spark, sf):
    table = choice.logit(options(spark, sf))
    last = table.groupBy("od").agg(F.max("rnk").alias("last"))
    trips = draws(spark, sf).join(last, "od", "left")
    override = F.when(F.col("o_orderkey") % 2 == 0, F.col("last"))
    return choice.assign(trips, table, _u(), override).select("o_orderkey", "o_custkey", "chosen")
