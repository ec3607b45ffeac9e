"""The same results in DuckDB's SQL: common table expressions by name, and one statement for each query."""

from __future__ import annotations

import re

CUT = "date '2024-01-16'"


def r4(x: str) -> str:
    return f"round({x} + 1e-9, 4)"


def ent(p: str) -> str:
    return f"-(case when {p} > 0 then {p} * ln({p}) else 0.0 end + case when 1 - {p} > 0 then (1 - {p}) * ln(1 - {p}) else 0.0 end)"


def uniform(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double)"


# The distribution function of Poisson(1).
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_one(u: str) -> str:
    return "(" + " + ".join(f"cast({u} >= {b}::double as int)" for b in POISSON_ONE) + ")"


def choose(cells: str, key: str) -> str:
    """The action of least expected loss of each row of `cells` with key columns and p."""
    return f"""
select {key}, action, loss from (
  select {key}, action, loss, row_number() over (partition by {key} order by loss, action) as r from (
    select {key}, action, round(fixed_cost + p * loss_if_flood + (1 - p) * loss_if_dry, 6) as loss from {cells} cross join action_cost)) where r = 1"""


def newton(step: int, ridge: float = 0.01, n: int = 4) -> str:
    """A Newton step of every member's logistic fit: sums over the cells, then elimination and substitution by columns."""
    before = "(select m, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as b3 from (select unnest(range(0, 3)) as m))" if step == 1 else f"newton_{step - 1}"
    z = " + ".join(f"b{i} * x{i}" for i in range(n))
    penalty = lambda i: f"{ridge} * w" if i else "0.0"
    sums = ", ".join([f"sum(w * (y - p) * x{i}) as r{i}" for i in range(n)] + [f"sum(w * p * (1 - p) * x{i} * x{j}) as s{i}{j}" for i in range(n) for j in range(i + 1)])
    cols = [f"r{i} - {penalty(i)} * b{i} as g{i}_0" for i in range(n)] + [f"s{max(i, j)}{min(i, j)}" + (f" + {penalty(i)} + 1e-9" if i == j else "") + f" as h{i}{j}_0" for i in range(n) for j in range(n)]
    for c in range(n - 1):
        for i in range(c + 1, n):
            cols.append(f"h{i}{c}_{c} / h{c}{c}_{c} as f{i}{c}")
            cols += [f"h{i}{j}_{c} - f{i}{c} * h{c}{j}_{c} as h{i}{j}_{c + 1}" for j in range(c + 1, n)] + [f"g{i}_{c} - f{i}{c} * g{c}_{c} as g{i}_{c + 1}"]
    for i in range(n - 1, -1, -1):
        rest = "".join(f" - h{i}{j}_{i} * d{j}" for j in range(i + 1, n))
        cols.append(f"(g{i}_{i}{rest}) / h{i}{i}_{i} as d{i}")
    betas = ", ".join(f"b{i} + d{i} as b{i}" for i in range(n))
    return f"""select m, {betas} from (select *, {", ".join(cols)} from (select m, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, any_value(b3) as b3, sum(w) as w, {sums}
      from (select *, 1 / (1 + exp(-({z}))) as p from bagged_x join {before} using (m)) group by m))"""


#: In order: an expression uses only those above it.
EXPRESSIONS: dict[str, str] = {
    "action_cost": """select action, fixed_cost::double as fixed_cost, loss_if_flood::double as loss_if_flood, loss_if_dry::double as loss_if_dry
      from (values ('evacuate', 40, 5, 0), ('preposition', 20, 45, 0), ('monitor', 8, 75, 0), ('none', 0, 100, 0)) t(action, fixed_cost, loss_if_flood, loss_if_dry)""",
    "observation": "select event_id, ts, cast(user_id % 25 as int) as zone_id, event_type as sensor, value from events",
    "forecast_member": """select * from (select zone_id, cast(ts as date) as valid_date, sensor as member, round(avg(value) / (avg(value) + 50.0), 6) as prob, count(*) as n_obs
      from observation group by all) where prob between 0 and 1""",
    "outcome": """select zone_id, cast(ts as date) as valid_date, case when max(value) >= 120 then 1 else 0 end as flooded, round(max(value), 6) as peak from observation
      where value is not null and not isnan(value) group by all""",
    "zone": "select cast(n_nationkey as int) as zone_id, n_name as zone_name, cast(r_regionkey as int) as district_id, r_name as district_name from nation join region on n_regionkey = r_regionkey",
    "exposure": "select cast(c_nationkey as int) as zone_id, c_custkey as asset_id, greatest(c_acctbal, 0.0::double) as population from customer",
    "resource": "select cast(s_nationkey as int) as zone_id, s_suppkey as resource_id, greatest(s_acctbal, 0.0::double) as capacity from supplier",
    "trial": """select o_orderkey as trial_id, o_custkey as participant_id, case when o_custkey % 2 = 0 then 'point' else 'uncertainty' end as arm,
      case when o_orderstatus <> 'F' then 1 else 0 end as ai_correct, case when o_totalprice >= 200000 then 1 else 0 end as accepted, round(o_totalprice / 10000.0, 6) as decision_seconds from orders""",
    "pixel": """select * from (select vec_id as tile_id, pos - 1 as pixel_id, round(1 / (1 + exp(-12 * cast(embedding[pos] as double))), 6) as prob,
      case when cast(embedding[pos] as double) + (((vec_id * 31 + (pos - 1) * 17) % 101) / 101.0::double - 0.5) * 0.2 > 0 then 1 else 0 end as wet
      from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings)) where prob between 0 and 1""",
    "daily": "select zone_id, sensor, cast(ts as date) as valid_date, round(avg(value), 9) as mean_value, datediff('day', date '1970-01-01', cast(ts as date)) as day_no from observation group by all",
    "features": """select zone_id, valid_date, sensor, mean_value, max(mean_value) over (w range between 1 preceding and 1 preceding) as lag_value,
      round(avg(mean_value) over (w range between 7 preceding and 1 preceding), 9) as week_mean from daily window w as (partition by zone_id, sensor order by day_no)""",
    "cell": """select zone_id, valid_date, round(avg(prob), 9) as p, round(case when count(*) > 1 then stddev_samp(prob) else 0.0 end, 9) as sd, count(*) as members,
      min(prob) as p_min, max(prob) as p_max, sum(n_obs)::bigint as n_obs from forecast_member group by all""",
    "ensemble": "select zone_id, valid_date, quantile_cont(prob, 0.05) as lo, quantile_cont(prob, 0.5) as mid, quantile_cont(prob, 0.95) as hi from forecast_member group by all",
    "seg_zone": "select cast(tile_id % 25 as int) as zone_id, count(*) as n, avg(prob) as fraction, sqrt(sum(prob * (1 - prob))) / count(*) as se from pixel group by all",
    "fused": """select zone_id, valid_date, coalesce((p1 / v1 + p2 / v2) / (1 / v1 + 1 / v2), p1, p2) as fused, coalesce(sqrt(1 / (1 / v1 + 1 / v2)), sqrt(v1), sqrt(v2)) as fused_sd,
      abs(p1 - p2) / sqrt(v1 + v2) as disagreement, case when p1 is null then 'segmentation' when p2 is null then 'forecast' else 'both' end as sources
      from (select coalesce(c.zone_id, s.zone_id) as zone_id, valid_date, p as p1, round(fraction, 9) as p2, case when sd is not null then greatest(sd * sd, 1e-6) end as v1,
        case when se is not null then greatest(round(se, 9) * round(se, 9), 1e-6) end as v2 from cell c full join seg_zone s on c.zone_id = s.zone_id)""",
    "scored": "select c.*, o.flooded as y from cell c join outcome o using (zone_id, valid_date)",
    "binned": "select least(cast(floor(p * 10) as int), 9) as bin, p, y, valid_date, zone_id from scored",
    "reliability": "select bin, count(*) as n, round(avg(p), 9) as mean_p, round(avg(y), 9) as rate from binned group by all",
    "aware": choose("cell", "zone_id, valid_date"),
    "hard_cell": "select zone_id, valid_date, case when p >= 0.5 then 1.0::double else 0.0::double end as p from cell",
    "hard": choose("hard_cell", "zone_id, valid_date"),
    "policies": "select 'aware' as policy, zone_id, valid_date, action from aware union all select 'deterministic', zone_id, valid_date, action from hard",
    "rates": f"select bin, round(avg(y), 9) as rate from binned where valid_date < {CUT} group by all",
    "late": f"select zone_id, valid_date, p, coalesce(rate, p) as fixed from (select zone_id, valid_date, p, least(cast(floor(p * 10) as int), 9) as bin from cell where valid_date >= {CUT}) left join rates using (bin)",
    "late_p": """select 'aware' as policy, zone_id, valid_date, p from late union all select 'deterministic', zone_id, valid_date, cast(p >= 0.5 as int)::double from late
      union all select 'aware_recalibrated', zone_id, valid_date, fixed from late union all select 'deterministic_recalibrated', zone_id, valid_date, cast(fixed >= 0.5 as int)::double from late""",
    "late_choice": choose("late_p", "policy, zone_id, valid_date"),
    "realised": """select policy, zone_id, valid_date, realised, realised - (select min(fixed_cost + case when flooded = 1 then loss_if_flood else loss_if_dry end) from action_cost) as regret, miss, false_alarm
      from (select policy, zone_id, valid_date, flooded, fixed_cost + case when flooded = 1 then loss_if_flood else loss_if_dry end as realised,
        cast(flooded = 1 and action = 'none' as int) as miss, cast(flooded = 0 and action = 'evacuate' as int) as false_alarm
        from policies join outcome using (zone_id, valid_date) join action_cost using (action))""",
    "context": """select zone_id, zone_name, district_name, coalesce(population, 0.0::double) as population, coalesce(assets, 0) as assets, coalesce(capacity, 0.0::double) as capacity from zone
      left join (select zone_id, round(sum(population), 9) as population, count(*) as assets from exposure group by all) using (zone_id)
      left join (select zone_id, round(sum(capacity), 9) as capacity from resource group by all) using (zone_id)""",
    "placed": "select zone_id, valid_date, p, district_name, population from cell join context using (zone_id)",
    "drawn": f"""select valid_date, district_name, draw, round(sum(case when (case when {uniform("valid_date", "draw", "'coin'")} < 0.3::double
        then {uniform("valid_date", "draw", "'city'")} else {uniform("valid_date", "draw", "zone_id")} end) < p then population else 0.0 end), 9) as affected
      from placed cross join (select unnest(range(0, 200)) as draw) group by all""",
    "member_cell": "select zone_id, valid_date, member, prob as p from forecast_member",
    "member_choice": choose("member_cell", "zone_id, valid_date, member"),
    "stability": """select zone_id, valid_date, any_value(a.action) as action, round(avg(cast(m.action = a.action as int)), 9) as stability
      from member_choice m join aware a using (zone_id, valid_date) group by all""",
    "gated": """select zone_id, valid_date, p, sd, members, action, stability,
      case when stability < 0.2 or members < 3 then 'abstain' when stability >= 0.6 and sd <= 0.15 then 'act' else 'verify' end as gate from cell join stability using (zone_id, valid_date)""",
    "scores": f"select cast(round(round(case when y = 1 then 1 - p else p end + 1e-9, 4) * 10000) as int) as s, count(*) as n from scored where valid_date < {CUT} group by all",
    "qhat": "select min(s) as q from (select s, sum(n) over (order by s) as up_to, sum(n) over () as total from scores) where up_to >= ceil((total + 1) * 0.9::double - 1e-9)",
    "conformal": f"""select zone_id, valid_date, p, q / 10000.0::double as qhat, case when wet and dry then 'both' when wet then 'wet' when dry then 'dry' else 'none' end as labels
      from (select *, q is null or cast(round(round(1 - p + 1e-9, 4) * 10000) as int) <= q as wet, q is null or cast(round(round(p + 1e-9, 4) * 10000) as int) <= q as dry
        from cell cross join qhat where valid_date >= {CUT})""",
    "curve": """select bin, sum(n) over w / sum(n) over () as coverage, sum(wrong) over w / sum(n) over w as risk from (
        select cast(floor(abs(p - 0.5) * 200) as int) as bin, count(*)::double as n, sum(cast((p >= 0.5) <> (y = 1) as int))::double as wrong from scored group by all) window w as (order by bin desc)""",
    "flags": """select zone_id, valid_date, flag from (
        select c.zone_id, c.valid_date, unnest([case when c.members < 5 then 'few_members' end, case when c.n_obs < 10 then 'few_observations' end,
          case when coalesce(f.sources <> 'both', true) then 'no_segmentation' end, case when f.disagreement > 2 then 'sources_disagree' end,
          case when abs(b.mean_p - b.rate) > 0.1 then 'poorly_calibrated' end]) as flag
        from cell c left join fused f using (zone_id, valid_date) left join reliability b on b.bin = least(cast(floor(c.p * 10) as int), 9)) where flag is not null""",
    "human": """select zone_id, valid_date, case when gate <> 'act' then 'gate is ' || gate when coalesce(n, 0) >= 2 then 'several limitations'
        when action = 'evacuate' and labels <> 'wet' then 'evacuation without a clear conformal set' else 'none' end as reason
      from gated left join (select zone_id, valid_date, count(*) as n from flags group by all) using (zone_id, valid_date) left join conformal using (zone_id, valid_date)""",
    "ranked": """select zone_id, valid_date, action, loss, row_number() over (partition by zone_id, valid_date order by loss, action)::int as rank, min(loss) over (partition by zone_id, valid_date) as best
      from (select zone_id, valid_date, action, round(fixed_cost + p * loss_if_flood + (1 - p) * loss_if_dry, 6) as loss from cell cross join action_cost)""",
    "situation": """select zone_id, valid_date, p, p * coalesce(population, 0.0) as expected_affected,
        p - max(p) over (partition by zone_id order by datediff('day', date '1970-01-01', valid_date) range between 1 preceding and 1 preceding) as change
      from cell left join context using (zone_id)""",
    "belief": """select zone_id, n, newest, (wet + 1) / (n + 2) as exact_p, (wet + 1) * (n - wet + 1) / ((n + 2) * (n + 2) * (n + 3)) as variance
      from (select zone_id, count(*)::double as n, count(*) filter (value >= 120)::double as wet, max(ts) as newest from observation group by all)""",
    "belief_cell": "select zone_id, round(exact_p, 9) as p from belief",
    "belief_choice": choose("belief_cell", "zone_id"),
    "belief_place": """select zone_id, place, round(least(greatest(round(exact_p, 9) + place * sqrt(variance), 0.0::double), 1.0::double), 9) as p
      from belief cross join (select unnest([-1.5, -0.75, 0.0, 0.75, 1.5])::double as place)""",
    "place_choice": choose("belief_place", "zone_id, place"),
    "followed": """select b.zone_id, b.n::bigint as n, newest, exact_p, variance, c.action, c.loss, case when stability < 0.2 then 'abstain' when stability >= 0.6 and sqrt(variance) <= 0.15 then 'act' else 'verify' end as gate
      from belief b join belief_choice c using (zone_id) join (select zone_id, round(avg(cast(p.action = c.action as int)), 9) as stability from place_choice p join belief_choice c using (zone_id) group by all) using (zone_id)""",
    "followed_by": """select f.event_id as forecast_id, f.value as forecast_value, o.event_id as outcome_id, o.ts as outcome_ts, o.value as outcome_value, f.zone_id from observation f join observation o
      on f.zone_id = o.zone_id and f.sensor = 'view' and o.sensor = 'error' and o.ts > f.ts and o.ts <= f.ts + interval 1 hour""",
    "outcome_of": """select f.event_id as forecast_id, f.zone_id, min(struct_pack(ts := o.ts, id := o.event_id)) as first, any_value(f.ts) as ts from observation f left join observation o
      on f.zone_id = o.zone_id and o.sensor = 'error' and o.ts > f.ts and o.ts <= f.ts + interval 6 hours where f.sensor = 'view' group by all""",
    "drift": """select cast(outcome_ts as date) as start, count(*) as n, avg(e) as brier, avg(e) > 1.5 * max(batch) as alarm from (
        select outcome_ts, (forecast_value / (forecast_value + 50.0) - cast(outcome_value >= 120 as int)) * (forecast_value / (forecast_value + 50.0) - cast(outcome_value >= 120 as int)) as e from followed_by)
      cross join (select avg((p - y) * (p - y)) as batch from scored) group by cast(outcome_ts as date)""",
    "alarmed": "select coalesce(bool_or(alarm), false) as alarm from (select alarm from drift order by start desc limit 7)",
    "newest_day": "select zone_id, max(cast(ts as date)) as newest from observation group by zone_id",
    "belief_before": """select o.zone_id, (count(*) filter (value >= 120) + 1)::double / (count(*) + 2)::double as p_before from observation o join newest_day d on o.zone_id = d.zone_id and cast(o.ts as date) < newest group by o.zone_id""",
    "reasons": """select zone_id, string_agg(sensor, ',' order by rank) as reasons from (
        select f.zone_id, sensor, row_number() over (partition by f.zone_id order by round(abs(mean_value - week_mean), 6) desc, sensor) as rank
        from features f join newest_day d on f.zone_id = d.zone_id and f.valid_date = d.newest where week_mean is not null) where rank <= 2 group by zone_id""",
    "belief_ranked": """select zone_id, action, loss, row_number() over (partition by zone_id order by loss, action) as rank, min(loss) over (partition by zone_id) as best from (
        select zone_id, action, round(fixed_cost + p * loss_if_flood + (1 - p) * loss_if_dry, 6) as loss from belief_cell cross join action_cost)""",
    "belief_others": "select zone_id, string_agg(action, ',' order by rank) as alternatives, min(loss - best) as extra_loss from belief_ranked where rank between 2 and 3 group by zone_id",
    "live": """select zone_id, n, round(exact_p, 9) as p, sqrt(variance) as sd, greatest(exact_p - 1.645 * sqrt(variance), 0.0::double) as lo, least(exact_p + 1.645 * sqrt(variance), 1.0::double) as hi, action, gate,
      list_filter([case when n < 10 then 'few_observations' end, case when fraction is null then 'no_segmentation' end,
        case when abs(exact_p - fraction) / sqrt(greatest(variance + se * se, 1e-6)) > 2 then 'sources_disagree' end, case when abs(r.mean_p - r.rate) > 0.1 then 'poorly_calibrated' end], lambda x: x is not null) as flags
      from followed left join (select zone_id, fraction, se from seg_zone) using (zone_id) left join (select bin, mean_p, rate from reliability) r on r.bin = least(cast(floor(round(exact_p, 9) * 10) as int), 9)""",
    "predictor": "select zone_id, valid_date, avg(lag_value) as lag_mean, max(lag_value) as lag_max, avg(week_mean) as week_mean, count(*) as n_obs from features where lag_value is not null and week_mean is not null group by all",
    "predictor_scale": f"""select round(avg(lag_mean), 9) as m1, round(stddev_pop(lag_mean), 9) as s1, round(avg(lag_max), 9) as m2, round(stddev_pop(lag_max), 9) as s2, round(avg(week_mean), 9) as m3, round(stddev_pop(week_mean), 9) as s3
      from predictor join outcome using (zone_id, valid_date) where valid_date < {CUT}""",
    "scaled_x": "select zone_id, valid_date, n_obs, 1.0::double as x0, (lag_mean - m1) / s1 as x1, (lag_max - m2) / s2 as x2, (week_mean - m3) / s3 as x3 from predictor cross join predictor_scale",
    "bagged_x": f"""select * from (select m, {poisson_one(uniform("m", "zone_id", "valid_date"))}::double as w, flooded::double as y, x0, x1, x2, x3
      from scaled_x join outcome using (zone_id, valid_date) cross join (select unnest(range(0, 3)) as m) where valid_date < {CUT}) where w > 0""",
    **{f"newton_{k}": newton(k) for k in range(1, 6)},
    "pav_point": f"select cast(round(round(p + 1e-9, 4) * 10000) as int) as s, sum(y)::double as total, count(*)::double as weight from scored where valid_date < {CUT} group by all",
    "pav_mean": """select a.s as i, b.s as j, sum(b.total) over w / sum(b.weight) over w as mean from pav_point a join pav_point b on b.s >= a.s window w as (partition by a.s order by b.s)""",
    "pav_least": "select i, j as s, min(mean) over (partition by i order by j desc) as least from pav_mean",
    "pav_fit": "select s, round(max(least), 9) as fit from pav_least where i <= s group by s",
    "people": "select arm, participant_id, avg(cast(ai_correct = accepted as int)) as mean from trial group by all",
    "arms": """select avg(mean) filter (arm = 'uncertainty') as ma, avg(mean) filter (arm = 'point') as mb, var_samp(mean) filter (arm = 'uncertainty') as va, var_samp(mean) filter (arm = 'point') as vb,
      count(*) filter (arm = 'uncertainty') as na, count(*) filter (arm = 'point') as nb from people""",
}
D = "cast(valid_date as varchar) as valid_date"
HARD = "case when p >= 0.5 then 1.0::double else 0.0::double end"


def log_loss(p: str) -> str:
    q = f"least(greatest({p}, 1e-6::double), 1 - 1e-6::double)"
    return f"avg(-(case when y = 1 then ln({q}) else ln(1 - {q}) end))"


STATEMENTS: dict[str, str] = {
    "a1_zone_features": f"select zone_id, {D}, sensor, {r4('mean_value')} as mean_value, {r4('lag_value')} as lag_value, {r4('week_mean')} as week_mean from features",
    "b1_ensemble_summary": f"select zone_id, {D}, {r4('p')} as p, {r4('sd')} as sd, members, {r4('p_min')} as p_min, {r4('p_max')} as p_max, n_obs from cell",
    "b2_ensemble_interval": f"select zone_id, {D}, {r4('lo')} as lo, {r4('mid')} as mid, {r4('hi')} as hi from ensemble",
    "b3_entropy_split": f"""select zone_id, {D}, {r4(ent('p'))} as total, {r4('aleatoric')} as aleatoric, {r4(ent('p') + ' - aleatoric')} as epistemic
      from (select zone_id, valid_date, round(avg(prob), 9) as p, avg({ent('prob')}) as aleatoric from forecast_member group by all)""",
    "b4_exceedance": f"""select zone_id, {D}, level, n, {r4('share')} as share, {r4('sqrt(share * (1 - share) / n)')} as se from (
        select zone_id, cast(ts as date) as valid_date, level::double as level, count(*) as n, avg(cast(value >= level as int)) as share from observation cross join (select unnest([60.0, 90.0, 120.0]) as level) group by all)""",
    "b5_tile_fraction": f"select tile_id, n, {r4('fraction')} as fraction, {r4('se')} as se from (select tile_id, count(*) as n, avg(prob) as fraction, sqrt(sum(prob * (1 - prob))) / count(*) as se from pixel group by all)",
    "b5_zone_fraction": f"select zone_id, n, {r4('fraction')} as fraction, {r4('se')} as se from seg_zone",
    "b6_segmentation_ambiguity": f"select tile_id, {r4('avg(case when abs(prob - 0.5) < 0.1 then 1.0 else 0.0 end)')} as ambiguous, {r4('avg(' + ent('prob') + ')')} as mean_entropy from pixel group by all",
    "b7_fuse_sources": f"select zone_id, {D}, {r4('fused')} as fused, {r4('fused_sd')} as fused_sd, {r4('disagreement')} as disagreement, sources from fused",
    "c1_score_probabilities": f"""select case when grouping(district_name) = 1 then 'ALL' else district_name end as district, count(*) as n, {r4('avg((p - y) * (p - y))')} as brier, {r4(log_loss('p'))} as log_loss,
      {r4(f'avg(({HARD} - y) * ({HARD} - y))')} as hard_brier, {r4(log_loss(HARD))} as hard_log_loss from scored join zone using (zone_id) group by rollup (district_name)""",
    "c2_reliability_table": f"select bin, n, {r4('mean_p')} as mean_p, {r4('rate')} as rate from reliability",
    "c3_calibration_error": f"select {r4('sum(n * abs(mean_p - rate)) / sum(n)')} as ece, {r4('max(abs(mean_p - rate))')} as mce from reliability",
    "c4_brier_decomposition": f"""select {r4('sum(n * (mean_p - rate) * (mean_p - rate)) / max(all_n)')} as reliability, {r4('sum(n * (rate - base) * (rate - base)) / max(all_n)')} as resolution, {r4('max(base) * (1 - max(base))')} as uncertainty
      from reliability cross join (select sum(n) as all_n, sum(n * rate) / sum(n) as base from reliability)""",
    "c5_interval_coverage": f"""select case when grouping(zone_id) = 1 then -1 else zone_id end as zone_id, count(*) as n, {r4('avg(cast(peak between lo and hi as int))')} as coverage, {r4('avg(hi - lo)')} as mean_width
      from outcome join (select zone_id, round(quantile_cont(peak, 0.05), 9) as lo, round(quantile_cont(peak, 0.95), 9) as hi from outcome where valid_date < {CUT} group by all) using (zone_id)
      where valid_date >= {CUT} group by rollup (zone_id)""",
    "c6_crps_ensemble": f"""select zone_id, {D}, {r4('avg(abs(prob - y)) - sum((2 * i - m - 1) * prob / (m * m))')} as crps from (
        select zone_id, valid_date, prob, flooded as y, row_number() over (partition by zone_id, valid_date order by prob, member) as i, count(*) over (partition by zone_id, valid_date) as m
        from forecast_member join outcome using (zone_id, valid_date)) group by zone_id, valid_date""",
    "c7_segmentation_scores": f"""select tile_id, tp, fp, fn, tn, {r4('tp / nullif(tp + fp + fn, 0)')} as iou, {r4('2 * tp / nullif(2 * tp + fp + fn, 0)')} as dice, {r4('tp / nullif(tp + fp, 0)')} as precision, {r4('tp / nullif(tp + fn, 0)')} as recall
      from (select case when grouping(tile_id) = 1 then -1 else tile_id end as tile_id, count(*) filter (prob >= 0.5 and wet = 1) as tp, count(*) filter (prob >= 0.5 and wet = 0) as fp,
        count(*) filter (prob < 0.5 and wet = 1) as fn, count(*) filter (prob < 0.5 and wet = 0) as tn from pixel group by rollup (tile_id))""",
    "c8_recalibrate_histogram": f"""select zone_id, {D}, {r4('p')} as p, {r4('coalesce(rate, p)')} as recalibrated from (select zone_id, valid_date, p, least(cast(floor(p * 10) as int), 9) as bin from cell where valid_date >= {CUT})
      left join (select bin, round(avg(y), 9) as rate from binned where valid_date < {CUT} group by all) using (bin)""",
    "a2_bagged_newton": f"""select zone_id, {D}, 'bag' || m as member, {r4('round(1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3))), 6)')} as prob, n_obs from scaled_x cross join newton_5 where valid_date >= {CUT}""",
    "c8_isotonic_blocks": f"""select zone_id, {D}, {r4('p')} as p, {r4('coalesce(fit, p)')} as recalibrated from (
        select zone_id, valid_date, any_value(c.p) as p, coalesce(arg_max(fit, f.s) filter (f.s <= c.s), arg_min(fit, f.s)) as fit
        from (select *, cast(round(round(p + 1e-9, 4) * 10000) as int) as s from cell where valid_date >= {CUT}) c left join pav_fit f on true group by all)""",
    "d1_expected_loss": f"select zone_id, {D}, action, {r4('round(fixed_cost + p * loss_if_flood + (1 - p) * loss_if_dry, 6)')} as loss from cell cross join action_cost",
    "d2_decide_uncertainty_aware": f"select zone_id, {D}, action, {r4('loss')} as loss from aware",
    "d3_decide_deterministic": f"select zone_id, {D}, action, {r4('loss')} as loss from hard",
    "d4_policy_comparison": f"""select policy, coalesce(cast(valid_date as varchar), 'ALL') as valid_date, count(*) as cells, {r4('sum(realised)')} as realised_loss, sum(miss)::bigint as misses, sum(false_alarm)::bigint as false_alarms, {r4('sum(regret)')} as regret
      from realised group by grouping sets ((policy, valid_date), (policy))""",
    "d4_recalibrated_policies": f"""select policy, coalesce(cast(valid_date as varchar), 'ALL') as valid_date, count(*) as cells, {r4('sum(realised)')} as realised_loss, sum(miss)::bigint as misses, sum(false_alarm)::bigint as false_alarms, {r4('sum(regret)')} as regret
      from (select policy, valid_date, realised, realised - case when flooded = 1 then 45.0::double else 0.0::double end as regret, cast(flooded = 1 and action = 'none' as int) as miss, cast(flooded = 0 and action = 'evacuate' as int) as false_alarm
        from (select policy, valid_date, flooded, action, fixed_cost + case when flooded = 1 then loss_if_flood else loss_if_dry end as realised from late_choice join outcome using (zone_id, valid_date) join action_cost using (action)))
      group by grouping sets ((policy, valid_date), (policy))""",
    "d5_policy_difference_ci": f"""select count(m) as draws, {r4('avg(m)')} as mean_difference, {r4('quantile_cont(m, 0.025)')} as lo, {r4('quantile_cont(m, 0.975)')} as hi from (
        select draw, round(sum(w * difference) / nullif(sum(w * cells), 0), 9) as m from (
          select valid_date, difference, cells, draw, {poisson_one(uniform('valid_date', 'draw'))} as w from (
            select valid_date, sum(case when policy = 'aware' then realised else -realised end) as difference, count(*) filter (policy = 'aware') as cells from realised group by all)
          cross join (select unnest(range(0, 200)) as draw)) group by draw)""",
    "d6_propagate_linear": f"""select {D}, case g when 0 then 'zone' when 1 then 'district' else 'city' end as level, case when g < 3 then district_name else 'ALL' end as district, case when g = 0 then zone_id else -1 end as zone_id,
      {r4('expected')} as expected, {r4('sd')} as sd from (select valid_date, district_name, zone_id, grouping(valid_date, district_name, zone_id) as g, sum(p * population) as expected,
        sqrt(sum(p * (1 - p) * population * population)) as sd from placed group by rollup (valid_date, district_name, zone_id)) where g < 7""",
    "d7_propagate_monte_carlo": f"""select {D}, count(*) as draws, {r4('quantile_cont(a, 0.05)')} as q05, {r4('quantile_cont(a, 0.5)')} as q50, {r4('quantile_cont(a, 0.95)')} as q95
      from (select valid_date, draw, round(sum(affected), 9) as a from drawn group by all) group by drawn.valid_date""".replace("group by drawn.valid_date", "group by valid_date"),
    "d8_capacity_shortfall": f"""select {D}, district_name as district, {r4('avg(cast(over > 0 as int))')} as p_shortfall, {r4('avg(over)')} as mean_shortfall from (
        select valid_date, district_name, greatest(affected - coalesce(capacity, 0), 0.0::double) as over from drawn
        left join (select district_name, round(sum(capacity), 9) as capacity from zone join resource using (zone_id) group by all) using (district_name)) group by valid_date, district_name""",
    "d9_decision_stability": f"select zone_id, {D}, action, {r4('stability')} as stability from stability",
    "e1_confidence_gate": f"select zone_id, {D}, {r4('p')} as p, {r4('sd')} as sd, members, action, {r4('stability')} as stability, gate from gated",
    "e2_conformal_set": f"select zone_id, {D}, {r4('p')} as p, {r4('qhat')} as qhat, labels from conformal",
    "e2_conformal_coverage": f"""select case when grouping(labels) = 1 then 'ALL' else labels end as labels, count(*) as cells, sum(flooded)::bigint as flooded,
      {r4("avg(cast(labels = 'both' or labels = case when flooded = 1 then 'wet' else 'dry' end as int))")} as coverage from conformal join outcome using (zone_id, valid_date) group by rollup (labels)""",
    "e3_risk_coverage": f"select bin, {r4('coverage')} as coverage, {r4('risk')} as risk from curve",
    "e4_pick_threshold": "select min(bin) filter (risk <= 0.2) as bin from curve",
    "e5_abstention_audit": f"""select case when grouping(district_name) = 1 then 'ALL' else district_name end as district, case when grouping(gate) = 1 then 'ALL' else gate end as gate, count(*) as cells,
      sum(cast((g.p >= 0.5) <> (flooded = 1) as int))::bigint as errors, {r4('avg(cast((g.p >= 0.5) <> (flooded = 1) as int))')} as error_rate
      from gated g join outcome using (zone_id, valid_date) join zone using (zone_id) group by cube (district_name, gate)""",
    "f1_situation": f"select zone_id, {D}, {r4('p')} as p, {r4('expected_affected')} as expected_affected, {r4('change')} as change from situation",
    "f2_rationale": f"""select zone_id, {D}, rank, sensor, {r4('mean_value')} as mean_value, {r4('week_mean')} as week_mean, {r4('distance')} as distance from (
        select *, row_number() over (partition by zone_id, valid_date order by distance desc, sensor)::int as rank from (
          select *, round(abs(mean_value - week_mean), 6) as distance from features where week_mean is not null)) where rank <= 2""",
    "f3_confidence": f"select zone_id, {D}, {r4('sd')} as sd, gate, {r4('lo')} as lo, {r4('hi')} as hi, case gate when 'act' then 'high' when 'verify' then 'medium' else 'low' end as label from gated join ensemble using (zone_id, valid_date)",
    "f4_alternatives": f"select zone_id, {D}, rank, action, {r4('loss - best')} as extra_loss from ranked where rank between 2 and 3",
    "f5_limitations": f"select zone_id, {D}, flag from flags",
    "f6_needs_human": f"select zone_id, {D}, reason <> 'none' as needs_human, reason from human",
    "f7_add_context": f"select zone_id, {D}, zone_name, district_name, {r4('population')} as population, assets, {r4('capacity')} as capacity from cell left join context using (zone_id)",
    "f8_recommendation": f"""select zone_id, {D}, case when gate <> 'abstain' then action end as action, gate, {r4('s.expected_affected')} as expected_affected, {r4('e.lo')} as lo, {r4('e.hi')} as hi,
      coalesce(n, 0)::int as n_limitations, h.reason <> 'none' as needs_human, x.district_name as district
      from gated g left join situation s using (zone_id, valid_date) left join ensemble e using (zone_id, valid_date) left join human h using (zone_id, valid_date) left join context x using (zone_id)
      left join (select zone_id, valid_date, count(*) as n from flags group by all) using (zone_id, valid_date)""",
    "g1_arm_summary": f"""select arm, count(*) as trials, {r4('avg(cast(ai_correct = accepted as int))')} as right_reliance, {r4('avg(accepted) filter (ai_correct = 0)')} as over_reliance,
      {r4('avg(1 - accepted) filter (ai_correct = 1)')} as under_reliance, {r4('quantile_cont(decision_seconds, 0.5)')} as median_seconds from trial group by all""",
    "g2_arm_contrast": f"""select na as n_a, nb as n_b, {r4('ma - mb')} as difference, {r4('sqrt(va / na + vb / nb)')} as se, {r4('ma - mb - 1.96 * sqrt(va / na + vb / nb)')} as lo, {r4('ma - mb + 1.96 * sqrt(va / na + vb / nb)')} as hi from arms""",
    "h1_stream_dedup": "select zone_id, sensor, count(distinct event_id) as events from observation group by all",
    "h2_tumbling_windows": f"select zone_id, cast(cast(ts as date) as varchar) as start, count(*) as n, {r4('avg(value)')} as mean_value, {r4('max(value)')} as max_value from observation group by zone_id, cast(ts as date)",
    "h2_sliding_windows": f"""select zone_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {r4('avg(value)')} as mean_value, {r4('max(value)')} as max_value from (
        select zone_id, value, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - k * interval 6 hours as start from observation cross join (select unnest(range(0, 4)) as k)) group by zone_id, start""",
    "h2_session_windows": f"""select zone_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n, {r4('avg(value)')} as mean_value, {r4('max(value)')} as max_value from (
        select *, sum(cast(gap as int)) over (partition by zone_id order by ts rows unbounded preceding) as session from (
          select zone_id, ts, value, coalesce(ts - lag(ts) over (partition by zone_id order by ts) >= interval 6 hours, true) as gap from observation)) group by zone_id, session""",
    "h3_stream_belief": f"""select zone_id, n, {r4('(wet + 1) / (n + 2)')} as p, round((wet + 1) * (n - wet + 1) / ((n + 2) * (n + 2) * (n + 3)) + 1e-12, 8) as variance
      from (select zone_id, count(*)::double as n, count(*) filter (value >= 120)::double as wet from observation group by all)""".replace("select zone_id, n,", "select zone_id, n::bigint as n,"),
    "h4_stream_decide": f"select zone_id, n, {r4('exact_p')} as p, round(variance + 1e-12, 8) as variance, action, {r4('loss')} as loss, gate from followed",
    "h5_outcome_status": """select event_id as forecast_id, coalesce(outcome_id, -1) as outcome_id, f.zone_id, case when outcome_id is null then 'missing' else 'matched' end as status
      from observation f left join followed_by on forecast_id = event_id where sensor = 'view'""",
    "h6_stream_drift": f"""select cast(cast(outcome_ts as date) as varchar) as start, count(*) as n, {r4('avg(e)')} as brier, avg(e) > 1.5 * max(batch) as alarm from (
        select outcome_ts, (forecast_value / (forecast_value + 50.0) - cast(outcome_value >= 120 as int)) * (forecast_value / (forecast_value + 50.0) - cast(outcome_value >= 120 as int)) as e from followed_by)
      cross join (select avg((p - y) * (p - y)) as batch from scored) group by cast(outcome_ts as date)""",
    "h5_outcome_ledger": """select forecast_id, coalesce(first.id, -1) as outcome_id, zone_id, case when first.id is null then 'missing' when first.ts <= ts + interval 1 hour then 'matched' else 'late' end as status from outcome_of""",
    "h6_closed_loop": """select zone_id, case when gate <> 'abstain' then action end as action, gate, array_to_string(flags, ',') as limitations,
      case when gate <> 'act' then 'gate is ' || gate when len(flags) >= 2 then 'several limitations' when action = 'evacuate' and lo < 0.5 then 'evacuation on an uncertain belief' else 'none' end as reason
      from (select zone_id, action, lo, case when gate = 'act' and alarm then 'verify' else gate end as gate, case when alarm then list_append(flags, 'forecast_drift') else flags end as flags from live cross join alarmed)""",
    "h7_live_record": f"""select zone_id, n, case when gate <> 'abstain' then action end as action, gate, {r4('p')} as p, {r4('p * coalesce(population, 0)')} as expected_affected, {r4('p - p_before')} as change, coalesce(reasons, '') as reasons,
      {r4('sd')} as sd, {r4('lo')} as lo, {r4('hi')} as hi, case gate when 'act' then 'high' when 'verify' then 'medium' else 'low' end as label, alternatives, {r4('extra_loss')} as extra_loss, array_to_string(flags, ',') as limitations,
      reason <> 'none' as needs_human, reason, district_name as district, {r4('population')} as population, assets
      from (select *, case when gate <> 'act' then 'gate is ' || gate when len(flags) >= 2 then 'several limitations' when action = 'evacuate' and lo < 0.5 then 'evacuation on an uncertain belief' else 'none' end as reason from live)
      left join context using (zone_id) left join belief_before using (zone_id) left join reasons using (zone_id) left join belief_others using (zone_id)""",
    "h7_publish_latest": "select gate, count(*) as zones, strftime(max(newest), '%Y-%m-%d %H:%M:%S.%f') as newest from followed group by gate",
    "h5_outcome_join": """select f.event_id as forecast_id, o.event_id as outcome_id, f.zone_id from observation f join observation o on f.zone_id = o.zone_id and f.sensor = 'view' and o.sensor = 'error'
      and o.ts > f.ts and o.ts <= f.ts + interval 1 hour""",
}


STATEMENTS["h3_belief_counts"] = STATEMENTS["h3_stream_belief"]
STATEMENTS["a1_features_by_day"] = STATEMENTS["a1_zone_features"]


def statement(name: str) -> str:
    """The statement with the expressions that it needs, in order."""
    needed, text = [], STATEMENTS[name]
    for key, sql in reversed(EXPRESSIONS.items()):
        if re.search(rf"\b{key}\b", text):
            needed.append(f"{key} as ({sql})")
            text += " " + sql
    return ("with " + ",\n".join(reversed(needed)) + "\n" if needed else "") + STATEMENTS[name]


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}
