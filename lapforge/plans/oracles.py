"""DuckDB SQL for the lap queries, written apart from the Spark code."""

from __future__ import annotations

_LAPS = """
placed as (
  select event_id, ts, user_id, event_type, value,
    event_type = 'purchase' as in_lap, epoch_us(ts) / 1e6 as sec, json_extract_string(props, '$.k')::bigint as k,
    row_number() over t as lap_number,
    coalesce(lag(event_type = 'purchase') over t, false) as out_lap
  from events window t as (partition by user_id order by ts, event_id)
), laps as (
  select 'S' || (user_id % 5) as session_key, user_id as driver_number, lap_number,
    case when event_id % 23 <> 0 then value end as lap_time_seconds,
    case when in_lap then sec end as pit_in_time, case when out_lap then sec end as pit_out_time,
    in_lap or out_lap as is_pit_lap,
    case event_type when 'purchase' then 'HYPERSOFT' when 'view' then ' m ' when 'click' then 'Inter' when 'error' then 'GLITTER' end as tyre_compound_raw,
    case event_type when 'purchase' then 'SOFT' when 'view' then 'MEDIUM' when 'click' then 'INTERMEDIATE' else 'UNKNOWN' end as tyre_compound,
    'C' || (k % 7) as circuit_name, case when day(ts) <= 24 then 2018 else 2024 end::bigint as year,
    (sum(out_lap::int) over (partition by user_id order by lap_number) + 1)::bigint as stint_number,
    row_number() over (partition by user_id % 5, lap_number order by value, event_id) as position, event_id, ts, sec, event_type
  from placed
), base as (
  select *, lap_time_seconds - min(lap_time_seconds) over (partition by session_key, lap_number) as lap_gap,
    row_number() over (partition by driver_number, stint_number order by lap_number) - 1 as age,
    case when count(lap_time_seconds) over r3 = 3 then avg(lap_time_seconds) over r3 end as mean3
  from laps window r3 as (partition by driver_number order by lap_number rows 2 preceding)
)"""
_TRACE = "(partition by driver_number order by lap_number)"
_SLOPE = """greatest(-0.5, least(0.5, case when var_pop(case when lap_time_seconds is not null then age end) over (partition by driver_number, stint_number) > 0
    then regr_slope(lap_time_seconds, age) over (partition by driver_number, stint_number) else 0 end))"""
_PIT = f"case when pit_out_time - lag(pit_in_time) over {_TRACE} >= 0 then pit_out_time - lag(pit_in_time) over {_TRACE} end"
_METRICS = {
    "gap_to_leader_v1": "lap_gap",
    "gap_to_leader_v2": f"sum(lap_gap) over {_TRACE}",
    "tyre_age_v1": "sum(lap_time_seconds) over (partition by driver_number, stint_number order by lap_number) - lap_time_seconds",
    "tyre_age_v2": "age",
    "pit_delta_v1": "case when is_pit_lap then lap_time_seconds - median(lap_time_seconds) over (partition by driver_number) end",
    "pit_delta_v2": _PIT,
    "degradation_rate_v1": f"mean3 - lag(mean3) over {_TRACE}",
    "degradation_rate_v2": _SLOPE,
    "stint_age_squared_v1": "(age * age)::double",
    "race_progress_v1": "lap_number / max(lap_number) over (partition by session_key)",
    "pace_delta_v1": "lap_time_seconds - median(lap_time_seconds) over (partition by driver_number order by lap_number rows 4 preceding)",
    "gap_closing_rate_v1": f"(lag(lap_gap, 3) over {_TRACE} - lap_gap) / 3",
    "relative_pace_delta_v1": "lap_time_seconds - median(lap_time_seconds) over (partition by session_key, lap_number)",
}
_KEYS = "session_key, driver_number, lap_number"


def _r(sql: str, name: str) -> str:
    return f"round({sql}, 6) as {name}"


_CURRENT = f"""{_LAPS}, current as (
  select *, {", ".join(f"{sql} as {key}" for key, sql in [(k[:-3], v) for k, v in _METRICS.items() if k[:-3] not in ("gap_to_leader", "tyre_age", "pit_delta", "degradation_rate")])},
    {_METRICS["gap_to_leader_v2"]} as gap_to_leader, age as tyre_age, {_PIT} as pit_delta, {_SLOPE} as degradation_rate,
    coalesce(max(is_pit_lap::int) over (partition by driver_number order by lap_number rows between 1 following and 5 following), 0)::bigint as y
  from base
), scored as (
  select {_KEYS}, circuit_name, year, y, round(1 / (1 + exp(-(-1.0::double + 0.15::double * tyre_age + 0.5::double * race_progress + 0.001::double * coalesce(pace_delta, 0.0)))), 6) as p
  from current
)"""
_GAPPY = f"""{_LAPS}, gappy as (
  select session_key, driver_number, lap_number, case when event_id % 7 > 1 then lap_time_seconds end as v, sec,
    sec - lag(sec) over {_TRACE} as step from laps
), spaced as (
  select *, median(case when step > 0 then step end) over (partition by driver_number) as interval_s,
    count(v) over {_TRACE} as seen from gappy
), runs as (
  select *, count(*) filter (v is null) over (partition by driver_number, seen) as missing from spaced
), told as (
  select *, v is null and seen > 0 and coalesce(missing * interval_s <= 100000, false) as filled from runs
)"""
_SCORES = """tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall"""
_F1 = "case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end"


def _sweep(grid: str) -> str:
    return f"""{_CURRENT}, grid as (select round(unnest({grid}), 2) as threshold
), counts as (
  select threshold, count(*) filter (p >= threshold and y = 1) as tp, count(*) filter (p >= threshold and y <> 1) as fp,
    count(*) filter (p < threshold and y = 1) as fn from grid, scored group by threshold
), rates as (select threshold, {_SCORES} from counts
), sweep as (select *, {_F1} as f1 from rates)"""


_AUC = """(sum(rank_) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2)
    / nullif(count(*) filter (y = 1) * count(*) filter (y <> 1), 0)"""


def _psi(source: str, reference: str, current: str, column: str) -> str:
    """Rows (feature, psi) of one column, from quantile edges of the reference."""
    return f"""select '{column}' as feature, sum((c - r) * ln(c / r)) as psi from (
    select b, greatest(coalesce(r.n / (select count(*) from {source} where {reference} and {column} is not null), 0), 0.0001) as r,
      greatest(coalesce(c.n / (select count(*) from {source} where {current} and {column} is not null), 0), 0.0001) as c
    from (select unnest(range(0, len(e) - 1)) as b from (select list_sort(list_distinct(quantile_cont({column}::double, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from {source} where {reference}))
    left join (select b, count(*) as n from (select len(list_filter(e[2:-2], lambda x: x <= v)) as b from (select {column}::double as v from {source} where {reference} and {column} is not null),
      (select list_sort(list_distinct(quantile_cont({column}::double, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from {source} where {reference})) group by b) r using (b)
    left join (select b, count(*) as n from (select len(list_filter(e[2:-2], lambda x: x <= v)) as b from (select {column}::double as v from {source} where {current} and {column} is not null),
      (select list_sort(list_distinct(quantile_cont({column}::double, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from {source} where {reference})) group by b) c using (b))"""


_SEVERITY = "case when psi < 0.1 then 'stable' when psi < 0.25 then 'moderate' else 'significant' end"
_CLOCK = r"""case when regexp_full_match(raw, '\s*(\d+:)?\d{1,2}(\.\d{1,6})?\s*') then
    coalesce(nullif(regexp_extract(raw, '^\s*(?:(\d+):)?(\d{1,2})(?:\.(\d{1,6}))?\s*$', 1), '')::double, 0) * 60
    + regexp_extract(raw, '^\s*(?:(\d+):)?(\d{1,2})(?:\.(\d{1,6}))?\s*$', 2)::double
    + coalesce(('0.' || nullif(regexp_extract(raw, '^\s*(?:(\d+):)?(\d{1,2})(?:\.(\d{1,6}))?\s*$', 3), ''))::double, 0) end"""

ORACLES: dict[str, str] = {
    name: f"with {_LAPS} select {_KEYS}, {sql if name == 'tyre_age_v2' else f'round({sql}, 6)'} as value from base" for name, sql in _METRICS.items()
} | {
    "metrics_view": f"with {_CURRENT} select {_KEYS}, stint_number, tyre_age, "
    + ", ".join(_r(k, k) for k in ("degradation_rate", "gap_closing_rate", "gap_to_leader", "pace_delta", "pit_delta", "race_progress", "relative_pace_delta", "stint_age_squared"))
    + " from current",
    "metrics_without_stint": f"""with {_LAPS}, pits as (
  select *, lag(is_pit_lap::int, 1, 0) over {_TRACE} as before from laps
), stints as (
  select *, sum(before) over {_TRACE} as stint from pits
), ages as (
  select *, row_number() over (partition by driver_number, stint order by lap_number) - 1 as age from stints
)
select {_KEYS}, age as tyre_age, (age * age)::double as stint_age_squared,
  round({_SLOPE.replace("stint_number", "stint")}, 6) as degradation_rate from ages""",
    "metrics_as_of_2023": f"with {_LAPS} select {_KEYS}, "
    + ", ".join(_r(_METRICS[f"{k}_v1"], k) for k in ("degradation_rate", "gap_to_leader", "pit_delta", "tyre_age"))
    + " from base",
    "registry_as_of": """
with registry(key, version, since, until) as (values
  ('gap_to_leader', 'v1', date '2023-01-01', date '2024-01-01'), ('gap_to_leader', 'v2', date '2024-01-01', null),
  ('tyre_age', 'v1', date '2023-01-01', date '2024-01-01'), ('tyre_age', 'v2', date '2024-01-01', null),
  ('pit_delta', 'v1', date '2023-01-01', date '2024-01-01'), ('pit_delta', 'v2', date '2024-01-01', null),
  ('degradation_rate', 'v1', date '2023-01-01', date '2024-01-01'), ('degradation_rate', 'v2', date '2024-01-01', null),
  ('stint_age_squared', 'v1', date '2024-01-01', null), ('race_progress', 'v1', date '2024-01-01', null),
  ('pace_delta', 'v1', date '2024-01-01', null), ('gap_closing_rate', 'v1', date '2024-01-01', null),
  ('relative_pace_delta', 'v1', date '2024-01-01', null)
), days as (select ts::date as day, count(*) as n from events group by 1)
select key, version, count(*)::bigint as n_days, sum(n)::bigint as n_events from days join registry on day >= since and (until is null or day < until) group by 1, 2""",
    "derive_stint": f"""with {_LAPS}
select {_KEYS}, coalesce(sum(is_pit_lap::int) over (partition by driver_number order by lap_number rows between unbounded preceding and 1 preceding), 0)::bigint as by_pit_lap,
  coalesce(sum((pit_in_time is not null)::int) over (partition by driver_number order by lap_number rows between unbounded preceding and 1 preceding), 0)::bigint as by_in_lap
from laps""",
    "race_dimension": f"""with {_LAPS} select session_key, count(distinct driver_number)::bigint as num_drivers, max(lap_number)::bigint as num_laps,
  min(circuit_name) as circuit_name from laps group by 1""",
    "compound_norm": f"with {_LAPS} select tyre_compound_raw, tyre_compound, count(*)::bigint as n from laps group by 1, 2",
    "duration_parse": rf"""
with rows as (
  select event_id, case event_id % 5 when 0 then clock when 1 then event_id::varchar when 2 then '1:' || clock when 3 then 'not-a-time' end as raw
  from (select event_id, floor(value / 60)::bigint || ':' || lpad(floor(value % 60)::bigint::varchar, 2, '0') || '.' || lpad((event_id % 1000)::varchar, 3, '0') as clock from events)
), parsed as (select event_id, raw, {_CLOCK} as clock from rows)
select event_id, round(coalesce(clock, try_cast(raw as double)), 6) as seconds, round(coalesce(clock, try_cast(raw as double) * 0.001), 6) as seconds_from_ms from parsed""",
    "normalize_raw": f"""with {_LAPS}, dev as (
  select *, count(lap_time_seconds) over w as n, median(lap_time_seconds) over w as m from laps window w as (partition by driver_number)
), mads as (select *, median(abs(lap_time_seconds - m)) over (partition by driver_number) as mad from dev)
select {_KEYS}, left('D' || driver_number || 'X', 3) as driver_code, 'Team ' || (driver_number % 2) as team_name, tyre_compound, event_type <> 'purchase' and coalesce(tyre_compound_raw, '') <> '' and day(ts) = 3 as rainfall, is_pit_lap,
  coalesce(n >= 5 and mad > 0 and abs(lap_time_seconds - m) / (mad * 1.4826::double) > 3, false) as lap_time_outlier, round(lap_time_seconds, 6) as lap_time_seconds
from mads""",
    "exclude_laps": f"with {_LAPS} select {_KEYS} from laps where not is_pit_lap and lap_number > 3 and event_type <> 'error' and day(ts) <> 3",
    "mad_outliers": """
with dev as (select l_suppkey, l_extendedprice as x, count(*) over w as n, median(l_extendedprice) over w as m from lineitem window w as (partition by l_suppkey)
), mads as (select *, median(abs(x - m)) over (partition by l_suppkey) as mad from dev)
select l_suppkey, count(*)::bigint as n, count(*) filter (n >= 5 and mad > 0 and abs(x - m) / (mad * 1.4826::double) > 2)::bigint as n_outliers from mads group by 1""",
    "impute_gaps": f"""with {_GAPPY}
select {_KEYS}, case when filled then last_value(v ignore nulls) over {_TRACE} else v end as lap_time_seconds,
  filled as lap_time_seconds_imputed, v is null and not filled as lap_time_seconds_sensor_failure from told""",
    "impute_events": f"""with {_GAPPY}
select session_key, driver_number, 'lap_time_seconds' as "column", min(lap_number) as first_lap, count(*)::bigint as n_samples,
  round(count(*) * any_value(interval_s), 6) as duration_seconds, case when bool_or(filled) then 'forward_filled' else 'sensor_failure' end as action,
  case when seen = 0 then 'gap at start of trace' when any_value(interval_s) is null then 'gap of unknown length' when bool_or(filled) then 'gap of  within ' else 'gap of  over ' end as reason
from told where v is null group by session_key, driver_number, seen""",
    "completeness": f"""with {_LAPS} select unnest(['lap_time_seconds', 'pit_in_time', 'pit_out_time', 'position']) as "column",
  unnest([round(100 * count(lap_time_seconds) / count(*), 6), round(100 * count(pit_in_time) / count(*), 6), round(100 * count(pit_out_time) / count(*), 6), round(100 * count(position) / count(*), 6)]) as percent from laps""",
    "null_rates": f"""with {_LAPS} select unnest(['lap_time_seconds', 'tyre_compound', 'tyre_compound_raw', 'pit_in_time']) as "column",
  unnest([round(1 - count(lap_time_seconds) / count(*), 6), round(1 - count(tyre_compound) / count(*), 6), round(1 - count(tyre_compound_raw) / count(*), 6), round(1 - count(pit_in_time) / count(*), 6)]) as null_rate from laps""",
    "driver_coverage": f"with {_LAPS} select session_key, count(distinct driver_number)::bigint as n_drivers from laps group by 1",
    "lap_gaps": f"""with {_LAPS}, moved as (
  select session_key, driver_number, lap_number + sum((event_id % 11 = 0)::int) over {_TRACE} as lap_number from laps
), nxt as (
  select *, lead(lap_number) over {_TRACE} as nxt from moved)
select session_key, driver_number, (lap_number + 1)::bigint as first_missing, (nxt - 1)::bigint as last_missing from nxt where nxt - lap_number > 1""",
    "monotonic_gap": f"""with {_LAPS} select count(*) filter (d < -0.000001)::bigint as n_violations
from (select lap_gap - lag(lap_gap) over {_TRACE} as d from base)""",
    "stint_reset": f"""with {_CURRENT}, kept as (
  select *, tyre_age + (event_id % 3 = 0)::int as age2, stint_number - lag(stint_number) over {_TRACE} as d from current)
select count(*) filter (d <> 0 and age2 <> 0)::bigint as n_violations from kept""",
    "dup_laps": f"""with {_LAPS} select count(*) filter (event_id % 17 = 0)::bigint as n_violations from laps""",
    "dup_positions": f"""with {_LAPS} select sum(n - d)::bigint as n_duplicates from (
  select count(p) as n, count(distinct p) as d from (select session_key, lap_number, case when event_id % 10 = 0 then 1 else position end as p from laps) group by session_key, lap_number)""",
    "bounds": f"""with {_CURRENT} """
    + " union all ".join(
        f"""select '{c}' as "column", count(*) filter ({c} < {lo})::bigint as n_low, count(*) filter ({c} > {hi})::bigint as n_high, count({c})::bigint as n_total from current"""
        for c, lo, hi in (("lap_time_seconds", 55.0, 150.0), ("degradation_rate", -0.5, 0.5), ("pit_delta", 1.5, 90.0))
    ),
    "sigma_count": f"""with {_LAPS}, dev as (
  select *, count(lap_time_seconds) over w as n, median(lap_time_seconds) over w as m from laps window w as (partition by driver_number)
), mads as (select *, median(abs(lap_time_seconds - m)) over (partition by driver_number) as mad from dev)
select session_key, driver_number, count(*) filter (abs(lap_time_seconds - m) > 1.5::double * 1.4826::double * mad)::bigint as n_outside
from mads where n >= 5 and mad > 0 group by 1, 2""",
    "validation_report": f"""with {_CURRENT}, dmg as (
  select *, lap_number + (event_id % 10 = 0)::int as lap2 from current
), steps as (
  select *, lap2 - lag(lap2) over t as d_lap, gap_to_leader - lag(gap_to_leader) over t as d_gap, stint_number - lag(stint_number) over t as d_stint,
    count(lap_time_seconds) over w as n, median(lap_time_seconds) over w as m
  from dmg window t as (partition by driver_number order by lap2, event_id), w as (partition by driver_number)
), mads as (
  select *, median(abs(lap_time_seconds - m)) over (partition by driver_number) as mad from steps
), one as (
  select count(*) as n, count(*) filter (d_gap < -0.000001) as gap, count(*) filter (d_stint <> 0 and tyre_age <> 0) as age, count(*) filter (d_lap <= 0) as ord,
    count(*) filter (lap_time_seconds < 55 or lap_time_seconds > 150) as b1, count(*) filter (degradation_rate < -0.5 or degradation_rate > 0.5) as b2,
    count(*) filter (pit_delta < 1.5 or pit_delta > 90) as b3, count(*) filter (n >= 5 and mad > 0 and abs(lap_time_seconds - m) > 2 * 1.4826::double * mad) as sig
  from mads
), nulls as (
  {" union all ".join(f"select '{c}' as c, count(*) filter ({c} is null) as k, count(*) as n, {strict} as strict from current" for c, strict in [("lap_time_seconds", "true"), ("tyre_compound", "true"), ("position", "true"), *[(c, "false") for c in ("pit_in_time", "pit_out_time", "is_pit_lap", "circuit_name", "year", "ts", "event_id", "stint_number", "gap_to_leader", "tyre_age", "pit_delta", "degradation_rate", "stint_age_squared", "race_progress", "pace_delta", "gap_closing_rate", "relative_pace_delta")]])}
), holes as (
  select session_key from (select session_key, d, lead(d) over (partition by driver_number order by d) as nxt from (select distinct session_key, driver_number, lap2 as d from dmg)) where nxt - d > 1
), results as (
  select 'completeness' as category, 'required_columns' as name, 'PASS' as severity, 0 as n_affected, null as session_key
  union all select 'completeness', 'null_rate:' || c, case when k / n <= case when strict then 0.05 else 0.1 end then 'PASS' when strict then 'ERROR' else 'WARNING' end, k, null
    from (select * from nulls union all select 'tyre_life', 0, 1, true) where strict or k / n > 0.1
  union all select 'completeness', 'driver_coverage', 'WARNING', count(distinct driver_number), session_key from current group by session_key
    having count(distinct driver_number) < 10000
  union all select 'completeness', 'lap_sequence_gaps', 'WARNING', count(*), session_key from holes group by session_key
  union all select 'consistency', 'monotonic_cumulative_gap', case when gap > 0 then 'ERROR' else 'PASS' end, gap, null from one
  union all select 'consistency', 'tyre_age_resets_after_pit', case when age > 0 then 'ERROR' else 'PASS' end, age, null from one
  union all select 'consistency', 'lap_number_strictly_increasing', case when ord > 0 then 'ERROR' else 'PASS' end, ord, null from one
  union all select 'consistency', 'unique_position_per_lap', case when k > 0 then 'WARNING' else 'PASS' end, k, null
    from (select coalesce(sum(k - 1), 0) as k from (select count(*) as k from dmg where position is not null group by session_key, lap2, position))
  union all select 'reasonableness', 'bounds:lap_time_seconds', case when b1 > 0 then 'ERROR' else 'PASS' end, b1, null from one
  union all select 'reasonableness', 'bounds:degradation_rate', case when b2 > 0 then 'ERROR' else 'PASS' end, b2, null from one
  union all select 'reasonableness', 'bounds:pit_delta', case when b3 > 0 then 'ERROR' else 'PASS' end, b3, null from one
  union all select 'reasonableness', 'lap_time_within_driver_sigma', case when sig > 0 then 'WARNING' else 'PASS' end, sig, null from one
)
select category, name, severity, n_affected::bigint as n_affected, session_key from results""",
    "circuit_loss_fit": f"with {_CURRENT} select circuit_name, round(avg(pit_delta), 6) as circuit_loss from current where circuit_name is not null group by 1",
    "circuit_loss_apply": f"""with {_CURRENT}, losses as (
  select circuit_name, avg(pit_delta) as loss from current where circuit_name <> 'C3' group by 1)
select {_KEYS}, round(coalesce(loss, (select avg(loss) from losses)), 6) as circuit_loss from current left join losses using (circuit_name)""",
    "pit_targets": f"""with {_CURRENT}, nexts as (select *, lead(is_pit_lap::int) over {_TRACE} as nxt from current)
select {_KEYS}, y as pit_next_5_laps,
  coalesce(max(nxt) over (partition by driver_number order by lap_number rows between 4 preceding and current row), 0)::bigint as pit_next_5_laps_compat from nexts""",
    "star_load": """select n_name, year(o_orderdate)::bigint as year, count(*)::bigint as n_orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where n_regionkey in (1, 2, 3) and n_name is not null group by 1, 2""",
    "threshold_sweep": f"""with {_sweep("list_transform(range(0, 17), lambda i: 0.1 + 0.05 * i)")}
select threshold::double as threshold, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from sweep""",
    "best_threshold": f"""with {_sweep("list_transform(range(0, 80), lambda i: 0.1 + 0.01 * i)")}
select case when max(f1) > 0 then arg_max(threshold, (f1, -threshold)) else 0.5 end::double as threshold, round(max(f1), 6) as f1 from sweep""",
    "group_metrics": f"""with {_CURRENT}, ranked as (
  select *, rank() over (partition by circuit_name order by p) + (count(*) over (partition by circuit_name, p) - 1) / 2 as rank_ from scored
), groups as (
  select circuit_name, count(*)::bigint as n, {_AUC} as roc_auc, count(*) filter (p >= 0.55 and y = 1) as tp,
    count(*) filter (p >= 0.55 and y <> 1) as fp, count(*) filter (p < 0.55 and y = 1) as fn from ranked group by 1
), rates as (select *, {_SCORES.replace("tp, fp, fn, ", "")} from groups)
select circuit_name, n, round(case when fit then roc_auc end, 6) as roc_auc, round(case when fit then precision end, 6) as precision,
  round(case when fit then recall end, 6) as recall, round(case when fit then {_F1} end, 6) as f1
from (select *, n >= 30 and roc_auc is not null as fit from rates)""",
    "roc_auc": f"""with {_CURRENT}, ranked as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rank_ from scored)
select round({_AUC}, 6) as roc_auc from ranked""",
    "brier": f"with {_CURRENT} select round(avg((p - y) * (p - y)), 6) as brier from scored",
    "brier_by_group": f"""with {_CURRENT} select driver_number, count(*)::bigint as n, round(case when count(*) >= 30 then avg((p - y) * (p - y)) end, 6) as brier from scored group by 1""",
    "reliability_quantile": f"""with {_CURRENT}, edges as (
  select list_sort(list_distinct(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as e from scored)
select greatest(1, len(list_filter(e, lambda x: x < p)))::bigint as bin, count(*)::bigint as n, round(avg(p), 6) as mean_predicted, round(avg(y), 6) as observed_rate
from scored, edges group by 1""",
    "reliability_uniform": f"""with {_CURRENT}, ends as (select min(p) as lo, max(p) as hi from scored)
select greatest(1, least(10, ceil((p - lo) * 10 / (hi - lo))))::bigint as bin, count(*)::bigint as n, round(avg(p), 6) as mean_predicted, round(avg(y), 6) as observed_rate
from scored, ends group by 1""",
    "drift_report": f"""with {_CURRENT}, rows as ({" union all ".join(_psi("current", "year = 2018", "year = 2024", c) for c in ("lap_time_seconds", "tyre_age", "race_progress"))})
select feature, round(psi, 5) as psi, {_SEVERITY} as severity from rows
union all select 'no_such_column', null, 'unavailable (column missing)'""",
    "psi_orders": f"""with rows as ({_psi("orders", "month(o_orderdate) <= 6", "month(o_orderdate) > 6", "o_totalprice")})
select feature, round(psi, 5) as psi, {_SEVERITY} as severity from rows""",
    "base_rates": f"""with {_CURRENT} select case when year = 2018 then 'train' else 'test' end as part, count(*)::bigint as n,
  round(avg(y), 6) as base_rate from current group by 1""",
    "race_star": f"""with {_LAPS}, ends as (select session_key, min(circuit_name) as circuit_name, count(distinct driver_number) as d from laps group by 1)
select session_key, 2018::int as year, any_value(e.circuit_name) as circuit_name, count(*)::bigint as n_laps, max(d)::bigint as num_drivers
from laps join ends e using (session_key) where session_key < 'S3' group by 1""",
    "nearest_threshold": f"""with {_sweep("list_transform(range(0, 80), lambda i: 0.1 + 0.01 * i)")}
select threshold::double as threshold, tp, fp, fn from sweep order by abs(threshold - 0.3333), threshold limit 1""",
    "action_labels": f"""with {_CURRENT} select case when p < 0.7::double * 0.6::double then 'Unlikely near-term' when p < 0.6 then 'Monitor' else 'Investigate pit window' end as action,
  count(*)::bigint as n from scored group by 1""",
    "scaler_fit": f"with {_CURRENT}, long as (unpivot (select "
    + ", ".join(f"coalesce({c}, 0)::double as {c}" for c in ("gap_to_leader", "tyre_age", "pit_delta", "degradation_rate", "stint_age_squared", "race_progress", "pace_delta", "gap_closing_rate", "relative_pace_delta"))
    + " from current where year = 2018) on columns(*) into name feature value v) select feature, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as deviation from long group by 1",
    "combined_metrics": f"""with {_CURRENT}
select {_KEYS}, round(coalesce(pace_delta, 0) - coalesce(relative_pace_delta, 0), 6) as pace_balance,
  round((coalesce(pace_delta, 0) - coalesce(relative_pace_delta, 0)) / (tyre_age + 1), 6) as balance_by_age from current""",
    "race_merge": f"""with {_LAPS}, sessions as (
  select 'U' || driver_number as session_key, (2018 + driver_number % 7)::int as year, 'R' || (driver_number % 40) as race_name,
    driver_number % 2 = 0 as early, max(lap_number)::bigint as num_laps from laps group by driver_number
), named as (
  select year, race_name, bool_or(early) as early, arg_min(session_key, (not early, session_key)) as session_key,
    arg_min(num_laps, (not early, session_key)) as num_laps from sessions group by year, race_name
)
select row_number() over (order by not early, year, race_name)::bigint as race_id, session_key, year, race_name,
  1::bigint as num_drivers, num_laps from named""",
    "stored_star": f"""with {_LAPS}
select rank() over (order by session_key)::bigint as race_id, session_key, 'R' || session_key as race_name, 2018::int as year,
  count(*)::bigint as n_laps, round(sum(lap_time_seconds), 3) as total from laps where session_key < 'S3' group by session_key""",
    "normalize_counts": f"""with {_LAPS}
select 'rows' as "column", count(*)::bigint as n from laps
union all select 'lap_time_seconds', count(*) filter (event_id % 5 = 0) from laps
union all select 'lap_number', count(*) filter (event_id % 7 = 0) from laps
union all select 'air_temp', count(*) filter (event_id % 9 = 0) from laps
union all select 'tyre_compound', count(*) filter (event_type = 'error') from laps""",
    "stratified_folds": f"""with {_CURRENT}, sizes as (select y, count(*) as k from current group by y), folds as (select unnest(range(0, 5)) as fold)
select y, fold, ((k + 4 - fold) // 5)::bigint as n from sizes, folds""",
    "policy_sweep": f"""with {_sweep("list_transform(range(0, 18), lambda i: 0.1 + 0.05 * i)")}
select threshold::double as threshold, case when threshold < 0.5 then 'coverage-first' when threshold < 0.7 then 'balanced' else 'intervention-first' end as style,
  tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  round((tp + fp) / (select count(*) from scored), 6) as flagged_share from sweep""",
    "race_state": f"""with {_CURRENT}
select session_key, driver_number, max(lap_number) as lap_number, arg_max(p, lap_number) as p,
  case when arg_max(p, lap_number) < 0.7::double * 0.6::double then 'Unlikely near-term' when arg_max(p, lap_number) < 0.6 then 'Monitor' else 'Investigate pit window' end as action
from scored group by 1, 2""",
    "model_review": f"""with {_CURRENT}, counts as (
  select count(*) as laps, avg(y) as base_rate, avg((p - y) * (p - y)) as brier, count(*) filter (p >= 0.55 and y = 1) as tp,
    count(*) filter (p >= 0.55 and y <> 1) as fp, count(*) filter (p < 0.55 and y = 1) as fn from scored
), rates as (select laps, base_rate, brier, {_SCORES} from counts
), one as (select *, {_F1} as f1 from rates),
long as (unpivot (select laps::double as laps, base_rate::double as base_rate, brier::double as brier, tp::double as tp, fp::double as fp, fn::double as fn,
  precision::double as precision, recall::double as recall, f1::double as f1 from one) on columns(*) into name measure value v)
select measure, round(v, 6) as value from long""",
    "stream_traces": f"""with {_LAPS}
select {_KEYS}, false as late, {", ".join(f"round(({_METRICS[m]})::double, 6) as {m}" for m in ("tyre_age_v1", "tyre_age_v2", "stint_age_squared_v1", "pit_delta_v2", "degradation_rate_v1", "pace_delta_v1"))}
from base""",
}
