"""DuckDB SQL for the registered queries, over the same Parquet tables.

Written on its own, from the meaning of each query, so that it checks the Spark code. The
views it starts from are those of driverdata.py."""

from __future__ import annotations

import json

from ..functions import seeds
from ..functions.jsons import canonical
from ..schema import TRAITS, TRIAL_STATES
from . import driverdata as d

VIEWS: dict[str, str] = {
    "attempts": """select concat('o', l_orderkey) as trial_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as int) as attempt,
  l_suppkey as seed, case when l_linestatus = 'F' then concat('h', l_partkey) end as handle, l_shipdate as sent_at,
  case when l_returnflag = 'A' then 1 when l_returnflag = 'R' then 0 end as valid,
  case when l_returnflag <> 'N' then 'ok' when l_linestatus = 'O' then 'transient' else 'refused' end as category,
  cast(l_extendedprice as decimal(18,2)) as reserved_usd,
  case when l_linestatus = 'F' then cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) end as actual_usd from lineitem""",
    "latest": "select * from attempts qualify row_number() over (partition by trial_id order by attempt desc) = 1",
    "trials": """select concat('o', o_orderkey) as trial_id, concat('t', 1 + o_orderkey % 4) as test, concat('p', 1 + o_custkey, '-m', 1 + o_custkey % 3) as agent_id,
  concat('t', 1 + o_orderkey % 4, '/p', 1 + o_custkey, '-m', 1 + o_custkey % 3, '/r', 1 + o_orderkey % 2) as session_id, cast(o_orderkey as int) as trial_index,
  o_orderpriority as instrument, o_orderpriority in ('1-URGENT', '2-HIGH') as pairwise,
  concat('c', 1 + o_orderkey % 97) as clip_a, concat('c', 101 + (o_orderkey * 7 + 3) % 97) as clip_b, cast(1 + o_orderkey % 2 as int) as repeat,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then cast(1 + o_orderkey % 2 as int) end as position,
  concat('p', 1 + o_custkey) as persona_id, concat('m', 1 + o_custkey % 3) as model_id,
  case when a.attempt is null then 'planned' when o_orderstatus = 'P' then 'sent' when a.valid = 1 then 'valid' when a.valid = 0 then 'invalid' when a.category = 'refused' then 'refused' else 'failed' end as state,
  coalesce(a.attempt, 0) as attempt, a.category as last_category
  from orders left join latest a on a.trial_id = concat('o', o_orderkey)""",
    "answered": """select a.*, case when a.valid = 1 then case t.instrument
    when '1-URGENT' then concat('{"better":"', case when a.seed % 2 = 0 then 'A' else 'B' end, '"}') when '2-HIGH' then concat('{"alive":"', case when a.seed % 2 = 0 then 'A' else 'B' end, '"}')
    when '3-MEDIUM' then concat('{"like":', 1 + a.seed % 5, ',"trust":', 1 + (a.seed + 1) % 7, '}') when '4-NOT SPECIFIED' then concat('{"calm":', 1 + (a.seed + 2) % 5, '}') else '{"why":"because"}' end end as answer_json
  from attempts a join trials t using (trial_id)""",
    "personas": "select concat('p', 1 + c_custkey) as id, c_custkey + 1 as number, c_mktsegment as segment, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "clips": "select concat('c', p_partkey) as clip_id, cast(p_size as double) as duration_s, p_partkey * 977 % 50021 + 100 as size_bytes, cast(640 + 16 * (p_partkey % 2) as int) as width, 480 as height, 25.0::double as fps, case when p_partkey % 17 = 0 then null else cast(-20 - p_partkey % 7 as double) end as loudness_lufs, p_brand, p_type from part",
    "blinding": "select concat('c', p_partkey) as clip_id, 'brand' as factor, p_brand as level from part union all select concat('c', p_partkey), 'type', p_type from part",
    "runs": "select concat('s', i) as run_id, i as run_no, case when i % 2 = 0 then 'fidelity' else 'perception' end as kind, case when i % 2 = 1 then 't1' end as screening_test, case when i = 3 then 'abandoned' else 'complete' end as status from (select unnest(range(1, 7)) as i)",
    "results": """select concat('s', run_no) as run_id, run_no, concat('m', m) as model_id, case when odd = 1 then concat('p', 1 + u40, '-m', m) end as agent_id, case when odd = 1 then 'fidelity' else event_type end as instrument,
  event_id as pos, case when value >= 5 then 'pass' else 'fail' end as outcome, concat('h', event_id % 5) as settings_hash, 'i0' as instrument_hash, cast(case when odd = 1 then null when event_type = 'error' then 0 else 2 end as int) as pair_checks
  from (select *, event_id % 2 as odd, 1 + event_id % 6 as run_no, 1 + user_id % 3 as m, user_id % 40 as u40 from events)
  qualify row_number() over (partition by run_no, m, case when odd = 1 then u40 end, case when odd = 1 then 'fidelity' else event_type end order by event_id) = 1""",
    "complete": "select r.*, s.screening_test, s.kind from results r join runs s on s.run_id = r.run_id where s.status = 'complete'",
    "settings": "select * from (values ('m1', 'h1'), ('m2', 'h2'), ('m3', 'h9')) v(model_id, cur_settings)",
    "stamps": "select * from (values ('view', 'i0'), ('click', 'i0'), ('signup', 'i0'), ('fidelity', 'i0'), ('purchase', 'i1'), ('error', 'i0')) v(instrument, cur_instrument)",
    "counted": "select c.*, coalesce(settings_hash = cur_settings and instrument_hash = cur_instrument, false) as fresh, settings_hash is distinct from cur_settings as s_changed, instrument_hash is distinct from cur_instrument as i_changed from complete c left join settings using (model_id) left join stamps using (instrument)",
    "judged": "select model_id, instrument, agent_id, coalesce(max(outcome) filter (where rn = 1 and fresh), 'stale') as outcome, max(run_id) filter (where rn = 1 and fresh) as run_id, not bool_or(fresh) and bool_or(s_changed) as settings_changed, not bool_or(fresh) and bool_or(i_changed) as instrument_changed from (select *, row_number() over (partition by model_id, instrument, agent_id order by fresh desc, run_no desc, pos) as rn from counted) group by all",
    "changes": "select event_id as seq, cast(value as decimal(18,2)) as ceiling_usd from events where event_type = 'purchase' qualify row_number() over (partition by cast(ts as date) order by event_id desc) = 1",
    "checks": "select * from (values (0, 'view', false, ['c1','c2'], 'c1'), (1, 'view', false, ['c3'], '4'), (2, 'click', true, ['c1','c4'], 'c4'), (3, 'click', true, ['c2','c3'], 'c2'), (4, 'signup', false, ['c5','c6'], 'c6'), (5, 'error', false, ['c7'], '2')) v(pos, instrument, pairwise, clips, expected)",
    "ptrials": """select * from (select event_id, concat('m', 1 + user_id % 3) as model_id, 1 + event_id % 2 as repeat, event_type as instrument,
    case when event_type = 'click' then concat('c', 1 + event_id % 7, '|c', 1 + (event_id + 1 + (event_id // 7) % 6) % 7) else concat('c', 1 + event_id % 7) end as clips,
    case when event_type <> 'click' then cast(1 + cast(floor(value) as bigint) % 5 as varchar) when cast(floor(value) as bigint) % 2 = 0 then concat('c', 1 + event_id % 7) else concat('c', 1 + (event_id + 1 + (event_id // 7) % 6) % 7) end as answer, event_id % 11 = 0 as bad from events)
  qualify row_number() over (partition by model_id, repeat, instrument, clips order by event_id desc) = 1""",
    "raws": """select concat('e', event_id) as id, event_id, event_id % 13 as k, cast(json_extract_string(props, '$.k') as int) as n, props from events""",
    "prices": "select * from (values ('m1', 'alpha', 1.25, 5.0, 263, 4.0, 100), ('m2', 'beta', 0.075, 0.3, 258, 4.0, 200), ('m3', 'gamma', 3.0, 15.0, 300, 3.5, 150)) v(model_id, provider, pin, pout, rate, cpt, most)",
    "shapes": "select * from (select 'rate' as instrument, c as clips, cast(null as varchar) as pair_id, cast(null as int) as position, p as place from (values ('c9', 0), ('c10', 1), ('c2', 2), ('c7', 3)) v(c, p) union all select 'pick', case o when 1 then concat(least(a.c, b.c), '|', greatest(a.c, b.c)) else concat(greatest(a.c, b.c), '|', least(a.c, b.c)) end, concat('pick:', least(a.c, b.c), ':', greatest(a.c, b.c)), o, 3 + row_number() over (order by a.p, b.p, o) from (values ('c9', 0), ('c10', 1), ('c2', 2), ('c7', 3)) a(c, p) join (values ('c9', 0), ('c10', 1), ('c2', 2), ('c7', 3)) b(c, p) on a.p < b.p, (values (1), (2)) w(o) union all select 'self', '', null, null, 16)",
    "sessions": "select persona_id, model_id, repeat, concat(persona_id, '-', model_id) as agent_id, concat('main/', persona_id, '-', model_id, '/r', repeat) as session_id from (select concat('p', 1 + c_custkey) as persona_id from customer), (values ('m1'), ('m2')) m(model_id), (values (1), (2), (3)) r(repeat)",
    "seeded": "select *, ('0x' || substr(sha256(concat('7:order:', session_id)), 1, 8))::bigint & 2147483647 as order_seed from sessions",
    "counters": "select *, 1 as c_trials, cast(state = 'invalid' as int) as c_invalid, cast(state = 'refused' as int) as c_refused, cast(state = 'failed' as int) as c_failed, cast(state = 'failed' and last_category is distinct from 'transient' as int) as c_fatal, cast(state = 'failed' and last_category = 'transient' as int) as c_transient, 0 as c_exhausted from trials",
    "cells": """select t.trial_id, case when not pairwise then a.p_brand end as brand, case when pairwise then a.p_brand end as brand_a, case when pairwise then b.p_brand end as brand_b,
  case when not pairwise then a.p_type end as type, case when pairwise then a.p_type end as type_a, case when pairwise then b.p_type end as type_b from trials t left join clips a on a.clip_id = clip_a left join clips b on b.clip_id = clip_b""",
    "budgets": "select trial_id, cast(count(*) filter (where valid = 0) as bigint) as n_invalid, cast(count(*) filter (where category = 'transient') as bigint) as n_transient from attempts group by trial_id",
    "open_trials": """select t.trial_id, t.test, t.state, coalesce(n_invalid, 0) as n_invalid, coalesce(n_transient, 0) as n_transient,
  case when l.trial_id is null then null when l.valid = 1 then 'valid' when l.valid = 0 and n_invalid > 2 then 'invalid' when l.category = 'transient' and n_transient > 3 then 'failed' when l.attempt < 6 then null
    when l.valid = 0 then 'invalid' when l.category = 'transient' then 'failed' when t.state = 'sent' and l.sent_at is not null and l.handle is not null then null else 'failed' end as settles_to
  from trials t left join latest l using (trial_id) left join budgets using (trial_id) where t.state in ('planned', 'sent')""",
    "deltas": """select cast(substr(trial_id, 2) as bigint) * 1000 + attempt as seq, 0 as step, trial_id, attempt, cast(reserved_usd as decimal(28,4)) as delta from attempts
  union all select cast(substr(trial_id, 2) as bigint) * 1000 + attempt, 1, trial_id, attempt, cast(actual_usd - reserved_usd as decimal(28,4)) from attempts where actual_usd is not null""",
    "replay": "select *, cast(sum(delta) over (order by seq, step) as decimal(28,4)) as committed from deltas",
    "shown": "select t.*, coalesce(case when t.state = 'valid' then v.attempt end, l.attempt) as exported_attempt, coalesce(case when t.state = 'valid' then v.seed end, l.seed) as seed, coalesce(case when t.state = 'valid' and v.attempt is not null then v.category end, l.category) as category, case when t.state = 'valid' then v.answer_json end as answer_json from trials t left join latest l using (trial_id) left join (select * from answered where valid = 1 qualify row_number() over (partition by trial_id order by attempt desc) = 1) v using (trial_id)",
    "items": "select * from (values ('1-URGENT', 'better', 'pairwise'), ('2-HIGH', 'alive', 'pairwise'), ('3-MEDIUM', 'like', 'likert'), ('3-MEDIUM', 'trust', 'likert'), ('4-NOT SPECIFIED', 'calm', 'likert'), ('5-LOW', 'why', 'free_text')) v(instrument, item, type)",
    "tidy": "select s.*, i.item, case when i.type = 'pairwise' then case json_extract_string(answer_json, '$.' || i.item) when 'A' then clip_a when 'B' then clip_b end else json_extract_string(answer_json, '$.' || i.item) end as response, p.segment, p.nation, p.region, c.brand, c.brand_a, c.brand_b, c.type, c.type_a, c.type_b from shown s join items i using (instrument) join personas p on p.id = persona_id join cells c using (trial_id) where state not in ('planned', 'sent')",
    "leak_values": " union all ".join(f"select b.factor, '{m}' as metric, b.level, cast(c.{m} as double) as x, {str(e).lower()} as exact, {t}::double as tolerance from blinding b join clips c using (clip_id)" for m, e, t in (("duration_s", False, 1.0), ("size_bytes", False, 500.0), ("loudness_lufs", False, 0.5), ("width", True, 0.0), ("height", True, 0.0), ("fps", True, 0.01))),
    "leak_levels": "select factor, metric, level, exact, tolerance, count(x) as n, avg(x) as mean, min(x) as lo, max(x) as hi from leak_values group by all",
    "leaks": "select a.factor, a.metric, a.level, a.n, a.mean, a.tolerance, max(case when a.exact then greatest(a.hi - b.lo, b.hi - a.lo) else abs(a.mean - b.mean) end) as max_diff from leak_levels a left join leak_levels b on a.factor = b.factor and a.metric = b.metric and a.level <> b.level group by all",
    "fid": "select concat('a', l_suppkey % 50) as agent_id, concat('i', l_partkey % 10) as item_id, (cast(floor(l_quantity) as bigint) + case when l_suppkey % 2 = 0 then l_partkey % 10 else 0 end) % 6 as value from lineitem where l_returnflag = 'A'",
    "keys": "select * from (values " + ", ".join(f"('{i}', '{c}', {str(r).lower()}, {p})" for i, c, r, p in d.KEYS) + ") v(item_id, construct, reversed, points)",
    "poles": "select concat('a', a) as agent_id, a, c.construct, case when (a >> c.bit) & 1 = 1 then 'high' else 'low' end as pole from (select unnest(range(0, 50)) as a), (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(d.CONSTRUCTS)) + ") c(bit, construct)",
    "construct_scores": "select agent_id, construct, pole, count(value) as n, avg(case when reversed then points + 1 - value else value end) as score from poles left join (select * from fid join keys using (item_id) where value between 1 and points) using (agent_id, construct) group by all",
    "gate_models": "select model_id, instrument, p, coalesce(j.outcome, 'missing') as found from (values ('m1'), ('m2'), ('m3')) m(model_id) cross join (values ('view', 0), ('error', 2)) n(instrument, p) left join (select * from judged where agent_id is null) j using (model_id, instrument)",
    "gate_worst": "select model_id, instrument, found from gate_models where found <> 'pass' qualify row_number() over (partition by model_id order by case found when 'fail' then 0 when 'stale' then 1 else 2 end, p) = 1",
    "gate": """select concat('p', p, '-', m) as agent_id, concat('p', p) as persona_id, m as model_id, w.instrument as worst_instrument, w.found,
  case when w.found = 'fail' then 'perception_fail' when coalesce(f.outcome, 'missing') = 'stale' or w.found = 'stale' then 'screening_stale' when w.found = 'missing' then 'perception_missing' when f.outcome = 'fail' then 'fidelity_fail' when f.outcome is null then 'fidelity_missing' end as reason
  from (select unnest(range(1, 41)) as p), (values ('m1'), ('m2'), ('m3')) v(m) left join gate_worst w on w.model_id = m left join judged f on f.agent_id = concat('p', p, '-', m) and f.instrument = 'fidelity'""",
    "estimates": """select t.trial_id, t.test, p.provider, cast((ceil(sec * rate) + ceil((400 + length(t.trial_id) * 7) / cpt)) * cast(pin as decimal(18,6)) + most * cast(pout as decimal(18,6)) as decimal(28,6)) as micro
  from trials t join prices p using (model_id) join (select trial_id, a.duration_s + case when pairwise then b.duration_s else 0 end as sec from trials left join clips a on a.clip_id = clip_a left join clips b on b.clip_id = clip_b) using (trial_id)""",
    "shown_clips": "select instrument, pairwise, clip_a as clip_id from trials union select instrument, pairwise, clip_b from trials where pairwise",
    "limits": "select * from (values ('m1', 95.0::double, 120000.0::double, true), ('m2', 60.0, 400000.0, false), ('m3', 200.0, 99000.0, true)) v(model_id, max_seconds, max_bytes, base64)",
    "clip_metrics": "select model_id, clip_id, 'max_seconds' as lim, max_seconds as allowed, duration_s as x from clips, limits union all select model_id, clip_id, 'max_bytes', max_bytes, cast(case when base64 then 4 * ((size_bytes + 2) // 3) else size_bytes end as double) from clips, limits",
    "media": """select model_id, instrument, lim, allowed, round(sum(x) + any_value(practised), 6) as total, string_agg(clip_id, '|' order by rn) as picked from (
    select m.model_id, s.instrument, s.pairwise, m.lim, m.allowed, m.x, m.clip_id, row_number() over (partition by m.model_id, s.instrument, m.lim order by m.x desc, m.clip_id) as rn from shown_clips s join clip_metrics m using (clip_id)
  ) join (select model_id, lim, sum(x) as practised from clip_metrics where clip_id in ('c1', 'c3') group by all) using (model_id, lim) where rn <= case when pairwise then 2 else 1 end group by model_id, instrument, lim, allowed""",
}

_SUMS = "cast(sum(c_trials) as bigint) as trials, cast(sum(c_invalid) as bigint) as invalid, cast(sum(c_refused) as bigint) as refused, cast(sum(c_failed) as bigint) as failed, cast(sum(c_fatal) as bigint) as failed_fatal, cast(sum(c_transient) as bigint) as failed_transient, cast(sum(c_exhausted) as bigint) as failed_exhausted"
_STATES = ", ".join(f"cast(count(*) filter (where state = '{s}') as bigint) as {s}" for s in ("planned", "sent", "valid", "invalid", "refused", "failed"))
_ENDED = ", ".join(f"cast(count(*) filter (where state = '{s}') as bigint) as {s}" for s in ("valid", "invalid", "refused", "failed"))
_RATE = "round(cast(count(*) filter (where state = 'invalid') as double) / nullif(count(*) filter (where state in ('valid', 'invalid')), 0), 6)"
_COST = "cast(coalesce(sum(coalesce(cost, 0)), 0) as decimal(28,4)) as cost_usd"
_COSTED = "(select t.*, c.cost from trials t left join (select trial_id, sum(coalesce(actual_usd, reserved_usd)) as cost from attempts group by trial_id) c using (trial_id))"
_PROFILES = "select i as profile, " + ", ".join(f"case when (i >> {4 - b}) & 1 = 1 then 'high' else 'low' end as {t}, 2 * ((i >> {4 - b}) & 1) - 1 as s{b}" for b, t in enumerate(TRAITS)) + " from (select unnest(range(0, 32)) as i)"
_TRAITS = ", ".join(TRAITS)
_TRIAL_COLS = "'main' as test, s.session_id, s.order_seed, s.repeat, s.agent_id, s.persona_id, s.model_id, h.instrument, h.clips, h.pair_id, h.position, concat(s.session_id, '/t', h.place + 1) as trial_id, cast(h.place + 1 as int) as trial_index"
_VARIANT = "case h.instrument when 'rate' then case s.repeat % 2 when 1 then 'first' else 'second' end when 'pick' then 'only' else case s.repeat when 1 then 'a' when 2 then 'b' else 'c' end end as prompt_variant"
_REASON = """case when k = 1 then 'not_json' when k = 2 then 'not_object' when k = 3 then 'duplicate_item' when k = 4 then 'unknown_item' when k = 5 then 'missing_item' when k in (6, 7, 8) then 'wrong_type:k' when k = 9 then 'not_json' when k = 11 then 'out_of_range:k' when n between 1 and 90 then null else 'out_of_range:k' end"""
_UNITS = """select m.model_id, c.instrument, r.repeat, c.pos, u.side,
  case when c.pairwise then (select bool_or(not t.bad and t.answer = c.expected) from ptrials t where t.model_id = m.model_id and t.repeat = r.repeat and t.instrument = c.instrument and t.clips = case u.side when 0 then concat(list_min(c.clips), '|', list_max(c.clips)) else concat(list_max(c.clips), '|', list_min(c.clips)) end)
    when len(c.clips) = 2 then (select max(case when t.clips = c.expected and not t.bad then cast(t.answer as int) end) > max(case when t.clips <> c.expected and not t.bad then cast(t.answer as int) end) from ptrials t where t.model_id = m.model_id and t.repeat = r.repeat and t.instrument = c.instrument and list_contains(c.clips, t.clips))
    else (select bool_or(not t.bad and t.answer = c.expected) from ptrials t where t.model_id = m.model_id and t.repeat = r.repeat and t.instrument = c.instrument and t.clips = c.clips[1]) end as ok
  from (select distinct model_id, repeat from ptrials) m join (select distinct model_id, repeat from ptrials) r on r.model_id = m.model_id and r.repeat = m.repeat, checks c, (values (0), (1)) u(side) where c.pairwise or u.side = 0"""

BODIES: dict[str, str] = {
    "status_rollup": f"select test, case when grouping(model_id) = 1 then '*' else model_id end as model, case when grouping(agent_id) = 1 then '*' else agent_id end as agent, {_STATES}, count(*) as trials, cast(sum(greatest(attempt - 1, 0)) as bigint) as retried, {_COST}, {_RATE} as invalid_rate from {_COSTED} group by grouping sets ((test, model_id, agent_id), (test, model_id), (test))",
    "status_zero_tests": f"select test, '*' as model, '*' as agent, count(*) as trials, case when test = 't2' then 'ceiling' end as paused, {_COST}, {_RATE} as invalid_rate from {_COSTED} group by test union all select 't9', '*', '*', 0, 'ceiling', 0, null",
    "state_counts": "select test, state, count(*) as n, case state when 'planned' then 1 when 'sent' then 2 when 'valid' then 3 when 'invalid' then 4 when 'refused' then 5 else 6 end as place from trials group by test, state",
    **{f"invalid_rates_by_{n}": f"select test, {c} as key, {_ENDED}, {_RATE} as rate from trials group by test, {c}" for n, c in (("agent", "agent_id"), ("model", "model_id"))},
    "plan_summary": "select test, count(*) as trials, count(distinct session_id) as sessions, count(distinct agent_id) as agents, count(distinct model_id) as models, count(distinct instrument) as instruments, (select count(distinct shape) = 1 from (select session_id, string_agg(concat(instrument, ':', n), ',' order by instrument) as shape from (select session_id, instrument, count(*) as n from trials u where u.test = t.test group by all) group by session_id)) as uniform from trials t group by test",
    "running_trials": "select test, count(*) as running from trials where state in ('planned', 'sent') group by test",
    "committed_spend": "select cast(sum(coalesce(actual_usd, reserved_usd)) as decimal(28,4)) as committed_usd from attempts",
    "cost_by_group": "select test, model_id, instrument, cast(sum(coalesce(actual_usd, reserved_usd)) as decimal(28,4)) as cost_usd from attempts join (select trial_id, test, model_id, instrument from trials) using (trial_id) group by all",
    "cost_footer": "select committed_usd, cast(ceiling_usd as decimal(28,4)) as ceiling_usd, cast(ceiling_usd - committed_usd as decimal(28,4)) as left_usd from (select cast(sum(coalesce(actual_usd, reserved_usd)) as decimal(28,4)) as committed_usd from attempts), (select ceiling_usd from changes order by seq desc limit 1)",
    "status_document": "select test, model, agent, concat('{', "
    + ", ".join(f"""'{"," if i else ""}"{c}":', {c}""" for i, c in enumerate((*TRIAL_STATES, "trials", "retried")))
    + f", '}}') as document from (select test, case when grouping(model_id) = 1 then '*' else model_id end as model, case when grouping(agent_id) = 1 then '*' else agent_id end as agent, {_STATES}, count(*) as trials, cast(sum(greatest(attempt - 1, 0)) as bigint) as retried from {_COSTED} group by grouping sets ((test, model_id, agent_id), (test, model_id), (test)))",
    "current_ceiling": "select ceiling_usd from changes order by seq desc limit 1",
    "ceiling_history": "select seq, ceiling_usd, lag(ceiling_usd) over (order by seq) as previous_usd from changes",
    "running_committed": "select seq, step, delta, committed from replay",
    "over_ceiling_points": f"select seq, trial_id, attempt, committed from replay where step = 0 and committed > {d.CEILING}",
    "chosen_answer": "select trial_id, attempt, seed, answer_json from answered where valid = 1 qualify row_number() over (partition by trial_id order by attempt desc) = 1",
    "exported_attempt": "select trial_id, state, exported_attempt, seed, category, answer_json from shown",
    "budget_counts": "select * from budgets",
    "settlement": "select * from open_trials",
    "resume_classes": "select o.test, case when settles_to is not null then 'settle' when o.state = 'sent' and l.handle is not null and l.valid is null and l.category is null then 'collect' else 'new_attempt' end as class, count(*) as n from open_trials o left join latest l using (trial_id) group by all",
    "attempt_seeds": "select trial_id, attempt, ('0x' || substr(sha256(concat('7:model:', trial_id, '#', attempt)), 1, 8))::bigint & 2147483647 as seed from attempts",
    "attempt_outcomes": "select category, case when category = 'refused' then 'refused' when category = 'transient' then 'retry' when valid = 1 then 'valid' else 'retry' end as outcome, count(*) as n from attempts group by all",
    "missing_attempts": "select trial_id, attempt from trials t where attempt > 0 and not exists (select 1 from attempts a where a.trial_id = t.trial_id and a.attempt = t.attempt and a.category = 'ok')",
    "next_run_number": "select cast(7 as bigint) as next_run",
    "attrition_by_persona": f"select test, persona_id, {_SUMS} from counters group by all",
    "status_by_attribute": " union all ".join(f"select test, '{a}' as attribute, {a} as value, {_SUMS}, min(number) as first from counters join personas on id = persona_id group by test, {a}" for a in d.ATTRIBUTES),
    "attrition_sidecar": " union all ".join(f"select '{dim}' as dimension, '{col}' as attribute, coalesce({expr}, '') as value, {_SUMS} from counters join personas on id = persona_id join cells using (trial_id) group by {expr}" for dim, col, expr in [("model", "model_id", "model_id"), *[("persona", a, a) for a in d.ATTRIBUTES], *[("condition", f"{f}{s}", f"{f}{s}") for f in ("brand", "type") for s in ("", "_a", "_b")], ("instrument", "instrument", "instrument")]),
    "leak_report": "select factor, metric, level, n, round(mean, 4) as mean, round(max_diff, 4) as max_diff, tolerance, coalesce(max_diff > tolerance, false) as flagged from leaks",
    "leak_flags": "select factor, metric, count(*) filter (where max_diff > tolerance) as flagged, count(*) as levels from leaks group by all",
    "blinding_pivot": "select clip_id, p_brand as brand, p_type as type from clips",
    "export_condition_cells": "select * from cells",
    "tidy_export_single": "select 1 as schema_version, agent_id, session_id, trial_index, clip_a as clip_id, segment, nation, region, model_id as model, brand, type, instrument, item, response, repeat, seed, 'default' as prompt_variant, state as status, false as excluded, 'main' as test_kind from tidy where not pairwise",
    "tidy_export_pairwise": "select 1 as schema_version, agent_id, session_id, trial_index, concat(instrument, ':', least(clip_a, clip_b), ':', greatest(clip_a, clip_b)) as pair_id, clip_a as clip_id_a, clip_b as clip_id_b, segment, nation, region, model_id as model, brand_a, brand_b, type_a, type_b, instrument, item, response, position, repeat, seed, 'default' as prompt_variant, state as status, false as excluded, 'main' as test_kind from tidy where pairwise",
    "current_results": "select run_id, run_no, model_id, agent_id, instrument, outcome, pos from complete qualify row_number() over (partition by screening_test, instrument, model_id, agent_id order by run_no desc, pos) = 1",
    "supersession": """select r.run_id, coalesce(every, false) as superseded, case when every then concat('s', last_later) end as superseded_by from runs r left join (
    select run_no, bool_and(later is not null) as every, max(later) as last_later from (
      select a.run_no, a.instrument, a.model_id, a.agent_id, (select min(b.run_no) from complete b where b.kind = a.kind and b.run_no > a.run_no and b.instrument = a.instrument and b.model_id = a.model_id and b.agent_id is not distinct from a.agent_id) as later from complete a
    ) group by run_no) k on k.run_no = r.run_no where r.status = 'complete'""",
    "latest_counting_rows": "select * from judged",
    "coverage_gaps": "select n.instrument, case when count(c.pos) = 0 then 'missing' else 'stale' end as reason from (values ('view'), ('purchase'), ('error'), ('poll')) n(instrument) left join counted c on c.instrument = n.instrument and c.agent_id is null and c.pair_checks > 0 group by n.instrument having not coalesce(bool_or(c.fresh), false)",
    "eligibility_gate": "select agent_id, persona_id, model_id, reason is null as eligible, reason, case when (found = 'fail' and reason = 'perception_fail') or (found = 'stale' and reason = 'screening_stale') or (found = 'missing' and reason = 'perception_missing') then worst_instrument end as instrument from gate",
    "exclusion_counts": "select reason, count(*) as n, case reason when 'perception_fail' then 1 when 'screening_stale' then 2 when 'perception_missing' then 3 when 'fidelity_fail' then 4 else 5 end as place from gate where reason is not null group by reason",
    "stamp_drift": "select model_id, instrument, case when r.s is null then 'not_recorded' when c.s is null then 'gone' else 'changed' end as drift from (select model_id, instrument, arg_max(settings_hash, pos) as s, arg_max(instrument_hash, pos) as i from results where agent_id is null group by all) r full join (select model_id, instrument, cur_settings as s, cur_instrument as i from settings, stamps) c using (model_id, instrument) where r.s is distinct from c.s or r.i is distinct from c.i",
    "panel_import_renumber": "select run_id, concat('s', dense_rank() over (order by run_no)) as new_run_id, model_id, agent_id, instrument, outcome from (select * from complete qualify row_number() over (partition by screening_test, instrument, model_id, agent_id order by run_no desc, pos) = 1)",
    "pairs_plan": "select instrument, clips, pair_id, position, cast(place as int) as place from shapes where pair_id is not null",
    "plan_trials_canonical": f"select {_TRIAL_COLS}, {_VARIANT} from seeded s, shapes h",
    "prompt_variant_rotation": f"select instrument, repeat, prompt_variant, count(*) as n from (select h.instrument, s.repeat, {_VARIANT} from sessions s, shapes h) group by all",
    "order_seeds": "select session_id, order_seed from seeded",
    "fractional_profiles": f"with p as ({_PROFILES}) select '1' as fraction, profile, {_TRAITS} from p union all select '1/2', profile, {_TRAITS} from p where s4 = s0 * s1 * s2 * s3 union all select '1/4', profile, {_TRAITS} from p where s3 = s0 * s1 and s4 = s0 * s2",
    "alias_chains": """with e as (select m, list_reduce([case when (m >> b) & 1 = 1 then substr('OCEAN', b + 1, 1) else '' end for b in range(0, 5)], lambda x, y: x || y) as name, bit_count(m) as o, list_reduce([case when (m >> b) & 1 = 1 then '0' else '1' end for b in range(0, 5)], lambda x, y: x || y) as k from (select unnest(range(1, 32)) as m)),
  g as (select * from (values ('1/2', 0), ('1/2', 31), ('1/4', 0), ('1/4', 11), ('1/4', 21), ('1/4', 30)) v(fraction, w)), c as (select fraction, e.m, e.name, e.o, e.k, (select min(xor(e.m, h.w)) from g h where h.fraction = f.fraction) as chain from e, (select distinct fraction from g) f where not exists (select 1 from g h where h.fraction = f.fraction and h.w = e.m))
  select fraction, string_agg(name, '=' order by o, k) as alias, count(*) as effects from c group by fraction, chain""",
    "quota_level_gaps": "select b.region as nars, 'age_band' as attribute, n.nation as level from (select distinct region from personas) b, (select distinct nation from personas) n where not exists (select 1 from personas p where p.region = b.region and p.nation = n.nation)",
    "perception_shapes": "select instrument, clips, pair_id, position, min(pos) as first_check from (select instrument, list_min(clips) || '|' || list_max(clips) as clips, instrument || ':' || list_min(clips) || ':' || list_max(clips) as pair_id, 1 as position, pos from checks where pairwise union all select instrument, list_max(clips) || '|' || list_min(clips), instrument || ':' || list_min(clips) || ':' || list_max(clips), 2, pos from checks where pairwise union all select instrument, unnest(clips), null, null, pos from checks where not pairwise) group by all",
    "perception_scores": f"select model_id, instrument, count(*) filter (where ok) as passed, count(*) as units, round(count(*) filter (where ok) / count(*), 6) as ratio, case when count(*) filter (where ok) / count(*) >= 0.75 then 'pass' else 'fail' end as outcome from ({_UNITS}) group by model_id, instrument",
    "pair_check_counts": "select instrument, count(*) filter (where len(clips) = 2) as n_pair_checks, min(pos) as first from checks group by instrument",
    "fidelity_scores": "select agent_id, count(*) filter (where not short and fits) as matched, count(*) as total, round(count(*) filter (where not short and fits) / count(*), 6) as ratio, count(*) filter (where short) as insufficient, case when count(*) filter (where not short and fits) / count(*) >= 0.8 then 'pass' else 'fail' end as outcome from (select *, 2 * n < case when construct = 'openness' then 40 else 4 end as short, coalesce(case when pole = 'high' then score > 3 else score < 3 end, false) as fits from construct_scores) group by agent_id",
    "fidelity_constructs": "select agent_id, construct, pole, n, round(score, 6) as score, case when n > 0 then 3.0::double end as midpoint, coalesce(case when pole = 'high' then score > 3 else score < 3 end, false) as matches from construct_scores",
    "validate_reasons": f"select id, {_REASON} as problem, case when ({_REASON}) is null then cast(n as varchar) end as answer from raws union all select concat('c', conv_id, '-', turn), 'not_json', null from conversations",
    "invalid_reason_counts": f"select problem, count(*) as n from (select coalesce({_REASON}, 'valid') as problem from raws union all select 'not_json' from conversations) group by problem",
    "answer_key_set_check": "select instrument, count(*) as fits, count(*) as answers from answered join (select trial_id, instrument from trials) using (trial_id) where valid = 1 group by instrument",
    "reissue_mismatches": "select trial_id, attempt, case when category = 'transient' then 'request_without_attempt' when seed % 20 = 1 then 'sent_without_request' when seed % 20 = 5 then 'requests_differ' when seed % 20 = 2 then 'hash_differs' when seed % 20 = 3 then 'seed_differs' else 'model_differs' end as reason from attempts where category = 'transient' and seed % 20 <> 1 or category <> 'transient' and seed % 20 in (1, 2, 3, 4, 5)",
    "archive_last_line_wins": """select concat('o', event_id % 700) as trial_id, cast(event_id % 2 as int) as attempt, event_id as line_no, case k when 1 then props || ' extra' when 2 then '[' || props || ']' when 3 then '{"k": 1, "k": 2}' when 4 then '{"k": 1, "z": 2}' when 5 then '{}' when 6 then '{"k": "1"}' when 7 then '{"k": 4.0}' when 8 then '{"k": true}' when 9 then '{"k": NaN}' when 10 then '```json' || chr(10) || props || chr(10) || '```' when 11 then '{"k": 0}' else props end as raw from raws qualify row_number() over (partition by event_id % 700, event_id % 2 order by event_id desc) = 1""",
    "cost_estimate": "select test, cast(sum(micro) / 1000000 as decimal(28,9)) as expected, cast(sum(micro) * 6 / 1000000 as decimal(28,9)) as worst_case, count(*) as trials, string_agg(distinct provider, ',' order by provider) as providers from estimates group by test",
    "actual_cost": "select model_id, category, cast(sum((800 + seed) * cast(pin as decimal(18,6)) + 100 * cast(pout as decimal(18,6))) filter (where category = 'ok') / 1000000 as decimal(28,9)) as cost_usd, count(*) filter (where category = 'ok') as known, count(*) as attempts from attempts join (select trial_id, model_id from trials) using (trial_id) join prices using (model_id) group by all",
    "media_worst_case": "select model_id, instrument, lim as \"limit\", allowed, total, picked, total > allowed as exceeds from media",
    "media_violations": "select model_id, count(*) as violations from media where total > allowed group by model_id",
    "clip_kind_overlap": "select clip_id, string_agg(test, ',' order by test) as tests, count(distinct kind) as kinds from (select distinct test, clip_id from (select test, clip_a as clip_id from trials union select test, clip_b from trials where pairwise)) join (values ('t1', 'pilot'), ('t2', 'main'), ('t4', 'main')) v(test, kind) using (test) group by clip_id having count(distinct kind) > 1",
    "unknown_references": "select clip_id, count(*) as uses from (select clip_a as clip_id from trials union all select clip_b from trials where pairwise) where clip_id not in (select clip_id from clips where duration_s > 10) group by clip_id",
    "duplicate_detection": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "first_seen_order": "select test, instrument, min(trial_index) as first from trials group by all",
    "natural_sort_rank": "select concat('p', p, '-m', m) as agent_id, cast(row_number() over (order by p, m) as int) as rank from (select unnest(range(1, 41)) as p), (values (1), (2), (3)) v(m)",
    "usd_texts": "select regexp_replace(regexp_replace(cast(cast(coalesce(actual_usd, reserved_usd) as decimal(18,4)) as varchar), '0+$', ''), '\\.$', '') as usd, count(*) as n from attempts group by 1",
    "run_numbers": "select run_id as name, cast(run_no as bigint) as n from runs union all select distinct test, cast(0 as bigint) from trials",
    "likert_from_latent": "select least(5, cast(floor((event_id * 37 % 101) / 101.0 * 5) as int) + 1) as points, count(*) as n from events group by 1",
    "worst_clips": "select width, cast(row_number() over (partition by width order by duration_s desc, clip_id) as int) as rank, clip_id, duration_s from clips qualify rank <= 3",
    "request_digests": """select test, session_id, sha256(string_agg(concat('{"i":"', instrument, '","t":"', trial_id, '"}'), '' order by trial_index)) as digest from trials group by all""",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _request_views() -> None:
    """The constant parts of requests, put together by a plain loop per instrument."""
    import hashlib

    ref = lambda c: {"clip_id": c, "sha256": hashlib.sha256(c.encode()).hexdigest()}
    media = lambda c, role: f"media|{c}|{ref(c)['sha256']}|{role}"
    rows = []
    for name in dict.fromkeys(i[0] for i in d.ITEMS):
        before, used, shown = [], [], []
        for _, pos, clips, answer in [e for e in d.EXAMPLES if e[0] == name][:2]:
            labels = ["text|Video A:", "text|Video B:"] if len(clips) == 2 else [None]
            before.append(f"text|Practice example {pos + 1}:")
            for label, clip in zip(labels, clips):
                before += [label] if label else []
                before.append(media(clip, "practice"))
            before.append("text|Intended answer: " + canonical(json.loads(answer)))
            used.append({"answer": json.loads(answer), "clips": [ref(c) for c in clips]})
            shown += [c for c in clips if c not in shown]
        items, schema = canonical(d.request_items(name)), canonical(d.answer_schema(name))
        cells = [name, "".join("\n" + x for x in before), items, canonical(used), schema, f"\ntext|Items: {items}\ntext|Response schema: {schema}", "|".join(shown)]
        rows.append("(" + ", ".join([*map(_quoted, cells), str(len(before))]) + ")")
    VIEWS["forms"] = "select * from (values " + ", ".join(rows) + ") v(instrument, before, items, used, schema, after, shown, n_before)"
    VIEWS["asked"] = """select t.*, f.*, concat('You live in ', p.nation, '.', chr(10), 'You buy ', p.segment, '.') as card, case when x.clip_id is null or (t.pairwise and y.clip_id is null) then 'unknown_clip' end as problem
  from trials t join forms f using (instrument) join personas p on p.id = t.persona_id left join clips x on x.clip_id = clip_a left join clips y on y.clip_id = clip_b"""


_request_views()
_REF = """concat('{{"clip_id":"', {0}, '","sha256":"', sha256({0}), '"}}')"""
_TEXT = _quoted(canonical(d.INSTRUCTIONS))
BODIES |= {
    "rendered_requests": f"""select trial_id, problem, case when problem is null then sha256(concat('{{"clips":[', {_REF.format('clip_a')}, case when pairwise then concat(',', {_REF.format('clip_b')}) end, '],"instructions":', {_TEXT}, ',"items":', items, ',"persona_card":"', replace(card, chr(10), '\\n'),
  '","practice":', used, ',"prompt":"Answer ', instrument, '.","response_schema":', schema, '}}')) end as request_sha256,
  case when problem is null then array_to_string(list_concat(case when shown = '' then [] else string_split(shown, '|') end, list_filter(case when pairwise then [clip_a, clip_b] else [clip_a] end, lambda x: not list_contains(string_split(shown, '|'), x))), '|') end as clips from asked""",
    "prompt_parts": f"""select trial_id, case when problem is null then cast(2 + n_before + case when pairwise then 4 else 2 end + 3 as int) end as n_parts, case when problem is null then sha256(concat('text|', card, chr(10), 'text|', {_quoted(d.INSTRUCTIONS)}, before,
  case when pairwise then concat(chr(10), 'text|Video A:', chr(10), 'media|', clip_a, '|', sha256(clip_a), '|target', chr(10), 'text|Video B:', chr(10), 'media|', clip_b, '|', sha256(clip_b), '|target')
  else concat(chr(10), 'text|Video to rate:', chr(10), 'media|', clip_a, '|', sha256(clip_a), '|target') end, chr(10), 'text|Answer ', instrument, '.', after)) end as prompt_sha256 from asked""",
    "practice_chosen": "select instrument, cast(pos + 1 as int) as n, clips from (values " + ", ".join(f"('{i}', {p}, '{'|'.join(c)}')" for i, p, c, _ in d.EXAMPLES) + ") v(instrument, pos, clips) where pos < 2",
    "usage_totals": """select sum(seed + 103)::bigint as a_input_tokens, sum(seed + case when valid = 1 then seed % 7 else 0 end)::bigint as a_output_tokens, sum(seed)::bigint as a_text_tokens, sum(2 * seed + 1)::bigint as a_video_tokens, sum(0)::bigint as a_audio_tokens, sum(case when valid = 1 then seed % 7 else 0 end)::bigint as a_thoughts_tokens,
  sum(seed + 50)::bigint as b_input_tokens, sum(seed)::bigint as b_output_tokens, sum(5)::bigint as b_text_tokens, sum(case when valid = 1 then seed end)::bigint as b_video_tokens, cast(null as bigint) as b_audio_tokens, cast(null as bigint) as b_reasoning_tokens, count(*) as reports from attempts where category <> 'transient'""",
    "error_codes": "select concat('ratelimit', category) as code, count(*) as n from attempts group by all",
    "attempts_from_events": "select trial_id, attempt, sent_at, handle, category, valid = 1 as valid from attempts",
    "states_from_events": "select trial_id, coalesce(min_by(case when valid = 1 then 'valid' when valid = 0 then 'invalid' else 'refused' end, attempt) filter (where category <> 'transient'), 'sent') as state from attempts group by trial_id",
    "ledger_from_events": "select trial_id, attempt, cast(reserved_usd as decimal(28,4)) as reserved_usd, cast(case when category = 'refused' then 0 else actual_usd end as decimal(28,4)) as actual_usd from attempts",
    "tests_with_clips": """select name, kind, coalesce(string_agg(concat(role, ':', clip_id), '|' order by role desc, clip_id) filter (where clip_id is not null), '') as clips from (values """ + ", ".join(map(str, d.TESTS)) + """) v(name, kind)
  left join (select distinct * from (select test, 'target' as role, clip_a as clip_id from trials union all select test, 'target', clip_b from trials where pairwise union all select test, 'practice', 'c1' from trials)) on test = name group by all""",
    "gate_decisions": """select coalesce(s.test, x.test) as test, coalesce(stamped, 0) as stamped, coalesce(excluded, 0) as excluded, coalesce(unstamped, 0) as unstamped from (select test, count(distinct (model_id, instrument)) as stamped from trials where state = 'valid' group by test) s
  full join (select test, count(*) as excluded, count(*) filter (where not exists (select 1 from trials v where v.state = 'valid' and v.test = l.test and v.model_id = l.model_id and v.instrument = l.instrument)) as unstamped from (select distinct test, agent_id, model_id, instrument from trials where state = 'failed') l group by test) x on x.test = s.test""",
    "needed_instruments": "select instrument, string_agg(distinct test, '|' order by test) as tests from trials where test in ('t1', 't2', 't4') and instrument not in ('5-LOW', '3-MEDIUM') group by instrument",
}


def _answer_schema(instrument: str) -> str:
    form = {"likert": lambda i: {"type": "integer", "minimum": 1, "maximum": i[3]}, "pairwise": lambda i: {"type": "string", "enum": i[4]}, "free_text": lambda i: {"type": "string", "minLength": 1}}
    of = [i for i in d.ITEMS if i[0] == instrument]
    return canonical({"type": "object", "properties": {i[1]: form[i[2]](i) for i in of}, "required": [i[1] for i in of], "additionalProperties": False})


VIEWS |= {
    "listed": "select distinct concat('u', o_custkey) as test, o_orderpriority as instrument, cast(substr(o_orderpriority, 1, 1) as int) as pos from orders where o_orderstatus = 'P'",
    "targets": "select distinct concat('u', o_custkey) as test, concat('c', o_orderkey % 30) as clip_id from orders where o_orderstatus = 'F'",
    "practice": """select concat('u', o_custkey) as test, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, o_orderpriority as instrument, concat('c', 25 + o_orderkey % 7) as one,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then concat('c', 27 + o_orderkey % 4) end as two from orders where o_orderstatus = 'O'""",
    "pictured": """select concat('k', user_id) as test, event_id as pos, event_type as instrument, case when event_id % 9 = 0 then 't' else 'v' end as item, concat('c', 1 + event_id % 4) as a, case when value >= 40 then concat('c', 1 + (event_id + 1) % 5) end as b,
  case when value < 40 then cast(1 + event_id % 6 as varchar) when event_id % 5 = 0 then 'c9' else concat('c', 1 + event_id % 4) end as expected, value < 40 and event_id % 7 <> 0 as number from events""",
    "settled": """select *, case when instrument not in ('view', 'click', 'signup', 'purchase') then 'unknown_instrument' when item = 't' and instrument <> 'signup' then 'unknown_item' when b = 'c5' then 'unknown_clip'
  when instrument = 'click' and b is null then 'needs_two_clips' when b is not null and expected = 'c9' then 'expected_not_shown' when b is not null and instrument = 'click' then null
  when b is not null and (instrument = 'purchase' or item = 't') then 'needs_likert' when b is not null and instrument = 'signup' then 'too_few_points' when b is not null then null
  when instrument = 'purchase' then 'free_text' when item = 't' or not number or cast(expected as int) > case instrument when 'view' then 5 else 2 end then 'bad_expected' end as own,
  concat(case when b is null or a < b then a else b end, '|', case when b is null or a = b then '' when a < b then b else a end) as shown from pictured""",
    "worded": "select concat('p', p_partkey) as id, case when p_size = 1 then '' else concat(case when p_size > 40 then 'HIGH' when p_size > 20 then 'low-lying' when p_size > 10 then 'Agreeable' when p_size > 5 then 'slow' else '' end, ' ', p_name) end as text from part union all select concat('c', conv_id, '-', turn), text from conversations",
}
_LABEL = r"(?i)\b(openness|conscientiousness|extraversion|agreeableness|neuroticism|agreeab\w*|conscientious\w*|neurotic\w*|extr[ao]ver\w*|introver\w*|open-minded\w*|high|low|nars)\b"
_PLAIN = "coalesce(regexp_replace(cast(cast(round({0}, 4) as decimal(38,4)) as varchar), '(\\.[0-9]+?)0+$', '\\1'), '')"
BODIES |= {
    "plan_problems": """select concat('u', c_custkey) as test, p.code, p.detail from customer left join (
    select test, arg_min(code, (rule, pos)) as code, arg_min(detail, (rule, pos)) as detail from (
      select test, 0 as rule, pos, 'unknown_instrument' as code, instrument as detail from listed where instrument = '4-NOT SPECIFIED'
      union all select concat('u', c_custkey), 1, 0, 'bad_pairing', 'no target clip' from customer where concat('u', c_custkey) not in (select test from targets)
      union all select test, 2, pos, 'bad_pairing', concat(instrument, ' needs two target clips') from listed l where instrument in ('1-URGENT', '2-HIGH') and (select count(*) from targets t where t.test = l.test) < 2
      union all select test, 3, 2 * pos, 'bad_practice', concat('practice[', pos, '] lists a clip twice') from practice where one = two
      union all select test, 3, 2 * pos + 1, 'bad_practice', concat('practice[', pos, '] has the target ', case when (test, one) in (select (test, clip_id) from targets) then one else two end) from practice where (test, one) in (select (test, clip_id) from targets) or (test, two) in (select (test, clip_id) from targets)
      union all select test, 4, pos, 'bad_practice', concat(instrument, ' has 0 of 1 examples') from listed l where instrument <> '4-NOT SPECIFIED' and not exists (select 1 from practice p where p.test = l.test and p.instrument = l.instrument)
    ) group by test) p on p.test = concat('u', c_custkey)""",
    "check_problems": """select s.test, s.pos, coalesce(s.own, case when f.pos < s.pos then case when f.expected = s.expected and f.number = s.number then 'duplicates' else 'contradicts' end end) as problem, case when s.own is null and f.pos < s.pos then f.pos end as first
  from settled s join (select * from settled qualify row_number() over (partition by test, instrument, item, shown order by pos) = 1) f on f.test = s.test and f.instrument = s.instrument and f.item = s.item and f.shown = s.shown""",
    "answer_schemas": "select * from (values " + ", ".join(f"({_quoted(i)}, {_quoted(_answer_schema(i))})" for i in dict.fromkeys(i[0] for i in d.ITEMS)) + ") v(instrument, schema)",
    "stale_summary": " union all ".join(f"select '{what}' as what, {name} as name, count(*) as n, min(concat_ws('|', model_id, instrument, agent_id)) as first from judged where outcome = 'stale' and {what}_changed group by {name}".replace("model_changed", "settings_changed") for what, name in (("model", "model_id"), ("instrument", "instrument"))),
    "shared_items": "select 'v' as item_id",
    "kept_agents": "select session_id, agent_id, order_seed from seeded where agent_id in (select agent_id from results where outcome = 'pass')",
    "flat_personas": "select id, " + ", ".join(f"case when (number >> {i}) & 1 = 1 then 'high' else 'low' end as {c}" for i, c in enumerate(d.CONSTRUCTS)) + ", case when region = 'ASIA' then '' else 'low' end as nars, nation as age_band, segment as gender, region as cultural_region, 'some' as robot_experience from (select *, cast(substr(id, 2) as bigint) as \"number\" from (select id, segment, nation, region from personas))",
    "sentence_problems": f"select id, case when text = '' then 'empty' when regexp_matches(text, '^\\s|\\s$|[\\n\\r]') then 'not_one_line' when regexp_matches(text, '{_LABEL}') then concat('label:', lower(regexp_extract(text, '{_LABEL}', 1))) end as problem from worded",
    "leak_texts": f"select factor, metric, level, {_PLAIN.format('mean')} as mean, {_PLAIN.format('max_diff')} as max_diff from leaks",
    "utc_texts": "select event_id, strftime(make_timestamp(event_id * 99991007 * 1000), '%Y-%m-%dT%H:%M:%SZ') as at, strftime(make_timestamp(event_id * 99991007 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as at_ms from events",
    "screen_summary": "select model_id, count(*) filter (where outcome = 'pass') as passed, count(*) filter (where outcome = 'fail') as failed, count(*) filter (where pair_checks = 0) as insufficient from results group by model_id",
    "canonical_stamps": """select event_id, sha256(concat('{"k":', n, '}')) as sha256 from raws""",
    "name_problems": """select distinct name, case when length(name) > 64 then 'too_long' when not regexp_full_match(name, '[a-z0-9][a-z0-9_-]*') then 'bad_characters' when regexp_full_match(name, 's[1-9][0-9]*') then 'reserved_run_id' when name like '%-attrition' then 'reserved_suffix' end as problem
  from (select p_brand as name from part union select p_name from part union select replace(p_name, ' ', '-') from part union select concat('s', p_size) from part union select concat('t', p_size, '-attrition') from part)""",
    "condition_pairs": "select p_partkey, case when p_size > 3 then 'brand' || case when p_size >= 45 then ' :' || p_brand else '' end end as factor, case when p_size <= 3 then null when p_size < 45 then concat(p_brand, '= x') else 'x' end as level from part",
    "retry_delays": "select trial_id, attempt, round(least(30.0::double, 2.0::double * power(2, attempt - 1)) * (0.5 + (seed % 8) / 8.0::double / 2), 6) as wait_s from attempts",
    "price_texts": "select p_partkey, true as plain, regexp_replace(cast(p_retailprice as varchar), '\\.0$', '') as usd from part",
    "frame_rates": "select p_partkey, case when p_size <= 40 then round(p_size * 1000 / 1001.0::double, 6) end as fps from part",
}


def _phrase(column: str, phrases: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in phrases.items()) + " end"


VIEWS["people"] = "select *, cast(substr(id, 2) as bigint) as pnum from (select id, segment, nation, region from personas)"
_LINES = ", chr(10), ".join(f"case when (pnum >> {i}) & 1 = 1 then 'Much of sentence {i}.' else 'Little of sentence {i}.' end" for i in range(len(d.CONSTRUCTS)))
BODIES |= {
    "card_texts": f"select id, concat('You come from ', {_phrase('region', d._PLACES)}, ' and ', {_phrase('segment', d._TRADES)}, '; you are grown, you have met robots.', chr(10), {_LINES}, case when region <> 'ASIA' then concat(chr(10), 'Robots are fine.') end, chr(10)) as card from people",
    "card_cues": " union all ".join(f"select id, '{c}' as construct, case when (pnum >> {i}) & 1 = 1 then 'high' else 'low' end as pole from people" for i, c in enumerate(d.CONSTRUCTS)),
    "session_ranks": "select session_id, cast(row_number() over (order by cast(n[1] as int), cast(n[2] as int), cast(n[3] as int), cast(n[4] as int)) as int) as rank from (select session_id, regexp_extract_all(session_id, '[0-9]+') as n from (select distinct session_id from trials))",
}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: _quoted(x) if isinstance(x, str) else str(x)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


#: Fault of a document by the remainder of its number, what is said of it, and the order of several.
_TEST_FAULTS = [
    (1, 0, "kind", "field required"), (2, 0, "kind", "input should be 'pilot', 'screening' or 'main'"), (3, 0, "instruments", "list should have at least 1 item after validation, not 0"), (4, 0, "instruments", "duplicate instrument 'a'"),
    (5, 0, "clips", "duplicate clip 'c_aaaaaaaa'"), (6, 0, "session.repeats", "input should be greater than or equal to 1"), (6, 1, "session.pairing", "input should be 'all_pairs'"), (7, 0, "session.repeats", "input should be a valid integer"),
    (7, 1, "session.max_retries", "input should be a valid integer"), (8, 0, "clips.1", "input should be a valid string"), (8, 1, "clips.2", "string should match pattern '^c_[a-z2-7]{8}$'"), (9, 0, "models", "must list at least one model id, or be omitted for all"),
    (10, 0, "colour", "extra inputs are not permitted"), (11, 0, "schema_version", "input should be 1"), (11, 1, "test", "string should match pattern '^[A-Za-z0-9][A-Za-z0-9_-]*$'"),
]
_PRICE_FAULTS = [
    (1, 0, "models.m1.input_usd_per_mtok", 'must be a non-negative decimal string, for example "0.30"'), (2, 0, "models.x1", "string should match pattern '^m[1-9][0-9]*$'"),
    (3, 0, "models.m1.chars_per_token", 'must be a decimal string greater than 0, for example "4"'), (4, 0, "models", "field required"),
]
VIEWS["faults"] = f"select concat('u', c_custkey) as doc_id, field, reason, n from customer join {_values(_TEST_FAULTS, 'k, n, field, reason')} on c_custkey % 13 = k union all select concat('s', s_suppkey), field, reason, n from supplier join {_values(_PRICE_FAULTS, 'k, n, field, reason')} on s_suppkey % 5 = k"
VIEWS["lines"] = r"""select category, case when category = 'transient' then text[:30] else text end as line from (select category, concat('{"trial_id":"', trial_id, '","attempt":', case when category = 'refused' then 'null' else cast(attempt as varchar) end, ',"raw":"line\\nof ', category, '"}') as text from attempts)"""
_FORMS = {"tie": "k / 32", "third": "p_retailprice / 3", "near": "k + 0.00005::double", "small": "-k * 1e-7::double", "cents": "k * 0.0125::double", "large": "p_retailprice * 1e9::double / 7", "huge": "p_retailprice * 1e19::double", "wide": "(k + 0.3::double) * 1e11::double"}
#: Digits of the binary value, half to even, then the shortest text of what they stand for.
_FOUR = "coalesce(cast(cast(printf('%.4f', {0}) as double) as varchar), '')"
VIEWS["asked_ceilings"] = """select concat('n', c_nationkey) as study, o_orderkey as seq, o_orderpriority in ('1-URGENT', '2-HIGH') or (o_orderpriority = '3-MEDIUM' and c_acctbal < 0) as own,
  case o_orderpriority when '1-URGENT' then cast(round(o_totalprice * 100) as bigint) when '2-HIGH' then (o_orderkey % 4) * 10000000 end as amount,
  (cast(round(o_totalprice * 100) as bigint) + 1) // 2 as expected, abs(cast(round(c_acctbal * 100) as bigint)) * 9 as committed, o_orderstatus <> 'P' as fresh, o_orderstatus = 'O' as uncapped from orders join customer on c_custkey = o_custkey"""
VIEWS["judged_ceilings"] = "select *, case when own then case when amount is null or amount <= 0 then 'invalid_ceiling' when committed > amount or (fresh and committed + expected > amount) then 'over_ceiling' else 'accepted' end end as mine from asked_ceilings"
VIEWS["held_ceilings"] = "select *, (select arg_max(b.amount, b.seq) from judged_ceilings b where b.study = a.study and b.seq < a.seq and b.mine = 'accepted') as held from judged_ceilings a"
_CENTS = "cast({0} / 100 as decimal(28,4))"
VIEWS["pushed"] = """select o_orderkey as pos, concat('u', o_custkey, case when o_orderpriority = '5-LOW' then '-attrition' else '' end) as name, case when o_orderstatus = 'F' then 'main' else 'pilot' end as kind, sha256(concat(o_custkey, '/', o_orderpriority)) as sha, concat('c', 1 + o_orderkey % 500) as target, concat('c', 1 + o_orderkey % 230) as example, o_orderpriority = '5-LOW' as misnamed from orders"""
VIEWS["known_tests"] = "select concat('u', c_custkey) as name, case when c_mktsegment = 'BUILDING' then 'main' else 'pilot' end as kind, sha256(concat(c_custkey, '/1-URGENT')) as was, case when c_mktsegment <> 'MACHINERY' then sha256(concat(c_custkey, '/', case when c_mktsegment = 'FURNITURE' then 'edited' else '1-URGENT' end)) end as file, concat('c', 1 + c_custkey % 400) as clip, c_nationkey < 5 as aims from customer where c_acctbal > 0"
VIEWS["faulty"] = """select p.*, k.was, k.file, case when misnamed then 'bad_test_name' when target not in (select clip_id from clips) then 'unknown_clip' when example not in (select clip_id from clips) then 'bad_practice'
    when exists (select 1 from known_tests h where h.aims and h.clip = p.target and (h.kind = 'main') <> (p.kind = 'main') and h.name <> p.name) then 'clip_kind_overlap' end as fault from pushed p left join known_tests k on k.name = p.name"""
VIEWS["pushes_judged"] = """select pos, name, kind, sha, case when was = sha and file = sha and coalesce(fault, '') <> 'bad_test_name' then 'same' when fault is not null or was is not null then 'refused' when earlier is null then 'new' when earlier = sha then 'same' else 'refused' end as outcome,
  case when was = sha and file = sha and coalesce(fault, '') <> 'bad_test_name' then null when fault = 'bad_test_name' then fault when was is not null then 'test_exists' when fault is not null then fault when earlier <> sha then 'test_exists' end as code
  from (select *, case when fault is null then first_value(sha) over (partition by name, fault is null order by pos rows between unbounded preceding and 1 preceding) end as earlier from faulty)"""
VIEWS["blinding_pushed"] = "select clip_id, b.factor, case when b.factor = 'brand' and p_size < 10 then concat('size', p_size) else level end as level from blinding b join part on concat('c', p_partkey) = clip_id"
VIEWS["pushed_leak_values"] = VIEWS["leak_values"].replace("from blinding b", "from blinding_pushed b")
VIEWS["pushed_leak_levels"] = VIEWS["leak_levels"].replace("leak_values", "pushed_leak_values")
VIEWS["pushed_leaks"] = VIEWS["leaks"].replace("leak_levels", "pushed_leak_levels")
VIEWS["request_texts"] = f"""select trial_id, test, persona_id, model_id, repeat, trial_index, problem, case when problem is null then concat('{{"clips":[', {_REF.format('clip_a')}, case when pairwise then concat(',', {_REF.format('clip_b')}) end, '],"instructions":', {_TEXT}, ',"items":', items, ',"persona_card":"', replace(card, chr(10), '\\n'),
  '","practice":', used, ',"prompt":"Answer ', instrument, '.","response_schema":', schema, '}}') end as request from asked"""
VIEWS["digests"] = "select test, count(*) as requests, sha256(string_agg(request, '' order by cast(substr(persona_id, 2) as bigint), model_id, repeat, trial_index, trial_id)) as requests_sha256 from request_texts where request is not null group by test"
_USD = "regexp_replace(regexp_replace(cast(cast({0} as decimal(28,4)) as varchar), '0+$', ''), '\\.$', '')"
VIEWS["paused"] = _values([(n, "ceiling") if k == "pilot" else (n, None) for n, k in d.TESTS], "name, reason").replace("None", "null")
VIEWS["paused"] = f"select name, reason from {VIEWS['paused']}"
_COUNTERS = ("planned", "sent", "valid", "invalid", "refused", "failed", "trials", "retried")
VIEWS["rolled"] = f"""select test, case when grouping(model_id) = 1 then '*' else model_id end as model, case when grouping(agent_id) = 1 then '*' else agent_id end as agent, {_STATES}, count(*) as trials, cast(sum(greatest(attempt - 1, 0)) as bigint) as retried, {_COST}, cast(count(*) filter (where state = 'invalid') as double) / nullif(count(*) filter (where state in ('valid', 'invalid')), 0) as rate
  from {_COSTED} group by grouping sets ((test, model_id, agent_id), (test, model_id), (test))
  union all select name, '*', '*', 0, 0, 0, 0, 0, 0, 0, 0, 0, null from paused where name not in (select test from trials)"""
VIEWS["report_rows"] = (
    "select test, [cast(substr(test, 2) as bigint), case when model = '*' then -1 else cast(substr(model, 2) as bigint) end, case when agent = '*' then -1 else cast(regexp_extract(agent, '[0-9]+') as bigint) end] as place, concat('{\"test\":\"', test, '\",\"model\":\"', model, '\",\"agent\":\"', agent, '\"', "
    + ", ".join(f"""',"{c}":', {c}""" for c in _COUNTERS)
    + f""", ',"invalid_rate":', coalesce(cast(rate as varchar), 'null'), ',"cost_usd":"', {_USD.format('cost_usd')}, '","paused":', case when model = '*' and reason is not null then concat('"', reason, '"') else 'null' end, '}}') as j from rolled join paused on name = test"""
)
_TALLIED = ("trials", "invalid", "refused", "failed", "failed_fatal", "failed_transient", "failed_exhausted")
VIEWS["tally_values"] = " union all ".join(f"select test, {i} as place, '{a}' as attribute, {a} as value, {_SUMS}, min(number) as first from counters join personas on id = persona_id group by test, {a}" for i, a in enumerate(d.ATTRIBUTES))
VIEWS["tally_texts"] = "select test, attribute, string_agg(concat('\"', value, '\":{', " + ", ".join(f"""'{"," if i else ""}"{c}":', {c}""" for i, c in enumerate(_TALLIED)) + ", '}'), ',' order by first, value) as t from tally_values group by test, attribute"
VIEWS["tallies"] = f"select name as test, concat('\"', name, '\":{{', string_agg(concat('\"persona_', a, '\":{{', coalesce(t, ''), '}}'), ',' order by place), '}}') as t from paused, {_values(list(enumerate(d.ATTRIBUTES)), 'place, a')} left join tally_texts on test = name and attribute = a group by name"
VIEWS["report_footer"] = f"""select concat(',"committed":"', {_USD.format('(select sum(coalesce(actual_usd, reserved_usd)) from attempts)')}, '","ceiling":"', {_USD.format('(select ceiling_usd from changes order by seq desc limit 1)')}, '","state":"paused","paused":[', (select string_agg(concat('{{"test":"', name, '","reason":"', reason, '"}}'), ',' order by name) from paused where reason is not null), '],"by_persona_attribute":{{') as f"""
VIEWS["reports"] = """select test, concat('{"schema_version":1,"test":"', test, '","rows":[', string_agg(j, ',' order by place), ']', any_value(f), any_value(t), '}}') as document from report_rows join tallies using (test), report_footer group by test
  union all select null, concat('{"schema_version":1,"test":null,"rows":[', string_agg(j, ',' order by place), ']', any_value(f), (select string_agg(t, ',' order by test) from tallies), '}}') from report_rows, report_footer"""
VIEWS["ptrials_of"] = "select concat('s', substr(persona_id, 2)) as run_id, trial_id, agent_id, persona_id, model_id, case when instrument in ('4-NOT SPECIFIED', '5-LOW') then 'bands' else 'self' end as form, state from trials"
VIEWS["ended"] = "select * from ptrials_of where run_id in (select run_id from ptrials_of group by run_id having bool_and(state not in ('planned', 'sent')))"
VIEWS["self_keys"] = "select * from " + _values([(f, i, int(i[1:]), c, r, p) for f, i, c, r, _, p in d.SELF_KEYS], "form, item_id, n, construct, turned, points")
VIEWS["self_values"] = """select e.run_id, e.agent_id, k.construct, case when k.turned then k.points + 1 - v else v end as value from (select t.*, k.*, (a.seed + k.n * 3) % 7 as v from ended t join (select trial_id, arg_max(seed, attempt) as seed from attempts where valid = 1 group by trial_id) a using (trial_id) join self_keys k using (form) where t.state = 'valid') e join self_keys k using (item_id) where v between 1 and k.points"""
VIEWS["self_checks"] = """select a.run_id, a.agent_id, p.construct, p.pole, coalesce(x.expected, 0) as expected, coalesce(m.n, 0) as n, m.score
  from (select distinct run_id, agent_id, persona_id from ended) a
  join (select id, construct, case when (pnum >> bit) & 1 = 1 then 'high' else 'low' end as pole from people, """ + _values(list(enumerate(d.CONSTRUCTS)), "bit, construct") + """ union all select id, 'nars', 'low' from people where region <> 'ASIA') p on p.id = a.persona_id
  left join (select run_id, agent_id, construct, count(*) as expected from ended join self_keys using (form) group by all) x on x.agent_id = a.agent_id and x.run_id = a.run_id and x.construct = p.construct
  left join (select run_id, agent_id, construct, count(*) as n, avg(value) as score from self_values group by all) m on m.agent_id = a.agent_id and m.run_id = a.run_id and m.construct = p.construct"""
VIEWS["wanted_names"] = "select concat(p_brand, '/', p_type) as study, replace(p_name, ' ', '_') as name, min(p_partkey) as pos from part group by 1, 2"
VIEWS["own_names"] = "select concat(p_brand, '/', p_type) as study, replace(p_name, ' ', '_') as name, max(p_size) > 48 as renamed from part where p_size > 40 group by 1, 2"
VIEWS["shared_names"] = "select replace(p_name, ' ', '_') as name, max(p_size) > 1 as renamed from part where p_size < 3 and p_type = 'STANDARD' group by 1"
VIEWS["questions"] = "select p_name as instrument, p_partkey as pos, p_size, concat('q', p_size, '_', p_partkey) as item_id, case when p_size = 13 then 'openness' when p_size <> 17 then 'nars' end as construct, coalesce(p_size > 25 and p_size % 5 in (1, 2, 3), false) as scaled from part"
VIEWS["moved"] = "select id, segment, case when nation = 'NATION_3' then 'NATION_4' else nation end as nation, region from personas union all select id, segment, case when nation = 'NATION_3' then 'NATION_4' else nation end, region from personas where region = 'ASIA'"

BODIES["leak_texts"] = f"select factor, metric, level, {_FOUR.format('mean')} as mean, {_FOUR.format('max_diff')} as max_diff from leaks"
BODIES |= {
    "archive_fragments": """select case category when 'transient' then 'fragment' when 'refused' then 'corrupt' else 'record' end as kind, count(*) as lines, cast(sum(length(line)) as bigint) as characters, case when category = 'ok' then count(*) else 0 end as keyed from lines group by category
  union all select 'placed', count(*), count(*) - 1, 0 from lines""",
    "rounded_texts": " union all ".join(f"select p_partkey, '{n}' as form, {_FOUR.format(f'({x})')} as text from (select *, cast(p_partkey as double) as k from part)" for n, x in _FORMS.items()),
    "ceiling_decisions": f"""select study, seq, {_CENTS.format('amount')} as amount, {_CENTS.format('case when own then case when amount > 0 then amount end else held end')} as ceiling_usd,
  case when own then nullif(mine, 'accepted') when held is null and not uncapped then 'ceiling_required' when fresh and committed + expected > held then 'over_ceiling' end as refusal, {_CENTS.format("case when mine = 'accepted' then held end")} as previous_usd from held_ceilings""",
    "document_problems": "select doc_id, field, reason from faults",
    "document_summaries": "select doc_id, string_agg(concat(field, ': ', reason), '; ' order by n) as problem from faults group by doc_id",
    "price_matches": """select coalesce(a.study, b.study) as study, coalesce(a.model_id, b.model_id) as model_id, case when b.study is null then 'field required (a Model of the study)' else 'not a Model id of the study' end as problem
  from (select distinct concat('n', c_nationkey) as study, concat('m', 1 + c_custkey % 7) as model_id from customer) a full join (select distinct concat('n', s_nationkey) as study, concat('m', 1 + s_suppkey % 5) as model_id from supplier) b on a.study = b.study and a.model_id = b.model_id where a.study is null or b.study is null""",
    "test_references": """select concat('u', o_custkey) as test, concat('0/', p) as place, case when i in ('3-MEDIUM', '5-LOW') then 'instrument_not_allowed' else 'unknown_instrument' end as code, concat('instruments.', p) as field from (select distinct o_custkey, o_orderpriority as i, substr(o_orderpriority, 1, 1) as p from orders where o_orderstatus = 'P') where i <> '1-URGENT'
  union all select concat('u', c_custkey), '1/0', 'config_invalid', 'models.0' from customer where c_custkey % 4 = 0
  union all select concat('u', o_custkey), concat('2/', n), 'unknown_instrument', concat('practice.', n) from (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders where o_orderstatus = 'O') e where not exists (select 1 from orders l where l.o_orderstatus = 'P' and l.o_custkey = e.o_custkey and l.o_orderpriority = e.o_orderpriority)""",
    "push_outcomes": "select pos, name, outcome, code from pushes_judged",
    "registered_after_push": "select name, kind, was as sha256 from known_tests union all select name, kind, sha from pushes_judged where outcome = 'new'",
    "leaks_after_push": f"select factor, metric, level, {_FOUR.format('mean')} as mean, {_FOUR.format('max_diff')} as max_diff from pushed_leaks",
    "plan_digests": "select * from digests",
    "status_reports": "select test, length(document) as characters, sha256(document) as sha256 from reports",
    "persona_results": """select a.run_id, a.agent_id, a.model_id, case when s.run_id is not null then case when c.matched / c.total >= 0.5 then 'pass' else 'fail' end end as outcome, case when s.run_id is not null then round(c.matched / c.total, 6) end as score, c.matched, c.total, c.short as insufficient,
  case when s.run_id is null then 'no_settings_stamp' end as problem, s.stamp as settings_hash from (select distinct run_id, agent_id, model_id from ended) a
  join (select run_id, agent_id, count(*) as total, count(*) filter (where 2 * n < expected) as short, count(*) filter (where 2 * n >= expected and case pole when 'high' then score > 3 else score < 3 end) as matched from self_checks group by all) c using (run_id, agent_id)
  left join (select concat('s', 1 + c_custkey) as run_id, sha256(c_mktsegment) as stamp from customer where c_mktsegment <> 'MACHINERY') s on s.run_id = a.run_id""",
    "resolved_instruments": """select w.study, w.pos, w.name, case when o.name is not null then 'user' when b.name is not null then 'builtin' end as source,
  case when w.study in (select study from own_names where name in (select name from shared_names)) then 'shadows_builtin' when o.name is null and b.name is null then 'unknown_instrument' when coalesce(o.renamed, b.renamed) then 'name_differs' end as problem
  from wanted_names w left join own_names o on o.study = w.study and o.name = w.name left join shared_names b on b.name = w.name""",
    "resolved_variants": "select trial_id, v as variant, case when v = 'default' or v = substr(instrument, 1, 1) then concat(instrument, ' by ', v) end as wording from (select *, case when repeat = 1 then case when model_id = 'm1' then substr(instrument, 1, 1) else '3' end else 'default' end as v from trials)",
    "self_report_problems": """select i.instrument, case when not i.self then 'no_self_report' when w.wrong is not null then w.wrong when not i.scaled then 'no_subscale' when i.shared is not null then concat('item_ids_taken:', i.shared) end as problem
  from (select instrument, max(p_size) > 15 as self, bool_or(scaled) as scaled, string_agg(item_id, ',' order by item_id) filter (where p_size between 40 and 41) as shared from questions group by instrument) i
  left join (select instrument, arg_min(case when construct is null then concat('no_key:', item_id) else concat('other_construct:', item_id) end, pos) as wrong from questions where construct is distinct from 'nars' group by instrument) w using (instrument)""",
    "stamp_maps": "select run_id as test, cast(count(*) as int) as pairs, string_agg(concat(model_id, '/', instrument, '=', settings_hash, '/', instrument_hash), ',' order by concat(model_id, '/', instrument)) as stamps from (select * from results where agent_id is null qualify row_number() over (partition by run_id, model_id, instrument order by pos desc) = 1) group by run_id",
    "exclusions_in_order": "select test, cast(count(*) as int) as n, sha256(string_agg(concat(agent_id, '|', instrument), ',' order by trial_index, agent_id)) as listed from (select test, agent_id, instrument, trial_index from trials where state = 'failed' qualify row_number() over (partition by test, agent_id order by trial_index) = 1) group by test",
    "frame_differences": "select id, segment, nation, region, cast(sum(n) as bigint) as more from (select *, 1 as n from moved union all select id, segment, nation, region, -1 from personas) group by all having sum(n) <> 0",
    "source_hashes": """select region, sha256(concat('{"panel":{', cards, '},"results":[', coalesce(rows, ''), ']}')) as source_hash
  from (select region, string_agg(concat('"', id, '.md":"', sha256(concat('You live in ', nation, '.', chr(10), 'You buy ', segment, '.')), '"'), ',' order by concat(id, '.md')) as cards from personas group by region)
  left join (select region, string_agg(concat('{"agent_id":"', agent_id, '","model_id":"', model_id, '","outcome":"', outcome, '","pair_checks":null,"run_id":"', run_id, '"}'), ',' order by pos) as rows from results join personas on id = split_part(agent_id, '-', 1) group by region) using (region)""",
    "open_dry_run": f"""select p.test, p.trials, p.sessions, p.agents, p.uniform, g.requests, g.requests_sha256, coalesce(b.n, 0) as unrendered, e.expected, e.worst_case, e.providers,
  cast(case p.test when 't1' then 1000000000000 when 't4' then 5 when 't2' then 1000000000000 end as decimal(28,4)) as ceiling_usd,
  case p.test when 't1' then null when 't3' then 'invalid_ceiling' when 't4' then 'over_ceiling' end as would_refuse, coalesce(x.n, 0) as excluded, paused.reason as paused
  from ({BODIES["plan_summary"]}) p left join digests g using (test) left join (select test, count(*) as n from request_texts where problem is not null group by test) b using (test) left join ({BODIES["cost_estimate"]}) e using (test)
  left join (select test, count(distinct agent_id) as n from trials where state = 'failed' group by test) x using (test) left join paused on paused.name = p.test""",
}


#: The profile of a persona as a number, the first trait being its highest bit; and the traits that are low, the first being the lowest.
VIEWS["profiled"] = "select id, pnum, " + " + ".join(f"(((pnum >> {b}) & 1) << {4 - b})" for b in range(5)) + " as profile, 31 - (pnum & 31) as low from people"
_FRACTIONS = {"1": "true", "1/2": "s4 = s0 * s1 * s2 * s3", "1/4": "s3 = s0 * s1 and s4 = s0 * s2"}
VIEWS["event_checks"] = "select event_id as pos, event_type as instrument, event_type = 'click' as pairwise, concat('c', 1 + event_id % 40) as a, concat('c', 101 + (event_id * 7 + 3) % 41) as b, event_type = 'click' or value >= 40 as two from events"
_LEVELS = {"age_band": "p_type from part", "gender": "c_mktsegment from customer", "cultural_region": "r_name from region", "robot_experience": "o_orderpriority from orders"}


def _panel_level(q: str) -> str:
    """The level of an attribute: its place in an order by hash for each band, turned for each copy."""
    n = f"len(l_{q})"
    again = f"({n} // greatest(1, gcd(16, {n})))"
    return f"l_{q}[1 + (at_{q} + b + copy * (16 % {n}) + copy // {again}) % {n}] as {q}"


_PLACES_OF_ATTRIBUTES = ", ".join(f"row_number() over (partition by b order by sha256(concat('{seeds.derive(7, 'personas', q)}:', b, ':', rank))) - 1 as at_{q}" for q in _LEVELS)
BODIES |= {
    "pairs_plan": """select instrument, concat(case o when 1 then least(a.c, b.c) else greatest(a.c, b.c) end, '|', case o when 1 then greatest(a.c, b.c) else least(a.c, b.c) end) as clips, concat(instrument, ':', least(a.c, b.c), ':', greatest(a.c, b.c)) as pair_id, cast(o as int) as position, cast(row_number() over (order by instrument, a.p, b.p, o) - 1 as int) as place
  from (select concat('c', min(p_partkey)) as c, p_size as p from part group by p_size) a join (select concat('c', min(p_partkey)) as c, p_size as p from part group by p_size) b on a.p < b.p, (select distinct o_orderpriority as instrument from orders where o_orderpriority in ('1-URGENT', '2-HIGH')), (values (1), (2)) w(o)""",
    "fractional_profiles": " union all ".join(f"select '{f}' as fraction, p.profile, {_TRAITS}, coalesce(h.n, 0) as personas from ({_PROFILES}) p left join (select profile, count(*) as n from profiled group by profile) h using (profile) where {w}" for f, w in _FRACTIONS.items()),
    "alias_chains": BODIES["alias_chains"].replace("select fraction, string_agg(name", "select c.fraction, string_agg(name").replace(" as effects from c group by fraction, chain", """ as effects,
  (select cast(coalesce(sum(1 - 2 * (bit_count(cast(c.chain & p.low as bigint)) % 2)), 0) as bigint) from profiled p where case c.fraction when '1/2' then bit_count(p.low) % 2 = 0 else bit_count(p.low & 11) % 2 = 0 and bit_count(p.low & 21) % 2 = 0 end) as contrast from c group by c.fraction, chain"""),
    "panel_generated": f"""with r as (select profile, {_TRAITS}, row_number() over (order by profile) - 1 as rank from ({_PROFILES}) where s4 = s0 * s1 * s2 * s3), n as (select r.*, b, case b when 0 then 'low' else 'high' end as nars from r, (values (0), (1)) w(b)), t as (select *, {_PLACES_OF_ATTRIBUTES} from n),
  l as (select {", ".join(f"(select list(distinct v order by v) from (select {c.replace(' from', ' as v from')})) as l_{q}" for q, c in _LEVELS.items())})
  select concat('p', (rank * 2 + copy) * 2 + b + 1) as id, (rank * 2 + copy) * 2 + b + 1 as number, {_TRAITS}, nars, {", ".join(map(_panel_level, _LEVELS))} from t, l, (values (0), (1)) k(copy)""",
    "perception_shapes": """select instrument, clips, pair_id, position, min(pos) as first_check from (select instrument, concat(least(a, b), '|', greatest(a, b)) as clips, concat(instrument, ':', least(a, b), ':', greatest(a, b)) as pair_id, 1 as position, pos from event_checks where pairwise
  union all select instrument, concat(greatest(a, b), '|', least(a, b)), concat(instrument, ':', least(a, b), ':', greatest(a, b)), 2, pos from event_checks where pairwise union all select instrument, a, null, null, pos from event_checks where not pairwise union all select instrument, b, null, null, pos from event_checks where not pairwise and two) group by all""",
    "pair_check_counts": "select instrument, count(*) filter (where two) as n_pair_checks, min(pos) as first from event_checks group by instrument",
    "practice_chosen": """select concat('u', o_custkey, '/', o_orderpriority) as instrument, cast(n as int) as n, case when o_orderpriority in ('1-URGENT', '2-HIGH') then concat('c', 25 + o_orderkey % 7, '|c', 27 + o_orderkey % 4) else concat('c', 25 + o_orderkey % 7) end as clips
  from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as n from orders where o_orderstatus = 'O') where n <= 2""",
    "answer_schemas": """select p_brand as instrument, length(j) as characters, sha256(j) as sha256 from (select p_brand, concat('{"additionalProperties":false,"properties":{', string_agg(concat('"i', p_partkey, '":', case p_type when 'ECONOMY' then concat('{"maximum":', 2 + p_size % 10, ',"minimum":1,"type":"integer"}') when 'PROMO' then concat('{"enum":["', replace(p_name, ' ', '","'), '"],"type":"string"}') else '{"minLength":1,"type":"string"}' end), ',' order by concat('i', p_partkey)),
  '},"required":[', string_agg(concat('"i', p_partkey, '"'), ',' order by p_partkey), '],"type":"object"}') as j from part group by p_brand)""",
    "shared_items": "select concat(p_name, '_', p_size) as item_id from part where p_type = 'ECONOMY' intersect select concat(p_name, '_', p_size) from part where p_type = 'PROMO'",
    "natural_sort_rank": "select agent_id, cast(row_number() over (order by cast(substr(persona_id, 2) as bigint), cast(substr(model_id, 2) as int)) as int) as rank from (select distinct agent_id, persona_id, model_id from trials)",
}


BODIES |= {
    "plan_places": "select test, trial_id, row_number() over (partition by test order by cast(substr(persona_id, 2) as bigint), cast(substr(model_id, 2) as int), repeat, trial_index, trial_id) as place from trials",
    "scoring_keys": "select p_brand as instrument, cast(pos as int) as pos, concat('i', p_partkey) as item_id, lower(p_type) as construct, p_size % 2 = 0 as reversed, case when p_type = 'PROMO' then concat('s', 1 + p_size % 3) end as subscale, cast(2 + p_size % 9 as int) as points from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as pos from part) where p_size >= 8 and p_type <> 'LARGE'",
    "clip_scan": "select clip_id, duration_s, size_bytes, loudness_lufs from clips where clip_id in (select clip_a from trials union select clip_b from trials where pairwise)",
    "typed_trials": "select test, model_id, count(*) as trials, cast(0 as bigint) as seeded, cast(sum(case when pairwise then 2 else 1 end) as bigint) as clips, max(trial_index) as last from trials group by all",
}


def _needed(body: str) -> list[str]:
    """The views that a statement uses, directly or through others, in order of definition."""
    import re

    found, todo = set(), [body]
    while todo:
        for name in set(re.findall(r"[a-z_]+", todo.pop())) & VIEWS.keys() - found:
            found.add(name)
            todo.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        views = ", ".join(f"{v} as ({VIEWS[v]})" for v in _needed(body))
        out[name] = f"with {views} select * from ({body})" if views else body
    return out
