"""DuckDB SQL for the signal queries, by other means where there are some.

The fold is a recursive query that steps all sessions by one window at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from tidemark.config import Config
from tidemark.operators.intervals import AD_LABELS, GRACE_SECONDS, MERGE_SECONDS, SKIP_LABELS
from tidemark.sources.adapters import BUFFER_RATE, CHUNK_WINDOWS, FRAME, RECUT

BUFFERS = """
buffers as (
  select vec_id, list_transform(embedding, lambda x, i: case when i - 1 >= vec_id * 5 % 56 and i - 1 < vec_id * 5 % 56 + vec_id * 11 % 40
    then 0.0::double else x::double * ((1 + vec_id % 7) / 8::double) end) as s from embeddings),
samples as (select vec_id, i - 1 as i, s[i] as x from buffers, unnest(range(1, len(s) + 1)) as u(i)),
levels as (
  select vec_id, count(*) as n, sqrt(sum(x * x) / count(*)) as rms, max(abs(x)) as peak from samples group by vec_id)"""
DB = "greatest(20 * log10(case when {0} > 0 then {0} end), -120)"
CREST = "case when rms <= 0 then 1.0::double else peak / rms end"
FRAMES = f"""
frames as (
  select vec_id, (i // {FRAME})::int as frame, sqrt(sum(x * x) / count(*)) as rms from samples group by all),
masks as (select vec_id, frame, coalesce({DB.format("rms")}, -120) < -60 as silent from frames),
runs as (
  select vec_id, min(frame)::int as start, (max(frame) + 1)::int as stop
  from (select *, frame - row_number() over (partition by vec_id order by frame) as island from masks where silent)
  group by vec_id, island),
frame_count as (select vec_id, max(frame) + 1 as n from frames group by vec_id),
profile as (
  select f.vec_id, coalesce(sum(stop - start), 0) / any_value(n)::double as silence_ratio,
    coalesce(max(stop - start), 0) * {FRAME / BUFFER_RATE}::double as max_silence_run_seconds,
    coalesce(max(stop - start) filter (start = 0), 0) * {FRAME / BUFFER_RATE}::double as leading_silence_seconds,
    coalesce(max(stop - start) filter (stop = n), 0) * {FRAME / BUFFER_RATE}::double as trailing_silence_seconds,
    coalesce(max(stop - start) filter (start > 0 and stop < n), 0) * {FRAME / BUFFER_RATE}::double as interior_silence_seconds
  from frame_count f left join runs r on f.vec_id = r.vec_id group by f.vec_id)"""
#: The spectrum by its definition: sums of cosines and sines.
CENTROID = f"""
tapered as (select vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) as x, n from samples join levels using (vec_id)),
spectrum as (
  select vec_id, b, sqrt(pow(sum(x * cos(2 * pi() * b * i / n)), 2) + pow(sum(x * sin(2 * pi() * b * i / n)), 2)) as size, any_value(n) as n
  from tapered, range(0, {BUFFER_RATE // 2 + 1}) as r(b) group by vec_id, b),
centroids as (
  select vec_id, case when sum(size) > 1e-12 then sum(size * b * {BUFFER_RATE}::double / n) / sum(size) else 0 end as spectral_centroid_hz
  from spectrum group by vec_id)"""
WINDOWS = f"""
keyed as (
  select user_id as session_id, event_id, event_type, value, coalesce(try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as int), 0) as k,
    row_number() over (partition by user_id order by ts, event_id) - 1 as window_index
  from events),
w as (
  select session_id, window_index, window_index::double as t, (window_index // {CHUNK_WINDOWS})::int as chunk, event_id, event_type, value, k,
    case when k % 10 = 0 then -90.0::double else 20 * log10(value / 500) end as rms_dbfs,
    (6 + k % 13)::double as crest_db, 500.0::double + 7 * k + value as centroid, k % 10 = 0 as silent,
    (case when k % 10 = 0 then 1 when k % 10 = 5 then 0.4 else 0 end)::double as silence_ratio,
    (case when k % 10 = 0 then 1 when k % 10 = 5 then 0.3 else 0 end)::double as longest,
    (case when k % 10 = 0 then 1 when k % 10 = 1 then 0.15 else 0 end)::double as lead_s,
    (case when k % 10 = 0 then 1 when k % 10 = 9 then 0.1 else 0 end)::double as trail_s,
    (case when k % 10 = 5 then 0.3 else 0 end)::double as interior, 1.0::double as duration
  from keyed)"""


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


SPANS = f"""
raw_spans as (
  select session_id, chunk, t - {CHUNK_WINDOWS} * chunk as start, t - {CHUNK_WINDOWS} * chunk + 2.0::double + event_id % 9 as "end",
    case event_id % 5 when 0 then 'skip' when 1 then 'advert' else 'ad' end as label
  from w where event_type = 'purchase'),
clipped as (
  select session_id, chunk, start, least("end", coalesce(lead(start) over (partition by session_id, chunk order by start, "end"), "end"), {CHUNK_WINDOWS}) as "end", label
  from raw_spans),
chunk_durations as (select session_id, chunk, sum(duration) as duration from w group by session_id, chunk),
offsets as (
  select session_id, chunk, coalesce(sum(duration) over (partition by session_id order by chunk rows between unbounded preceding and 1 preceding), 0) as o
  from chunk_durations),
spans as (select session_id, chunk, start + o as start, "end" + o as "end", label from clipped join offsets using (session_id, chunk)),
marked as (
  select *, case when start - lag("end") over b >= {MERGE_SECONDS} or lag("end") over b is null then 1 else 0 end as opens from spans
  where label in ({_listed(AD_LABELS)}) window b as (partition by session_id order by start, "end")),
islands as (select *, sum(opens) over (partition by session_id order by start, "end" rows unbounded preceding) - 1 as break_id from marked),
breaks as (select session_id, break_id::bigint as break_id, min(start) as start, arg_max("end", (start, "end")) as "end" from islands group by session_id, break_id),
labelled as (
  select w.*, case when s.label in ({_listed(AD_LABELS)}) then 'ad' when s.label is not null then 'skip' else 'content' end as label
  from w left join spans s on w.session_id = s.session_id and t + duration / 2 >= s.start and t + duration / 2 < s."end")"""


def _baseline(alpha: float) -> str:
    step = lambda c, x: f"case when w.silent then {c} when {c} is null then w.{x} else {1 - alpha}::double * {c} + {alpha}::double * w.{x} end"
    return f"""
folded as (
  select session_id, 0::bigint as i, null::double as r, null::double as c, null::double as z, 0 as n from w where window_index = 0
  union all
  select w.session_id, i + 1, {step("r", "rms_dbfs")}, {step("c", "crest_db")}, {step("z", "centroid")}, n + case when w.silent then 0 else 1 end
  from folded f join w on w.session_id = f.session_id and w.window_index = f.i),
based as (
  select w.*, r as baseline_rms_dbfs, c as baseline_crest_db, z as baseline_centroid_hz, n as baseline_count
  from w join folded f on w.session_id = f.session_id and w.window_index = f.i)"""


def _fold(config: Config, bars: Sequence[tuple[float, float]]) -> str:
    """`decided`: the fold for each (bar to enter, bar to stay), config_id by place. Relative mode, no gate."""
    d, c = config.detection, config.controller
    trials = ", ".join(f"({k}, {a}::double, {b}::double)" for k, (a, b) in enumerate(bars))
    ema = lambda b, x: f"case when not takes then {b} when {b} is null then {x} else {1 - d.baseline_alpha}::double * {b} + {d.baseline_alpha}::double * {x} end"
    return f"""
trials(config_id, enter, stay) as (values {trials}),
steps as (
  select config_id, enter, stay, session_id, -1::bigint as i, null::double as t, null::double as br, null::double as bc, null::double as bz, 0 as bn, false as in_ad,
    null::double as ad_at, 0.0::double as carry, null::double as cue_at, null::double as vr, null::double as vz, 0 as streak, []::double[] as recent,
    'CONTENT' as state, 0 as pending, null::double as muted_at, 'NO_CHANGE' as event, false as profile, 0.0::double as confidence, 0.0::double as gap,
    false as active, 0.0::double as smoothed, null::double as pr, null::double as pc, null::double as pz, 0 as pn, null::double as bar, null::double as elapsed
  from trials, (select distinct session_id from w)
  union all
  select config_id, enter, stay, session_id, i, t, {ema("br", "rms_dbfs")}, {ema("bc", "crest_db")}, {ema("bz", "centroid")}, bn + case when takes then 1 else 0 end,
    (started or in_ad and not ended) and not reject, case when (started or in_ad and not ended) and not reject then coalesce(case when started then t end, ad_at) end,
    carry2, case when not (started or ended or reject) then cue2 end, case when silent then vr else rms_dbfs end, case when silent then vz else centroid end,
    case when started or ended or reject or not in_ad or profile2 then 0 else streak + 1 end, recent2,
    state2, case when state2 = 'AD_SUSPECTED' then case when state = 'AD_SUSPECTED' then pending + 1 else 1 end
      when state2 = 'MUTED' then case when state = 'MUTED' then pending when state = 'AD_SUSPECTED' then pending + 1 else 1 end else 0 end,
    case when state2 = 'MUTED' then case when state = 'MUTED' then muted_at else t end end,
    event2, profile2 and not failsafe, case when ended then 0 else confidence2 end, gap2, active2, smoothed2, br, bc, bz, bn, bar2, elapsed2
  from (
    select *, case state
        when 'MUTED' then case when ended or t - muted_at >= {c.max_mute_seconds} then 'CONTENT' else 'MUTED' end
        when 'AD_SUSPECTED' then case when ended or not (profile2 and not failsafe) then 'CONTENT' when pending + 1 >= {c.confirm_windows} then 'MUTED' else 'AD_SUSPECTED' end
        else case when not started then 'CONTENT' when 1 >= {c.confirm_windows} then 'MUTED' else 'AD_SUSPECTED' end end as state2,
      not ended and (state = 'MUTED' and t - muted_at >= {c.max_mute_seconds} or state = 'AD_SUSPECTED' and not profile2) as reject,
      not silent and (not in_ad and not started or ended and not failsafe) as takes,
      case when started then 'AD_STARTED' when ended then 'AD_ENDED' else 'NO_CHANGE' end as event2
    from (
      select *, not in_ad and profile2 and active2 as started, in_ad and elapsed2 >= {d.max_ad_seconds} as failsafe,
        in_ad and (elapsed2 >= {d.max_ad_seconds} or not profile2 and streak + 1 >= {d.ad_end_windows} and elapsed2 >= {d.min_ad_seconds}) as ended,
        round(0.5 * least(1, greatest(0, ld / greatest(bar2, 1e-6))) + 0.5 * least(1, greatest(0, cd / greatest({d.ad_crest_delta_db}, 1e-6))), 3) as confidence2
      from (
        select *, case when t - cue1 <= {d.cue_grace_seconds} then cue1 end as cue2, coalesce(t - cue1 <= {d.cue_grace_seconds}, false) as active2,
          judged and ld >= bar2 and cd >= {d.ad_crest_delta_db} as profile2
        from (
          select *, case when is_cue then t else cue_at end as cue1, case when judged then rms_dbfs - br else 0 end as ld, case when judged then bc - crest_db else 0 end as cd
          from (
            select s.* exclude (t, i), w.t, w.window_index as i, rms_dbfs, crest_db, centroid, silent, w.t - ad_at as elapsed2,
              case when in_ad then stay else enter end as bar2, not silent and bn >= {d.baseline_min_windows} as judged,
              case when silence_ratio >= 0.999 then 0 else greatest(carry + lead_s, interior) end as gap2,
              case when silence_ratio >= 0.999 then carry + duration else trail_s end as carry2,
              (case when silence_ratio >= 0.999 then 0 else greatest(carry + lead_s, interior) end) between {d.min_gap_seconds} and {d.max_gap_seconds}
                and (vr is null or abs(rms_dbfs - vr) >= {d.loudness_jump_db} or vz > 1 and abs(centroid - vz) / vz >= {d.centroid_shift_ratio}) as is_cue,
              list_append(recent, rms_dbfs)[-{d.loudness_median_windows}:] as recent2,
              list_median(list_append(recent, rms_dbfs)[-{d.loudness_median_windows}:]) as smoothed2
            from steps s join w on w.session_id = s.session_id and w.window_index = s.i + 1)))))),
decided as (select *, state = 'MUTED' as muted from steps where i >= 0),
changes as (
  select *, muted <> lag(muted, 1, false) over b as changed, max(t) over (partition by config_id, session_id) as until, lead(i) over b is null as is_last
  from decided window b as (partition by config_id, session_id order by i)),
stretches as (
  select config_id, session_id, muted, t as start, coalesce(lead(t) over (partition by config_id, session_id order by i), until) as stop, until
  from changes where changed),
mutes as (
  select config_id, session_id, row_number() over (partition by config_id, session_id order by start) - 1 as span, start,
    case when stop > start then stop else until + 1 end as "end"
  from stretches where muted)"""


#: Polls beside the windows: the app that each window's event names, restarts and failures of the actuator.
OWN_POLLS = """
polls as (
  select *, window_index % 23 = 0 and window_index > 0 as restarted, event_id % 7 <> 3 as ok,
    case when event_type <> 'view' then ((window_index + session_id) // 17 % 4)::bigint::varchar end as app_id, upper(event_type) as app_name from w)"""
#: Polls of a second table, the last one before each window; the actuator always obeys.
TABLE_POLLS = """
asked as (
  select session_id, t + event_id % 4 * 0.5 - 1.0 as told_at, upper(event_type) as app_name,
    case event_id % 7 when 2 then null when 3 then '' else ((window_index + session_id) // 17 % 4)::bigint::varchar end as app_id
  from w where event_id % 3 = 0),
last_asked as (
  select * from asked qualify row_number() over (partition by session_id, told_at order by app_id desc nulls last, app_name desc nulls last) = 1),
polls as materialized (
  select w.*, a.app_id, a.app_name, window_index % 23 = 0 and window_index > 0 as restarted, true as ok,
    case when a.told_at is null then null when a.app_id is null then 'failed' when a.app_id = '' then 'no app' else 'app' end as poll
  from w asof left join last_asked a on w.session_id = a.session_id and w.t >= a.told_at)"""


def _gated(config: Config, polls: str) -> str:
    """`steps`: one config's fold with the app gate, restarts of the stream and an actuator that may fail. Relative mode.

    A row is stepped in stages: what breaks off first, then the detector on what is left, then the controller.
    """
    d, c, g = config.detection, config.controller, config.gate
    names = _listed([x.strip().lower() for x in g.armed_app_names])
    left = lambda column, none="null::double": f"case when reset then {none} else {column} end"
    ema = lambda b, x: f"case when not takes then {b} when {b} is null then {x} else {1 - d.baseline_alpha}::double * {b} + {d.baseline_alpha}::double * {x} end"
    return f"""{polls},
steps as (
  select session_id, -1::bigint as i, null::double as br, null::double as bc, null::double as bz, 0 as bn, false as in_ad, null::double as ad_at, 0.0::double as carry,
    null::double as cue_at, null::double as vr, null::double as vz, 0 as streak, 'CONTENT' as state, 0 as pending, null::double as muted_at, false as unmute,
    null::double as checked, false as armed, '' as app, '' as event
  from (select distinct session_id from w)
  union all
  select session_id, i, case when on2 then {ema("br", "rms_dbfs")} else br end, case when on2 then {ema("bc", "crest_db")} else bc end,
    case when on2 then {ema("bz", "centroid")} else bz end, bn + case when on2 and takes then 1 else 0 end,
    case when on2 then (started or in_ad and not ended) and not reject else in_ad end,
    case when not on2 then ad_at when (started or in_ad and not ended) and not reject then case when started then t else ad_at end end,
    case when on2 then carry2 else carry end, case when not on2 then cue_at when not (started or ended or reject) then cue2 end,
    case when on2 and not silent then rms_dbfs else vr end, case when on2 and not silent then centroid else vz end,
    case when not on2 then streak when started or ended or reject or not in_ad or profile then 0 else streak + 1 end,
    case when not on2 then state when wish = 'CONTENT' and state = 'MUTED' and not ok then 'MUTED' when wish = 'MUTED' and state <> 'MUTED' and not ok then 'AD_SUSPECTED' else wish end,
    case when not on2 then pending when wish = 'CONTENT' and not (state = 'MUTED' and not ok) then 0 when state = 'AD_SUSPECTED' then pending + 1 when started and state = 'CONTENT' then 1 else pending end,
    case when not on2 then muted_at when wish = 'MUTED' then case when state = 'MUTED' then muted_at when ok then t end when state = 'MUTED' and not ok then muted_at end,
    case when not on2 or wish = state then unmute when wish = 'CONTENT' then state = 'MUTED' and not ok when wish = 'MUTED' and ok then false else unmute end,
    checked, on2, app, case when not on2 then '' when started then 'AD_STARTED' when ended then 'AD_ENDED' else 'NO_CHANGE' end
  from (
    select *, case state
        when 'MUTED' then case when ended or overdue or unmute then 'CONTENT' else 'MUTED' end
        when 'AD_SUSPECTED' then case when ended or not profile then 'CONTENT' when pending + 1 >= {c.confirm_windows} then 'MUTED' else 'AD_SUSPECTED' end
        else case when not started then 'CONTENT' when 1 >= {c.confirm_windows} then 'MUTED' else 'AD_SUSPECTED' end end as wish,
      not ended and (state = 'MUTED' and overdue and not (unmute and ok) or state = 'AD_SUSPECTED' and not profile) as reject,
      not silent and (not in_ad and not started or ended and not failsafe) as takes
    from (
      select *, not in_ad and loud and active as started, in_ad and elapsed >= {d.max_ad_seconds} as failsafe, loud and not (in_ad and elapsed >= {d.max_ad_seconds}) as profile,
        in_ad and (elapsed >= {d.max_ad_seconds} or not loud and streak + 1 >= {d.ad_end_windows} and elapsed >= {d.min_ad_seconds}) as ended,
        coalesce(t - muted_at >= {c.max_mute_seconds}, false) as overdue
      from (
        select *, case when t - cue1 <= {d.cue_grace_seconds} then cue1 end as cue2, coalesce(t - cue1 <= {d.cue_grace_seconds}, false) as active,
          judged and rms_dbfs - br >= case when in_ad then {d.stay_delta} else {d.ad_loudness_delta_db} end and bc - crest_db >= {d.ad_crest_delta_db} as loud
        from (
          select *, t - ad_at as elapsed, not silent and bn >= {d.baseline_min_windows} as judged, case when silence_ratio >= 0.999 then carry + duration else trail_s end as carry2,
            case when gap between {d.min_gap_seconds} and {d.max_gap_seconds}
              and (vr is null or abs(rms_dbfs - vr) >= {d.loudness_jump_db} or vz > 1 and abs(centroid - vz) / vz >= {d.centroid_shift_ratio}) then t else cue_at end as cue1
          from (
            select *, case when silence_ratio >= 0.999 then 0 else greatest(carry + lead_s, interior) end as gap
            from (
              select * exclude (br, bc, bz, bn, in_ad, ad_at, carry, cue_at, vr, vz, streak, state, pending, muted_at, unmute), {left("br")} as br, {left("bc")} as bc, {left("bz")} as bz,
                {left("bn", "0")} as bn, {left("in_ad", "false")} as in_ad, {left("ad_at")} as ad_at, {left("carry", "0.0")} as carry, {left("cue_at")} as cue_at, {left("vr")} as vr,
                {left("vz")} as vz, {left("streak", "0")} as streak, case when breaks and stays then 'MUTED' when breaks then 'CONTENT' else state end as state,
                case when breaks and not stays and state <> 'CONTENT' then 0 else pending end as pending, case when breaks and not stays and state <> 'CONTENT' then null else muted_at end as muted_at,
                case when breaks and state = 'MUTED' then not ok else unmute end as unmute
              from (
                select *, restarted or not on2 as breaks, state = 'MUTED' and not ok as stays, restarted or switched or not on2 and state <> 'CONTENT' as reset
                from (
                  select * exclude (checked, app), case when due then t else checked end as checked, due and app_id is not null and fits and own_app <> app as switched,
                    case when due and app_id is not null then fits else armed end as on2, case when due and app_id is not null then case when fits then own_app else '' end else app end as app
                  from (
                    select s.* exclude (i), p.window_index as i, p.t, p.rms_dbfs, p.crest_db, p.centroid, p.silent, p.silence_ratio, p.lead_s, p.trail_s, p.interior, p.duration, p.restarted,
                      p.ok, p.app_id, coalesce(nullif(p.app_id, ''), p.app_name) as own_app, coalesce(checked is null or p.t - checked >= {c.app_check_seconds}, true) as due, p.app_id in ({_listed(g.armed_app_ids)}) or lower(trim(p.app_name)) in ({names}) as fits
                    from steps s join polls p on p.session_id = s.session_id and p.window_index = s.i + 1))))))))))"""


SCORES = f"""
sessions as (select config_id, session_id, sum(duration) as duration from w, trials group by config_id, session_id),
met as (
  select t.config_id, b.session_id, b.break_id, b.start, b."end", min(m.start) as first_mute, min(m.start) - b.start as latency,
    coalesce(sum(case when m.start is not null then least(m."end", b."end") - greatest(m.start, b.start) end), 0) as covered_seconds
  from breaks b cross join trials t left join mutes m on m.session_id = b.session_id and m.config_id = t.config_id and m.start < b."end" and m."end" > b.start
  group by t.config_id, b.session_id, b.break_id, b.start, b."end"),
wrong as (
  select m.config_id, m.session_id, sum(m."end" - m.start) as muted_seconds, count(*) as mutes,
    greatest(0, sum(m."end" - m.start) - sum(coalesce((
      select sum(least(m."end", b."end" + {GRACE_SECONDS}) - greatest(m.start, b.start - {GRACE_SECONDS})) from breaks b
      where b.session_id = m.session_id and m.start < b."end" + {GRACE_SECONDS} and m."end" > b.start - {GRACE_SECONDS}), 0))) as false_seconds
  from mutes m group by m.config_id, m.session_id),
per_break as (
  select config_id, session_id, count(*) as breaks, count(first_mute) as caught, sum("end" - start) as ad_seconds, sum(covered_seconds) as covered_seconds
  from met group by config_id, session_id),
scores as (
  select s.config_id, s.session_id, s.duration, coalesce(breaks, 0) as breaks, coalesce(caught, 0) as caught, coalesce(mutes, 0) as mutes,
    coalesce(ad_seconds, 0)::double as ad_seconds, coalesce(covered_seconds, 0)::double as covered_seconds, coalesce(muted_seconds, 0)::double as muted_seconds,
    coalesce(false_seconds, 0)::double as false_seconds
  from sessions s left join per_break p using (config_id, session_id) left join wrong x using (config_id, session_id)),
totals as (
  select config_id, count(*) as sessions, round(sum(duration), 6) as duration, sum(breaks)::bigint as breaks, sum(caught)::bigint as caught, sum(mutes)::bigint as mutes,
    round(sum(ad_seconds), 6) as ad_seconds, round(sum(covered_seconds), 6) as covered_seconds, round(sum(muted_seconds), 6) as muted_seconds,
    round(sum(false_seconds), 6) as false_seconds, round(3600 * sum(false_seconds) / sum(duration), 6) as false_per_hour
  from scores group by config_id),
late as (select config_id, round(median(latency), 6) as median_latency, round(max(latency), 6) as max_latency from met group by config_id)"""


def statements(config: Config, swept: Sequence[str], app_ids: Sequence[str], app_names: Sequence[str], gated: Config, heartbeat: int, grid: Mapping[str, Sequence[str]], grid_stay: float) -> dict[str, str]:
    d = config.detection
    island = "row_number() over (partition by session_id order by window_index)"
    sofar = "over (partition by session_id order by window_index rows unbounded preceding)"
    before = "over (partition by session_id order by window_index rows between unbounded preceding and 1 preceding)"
    gaps = f"""
opened as (select *, coalesce(sum(case when silence_ratio >= 0.999 then 0 else 1 end) {before}, 0) as opener from w),
carried as (
  select a.*, coalesce((select max(o.trail_s) from opened o where o.session_id = a.session_id and o.opener = a.opener - 1 and o.silence_ratio < 0.999), 0)
    + coalesce(sum(case when silence_ratio >= 0.999 then duration end) over (partition by session_id, opener order by window_index rows between unbounded preceding and 1 preceding), 0) as carry
  from opened a),
gaps as (select *, case when silence_ratio >= 0.999 then 0.0::double else greatest(carry + lead_s, interior) end as gap_seconds from carried),
voiced as (
  select *, last_value(case when not silent then rms_dbfs end ignore nulls) {before} as vr, last_value(case when not silent then centroid end ignore nulls) {before} as vz from gaps),
cues as (
  select *, gap_seconds between {d.min_gap_seconds} and {d.max_gap_seconds}
    and (vr is null or abs(rms_dbfs - vr) >= {d.loudness_jump_db} or vz > 1 and abs(centroid - vz) / vz >= {d.centroid_shift_ratio}) as is_cue from voiced)"""
    parsed = f"""
lines as (
  select session_id, chunk, line, case (session_id + line) % 8
    when 0 then concat_ws(chr(9), a, b) when 1 then concat_ws(chr(9), 'x1', b, label) when 2 then concat_ws(chr(9), b, a, label)
    when 3 then concat_ws(chr(9), a, b, 'Music') when 4 then '# a comment' else concat_ws(chr(9), a, b, upper(label)) end as text
  from (select *, row_number() over (partition by session_id, chunk order by start, "end")::int as line, printf('%.2f', start) as a, printf('%.2f', "end") as b from raw_spans)),
parts as (
  select *, string_split(text, chr(9)) as p, try_cast(string_split(text, chr(9))[1] as double) as start, try_cast(string_split(text, chr(9))[2] as double) as "end",
    lower(string_split(text, chr(9))[3]) as label from lines where not starts_with(text, '#'))"""
    clocked = "clocked as (select *, coalesce(sum(duration) " + before + ", 0) as session_seconds from w)"
    deltas = """
  baseline_rms_dbfs, baseline_crest_db, baseline_centroid_hz, baseline_count, rms_dbfs - baseline_rms_dbfs as delta_rms_db, baseline_crest_db - crest_db as delta_crest_db,
  case when baseline_centroid_hz > 1 then (centroid - baseline_centroid_hz) / baseline_centroid_hz end as delta_centroid_ratio"""
    training = f"""
{_baseline(d.baseline_alpha)}, {clocked},
rows_ as (
  select b.*, session_seconds, t - min(t) over (partition by b.session_id, b.chunk) as at_s, {deltas.replace("baseline_count, rms", "baseline_count as cold, rms")},
    session_seconds - max(case when b.longest >= {d.min_gap_seconds} then session_seconds end) over (partition by b.session_id order by b.window_index rows unbounded preceding) as since
  from based b join (select session_id, window_index, session_seconds from clocked) using (session_id, window_index)),
training as (
  select r.*, case when s.label in ({_listed(AD_LABELS)}) then 'ad' when s.label is not null then 'skip' else 'content' end as label
  from rows_ r left join clipped s on r.session_id = s.session_id and r.chunk = s.chunk and at_s + duration / 2 >= s.start and at_s + duration / 2 < s."end")"""
    buffers, windows = f"with {BUFFERS}", f"with recursive {WINDOWS}"
    folded = f"{windows}, {_fold(config, [(d.ad_loudness_delta_db, d.stay_delta)])}"
    scored = f"{folded}, {SPANS}, {SCORES}"
    sweep_bars = [(float(v), -0.063) for v in swept]
    r6 = lambda *names: ", ".join(f"round({n}, 6) as {n}" for n in names)
    gap_values, bar_values = grid["detection.min_gap_seconds"], grid["detection.ad_loudness_delta_db"]

    def grid_part(gap: str) -> str:
        """The scores of one gap with every bar; a gap over the longest allowed is no setting."""
        own = replace(config, detection=replace(d, min_gap_seconds=float(gap)))
        folded = _fold(own, [(float(b), grid_stay) for b in bar_values])
        bar = " ".join(f"when {k} then '{b}'" for k, b in enumerate(bar_values))
        return f"""select '{gap}' as min_gap_seconds, case config_id {bar} end as ad_loudness_delta_db, * exclude (config_id)
  from (with recursive {WINDOWS}, {folded}, {SPANS}, {SCORES} select t.*, l.* exclude (config_id) from totals t join late l using (config_id))"""

    names = " or ".join(f"lower(trim(app_name)) = '{n}'" for n in app_names)
    return {
        "downmix": f"""{buffers},
pairs as (select vec_id, i // 2 as f, sum(round(x * 32768) / 32768) / 2 as m from samples group by all)
select vec_id, count(*)::int as n_frames, round(sqrt(sum(m * m) / count(*)), 6) as rms, round(max(abs(m)), 6) as peak from pairs group by vec_id""",
        "sig_rms": f"{buffers} select vec_id, {r6('rms')} from levels",
        "sig_level_db": f"{buffers} select vec_id, round(coalesce({DB.format('rms')}, -120), 6) as rms_dbfs from levels",
        "sig_peak": f"{buffers} select vec_id, {r6('peak')} from levels",
        "sig_crest": f"{buffers}, c as (select vec_id, {CREST} as crest_factor from levels) select vec_id, {r6('crest_factor')}, round({DB.format('crest_factor')}, 6) as crest_db from c",
        "sig_zcr": f"""{buffers}
select vec_id, round(count(*) filter (changed) / (count(*) - 1)::double, 6) as zero_crossing_rate
from (select vec_id, (x < 0) <> (lag(x) over (partition by vec_id order by i) < 0) as changed from samples) group by vec_id""",
        "sig_centroid": f"{buffers}, {CENTROID} select vec_id, round(spectral_centroid_hz, 5) as spectral_centroid_hz from centroids",
        "sig_frame_rms": f"{buffers}, {FRAMES} select vec_id, frame, {r6('rms')} from frames",
        "silence_runs": f"{buffers}, {FRAMES} select * from runs",
        "silence_profile": f"{buffers}, {FRAMES} select vec_id, {r6('silence_ratio', 'max_silence_run_seconds', 'leading_silence_seconds', 'trailing_silence_seconds', 'interior_silence_seconds')} from profile",
        "window_features": f"""{buffers}, {FRAMES}, {CENTROID},
z as (
  select vec_id, count(*) filter (changed) / (count(*) - 1)::double as zero_crossing_rate
  from (select vec_id, (x < 0) <> (lag(x) over (partition by vec_id order by i) < 0) as changed from samples) group by vec_id)
select l.vec_id, round(coalesce({DB.format("rms")}, -120), 6) as rms_dbfs, {r6("peak")}, round(coalesce({DB.format("peak")}, -120), 6) as peak_dbfs,
  round({CREST}, 6) as crest_factor, round({DB.format("(" + CREST + ")")}, 6) as crest_db, round(spectral_centroid_hz, 5) as spectral_centroid_hz, {r6("zero_crossing_rate")},
  coalesce({DB.format("rms")}, -120) < -60 as is_silence,
  {r6("silence_ratio", "max_silence_run_seconds", "leading_silence_seconds", "trailing_silence_seconds", "interior_silence_seconds")}, round(l.n / {BUFFER_RATE}::double, 6) as duration_seconds
from levels l join profile using (vec_id) join centroids using (vec_id) join z using (vec_id)""",
        "session_clock": f"{windows}, {clocked} select session_id, window_index, ({island} - 1)::int as session_index, {r6('session_seconds')} from clocked",
        "gap_stitch": f"{windows}, {gaps} select session_id, window_index, {r6('gap_seconds')} from gaps",
        "last_voiced": f"{windows}, {gaps} select session_id, window_index, round(vr, 6) as voiced_rms_dbfs, round(vz, 6) as voiced_centroid_hz from voiced",
        "cue_candidates": f"{windows}, {gaps} select session_id, window_index, is_cue, round(case when is_cue then gap_seconds else 0 end, 6) as cue_gap_seconds from cues",
        "cue_active": f"{windows}, {gaps} select session_id, window_index, coalesce(t - max(case when is_cue then t end) {sofar} <= {d.cue_grace_seconds}, false) as cue_active from cues",
        "trailing_median": f"{windows} select session_id, window_index, round(median(rms_dbfs) over (partition by session_id order by window_index rows 8 preceding), 6) as smoothed_rms_dbfs from w",
        "ema_baseline": f"{windows}, {_baseline(d.baseline_alpha)} select session_id, window_index, {r6('baseline_rms_dbfs', 'baseline_crest_db', 'baseline_centroid_hz')}, baseline_count from based",
        "feature_deltas": f"{windows}, {_baseline(d.baseline_alpha)} select session_id, window_index, {r6('delta_rms_db', 'delta_crest_db', 'delta_centroid_ratio')} from (select session_id, window_index, {deltas} from based)",
        "seconds_since_gap": f"{windows}, {clocked} select session_id, window_index, round(session_seconds - max(case when longest >= {d.min_gap_seconds} then session_seconds end) {sofar}, 6) as seconds_since_gap from clocked",
        "app_gate": f"""{windows},
polls as (select *, case when window_index % 10 = 0 and event_type <> 'view' then (event_id % 20)::varchar end as app_id, upper(event_type) as app_name from w),
known as (
  select *, last_value(app_id ignore nulls) {sofar} as active_app, last_value(case when app_id is not null then app_name end ignore nulls) {sofar} as active_name from polls)
select session_id, window_index, active_app, coalesce(active_app in ({_listed(app_ids)}) or {names.replace("app_name", "active_name")}, false) as armed from known""",
        "label_parse": f"""{windows}, {SPANS}, {parsed}
select session_id, chunk, line, {r6("start", '"end"').replace('as "end"', 'as "end"')}, label,
  case when len(p) < 3 then 'fewer than three columns' when start is null or "end" is null then 'not a number' when "end" < start then 'ends before it starts'
    when label not in ({_listed((*AD_LABELS, *SKIP_LABELS))}) then 'unknown label' end as error
from parts""",
        "label_overlap_check": f"""{windows}, {SPANS}
select * from (select session_id, chunk, start, "end", label, lag("end") over (partition by session_id, chunk order by start, "end") as previous_end from raw_spans) where start < previous_end""",
        "session_spans": f"{windows}, {SPANS} select * from spans",
        "label_windows": f"{windows}, {SPANS} select session_id, window_index, label from labelled",
        "class_balance": f"""{windows}, {SPANS}
select coalesce(session_id, -1) as session_id, coalesce(chunk, -1) as chunk, count(*) filter (label = 'ad') as ad, count(*) filter (label = 'content') as content, count(*) filter (label = 'skip') as skip
from labelled group by rollup (session_id, chunk)""",
        "unlabelled_chunks": "select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)",
        "merge_breaks": f"{windows}, {SPANS} select * from breaks",
        "training_rows": f"""{windows}, {SPANS}, {training}
select session_id, chunk, window_index, round(at_s, 3) as timestamp, round(session_seconds, 3) as session_seconds, label, (label = 'ad')::int as is_ad, round(rms_dbfs, 6) as rms_dbfs,
  round(value / 500, 6) as peak, round(rms_dbfs, 6) as peak_dbfs, 1.0::double as crest_factor, crest_db, round(centroid, 6) as spectral_centroid_hz, round(k / 1000, 6) as zero_crossing_rate,
  silent::int as is_silence, silence_ratio, longest as max_silence_run_seconds, lead_s as leading_silence_seconds, trail_s as trailing_silence_seconds, interior as interior_silence_seconds,
  duration as duration_seconds, {r6("baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz")}, baseline_count, {r6("delta_rms_db", "delta_crest_db", "delta_centroid_ratio")},
  round(since, 6) as seconds_since_gap
from training where label <> 'skip'""",
        "dataset_stats": f"""{windows}, {SPANS}, {training}
select session_id, count(*) as n_rows, round(avg((label = 'ad')::int), 6) as ad_share, count(*) filter (baseline_count < {d.baseline_min_windows}) as cold_rows
from training where label <> 'skip' group by session_id""",
        "detector_decisions": f"""{folded}
select session_id, i as window_index, event, profile as ad_profile, confidence, round(gap, 6) as gap_seconds, active as cue_active, round(smoothed, 6) as smoothed_rms_dbfs,
  round(pr, 6) as baseline_rms_dbfs, round(pc, 6) as baseline_crest_db, round(pz, 6) as baseline_centroid_hz, pn as baseline_count from decided""",
        "detector_events": f"{folded} select session_id, i as window_index, t as timestamp, event from decided where event <> 'NO_CHANGE'",
        "controller_states": f"{folded} select session_id, i as window_index, state, muted, pending from decided",
        "gated_states": f"{windows}, {_gated(gated, OWN_POLLS)} select session_id, i as window_index, event, state, state = 'MUTED' as muted, pending from steps where i >= 0",
        "restarted_states": f"{windows}, {_gated(gated, TABLE_POLLS)} select session_id, i as window_index, event, state, state = 'MUTED' as muted, pending from steps where i >= 0",
        "app_asof": f"""{windows}, {_gated(gated, TABLE_POLLS)},
told as (
  select session_id, i, armed, coalesce(checked = i, false) as checked, armed and app <> coalesce(lag(app) over (partition by session_id order by i), '') as app_switched
  from steps where i >= 0)
select p.session_id, window_index, poll, app_id, checked, armed, app_switched from polls p join told s on s.session_id = p.session_id and s.i = p.window_index""",
        "epoch_features": f"""{windows.replace("w as (", "plain as (")},
w as (
  select * exclude (session_id, window_index, t), session_id * 100000 + window_index // 23 as session_id, window_index % 23 as window_index, t, session_id as own, window_index as place from plain),
{gaps}, {_baseline(d.baseline_alpha)}
select own as session_id, place as window_index, (place // 23)::int as epoch, {r6("gap_seconds")}, round(vr, 6) as voiced_rms_dbfs,
  round(median(v.rms_dbfs) over (partition by v.session_id order by v.window_index rows 8 preceding), 6) as smoothed_rms_dbfs,
  {r6("baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz")}, baseline_count
from voiced v join (select session_id, window_index, baseline_rms_dbfs, baseline_crest_db, baseline_centroid_hz, baseline_count from based) using (session_id, window_index)""",
        "recut_blocks": f"""
with cut as (select vec_id, vec_id % 16 as session_id, list_transform(embedding[:20 + vec_id * 7 % 45], lambda x: x::double) as s from embeddings),
placed as (select *, sum(len(s)) over (partition by session_id order by vec_id) - len(s) as first from cut),
frames as (select session_id, first + i - 1 as frame, s[i] as x from placed, unnest(range(1, len(s) + 1)) as u(i) where vec_id % 29 <> 5)
select session_id, (frame // {RECUT})::bigint as window_index, min(frame)::bigint as first_frame, count(*)::int as n, max(frame) - min(frame) + 1 = count(*) as whole,
  round(arg_min(x, frame), 6) as first, round(sqrt(sum(x * x) / count(*)), 6) as rms
from frames group by all""",
        "mute_spans": f'{folded} select session_id, span::int as span, start, "end" from mutes',
        "mute_commands": f"""{folded}
select session_id, i as window_index, t as timestamp, muted as want_muted, false as at_end from changes where changed
union all select session_id, i, t, false, true from changes where is_last and muted""",
        "feature_log_rows": f"""{folded}
select session_id, i as "index", d.t as timestamp, state, muted, round(rms_dbfs, 6) as rms_dbfs, crest_db, event, bar as loudness_threshold_db, elapsed as ad_elapsed_seconds
from decided d join w using (session_id) where w.window_index = d.i""",
        "decision_log": f"""{folded}
select session_id, i as window_index, event, state,
  case when event <> 'NO_CHANGE' or (i + 1) % {heartbeat} = 0 or state is distinct from lag(state) over (partition by session_id order by i) then 'INFO' else 'DEBUG' end as level
from decided""",
        "replay_changes": f"{folded} select session_id, i as window_index, t as timestamp, event, state, confidence from decided where event <> 'NO_CHANGE'",
        "replay_summary": f"""{folded},
m as (select session_id, count(*) as mutes, sum("end" - start) as muted_seconds from mutes group by session_id)
select session_id, max(t) + 1 as duration, coalesce(any_value(mutes), 0) as mutes, coalesce(any_value(muted_seconds), 0)::double as muted_seconds,
  round(coalesce(any_value(muted_seconds), 0) / (max(t) + 1), 6) as muted_share from decided left join m using (session_id) group by session_id""",
        "break_latency": f"{scored} select session_id, break_id, first_mute, latency from met",
        "ad_coverage": f'{scored} select session_id, break_id, start, "end", covered_seconds from met',
        "false_mute": f"{scored} select session_id, muted_seconds, false_seconds from wrong",
        "spurious_mutes": f'{scored} select session_id, span::int as span, start, "end" from mutes m where not exists (select 1 from breaks b where b.session_id = m.session_id and m.start < b."end" and m."end" > b.start)',
        "score_session": f"{scored} select * exclude (config_id) from scores",
        "score_totals": f"{scored} select * exclude (config_id) from totals join late using (config_id)",
        "param_sweep": f"{windows}, {_fold(config, sweep_bars)}, {SPANS}, {SCORES} select config_id, t.* exclude (config_id), l.* exclude (config_id) from totals t join late l using (config_id)",
        "param_grid": " union all ".join(grid_part(g) for g in gap_values if float(g) <= d.max_gap_seconds),
        "clock_format": f"""{windows}
select session_id, window_index, printf('%02d:%02d.%d', (s // 600)::int, (s % 600 // 10)::int, (s % 10)::int) as clock
from (select session_id, window_index, round((window_index * 61.25 + 0.5) * 10)::bigint as s from w)""",
        "device_candidates": """
select doc_id, case when regexp_matches(trim(spec), '^[0-9]+$') then trim(spec) else concat_ws('|', trim(spec), nullif(regexp_extract(spec, 'CARD=([^,]+)', 1), '')) end as candidates
from (select doc_id, case doc_id % 3 when 0 then 'plughw:CARD=' || source || ',DEV=0' when 1 then ' ' || source else (doc_id % 10)::varchar end as spec from documents)""",
        "device_spec_parse": """
select doc_id, spec, coalesce(nullif(regexp_extract(spec, 'CARD=([^,]+)', 1), ''), spec) as device
from (select doc_id, case doc_id % 3 when 0 then 'plughw:CARD=' || source || ',DEV=0' when 1 then source else 'hw:CARD=,x' end as spec from documents)""",
    }
