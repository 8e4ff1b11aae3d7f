"""SQL for the checking engine, written independently of the Spark operators.

Sequence operators use plain windows over whole logs, run merging replays the merges
(unrolled or recursively), and spectra are sums of cosines and sines.
"""

from __future__ import annotations

import re

from loadline.profiles import PROFILES


def r(expr: str, name: str | None = None) -> str:
    """Six decimals, by the same arithmetic in both engines."""
    return f"floor(({expr}) * 1e6 + 5e-1) / 1e6 as {name or expr}"


def rs(*names: str, prefix: str = "") -> str:
    return ", ".join(r(prefix + n, n) for n in names)


def _profile_rows() -> str:
    fields = ["profile", "window_seconds", "overlap", "channels", "has_phase_imbalance", "freq_target_hz",
              "freq_tolerance_hz", "freq_valid_fraction", "min_current_floor", "max_phase_imbalance",
              "valid_window_fraction", "red_max_rms", "red_max_variance", "green_min_rms", "green_min_thd",
              "green_min_variance", "green_min_imbalance", "intensity_cut", "dominant_factor",
              "dominant_confidence", "state_red", "state_amber", "state_green", "label_red_max",
              "label_red_inclusive", "label_green_min", "label_min_run", "job_types", "job_features", "cycle_rule", "extra_job_name",
              "look_back", "model_channels"]

    def lit(v):
        if v is None:
            return "cast(null as double)"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        return f"'{v}'" if isinstance(v, str) else str(v)

    rows = ", ".join("(" + ", ".join(lit(getattr(p, f)) for f in fields) + ")" for p in PROFILES)
    return f"select * from (values {rows}) as t({', '.join(fields)})"


CTES: dict[str, str] = {
    "ev0": """select event_id, value,
      case event_id % 4 when 0 then 'furnace' when 1 then 'conveyer' when 2 then 'robo' else 'milling' end as machine,
      cast(row_number() over (partition by event_id % 4 order by ts, event_id) - 1 as bigint) as row_idx,
      least(value, 100e0) / 100e0 - 5e-1 as u from events""",
    "ev1": """select *, (case cast(floor(row_idx / 90e0) as int) % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 1 end
      + case when value > 200e0 then 1 else 0 end) % 3 as lvl from ev0""",
    "ev2": """select *, case machine
      when 'furnace'  then case lvl when 0 then 5e-1 when 1 then 6e0  else 15e0  end
      when 'conveyer' then case lvl when 0 then 5e-2 when 1 then 2e-1 else 6e-1  end
      when 'robo'     then case lvl when 0 then 5e-2 when 1 then 1003e-4 else 13e-2 end
      else                 case lvl when 0 then 3e-1 when 1 then 2e0  else 6e0   end end as base from ev1""",
    "ev3": """select event_id, machine, row_idx, value, u,
      case when machine = 'robo' then 3e0 * base * (1e0 + 4e-1 * u) else base * (1e0 + 4e-1 * u) end as i1,
      case when machine = 'robo' then 0e0 else base * (1e0 - 3e-1 * u) end as i2,
      case when machine = 'robo' then 0e0 else base * (1e0 + 1e-1 * u) end as i3,
      50e0 + case when value > 200e0 then 8e-1 else 4e-1 * u end as frequency from ev2""",
    "readings": """select machine, row_idx, timestamp '2024-01-01' + to_seconds(row_idx) as ts,
      i1, i2, i3, (i1 + i2 + i3) / 3e0 as i_avg, frequency from ev3""",
    "raw": """select event_id, machine, row_idx,
      printf('%02d:%04.1f', cast(floor((row_idx * 10) / 60e0) as int) % 60, cast((row_idx * 10) % 60 as double)) as timestamp_str,
      case when event_id % 97 = 0 then 'bad' when event_id % 89 = 0 then '-1.0' when event_id % 83 = 0 then null
           else printf('%.10f', i1) end as i1,
      printf('%.10f', i2) as i2, printf('%.10f', i3) as i3,
      case when event_id % 101 = 0 then 'n/a' else printf('%.10f', frequency) end as frequency from ev3""",
    "iso": """select event_id, machine, row_idx,
      case when event_id % 103 = 0 then 'corrupt'
           else strftime(timestamp '2024-01-01' + to_seconds(row_idx), '%Y-%m-%d %H:%M:%S') end as timestamp_str,
      i1, i2, i3, case when event_id % 107 = 0 then 'x' else i1 end as i_avg_src, frequency from raw""",
    "numeric_raw": """select *, greatest(coalesce(try_cast(i1 as double), 0e0), 0e0) as n1,
      greatest(coalesce(try_cast(i2 as double), 0e0), 0e0) as n2,
      greatest(coalesce(try_cast(i3 as double), 0e0), 0e0) as n3,
      coalesce(try_cast(frequency as double), 50e0) as nf from raw""",
    "profiles": _profile_rows(),
    "steps": """select machine, row_idx, ts, i_avg,
      epoch_us(ts) - lag(epoch_us(ts)) over (partition by machine order by row_idx) as step from readings""",
    "stats": """select machine, count(*) as n, min(ts) as t_first, max(ts) as t_last,
      min(i_avg) as min_i_avg, max(i_avg) as max_i_avg,
      case when median(step) > 0 then 1e0 / (median(step) / 1e6) else 1e0 end as sample_rate
      from steps group by machine""",
    "settings": """select s.machine, s.n, s.sample_rate as rate, s.t_first, p.*,
      window_seconds * (1e0 - overlap) as step_s,
      greatest(2, cast(floor(window_seconds * s.sample_rate * 5e-1) as bigint)) as min_rows,
      least(floor(epoch_us(t_last - t_first) / 1e6 / (window_seconds * (1e0 - overlap))),
            greatest(0e0, ceil((epoch_us(t_last - t_first) / 1e6 - overlap * window_seconds)
                               / (window_seconds * (1e0 - overlap))))) as last_k
      from stats s join profiles p on p.profile = s.machine""",
    "slots": """select machine, unnest(range(0, cast(last_k as bigint) + 1)) as k from settings""",
    "bounds": """select s.*, o.k, t_first + to_microseconds(cast(o.k * step_s * 1e6 as bigint)) as start_time,
      t_first + to_microseconds(cast((o.k * step_s + window_seconds) * 1e6 as bigint)) as end_time
      from settings s join slots o using (machine)""",
    "wrows": """select b.machine, b.k, b.start_time, b.end_time, b.min_rows, b.rate, r.row_idx, r.i1, r.i2, r.i3,
      r.i_avg, r.frequency from bounds b join readings r
      on r.machine = b.machine and r.ts >= b.start_time and r.ts < b.end_time""",
    "w0": """select machine, k, start_time, end_time, rate, count(*) as n_samples, min(row_idx) as start_row,
      max(row_idx) as end_row,
      sqrt(avg(i1 * i1)) as rms_i1, sqrt(avg(i2 * i2)) as rms_i2, sqrt(avg(i3 * i3)) as rms_i3,
      sqrt(avg(i_avg * i_avg)) as rms_i_avg, var_pop(i1) as variance_i1, var_pop(i2) as variance_i2,
      var_pop(i3) as variance_i3, var_pop(i_avg) as variance_i_avg, max(i1) - min(i1) as peak_to_peak_i1,
      max(i2) - min(i2) as peak_to_peak_i2, max(i3) - min(i3) as peak_to_peak_i3,
      avg(i1) as m1, avg(i2) as m2, avg(i3) as m3, avg(i_avg) as avg_i_avg, avg(frequency) as avg_freq,
      avg(case when abs(frequency - 50e0) <= 5e-1 then 1e0 else 0e0 end) as in_band,
      min(least(i1, i2, i3)) >= 0 as sane, max(greatest(i1, i2, i3)) > 1e-2 as loaded
      from wrows group by machine, k, start_time, end_time, min_rows, rate having count(*) >= min_rows""",
    "windows": """select *, cast(row_number() over (partition by machine order by k) - 1 as int) as window_index,
      date_trunc('millisecond', start_time + (end_time - start_time) / 2) as centre_time from w0""",
    "timef": """select w.*, case when not has_phase_imbalance or (rms_i1 + rms_i2 + rms_i3) / 3e0 <= 1e-2 then 0e0
      else sqrt(((rms_i1 * rms_i1 + rms_i2 * rms_i2 + rms_i3 * rms_i3) / 3e0)
                - pow((rms_i1 + rms_i2 + rms_i3) / 3e0, 2)) / ((rms_i1 + rms_i2 + rms_i3) / 3e0) end as phase_imbalance
      from windows w join profiles p on p.profile = w.machine""",
    "v0": """select w.*, p.*, case when (m1 + m2 + m3) / 3e0 <= 1e-2 then 0e0
      else sqrt((pow(m1 - (m1 + m2 + m3) / 3e0, 2) + pow(m2 - (m1 + m2 + m3) / 3e0, 2)
                 + pow(m3 - (m1 + m2 + m3) / 3e0, 2)) / 3e0) / ((m1 + m2 + m3) / 3e0) end as validation_imbalance
      from windows w join profiles p on p.profile = w.machine""",
    "v1": """select *, in_band >= freq_valid_fraction as freq_ok, sane and loaded as range_ok,
      validation_imbalance <= max_phase_imbalance as phase_ok, avg_i_avg >= min_current_floor as energy_ok,
      in_band * 100e0 as freq_valid_pct from v0""",
    "valid": """select *, freq_ok and range_ok and phase_ok and energy_ok as is_valid,
      coalesce(nullif(concat_ws('; ',
        case when not freq_ok then printf('Grid freq %.2f Hz out of band', avg_freq) end,
        case when not range_ok then 'Current values out of valid range or all-zero' end,
        case when not phase_ok then printf('Phase imbalance CV=%.2f > %.2f', validation_imbalance, max_phase_imbalance) end,
        case when not energy_ok then printf('Mean i_avg %.3f A < floor %.3f A', avg_i_avg, min_current_floor) end),
        ''), 'OK') as failure_reason from v1""",
    # spectra: every channel sample times every bin
    "signals": """select x.machine, w.window_index, w.n_samples, w.rate, x.channel, x.v,
      x.row_idx - w.start_row as j from windows w
      join (select machine, k, row_idx, unnest(['i1', 'i2', 'i3', 'i_avg']) as channel,
                   unnest([i1, i2, i3, i_avg]) as v from wrows) x using (machine, k)
      join profiles p on p.profile = x.machine and contains(',' || p.channels || ',', ',' || x.channel || ',')""",
    "tapered": """select *, (v - avg(v) over (partition by machine, window_index, channel))
      * (5e-1 - 5e-1 * cos(2e0 * pi() * j / (n_samples - 1))) as y from signals where n_samples >= 4""",
    "bins": """select machine, window_index, channel, n_samples, rate, k as bin,
      sqrt(pow(sum(y * cos(2e0 * pi() * k * j / n_samples)), 2) + pow(sum(y * sin(2e0 * pi() * k * j / n_samples)), 2))
        * 2e0 / n_samples as magnitude
      from (select *, unnest(range(0, n_samples // 2 + 1)) as k from tapered)
      group by machine, window_index, channel, n_samples, rate, k""",
    "energy": """select machine, window_index, channel, n_samples, rate, 1e0 / (n_samples * (1e0 / rate)) as df, sum(magnitude * magnitude) as total_energy,
      sum(case when bin * (1e0 / (n_samples * (1e0 / rate))) > rate / 4e0 then magnitude * magnitude else 0e0 end) as high_freq_energy,
      max(bin) as last_bin from bins group by machine, window_index, channel, n_samples, rate""",
    "peaks": """select e.*, case when total_energy < 1e-18 then 1 else (select min(b.bin) from bins b
        where b.machine = e.machine and b.window_index = e.window_index and b.channel = e.channel and b.bin > 0
          and b.magnitude = t.top) end as peak
      from energy e join (select machine, window_index, channel, max(magnitude) as top from bins where bin > 0
                          group by machine, window_index, channel) t using (machine, window_index, channel)""",
    "near2": """select p.machine, p.window_index, p.channel, arg_min(b.magnitude, abs(b.bin - 2 * p.peak)) as m,
      min(abs(b.bin * p.df - p.peak * p.df * 2)) as d
      from peaks p join bins b using (machine, window_index, channel) group by p.machine, p.window_index, p.channel""",
    "near3": """select p.machine, p.window_index, p.channel, arg_min(b.magnitude, abs(b.bin - 3 * p.peak)) as m,
      min(abs(b.bin * p.df - p.peak * p.df * 3)) as d
      from peaks p join bins b using (machine, window_index, channel) group by p.machine, p.window_index, p.channel""",
    "spec0": """select p.*, b.magnitude as h1, case when n2.d <= 5e-2 then n2.m else 0e0 end as h2,
      case when n3.d <= 5e-2 then n3.m else 0e0 end as h3
      from peaks p join bins b on b.machine = p.machine and b.window_index = p.window_index
        and b.channel = p.channel and b.bin = p.peak
      join near2 n2 on n2.machine = p.machine and n2.window_index = p.window_index and n2.channel = p.channel
      join near3 n3 on n3.machine = p.machine and n3.window_index = p.window_index and n3.channel = p.channel""",
    "spectral": """select w.machine, w.window_index, c.channel, w.n_samples,
      coalesce(s.peak * s.df, 0e0) as fundamental_freq, coalesce(h1, 0e0) as fundamental_mag,
      coalesce(h2, 0e0) as harmonic2_mag, coalesce(h3, 0e0) as harmonic3_mag,
      coalesce(total_energy, 0e0) as total_energy, coalesce(high_freq_energy, 0e0) as high_freq_energy,
      case when h1 > 1e-9 then sqrt(h2 * h2 + h3 * h3) / h1 else 0e0 end as thd
      from windows w join profiles p on p.profile = w.machine
      join (select unnest(['i1', 'i2', 'i3', 'i_avg']) as channel) c
        on contains(',' || p.channels || ',', ',' || c.channel || ',')
      left join spec0 s on s.machine = w.machine and s.window_index = w.window_index and s.channel = c.channel""",
    "features": """select t.*, fundamental_freq, fundamental_mag * fundamental_mag as fundamental_energy,
      harmonic2_mag * harmonic2_mag as harmonic2_energy, harmonic3_mag * harmonic3_mag as harmonic3_energy,
      total_energy, high_freq_energy, thd,
      case when total_energy > 1e-9 then high_freq_energy / total_energy else 0e0 end as high_freq_ratio
      from timef t join spectral s on s.machine = t.machine and s.window_index = t.window_index and s.channel = 'i_avg'""",
}


def rules(profiles: str = "profiles") -> dict[str, str]:
    return {
        "s0": f"""select f.*, p.*, least(1e0, greatest(0e0, rms_i_avg / greatest(green_min_rms, 1e-9))) as srms,
          least(1e0, greatest(0e0, variance_i_avg / greatest(green_min_variance, 1e-9))) as svar,
          least(1e0, greatest(0e0, thd / greatest(green_min_thd, 1e-9))) as sthd,
          case when green_min_imbalance is not null
               then least(1e0, greatest(0e0, phase_imbalance / greatest(green_min_imbalance, 1e-9))) end as simb
          from features f join {profiles} p on p.profile = f.machine""",
        "s1": """select *, greatest(sthd, svar, coalesce(simb, 0e0)) as intensity,
          'RMS=' || case when red_max_variance is not null then printf('%.2f', rms_i_avg)
            when simb is null then printf('%.4f', rms_i_avg) else printf('%.3f', rms_i_avg) end || ' A' as txt from s0""",
        "s2": """select *, case when rms_i_avg <= red_max_rms and coalesce(variance_i_avg <= red_max_variance, true) then 1
          when rms_i_avg >= green_min_rms and intensity >= intensity_cut then 2
          when rms_i_avg >= green_min_rms * dominant_factor then 3 else 4 end as rule from s1""",
        "classified": """select *, case rule when 1 then 'RED' when 4 then 'AMBER' else 'GREEN' end as state,
          round(least(1e0, greatest(0e0, case rule when 1 then 1e0 - rms_i_avg / greatest(red_max_rms, 1e-9)
            when 2 then (srms + intensity) / 2e0 when 3 then srms * dominant_confidence
            else (rms_i_avg - red_max_rms) / greatest(green_min_rms - red_max_rms, 1e-9) end)), 3) as confidence,
          case rule
            when 1 then case when red_max_variance is not null
              then txt || ' <= ' || red_max_rms || ' A, Var=' || printf('%.2f', variance_i_avg) || ' A2 <= ' || red_max_variance || ' A2'
              else txt || ' <= ' || red_max_rms || ' A (' || case machine when 'robo' then 'STANDBY' when 'milling' then 'Idle'
                   else 'HALT' end || ' threshold)' end
            when 2 then concat_ws('; ', txt || ' >= ' || green_min_rms || ' A',
              case when thd >= green_min_thd then printf('THD=%.3f', thd) end,
              case when variance_i_avg >= green_min_variance then case machine
                when 'furnace' then printf('Var=%.2f', variance_i_avg) || ' A²' when 'robo' then printf('Var=%.5f', variance_i_avg)
                else printf('Var=%.4f', variance_i_avg) end end,
              case when phase_imbalance >= green_min_imbalance then
                case machine when 'furnace' then 'Imbalance=' else 'Imb=' end || printf('%.2f', phase_imbalance) end)
            when 3 then case machine when 'furnace' then txt || ' >> ' || green_min_rms || ' A (dominant)'
              when 'robo' then txt || ' >> threshold (ACTIVE dominant)'
              else txt || ' >> threshold (3-phase motor dominant)' end
            else case machine when 'furnace' then txt || ' between thresholds [' || red_max_rms || ', ' || green_min_rms || ']'
              when 'robo' then txt || printf(' in IDLE band [%.3f, %.3f] A', red_max_rms, green_min_rms)
              when 'milling' then txt || printf(' in No-Load band [%.2f, %.2f] A', red_max_rms, green_min_rms)
              else txt || printf(' in IDLE band [%.2f, %.2f] A', red_max_rms, green_min_rms) end end as reason
          from s2""",
    }


CTES |= rules()


def hysteresis_ctes(source: str, prefix: str, initial: str | None, n: int = 3) -> dict[str, str]:
    """Replay of the streak counter: position in the run of equal states, last accepted state."""
    start = f"'{initial}'" if initial else "first_value(state) over (partition by machine order by window_index)"
    return {
        f"{prefix}0": f"""select *, window_index - row_number() over (partition by machine, state order by window_index)
          as run from {source}""",
        f"{prefix}1": f"""select *, row_number() over (partition by machine, state, run order by window_index) as pos,
          {start} as first_state from {prefix}0""",
        f"{prefix}": f"""select *, coalesce(last_value(case when pos >= {n} then state end ignore nulls)
          over (partition by machine order by window_index rows between unbounded preceding and current row),
          first_state) as smoothed_state from {prefix}1""",
    }


CTES |= hysteresis_ctes("classified", "smoothed", None)
CTES |= hysteresis_ctes("classified", "smoothed_red", "RED")


def runs_sql(source: str, order: str, value: str, lo: str, hi: str) -> str:
    return f"""select machine, run_id, min(value) as value, min(lo) as start_row, max(hi) as end_row,
      max(hi) - min(lo) + 1 as len from (
        select machine, value, lo, hi, sum(fresh) over (partition by machine order by o) - 1 as run_id from (
          select machine, {value} as value, {order} as o, {lo} as lo, {hi} as hi,
            case when lag({value}) over (partition by machine order by {order}) = {value} then 0 else 1 end as fresh
          from {source}))
      group by machine, run_id"""


CTES |= {
    "labelled_raw": """select r.*, case when i_avg >= label_green_min then 2
      when i_avg < label_red_max or (label_red_inclusive and i_avg = label_red_max) then 0 else 1 end as raw_label
      from readings r join profiles p on p.profile = r.machine""",
    "runs": runs_sql("labelled_raw", "row_idx", "raw_label", "row_idx", "row_idx"),
}
# Furnace: ten unrolled passes of the simultaneous merge.
_last = "(select * from runs where machine = 'furnace')"
for _i in range(10):
    CTES[f"pass{_i}"] = f"""select machine, run_id, start_row, end_row, case
        when len >= 10 or coalesce(ll, rl) is null then value when coalesce(ll, 0) >= coalesce(rl, 0) then lv else rv end as value
      from (select *, lag(len) over w as ll, lead(len) over w as rl, lag(value) over w as lv, lead(value) over w as rv
            from {_last} window w as (partition by machine order by run_id))"""
    CTES[f"merged{_i}"] = runs_sql(f"pass{_i}", "run_id", "value", "start_row", "end_row")
    _last = f"merged{_i}"
CTES["together"] = "select * from merged9"
# Others: replay of the leftmost-first merge, one raw run per step.
CTES["raw_runs"] = """select r.*, label_min_run as m, max(run_id) over (partition by machine) as last_run
  from runs r join profiles p on p.profile = r.machine where machine <> 'furnace'"""
CTES["walk"] = """select machine, m, last_run, 0 as i, cast(-1 as int) as v, cast(0 as bigint) as s, false as topped,
    cast(null as int) as out_v, cast(null as bigint) as out_s from raw_runs where run_id = 0
  union all
  select w.machine, w.m, w.last_run,
    case when w.topped and c.value <> w.v and c.len < w.m and n.run_id is not null and c.start_row - w.s < n.len
         then w.i + 2 else w.i + 1 end,
    case when not w.topped then c.value when c.value = w.v then w.v when c.len >= w.m then c.value
         when n.run_id is not null and c.start_row - w.s < n.len then n.value else w.v end,
    case when not w.topped then 0 when c.value = w.v then w.s when c.len >= w.m then c.start_row
         when n.run_id is not null and c.start_row - w.s < n.len and n.value <> w.v then c.start_row else w.s end,
    w.topped or c.end_row + 1 >= w.m,
    case when not w.topped then case when c.end_row + 1 >= w.m or n.run_id is null then c.value end
         when c.value = w.v then null when c.len >= w.m then c.value
         when n.run_id is not null and c.start_row - w.s < n.len and n.value <> w.v then n.value end,
    case when not w.topped then 0 else c.start_row end
  from walk w join raw_runs c on c.machine = w.machine and c.run_id = w.i
  left join raw_runs n on n.machine = w.machine and n.run_id = w.i + 1"""
CTES |= {
    "leftmost0": "select machine, out_v as value, out_s as start_row from walk where out_v is not null",
    "leftmost": """select machine, row_number() over (partition by machine order by start_row) - 1 as run_id, value, start_row,
      coalesce(lead(start_row) over (partition by machine order by start_row), n) - 1 as end_row,
      coalesce(lead(start_row) over (partition by machine order by start_row), n) - start_row as len
      from leftmost0 join stats using (machine)""",
    "smooth": """select machine, run_id, value, start_row, end_row, len from together union all
      select machine, run_id, value, start_row, end_row, len from leftmost""",
    "reds": """select *, sum(case when value = 0 then 1 else 0 end) over (partition by machine order by run_id) as red_no
      from smooth where machine = 'furnace'""",
    "red_cycles": """select machine, row_number() over (partition by machine order by red_no) - 1 as cycle_id, start_row, end_row
      from (select machine, red_no, min(start_row) as start_row, max(end_row) as end_row from reds
            where value <> 0 and red_no >= 1 group by machine, red_no having bool_or(value = 2))""",
    "green_cycles": """select machine, row_number() over (partition by machine order by run_id) - 1 as cycle_id, start_row, end_row
      from smooth s join profiles p on p.profile = s.machine
      where machine <> 'furnace' and value = 2 and len >= label_min_run""",
    "cycles": """select *, end_row - start_row + 1 as duration_s from
      (select * from red_cycles union all select * from green_cycles)""",
    "labelled": """select r.*, s.value as state_label, cast(coalesce(k.cycle_id, -1) as int) as cycle_id,
      case when k.cycle_id is null then null when k.end_row = k.start_row then 0e0
           else (r.row_idx - k.start_row) / cast(k.end_row - k.start_row as double) end as cycle_pos
      from readings r join smooth s on s.machine = r.machine and r.row_idx between s.start_row and s.end_row
      left join cycles k on k.machine = r.machine and r.row_idx between k.start_row and k.end_row
        and (r.machine <> 'furnace' or k.end_row > k.start_row)""",
    # fixed rule in place of a model: labels of five rows before, none for the first L - 1 rows
    "pred0": """select l.*, n, look_back, lag(state_label, 5) over w as ls, lag(cycle_pos, 5) over w as lp,
      lag(cycle_id % 2, 5) over w as lj from labelled l join profiles p on p.profile = l.machine
      join stats using (machine) window w as (partition by machine order by row_idx)""",
    "predictions": """select * exclude (ls, lp, lj), case when row_idx < look_back - 1 then -1 else ls end as ml_state,
      case when row_idx >= look_back - 1 then coalesce(lp, 5e-1) end as ml_cycle_pos,
      case when row_idx < look_back - 1 then -1 when lj < 0 then 0 else lj end as ml_job_type,
      case when cycle_id < 0 then -1 else cycle_id % 3 % 2 end as job_type,
      case when row_idx >= look_back - 1 then 6e-1 + (row_idx % 37) / 1e2 end as ml_state_conf from pred0""",
}


def _draw(round_no: int) -> str:
    """The integer draw of k-means++ in (0, 1)."""
    base = f"((cycle_id * 7919 + start_no * 104729 + {round_no * 1299709 + 42}) % 1000003)"
    return f"((({base} * {base} * {base} + start_no * 7919) % 1000003 + 1) / 1000004e0)"


def _square(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: pow({a}[i] - {b}[i], 2)))"


# K-means over lists: one row per machine and start, all points of the machine beside it.
CTES |= {
    "job_raw": f"""select k.machine, k.cycle_id, any_value(job_features) as job_features, any_value(cycle_rule) as cycle_rule, any_value(job_types) as job_types,
      cast(count(*) as double) as duration_s, case when k.machine = 'furnace' then ln(1e0 + count(*)) else log10(count(*) + 1e0) end as log_duration,
      avg(i_avg) as mean_iavg, stddev_pop(i_avg) as std_iavg, avg(i1) as mean_i1, avg((i2 + i3) / 2e0) as mean_i23,
      coalesce(avg(i_avg) filter (s.value = 2), 0e0) as mean_green, coalesce(max(i_avg) filter (s.value = 2), 0e0) as max_green,
      coalesce(stddev_pop(i_avg) filter (s.value = 2), 0e0) as std_green,
      count(*) filter (s.value = 2) * 1e0 / count(*) as green_fraction, count(*) filter (s.value = 1) * 1e0 / count(*) as amber_fraction
      from cycles k join readings r on r.machine = k.machine and r.row_idx between k.start_row and k.end_row
      join smooth s on s.machine = r.machine and r.row_idx between s.start_row and s.end_row
      join profiles p on p.profile = k.machine group by k.machine, k.cycle_id""",
    "job_long": f"""select machine, cycle_id, cycle_rule, job_types, unnest(range(1, len(string_split(job_features, ',')) + 1)) as pos,
      unnest(list_transform(string_split(job_features, ','), lambda f: case f {' '.join(f"when '{c}' then {c}" for c in ('log_duration', 'mean_iavg', 'std_iavg', 'mean_i1', 'mean_i23', 'mean_green', 'max_green', 'std_green', 'green_fraction', 'amber_fraction'))} end)) as v from job_raw""",
    "job_z": """select machine, cycle_id, cycle_rule, pos, least(job_types, count(*) over (partition by machine, pos)) as k,
      (v - avg(v) over (partition by machine, pos)) / case when stddev_pop(v) over (partition by machine, pos) < 1e-12 then 1e0
        else stddev_pop(v) over (partition by machine, pos) end as z from job_long""",
    "job_x": """select machine, cast(cycle_id as bigint) as cycle_id, cycle_rule, k, list(z order by pos) as x from job_z
      group by machine, cycle_id, cycle_rule, k""",
    "job_p": """select machine, max(k) as k, list(x order by cycle_id) as xs from job_x group by machine""",
    "job_s": "select distinct machine, unnest(range(0, 10)) as start_no from job_x",
}
_centres = "cast([] as double[][])"
CTES["seed0"] = f"select machine, start_no, {_centres} as cs from job_s"
for _i in range(3):
    CTES[f"draw{_i}"] = f"""select x.machine, c.start_no, cycle_id, x, cs, case when len(cs) = 0 then 1e0 when len(cs) >= k then 0e0
        else list_min(list_transform(cs, lambda c: {_square('c', 'x')})) end as near, {_draw(_i)} as u
      from job_x x join seed{_i} c on c.machine = x.machine"""
    CTES[f"seed{_i + 1}"] = f"""select machine, start_no, case when count(*) filter (near > 0) = 0 then any_value(cs)
        else list_append(any_value(cs), arg_min(x, (-ln(u) / near, cycle_id)) filter (near > 0)) end as cs from draw{_i} group by machine, start_no"""
_near_all = f"list_transform(xs, lambda x: list_transform(cs, lambda c: {_square('c', 'x')}))"
_labels = "list_transform(ds, lambda d: list_position(d, list_min(d)))"
_mean = """list_transform(range(1, len(cs) + 1), lambda j: case when list_contains(ls, j)
    then list_transform(range(1, len(cs[1]) + 1), lambda q: list_avg(list_transform(list_filter(list_zip(xs, ls), lambda m: m[2] = j), lambda m: m[1][q])))
    else cs[j] end)"""
CTES |= {
    "lloyd": f"""select machine, start_no, xs, cs, cast('infinity' as double) as moved, 0 as step from seed3 join job_p using (machine)
      union all
      select machine, start_no, xs, after as cs, list_sum(list_transform(range(1, len(cs) + 1), lambda j: {_square('cs[j]', 'after[j]')})) as moved, step + 1 as step
      from (select *, {_mean} as after from (select *, {_labels} as ls from (select *, {_near_all} as ds from lloyd where moved > 1e-4 and step < 300)))""",
    "ended": """select * from (select *, max(step) over (partition by machine, start_no) as last_step from lloyd) where step = last_step""",
    "judged": f"""select *, list_sum(list_transform(ds, lambda d: list_min(d))) as cost from (select *, {_near_all} as ds from ended)""",
    "chosen": "select * from (select *, row_number() over (partition by machine order by round(cost, 9), start_no) as pick from judged) where pick = 1",
    "clustered": f"""select x.machine, x.cycle_id, x.cycle_rule, x.x, list_position(ds, list_min(ds)) as cluster from (
      select x.*, list_transform(cs, lambda c: {_square('c', 'x.x')}) as ds from job_x x join chosen c on c.machine = x.machine) x""",
    "job_rank": """select machine, cluster, cast(row_number() over (partition by machine order by avg(case when cycle_rule = 'non_red' then x[2] else x[1] end), cluster) - 1 as int) as job_type
      from clustered group by machine, cluster""",
    "jobs": "select machine, cycle_id, job_type from clustered join job_rank using (machine, cluster)",
}


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` with the CTEs it needs, directly or through others."""
    ctes = CTES | (extra or {})
    ordered: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in ctes:
            if name in words and name not in ordered and name not in visiting:
                visiting.add(name)
                visit(ctes[name])
                ordered.append(name)

    visiting: set[str] = set()
    visit(final)
    body = ",\n".join(f"{name} as {'' if name in ('walk', 'lloyd') else 'materialized '}({ctes[name]})" for name in ordered)
    return f"with recursive {body}\n{final}" if ordered else final
