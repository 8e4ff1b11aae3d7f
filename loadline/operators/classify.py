"""RED / AMBER / GREEN rules for samples and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.functions.display import state_code
from loadline.profiles import AMBER, GREEN, PROFILES, RED, with_profile

RULE_COLUMNS = ["red_max_rms", "red_max_variance", "green_min_rms", "green_min_thd",
                "green_min_variance", "green_min_imbalance", "intensity_cut",
                "dominant_factor", "dominant_confidence"]


def sample_states(readings: DataFrame, profiles=PROFILES, overrides: DataFrame | None = None) -> DataFrame:
    """State of every sample by its i_avg: below the red limit RED, at the green limit GREEN."""
    i = F.col("i_avg")
    state = (F.when(i < F.col("red_max_rms"), RED)
             .when(i >= F.col("green_min_rms"), GREEN).otherwise(AMBER))
    return (with_profile(readings, "red_max_rms", "green_min_rms", profiles=profiles, overrides=overrides)
            .withColumn("state", state).withColumn("state_code", state_code("state"))
            .drop("red_max_rms", "green_min_rms"))


def label_states(readings: DataFrame, profiles=PROFILES) -> DataFrame:
    """Integer training label per sample; the profile says if the red limit is included."""
    i = F.col("i_avg")
    red = (i < F.col("label_red_max")) | (F.col("label_red_inclusive") & (i == F.col("label_red_max")))
    label = F.when(i >= F.col("label_green_min"), 2).when(red, 0).otherwise(1)
    return (with_profile(readings, "label_red_max", "label_red_inclusive", "label_green_min", profiles=profiles)
            .withColumn("raw_label", label)
            .drop("label_red_max", "label_red_inclusive", "label_green_min"))


def state_share(states: DataFrame, state: str = "state") -> DataFrame:
    """Count and share per machine and state; states that never occur have 0 rows.

    One aggregation with the three states as columns, so nothing is joined back.
    """
    wide = states.groupBy("machine").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(state) == s).alias(s) for s in (RED, AMBER, GREEN)])
    long = wide.unpivot(["machine", "_n"], [RED, AMBER, GREEN], "state", "samples")
    return long.select("machine", "state", "samples", (F.col("samples") / F.col("_n") * 100.0).alias("share_pct"))


# Wording and decimals of the reasons, by family of messages.
_RMS_TEXT = """concat('RMS=', case when red_max_variance is not null then format_string('%.2f', rms_i_avg)
  when green_min_imbalance is null then format_string('%.4f', rms_i_avg)
  else format_string('%.3f', rms_i_avg) end, ' A')"""
_RED_TEXT = """case when red_max_variance is not null then
    concat(_text, ' <= ', string(red_max_rms), ' A, Var=', format_string('%.2f', variance_i_avg),
           ' A2 <= ', string(red_max_variance), ' A2')
  else concat(_text, ' <= ', string(red_max_rms), ' A (',
    case when green_min_imbalance is null then 'STANDBY'
         when substring_index(machine, '_', 1) = 'milling' then 'Idle' else 'HALT' end, ' threshold)') end"""
_GREEN_TEXT = """concat_ws('; ', concat(_text, ' >= ', string(green_min_rms), ' A'),
  case when thd >= green_min_thd then format_string('THD=%.3f', thd) end,
  case when variance_i_avg >= green_min_variance then
    case when red_max_variance is not null then format_string('Var=%.2f A²', variance_i_avg)
         when green_min_imbalance is null then format_string('Var=%.5f', variance_i_avg)
         else format_string('Var=%.4f', variance_i_avg) end end,
  case when phase_imbalance >= green_min_imbalance then
    case when red_max_variance is not null then format_string('Imbalance=%.2f', phase_imbalance)
         else format_string('Imb=%.2f', phase_imbalance) end end)"""
_DOMINANT_TEXT = """case
  when red_max_variance is not null then concat(_text, ' >> ', string(green_min_rms), ' A (dominant)')
  when green_min_imbalance is null then concat(_text, ' >> threshold (ACTIVE dominant)')
  else concat(_text, ' >> threshold (3-phase motor dominant)') end"""
_AMBER_TEXT = """case
  when red_max_variance is not null then
    concat(_text, ' between thresholds [', string(red_max_rms), ', ', string(green_min_rms), ']')
  when green_min_imbalance is null then
    concat(_text, format_string(' in IDLE band [%.3f, %.3f] A', red_max_rms, green_min_rms))
  when substring_index(machine, '_', 1) = 'milling' then
    concat(_text, format_string(' in No-Load band [%.2f, %.2f] A', red_max_rms, green_min_rms))
  else concat(_text, format_string(' in IDLE band [%.2f, %.2f] A', red_max_rms, green_min_rms)) end"""


def _score(value: str, threshold: str) -> str:
    return f"least(greatest({value} / greatest({threshold}, 1e-9D), 0D), 1D)"


def classify(features: DataFrame, profiles=PROFILES, overrides: DataFrame | None = None) -> DataFrame:
    """Rule-based state, confidence, reason and component scores of a window.

    A window is RED at or below the red RMS limit (and variance limit, where the profile
    has one); GREEN at or above the green RMS limit with one strong enough indicator, or
    far above it; else AMBER.  A NULL imbalance limit leaves that indicator out.
    """
    w = with_profile(features, *RULE_COLUMNS, profiles=profiles, overrides=overrides)
    w = with_exprs(
        w, _rms=_score("rms_i_avg", "green_min_rms"), _thd=_score("thd", "green_min_thd"),
        _var=_score("variance_i_avg", "green_min_variance"),
        _imb=f"case when green_min_imbalance is not null then {_score('phase_imbalance', 'green_min_imbalance')} end")
    w = with_exprs(w, _intensity="greatest(_thd, _var, _imb)", _text=_RMS_TEXT)  # greatest skips NULL
    w = with_exprs(w, _rule="""case
        when rms_i_avg <= red_max_rms and (red_max_variance is null or variance_i_avg <= red_max_variance)
          then 'red'
        when rms_i_avg >= green_min_rms and _intensity >= intensity_cut then 'green'
        when rms_i_avg >= green_min_rms * dominant_factor then 'dominant'
        else 'amber' end""")
    w = with_exprs(
        w,
        state="case _rule when 'red' then 'RED' when 'amber' then 'AMBER' else 'GREEN' end",
        confidence="""round(least(greatest(case _rule
            when 'red' then 1D - rms_i_avg / greatest(red_max_rms, 1e-9D)
            when 'green' then (_rms + _intensity) / 2D
            when 'dominant' then _rms * dominant_confidence
            else (rms_i_avg - red_max_rms) / greatest(green_min_rms - red_max_rms, 1e-9D) end, 0D), 1D), 3)""",
        scores="""named_struct('rms', round(_rms, 3), 'variance', round(_var, 3),
                               'thd', round(_thd, 3), 'imbalance', round(_imb, 3))""",
        reason=f"""case _rule when 'red' then {_RED_TEXT} when 'green' then {_GREEN_TEXT}
                     when 'dominant' then {_DOMINANT_TEXT} else {_AMBER_TEXT} end""")
    return w.drop(*RULE_COLUMNS, "_rms", "_var", "_thd", "_imb", "_intensity", "_rule", "_text")
