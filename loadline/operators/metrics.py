"""Model metrics as one-pass conditional aggregates, joined to nothing.

Input: labelled readings with ml_state, ml_cycle_pos, ml_job_type; rows with
``ml_state < 0`` have no prediction and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.operators.cycles import histogram
from loadline.profiles import STATES

KEYS = ["machine"]


def predicted(rows: DataFrame) -> DataFrame:
    return rows.filter("ml_state >= 0")


def confusion_matrix(rows: DataFrame, true: str = "state_label", pred: str = "ml_state",
                     classes: int = 3) -> DataFrame:
    """Count and row share for every (true, predicted) pair, also pairs that never occur."""
    pairs = [(t, p) for t in range(classes) for p in range(classes)]
    wide = rows.groupBy(*KEYS).agg(*[
        F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"{t}_{p}") for t, p in pairs])
    total = [" + ".join(f"`{t}_{p}`" for p in range(classes)) for t in range(classes)]
    entries = ", ".join(f"{t}, {p}, `{t}_{p}`, {total[t]}" for t, p in pairs)
    long = wide.select(*KEYS, F.expr(
        f"stack({len(pairs)}, {entries}) as (true_class, pred_class, samples, _total)"))
    return with_exprs(long, row_share="case when _total > 0 then samples / _total else 0D end").drop("_total")


def job_confusion(rows: DataFrame, classes: int) -> DataFrame:
    return confusion_matrix(rows.filter("job_type >= 0"), "job_type", "ml_job_type", classes)


def class_report(rows: DataFrame, names=STATES) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    counts = []
    for i in range(len(names)):
        is_true, is_pred = F.col("state_label") == i, F.col("ml_state") == i
        counts += [F.count_if(is_true & is_pred).alias(f"tp_{i}"), F.count_if(is_pred).alias(f"pp_{i}"),
                   F.count_if(is_true).alias(f"tt_{i}")]
    wide = rows.groupBy(*KEYS).agg(*counts)
    k = range(len(names))
    wide = with_exprs(
        wide, **{f"p_{i}": f"case when pp_{i} > 0 then tp_{i} / pp_{i} else 0D end" for i in k},
        **{f"r_{i}": f"case when tt_{i} > 0 then tp_{i} / tt_{i} else 0D end" for i in k},
        _n=" + ".join(f"tt_{i}" for i in k))
    wide = with_exprs(wide, **{
        f"f_{i}": f"case when p_{i} + r_{i} > 0 then 2D * p_{i} * r_{i} / (p_{i} + r_{i}) else 0D end" for i in k})
    rows_of = [f"'{n}', p_{i}, r_{i}, f_{i}, tt_{i}" for i, n in enumerate(names)]
    macro = [f"({' + '.join(f'{s}_{i}' for i in k)}) / {len(names)}D" for s in "prf"]
    weighted = [f"({' + '.join(f'{s}_{i} * tt_{i}' for i in k)}) / _n" for s in "prf"]
    rows_of += [f"'macro avg', {', '.join(macro)}, _n", f"'weighted avg', {', '.join(weighted)}, _n"]
    return wide.select(*KEYS, F.expr(
        f"stack({len(rows_of)}, {', '.join(rows_of)}) as (class, precision, recall, f1, support)"))


def evaluation(rows: DataFrame) -> DataFrame:
    """State accuracy, cycle-position MAE and job accuracy (the last two inside cycles only)."""
    return predicted(rows).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(F.expr("case when state_label = ml_state then 1D else 0D end")).alias("state_acc"),
        F.avg(F.expr("case when cycle_pos >= 0 and not isnan(cycle_pos) then abs(ml_cycle_pos - cycle_pos) end"))
        .alias("cyc_mae"),
        F.avg(F.expr("case when job_type >= 0 then case when job_type = ml_job_type then 1D else 0D end end"))
        .alias("job_acc"))


def multi_task_loss(rows: DataFrame, keys: list[str] | None = None, alpha: float = 1.0,
                    beta: float = 0.5, gamma: float = 0.5) -> DataFrame:
    """alpha * state cross entropy + beta * squared position error + gamma * job cross entropy.

    Needs state_probs and job_probs arrays; position and job count inside cycles only.
    A class that the model never saw has probability 1e-12.
    """
    parts = rows.groupBy(*(keys or KEYS)).agg(
        F.avg(F.expr("-ln(greatest(coalesce(get(state_probs, state_label), 0D), 1e-12D))")).alias("loss_state"),
        F.coalesce(F.avg(F.expr("case when cycle_pos >= 0 then pow(ml_cycle_pos - cycle_pos, 2) end")), F.lit(0.0))
        .alias("loss_cyc"),
        F.coalesce(F.avg(F.expr("case when job_type >= 0 then -ln(greatest(coalesce(get(job_probs, job_type), 0D), 1e-12D)) end")), F.lit(0.0))
        .alias("loss_job"))
    return with_exprs(parts, loss=f"{alpha}D * loss_state + {beta}D * loss_cyc + {gamma}D * loss_job")


def prediction_breakdown(rows: DataFrame) -> DataFrame:
    """Count and share of every predicted state."""
    wide = predicted(rows).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("ml_state") == i).alias(s) for i, s in enumerate(STATES)])
    return (wide.unpivot([*KEYS, "_n"], list(STATES), "state", "samples")
            .withColumn("share_pct", F.col("samples") / F.col("_n") * 100.0).drop("_n"))


def confidence_histogram(rows: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(predicted(rows), KEYS, "ml_state_conf", bins)


def label_agreement(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Automatic label next to the prediction of the same row."""
    return labels.select("machine", "row_idx", "state_label").join(
        predictions.select("machine", "row_idx", "ml_state"), ["machine", "row_idx"])
