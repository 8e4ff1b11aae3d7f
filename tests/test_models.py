"""Job clusters and models: invariants, plain numpy, persistence, ranges, foreign models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadline.functions.columns import with_exprs
from loadline.operators import lookback, metrics, models
from loadline.operators.cycles import named_jobs
from loadline.operators.jobs import TOLERANCE, cluster_runs, feature_vectors, job_clusters
from loadline.plans.labelling import Labelling
from loadline.plans.staging import new_path, stage
from loadline.profiles import CONVEYER, ROBO
from loadline.sources import events


def duration_cycles(spark):
    rows = [(m, i, float(d), 0.5 + d / 100, 0.01, 0.5) for m in ("conveyer_1", "conveyer_2")
            for i, d in enumerate([10, 11, 12, 9, 80, 82, 79, 10, 81])]
    rows.append(("conveyer_3", 0, 12.0, 0.5, 0.01, 0.5))
    return rows, spark.createDataFrame(rows, "machine string, cycle_id bigint, duration_s double, mean_iavg double, "
                                             "std_iavg double, mean_i23 double").withColumn(
        "log_duration", F.log10(F.col("duration_s") + 1))


def test_job_clusters_separate_and_are_ordered_by_duration(spark):
    rows, df = duration_cycles(spark)
    jobs = stage(job_clusters(df))
    got = {(r.machine, r.cycle_id): r.job_type for r in jobs.collect()}
    assert len(got) == 19
    for m, i, d, *_ in rows:
        assert got[m, i] == (0 if d < 50 else 1)
    names = {(r.machine, r.job_type): r.job_name for r in named_jobs(jobs).collect()}
    assert names == {("conveyer_1", 0): "Light Load", ("conveyer_1", 1): "Heavy Load", ("conveyer_2", 0): "Light Load",
                     ("conveyer_2", 1): "Heavy Load", ("conveyer_3", 0): "Standard"}  # one cycle, one type
    assert job_clusters(df.limit(0)).collect() == []


def test_every_start_stands_still(spark):
    _, df = duration_cycles(spark)
    runs = cluster_runs(feature_vectors(df)).collect()
    assert len(runs) == 30 and all(r.moved <= TOLERANCE and 1 <= r.steps <= 300 for r in runs)
    assert {len(r.centroids) for r in runs if r.machine != "conveyer_3"} == {2}


def plain_vectors(x, length):
    """Window vectors row by row."""
    return np.array([np.concatenate([x[i:i + length].ravel(), (x[i:i + length] ** 2).mean(0), [1.0]]) for i in range(len(x) - length + 1)])


def test_window_vectors_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 7)
    x = np.random.default_rng(1).normal(size=(60, 3))
    got = np.vstack([z for _, z in models.window_vectors(x, 12)])
    assert np.allclose(got, plain_vectors(x, 12))
    assert list(models.window_vectors(x[:11], 12)) == []


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    z, w, label = rng.normal(size=(40, 5)), rng.normal(size=(5, 3)), rng.integers(-1, 3, 40)
    loss, grad = models.cross_entropy(z, w, label)
    for i in range(5):
        for c in range(3):
            step = np.zeros_like(w)
            step[i, c] = 1e-6
            up, down = models.cross_entropy(z, w + step, label)[0], models.cross_entropy(z, w - step, label)[0]
            assert abs((up - down) / 2e-6 - grad[i, c]) < 1e-4
    assert loss > 0


def test_many_classifiers_at_once_equal_one_by_one():
    rng = np.random.default_rng(5)
    z, w = rng.normal(size=(50, 6)), [rng.normal(size=(6, k)) for k in (3, 2, 3)]
    labels = [rng.integers(0, 3, 50), rng.integers(-1, 2, 50), np.full(50, -1)]
    losses, grad = models.cross_entropies(z, np.hstack(w), [(0, 3, labels[0]), (3, 5, labels[1]), (5, 8, labels[2])])
    for loss, own, lo, hi, label in zip(losses, w, (0, 3, 5), (3, 5, 8), labels):
        some = label >= 0
        p = models.softmax(z[some] @ own)
        assert np.isclose(loss, -np.log(p[np.arange(some.sum()), label[some]]).sum())
        assert np.allclose(grad[:, lo:hi], z[some].T @ (p - np.eye(hi - lo)[label[some]]))


def test_descent_reaches_the_minimum_and_never_rises():
    rng = np.random.default_rng(3)
    z = np.hstack([rng.normal(size=(300, 6)), np.ones((300, 1))])
    label = (z[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int) + (z[:, 1] > 1)
    head = models.Descent(300, 0.01, models.inverse(0.5 * z.T @ z / 300, 0.01), np.zeros((7, 3)))
    seen = []
    for _ in range(60):
        head.take(*models.cross_entropy(z, head.trial, label))
        seen.append(head.loss)
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    grad = models.cross_entropy(z, head.w, label)[1] / 300 + head.penalty(head.w)
    assert np.abs(grad).max() < 1e-2 and seen[-1] < 0.6 * seen[0]


def test_lookback_moments_equal_arrays(spark, blocks):
    if blocks < 30:
        pytest.skip("blocks shorter than the look-back")
    rows = events.readings(spark, "/root/testdata/sf0.001").withColumn("split", F.when(F.col("row_idx") < 90, "train").otherwise("test"))
    arrays = with_exprs(lookback.lookback(rows, ["machine", "split"], look_back=20), m="transform(sequence(0, size(x[0]) - 1), c -> aggregate(x, 0D, (t, r) -> t + r[c]) / size(x))",
                        p="transform(sequence(0, size(x[0]) - 1), c -> aggregate(x, 0D, (t, r) -> t + r[c] * r[c]) / size(x))")
    want = {(r.machine, r.row_idx): r.m + r.p for r in arrays.collect()}
    got = {(r.machine, r.row_idx): r.look_mean + r.look_power for r in lookback.lookback_moments(rows, ["machine", "split"], look_back=20).collect()}
    assert got.keys() == want.keys() and len(got) > 500
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


@pytest.fixture(scope="module")
def trained(spark):
    mine = events.readings(spark, "/root/testdata/sf0.01").filter("machine in ('robo', 'conveyer')")
    # a machine whose log is too short for a model must not stop the others
    short = mine.filter("machine = 'robo' and row_idx < 60").withColumn("machine", F.lit("robo_9"))
    lab = Labelling(stage(mine.unionByName(short)), (ROBO, CONVEYER))
    labelled = stage(lab.samples)
    return models.train(labelled, lab.stats, (ROBO, CONVEYER), grid=(0.01,), iterations=12), labelled, lab


def test_short_logs_are_reported(trained):
    model, _, _ = trained
    assert {(r.machine, r.split) for r in model.left_out.collect()} == {("robo_9", "val"), ("robo_9", "test")}
    assert set(model.kinds) == {"robo", "conveyer"}
    assert model.history.count() == 2


def test_training_blocks_are_dealt_in_pieces(spark, trained, monkeypatch):
    _, labelled, lab = trained
    rows, _, _ = lookback.training_rows(labelled, lab.stats, (ROBO, CONVEYER))
    monkeypatch.setattr(models, "PIECE", 1 << 30)
    whole = models.model_blocks(rows, (ROBO, CONVEYER)).collect()
    monkeypatch.setattr(models, "PIECE", 100)
    pieces = sorted(models.model_blocks(rows, (ROBO, CONVEYER)).collect(), key=lambda r: r["at"])
    assert len(pieces) > 4 * len(whole) and max(r.windows for r in pieces) == 100
    for r in whole:
        mine = [p for p in pieces if (p.machine, p.split) == (r.machine, r.split)]
        assert all(b"".join(p[c] for p in mine) == r[c] for c in ("state", "position", "job"))
        width = len(r.x) // 8 // (r.windows + 29)
        x, at = np.frombuffer(r.x).reshape(-1, width), 0
        for p in mine:
            assert (np.frombuffer(p.x).reshape(-1, width) == x[at:at + p.windows + 29]).all()
            at += p.windows


def test_model_beats_majority_and_survives_saving(spark, trained):
    model, labelled, lab = trained
    path = new_path(spark, "model-test")
    models.save_models(model, path)
    loaded = models.load_models(spark, path)
    for machine in ("robo", "conveyer"):
        last = stage(lookback.last_rows(labelled, lab.stats).filter(F.col("machine") == machine))
        out = stage(models.predict(last, loaded, (ROBO, CONVEYER)))
        result = metrics.evaluation(out).first()
        mine = labelled.filter(F.col("machine") == machine)
        share = mine.groupBy("state_label").count().agg(F.max("count")).first()[0] / mine.count()
        assert result.n_valid == last.count() - 29
        assert result.state_acc > share
        first = out.orderBy("row_idx").limit(29).collect()
        assert {(r.ml_state, r.ml_state_name, r.ml_job_type, r.ml_cycle_pos) for r in first} == {(-1, "–", -1, None)}
        assert out.filter("ml_state >= 0 and (ml_cycle_pos < 0 or ml_cycle_pos > 1)").isEmpty()
    unknown = models.predict(labelled.filter("machine = 'robo_9'"), loaded, (ROBO, CONVEYER))
    assert {(r.ml_state, r.ml_job_type, r.ml_state_name) for r in unknown.collect()} == {(-1, -1, "–")}  # no statistics, no prediction


def test_predictions_equal_plain_numpy(trained):
    model, labelled, _ = trained
    rows = sorted(models.predict(labelled.filter("machine = 'robo'"), model, (ROBO, CONVEYER)).collect(), key=lambda r: r.row_idx)
    norm = {r.machine: r for r in model.norm.collect()}["robo"]
    x = np.array([[(r.i1 - norm.mean_i1) / norm.std_i1, (r.i_avg - norm.mean_i_avg) / norm.std_i_avg] for r in rows])
    kind = model.kinds["robo"]
    z = plain_vectors(x, 30)
    states = models.softmax(z @ kind.state)
    assert [r.ml_state for r in rows[29:]] == states.argmax(1).tolist()
    assert np.allclose([r.ml_state_conf for r in rows[29:]], states.max(1))
    assert np.allclose([r.ml_cycle_pos for r in rows[29:]], np.clip(z @ kind.position, 0, 1))


def test_predictions_over_many_blocks(spark, trained):
    model, labelled, _ = trained
    key = ["machine", "row_idx", "ml_state", "ml_job_type"]
    whole = sorted(tuple(r) for r in models.predict(labelled, model, (ROBO, CONVEYER)).select(key).collect())
    spark.conf.set("spark.loadline.blockRows", "64")
    try:
        cut = sorted(tuple(r) for r in models.predict(labelled, model, (ROBO, CONVEYER)).select(key).collect())
        part = sorted(tuple(r) for r in models.predict_range(labelled, model, 100, 333, (ROBO, CONVEYER)).select(key).collect())
    finally:
        spark.conf.unset("spark.loadline.blockRows")
    assert cut == whole
    assert part == [r for r in whole if 100 <= r[1] < 333]


def test_foreign_model(spark, trained, tmp_path):
    model, labelled, _ = trained
    path = tmp_path / "weights-1.npz"
    path.write_bytes(models.artefact_bytes(model))
    mine = labelled.filter("machine <> 'robo_9'")
    types = {k: m.job_types for k, m in model.kinds.items()}
    key = ["machine", "row_idx", "ml_state", "ml_state_name", "ml_job_type", "ml_job_name"]
    out = models.predict_with(mine, model.norm, str(path), models.load_artefact, types, (ROBO, CONVEYER))
    own = models.predict(mine, model, (ROBO, CONVEYER))
    assert sorted(tuple(r) for r in out.select(key).collect()) == sorted(tuple(r) for r in own.select(key).collect())
