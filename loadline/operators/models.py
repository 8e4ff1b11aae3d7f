"""Training, selection, persistence and application of models on look-back windows.

One set of models per machine kind: state (all rows), cycle position and job type (rows inside cycles), all linear in
one input vector: the normalised channels of the last L rows, their mean squares and a constant.

The vectors (485 numbers a row for four channels and 120 rows) are never written or shuffled.  Rows go to blocks with
the L - 1 rows before them; a task cuts windows as views of a block, some thousand at a time, and returns sums only:

* one job for the Gram matrices and the least squares of the position,
* one job a round for loss and gradient of both classifiers, of all machine kinds and all candidates,
* one job for the metrics of every candidate on every split.

The classifiers are multinomial with a quadratic penalty.  Half the Gram matrix bounds their curvature, so a step by its inverse never
raises the loss; limited-memory BFGS starts from that inverse and falls back to the plain step where it would.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadline.functions.columns import with_exprs
from loadline.functions.display import job_name, state_name
from loadline.operators.lookback import normalised, training_rows
from loadline.operators.slices import row_range_with_context, trim_context
from loadline.plans.blocks import BLOCK, block_rows, sent_to_blocks
from loadline.plans.staging import stage
from loadline.profiles import PROFILES, profile_of

PREDICTION_COLUMNS = ["ml_state", "ml_state_name", "ml_state_conf", "ml_cycle_pos", "ml_job_type", "ml_job_name"]
STATES = 3
GRID = (0.0, 0.01, 0.1)
ITERATIONS = 30
MEMORY = 8
#: Windows cut at once, windows of a written piece, and parts in which sums of many tasks meet.
CHUNK, PIECE, PARTS = 512, 8192, 8
#: Bytes that a Python worker is handed at once.
BATCH_BYTES = 16 << 20
HISTORY = ("profile string, round int, reg_param double, train_loss double, val_loss double, train_state_acc double, "
           "val_state_acc double, val_cyc_mae double, val_job_acc double")


# ---------------------------------------------------------------- input

def window_vectors(x: np.ndarray, length: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Vectors of all full windows of the rows ``x``, oldest row first, some at a time.

    Mean squares are differences of prefix sums.
    """
    full = len(x) - length + 1
    if full <= 0:
        return
    views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)  # (window, channel, lag)
    squares = np.vstack([np.zeros(x.shape[1]), np.cumsum(x * x, axis=0)])
    for lo in range(0, full, CHUNK):
        at = slice(lo, min(full, lo + CHUNK))
        flat = views[at].transpose(0, 2, 1).reshape(at.stop - lo, -1)
        power = (squares[lo + length:at.stop + length] - squares[at]) / length
        yield at, np.hstack([flat, power, np.ones((len(flat), 1))])


def model_blocks(rows: DataFrame, profiles=PROFILES, look_back: int | None = None) -> DataFrame:
    """Training rows packed by (machine, split, block) in pieces of ``PIECE`` windows, each with the look-back rows before it.

    Per piece: channels as one array, and state, position (NaN: outside cycles) and job type (-1) of its full windows.  Pieces
    are dealt to some files a core, so that the rounds over them keep all cores busy.
    """
    shapes = {p.profile: (look_back or p.look_back, p.model_channels.split(",")) for p in profiles}
    size = block_rows(rows)
    columns = ["machine", "split", "row_idx", "i1", "i2", "i3", "i_avg", "state_label", "cycle_pos", "job_type"]
    sent, _ = sent_to_blocks(rows.select(*columns), "row_idx", before=max(n for n, _ in shapes.values()) - 1)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        machine, split, block = (k.as_py() for k in key)
        profile = machine.split("_")[0]
        length, channels = shapes[profile]
        rows = rows.sort_by("row_idx")
        index = rows.column("row_idx").to_numpy()
        start = max(0, int(np.searchsorted(index, block * size)) - (length - 1))
        rows = rows.slice(start)
        n = max(0, len(rows) - length + 1)
        x = np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in channels], 1), np.float64)
        ends = rows.slice(length - 1)
        position = ends.column("cycle_pos").to_pandas().to_numpy(np.float64)
        state, job = (ends.column(c).to_numpy().astype(np.int32) for c in ("state_label", "job_type"))
        cuts = [(lo, min(n, lo + PIECE)) for lo in range(0, n, PIECE)] or [(0, 0)]
        return pa.Table.from_pylist([{
            "profile": profile, "machine": machine, "split": split, "at": block * size + lo, "windows": hi - lo, "x": x[lo:hi + length - 1].tobytes() if n else b"",
            "state": state[lo:hi].tobytes(), "position": position[lo:hi].tobytes(), "job": job[lo:hi].tobytes()} for lo, hi in cuts], schema=_BLOCK)

    packed = sent.groupBy("machine", "split", BLOCK).applyInArrow(
        pack, "profile string, machine string, split string, at long, windows long, x binary, state binary, position binary, job binary")
    spark = rows.sparkSession
    files = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stage(packed.repartition(files, "machine", "split", "at"), "model-blocks")


_BLOCK = pa.schema([("profile", pa.string()), ("machine", pa.string()), ("split", pa.string()), ("at", pa.int64()), ("windows", pa.int64()),
                    ("x", pa.binary()), ("state", pa.binary()), ("position", pa.binary()), ("job", pa.binary())])


@dataclass
class Shape:
    """What a task needs to cut vectors of a machine kind."""

    look_back: int
    channels: list[str]
    jobs: int = 0

    @property
    def width(self) -> int:
        return (self.look_back + 1) * len(self.channels) + 1


def summed(blocks: DataFrame, shapes: dict[str, Shape], keys: tuple[str, ...], measure: Callable) -> dict[tuple, np.ndarray]:
    """Sums over all windows of ``measure(profile, vectors, state, position, job)``, by profile and ``keys``.

    A task returns one array per group; arrays of many tasks are added in ``PARTS`` parts, and those on the driver.
    """
    spark = blocks.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shape = shapes[row["profile"]]
                if not row["windows"]:
                    continue
                x = np.frombuffer(row["x"]).reshape(-1, len(shape.channels))
                state, job = (np.frombuffer(row[c], np.int32) for c in ("state", "job"))
                position = np.frombuffer(row["position"])
                group = (row["profile"], *(row[k] for k in keys))
                for at, z in window_vectors(x, shape.look_back):
                    got = measure(row["profile"], z, state[at], position[at], job[at])
                    if group in held:
                        held[group] += got
                    else:
                        held[group] = got
        part = TaskContext.get().partitionId() % PARTS
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join(g) for g in held]), pa.array([part] * len(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                             ["key", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in rows["sums"])
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "sums": [np.asarray(total).tobytes()]})

    parts = blocks.mapInArrow(run, "key string, part long, sums binary").groupBy("key", "part").applyInPandas(add, "key string, sums binary")
    out: dict[tuple, np.ndarray] = {}
    for key, sums in parts.collect():  # at most PARTS arrays a group
        group = tuple(key.split("\t"))
        out[group] = out.get(group, 0) + np.frombuffer(sums)
    return out


# ---------------------------------------------------------------- fitting

def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cross_entropies(z: np.ndarray, w: np.ndarray, labels: list[tuple[int, int, np.ndarray]]) -> tuple[list[float], np.ndarray]:
    """Summed losses and gradients of many classifiers over the same rows, in one product each way.

    ``labels`` has for each classifier its columns [lo, hi) of ``w`` and the labels; rows with a label below 0 do not count.
    """
    p, losses = w.T @ z.T, []
    for lo, hi, label in labels:
        own, some = p[lo:hi], label >= 0
        own -= own.max(0)
        np.exp(own, out=own)
        own /= own.sum(0)
        at, known = np.flatnonzero(some), label[some]
        losses.append(float(-np.log(np.maximum(own[known, at], 1e-300)).sum()))
        own[known, at] -= 1
        own[:, ~some] = 0
    return losses, (p @ z).T


def cross_entropy(z: np.ndarray, w: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and gradient of rows with a label of at least 0."""
    losses, grad = cross_entropies(z, w, [(0, w.shape[1], label)])
    return losses[0], grad


@dataclass
class Descent:
    """One classifier: limited-memory BFGS from a curvature bound, one loss and gradient a round."""

    n: float
    reg: float
    bound: np.ndarray            # inverse of a matrix that is never below the curvature
    w: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    safe: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    trial: np.ndarray | None = None
    done: bool = False

    def __post_init__(self) -> None:
        self.trial = self.w

    def penalty(self, w: np.ndarray) -> np.ndarray:
        out = self.reg * w
        out[-1] = 0.0  # the constant is free
        return out

    def take(self, loss: float, grad: np.ndarray) -> None:
        """Loss and gradient sums at ``trial``; sets the next trial."""
        loss = loss / self.n + 0.5 * float((self.trial * self.penalty(self.trial)).sum())
        grad = grad / self.n + self.penalty(self.trial)
        if loss > self.loss:  # the bounded step from the last point can't rise
            self.pairs.clear()
            if self.trial is self.safe:
                self.done = True
            self.trial = self.safe
            return
        if self.grad is not None:
            s, y = self.trial - self.w, grad - self.grad
            if (s * y).sum() > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.done = self.loss - loss < 1e-7 * max(1.0, abs(loss)) if np.isfinite(self.loss) else False
        self.w, self.loss, self.grad = self.trial, loss, grad
        self.safe = self.w - self.bound @ grad
        self.trial = self.w - self.direction()

    def direction(self) -> np.ndarray:
        q, used = self.grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            used.append(a)
        q = self.bound @ q
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return q


def inverse(gram: np.ndarray, reg: float) -> np.ndarray:
    """Inverse of gram + reg, the constant without penalty; a tiny ridge keeps dependent columns apart."""
    ridge = np.full(len(gram), max(reg, 1e-8 * np.trace(gram) / len(gram)) + 1e-12)
    ridge[-1] = 1e-10
    value, vector = np.linalg.eigh(gram + np.diag(ridge))
    return (vector / np.maximum(value, 1e-12)) @ vector.T


@dataclass
class KindModel:
    """Weights of one machine kind; columns of ``job`` are job types, None if no cycle was in the train rows."""

    profile: str
    look_back: int
    channels: list[str]
    reg: float
    state: np.ndarray
    position: np.ndarray | None
    job: np.ndarray | None

    @property
    def job_types(self) -> int:
        return self.job.shape[1] if self.job is not None else 1

    def score(self, z: np.ndarray) -> dict[str, np.ndarray]:
        """ml_state, ml_state_conf, ml_cycle_pos, ml_job_type of vectors, and the probabilities."""
        states = softmax(z @ self.state)
        jobs = softmax(z @ self.job) if self.job is not None else np.ones((len(z), 1))
        position = np.clip(z @ self.position, 0, 1) if self.position is not None else np.zeros(len(z))
        return {"ml_state": states.argmax(1), "ml_state_conf": states.max(1), "ml_cycle_pos": position, "ml_job_type": jobs.argmax(1),
                "states": states, "jobs": jobs}


@dataclass
class Models:
    """Models by machine kind, channel statistics per machine, metrics of every candidate, splits that were too short."""

    kinds: dict[str, KindModel]
    norm: DataFrame
    history: DataFrame
    left_out: DataFrame | None = None


def fit(blocks: DataFrame, shapes: dict[str, Shape], grid=GRID, iterations: int = ITERATIONS) -> dict[str, list[KindModel]]:
    """Candidates of every machine kind, one per regularisation, from the train blocks."""
    train = blocks.filter("split = 'train'")

    def grams(profile, z, state, position, job):
        inside, typed = ~np.isnan(position), job >= 0
        d = z.shape[1]
        whole, inner, jobs = out = np.zeros((3, d, d))
        for i in (False, True):
            for t in (False, True):  # every row is multiplied once
                own = (inside == i) & (typed == t)
                if own.any():
                    some = z if own.all() else z[own]
                    gram = some.T @ some
                    whole += gram
                    if i:
                        inner += gram
                    if t:
                        jobs += gram
        return np.concatenate([[len(z), inside.sum(), typed.sum(), 0.0], out.ravel(), z[inside].T @ position[inside]])

    sums = {g[0]: v for g, v in summed(train, shapes, (), grams).items()}
    heads: dict[tuple, Descent] = {}
    places: dict[tuple, np.ndarray | None] = {}
    for profile, v in sums.items():
        d = shapes[profile].width
        n, n_in, n_job = v[:3]
        whole, inner, jobs = v[4:4 + 3 * d * d].reshape(3, d, d)
        for c, reg in enumerate(grid):
            places[profile, c] = inverse(inner / n_in, max(reg, 1e-4)) @ (v[4 + 3 * d * d:] / n_in) if n_in else None
            heads[profile, c, "state"] = Descent(n, reg, inverse(0.5 * whole / n, reg), np.zeros((d, STATES)))
            if n_job and shapes[profile].jobs:
                heads[profile, c, "job"] = Descent(n_job, reg, inverse(0.5 * jobs / n_job, reg), np.zeros((d, shapes[profile].jobs)))

    for _ in range(iterations):
        live = {k: h for k, h in heads.items() if not h.done}
        if not live:
            break
        now = {p: np.hstack([h.trial for k, h in live.items() if k[0] == p]) for p in {k[0] for k in live}}
        places_of = {p: [(k[2], h.trial.shape[1]) for k, h in live.items() if k[0] == p] for p in now}

        def losses(profile, z, state, position, job):
            labels, at = [], 0
            for head, width in places_of[profile]:
                labels.append((at, at + width, state if head == "state" else job))
                at += width
            lost, grad = cross_entropies(z, now[profile], labels)
            return np.concatenate([part for loss, (lo, hi, _) in zip(lost, labels) for part in ([loss], grad[:, lo:hi].ravel())])

        for (profile,), v in summed(train.filter(F.col("profile").isin(sorted({k[0] for k in live}))), shapes, (), losses).items():
            at = 0
            for key, h in live.items():
                if key[0] == profile:
                    size = h.w.size
                    h.take(float(v[at]), v[at + 1:at + 1 + size].reshape(h.w.shape))
                    at += 1 + size
    return {p: [KindModel(p, shapes[p].look_back, shapes[p].channels, float(reg), heads[p, c, "state"].w, places[p, c],
                          heads[p, c, "job"].w if (p, c, "job") in heads else None) for c, reg in enumerate(grid)] for p in sums}


def candidate_metrics(blocks: DataFrame, shapes: dict[str, Shape], candidates: dict[str, list[KindModel]]) -> dict[tuple[str, str], np.ndarray]:
    """By (profile, split): for each candidate sums of rows, cross entropy, hits; rows inside, squared and
    absolute error of the position; rows with a job, cross entropy, hits."""

    def judge(profile, z, state, position, job):
        out = []
        inside, typed = ~np.isnan(position), job >= 0
        for model in candidates[profile]:
            got = model.score(z)
            gap = got["ml_cycle_pos"][inside] - position[inside]
            types = job[typed]
            known = np.minimum(types, got["jobs"].shape[1] - 1)
            chance = np.where(types < got["jobs"].shape[1], got["jobs"][typed][np.arange(len(types)), known], 0)
            out += [len(z), -np.log(np.maximum(got["states"][np.arange(len(z)), state], 1e-12)).sum(), (got["ml_state"] == state).sum(),
                    len(gap), (gap ** 2).sum(), np.abs(gap).sum(),
                    len(types), -np.log(np.maximum(chance, 1e-12)).sum(), (got["ml_job_type"][typed] == types).sum()]
        return np.array(out, float)

    return {g: v.reshape(-1, 9) for g, v in summed(blocks, shapes, ("split",), judge).items()}


def split_scores(row: np.ndarray, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.5) -> dict[str, float | None]:
    """Loss and metrics from the sums of one candidate and split."""
    n, ce, hits, n_in, square, absolute, n_job, job_ce, job_hits = (float(x) for x in row)
    return {"loss": alpha * ce / n + beta * (square / n_in if n_in else 0.0) + gamma * (job_ce / n_job if n_job else 0.0),
            "state_acc": hits / n, "cyc_mae": absolute / n_in if n_in else None, "job_acc": job_hits / n_job if n_job else None}


def train(labelled: DataFrame, stats: DataFrame, profiles=PROFILES, grid=GRID, iterations: int = ITERATIONS,
          look_back: int | None = None) -> Models:
    """Fit one candidate per regularisation and machine kind, keep the one with least validation loss.

    ``labelled`` are readings with state_label, cycle_pos and job_type, ``stats`` their machine statistics.  Machines with a split
    shorter than the look-back are listed in ``left_out``; a kind without any other machine gets no model.
    ``history`` has train and validation metrics of every candidate.
    """
    spark = labelled.sparkSession
    rows, norm, short = training_rows(labelled, stats, profiles, look_back)
    blocks = model_blocks(rows, profiles, look_back)
    jobs = {r.profile: r.jobs for r in labelled.filter("job_type >= 0").groupBy(profile_of().alias("profile")).agg((F.max("job_type") + 1).alias("jobs")).collect()}
    shapes = {p.profile: Shape(look_back or p.look_back, p.model_channels.split(","), jobs.get(p.profile, 0)) for p in profiles}
    candidates = fit(blocks, shapes, grid, iterations)
    judged = candidate_metrics(blocks.filter("split in ('train', 'val')"), shapes, candidates)
    kinds, history = {}, []
    for profile, models in sorted(candidates.items()):
        seen = {split: [split_scores(r) for r in judged[profile, split]] for split in ("train", "val")}
        best = min(range(len(models)), key=lambda c: (seen["val"][c]["loss"], c))
        kinds[profile] = models[best]
        history += [(profile, c, m.reg, seen["train"][c]["loss"], seen["val"][c]["loss"], seen["train"][c]["state_acc"], seen["val"][c]["state_acc"],
                     seen["val"][c]["cyc_mae"], seen["val"][c]["job_acc"]) for c, m in enumerate(models)]
    return Models(kinds, norm, spark.createDataFrame(history, HISTORY), short)


# ---------------------------------------------------------------- application

_RESULT = T.StructType([T.StructField("ml_state", T.IntegerType()), T.StructField("ml_state_conf", T.DoubleType()),
                        T.StructField("ml_cycle_pos", T.DoubleType()), T.StructField("ml_job_type", T.IntegerType())])


def _applied(readings: DataFrame, norm: DataFrame, lengths: dict[str, tuple[int, list[str]]], scorer: Callable[[], Callable]) -> DataFrame:
    """Readings with the four values of ``scorer()(profile, windows)`` per row with a full window, else NULLs.

    Blocks of rows with the rows before them, so a long log is many tasks; all columns pass through untouched.
    """
    size, columns = block_rows(readings), readings.columns
    names = ("i1", "i2", "i3", "i_avg")
    scaled = normalised(readings.withColumns({f"_raw_{c}": F.col(c) for c in names}), norm)
    # machines without statistics have no model; they come back without predictions
    sent, _ = sent_to_blocks(scaled, "row_idx", before=max([n for n, _ in lengths.values()] or [1]) - 1)
    schema = T.StructType(readings.schema.fields + _RESULT.fields)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        machine, block = key[0].as_py(), key[1].as_py()
        profile = machine.split("_")[0]
        rows = rows.sort_by("row_idx")
        index = rows.column("row_idx").to_numpy()
        first = int(np.searchsorted(index, block * size))
        own = rows.slice(first)
        values = {"ml_state": np.full(len(own), -1, np.int32), "ml_state_conf": np.full(len(own), np.nan), "ml_cycle_pos": np.full(len(own), np.nan),
                  "ml_job_type": np.full(len(own), -1, np.int32)}
        if profile in lengths:
            length, channels = lengths[profile]
            start = max(0, first - (length - 1))
            x = np.stack([rows.column(c).to_numpy() for c in channels], 1).astype(np.float64)[start:]
            score = scorer()
            skip = start + length - 1 - first  # own rows before the first full window
            for at, got in score(profile, x):
                for name in values:
                    values[name][skip + at.start:skip + at.stop] = got[name]
        out = {c: own.column(f"_raw_{c}" if c in names else c) for c in columns}
        masked = values["ml_state"] < 0
        out |= {n: pa.array(v, mask=masked) for n, v in values.items()}
        return pa.table(out)

    known = sent.groupBy("machine", BLOCK).applyInArrow(run, schema)
    lost = readings.join(norm.select("machine"), "machine", "left_anti").withColumns({f.name: F.lit(None).cast(f.dataType) for f in _RESULT.fields})
    return known.unionByName(lost)


def predict(readings: DataFrame, models: Models, profiles=PROFILES) -> DataFrame:
    """Readings + prediction columns; rows without L - 1 rows before them have -1 / NULL / an en dash.

    ``row_idx`` has no gaps inside a machine.  Machines without statistics or model have no predictions.
    """
    kinds = models.kinds
    lengths = {k: (m.look_back, m.channels) for k, m in kinds.items()}

    def scorer():
        return lambda profile, x: ((at, kinds[profile].score(z)) for at, z in window_vectors(x, kinds[profile].look_back))

    return _with_names(_applied(readings, models.norm, lengths, scorer), {k: m.job_types for k, m in kinds.items()}, profiles)


def predict_range(readings: DataFrame, models: Models, start: int, end: int, profiles=PROFILES) -> DataFrame:
    """Predictions of rows [start, end) of every machine, equal to those on the whole log.

    Only the range and the look-back rows before it are scanned; these are cut off again.
    """
    most = max([m.look_back for m in models.kinds.values()] or [1])
    wide = row_range_with_context(readings, start, end, most - 1)
    return trim_context(predict(wide, models, profiles))


def _with_names(out: DataFrame, job_types: dict[str, int], profiles) -> DataFrame:
    out = with_exprs(out, ml_state="coalesce(ml_state, -1)", ml_job_type="coalesce(ml_job_type, -1)")
    extra = {p.profile: p.extra_job_name for p in profiles}
    names = F.lit("–")
    for profile, count in sorted(job_types.items()):
        names = F.when(profile_of() == profile, job_name("ml_job_type", count, extra[profile])).otherwise(names)
    return out.withColumns({"ml_state_name": state_name("ml_state"), "ml_job_name": names})


# ---------------------------------------------------------------- foreign models

_loaded: dict[str, Callable] = {}


def predict_with(readings: DataFrame, norm: DataFrame, artefact: str, load: Callable[[str], Callable], job_types: dict[str, int],
                 profiles=PROFILES, look_back: int | None = None) -> DataFrame:
    """Apply any saved model: ``load(path)`` gives ``score(profile, windows)``, windows being (n, L, channels).

    The file ``artefact`` is shipped once to each executor and loaded once by each Python worker.  ``score`` returns arrays
    ml_state, ml_state_conf, ml_cycle_pos, ml_job_type.  The name of the file marks it: another model has another name.
    """
    spark = readings.sparkSession
    spark.sparkContext.addFile(artefact)
    name = artefact.rstrip("/").rsplit("/", 1)[-1]
    lengths = {p.profile: (look_back or p.look_back, p.model_channels.split(",")) for p in profiles}

    def scorer():
        if name not in _loaded:
            _loaded[name] = load(SparkFiles.get(name))
        score = _loaded[name]

        def run(profile: str, x: np.ndarray):
            length = lengths[profile][0]
            full = len(x) - length + 1
            if full > 0:
                views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1)
                for lo in range(0, full, CHUNK):
                    at = slice(lo, min(full, lo + CHUNK))
                    yield at, score(profile, views[at])

        return run

    return _with_names(_applied(readings, norm, lengths, scorer), job_types, profiles)


def artefact_bytes(models: Models) -> bytes:
    """All weights as one file that ``load_artefact`` reads without Spark."""
    held = io.BytesIO()
    arrays = {}
    for profile, m in models.kinds.items():
        arrays |= {f"{profile}.{n}": v for n, v in (("state", m.state), ("position", m.position), ("job", m.job)) if v is not None}
    np.savez(held, **arrays)
    return held.getvalue()


def load_artefact(path: str) -> Callable:
    """``score(profile, windows)`` of a file written from ``artefact_bytes``."""
    held = np.load(path)

    def score(profile: str, windows: np.ndarray) -> dict[str, np.ndarray]:
        part = {n: held[f"{profile}.{n}"] if f"{profile}.{n}" in held else None for n in ("state", "position", "job")}
        model = KindModel(profile, windows.shape[1], [], 0.0, **part)
        z = np.hstack([windows.reshape(len(windows), -1), (windows ** 2).mean(1), np.ones((len(windows), 1))])
        return model.score(z)

    return score


# ---------------------------------------------------------------- persistence

_WEIGHTS = ("profile string, look_back int, channels string, reg double, job_types int, state array<double>, position array<double>, job array<double>")


def save_models(models: Models, path: str) -> None:
    """Weights, channel statistics, history and left-out splits below one folder."""
    spark = models.norm.sparkSession
    rows = [(m.profile, m.look_back, ",".join(m.channels), m.reg, m.job_types, m.state.ravel().tolist(),
             m.position.tolist() if m.position is not None else None, m.job.ravel().tolist() if m.job is not None else None) for m in models.kinds.values()]
    spark.createDataFrame(rows, _WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    models.norm.write.mode("overwrite").parquet(f"{path}/norm")
    models.history.coalesce(1).write.mode("overwrite").parquet(f"{path}/history")
    if models.left_out is not None:
        models.left_out.write.mode("overwrite").parquet(f"{path}/left_out")


def load_models(spark: SparkSession, path: str) -> Models:
    kinds = {}
    for r in spark.read.parquet(f"{path}/weights").collect():  # a row a machine kind
        channels = r.channels.split(",")
        kinds[r.profile] = KindModel(r.profile, r.look_back, channels, r.reg, np.array(r.state).reshape(-1, STATES),
                                     np.array(r.position) if r.position is not None else None,
                                     np.array(r.job).reshape(-1, r.job_types) if r.job is not None else None)
    return Models(kinds, spark.read.parquet(f"{path}/norm"), spark.read.parquet(f"{path}/history"))
