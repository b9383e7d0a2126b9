"""Classifier over feature vectors: a perceptron head trained by Adam, a sweep of rates on a given validation split, batch scores.

An epoch is one Spark job for all rates that still run: every task goes through its own rows in
mini-batches, starting from the same weights, and returns what it made of them; weights and moments
are averaged by rows, first in some few tasks, then on the driver. With one partition this is plain
mini-batch training. No row visits the driver; what is broadcast and returned has the head's size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.metrics import from_cells
from attestor.session import prepare

#: Hidden layers, dropout, batch, epochs, patience, seed, and learning rates of the sweep.
HIDDEN, DROPOUT, BATCH, EPOCHS, PATIENCE, SEED, RATES = [512, 128], 0.3, 512, 40, 5, 20260803, [3e-4, 1e-3, 3e-3, 1e-2]
#: Tasks that average the tasks' weights before the driver does.
AVERAGERS = 8


class Head:
    """Layers of rectified units with dropout, and one logit; weights and biases are one flat vector."""

    def __init__(self, dim: int, hidden: list[int], flat: np.ndarray | None = None, seed: int = SEED):
        self.sizes = [dim, *hidden, 1]
        if flat is None:
            rng = np.random.default_rng(seed)
            limits = [1 / np.sqrt(a) for a, b in zip(self.sizes, self.sizes[1:], strict=False)]
            flat = np.concatenate([rng.uniform(-limit, limit, (a + 1) * b) for limit, a, b in zip(limits, self.sizes, self.sizes[1:], strict=False)])
        self.flat = flat

    def layers(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) of each layer, as views."""
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            yield flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]
            at += (a + 1) * b

    def logits(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers(self.flat)):
            x = x @ w + b
            if k < len(self.sizes) - 2:
                x = np.maximum(x, 0)
        return x[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Mean cross-entropy of a batch, and its gradient."""
        inputs, gates, layers = [], [], list(self.layers(self.flat))
        for w, b in layers[:-1]:
            inputs.append(x)
            x = x @ w + b
            gate = (x > 0) / (1 - dropout)
            if dropout:
                gate *= rng.random(x.shape) >= dropout
            gates.append(gate)
            x = x * gate
        inputs.append(x)
        logit = (x @ layers[-1][0] + layers[-1][1])[:, 0]
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        out, d = np.empty_like(self.flat), ((1 / (1 + np.exp(-logit)) - y) / len(y))[:, None]
        for k, (gw, gb) in reversed(list(enumerate(self.layers(out)))):
            gw[:], gb[:] = inputs[k].T @ d, d.sum(axis=0)
            if k:
                d = (d @ layers[k][0].T) * gates[k - 1]
        return loss, out

    def digest(self) -> str:
        """SHA-256 of the sizes and weights."""
        return hashlib.sha256(json.dumps(self.sizes).encode() + self.flat.astype("<f8").tobytes()).hexdigest()


class Training:
    """A head on its way: its weights, Adam's moments and steps, the best epoch and how old it is."""

    def __init__(self, rate: float, dim: int, hidden: list[int], seed: int):
        self.rate, self.head = rate, Head(dim, hidden, seed=seed)
        self.state = np.stack([self.head.flat, np.zeros_like(self.head.flat), np.zeros_like(self.head.flat)])
        self.steps, self.stale, self.best, self.history = 0.0, 0, None, []

    def run(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int, dropout: float) -> float:
        """One pass over some rows in shuffled mini-batches; the sum of their losses."""
        total, (flat, m, v) = 0.0, self.state
        head = Head(self.head.sizes[0], self.head.sizes[1:-1], flat)
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            loss, g = head.gradient(x[rows], y[rows], dropout, rng)
            self.steps += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            flat -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            total += loss * len(rows)
        return total

    def judge(self, epoch: int, loss: float, cells: dict, patience: int) -> bool:
        """Note an epoch's validation; is it to go on?"""
        self.history.append({"rate": self.rate, "epoch": epoch, "train_loss": loss, "val_accuracy": cells["accuracy"], "val_macro_f1": cells["macro_f1"]})
        if self.best is None or cells["macro_f1"] > self.best[0]:
            self.best, self.stale = (cells["macro_f1"], epoch, self.state[0].copy()), 0
        else:
            self.stale += 1
        return self.stale < patience


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(batch["features"].to_numpy()).astype(np.float64), batch["y"].to_numpy(dtype=np.float64)


def _epoch(train: DataFrame, running: list[Training], epoch: int, batch: int, dropout: float, seed: int) -> list[float]:
    """Let all trainings go through the rows once; mean losses."""
    shared = train.sparkSession.sparkContext.broadcast(running)
    names = "which int, n long, loss double, steps double, state binary"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import copy

        rows, mine = [b for b in map(_arrays, (b for b in batches if len(b)))], copy.deepcopy(shared.value)
        if not rows:
            return
        x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        for k, one in enumerate(mine):
            loss = one.run(x, y, np.random.default_rng([seed, epoch, k, TaskContext.get().partitionId()]), batch, dropout)
            yield pd.DataFrame([(k, len(y), loss, one.steps, one.state.tobytes())], columns=["which", "n", "loss", "steps", "state"])

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        n, state = int(frame["n"].sum()), sum(np.frombuffer(s) * n for s, n in zip(frame["state"], frame["n"], strict=True))
        return pd.DataFrame([(frame["which"].iloc[0], n, frame["loss"].sum(), (frame["steps"] * frame["n"]).sum() / n, (state / n).tobytes())], columns=["which", "n", "loss", "steps", "state"])

    made = train.mapInPandas(work, names).withColumn("part", F.spark_partition_id() % AVERAGERS)
    some = made.groupBy("which", "part").applyInPandas(lambda f: average(f.drop(columns="part")), names).toPandas()  # AVERAGERS rows a rate
    losses = []
    for k, one in enumerate(running):
        total = average(some[some["which"] == k].sort_values(["n", "loss"])).iloc[0]
        one.state, one.steps = np.frombuffer(total["state"]).reshape(one.state.shape).copy(), float(total["steps"])
        losses.append(float(total["loss"] / total["n"]))
    return losses


def _validate(val: DataFrame, running: list[Training]) -> list[dict]:
    """accuracy and macro_f1 of each training's weights: one pass, four counts a task."""
    heads = val.sparkSession.sparkContext.broadcast([Head(t.head.sizes[0], t.head.sizes[1:-1], t.state[0]) for t in running])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = _arrays(batch)
                cells = [2 * y.astype(int) + (h.logits(x) > 0) for h in heads.value]
                yield pd.DataFrame([(k, *np.bincount(c, minlength=4).tolist()) for k, c in enumerate(cells)], columns=["which", "tn", "fp", "fn", "tp"])

    counted = val.mapInPandas(count, "which int, tn long, fp long, fn long, tp long").groupBy("which").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    found = {r["which"]: r.asDict() for r in counted.select("which", *from_cells()).collect()}
    return [found.get(k, {"accuracy": 0.0, "macro_f1": 0.0}) for k in range(len(running))]


def sweep(train: DataFrame, val: DataFrame, rates: list[float] = RATES, hidden: list[int] = HIDDEN, epochs: int = EPOCHS, patience: int = PATIENCE, batch: int = BATCH, dropout: float = DROPOUT, seed: int = SEED) -> tuple[Head, list[dict]]:
    """(winner, history) over (id, y, features): the highest validation macro F1 of any rate and epoch, the first of equals.

    Every rate starts from the same weights and stops once its best epoch is ``patience`` epochs old; its
    weights are those of that epoch. ``history`` has a record for each rate and epoch. Features are of
    one length and not null.
    """
    prepare(train.sparkSession)
    rows, held = (df.select(F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features")) for df in (train, val))
    first = rows.select(F.size("features").alias("dim")).first()
    if first is None:
        raise ValueError("nothing to learn from")
    rows, held = rows.checkpoint(), held.checkpoint()
    trainings = [Training(rate, first["dim"], hidden, seed) for rate in rates]
    running = list(trainings)
    for epoch in range(epochs):
        losses = _epoch(rows, running, epoch, batch, dropout, seed)
        judged = [t.judge(epoch, loss, cells, patience) for t, loss, cells in zip(running, losses, _validate(held, running), strict=True)]
        running = [t for t, on in zip(running, judged, strict=True) if on]
        if not running:
            break
    best = max(trainings, key=lambda t: t.best[0])  # max keeps the first of equals
    return Head(first["dim"], hidden, best.best[2]), [h for t in trainings for h in t.history]


def score(head: Head, rows: DataFrame) -> DataFrame:
    """(id, y, score, pred): probability of class 1, decided above 0.5."""
    shared = prepare(rows.sparkSession).sparkContext.broadcast(head)

    @F.pandas_udf("double")
    def probability(features: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in features:
            x = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.empty((0, shared.value.sizes[0]))
            yield pd.Series(1 / (1 + np.exp(-shared.value.logits(x))))

    p = probability(F.col("features").cast("array<double>"))
    return rows.select("id", F.col("y").cast("int").alias("y"), p.alias("score")).withColumn("pred", (F.col("score") > 0.5).cast("int"))


class FrozenModelError(ValueError):
    """A stored head is not the one that was frozen."""


def freeze(spark: SparkSession, head: Head, path: str) -> str:
    """Write a head once, with its digest; returns the digest."""
    row = [(head.sizes, head.flat.tolist(), head.digest())]
    spark.createDataFrame(row, "sizes array<long>, flat array<double>, digest string").coalesce(1).write.mode("errorifexists").parquet(path)
    return head.digest()


def load_frozen(spark: SparkSession, path: str, digest: str | None = None) -> Head:
    """The frozen head; a head that has another digest than stored (or than given) raises."""
    row = spark.read.parquet(path).first()
    head = Head(row["sizes"][0], list(row["sizes"][1:-1]), np.array(row["flat"]))
    if head.digest() != row["digest"] or digest not in (None, row["digest"]):
        raise FrozenModelError(f"{path}: not the frozen head")
    return head
