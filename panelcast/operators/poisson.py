"""Poisson regression of a panel: hours of the week, numeric inputs and a level of each key, fitted jointly.

A key's level has a closed form once the rest is given: the sum of its counts
over the sum of its rates. Put into the likelihood it leaves a problem in the
shared weights alone, whose gradient and Hessian are sums over keys; each Newton
step is one pass that adds them up inside tasks. So the model is as wide as the
hours of a week and its inputs, however many keys there are, and on the training
rows the forecasts of each key, and of each hour of the week, add up to what was
counted.

Training rows are packed once, sorted by key, as runs of whole keys; the passes
read those and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from panelcast.functions.scalars import hour_of_week
from panelcast.operators.features import HISTORY
from panelcast.operators.keyed import changes, whole_keys
from panelcast.operators.sums import array_sum
from panelcast.sources.sinks import shared_folder

HOURS = 168
#: Panel rows of a run of keys, and bytes of a row group of runs: a task reads a whole group at once.
RUN_ROWS, GROUP_BYTES = 4_096, 8 << 20
#: Weight of an hour of the week in which nothing was ever counted; its best one is minus infinity.
NEVER = -30.0


@dataclass
class PoissonModel:
    """Weights of hours of the week and of standardized inputs, and the level of each key."""

    hours: list[float]
    weights: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    levels: DataFrame
    overall: float
    extra: tuple[str, ...]
    steps: int


def _inputs(extra: tuple[str, ...]) -> dict[str, Column]:
    """Numeric inputs by name; history as log1p."""
    plain = {c: F.col(c).cast("double") for c in ("is_holiday", *extra)}
    return plain | {f"log_{c}": F.log1p(F.col(c).cast("double")) for c in HISTORY}


def _standard(name: str, column: Column, model_means: dict[str, float], deviations: dict[str, float], fill: bool) -> Column:
    z = (column - F.lit(model_means[name])) / F.lit(deviations[name])
    return F.coalesce(z, F.lit(0.0)) if fill else z


# -------------------------------------------------------------------- packing


def _packed(q: int):
    """Rows sorted by key as runs of whole keys: the keys, how many rows each has, and the rows' numbers as buffers."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column(0).combine_chunks()
        new = np.array(changes(key), np.int64)
        counts = np.diff(np.append(new, len(key))).astype(np.int64)
        x = np.stack([np.asarray(rows.column(3 + j), np.float64) for j in range(q)], axis=1)
        cols = [np.asarray(rows.column(1), np.float64), np.asarray(rows.column(2), np.int16), x]
        keys = key.take(pa.array(new))
        return pa.RecordBatch.from_arrays([pa.array([keys.to_pylist()], pa.list_(key.type)), *[pa.array([c.tobytes()], pa.binary()) for c in (counts, *cols)]], ["keys", "counts", "y", "hour", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, 0, RUN_ROWS):
            yield emit(rows)

    return run


class Run:
    """A run of keys under given weights: rates, levels and expected counts."""

    def __init__(self, row: Row, weights: np.ndarray):
        counts = np.frombuffer(row["counts"], np.int64)
        self.y, self.hour = np.frombuffer(row["y"], np.float64), np.frombuffer(row["hour"], np.int16).astype(np.int64)
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.y), -1)
        self.key = np.repeat(np.arange(len(counts)), counts)
        self.n_keys = len(counts)
        self.eta = weights[:HOURS][self.hour] + self.x @ weights[HOURS:]
        self.rate = np.exp(self.eta)
        self.seen, self.rated = (np.bincount(self.key, v, self.n_keys) for v in (self.y, self.rate))
        self.level = self.seen / self.rated
        self.mu = self.rate * self.level[self.key]

    def score(self) -> np.ndarray:
        miss = self.y - self.mu
        return np.concatenate([np.bincount(self.hour, miss, HOURS), self.x.T @ miss])

    def likelihood(self) -> float:
        some = self.y > 0
        return float((self.y[some] * np.log(self.mu[some])).sum() - self.mu.sum())

    def information(self) -> np.ndarray:
        """Of the shared weights, with the keys' levels at their best for each."""
        q = self.x.shape[1]
        out = np.zeros((HOURS + q, HOURS + q))
        out[range(HOURS), range(HOURS)] = np.bincount(self.hour, self.mu, HOURS)
        for j in range(q):
            out[:HOURS, HOURS + j] = out[HOURS + j, :HOURS] = np.bincount(self.hour, self.mu * self.x[:, j], HOURS)
        out[HOURS:, HOURS:] = (self.x * self.mu[:, None]).T @ self.x
        by_key = np.zeros((self.n_keys, HOURS + q))
        by_key[:, :HOURS] = np.bincount(self.key * HOURS + self.hour, self.mu, self.n_keys * HOURS).reshape(self.n_keys, HOURS)
        for j in range(q):
            by_key[:, HOURS + j] = np.bincount(self.key, self.mu * self.x[:, j], self.n_keys)
        some = self.seen > 0
        return out - by_key[some].T @ (by_key[some] / self.seen[some][:, None])


def _levels(weights: np.ndarray):
    def run(row: Row) -> Iterator[tuple]:
        r = Run(row, weights)
        return zip(row["keys"], r.level.tolist(), r.seen.tolist(), r.rated.tolist(), strict=True)

    return run


# -------------------------------------------------------------------- fitting


def fit_poisson(train: DataFrame, extra: tuple[str, ...] = (), max_iter: int = 25, tolerance: float = 1e-8) -> PoissonModel:
    """Maximum likelihood of counts y with log-rate: hour of the week + inputs + the key's level.

    `extra` names further numeric inputs; a null in one of them counts as its
    mean. Rows without y or without their whole history are left out. A key has
    at most a row an hour; a run holds whole keys, so that bounds what a task
    holds. A key that was never counted has level 0.
    """
    extra = tuple(extra)
    spark = train.sparkSession
    inputs = _inputs(extra)
    known = train.dropna(subset=["y", *HISTORY]).select("key", F.col("y").cast("double").alias("y"), hour_of_week().cast("int").alias("hour"), *[c.alias(n) for n, c in inputs.items()])
    facts = known.agg(*[F.avg(n).alias(f"m_{n}") for n in inputs], *[F.stddev_pop(n).alias(f"s_{n}") for n in inputs]).first()
    means, deviations = ({n: float(facts[f"{k}_{n}"] or 0) for n in inputs} for k in "ms")
    deviations = {n: v or 1.0 for n, v in deviations.items()}
    standard = known.select("key", "y", "hour", *[_standard(n, F.col(n), means, deviations, True).alias(n) for n in inputs])
    kind = dict(train.dtypes)["key"]
    path = shared_folder(spark)
    standard.repartition("key").sortWithinPartitions("key").mapInArrow(_packed(len(inputs)), f"keys array<{kind}>, counts binary, y binary, hour binary, x binary").write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    runs = spark.read.parquet(path)
    start = np.zeros(HOURS + len(inputs))
    for row in known.groupBy("hour").agg(F.sum("y").alias("y")).filter("y = 0").collect():  # an hour of the week a row
        start[row["hour"]] = NEVER
    weights, steps = _newton(runs, start, max_iter, tolerance)
    levels_path = shared_folder(spark)
    spark.createDataFrame(runs.rdd.flatMap(_levels(weights)), f"key {kind}, level double, seen double, rated double").write.parquet(levels_path)
    levels = spark.read.parquet(levels_path)
    overall = levels.agg(F.try_divide(F.sum("seen"), F.sum("rated"))).first()[0]
    return PoissonModel(weights[:HOURS].tolist(), dict(zip(inputs, weights[HOURS:].tolist(), strict=True)), means, deviations, levels.select("key", "level"), float(overall or 0), extra, steps)


def _newton(runs: DataFrame, weights: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, int]:
    """The best shared weights from a start, those of NEVER kept, and the steps that it took; a step that lowers the likelihood is halved."""
    p, free = len(weights), weights != NEVER

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(row: Row) -> np.ndarray:
            r = Run(row, weights)
            return np.concatenate([[r.likelihood()], r.score(), r.information().ravel()])

        total = array_sum(runs.drop("keys"), 1 + p + p * p, of)
        return float(total[0]), total[1 : 1 + p] * free, total[1 + p :].reshape(p, p) * np.outer(free, free)

    value, score, information = at(weights)
    for k in range(1, max_iter + 1):
        # levels and hours share a constant, so one direction is flat: the damping holds it without moving the optimum
        damped = information + np.eye(p) * max(1e-9, 1e-9 * np.trace(information) / p)
        step = np.linalg.solve(damped, score)
        gain = float(score @ step)  # twice what the step should add to the likelihood
        if gain <= tolerance:
            return weights + step, k
        while True:
            next_value, next_score, next_information = at(weights + step)
            if next_value >= value - 1e-9 * abs(value) or np.abs(step).max() < tolerance:
                break
            step = step / 2
        weights = weights + step
        value, score, information = next_value, next_score, next_information
    return weights, max_iter


def predict_poisson(model: PoissonModel, features: DataFrame) -> DataFrame:
    """features with `prediction`: rate times level; unknown keys have the overall level, rows without their history none."""
    inputs = _inputs(model.extra)
    hours = F.element_at(F.array(*[F.lit(v) for v in model.hours]), hour_of_week().cast("int") + 1)
    z = [F.lit(w) * _standard(n, inputs[n], model.means, model.deviations, n in model.extra) for n, w in model.weights.items()]
    rate = F.exp(sum(z, hours))
    known = model.levels.withColumnRenamed("level", "__level")
    return features.join(known, "key", "left").withColumn("prediction", F.coalesce("__level", F.lit(model.overall)) * rate).drop("__level")
