"""Gradient boosting for quantiles: one model over all keys, trees on the pinball loss, bands calibrated on later rows.

A tree is grown on the sign gradient of the pinball loss (q above the forecast,
q - 1 below), and each leaf moves the forecast by the q-th percentile of what is
left there. Inputs are binned once and rows packed as arrays, without a shuffle;
each level of the trees of all quantiles is one pass that adds up histograms
inside tasks, so what reaches the driver does not depend on the rows. The fitted
trees are a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelcast.config import QUANTILES
from panelcast.functions.scalars import compressed, cyclical, repaired_quantiles
from panelcast.operators.features import HISTORY
from panelcast.operators.sums import array_sum
from panelcast.sources.sinks import shared_folder

BOOST_INPUTS = {
    "past": [f"scaled_{c}" for c in HISTORY],
    "future": ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "is_weekend", "is_holiday"],
    "static": ["log_scale"],
}
INPUTS = [c for g in BOOST_INPUTS.values() for c in g]
BINS = 32
PACK_ROWS = 65_536
#: Ranks that percentiles of leaves may be off by: one in so many rows.
ACCURACY = 10_000
TREES = "quantile double, tree int, node int, input string, threshold double, value double"


def boost_inputs(features: DataFrame, scales: DataFrame) -> DataFrame:
    """History in units of the key's own scale, cyclical calendar, the scale itself; keys without a scale are left out."""
    out = features.join(scales, "key")
    new = {f"scaled_{c}": F.col(c) / F.col("scale") for c in HISTORY} | cyclical("hour", 24, "hour") | cyclical("day_of_week", 7, "day_of_week")
    return out.withColumns(new | {"log_scale": compressed("scale"), "target": F.col("y") / F.col("scale")}).withColumns({c: F.col(c).cast("double") for c in ("is_weekend", "is_holiday")})


@dataclass
class Tree:
    """A complete binary tree as arrays: node i has children 2 i + 1 and 2 i + 2; inputs of -1 mark nodes that do not split."""

    input: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def leaves(self, x: np.ndarray, by_bin: bool) -> np.ndarray:
        """The node in which each row of x, inputs or their bins, ends.

        Nodes are judged for whole columns of x, best kept one after another, and not
        by looking up an input for each row: a compare and a choice, by masks of bits,
        of small numbers.
        """
        limit, small = self.bin if by_bin else self.threshold, np.min_scalar_type(len(self.input))

        def ends(i: int) -> np.ndarray:
            j = self.input[i]
            if j < 0:
                return small.type(i)
            left, right = ends(2 * i + 1), ends(2 * i + 2)
            return right ^ ((left ^ right) & np.negative((x[:, j] <= x.dtype.type(limit[i])).astype(small)))

        return np.broadcast_to(ends(0), len(x))


@dataclass
class QuantileModel:
    """For each quantile a start, its trees and the shift that validation rows ask for."""

    quantiles: tuple[float, ...]
    start: np.ndarray
    inputs: list[str] = field(default_factory=lambda: list(INPUTS))
    trees: list[list[Tree]] = field(default_factory=list)
    shift: np.ndarray | None = None

    def raw(self, k: int, x: np.ndarray, by_bin: bool = False) -> np.ndarray:
        out = np.full(len(x), self.start[k])
        for tree in self.trees[k]:
            out += tree.value[tree.leaves(x, by_bin)]
        return out


# -------------------------------------------------------------------- fitting


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Inputs as rows."""
    return np.stack([np.asarray(batch.column(j).fill_null(np.nan), np.float64) for j in range(n)])


def _packed(edges: list[np.ndarray]):
    """Rows as bins of their inputs and targets, many to one packed row. A missing input is in the last bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                x = _matrix(part, len(edges))
                bins = np.stack([np.searchsorted(e, x[j], "left") for j, e in enumerate(edges)]).astype(np.uint8)
                y = np.asarray(part.column(len(edges)), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["bins", "y"])

    return run


def _rows(bins: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    targets = np.frombuffer(y)
    return np.frombuffer(bins, np.uint8).reshape(-1, len(targets)).T, targets


def _histograms(packed: DataFrame, model: QuantileModel, growing: list[Tree], level: int) -> np.ndarray:
    """Gradient sums and row counts by quantile, node of the level, input and bin."""
    first, n_nodes, n_inputs = (1 << level) - 1, 1 << level, len(model.inputs)
    shape = (len(growing), 2, n_nodes, n_inputs, BINS)

    def of(row: Row) -> np.ndarray:
        bins, y = _rows(*row)
        out = np.zeros(shape)
        for k, tree in enumerate(growing):
            node = tree.leaves(bins, True).astype(np.int64) - first
            cell = 2 * BINS * node + (y > model.raw(k, bins, True))  # a gradient is one of two numbers, so rows above and below are counted
            live = node >= 0  # others ended above
            cell, some = (cell, bins) if live.all() else (cell[live], bins[live])
            for j in range(n_inputs):
                n = np.bincount(cell + 2 * some[:, j].astype(np.int64), minlength=n_nodes * BINS * 2).reshape(n_nodes, BINS, 2)
                out[k, 0, :, j] = model.quantiles[k] * n[..., 1] + (model.quantiles[k] - 1) * n[..., 0]
                out[k, 1, :, j] = n.sum(-1)
        return out.ravel()

    return array_sum(packed, int(np.prod(shape)), of).reshape(shape)


def _split(tree: Tree, level: int, sums: np.ndarray, edges: list[np.ndarray], min_rows: int) -> None:
    """Split each node of the level where that explains most of the gradient."""
    for node in range(1 << level):
        g, n = sums[0, node], sums[1, node]
        left_g, left_n = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
        right_g, right_n = left_g[:, -1:] - left_g, left_n[:, -1:] - left_n
        fits = (left_n >= min_rows) & (right_n >= min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, left_g**2 / left_n + right_g**2 / right_n - (left_g[:, -1:] ** 2) / left_n[:, -1:], -1)
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] > 1e-9 and b < len(edges[j]):
            i = (1 << level) - 1 + node
            tree.input[i], tree.bin[i], tree.threshold[i], tree.gain[i] = j, b, edges[j][b], gain[j, b]


def _residuals(model: QuantileModel, growing: list[Tree]):
    """(k, node, r): what each quantile's forecast leaves, by the leaf of its new tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y = _rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                for k, tree in enumerate(growing):
                    cols = [pa.array(np.full(len(y), k), pa.int32()), pa.array(tree.leaves(bins, True), pa.int32()), pa.array(y - model.raw(k, bins, True))]
                    yield pa.RecordBatch.from_arrays(cols, ["k", "node", "r"])

    return run


def _of_quantile(model_quantiles: tuple[float, ...], values: Column, k: Column) -> Column:
    """The percentile of `values` that goes with quantile number k."""
    return F.get(F.percentile_approx(values, F.array(*[F.lit(float(q)) for q in model_quantiles]), ACCURACY), k)


def fit_quantiles(train: DataFrame, scales: DataFrame, quantiles: tuple[float, ...] = QUANTILES, rounds: int = 10, depth: int = 4, rate: float = 0.3, min_rows: int = 20) -> QuantileModel:
    """Boost one model for each quantile, all in the same passes. Rows without y are left out."""
    spark = train.sparkSession
    rows = boost_inputs(train.filter(F.col("y").isNotNull()), scales).select(*INPUTS, "target")
    written = shared_folder(spark)
    rows.write.parquet(written)
    rows = spark.read.schema(rows.schema).parquet(written)
    probabilities = [b / BINS for b in range(1, BINS)]
    edges = [np.unique(np.array(e, float)) for e in rows.approxQuantile(INPUTS, probabilities, 1 / (8 * BINS))]
    start = rows.agg(F.percentile_approx("target", F.array(*[F.lit(float(q)) for q in quantiles]), ACCURACY)).first()[0]
    model = QuantileModel(tuple(quantiles), np.array(start or [0.0] * len(quantiles)), trees=[[] for _ in quantiles])
    if start is None:
        return model
    path = shared_folder(spark)
    rows.mapInArrow(_packed(edges), "bins binary, y binary").write.parquet(path)
    packed = spark.read.parquet(path)
    for _ in range(rounds):
        growing = [Tree.of_depth(depth) for _ in quantiles]
        for level in range(depth):
            sums = _histograms(packed, model, growing, level)
            for k, tree in enumerate(growing):
                _split(tree, level, sums[k], edges, min_rows)
        left = packed.mapInArrow(_residuals(model, growing), "k int, node int, r double")
        for leaf in left.groupBy("k", "node").agg(_of_quantile(quantiles, F.col("r"), F.col("k")).alias("value")).collect():  # one row a leaf
            growing[leaf["k"]].value[leaf["node"]] = rate * leaf["value"]
        for k, tree in enumerate(growing):
            model.trees[k].append(tree)
    return model


def calibrate(model: QuantileModel, validation: DataFrame, scales: DataFrame) -> QuantileModel:
    """Shift each quantile so that its share of validation rows, none of which training has seen, lies below it."""
    bare = QuantileModel(model.quantiles, model.start, model.inputs, model.trees)
    raw = boost_inputs(validation.filter(F.col("y").isNotNull()), scales).withColumn("raw", raw_quantiles(bare))
    left = [F.percentile_approx(F.col("target") - F.get("raw", k), float(q), ACCURACY).alias(f"q{k}") for k, q in enumerate(model.quantiles)]
    found = raw.agg(*left).first()
    bare.shift = np.array([v or 0.0 for v in found])
    return bare


# ----------------------------------------------------------------- prediction


def raw_quantiles(model: QuantileModel) -> Column:
    """An array of forecasts, in units of the key's scale, from the input columns."""

    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        m = np.asfortranarray(x.to_numpy(float))
        out = np.stack([model.raw(k, m) for k in range(len(model.quantiles))], axis=1)
        return pd.Series(list(out + (0 if model.shift is None else model.shift)))

    return run(F.struct(*model.inputs))


def predict_quantiles(model: QuantileModel, inputs: DataFrame) -> DataFrame:
    """Median with a band from prepared inputs (`boost_inputs`): rescaled, in order, not below zero."""
    raw = inputs.withColumn("raw", raw_quantiles(model))
    q = repaired_quantiles(*[F.get("raw", k) for k in range(3)], scale=F.col("scale"))
    return raw.withColumn("q", q).select("key", "hour_ts", "y", F.get("q", 0).alias("p10"), F.get("q", 1).alias("prediction"), F.get("q", 2).alias("p90"))


def gains(model: QuantileModel) -> list[tuple[str, str, float]]:
    """(group, input, share of all splits' gain), one row an input."""
    total = np.zeros(len(model.inputs))
    for trees in model.trees:
        for tree in trees:
            some = tree.input >= 0
            total += np.bincount(tree.input[some], tree.gain[some], len(model.inputs))
    group = {c: g for g, cols in BOOST_INPUTS.items() for c in cols}
    return [(group[c], c, float(v)) for c, v in zip(model.inputs, total / max(total.sum(), 1e-300), strict=True)]


def trees_table(spark: SparkSession, model: QuantileModel) -> DataFrame:
    """The model as a table: a row a node (children of node i: 2 i + 1 where input <= threshold, else 2 i + 2), leaves with a value; tree -1 has the start and the shift."""
    rows = []
    for k, (q, trees) in enumerate(zip(model.quantiles, model.trees, strict=True)):
        shift = 0.0 if model.shift is None else float(model.shift[k])
        rows.append((float(q), -1, 0, None, None, float(model.start[k]) + shift))
        for t, tree in enumerate(trees):
            reached = {0}
            for i in range(len(tree.input)):
                if i in reached:
                    if tree.input[i] >= 0:
                        reached |= {2 * i + 1, 2 * i + 2}
                        rows.append((float(q), t, i, model.inputs[tree.input[i]], float(tree.threshold[i]), None))
                    else:
                        rows.append((float(q), t, i, None, None, float(tree.value[i])))
    return spark.createDataFrame(rows, TREES)


def scored_by_table(trees: DataFrame, inputs: DataFrame, depth: int) -> DataFrame:
    """(key, hour_ts, quantile, raw): forecasts out of the exported table alone, by one join of each row with all trees.

    The table of trees has a bounded number of rows, whatever the data: its nodes
    are packed as arrays by tree, and the trees by quantile, so that a row meets
    them once a quantile and not once a tree and level.
    """
    place = F.coalesce(*[F.when(F.col("input") == c, F.lit(j)) for j, c in enumerate(INPUTS)])
    nodes = F.map_from_entries(F.collect_list(F.struct("node", F.struct(place.alias("input"), "threshold", "value"))))
    by_tree = trees.groupBy("quantile", "tree").agg(nodes.alias("nodes"))
    every = F.transform(F.sequence(F.lit(0), F.lit((2 << depth) - 2)), lambda i: F.try_element_at("nodes", i))  # node i at place i, null where the tree has none
    models = by_tree.select("quantile", every.alias("nodes")).groupBy("quantile").agg(F.collect_list("nodes").alias("trees"))
    x = F.array(*[F.col(c).cast("double") for c in INPUTS])
    both = inputs.select("key", "hour_ts", x.alias("x")).crossJoin(F.broadcast(models))

    def ended(tree):
        step = lambda at, _: F.when(F.get(tree, at)["input"].isNull(), at).when(F.get("x", F.get(tree, at)["input"]) <= F.get(tree, at)["threshold"], 2 * at + 1).otherwise(2 * at + 2)
        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))["value"]

    return both.select("key", "hour_ts", "quantile", F.aggregate("trees", F.lit(0.0), lambda s, tree: s + ended(tree)).alias("raw"))
