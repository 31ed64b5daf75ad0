"""Packaged models: an artifact of one file with declared inputs and outputs, loaded once a worker, scoring batches of whole keys.

The artifact is a zip with the pickled model and a JSON of its columns. Spark
hands it to every executor as a file; a Python worker unpacks it at its first
batch and keeps it. Partitions are sorted by key, so a batch holds many whole keys
and the model sees them at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator, SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelcast.operators.keyed import together, whole_keys

#: Rows that a model is given at once, keys whole.
BATCH_ROWS = 65_536
_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Artifact:
    """What a driver knows of a packaged model: its file and its columns, each `name type`."""

    path: str
    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]


def save(model: Any, path: str, inputs: dict[str, str], outputs: dict[str, str]) -> None:
    """Write a model, any object with predict(rows of whole keys, sorted by key and hour) -> rows, with its declared columns, to a local file."""
    # classes and functions of the caller's main program travel by value, those of modules by name
    body = cloudpickle.dumps(model)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("columns.json", json.dumps({"inputs": inputs, "outputs": outputs}))
        z.writestr("model.pkl", body)


def publish(spark: SparkSession, path: str) -> Artifact:
    """Send the artifact at a local path to all executors. Its name there tells its content, so that another version is another file, and the same one is sent once an application: Spark's file server refuses a name from a second path."""
    with zipfile.ZipFile(path) as z:
        columns, body = json.loads(z.read("columns.json")), z.read("model.pkl")
    name = f"model-{hashlib.sha256(body + json.dumps(columns).encode()).hexdigest()[:24]}.zip"
    if not any(sent.endswith(f"/{name}") for sent in spark.sparkContext.listFiles):
        copy = os.path.join(tempfile.mkdtemp(prefix="spark-model-"), name)
        with zipfile.ZipFile(copy, "w") as z:  # without times: the same model is the same file
            z.writestr(zipfile.ZipInfo("columns.json"), json.dumps(columns))
            z.writestr(zipfile.ZipInfo("model.pkl"), body)
        spark.sparkContext.addFile(copy)
    return Artifact(path, name, columns["inputs"], columns["outputs"])


def _load(name: str, loads: Accumulator | None) -> Any:
    """The model of this worker."""
    if name not in _LOADED:
        with zipfile.ZipFile(SparkFiles.get(name)) as z:
            _LOADED[name] = cloudpickle.loads(z.read("model.pkl"))
        if loads is not None:
            loads.add(1)
    return _LOADED[name]


def check_columns(rows: DataFrame, declared: dict[str, str], what: str = "model input") -> None:
    """Fail before any task runs when a declared column is missing or of another type."""
    have = dict(rows.dtypes)
    wrong = [f"{n} {t} (there is {f'{n} {have[n]}' if n in have else 'no such column'})" for n, t in declared.items() if have.get(n) != t]
    if wrong:
        raise ValueError(f"{what} does not have: " + "; ".join(wrong))


def score_batches(rows: DataFrame, artifact: Artifact, key: str = "key", order: str = "hour_ts", n_tasks: int | None = None, loads: Accumulator | None = None) -> DataFrame:
    """Score rows by a packaged model: the declared outputs, for batches of whole keys.

    Input columns are those declared, others are not sent. `loads` counts how
    often a worker loads the model. A key's rows fit into a task: a window has a
    bounded number of hours.
    """
    check_columns(rows, artifact.inputs)
    schema = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in artifact.outputs.items()))
    names, kinds, name = list(artifact.inputs), to_arrow_schema(schema), artifact.name
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, at, BATCH_ROWS):
            yield from one(rows)

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _load(name, loads).predict(rows.select(names).to_pandas())
        lost = [c for c in kinds.names if c not in found.columns]
        if lost:
            raise ValueError(f"the model gives no {', '.join(lost)}; it declares {', '.join(kinds.names)}")
        yield from pa.Table.from_pandas(found[kinds.names], schema=kinds, preserve_index=False).combine_chunks().to_batches()

    dealt = rows.select(*names).repartition(n_tasks, key) if n_tasks else rows.select(*names)
    return together(dealt, key, order).mapInArrow(run, schema)


class WindowQuantiles:
    """A model of windows: mean and percentiles of the hours before for each row without a value."""

    def __init__(self, low: float = 0.1, high: float = 0.9):
        self.low, self.high = low, high

    def predict(self, rows: pd.DataFrame) -> pd.DataFrame:
        past = rows.dropna(subset=["y"]).groupby("key")["y"]
        stats = pd.DataFrame({"prediction": past.mean(), "p10": past.quantile(self.low), "p90": past.quantile(self.high)})
        return rows.loc[rows["y"].isna(), ["key", "hour_ts"]].merge(stats, left_on="key", right_index=True)
