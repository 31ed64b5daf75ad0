"""Hard-negative mining by vertical scans (BOND): dimensions are columns, read in each anchor's own order of magnitude.

Rows are dealt to blocks that hold one column a dimension and its least and
largest value. For an anchor, the dimensions with its largest components come
first. After some of them each candidate has a partial score; what the remaining
ones can add at least and at most bounds its score, and candidates whose bounds
cannot reach the window asked for, or the best ones already sure to be in it,
leave the bitmap. All dimensions are read for the rest, whose scores are exact.

The anchors are a stated query set: they travel in packed groups to all blocks of
rows. Each block gives its best rows of each anchor and window, and the best of
all blocks are merged.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialize, release

POSITIVES = 5
NEGATIVES = 5
#: Bytes of a block's columns and of a group of anchors; bound what a task holds.
BLOCK_BYTES = 8 << 20
GROUP_BYTES = 1 << 20
LEAST_ROWS = 2048
#: Dimensions that are read between two looks at the bounds.
STEP = 8
_EXACT = float(1 << 53)

_BLOCK = "block long, kind int, part long, data binary"
_ANCHOR = "ablock long, aidx int, anchor_id long, label long, vec binary"
_FOUND = "ablock long, aidx int, anchor_id long, window int, score long, id long, rblock long, ridx int"


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _read(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def scaled(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


# --------------------------------------------------------------------- blocks


def _vectors(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list array as a matrix; shorter ones end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.asarray(col.value_lengths(), dtype=np.int64)
    values = np.asarray(col.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pack_block(dims: int):
    """The rows of one partition as one block: a column a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some = [b for b in batches if b.num_rows]
        if not some:
            return
        rows = pa.Table.from_batches(some)
        ids = rows["vec_id"].combine_chunks()
        matrix = np.ascontiguousarray(_vectors(rows["vec"], dims).T)
        if not matrix.size or np.abs(matrix).max() < 1 << 31:
            matrix = matrix.astype(np.int32)
        data = _dump(cols=matrix, ids=np.asarray(ids.fill_null(0), np.int64), null=np.asarray(ids.is_null()), label=np.asarray(rows["label"], np.int64), anchor=np.asarray(rows["anchor"], bool))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([data], pa.binary())], ["block", "kind", "part", "data"])
        release()

    return run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            b = _read(data.as_py())
            at = np.flatnonzero(b["anchor"])
            vecs = [np.ascontiguousarray(b["cols"][:, i], np.int64).tobytes() for i in at]
            ids = pa.array(b["ids"][at], pa.int64(), mask=b["null"][at])
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), ids, pa.array(b["label"][at], pa.int64()), pa.array(vecs, pa.binary())], ["ablock", "aidx", "anchor_id", "label", "vec"])


def _pack_anchors(group_bytes: int):
    """Anchors with the windows that they ask for, as groups of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = max([16, *(len(v.as_py()) for v in batch.column(4).slice(0, 1))]) + 128
            each = max(1, group_bytes // size)
            for lo in range(0, batch.num_rows, each):
                part = batch.slice(lo, each)
                ids = part.column(2)
                windows = part.column(5).to_pylist()
                data = _dump(
                    ablock=np.asarray(part.column(0), np.int64),
                    aidx=np.asarray(part.column(1), np.int32),
                    ids=np.asarray(ids.fill_null(0), np.int64),
                    null=np.asarray(ids.is_null()),
                    label=np.asarray(part.column(3), np.int64),
                    vecs=np.frombuffer(b"".join(part.column(4).to_pylist()), np.int64).reshape(part.num_rows, -1),
                    sizes=np.array([len(w or ()) // 3 for w in windows], np.int64),
                    windows=np.array([x for w in windows for x in w or ()], np.int64).reshape(-1, 3),
                )
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["part", "data"])
                number += 1

    return run


# ----------------------------------------------------------------------- scan


class Columns:
    """A block of rows by dimension, with each dimension's least and largest value."""

    def __init__(self, data: bytes):
        b = _read(data)
        self.cols, self.ids, self.null, self.label = b["cols"], b["ids"], b["null"], b["label"]
        self.low, self.high = self.cols.min(axis=1).astype(np.int64), self.cols.max(axis=1).astype(np.int64)

    def bond(self, q: np.ndarray, live: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k best rows of the bitmap `live` for each window [lo, hi] of scores; None is no bound."""
        order = np.argsort(-np.abs(q), kind="stable")
        order = order[q[order] != 0]
        ends = np.stack([q[order] * self.low[order], q[order] * self.high[order]])
        # what the dimensions from each one on can add at least and at most
        least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        kind = np.float64 if np.abs(ends).max(axis=0, initial=0).astype(float).sum() < _EXACT else np.int64
        rows = np.flatnonzero(live)
        score = np.zeros(len(rows), kind)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            for d in dims:
                column = self.cols[d]
                score += kind(q[d]) * (column if len(rows) == len(column) else column[rows])
            left = at + len(dims)
            if left < len(order) and len(rows) > k:
                keep = self._may_count(score + least[left], score + most[left], windows, k)
                rows, score = rows[keep], score[keep]
        out = []
        for lo, hi in windows:
            inside = np.ones(len(rows), bool) if lo is None else score >= lo
            if hi is not None:
                inside &= score <= hi
            r, s = rows[inside], score[inside].astype(np.int64)
            if len(r) > k:  # ties of the k-th best stay in for the order by id
                enough = s >= np.partition(s, len(s) - k)[len(s) - k]
                r, s = r[enough], s[enough]
            best = np.lexsort((r, self.ids[r], self.null[r], -s))[:k]
            out.append((r[best], s[best]))
        return out

    @staticmethod
    def _may_count(lower: np.ndarray, upper: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for lo, hi in windows:
            may, sure = np.ones(len(lower), bool), np.ones(len(lower), bool)
            if lo is not None:
                may &= upper >= lo
                sure &= lower >= lo
            if hi is not None:
                may &= lower <= hi
                sure &= upper <= hi
            known = lower[sure]
            if len(known) >= k:
                may &= upper >= np.partition(known, len(known) - k)[len(known) - k]
            keep |= may
        return keep


def _match(k: int, same_label: bool):
    """A sorted stream of blocks, each followed by the groups of anchors: the best rows of each anchor and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = -1, None
        for batch in batches:
            for b, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if kind == 0:
                    number, block = b, Columns(data.as_py())
                elif number == b:
                    yield _group(number, block, _read(data.as_py()), k, same_label)
        release()

    return run


def _group(number: int, block: Columns, a: dict[str, np.ndarray], k: int, same_label: bool) -> pa.RecordBatch:
    out, at = [], np.concatenate([[0], np.cumsum(a["sizes"])])
    for i, q in enumerate(a["vecs"]):
        live = block.label == a["label"][i] if same_label else block.label != a["label"][i]
        if a["ablock"][i] == number:
            live[a["aidx"][i]] = False
        asked = a["windows"][at[i] : at[i + 1]]
        windows = [(int(lo), int(hi)) for _, lo, hi in asked] if not same_label else [(None, None)]
        for w, (rows, scores) in zip(asked[:, 0] if not same_label else [0], block.bond(q, live, windows, k), strict=True):
            if len(rows):
                out.append((np.full(len(rows), i), np.full(len(rows), w), scores, rows))
    i, w, s, r = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [[]] * 4))
    cols = [
        pa.array(a["ablock"][i], pa.int64()),
        pa.array(a["aidx"][i], pa.int32()),
        pa.array(a["ids"][i], pa.int64(), mask=a["null"][i]),
        pa.array(w, pa.int32()),
        pa.array(s, pa.int64()),
        pa.array(block.ids[r], pa.int64(), mask=block.null[r]),
        pa.array(np.full(len(r), number), pa.int64()),
        pa.array(r, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["ablock", "aidx", "anchor_id", "window", "score", "id", "rblock", "ridx"])


# ------------------------------------------------------------------- operator


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and window over all blocks, numbered from 1."""
    w = Window.partitionBy("ablock", "aidx", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rblock", "ridx")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = 80,
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """For each anchor and each of its `positives` best rows of the same label: the best rows of another label
    that score at least least_percent of the positive's score and not more than it.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. A score is the inner product of the components floor(scale *
    x); ties go to the smaller key, null keys last. Rows without a label or
    vector, or with a null or non-finite component, take no part. Vectors of
    different lengths are compared as if the shorter one ended in zeros; an empty
    vector scores 0. Rows that repeat a key are rows of their own. Anchors without
    another row of their label, and positives without such a negative, give no row. Scores
    are 64-bit integers. Other columns are not read. Empty table: no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("vec"))
    rows = named.filter(F.col("label").isNotNull() & _usable("vec")).withColumn("vec", scaled("vec", scale))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = int(size["n"]), int(size["dims"] or 0)
    cores = min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS)
    n_blocks = max(1, cores, math.ceil(n * max(1, dims) * 4 / block_bytes))
    blocks = materialize(rows.repartition(n_blocks).mapInArrow(_pack_block(dims), _BLOCK), "vector-blocks")
    asking = materialize(blocks.mapInArrow(_anchor_rows, _ANCHOR), "anchors")
    no_window = asking.withColumn("windows", F.array().cast("array<long>"))
    best = materialize(_best(_search(blocks, no_window, n_blocks, positives, True, group_bytes), positives), "positives")
    # 100 * score in [least * positive, 100 * positive], in whole numbers
    p = F.col("score")
    floor = F.expr(f"cast(floor((score * {least_percent} + 99) / cast(100 AS decimal(3))) AS long)")
    windows = best.groupBy("ablock", "aidx").agg(F.flatten(F.array_sort(F.collect_list(F.array(F.col("rank").cast("long"), floor, p)))).alias("windows"))
    found = _best(_search(blocks, asking.join(windows, ["ablock", "aidx"]), n_blocks, negatives, False, group_bytes), negatives)
    of = best.select("ablock", "aidx", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.withColumnRenamed("score", "negative_score").join(of, ["ablock", "aidx", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")


def _search(blocks: DataFrame, asking: DataFrame, n_blocks: int, k: int, same_label: bool, group_bytes: int) -> DataFrame:
    """Each group of anchors goes to every block; blocks stay whole."""
    groups = asking.select("ablock", "aidx", "anchor_id", "label", "vec", "windows").mapInArrow(_pack_anchors(group_bytes), "part long, data binary")
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(F.col("block").cast("long").alias("block"), F.lit(1).alias("kind"), "part", "data")
    stream = blocks.unionByName(everywhere).repartition(n_blocks, "block").sortWithinPartitions("block", "kind", "part")
    return stream.mapInArrow(_match(k, same_label), _FOUND)
