"""Toxicity: cumulative-link ordinal regression on sparse word features.

log-odds(grade > k) = score - threshold_k: one weight vector for all thresholds,
so every grade informs the same words. The weights are fitted with an L1 penalty
(accelerated proximal gradient), which leaves few words, and travel to the tasks
as two small arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, materialize, text_slices, words

#: Labelled documents that the model is fitted on, at most; the smallest hashes of their ids and texts.
MAX_LABELLED = 5000
#: Words in fewer of those documents are no features; of the others the most frequent ones are, at most so many.
MIN_DOCS = 3
MAX_FEATURES = 1 << 17
GRADES = 3
PREFIXES = (4, 5)
REJECT_AT = 0.1
L1 = 2e-4
SCREEN_STEPS, FINAL_STEPS = 150, 1500


@dataclass
class OrdinalModel:
    """Weights by word hash (sorted), thresholds in rising order."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        return _sigmoid(score[:, None] - self.thresholds[None, :]).sum(axis=1)

    def scores(self, word_hash: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct known words."""
        out = np.zeros(len(at) - 1)
        if not len(self.features) or not len(word_hash):
            return out
        k = np.minimum(np.searchsorted(self.features, word_hash), len(self.features) - 1)
        known = np.flatnonzero(self.features[k] == word_hash)
        text = np.searchsorted(at, known, "right") - 1
        pair = np.unique(text * len(self.features) + k[known])
        np.add.at(out, pair // len(self.features), self.weights[pair % len(self.features)])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES, l1: float = L1, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for presence features given as (row, column) pairs.

    Minimises the mean negative log-likelihood of the grades plus l1 * |weights|.
    Thresholds start at the label shares; they stay in order, at least 0.1 apart.
    """
    n = max(1, len(grades))
    y = np.clip(grades, 0, n_grades - 1)
    share = np.clip([(y <= k).mean() if len(y) else 0.5 for k in range(n_grades - 1)], 0.5 / n, 1 - 0.5 / n)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 0.1 * np.arange(n_grades - 1))
    w = np.zeros(n_features)
    look, look_t, momentum = w.copy(), theta.copy(), 1.0
    df = np.bincount(cols, minlength=n_features) if len(cols) else np.zeros(n_features)
    # a step for each word, as its curvature is bounded by its own frequency times the usual words a text shares
    rate = 4.0 / (np.sqrt(np.maximum(df, 1) / n) * np.sqrt(max(1.0, len(cols) / n)))
    for _ in range(steps):
        s = np.bincount(rows, look[cols], minlength=len(grades)) if len(cols) else np.zeros(len(grades))
        edge = np.concatenate([[-np.inf], look_t, [np.inf]])
        hi, lo = _sigmoid(np.minimum(edge[y + 1], 500) - s), _sigmoid(np.maximum(edge[y], -500) - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (dhi - dlo) / n  # d(-log p)/ds
        g = np.bincount(cols, g_s[rows], minlength=n_features) if len(cols) else w * 0
        g_t = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            g_t[k] = (-dhi[y == k].sum() + dlo[y == k + 1].sum()) / n
        new = look - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_t = np.clip(look_t - 2.0 * g_t, -20, 20)
        new_t = np.maximum.accumulate(new_t - 0.1 * np.arange(len(new_t))) + 0.1 * np.arange(len(new_t))
        nxt = 0.5 * (1 + np.sqrt(1 + 4 * momentum**2))
        if np.dot(look - new, new - w) > 0:  # overshot: start the momentum anew
            nxt = 1.0
        look, look_t = new + (momentum - 1) / nxt * (new - w) * (nxt > 1), new_t + (momentum - 1) / nxt * (new_t - theta) * (nxt > 1)
        w, theta, momentum = new, new_t, nxt
    return w, theta


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and of their first 4 and 5 bytes, and the n+1 offsets of the texts."""
    low, s, e, at = words(*buffers(batch.column(batch.schema.get_field_index("text"))))
    out = np.zeros((len(s), 1 + len(PREFIXES)), dtype=np.uint64)
    if len(s):
        roll = RollingHash(low)
        out[:, 0] = roll.of(s, e)
        for k, n in enumerate(PREFIXES):
            out[:, k + 1] = roll.of(s, np.minimum(e, s + n)) ^ np.uint64(n)
    return out.reshape(-1), at * out.shape[1]


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        h, at = _features(batch)
        sets = [np.unique(h[a:b].view(np.int64)) for a, b in zip(at[:-1], at[1:], strict=True)]
        own = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "grade")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.list_(pa.int64()))], ["row", "grade", "words"])


def labelled_sets(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(row, grade, words) of at most max_labelled labelled documents, a set of hashed words and word beginnings each.

    The bound holds for the rows that are learned from, after the join: of rows
    that repeat id and text one counts, and rows that share an id but no text are
    documents of their own. Rows are chosen by hash before words are looked for, so
    no more than max_labelled texts are shuffled, whatever share of all rows one id has.
    """
    known = labels.filter("grade is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "grade").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the sample has max_labelled rows of two numbers at most, chosen max_labelled numbers
    rows = texts.join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text", "grade").alias("row"), "grade", "text")
    chosen = rows.select("row").distinct().orderBy("row").limit(max_labelled)
    few = rows.join(F.broadcast(chosen), "row", "left_semi").dropDuplicates(["row"])
    return few.mapInArrow(_word_sets, "row long, grade int, words array<long>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_docs: int = MIN_DOCS, n_grades: int = GRADES, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit on at most max_labelled of the documents that `labels` (doc_id, grade) covers.

    Labels without a grade or a document are left out; null texts are empty ones;
    repeated rows count once. Rare words are left out before anything reaches
    the driver, which sees at most max_features words of max_labelled documents.
    Without any labels the model has no words and gives every text the same low
    severity.
    """
    sets = materialize(labelled_sets(docs, labels, max_labelled), "labelled-sets")
    rows = sets.select("row", "grade").orderBy("row").toArrow()
    ids, grades = np.asarray(rows.column("row"), dtype=np.int64), np.asarray(rows.column("grade"), dtype=np.int64)
    pairs = sets.select("row", F.explode("words").alias("word"))
    frequent = pairs.groupBy("word").count().filter(F.col("count") >= min_docs).orderBy(F.desc("count"), "word").limit(max_features).select("word")
    # at most max_features numbers
    got = pairs.join(F.broadcast(frequent), "word").groupBy("row").agg(F.sort_array(F.collect_list("word")).alias("words")).orderBy("row").toArrow()
    row = np.asarray(got.column("row"), dtype=np.int64)
    lists = got.column("words").combine_chunks()
    words_of, sizes = np.asarray(lists.flatten()).view(np.uint64), np.asarray(pc.list_value_length(lists))
    if not len(words_of):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), 3.0 + np.arange(n_grades - 1))
    vocab = np.unique(words_of)
    c = np.searchsorted(vocab, words_of).astype(np.int32)
    r = np.repeat(np.searchsorted(ids, row).astype(np.int32), sizes)
    del got, lists, words_of
    w, _ = fit_ordinal(r, c, grades, len(vocab), n_grades, steps=SCREEN_STEPS)
    # the penalty has shrunk what it left: fit those words anew with a tenth of it
    live = np.flatnonzero(w)
    slot = np.full(len(w), -1)
    slot[live] = np.arange(len(live))
    on = slot[c] >= 0
    w, theta = fit_ordinal(r[on], slot[c[on]], grades, len(live), n_grades, l1=L1 / 10, steps=FINAL_STEPS)
    return OrdinalModel(vocab[live], w, theta)


def grade_labels(labels: DataFrame) -> DataFrame:
    """Severity grades from the labels table: 0 not toxic, 1 toxic, 2 toxic and of low quality; null stays out."""
    return labels.select("doc_id", (F.col("toxic") * F.when(F.col("quality") == 0, 2).otherwise(1)).cast("int").alias("grade"))


def _severities(model: OrdinalModel, batch: pa.RecordBatch) -> np.ndarray:
    return model.severity(model.scores(*_features(batch)))


def score(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """Per document: expected severity, the likeliest side of each threshold as a grade, whether it is rejected.

    Null and empty texts have no words and get the severity of the thresholds alone.
    Whole texts are scored, however long; rows that repeat are scored one by one;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sev = _severities(model, batch)
            grade = np.floor(sev + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sev), pa.array(grade), pa.array(sev >= reject_at)], ["doc_id", "severity", "grade", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs, all columns, below the severity limit.

    Null and empty texts have the severity of the thresholds alone; repeated rows and
    whole texts, however long, are judged one by one; an empty table stays empty. No
    column is added, so names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(_severities(model, batch) < reject_at))

    return docs.mapInArrow(run, docs.schema)
