"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

The rarity of a byte window is its self-information under the byte pairs of all
documents, the sum of -log2 P(byte | byte before). The windows that are rarest
within their surroundings are a text's features; each sets a few bits of a Bloom
filter, and when one has its share of features the next begins. Two digests are
compared by the bit overlap of their filters beyond what chance explains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, materialize, release, table_bytes, text_slices

WINDOW = 16
#: A feature's window is the rarest of those that start at most so many bytes from it.
REACH = 12
FILTER_BYTES = 256
#: Features in a filter; each sets BITS bits.
FEATURES = 160
BITS = 5
SPREADS = 2.5
#: Text bytes of a range, about, and how many ranges there are at most. A range is read in order, slice by slice: its size costs time, not memory.
RANGE_BYTES = 16 << 20
MAX_RANGES = 100_000
SLICE = 1 << 20


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each byte, over all whole texts: 256 x 256, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in text_slices(batches):
            data, offsets = buffers(batch.column(0))
            if len(data) > 1:
                inner = np.ones(len(data) - 1, dtype=bool)
                cut = offsets[1:-1]
                inner[cut[(cut > 0) & (cut < len(data))] - 1] = False
                total += np.bincount((data[:-1].astype(np.int64) << 8 | data[1:])[inner], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, dtype=np.int64)
    out[np.asarray(rows.column("pair"), dtype=np.int64)] = np.asarray(rows.column("n"), dtype=np.int64)
    return out.reshape(256, 256)


def rarity_table(counts: np.ndarray) -> np.ndarray:
    """-log2 P(second | first) in 1/256 bits, as integers so that sums are exact; unseen pairs count a half."""
    smooth = counts + 0.5
    return np.round(-256 * np.log2(smooth / smooth.sum(axis=1, keepdims=True))).astype(np.int64).reshape(-1)


def _features(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the chosen windows in order, and the n+1 offsets of the texts among them.

    A text of fewer bytes than a window, but not none, is one feature itself.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    starts = np.zeros(0, np.int64)
    if len(data) >= WINDOW:
        info = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(rarity[data[:-1].astype(np.int64) << 8 | data[1:]], out=info[1:-1])
        score = info[WINDOW - 1 : len(data)] - info[: len(data) - WINDOW + 1]
        # windows that run over the end of their text are out
        last = offsets[1:] - WINDOW
        valid = np.zeros(len(score) + 1, dtype=np.int32)
        ok = size >= WINDOW
        np.add.at(valid, offsets[:-1][ok], 1)
        np.add.at(valid, last[ok] + 1, -1)
        inside = np.cumsum(valid[:-1]) > 0
        score = np.where(inside, score, -1)
        # the running maximum over 2 * REACH + 1 windows, by doubling; the text's own bounds need no care, as -1 separates texts by WINDOW - 1 places
        wide = np.full(len(score) + 2 * REACH, -1, dtype=np.int64)
        wide[REACH : REACH + len(score)] = score
        span, at = wide.copy(), 1
        while at * 2 <= 2 * REACH + 1:
            span[: len(span) - at] = np.maximum(span[: len(span) - at], span[at:])
            at *= 2
        rest = 2 * REACH + 1 - at
        top = np.maximum(span[: len(score)], span[rest : rest + len(score)])
        starts = np.flatnonzero(inside & (score >= top))
    short = np.flatnonzero((size < WINDOW) & (size > 0))
    begin = np.concatenate([starts, offsets[short]])
    end = np.concatenate([starts + WINDOW, offsets[short + 1]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    hashes = RollingHash(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(begin, offsets)


def _filters(hashes: np.ndarray) -> np.ndarray:
    """The chained filters of one text's features: (filters, FILTER_BYTES). A repeated feature counts once."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    n = -(-len(hashes) // FEATURES)
    bits = np.zeros((n, FILTER_BYTES * 8), dtype=np.uint8)
    which = np.arange(len(hashes)) // FEATURES
    for k in range(BITS):
        bits[which, ((hashes >> np.uint64(12 * k)) % np.uint64(FILTER_BYTES * 8)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two digests, 0 to 1: equal ones 1, an empty one and another 0.

    For each filter of the digest with fewer filters, its best overlap with one
    of the other's: common bits beyond what chance may give (its mean and
    SPREADS standard deviations), over the most there could be beyond that; the
    mean is weighted by the bits a filter has.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    best = np.zeros(len(a))
    for k in range(len(a)):
        both = np.bitwise_count(a[k][None, :] & b).sum(axis=1)
        p = nb / (FILTER_BYTES * 8)
        chance = na[k] * p + SPREADS * np.sqrt(na[k] * p * (1 - p))
        most = np.minimum(na[k], nb)
        best[k] = np.clip(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0), 0, 1).max()
    return float((best * na).sum() / na.sum())


def _digests(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in text_slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary())], ["text"])])):
        hashes, at = _features(*buffers(part.column(0)), rarity)
        out += [_filters(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def edit(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many, or all, of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


#: `digests` has both fingerprints of a row: they share most filters, so together they take less room where they are written.
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, digests string, near_edited double, near_next double"
_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "digests", "near_edited", "near_next")
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _rows(docs: list[tuple], after: list[tuple], rarity: np.ndarray) -> pa.RecordBatch:
    """The result rows of (id, text, digest) documents, each with the one after it."""
    edited = [edit(d[1], n[1]) for d, n in zip(docs, after, strict=True)]
    changed = _digests([e.encode() for e in edited], rarity)
    out = [(d[0], len(d[1]), hashlib.sha256(e.encode()).hexdigest(), f"{d[2].tobytes().hex()}:{c.tobytes().hex()}", likeness(d[2], c), likeness(d[2], n[2])) for d, n, e, c in zip(docs, after, edited, changed, strict=True)]
    cols = list(zip(*out, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], _COLUMNS)


def _known(ids: list, texts: list[str], rarity: np.ndarray) -> list[tuple]:
    return list(zip(ids, texts, _digests([t.encode() for t in texts], rarity), strict=True))


FIRST, LAST = 0, 1


def _range_rows(rarity: np.ndarray):
    """Rows of a sorted range, one slice after another: all results but the last document's, and the texts of its first and last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for part in text_slices(batches, "text", SLICE):
            seq = [*([last] if last else []), *_known(part.column(0).to_pylist(), part.column(1).to_pylist(), rarity)]
            yield _with_edges(_rows(seq[:-1], seq[1:], rarity), [])
            first, last = first or seq[0][:2], seq[-1]
        if last:
            yield _with_edges(_rows([], [], rarity), [(FIRST, *first), (LAST, *last[:2])])
        release()

    return run


def _with_edges(rows: pa.RecordBatch, edges: list[tuple]) -> pa.RecordBatch:
    from pyspark import TaskContext

    part, blank = TaskContext.get().partitionId(), [None] * rows.num_rows
    cols = [pa.concat_arrays([c, pa.nulls(len(edges), c.type)]) for c in rows.columns]
    cols[0] = pa.concat_arrays([rows.column(0), pa.array([e[1] for e in edges], pa.int64())])
    cols += [pa.array([*blank, *[e[0] for e in edges]], pa.int32()), pa.array([*blank, *[part] * len(edges)], pa.int32()), pa.array([*blank, *[e[2] for e in edges]], pa.string())]
    return pa.RecordBatch.from_arrays(cols, [*_COLUMNS, "edge", "part", "text"])


def _edge_rows(rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, after = (batch.column(k).to_pylist() for k in range(3))
            yield _rows(_known(ids, texts, rarity), _known(ids, after, rarity), rarity)

    return run


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of all whole texts and of their edited texts, and how alike they are.

    Documents follow each other by id, then text; null ids come first, null
    texts are empty. After the last document comes the first; a single one
    follows itself. Rows that repeat an id, and even its text, are documents of
    their own, and are dealt out like others. Empty table: no rows.

    Texts are shuffled once, by ranges of that order, and read in order: a task
    holds a slice of its range. What spans two ranges is added from the first
    and last text of each.
    """
    rarity = rarity_table(pair_counts(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(MAX_RANGES, table_bytes(rows) // range_bytes + 1)
    # rows that repeat id and text may come in any order: their number only lets them be split
    order = [F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("mark"), F.col("copy")]
    marked = rows.withColumns({"mark": F.md5("text"), "copy": F.monotonically_increasing_id()})
    ranged = marked.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialize(ranged.mapInArrow(_range_rows(rarity), f"{_SCHEMA}, edge int, part int, text string"), "fingerprints")
    inner = done.filter("edge IS NULL").select(*_COLUMNS)
    # two rows a range from here on
    edges = done.filter("edge IS NOT NULL").select("edge", "part", "doc_id", "text")
    number = F.row_number().over(Window.orderBy("part"))
    parts = edges.filter(F.col("edge") == FIRST).select("part").withColumn("k", number)
    goes = parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("m")))).select("part", "k", (F.when(F.col("k") == 1, F.col("m")).otherwise(F.col("k") - 1)).alias("before"))
    firsts = edges.filter(F.col("edge") == FIRST).join(goes, "part").select(F.col("before").alias("k"), F.col("text").alias("after"))
    lasts = edges.filter(F.col("edge") == LAST).join(parts, "part")
    outer = lasts.join(firsts, "k").select("doc_id", "text", "after").mapInArrow(_edge_rows(rarity), _SCHEMA)
    both = F.split("digests", ":")
    return inner.unionByName(outer).select("doc_id", "n_chars", "edited_sha256", both[0].alias("fingerprint"), both[1].alias("edited_fingerprint"), "near_edited", "near_next")
