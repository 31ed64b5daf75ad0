"""LM scoring by partial matching: a byte-context trie with escape estimation and symbol exclusion.

The trie of order K is held as a table of (context, next symbol) -> count over
the learning documents; contexts of lower orders are its marginals. A symbol
that its longest context has not seen costs an escape (half a count of every
distinct symbol goes to it, method D) and is sought in the next shorter context,
where symbols of the longer one are excluded. Texts start after K zero bytes and
end with an end symbol of their own, so probabilities of texts sum up to one.

No task holds the whole trie and no position is shuffled. Counts of (context,
symbol) pairs and words are one table. Documents are dealt to blocks of bounded
size; a block asks once for each pair and word it has. Keys belong to units: all
contexts that end in the same three bytes are in one, and contexts of two bytes
and less are a table of bounded size that every task has. A unit reads its counts,
answers the blocks' questions one after another, and the answers go back to the
block, which adds them up. Questions and answers travel as packed sorted lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, materialize, mix64, release, table_bytes, text_slices, words

ORDER = 5
#: Text bytes of a block; bounds what a task holds.
BLOCK_BYTES = 16 << 20
SLICE = 1 << 19
#: Text bytes of the corpus for each unit of keys.
UNIT_BYTES = 8 << 20
#: Blocks and units are not made smaller than this to keep all cores busy.
LEAST_BYTES = 2 << 20
#: Distinct keys after which a counting task hands its counts on; count rows that are packed together.
FLUSH_KEYS = 1_500_000
PACK_ROWS = 500_000
END = 256
SYMBOLS = 257
_SYM = np.int64(512)


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context * 512 + symbol) of every symbol of every text, the end included, and the n+1 offsets of the texts."""
    n = len(offsets) - 1
    padded = np.zeros(len(data) + (order + 1) * n, dtype=np.uint8)
    shift = order * np.arange(1, n + 1) + np.arange(n)
    where = np.arange(len(data)) + np.repeat(shift, np.diff(offsets))
    padded[where] = data
    size = np.diff(offsets) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    pos = np.arange(at[-1]) + np.repeat(shift, size) - np.repeat(np.arange(n), size)
    sym = padded[pos].astype(np.int64)
    sym[at[1:] - 1] = END
    ctx = np.zeros(at[-1], dtype=np.int64)
    for k in range(order, 0, -1):
        ctx = (ctx << 8) | padded[pos - k]
    return ctx * _SYM + sym, at


#: Contexts of this many bytes and less are one table that all pricing tasks share.
SHARED = 2


class Level:
    """The contexts of one order: symbol counts by key; per context its count, its symbols, and what its parent counted of them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, parent: Level | None):
        self.keys, self.counts = _sum_by(_shorten(keys, order), counts)
        self.ctx, first = np.unique(self.keys // _SYM, return_index=True)
        add = lambda v: np.add.reduceat(v, first) if len(first) else v[:0]
        self.n, self.q = add(self.counts), add(np.ones(len(self.keys), np.int64))
        # the symbols of this context are excluded in the parent
        self.x = add(_find(parent.keys, parent.counts, _shorten(self.keys, order - 1))) if parent else None


def shared_levels(keys: np.ndarray, counts: np.ndarray, order: int) -> list[Level]:
    """The orders up to SHARED: at most 65,536 contexts, however large the corpus is."""
    out: list[Level] = []
    for i in range(min(SHARED, order) + 1):
        out.append(Level(keys, counts, i, out[-1] if out else None))
    return out


class Trie:
    """All contexts that end in some three-byte strings, with the short orders that all share."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shared: list[Level], order: int = ORDER):
        self.order = order
        self.levels = list(shared)
        for i in range(len(shared), order + 1):
            self.levels.append(Level(keys, counts, i, self.levels[-1]))

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """log10 probability of each asked (context * 512 + symbol)."""
        out = np.zeros(len(asked))
        open_ = np.arange(len(asked))
        out_n, out_q = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)  # excluded at the order at hand
        for i in range(self.order, -1, -1):
            key = _shorten(asked[open_], i)
            level = self.levels[i]
            if len(level.ctx):
                at = np.minimum(np.searchsorted(level.ctx, key // _SYM), len(level.ctx) - 1)
                seen = level.ctx[at] == key // _SYM
                n = np.where(seen, level.n[at], 0) - out_n[open_]
                q = np.where(seen, level.q[at], 0) - out_q[open_]
                c = _find(level.keys, level.counts, key)
                hit = c > 0
                # at order 0 nothing is left to escape to once all symbols are known
                spare = 0 if i == 0 and len(level.keys) == SYMBOLS else 1
                out[open_[hit]] += np.log10((2 * c[hit] - spare) / (2 * n[hit]))
                esc = ~hit & (q > 0)
                out[open_[esc]] += np.log10(q[esc] / (2 * n[esc]))
                if i:
                    out_n[open_] = np.where(seen, level.x[at], 0)
                    out_q[open_] = np.where(seen, level.q[at], 0)
                open_ = open_[~hit]
        out[open_] -= math.log10(max(1, SYMBOLS - len(self.levels[0].keys)))
        return out


def _shorten(keys: np.ndarray, order: int) -> np.ndarray:
    return ((keys // _SYM) & np.int64((1 << (8 * order)) - 1)) * _SYM + keys % _SYM


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[first], np.add.reduceat(counts, first)


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


class Lookup:
    """An open-addressing table from int64 keys to rows; quicker than binary search for many lookups."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.mask = np.int64(size - 1)
        self.slots = np.full(size, -1, dtype=np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            miss = self.slots[at] != todo
            todo, at = todo[miss], (at[miss] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def rows(self, asked: np.ndarray) -> np.ndarray:
        """Row of each asked key; all of them must be there."""
        at = self._hash(asked)
        out = self.slots[at]
        todo = np.flatnonzero(self.keys[out] != asked)
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            out[todo] = self.slots[at]
            miss = self.keys[out[todo]] != asked[todo]
            todo, at = todo[miss], at[miss]
        return out


#: Keys of words are negative, those of (context, symbol) pairs are not.
_WORD = np.uint64(1 << 63)
END_WORD = np.int64(-(1 << 63))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit hash with the sign set of every white-space word, A-Z lower-cased, and the n+1 offsets of the texts."""
    low, s, e, at = words(data, offsets, by_space=True)
    return (RollingHash(low).of(s, e) | _WORD).view(np.int64) if len(s) else np.zeros(0, np.int64), at


class Tally:
    """Counts by key, added up in parts: what waits to be merged is bounded by bytes, not by pieces."""

    def __init__(self, wait: int = 1 << 18):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.wait = 0, wait

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts.astype(np.int32)))
        self.waiting += len(keys)
        if self.waiting > max(self.wait, len(self.keys) // 2):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            parts, self.parts, self.waiting = [(self.keys, self.counts), *self.parts], [], 0
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            del parts
            self.keys, self.counts = _sum_by(keys, counts)
        return self.keys, self.counts


def _tallied(tally: Tally, part: pa.RecordBatch, order: int) -> None:
    """Add the pairs, words and ends of some texts."""
    data, offsets = buffers(part.column(part.schema.get_field_index("text")))
    for keys in (keys_of(data, offsets, order)[0], word_keys(data, offsets)[0]):
        tally.add(*np.unique(keys, return_counts=True))
    tally.add(np.array([END_WORD]), np.array([part.num_rows]))


def _count(order: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for part in text_slices(batches, limit=SLICE):
            _tallied(tally, part, order)
            if len(tally.keys) > flush:
                yield from _count_rows(tally)
                tally = Tally()
        yield from _count_rows(tally)
        release()

    return run


def _count_rows(tally: Tally, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    keys, counts = tally.merge()
    for a in range(0, len(keys), step):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(counts[a : a + step].astype(np.int64))], ["key", "n"])


def units_of(keys: np.ndarray, n_units: int) -> np.ndarray:
    """The unit of each key: by the last SHARED + 1 bytes of its context, or by the word."""
    ending = (keys >> 9) & np.int64((1 << 8 * (SHARED + 1)) - 1)
    with np.errstate(over="ignore"):
        return (mix64(np.where(keys < 0, keys, ending).view(np.uint64)) % np.uint64(n_units)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """A sorted list of keys as differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.int64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).reshape(-1))


PACKED_SCHEMA = "unit long, block long, n int, keys binary, counts binary"


def _by_unit(keys: np.ndarray, n_units: int) -> Iterator[tuple[int, np.ndarray]]:
    """(unit, places of its keys, in the order of the keys) of each unit that some keys belong to."""
    unit = units_of(keys, n_units)
    order = np.argsort(unit, kind="stable")
    edges = np.flatnonzero(np.diff(unit[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield int(unit[order[a]]), order[a:b]


def _packed_rows(keys: np.ndarray, block: int, n_units: int, counts: np.ndarray | None = None) -> pa.RecordBatch:
    rows = [(u, block, len(at), packed(keys[at]), pa.compress(counts[at].astype(np.int64), codec="zstd", asbytes=True) if counts is not None else None) for u, at in _by_unit(keys, n_units)]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["unit", "block", "n", "keys", "counts"])


def _pack_counts(n_units: int):
    """Count rows as packed lists of block -1; a unit may get several, each with keys of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield packs(waiting)
                waiting, size = [], 0
        if waiting:
            yield packs(waiting)

    def packs(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, counts = (np.concatenate([np.asarray(b.column(k)) for b in waiting]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        return _packed_rows(keys[order], -1, n_units, counts[order])

    return run


def _block_keys(table: pa.Table, order: int) -> np.ndarray:
    """The sorted distinct keys that the texts of a block have."""
    tally = Tally()
    for part in text_slices(iter(table.to_batches()), limit=SLICE):
        _tallied(tally, part, order)
    return tally.merge()[0]


def _ask(order: int, n_units: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_packed_rows(_block_keys(table, order), key[0].as_py(), n_units)])
        release()
        return out

    return run


ANSWER_SCHEMA = "block long, unit long, n int, answers binary"


def _price(order: int, low: tuple[np.ndarray, np.ndarray]):
    """Rows come sorted by unit and block, so a unit's counts (block -1) come before its questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = shared_levels(*low, order)
        unit, known, trie, words_ = None, [], None, None
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                u, block, n = (batch.column(c)[k].as_py() for c in range(3))
                keys = unpacked(batch.column(3)[k].as_py(), n)
                if u != unit:
                    unit, known, trie = u, [], None
                if block < 0:
                    known.append((keys, np.frombuffer(pa.decompress(batch.column(4)[k].as_py(), decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.int64)))
                    continue
                if trie is None:
                    all_keys, counts = _sum_by(*(np.concatenate([x[c] for x in known] or [np.zeros(0, np.int64)]) for c in (0, 1)))
                    first = int(np.searchsorted(all_keys, 0))
                    words_, trie = (all_keys[:first], counts[:first]), Trie(all_keys[first:], counts[first:], shared, order)
                    known = []
                first = int(np.searchsorted(keys, 0))
                value = np.concatenate([np.log10(_find(*words_, keys[:first]) + 1.0), trie.log10(keys[first:])])
                out.append((block, u, n, pa.compress(value, codec="zstd", asbytes=True)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "unit", "n", "answers"])
        release()

    return run


def _answered(keys: np.ndarray, answers: pa.Table, n_units: int) -> np.ndarray:
    """The value of each key of a block; a unit's answers are in the order of its questions."""
    by_unit = {u: (n, blob) for u, n, blob in zip(*(answers.column(c).to_pylist() for c in ("unit", "n", "answers")), strict=True)}
    value = np.zeros(len(keys))
    for u, at in _by_unit(keys, n_units):
        n, blob = by_unit[u]
        if n != len(at):
            raise ValueError(f"unit {u} has answered {n} of {len(at)} questions")
        value[at] = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True))
    return value


def _add_up(order: int, n_units: int, tokens: int, distinct: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _block_keys(docs, order)
        value = _answered(keys, answers, n_units)
        look = Lookup(keys)
        spread = math.log10(tokens + distinct + 1)
        end = value[look.rows(np.array([END_WORD]))][0] if len(keys) else 0.0
        out: list[list] = [[] for _ in range(6)]
        for part in text_slices(iter(docs.to_batches()), limit=SLICE):
            data, offsets = buffers(part.column(part.schema.get_field_index("text")))
            k, at = keys_of(data, offsets, order)
            score = np.add.reduceat(value[look.rows(k)], at[:-1])
            k, at = word_keys(data, offsets)
            v = np.concatenate([value[look.rows(k)], [0.0]])
            n = np.diff(at)
            some = n > 0
            base, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
            base[some] = np.add.reduceat(v, at[:-1][some])
            known[some] = np.add.reduceat((v > 0).astype(np.int64), at[:-1][some])
            got = (part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("held_out")), n + 1, known + (end > 0), base + end - (n + 1) * spread, score)
            for c, x in zip(out, got, strict=True):
                c.append(x)
        del look, keys, value
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        release()
        return pa.table(
            {
                "doc_id": pa.chunked_array(out[0], pa.int64()),
                "held_out": pa.chunked_array(out[1], pa.bool_()),
                "n_tokens": cat(out[2], pa.int64()),
                "n_known": cat(out[3], pa.int64()),
                "train_tokens": pa.array([tokens] * sum(map(len, out[2])), pa.int64()),
                "base_score": cat(out[4], pa.float64()),
                "score": cat(out[5], pa.float64()),
            }
        )

    return run


def ppm_scores(docs: DataFrame, held_out: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Score whole texts by a model learned from the rows where held_out is false (a null counts as false).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram log10 probability over words and one end) and score (the
    trie's log10 probability of the text and its end). Null texts are empty
    ones: an end alone. Repeated rows are learned from and scored one by one.
    Nothing to learn from: every symbol has probability 1/257.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6: a context and a symbol share one long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = table_bytes(rows)
    # a small corpus has as many blocks as there are cores, a large one as its size asks for
    cores = min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    n_blocks, n_units = (max(1, cores, math.ceil(size / each)) for each in (block_bytes, unit_bytes))
    learned = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count(order, FLUSH_KEYS), "key long, n long")
    counts = materialize(learned.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    # the orders up to SHARED: a table of bounded size
    short = (F.shiftright("key", 9).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)) * 512 + F.col("key") % 512).alias("low")
    low_rows = counts.filter("key >= 0").groupBy(short).agg(F.sum("n").alias("n")).toArrow().sort_by("low")
    low = (np.asarray(low_rows.column("low"), dtype=np.int64), np.asarray(low_rows.column("n"), dtype=np.int64))
    facts = counts.filter("key < 0").agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(facts[0] or 0), int(facts[1] or 0)
    # as each row has one block and each block one group, both uses below share one shuffle of the texts
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("long")).repartition("block")
    asked = blocked.groupBy("block").applyInArrow(_ask(order, n_units), PACKED_SCHEMA)
    known = counts.mapInArrow(_pack_counts(n_units), PACKED_SCHEMA)
    answers = known.unionByName(asked).repartition("unit").sortWithinPartitions("unit", "block").mapInArrow(_price(order, low), ANSWER_SCHEMA)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_add_up(order, n_units, tokens, distinct), schema)


def crc_fold(key: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """True where the CRC-32 of the id as text leaves `fold` modulo `folds`."""
    return F.crc32(F.col(key).cast("string")) % folds == fold
