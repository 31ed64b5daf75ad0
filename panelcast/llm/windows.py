"""Substring dedup by level-wise doubling: word windows that repeat at one length are alone extended to twice that length.

A window of 2n words repeats only if both of its halves do. So windows are
looked up at a short length first, then at twice that length where both halves
repeat, and so on up to the length asked for. The lower levels only rule out:
their windows are named by hashes just long enough that few of them meet by
chance, while the last level names windows by 96 bits.

Rows are dealt to blocks of bounded size. At each level a block asks once for
each of its distinct windows, as packed sorted hashes, a record for each unit;
a unit is a range of hashes. A unit answers each block by a bit a window: does
it occur in another block as well, and at the last level, does it occur in an
earlier place. All uses of the blocks share one shuffle of the texts; the windows
that are still in the running stay with the block as a bitmap that travels with
one of its questions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import MIX, RollingHash, buffers, mix64, release, table_bytes, text_slices, words

WINDOW = 20
#: Words of the windows of the first level, at least.
FIRST = 5
#: Text bytes of a block and, for each unit of hashes, of the corpus; bound what a task holds.
BLOCK_BYTES = 12 << 20
UNIT_BYTES = 12 << 20
#: Blocks and units are not made smaller than this to keep all cores busy.
LEAST_BYTES = 2 << 20
#: Bits that the hashes of a lower level have beyond those that number all windows: one in 2**SPARE meets another by chance.
SPARE = 8

_ASK = "unit long, block long, data binary, state binary"
_ANSWER = "block long, unit long, bits binary, state binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(window: int, first: int = FIRST) -> list[int]:
    """Window lengths from about `first` words on, each at most twice the one before, the last one `window`."""
    out = [window]
    while out[0] >= 2 * first:
        out.insert(0, (out[0] + 1) // 2)
    return out


# ------------------------------------------------------------- packed numbers


def pack_deltas(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as differences of as many bytes as most of them need; larger ones take several."""
    if not len(values):
        return b"\x01"
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[0] = 0
    mean = float(values[-1] - values[0]) / len(values)
    width = min(8, max(1, math.ceil((math.log2(mean + 1) + 2.5) / 8)))
    if width == 8:
        return bytes([width]) + values[:1].tobytes() + gaps.tobytes()
    most = np.uint64((1 << 8 * width) - 1)
    times, rest = (gaps // most).astype(np.int64), gaps % most
    digits = np.full(len(gaps) + int(times.sum()), most, dtype="<u8")
    digits[np.cumsum(times + 1) - 1] = rest
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(digits.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_deltas(data: bytes) -> np.ndarray:
    if len(data) < 2:
        return np.zeros(0, np.uint64)
    width = data[0]
    first = np.frombuffer(data, "<u8", 1, 1)[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    digits = np.zeros((len(raw), 8), np.uint8)
    digits[:, :width] = raw
    digits = digits.view("<u8")[:, 0]
    if width == 8:
        return first + np.cumsum(digits, dtype=np.uint64)
    sums = np.cumsum(digits, dtype=np.uint64)
    return first + sums[digits != np.uint64((1 << 8 * width) - 1)]


def pack_keys(keys: np.ndarray) -> bytes:
    """uint64 values in the bytes that their range needs."""
    low = keys.min() if len(keys) else np.uint64(0)
    span = int(keys.max() - low) if len(keys) else 0
    width = max(1, math.ceil(span.bit_length() / 8))
    return bytes([width]) + np.uint64(low).tobytes() + np.ascontiguousarray((keys - low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, low = data[0], np.frombuffer(data, "<u8", 1, 1)[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return low + out.view("<u8")[:, 0]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# --------------------------------------------------------------------- blocks


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 2 << 20) -> np.ndarray:
    """A hash of each word; a long text is taken piece by piece."""
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        lo = starts[i]
        out.append(RollingHash(data[lo : ends[j - 1]]).of(starts[i:j] - lo, ends[i:j] - lo))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Block:
    """The rows of a block in order: the hash of each word, and the row and the key of the order that it belongs to."""

    def __init__(self, table: pa.Table):
        names = ("doc_id", "mark", "text")
        order = table.select(["doc_id", "mark"]).append_column("n", pa.array(range(table.num_rows)))
        ids = order.sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("n", "ascending")])["n"]
        self.rows = table.select(names).take(ids).combine_chunks()
        key = np.asarray(self.rows["doc_id"].fill_null(0), dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        null = np.asarray(self.rows["doc_id"].is_null())
        self.key = np.where(null, np.uint64((1 << 64) - 1), key)
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in self.slices():
            data, offsets = buffers(part.column(2))
            _, starts, ends, at = words(data, offsets, by_space=True)
            hashes.append(_word_hashes(data, starts, ends))
            counts.append(np.diff(at))
        self.words, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def slices(self) -> Iterator[pa.RecordBatch]:
        return text_slices(iter(self.rows.to_batches()))

    def places(self, n: int) -> np.ndarray:
        """Where a window of n words of one row may start."""
        if len(self.words) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])

    def hashes(self, sizes: list[int]) -> np.ndarray:
        """Hash of the window of sizes[-1] words from each place on, built by joining halves level by level; wrong where a window leaves its row."""
        n, h = sizes[0], np.zeros(max(0, len(self.words) - sizes[0] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ self.words[k : k + len(h)]) * MIX
                h ^= h >> np.uint64(29)
            h = mix64(h)
            for size in sizes[1:]:
                half = size - n
                m = max(0, len(self.words) - size + 1)
                h = mix64(h[:m] * MIX + (h[half : half + m] ^ (h[half : half + m] >> np.uint64(31))))
                n = size
        return h


def _second(h: np.ndarray, start: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """32 further bits of the windows at `start`, from their words alone."""
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + w[start + k]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return (mix64(out) >> np.uint64(32)).astype(np.uint32)


def _unit(h: np.ndarray, bits: int, n_units: int) -> np.ndarray:
    top = (h >> np.uint64(max(0, bits - 24))) << np.uint64(max(0, 24 - bits))
    return ((top * np.uint64(n_units)) >> np.uint64(24)).astype(np.int64)


class Distinct:
    """The distinct windows among candidate places, sorted: their hashes, first place, and each candidate's number in them."""

    def __init__(self, block: Block, start: np.ndarray, sizes: list[int], bits: int, exact: bool):
        h = block.hashes(sizes)[start] >> np.uint64(64 - bits)
        if exact:
            more = _second(h, start, block.words, sizes[-1])
            order = np.lexsort((more, h))
        else:
            more, order = None, np.argsort(h, kind="stable")
        sh = h[order]
        new = np.ones(len(sh), bool)
        new[1:] = sh[1:] != sh[:-1]
        if exact:
            sm = more[order]
            new[1:] |= sm[1:] != sm[:-1]
            self.more = sm[new]
        self.hash = sh[new]
        number = np.cumsum(new) - 1
        self.number = np.empty(len(start), np.int64)
        self.number[order] = number
        self.count = np.bincount(number, minlength=len(self.hash)) if len(start) else np.zeros(0, np.int64)
        # sorting is stable, so the first of equal windows is the earliest
        self.first = start[order[new]]


def _candidates(block: Block, sizes: list[int], state: np.ndarray | None, repeats: np.ndarray | None) -> np.ndarray:
    """Places of windows of sizes[-1] words both halves of which repeat; state marks the places that were asked for a level below, repeats those of them that repeat."""
    places = block.places(sizes[-1])
    if state is None:
        return places
    live = np.zeros(len(block.words) + 1, bool)
    live[np.flatnonzero(state)[repeats]] = True
    return places[live[places] & live[places + sizes[-1] - sizes[-2]]]


def _ask(block: Block, number: int, start: np.ndarray, sizes: list[int], bits: int, n_units: int, last: bool) -> pa.Table:
    found = Distinct(block, start, sizes, bits, last)
    unit = _unit(found.hash, bits, n_units)
    asked = np.zeros(len(block.words), bool)
    asked[start] = True
    edges = np.flatnonzero(np.diff(unit, prepend=-1))
    out = []
    for lo, hi in zip(edges, np.append(edges[1:], len(unit))[: len(edges)], strict=True):
        h = found.hash[lo:hi]
        if last:
            # equal hashes that differ in their further bits have a difference of zero
            parts = [pack_deltas(h), found.more[lo:hi].tobytes(), pack_keys(block.key[block.row[found.first[lo:hi]]])]
            data = b"".join(len(p).to_bytes(4, "little") + p for p in parts)
        else:
            data = pack_deltas(h)
        out.append((int(unit[lo]), number, data, None))
    if out:
        out[0] = (*out[0][:3], _bits(asked))
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    release()
    return pa.table({"unit": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary()), "state": pa.array(cols[3], pa.binary())})


def _answered(block: Block, answers: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The places that were asked for, and the answers by unit."""
    rows = answers.sort_by("unit")
    state = next((s for s in rows["state"].to_pylist() if s is not None), None)
    asked = np.zeros(len(block.words), bool) if state is None else _flags(state, len(block.words))
    return asked, list(zip(rows["unit"].to_pylist(), rows["bits"].to_pylist(), strict=True))


def _spread(found: Distinct, bits: int, n_units: int, answers: list) -> np.ndarray:
    """The answers as a flag for each distinct window."""
    unit = _unit(found.hash, bits, n_units)
    out = np.zeros(len(unit), bool)
    for u, data in answers:
        lo, hi = np.searchsorted(unit, u, "left"), np.searchsorted(unit, u, "right")
        out[lo:hi] = _flags(data, hi - lo)
    return out


def _first_ask(sizes: list[int], bits: int, n_units: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        last = len(sizes) == 1
        return _ask(block, table["block"][0].as_py(), block.places(sizes[0]), sizes[:1], bits if not last else 64, n_units, last)

    return run


def _next_ask(sizes: list[int], k: int, bits: int, n_units: int):
    """Reads the answers of level k - 1 and asks for the windows of level k that are left."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        last = k == len(sizes) - 1
        asked, got = _answered(block, answers)
        before = Distinct(block, np.flatnonzero(asked), sizes[:k], bits, False)
        again = (_spread(before, bits, n_units, got) | (before.count > 1))[before.number]
        start = _candidates(block, sizes[: k + 1], asked, again)
        number = table["block"][0].as_py() if table.num_rows else 0
        return _ask(block, number, start, sizes[: k + 1], 64 if last else bits, n_units, last)

    return run


def _result(sizes: list[int], n_units: int):
    """Reads the answers of the last level and removes the words of windows that occur in an earlier place."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        asked, got = _answered(block, answers)
        start = np.flatnonzero(asked)
        found = Distinct(block, start, sizes, 64, True)
        later = _spread(found, 64, n_units, got)[found.number] | (start != found.first[found.number])
        change = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(change, start[later], 1)
        np.add.at(change, start[later] + sizes[-1], -1)
        gone = np.cumsum(change)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        ends = np.cumsum(block.counts)
        removed = sums[ends] - sums[ends - block.counts]
        digests = list(_kept_digests(block, gone))
        out = pa.table({"doc_id": block.rows["doc_id"], "n_words": pa.array(block.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})
        del block, found
        release()
        return out

    return run


def _kept_digests(block: Block, gone: np.ndarray) -> Iterator[str]:
    """SHA-256 of each row's kept words, joined by single blanks."""
    at = 0
    for part in block.slices():
        data, offsets = buffers(part.column(2))
        _, starts, ends, of_row = words(data, offsets, by_space=True)
        keep = ~gone[at : at + len(starts)]
        at += len(starts)
        before = np.concatenate([[0], np.cumsum(keep)])
        size = (ends - starts)[keep] + 1
        to = np.concatenate([[0], np.cumsum(size)])
        text = np.append(data, np.uint8(0x20))[np.repeat(starts[keep] - to[:-1], size) + np.arange(to[-1])]
        text[to[1:] - 1] = 0x20
        raw = memoryview(np.ascontiguousarray(text))
        for r in range(part.num_rows):
            lo, hi = to[before[of_row[r]]], to[before[of_row[r + 1]]]
            yield hashlib.sha256(raw[lo : max(lo, hi - 1)]).hexdigest()


# ---------------------------------------------------------------------- units


def _seen_elsewhere(table: pa.Table) -> pa.Table:
    """A lower level's answers of one unit: which windows more than one block has."""
    lists = [unpack_deltas(d) for d in table["data"].to_pylist()]
    both = np.sort(np.concatenate(lists))
    again = np.unique(both[1:][both[1:] == both[:-1]])
    bits = [_bits(_member(x, again)) for x in lists]
    return _reply(table, bits)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _earlier(table: pa.Table) -> pa.Table:
    """The last level's answers of one unit: which windows of a block have an earlier place in another one."""
    hashes, more, keys = [], [], []
    for data in table["data"].to_pylist():
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        hashes.append(unpack_deltas(parts[0]))
        more.append(np.frombuffer(parts[1], np.uint32))
        keys.append(unpack_keys(parts[2]))
    sizes = [len(h) for h in hashes]
    block = np.repeat(np.asarray(table["block"]), sizes)
    h, m, key = np.concatenate(hashes), np.concatenate(more), np.concatenate(keys)
    order = np.lexsort((block, key, m, h))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (m[order][1:] == m[order][:-1])
    flags = np.empty(len(h), bool)
    flags[order] = same
    ends = np.cumsum(sizes)
    return _reply(table, [_bits(flags[e - n : e]) for e, n in zip(ends, sizes, strict=True)])


def _reply(table: pa.Table, bits: list[bytes]) -> pa.Table:
    release()
    return pa.table({"block": table["block"], "unit": table["unit"], "bits": pa.array(bits, pa.binary()), "state": table["state"]})


# ------------------------------------------------------------------- operator


def dedup_windows(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, unit_bytes: int = UNIT_BYTES, first: int = FIRST) -> DataFrame:
    """Remove each word that a window of `window` words covers whose words also start in an earlier place.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined
    by single blanks) for each row. Words are runs without white space, taken as
    they are; windows do not cross documents and are judged on the input. A
    place is earlier in a document of smaller id, or before in the same one;
    null ids come last. Rows that share an id follow each other by a hash of id
    and text, and those that repeat id and text count as documents of their own,
    of which one is first. Null and empty texts have no words; a text shorter
    than a window never changes. Very long texts are handled whole. An empty
    table gives no rows; other columns are not read.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("doc_id", "text"))
    size = table_bytes(rows)
    cores = min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    n_blocks, n_units = (min(1 << 24, max(1, cores, math.ceil(size / each))) for each in (block_bytes, unit_bytes))
    # words are at least a byte and a blank apart, so there are fewer windows than half the bytes
    bits = min(64, max(24, math.ceil(math.log2(size + 2)) - 1 + SPARE))
    sizes = levels(window, first)
    # blocks are ranges of the mark, so that equal ids follow each other by it from block to block as well
    of_mark = F.shiftrightunsigned(F.shiftrightunsigned("mark", 40) * F.lit(n_blocks), 24).cast("long")
    blocked = _spread_copies(rows, block_bytes).withColumn("block", of_mark * F.lit(1 << 20) + F.col("part")).drop("part").repartition("block")

    def answers(asked: DataFrame, judge: Callable) -> DataFrame:
        return asked.groupBy("unit").applyInArrow(judge, _ANSWER)

    judge = lambda k: _earlier if k == len(sizes) - 1 else _seen_elsewhere
    told = answers(blocked.groupBy("block").applyInArrow(_first_ask(sizes, bits, n_units), _ASK), judge(0))
    for k in range(1, len(sizes)):
        told = answers(blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_next_ask(sizes, k, bits, n_units), _ASK), judge(k))
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_result(sizes, n_units), _RESULT)


def _spread_copies(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows with `part`, 0 but for rows whose copies fill blocks of their own: those are dealt to so many parts."""
    copies = rows.groupBy("doc_id", "mark").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    many = copies.filter((F.col("n") > 1) & (F.col("bytes") > F.lit(block_bytes))).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.ceil(F.col("bytes") / F.lit(block_bytes)).alias("__parts"))
    if many.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    joined = rows.join(many, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    return joined.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")), F.lit(0)).cast("long")).drop("__id", "__mark", "__parts")
