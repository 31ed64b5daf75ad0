"""Best-fit packing of tokenized documents into sequences, after dominance reduction.

A document's tokens are cut into pieces (only documents longer than a sequence
are cut: full pieces, of which the first may be shorter). How many pieces of
each length there are is all that the packing needs to know: at most `capacity`
counts, however many documents there are. `plan` reduces that histogram by
dominance in the way of Martello and Toth and best-fits the rest, working on
lengths with multiplicities, so its cost is bounded by the capacity. Pieces are
then dealt to the planned slots by their rank within their length, as a join.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialize, texts_with_ids

CAPACITY = 2048
END_ID = 0


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian uint32 bytes.

    Where the vocabulary's ids are its merge ranks, a quicker library makes the
    same ids; texts that hold a special token's string go to the plain one, and so
    do texts whose runs of white space are too long for the quicker one's pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str) -> Callable | None:
        """The same merges in a quicker library, if the vocabulary's ids are its merge ranks; else None."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or not (spec.get("pre_tokenizer") or {}).get("use_regex"):
            return None
        alphabet = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        printable = {chr(b): b for b in alphabet} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(alphabet))}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.specials}
        if any(c not in printable for w in vocab for c in w):
            return None
        ranks = {bytes(printable[c] for c in w): i for w, i in vocab.items()}
        merges = spec["model"]["merges"]
        order = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        if order != sorted(x for x in order if x is not None):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def __call__(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.specials):
            try:
                return np.asarray(self.fast(text, disallowed_special=()), dtype="<u4").tobytes()
            except ValueError:  # its pattern backtracks once per blank of a run, up to a limit
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut what is longer than `capacity`.

    Returns one row per piece: its document, number, start, length, CRC-32 of
    its ids, and (part, nth): its place among the pieces of its length that one
    task made. Null texts are empty: one piece that holds the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, seen = encoder(vocabulary), [0] * (capacity + 1)
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + tail
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return texts_with_ids(docs).mapInArrow(run, PIECE_SCHEMA)


Pattern = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix the sets that dominate every other set for their longest item; (fixed patterns, what is left).

    For the longest item x left, a set {x} or {x, y} may be fixed for good when
    no other set of items that fits beside x could serve better: nothing fits
    beside x; or y fills the sequence exactly; or only single items fit beside
    x (two of the shortest don't), and y is the longest that does. A dominating
    set that exists several times is fixed as many times at once.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []
    lengths = sorted(left)
    for x in sorted(left, reverse=True):
        while left.get(x, 0):
            room = capacity - x
            present = [n for n in lengths[: bisect.bisect_right(lengths, room)] if left.get(n, 0) - (n == x) > 0]
            if not present:
                take, items = left[x], (x,)
            else:
                y = present[-1]
                short = [n for n in present[:2]]
                pair = 2 * short[0] if left[short[0]] - (short[0] == x) > 1 else sum(short) if len(short) > 1 else capacity + 1
                if y != room and pair <= room:
                    break  # two or more items may fit beside x: no single set dominates
                items = (x, y)
                take = left[x] // 2 if x == y else min(left[x], left[y])
            fixed.append((items, take))
            for n in items:
                left[n] -= take
    return fixed, {n: c for n, c in left.items() if c > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over lengths with multiplicities.

    Open sequences with the same contents are one entry (contents, how many).
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(items: tuple[int, ...], n: int) -> None:
        room = capacity - sum(items)
        if room == 0:
            done.append((items, n))
            return
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([items, n])

    for x in sorted(counts, reverse=True):
        todo = counts[x]
        while todo:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                each = capacity // x
                full, rest = divmod(todo, each)
                if full:
                    put((x,) * each, full)
                if rest:
                    put((x,) * rest, 1)
                break
            room = rooms[at]
            items, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // x, max(1, todo // n))
            used = min(n, todo // each)
            put(items + (x,) * each, used)
            if n > used:
                put(items, n - used)
            todo -= used * each
    return done + [(tuple(i), n) for room in rooms for i, n in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths and how many sequences follow each; every counted piece has a place."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) of each place that a pattern has."""
    out, ranks, base = [], {}, 0
    for items, n in patterns:
        offset = 0
        for x in items:
            at = ranks.get(x, 0)
            out.append((x, at, at + n - 1, base, offset))
            ranks[x] = at + n
            offset += x
        base += n
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of `pieces` a sequence and a place in it.

    The driver sees `capacity` counts and no document. The slot table has as
    many rows as the patterns have items: it depends on the capacity's number
    of distinct lengths, and neither on documents nor on tokens.
    """
    spark = cut.sparkSession
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    by_length = spark.createDataFrame(table, "length long, lo long, hi long, base long, offset long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "offset"))).alias("slots"))
    ranked = cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    # one row a length, at most `capacity` of them
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("slot", F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") <= s["hi"]))[0])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.base") + F.col("rank") - F.col("slot.lo")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack all documents.

    Empty table: no rows. Null and empty texts: a piece of one end id. Very long
    texts are cut into as many pieces as they need. Repeated
    rows are packed as often as they come. The pieces (a few numbers each, no
    ids) are written once, so ranks stay the same when an executor is lost.
    """
    return pack(materialize(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
