"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

A distributed suffix sort in the manner of the difference-cover algorithm, cut
down to what a match of `length` bytes can touch:

1. Sampled positions. Instead of positions modulo 3, the cover is chosen by
   content: of the `length - gram + 1` grams inside a string of `length` bytes
   the least hash is its anchor, so equal strings have anchors at equal offsets,
   and about one position in a hundred is sampled. Only strings whose anchor's
   gram is an anchor elsewhere can repeat; they go on.
2. Sort of the sampled triples. The first three machine words right of each anchor
   are sorted over all shards: Spark deals them out by ranges and sorts each range,
   so ranges and the rows in them are in the order of the suffixes. Strings that are
   equal share a triple and so a range.
3. Recursion on names. A range is read in order; where triples are equal the bytes
   behind them decide: they are sorted as triples of words, each triple gets its
   rank as a name, and the sort recurses on the names.
4. Merge of the remaining suffixes. The suffixes that start 1, 2, ... bytes
   left of the anchors follow from that order by a stable sort on one byte each:
   (byte, rank of the next suffix), as when non-sampled suffixes are merged.
5. Adjacent prefixes. Neighbours in each order are compared over `length`
   bytes; equal ones repeat.

Texts that occur more than once as a whole are sorted once, and so are the
contexts of an anchor whose gram is very frequent. Very many contexts that still
share what lies beside their anchor are compared by their strings' digests, so no
task holds all documents of a passage.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, join_spread, materialize, mix64, release, text_slices

LENGTH = 200
GRAM = 32
#: Context bytes that a task sorts at once; a range has about four times as many.
UNIT_BYTES = 4 << 20
SLICE_STRINGS = 1 << 18
#: Grams with more anchors than this are dealt out further, by what lies beside the anchor.
HOT = 50_000
#: Hot contexts that share a triple and what lies beside the anchor, if there are more of them than this, are told apart string by string.
WIDE = 20_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, gram hash, text) of each run of strings that share an anchor; places in the buffer."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    n = len(data) - gram + 1
    size = np.diff(offsets)
    if n <= 0 or not (size >= length).any():
        return none
    at = np.arange(n)
    h = RollingHash(data).of(at, at + gram)
    value = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    wide, span = length - gram + 1, 1
    low = value.copy()
    while span * 2 <= wide:
        np.minimum(low[:-span], low[span:], out=low[:-span])
        span *= 2
    ok = size >= length
    first, count = offsets[:-1][ok], size[ok] - length + 1
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    least = np.minimum(low[starts], low[starts + wide - span])
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.flatnonzero(ok), count)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0) | (np.diff(text) != 0)]))
    end = np.concatenate([new[1:], [len(where)]]) - 1
    return where[new], starts[new], starts[end], h[where[new]], text[new]


#: The key of a whole text: 60 and 32 bits of its SHA-256.
_KEY = ("c1", "c2")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, its bytes, its digest and its key."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha"))
    bits = lambda at, digits: F.conv(F.substring("own_sha", at, digits), 16, 10).cast("long")
    return rows.withColumns({"c1": bits(1, 15), "c2": bits(17, 8)})


def _sample(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = buffers(batch.column(2))
            p, _, _, h, text = anchors(data, offsets, length, gram)
            take = pa.array(text)
            place = (np.asarray(batch.column(1))[text] << 31) | (p - offsets[text])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(take), pa.array(place)], ["h", "c1", "place"])

    return run


def _split_hot(data: np.ndarray, hot: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Deal the strings of hot anchors out by more than the gram.

    Strings that start up to `left` bytes before the anchor all hold the same
    length - left bytes right of it, the others the `left` + 1 bytes before it:
    each part of a run goes by the hash of those. Equal strings stay together.
    """
    if not hot.any():
        return lo, hi, p, h, hot
    left = (length - gram) // 2
    cut = p - left
    roll = RollingHash(data)
    out = [[v[~hot] for v in (lo, hi, p, h)] + [np.zeros(int((~hot).sum()), bool)]]
    near = hot & (hi >= cut)
    far = hot & (lo < cut)
    beside = roll.of(p[near], p[near] + length - left)
    out.append([np.maximum(lo, cut)[near], hi[near], p[near], mix64(h[near] ^ beside), np.ones(int(near.sum()), bool)])
    beside = roll.of(p[far] - left - 1, p[far])
    out.append([lo[far], np.minimum(hi, cut - 1)[far], p[far], mix64(~h[far] ^ beside), np.ones(int(far.sum()), bool)])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _survivors(length: int, gram: int):
    """Runs of strings whose anchor's gram repeats, for the texts that have some. A negative mark ~p is a hot anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = buffers(batch.column(2))
            p, s0, s1, h, text = anchors(data, offsets, length, gram)
            marks = batch.column(3)
            again, hot = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for k in range(batch.num_rows):
                own = slice(edges[k], edges[k + 1])
                m, here = np.asarray(marks[k].values), p[own] - offsets[k]
                hot[own] = np.isin(here, ~m[m < 0])
                again[own] = hot[own] | np.isin(here, m[m >= 0])
            s0, s1, p, h, hot = _split_hot(data, hot[again], s0[again], s1[again], p[again], h[again], length, gram)
            edges = np.searchsorted(s0, offsets) if (np.diff(s0) >= 0).all() else None
            if edges is None:
                order = np.argsort(s0, kind="stable")
                s0, s1, p, h, hot = (v[order] for v in (s0, s1, p, h, hot))
                edges = np.searchsorted(s0, offsets)
            rows: list[list] = [[] for _ in range(6)]
            kept = []
            for k in range(batch.num_rows):
                own = slice(edges[k], edges[k + 1])
                if len(s0[own]):
                    kept.append(k)
                    for c, v in zip(rows, (s0[own] - offsets[k], s1[own] - offsets[k], p[own] - offsets[k], h[own].view(np.int64), hot[own]), strict=False):
                        c.append(v)
                    rows[5].append(int((s1[own] - s0[own] + length).sum()))
            take = batch.take(pa.array(kept, pa.int64()))
            lists = [pa.array(c, pa.list_(pa.int64())) for c in rows[:4]] + [pa.array(rows[4], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), take.column(2), *lists, pa.array(rows[5], pa.int64())], ["c1", "c2", "text", "lo", "hi", "p", "h", "hot", "context_bytes"])

    return run


def _words_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of a buffer as a big-endian number; the buffer goes on for 8 bytes at least."""
    rows = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - 7, 8), strides=(1, 1))
    return np.ascontiguousarray(rows[places]).view(">u8").reshape(-1).astype(np.uint64)


_TRIPLE = ("k0", "k1", "k2", "part")
CONTEXT_SCHEMA = "k0 long, k1 long, k2 long, part long, c1 long, c2 long, lo long, starts int, anchor int, hot boolean, bytes binary"


def _triple(buf: np.ndarray, places: np.ndarray, gram: int) -> list[np.ndarray]:
    """Three words from each place on, of the gram there at most: what strings with this anchor surely share."""
    out = []
    for k in range(3):
        drop = np.uint64(8 * min(max(8 * (k + 1) - gram, 0), 7))
        word = _words_at(buf, places + 8 * k) >> drop << drop if 8 * k < gram else np.zeros(len(places), np.uint64)
        # the sign bit is turned, so that signed numbers have the order of the bytes
        out.append((word ^ np.uint64(1 << 63)).view(np.int64))
    return out


def _contexts(length: int, gram: int):
    """The bytes around each anchor with the triple right of it, in the order of the bytes; `part` deals hot anchors out further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            data, offsets = buffers(batch.column(2))
            raw = data.tobytes()
            lo, hi, p, h = (np.asarray(batch.column(k).flatten()) for k in range(3, 7))
            hot = np.asarray(batch.column(7).flatten())
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(3))))
            base = offsets[owner]
            cut = [raw[a:b] for a, b in zip((base + lo).tolist(), (base + hi + length).tolist(), strict=True)]
            padded = np.concatenate([data, np.zeros(24, np.uint8)])
            take = pa.array(owner)
            cols = [*(pa.array(x) for x in (*_triple(padded, base + p, gram), np.where(hot, h, 0))), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo), pa.array((hi - lo + 1).astype(np.int32)), pa.array((p - lo).astype(np.int32)), pa.array(hot), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*_TRIPLE, "c1", "c2", "lo", "starts", "anchor", "hot", "bytes"])

    return run


def rank_rows(rows: np.ndarray) -> np.ndarray:
    """Ranks of the rows of a table of numbers in lexicographic order, equal rows alike.

    Triples of columns are sorted and named by their rank; the names are sorted
    in the same way until one column is left.
    """
    while rows.shape[1] > 1:
        names = []
        for k in range(0, rows.shape[1], 3):
            part = rows[:, k : k + 3]
            order = np.lexsort(part.T[::-1])
            step = (part[order[1:]] != part[order[:-1]]).any(axis=1)
            name = np.zeros(len(rows), dtype=np.uint64)
            name[order[1:]] = np.cumsum(step).astype(np.uint64)
            names.append(name)
        rows = np.column_stack(names)
    return rows[:, 0]


def repeated_starts(buf: np.ndarray, at: np.ndarray, starts: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """For contexts that begin at `at` in the buffer, with `starts` strings each and the anchor at an offset: which strings repeat.

    Returns one flag for each string, context by context. Context k has
    starts[k] + length - 1 bytes.
    """
    m = len(at)
    flags = np.zeros(int(starts.sum()), dtype=bool)
    first = np.concatenate([[0], np.cumsum(starts)[:-1]])
    if m < 2:
        return flags
    width = -(-length // 8)
    padded = np.concatenate([buf, np.zeros(8 * width + 8, np.uint8)])

    def word(places: np.ndarray) -> np.ndarray:
        return _words_at(padded, places)

    # order of the bytes right of the anchors; what lies past a context counts as zeros
    right = at + anchor
    room = at + starts + length - 1 - right
    columns = np.empty((m, width), dtype=np.uint64)
    for k in range(width):
        over = np.clip(8 * (k + 1) - room, 0, 8).astype(np.uint64)
        value = word(np.minimum(right + 8 * k, len(buf)))
        columns[:, k] = np.where(over >= 8, np.uint64(0), value >> (np.uint64(8) * np.minimum(over, 7)) << (np.uint64(8) * np.minimum(over, 7)))
    order = np.argsort(rank_rows(columns), kind="stable")
    del columns
    most, least = anchor, anchor - starts + 1
    for d in range(int(most.max()) + 1):
        if d:
            order = order[most[order] >= d]
            order = order[np.argsort(buf[right[order] - d], kind="stable")]
        live = order[least[order] <= d]
        s = right[live] - d
        same = np.arange(len(live) - 1)
        # word by word, only neighbours that have been equal so far are compared further
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            if not len(same):
                break
            same = same[word(s[same] + k) == word(s[same + 1] + k)]
        slot = first[live] + anchor[live] - d
        flags[slot[same]] = True
        flags[slot[same + 1]] = True
    return flags


def _spans(table: pa.Table, length: int) -> pa.RecordBatch:
    """The spans that repeated strings cover, of the contexts of whole triples."""
    c1, c2, lo, starts, anchor = (np.asarray(table.column(c)).astype(np.int64) for c in ("c1", "c2", "lo", "starts", "anchor"))
    # a row that repeats id and text has brought its contexts twice
    _, one = np.unique(np.column_stack([c1, c2, lo, anchor]), axis=0, return_index=True)
    data, offsets = buffers(table.column("bytes").combine_chunks())
    c1, c2, lo, starts, anchor = (v[one] for v in (c1, c2, lo, starts, anchor))
    flags = repeated_starts(data, offsets[:-1][one], starts, anchor, length)
    owner = np.repeat(np.arange(len(one)), starts)
    begin = np.arange(len(flags)) - np.repeat(np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + lo[owner] if len(one) else flags.astype(np.int64)
    hit = np.flatnonzero(flags)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])) if len(hit) else hit
    end = np.concatenate([new[1:], [len(hit)]]).astype(np.int64) - 1 if len(hit) else hit
    a, b, o = begin[hit[new]], begin[hit[end]] + length, owner[hit[new]]
    return pa.RecordBatch.from_arrays([pa.array(c1[o]), pa.array(c2[o]), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c1", "c2", "a", "b"])


def _match(length: int, unit_bytes: int):
    """Rows of a range come in the order of their triples; so many of them are handled at once as a unit holds, equal triples together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, limit = [], 0, unit_bytes
        for batch in batches:
            waiting.append(batch)
            size += batch.column(batch.schema.get_field_index("bytes")).nbytes
            if size < limit:
                continue
            table = pa.Table.from_batches(waiting)
            keys = [np.asarray(table.column(k)) for k in _TRIPLE]
            step = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if not len(step):  # one triple so far
                limit = 2 * size
                continue
            cut = int(step[-1]) + 1
            yield _spans(table.slice(0, cut), length)
            waiting = table.slice(cut).combine_chunks().to_batches()
            size, limit = sum(b.column(b.schema.get_field_index("bytes")).nbytes for b in waiting), unit_bytes
        if waiting:
            yield _spans(pa.Table.from_batches(waiting), length)
        release()

    return run


def _strings(length: int):
    """Every string of each context: 128 bits of its digest, its text and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "bytes", SLICE_STRINGS):
            c1, c2, lo, starts = (np.asarray(batch.column(k)).astype(np.int64) for k in range(4))
            digests = b"".join(hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for raw, n in zip(batch.column(4).to_pylist(), starts.tolist(), strict=True) for k in range(n))
            s = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(starts)), starts)
            at = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (s[:, 0], s[:, 1], c1[owner], c2[owner], at)], ["s1", "s2", "c1", "c2", "a"])

    return run


def _wide_spans(classes_of: DataFrame, wide: int, length: int) -> tuple[DataFrame, DataFrame]:
    """(contexts to sort, spans): contexts of which very many share a triple and a part are compared string by string.

    Such are the edges of a passage that a large share of all documents has:
    their outer bytes differ, so each document has contexts of its own. Strings
    are counted by their digests, which combine before the shuffle.
    """
    group = ["k0", "k1", "k2", "part"]
    sizes = materialize(classes_of.groupBy(*group).agg(F.count("*").alias("in_group")).filter(F.col("in_group") > wide), "wide-groups")
    total = sizes.agg(F.sum("in_group")).first()[0] or 0
    if not total:
        return classes_of, classes_of.limit(0).select("c1", "c2", F.col("lo").alias("a"), F.col("lo").alias("b"))
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in group]
    named = sizes.select(*[F.col(c).alias(f"w_{c}") for c in group])
    narrow = classes_of.join(named, same, "left_anti")
    strings = join_spread(classes_of, sizes, group, "in_group", total, ["c1", "c2", "lo"]).select("c1", "c2", "lo", "starts", "bytes").mapInArrow(_strings(length), "s1 long, s2 long, c1 long, c2 long, a long")
    strings = materialize(strings, "wide-strings")
    place = F.struct("c1", "c2", "a")
    again = materialize(strings.groupBy("s1", "s2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n")).filter("x <> y").select("s1", "s2", "n"), "wide-repeated")
    n_again = again.agg(F.sum("n")).first()[0] or 0
    found = join_spread(strings, again, ["s1", "s2"], "n", n_again, ["c1", "a"])
    return narrow, found.select("c1", "c2", "a", (F.col("a") + length).alias("b"))


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for text, a, b in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                raw = text.as_py().encode()
                a, b = np.asarray(a.values), np.asarray(b.values)
                order = np.argsort(a, kind="stable")
                a, top = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]]))
                end = np.concatenate([new[1:], [len(a)]]) - 1
                spans = list(zip(a[new].tolist(), top[end].tolist(), strict=True))
                left = b"".join(raw[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
                for c, v in zip(out, (len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if keep_bytes else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["c1", "c2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False, unit_bytes: int = UNIT_BYTES, hot: int = HOT, wide: int = WIDE) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes the `kept` bytes.

    Every byte goes that a string of `length` bytes covers which also starts
    elsewhere, in the same document or another; all copies go, judged on the
    input. Null texts are empty; very long ones are searched whole. Rows that repeat an id and a text are different
    documents, so both lose it; null ids are kept. Empty table: no rows.
    """
    base = _keyed(docs)
    long = base.filter(F.col("n_bytes") >= length)
    # anchors are found twice rather than written: they would be a fifth of the disk
    sampled = long.select(*_KEY, "text").mapInArrow(_sample(length, gram), "h long, c1 long, place long")
    spot = F.xxhash64("c1", "place")
    again = materialize(sampled.groupBy("h").agg(F.min(spot).alias("x"), F.max(spot).alias("y"), F.count("*").alias("n")).filter("x <> y").select("h", "n", (F.col("n") > hot).alias("hot")), "repeated-grams")
    some_hot = not again.filter("hot").isEmpty()
    p = F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    n_again = again.agg(F.sum("n")).first()[0] or 0
    marks = join_spread(sampled, again, ["h"], "n", n_again, ["c1", "place"]).groupBy("c1", F.shiftright("place", 31).alias("c2")).agg(F.collect_set(F.when(F.col("hot"), -1 - p).otherwise(p)).alias("marks"))
    classes = base.groupBy(*_KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "text-classes")
    heads = marks.join(classes, list(_KEY)).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "rep", "marks")
    # one row of each text: its copies have other ids, so a text that many share is spread over them
    chosen = long.join(heads, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(*_KEY, "text", "marks")
    live = materialize(chosen.mapInArrow(_survivors(length, gram), "c1 long, c2 long, text string, lo array<long>, hi array<long>, p array<long>, h array<long>, hot array<boolean>, context_bytes long"), "candidates")
    n_ranges = max(1, math.ceil((live.agg(F.sum("context_bytes")).first()[0] or 0) / (4 * unit_bytes)))
    contexts = live.select(*_KEY, "text", "lo", "hi", "p", "h", "hot").mapInArrow(_contexts(length, gram), CONTEXT_SCHEMA)
    sort = contexts
    if some_hot:
        # a context that occurs again as a whole repeats: all its places are known by a count, and one of them is sorted
        busy = contexts.filter("hot")
        spot = F.xxhash64(*_KEY, "lo")
        first = F.min(F.struct(*_KEY, "lo", "starts"))
        whole = [*_TRIPLE, "anchor", "bytes"]
        classes_of = materialize(busy.groupBy(*whole).agg(first.alias("f"), (F.min(spot) != F.max(spot)).alias("twice"), F.count("*").alias("n")), "hot-contexts")
        narrow, wide_spans = _wide_spans(classes_of.select(*_TRIPLE, "f.c1", "f.c2", "f.lo", "f.starts", "anchor", F.lit(True).alias("hot"), "bytes"), wide, length)
        sort = contexts.filter("NOT hot").unionByName(narrow)
        twice = classes_of.filter("twice").select("part", "anchor", "bytes", "n")
        n_twice = twice.agg(F.sum("n")).first()[0] or 0
        dealt = join_spread(busy, twice, ["part", "anchor", "bytes"], "n", n_twice, [*_KEY, "lo"])
        whole_contexts = dealt.select(*_KEY, F.col("lo").alias("a"), (F.col("lo") + F.col("starts") - 1 + length).alias("b"))
    ranges = sort.drop("hot").repartitionByRange(n_ranges, *_TRIPLE).sortWithinPartitions(*_TRIPLE)
    spans = ranges.mapInArrow(_match(length, unit_bytes), "c1 long, c2 long, a long, b long")
    if some_hot:
        spans = spans.unionByName(whole_contexts).unionByName(wide_spans)
    spans = spans.groupBy(*_KEY).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    done = live.select(*_KEY, "text").join(spans, list(_KEY)).mapInArrow(_cut(keep_bytes), "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(list(_KEY))
    facts = classes.join(done, list(_KEY), "left").select(*_KEY, "copies", F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.col("kept_sha256").alias("k"), F.col("kept").alias("kb"))
    own = base.select("doc_id", *_KEY, "n_bytes", "own_sha", *([F.col("text").cast("binary").alias("raw")] if keep_bytes else []))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = own.join(facts, list(_KEY)).select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("k", "own_sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.coalesce("kb", "raw")).alias("kept")] if keep_bytes else []),
    )
    return out
