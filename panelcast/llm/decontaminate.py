"""Benchmark decontamination: suffix arrays of the corpus shards, searched for every test suffix.

A shard is a slice of the documents of one task. Its suffix array holds the word
suffixes that begin like some test suffix (the others cannot match a window),
sorted by their words; every test suffix is looked up by binary search, which
gives all places where a whole window of it occurs. Windows that follow each other
in a document and in an item are one verbatim match: `matches` returns the longest
ones with their places, and the verdict on a document follows from these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, text_slices, words

WINDOW = 13
#: Test text that is searched for at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
HEAD = 3
_BITS = 22


class Suffixes:
    """The test suffixes of one block of benchmark items, ready to be looked up.

    Words are numbered by their sorted order, so comparing rows of numbers
    compares texts. Each suffix row has `window` numbers, padded with 0.
    """

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        data, offsets = buffers(pa.array([t or "" for _, t in items], pa.string()))
        low, s, e, at = words(data, offsets)
        raw = low.tobytes()
        tokens = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        self.names = {w: k + 1 for k, w in enumerate(sorted(set(tokens)))}
        ids = np.asarray([self.names[w] for w in tokens], dtype=np.int64)
        # word hash -> number; the words themselves are compared once a hash is met
        hashes = RollingHash(low).of(s, e) if len(s) else np.zeros(0, np.uint64)
        self.by_hash = dict(zip(hashes.tolist(), ids.tolist(), strict=True))
        self.words = [b"", *sorted(self.names)]
        rows, needs, owners, starts = [], [], [], []
        for k in range(len(items)):
            own = ids[at[k] : at[k + 1]]
            need = min(window, len(own))
            for j in range(len(own)):
                row = np.zeros(window, dtype=np.int64)
                row[: min(window, len(own) - j)] = own[j : j + window]
                rows.append(row)
                needs.append(need if len(own) - j >= need else 0)  # 0: too short to hold a window
                owners.append(k)
                starts.append(j)
        self.rows = np.asarray(rows, dtype=np.int64).reshape(-1, window)
        self.needs, self.owners, self.starts = (np.asarray(x, dtype=np.int64) for x in (needs, owners, starts))
        self.known = np.zeros(1 << _BITS, dtype=bool)
        self.known[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        # the first words of each window: a place whose words don't start so is in no suffix array
        self.heads = [np.unique(_heads(self.rows[self.needs >= n] if n == HEAD else self.rows[self.needs == n], n)) for n in range(1, HEAD + 1)]


def _heads(rows: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(rows), dtype=np.int64)
    for k in range(n):
        key = key * np.int64(1 << 20) + rows[:, k] % (1 << 20)
    return key


def _number(sfx: Suffixes, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The number of each word of a shard: 0 unless the benchmark has it."""
    out = np.zeros(len(s), dtype=np.int64)
    if not len(s):
        return out
    h = RollingHash(low).of(s, e)
    maybe = np.flatnonzero(sfx.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(maybe):
        return out
    uniq, first, back = np.unique(h[maybe], return_index=True, return_inverse=True)
    raw, num = low.tobytes(), np.zeros(len(uniq), dtype=np.int64)
    for k, (x, i) in enumerate(zip(uniq.tolist(), maybe[first].tolist(), strict=True)):
        n = sfx.by_hash.get(x, 0)
        if n and sfx.words[n] == raw[s[i] : e[i]]:
            num[k] = n
    out[maybe] = num[back]
    return out


def search(sfx: Suffixes, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Look all test suffixes up in the suffix array of one shard.

    Returns (place, words matched, item, place in the item) of each occurrence of a whole window.
    """
    w, n = sfx.window, len(ids)
    none = np.zeros(0, np.int64)
    if not n or not len(sfx.rows):
        return none, none, none, none
    padded = np.concatenate([ids, np.zeros(w, np.int64)])
    doc_end = np.repeat(at[1:], np.diff(at))
    heads = np.column_stack([padded[k : k + n] for k in range(HEAD)])
    # words past the end of their document are no part of its suffixes
    for k in range(1, HEAD):
        heads[:, k][np.arange(n) + k >= doc_end] = 0
    keep = np.zeros(n, dtype=bool)
    for k in range(1, HEAD + 1):
        if len(sfx.heads[k - 1]):
            live = np.flatnonzero((heads[:, :k] != 0).all(axis=1))
            keep[live[np.isin(_heads(heads[live], k), sfx.heads[k - 1])]] = True
    places = np.flatnonzero(keep)
    if not len(places):
        return none, none, none, none
    span = places[:, None] + np.arange(w)[None, :]
    table = np.where(span < doc_end[places][:, None], padded[np.minimum(span, n + w - 1)], 0)
    order = np.lexsort(table.T[::-1])
    table, places = table[order], places[order]
    # binary search: the suffix array narrows word by word, as long as something is left
    live = np.flatnonzero(sfx.needs > 0)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(places), np.int64)
    got: list[tuple[np.ndarray, ...]] = []
    groups = np.zeros(len(places), np.int64)  # number of the distinct prefix of k words
    rows, needs, owners, starts = sfx.rows[live], sfx.needs[live], sfx.owners[live], sfx.starts[live]
    width = np.int64(len(sfx.words) + 1)
    for k in range(w):
        key = groups * width + table[:, k]
        want = groups[np.minimum(lo, len(places) - 1)] * width + rows[:, k]
        lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        ok = (hi > lo) & (rows[:, k] != 0)
        full = ok & (needs == k + 1)
        if full.any():
            size = (hi - lo)[full]
            which = np.repeat(np.flatnonzero(full), size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            got.append((places[lo[which] + inner], np.full(len(which), k + 1), owners[which], starts[which]))
        go = ok & (needs > k + 1)
        lo, hi, rows, needs, owners, starts = lo[go], hi[go], rows[go], needs[go], owners[go], starts[go]
        if not len(lo):
            break
        groups = np.concatenate([[0], np.cumsum(np.diff(key) != 0)]) if len(key) else key
    if not got:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))  # type: ignore[return-value]


def longest(place: np.ndarray, size: np.ndarray, owner: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grow the windows of a shard to maximal matches: (text, item, place in the text, place in the item, words).

    Windows one word apart in a text and in an item are on one diagonal and
    overlap or touch; a run of them is one match, which no word on either side extends.
    """
    row = np.searchsorted(at, place, "right") - 1
    order = np.lexsort((place, place - start, owner, row))
    row, place, size, owner, start = (v[order] for v in (row, place, size, owner, start))
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(owner) != 0) | (np.diff(place - start) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]).astype(np.int64) - 1 if len(first) else first
    return row[first], owner[first], (place - at[row])[first], start[first], place[last] + size[last] - place[first]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of bounded size, one at a time; equal (item, text) rows count once."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null").distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


@dataclass
class Matches:
    """The longest matches of a batch of texts, in the order of its rows."""

    row: np.ndarray
    item: list[str]
    place: np.ndarray
    item_place: np.ndarray
    size: np.ndarray

    def hits(self, at: np.ndarray) -> np.ndarray:
        """Words of each text that some match covers; `at` has the n+1 word offsets of the texts."""
        cover = np.zeros(at[-1] + 1, np.int64)
        np.add.at(cover, at[self.row] + self.place, 1)
        np.add.at(cover, at[self.row] + self.place + self.size, -1)
        upto = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        return upto[at[1:]] - upto[at[:-1]]

    def by_row(self, n_rows: int) -> Iterator[list[tuple[int, int, str, int]]]:
        """Each text's matches as (-words, place, item, place in the item): the least is the longest, then the first."""
        edge = np.searchsorted(self.row, np.arange(n_rows + 1))
        all_ = list(zip((-self.size).tolist(), self.place.tolist(), self.item, self.item_place.tolist(), strict=True))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield all_[a:b]

    def column(self, n_rows: int) -> pa.Array:
        """A list of structs for each text."""
        cols = [pa.array(-self.size, pa.int64()), pa.array(self.place, pa.int64()), pa.array(self.item, pa.string()), pa.array(self.item_place, pa.int64())]
        edge = np.searchsorted(self.row, np.arange(n_rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(cols, ["less", "place", "item_id", "item_place"]))


def _scan(items: list[tuple], window: int, judge):
    """A mapInArrow function; judge(rows, word offsets of their texts, their longest matches) makes the output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sfx = Suffixes(items, window)
        for batch in text_slices(batches):
            low, s, e, at = words(*buffers(batch.column(batch.schema.get_field_index("text"))))
            row, owner, *rest = longest(*search(sfx, _number(sfx, low, s, e), at), at)
            yield judge(batch, at, Matches(row, [items[k][0] for k in owner.tolist()], *rest))

    return run


MATCH_SCHEMA = "doc_id long, item_id string, place long, item_place long, n_words long"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches: one row for each maximal run of words that a document and an item share.

    Only runs of `window` words or more, or of a whole shorter item; places count
    words from 0. Null texts have no words and items without words no matches;
    repeated rows are searched one by one, equal (item, text) rows once, and a
    null item_id is an empty one. Whole texts are searched, however long; an empty
    table gives no rows; other columns of docs are left out, whatever their names.
    """

    def judge(batch: pa.RecordBatch, at: np.ndarray, found: Matches) -> pa.RecordBatch:
        cols = [batch.column(0).take(pa.array(found.row)), pa.array(found.item, pa.string()), *[pa.array(x, pa.int64()) for x in (found.place, found.item_place, found.size)]]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "place", "item_place", "n_words"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(benchmark, block_bytes):
        found = base.mapInArrow(_scan(block, window, judge), MATCH_SCHEMA)
        out = out.unionByName(found) if out is not None else found
    return out if out is not None else base.mapInArrow(_scan([], window, judge), MATCH_SCHEMA)


def digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()


RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_place long, match_item string"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside its longest matches, items found, verdict, and the longest match of all.

    A document is contaminated if it has a hit and ratio * hits >= words.
    longest_match has the words of its longest match (0: none), match_place and
    match_item where that starts in the document and whose it is (null: none); of
    equally long ones the first place counts, then the least item_id. Null
    texts have no words, and no item is found in them; items without words have
    no window; a short item is one window; a null item_id is an empty one. Repeated
    rows are judged one by one, whole texts however long; empty tables have no rows.
    The test set goes to the tasks in blocks of at most block_bytes (+ one
    item); with more than one block the matches are merged by document.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = list(_two(_blocks(benchmark, block_bytes)))
    if len(blocks) <= 1:

        def judge(batch: pa.RecordBatch, at: np.ndarray, found: Matches) -> pa.RecordBatch:
            n_words, n_hit = np.diff(at), found.hits(at)
            rows = list(found.by_row(batch.num_rows))
            items = [{m[2] for m in r} for r in rows]
            best = [min(r, default=(0, None, None)) for r in rows]
            verdict = (n_hit > 0) & (ratio * n_hit >= n_words)
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for f in items], pa.int64()), pa.array([digest(f) for f in items], pa.string()), pa.array(verdict)]
            cols += [pa.array([-m[0] for m in best], pa.int64()), pa.array([m[1] for m in best], pa.int64()), pa.array([m[2] for m in best], pa.string())]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT_SCHEMA.split(", ")])

        return base.mapInArrow(_scan(blocks[0] if blocks else [], window, judge), RESULT_SCHEMA)

    # rows with the same id and text have the same hits; the copies are told apart by their number
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("doc_id", _text_key()).orderBy(F.lit(1)))
    base = base.withColumn("copy", F.concat_ws("-", number, _text_key()))
    merged = _merged(base, benchmark, window, block_bytes)
    items, best = F.array_sort(F.array_distinct("found.item_id")), F.array_min("found")
    return merged.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), _contaminated(ratio).alias("contaminated"), F.coalesce(-best["less"], F.lit(0)).cast("long").alias("longest_match"), best["place"].alias("match_place"), best["item_id"].alias("match_item"))


def _text_key(text: str = "text") -> Column:
    """128 bits that tell the texts of rows with the same id apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _contaminated(ratio: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))


FOUND_SCHEMA = "array<struct<less:bigint,place:bigint,item_id:string,item_place:bigint>>"


def _merged(base: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(doc_id, copy, n_words, found, n_hit): the longest matches of all blocks, merged by the id and copy of base."""

    def partial(batch: pa.RecordBatch, at: np.ndarray, found: Matches) -> pa.RecordBatch:
        cols = [batch.column(0), batch.column(2), pa.array(np.diff(at), pa.int64()), found.column(batch.num_rows)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "copy", "n_words", "found"])

    parts = [base.mapInArrow(_scan(b, window, partial), f"doc_id long, copy string, n_words long, found {FOUND_SCHEMA}") for b in _blocks(benchmark, block_bytes)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    # an item is in one block, so no match is cut; equal rows of base have equal matches
    merged = merged.groupBy("doc_id", "copy").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    covered = F.array_distinct(F.flatten(F.transform("found", lambda m: F.sequence(m["place"], m["place"] - m["less"] - 1))))
    return merged.withColumn("n_hit", F.size(covered).cast("long"))


def _two(blocks: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """At most the first two blocks: enough to know whether one will do."""
    for k, b in enumerate(blocks):
        yield b
        if k:
            return


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that `contamination` lets pass; each is judged by itself, however large the benchmark is."""
    blocks = list(_two(_blocks(benchmark, block_bytes)))
    if len(blocks) <= 1:

        def keep(batch: pa.RecordBatch, at: np.ndarray, found: Matches) -> pa.RecordBatch:
            n_hit = found.hits(at)
            return batch.filter(pa.array((n_hit == 0) | (ratio * n_hit < np.diff(at))))

        return docs.mapInArrow(_scan(blocks[0] if blocks else [], window, keep), docs.schema)
    # rows with the same id and text have one verdict; the id alone would take clean rows along
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("copy"))
    bad = _merged(base, benchmark, window, block_bytes).filter(_contaminated(ratio)).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"))
    keyed = docs.withColumns({"__row_id": F.col("doc_id").cast("long"), "__row_copy": _text_key()})
    return keyed.join(bad, F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_copy") == F.col("__copy")), "left_anti").select(*docs.columns)
