"""N-gram Jaccard self-join of documents: MinHash bands for candidates, full n-gram sets for the verdict.

1. Each task turns its texts into n-gram sets, a class key (a digest of the
   whole set) and band hashes. Documents with equal sets are one class, so
   copies never meet as pairs.
2. Classes have numbers of their own, so ids may repeat or be null. One row of
   each class stands for it and is shuffled on its band hashes. A bucket links its
   members to its least member (a star, never all pairs); the components of
   those stars are the groups of representatives that may be similar.
3. The texts of such groups come together once, a group whose n-grams exceed
   a unit's bound as pairs of blocks of it, and all their pairs are compared on
   full n-gram sets, as products of sparse indicator matrices. A unit returns
   each member's number of links and a star of the links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import RollingHash, buffers, materialize, mix64, ngram_hashes, text_slices, words
from panelcast.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
#: Chance to miss a pair of exactly the threshold's similarity.
MISS = 1e-5
ROWS = 5
#: n-grams in one block of a group; a unit holds two blocks.
BLOCK_NGRAMS = 1_000_000


def bands_and_rows(threshold: float = THRESHOLD, miss: float = MISS, rows: int = ROWS) -> tuple[int, int]:
    """The number of bands of `rows` values that misses a pair at the threshold with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows))), rows


def ngram_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words, but not none, is one n-gram."""
    low, s, e, at = words(*buffers(batch.column(batch.schema.get_field_index("text"))))
    h = RollingHash(low).of(s, e) if len(s) else np.zeros(0, np.uint64)
    grams = ngram_hashes(h, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sign(sets: list[np.ndarray], mult: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of the non-empty sets."""
    sizes = np.asarray([len(x) for x in sets])
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), len(mult)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(mult)):
            v = low * mult[k] + (high ^ add[k])
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[:, k] = np.minimum.reduceat(v, starts)
        bands = np.zeros((len(sets), len(mult) // rows), dtype=np.uint64)
        for r in range(rows):
            bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + out[:, r::rows] + np.uint64(1))
    return bands


def signatures(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, text_hash, set_key, n_grams, bands) of each document; a null text has the empty set, whose bands are empty."""
    n_bands, rows = bands_and_rows(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        mult = rng.integers(0, 1 << 32, n_bands * rows, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 1 << 32, n_bands * rows, dtype=np.uint32)
        for batch in text_slices(batches, limit=1 << 20):
            sets = ngram_sets(batch, n)
            full = [k for k, x in enumerate(sets) if len(x)]
            bands: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            if full:
                got = _sign([sets[k] for k in full], mult, add, rows).view(np.int64)
                for k, g in zip(full, got, strict=True):
                    bands[k] = g
            keys = [_key(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "set_key", "n_grams", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, set_key binary, n_grams long, bands array<long>")


def _links(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member, and its least linked member's root, over the pairs that this unit owns.

    side 0: the pairs within the unit; otherwise only those of a 1 with a 2.
    Intersections are counted on n-grams that several members share; members of
    a tile are multiplied as dense indicator matrices over those n-grams.
    """
    m = len(sets)
    sizes = np.asarray([len(x) for x in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    uniq, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    owner, col = owner[keep], number[col[keep]]
    count, root = np.zeros(m, np.int64), np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if not len(col):
        return count, root
    n_cols, tile, width = int(col.max()) + 1, 1024, 8192
    order = np.argsort(col, kind="stable")
    o_col, o_owner = col[order], owner[order]
    for a in range(0, m, tile):
        for b in range(a, m, tile):
            ra, rb = min(tile, m - a), min(tile, m - b)
            both = np.zeros((ra, rb), dtype=np.float32)
            for c in range(0, n_cols, width):
                lo, hi = np.searchsorted(o_col, [c, c + width])
                who, what = o_owner[lo:hi], o_col[lo:hi] - c
                in_a, in_b = (who >= a) & (who < a + ra), (who >= b) & (who < b + rb)
                if not in_a.any() or not in_b.any():
                    continue
                x = np.zeros((ra, min(width, n_cols - c)), dtype=np.float32)
                x[who[in_a] - a, what[in_a]] = 1
                y = x
                if a != b:
                    y = np.zeros((rb, x.shape[1]), dtype=np.float32)
                    y[who[in_b] - b, what[in_b]] = 1
                both += x @ y.T
            union = sizes[a : a + ra, None] + sizes[None, b : b + rb] - both
            ok = (both >= threshold * union - 1e-9) & (both > 0)
            if a == b:
                ok = np.triu(ok, 1)
            s, t = side[a : a + ra, None], side[None, b : b + rb]
            ok &= (s != t) | (s == 0)
            count[a : a + ra] += ok.sum(axis=1)
            count[b : b + rb] += ok.sum(axis=0)
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                # the first unseen root among the partners, again and again: as many steps as roots, not links
                mates = np.flatnonzero(ok[i]) + b
                for r in np.unique(root[mates]).tolist():
                    p, q = find(a + i), find(r)
                    if p != q:
                        root[max(p, q)] = min(p, q)
    return count, np.asarray([find(k) for k in range(m)])


def _verify(n: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        comp, i, j = (np.asarray(table.column(c)) for c in ("comp", "bi", "bj"))
        order = np.lexsort((np.asarray(table.column("node")), j, i, comp))
        table = table.take(pa.array(order))
        comp, i, j, blk, ids = (np.asarray(table.column(c)) for c in ("comp", "bi", "bj", "blk", "node"))
        sets: list[np.ndarray] = []
        for part in text_slices(iter(table.select(["text"]).combine_chunks().to_batches())):
            sets += ngram_sets(part, n)
        # a text that only shares the hash of the class's text is not its text
        good = [k for k, key in enumerate(table.column("key").to_pylist()) if _key(sets[k]) == key]
        if len(good) < len(ids):
            comp, i, j, blk, ids, sets = comp[good], i[good], j[good], blk[good], ids[good], [sets[k] for k in good]
        out_id, out_n, out_root = [], [], []
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(comp) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])) if len(ids) else np.zeros(0, int)
        for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
            side = np.zeros(b - a, np.int64) if i[a] == j[a] else np.where(blk[a:b] == i[a], 1, 2)
            count, root = _links(sets[a:b], side, threshold)
            live = np.flatnonzero(count)
            out_id.append(ids[a:b][live])
            out_n.append(count[live])
            out_root.append(ids[a:b][root[live]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(x), pa.int64()) for x in (out_id, out_n, out_root)], ["node", "n_links", "root"])

    return run


def _group_key(comp: str, bi: str, bj: str, n_units: int):
    return F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64(comp), F.lit(n_units))).otherwise(F.xxhash64(comp, bi, bj))


def _classes(docs: DataFrame, n: int, threshold: float, miss: float, block_ngrams: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and per class: node, set_key, head, nameless, class_size, n_links, root.

    head is (no_id, doc_id, text_hash) of the row that stands for the class: the
    least one with an id, or the least one if no row has an id; nameless is the
    least text_hash of its rows without an id; root is the node of its group.
    """
    signed = materialize(signatures(docs, n, threshold, miss), "signatures")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("head")
    # rows with equal sets combine before the shuffle; the numbers are fixed once they are written
    reps = signed.groupBy("set_key").agg(head, F.min(F.when(F.col("doc_id").isNull(), F.col("text_hash"))).alias("nameless"), F.count("*").alias("class_size"), F.min("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = reps.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = rows.groupBy("band", "h").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band", "h", "least")
    stars = rows.join(buckets, ["band", "h"]).filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    maybe = components(stars)

    # groups come together once; blocks bound what one unit holds
    sized = maybe.join(reps.select("node", F.col("set_key").alias("key"), "head", "n_grams"), "node")
    total = sized.groupBy("root").agg(F.sum("n_grams").alias("total"))
    sized = sized.join(total, "root").select("node", F.col("root").alias("comp"), "key", "n_grams", F.col("head.no_id").alias("no_id"), F.coalesce("head.doc_id", F.lit(0)).alias("id"), F.col("head.text_hash").alias("text_hash"), F.ceil(F.col("total") / block_ngrams).cast("int").alias("n_blocks"))
    sized = materialize(sized, "groups")
    all_ngrams = sized.agg(F.sum("n_grams")).first()[0] or 0
    n_units = max(1, math.ceil(all_ngrams / block_ngrams))
    own = ["no_id", "id", "text_hash"]
    texts = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    # a shuffle join at every size; rows that repeat id and text lie together then and go without another exchange
    texts = texts.join(sized.hint("merge"), own).dropDuplicates([*own, "node"])
    blk = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    spread = texts.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    spread = spread.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).withColumn("unit", _group_key("comp", "bi", "bj", n_units))
    found = spread.select("unit", "comp", "bi", "bj", "blk", "node", "key", "text").groupBy("unit").applyInArrow(_verify(n, threshold), "node long, n_links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = reps.drop("bands", "n_grams").join(links, "node", "left").join(groups, "node", "left")
    return signed, classes.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "root": F.coalesce("root", "node")})


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, miss: float = MISS, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """Per document: class_id, class_size, n_links, group_id.

    class_id is the least id of the documents with the same n-gram set;
    n_links counts the other classes at `threshold` or more; group_id is the
    least class_id that is reachable over links. Documents without words (null,
    empty, no word characters) are one class without links. Every row is judged
    by its own text: rows that repeat an id with another text are in the classes
    of their texts, and so are rows with a null id; an id is null only where no
    row of the class, or of the group, has one. An empty table gives no rows.
    """
    signed, classes = _classes(docs, n, threshold, miss, block_ngrams)
    classes = materialize(classes.select("set_key", "root", F.col("head.doc_id").alias("class_id"), "class_size", "n_links"), "grouped")
    # min leaves nulls out; classes of one group combine before the shuffle
    least = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return signed.select("doc_id", "set_key").join(classes.join(least, "root"), "set_key").select("doc_id", "class_id", "class_size", "n_links", "group_id")


def drop_near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, less near duplicates: of each group one row with an id, and one without.

    The row with an id is the one with the least id, then set key, text hash and
    row hash; a row without an id does not stand for rows with one, nor they for
    it, and the one with the least text hash and row hash stays.
    """
    _, classes = _classes(docs, n, threshold, MISS, BLOCK_NGRAMS)
    classes = materialize(classes.select("set_key", "head", "nameless", "root"), "grouped")
    named = classes.filter("not head.no_id").groupBy("root").agg(F.min(F.struct("head.doc_id", "set_key", "head.text_hash")).alias("s")).select(F.col("s.doc_id").alias("__id"), F.col("s.text_hash").alias("__hash"))
    nameless = classes.filter("nameless is not null").groupBy("root").agg(F.min("nameless").alias("__hash")).select(F.lit(None).cast("long").alias("__id"), "__hash")
    kept = materialize(named.unionByName(nameless).distinct(), "kept")
    found = docs.withColumns({"__row_id": F.col("doc_id").cast("long"), "__row_hash": F.xxhash64("text")}).join(kept, F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash")), "left_semi")
    key = ["__row_id", "__row_hash"]
    # only numbers are shuffled to find rows that repeat id and text; those alone are dealt out, one of each stays
    again = materialize(found.groupBy(*key).count().filter("count > 1").select(F.col("__row_id").alias("__id"), F.col("__row_hash").alias("__hash")), "again")
    if again.isEmpty():
        return found.select(*docs.columns)
    same = F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash"))
    single = found.join(again, same, "left_anti").select(*docs.columns)
    one = found.join(again, same, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("s")).select("s.*")
    return single.unionByName(one)
