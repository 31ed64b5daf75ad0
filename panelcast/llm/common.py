"""Shared helpers: tables on disk, Arrow text buffers, words and hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Text bytes handled at once inside a task; bounds the numpy temporaries.
SLICE_BYTES = 2 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0x2545F4914F6CDD1D)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that more than one in HOT_SHARE rows bear is hot: fewer than HOT_SHARE keys are. Rows of hot keys are dealt to SALTS groups.
HOT_SHARE = 1000
SALTS = 64


def salt(hot: Column, *row: str) -> Column:
    """The group of a row of a hot key, by what tells its rows apart; 0 for other keys."""
    return F.when(hot, F.pmod(F.xxhash64(*row), F.lit(SALTS))).otherwise(F.lit(0))


def all_salts(hot: Column) -> Column:
    """As rows: all groups of a hot key, one of any other."""
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, apart: list[str]) -> DataFrame:
    """Inner join of left with right, which has one row a key and in `rows` how many rows of left bear it, of `total` in all.

    Rows of hot keys are dealt to several tasks by the columns `apart`. The list
    of hot keys is broadcast: it has fewer than HOT_SHARE rows.
    """
    is_hot = F.col(rows) * HOT_SHARE > F.lit(total)
    hot = right.filter(is_hot).select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__hot_{k}"))
    flagged = left.join(F.broadcast(hot), same, "left").withColumn("__salt", salt(F.col(f"__hot_{keys[0]}").isNotNull(), *apart)).drop(*[f"__hot_{k}" for k in keys])
    return flagged.join(right.withColumn("__salt", all_salts(is_hot)), [*keys, "__salt"]).drop("__salt")


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def texts_with_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def table_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, by one aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


# ---------------------------------------------------------------- inside tasks


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most `limit` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n+1 offsets, as numpy; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: spreads all bits of a uint64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ...; a worker keeps those that its usual slices need."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


def release() -> None:
    """Give memory that Arrow keeps for later back: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()


class RollingHash:
    """Hashes of any byte range of one buffer, modulo 2**64, from prefix sums."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _WORD_BASE):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            terms = self.sums[1:]
            terms[:] = data
            terms += np.uint64(1)
            terms *= powers(base, len(data))
            np.cumsum(terms, out=terms)
            self.unshift = powers(_inverse(base), len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.unshift[start])


#: Bytes of words: digits, letters (lower-cased) and all bytes over 0x7F; 0 elsewhere.
WORD_BYTES = np.zeros(256, dtype=np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)


#: All bytes with A-Z lower-cased; white space (0x09-0x0D, 0x20).
LOWER_BYTES = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
SPACES = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])


def words(data: np.ndarray, offsets: np.ndarray, by_space: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text in one buffer: (lowered bytes, starts, ends, n+1 word offsets of the texts).

    A word is a maximal run of 0-9, a-z (A-Z lower-cased) and non-ASCII bytes,
    or with by_space one of bytes that are no white space.
    """
    low = (LOWER_BYTES if by_space else WORD_BYTES)[data]
    on = np.zeros(len(data) + 2, dtype=np.int8)
    on[1:-1] = ~SPACES[data] if by_space else low != 0
    step = np.diff(on)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    # a word never crosses from one text to the next
    cut = np.unique(inner[(on[inner] == 1) & (on[inner + 1] == 1)]) if len(inner) else inner
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.searchsorted(starts, offsets, "left")


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 values)."""
    if len(word_hash) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(word_hash) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ word_hash[k : len(word_hash) - n + 1 + k]) * MIX
            h ^= h >> np.uint64(29)
        return mix64(h)
