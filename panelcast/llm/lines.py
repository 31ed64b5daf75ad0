"""Line dedup by content-defined chunks, with DataFrame functions only.

Every line is hashed; a rolling hash over two line hashes says whether these two
lines follow each other at an earlier place anywhere in the corpus. A chunk goes
on for as long as it does, so the corpus's own rolling hashes choose where chunks
begin and end: boundaries move with the content, and a line that is inserted or
changed cuts a chunk at that line alone. All two-line pieces of a chunk are
compared byte by byte with their earliest places (smallest document id, then
position), and chunks of two lines or more are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import HOT_SHARE, all_salts, join_spread, materialize, salt

#: Chunks of fewer words (blank lines, closing brackets) are no passages and stay.
MIN_WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def rolling_hashes(text: Column | str) -> Column:
    """Structs (pos, key): the hash of the hashes of lines pos and pos + 1, from 1 on, of a text of two lines or more."""
    hashes = F.transform(_lines(text), lambda x: F.xxhash64(x))
    return _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.get(h, i - 1), F.get(h, i)).alias("key"))))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id, null or not, and its text: rows that share an id are told apart, rows that repeat both are one document."""
    return _digest(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """(row, drop): for each document with a repeat, by its `row_key`, the numbers of the lines that with the next line stand at an earlier place too.

    Only numbers are shuffled to find the repeated hashes; the bytes of lines
    whose hash repeats follow for the comparison. Pairs that a large share of
    all documents hold, and rows that repeat so often, are dealt to several
    tasks wherever they are joined.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.contains("text", F.lit("\n")))
    texts = texts.withColumns({"row": row_key(F.col("doc_id"), F.col("text")), "copy": F.monotonically_increasing_id()})
    found = texts.select("row", "copy", F.explode(rolling_hashes("text")).alias("c")).select("row", "copy", "c.pos", "c.key")
    # counts and bounds combine before the shuffle: a pair that a third of all documents hold is one row a task
    spot = F.xxhash64("row", "pos")
    again = found.groupBy("key").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("key", "n")
    again = materialize(again, "repeated-pairs")
    total = again.agg(F.sum("n")).first()[0] or 0
    known = again.withColumn("hot", F.col("n") * HOT_SHARE > F.lit(total))
    # one row a document: of its pairs those whose hash repeats, and how many rows are the document
    in_text = join_spread(found, known, ["key"], "n", total, ["row", "pos", "copy"]).groupBy("row", "pos", "key", "hot").agg(F.count("*").alias("copies"))
    suspects = in_text.groupBy("row").agg(F.collect_list(F.struct("pos", "key", "hot")).alias("suspects"), F.max("copies").alias("copies"))
    suspects = materialize(suspects, "suspect-pairs")
    rows = suspects.agg(F.sum("copies")).first()[0] or 0
    pair = _let(_lines("text"), lambda x: F.transform("suspects", lambda s: F.struct(s["pos"].alias("pos"), s["key"].alias("key"), s["hot"].alias("hot"), F.concat(F.get(x, s["pos"] - 1), F.lit("\n"), F.get(x, s["pos"])).alias("pair"))))
    bytes_of = join_spread(texts, suspects, ["row"], "copies", rows, ["copy"]).select("doc_id", "row", F.explode(pair).alias("c")).select("doc_id", "row", "c.*").withColumn("digest", _digest(F.col("pair")))
    place = F.struct("doc_id", "row", "pos")
    # bytes are compared where they meet as groups; a hash and digest that one text alone has then stands for it
    texts_of = bytes_of.groupBy("key", "digest", "hot", "pair").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    first = texts_of.groupBy("key", "digest", "hot").agg(F.count("*").alias("texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("texts = 1 and lo != hi")
    first = first.select("key", "digest", "lo", all_salts(F.col("hot")).alias("salt"))
    later = bytes_of.select("doc_id", "row", "pos", "key", "digest", salt(F.col("hot"), "row", "pos").alias("salt")).join(first, ["key", "salt", "digest"]).filter(~place.eqNullSafe(F.col("lo")))
    return later.groupBy("row").agg(F.collect_set("pos").alias("drop"))


def _chunks(drop: Column, lines: Column, min_lines: int, min_words: int) -> Column:
    """Structs (lo, hi) of first and last lines: stretches of pairs that follow each other, if long enough."""

    def from_sorted(d: Column) -> Column:
        starts = F.filter(d, lambda p, k: (k == 0) | (F.get(d, k - 1) != p - 1))
        ends = F.filter(d, lambda p, k: (k == F.size(d) - 1) | (F.get(d, k + 1) != p + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("lo"), (b + 1).alias("hi")))

    def size(c: Column) -> Column:
        return c["hi"] - c["lo"] + 1

    def words(c: Column) -> Column:
        return F.aggregate(F.slice(lines, c["lo"], size(c)), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))

    return F.filter(_let(F.sort_array(drop), from_sorted), lambda c: (size(c) >= min_lines) & (words(c) >= min_words))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with `text` less its repeated chunks, and n_lines, n_removed, n_removed_chunks.

    A line goes if it and a neighbour of it stand in this order at an earlier
    place, in this text or another, and the chunk of such lines has min_lines
    lines and min_words words; repeats are judged on the input, not on what is
    left. A null text stays null, with no lines; a text without a line break is
    one line and never changes. Documents that share an id, or have none, are
    told apart by their texts and follow each other by a digest of them; null
    ids come first. Rows that repeat both id and text count as one document and
    all get its result. Columns of docs that bear the names of the new ones are
    replaced. Very long texts are handled whole, in time linear in their lines;
    an empty table gives no rows.
    """
    drop = repeated_pairs(docs).select(F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    lines = _lines("text")

    def kept(x: Column) -> Column:
        dropped = F.flatten(F.transform("__gone", lambda g: F.sequence(g["lo"], g["hi"])))
        return F.transform(F.array_except(F.sequence(F.lit(1), F.size(x)), dropped), lambda i: F.get(x, i - 1))

    gone = F.when(F.col("__drop").isNotNull(), _let(lines, lambda x: _chunks(F.col("__drop"), x, min_lines, min_words)))
    joined = docs.withColumn("__key", row_key(docs["doc_id"].cast("long"), docs["text"])).join(drop, F.col("__key") == F.col("__row"), "left").withColumn("__gone", gone)
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_removed": F.coalesce(F.aggregate("__gone", F.lit(0), lambda a, g: a + g["hi"] - g["lo"] + 1), F.lit(0)).cast("long"),
            "n_removed_chunks": F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long"),
        }
    )
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.array_join(_let(lines, kept), "\n")).otherwise(F.col("text")))
    return out.drop("__key", "__row", "__drop", "__gone")
