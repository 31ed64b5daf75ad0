"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns. Its name is its depth and the
exclusive-or, in two independent halves, of a hash of each turn with its
position, so that names of prefixes are running aggregates and the name of the
parent is one turn less.

Totals of subtrees go up by bands of fixed height. Inside a band a node adds to
its ancestors there only, at most as many as the band is high. The roots of bands
are a trie of their own, with one level a band; it is rolled up in the same way,
band by band of bands, until one band is left. Each completed total of a band's
root then goes to the ancestors in the band above. So a depth of d takes
log(d) / log(height) rounds, and no row is exploded to more than a band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import join_spread, materialize

HEIGHT = 16
#: Conversations share the start of the first one of each group of GROUP; how much of it is CRC-32 modulo HEADS.
GROUP = 5
HEADS = 9
#: Bytes of ids that travel as one row.
CHUNK = 1 << 16
NAME = ["depth", "a", "b"]
_PREFIX = 32


# ---------------------------------------------------------------- turn by turn


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each turn of a sorted partition among those of its conversation there."""
    from pyspark import TaskContext

    piece, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = np.asarray(batch.column(0), np.int64)
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(conv)))
        i = np.arange(len(conv)) - np.repeat(starts, sizes)
        if last == conv[0]:
            i[: sizes[0]] += seen
        last, seen = conv[-1], int(i[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), piece), pa.int32()), pa.array(i, pa.int64()), batch.column(1), batch.column(2)], ["conv_id", "piece", "i", "digest", "bytes"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, i, digest, bytes): every turn in order; pieces are ranges of the sorted table, so that a conversation of any length is spread."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    # range bounds go through the driver: of long values only the beginning, as far as that keeps the order
    short = F.when(F.length("role") <= _PREFIX, F.substring("text", 1, _PREFIX)).otherwise(F.lit(""))
    ranged = turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, _PREFIX), short)
    ordered = ranged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return materialize(ordered.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).mapInArrow(_number, "conv_id long, piece int, i long, digest string, bytes long"), "turns")


def _marks(position: str) -> list:
    return [F.xxhash64(F.lit(k), F.col(position).cast("long"), "digest").alias(x) for k, x in ((1, "x"), (2, "y"))]


def _before(c: str, w) -> Column:
    """Exclusive-or of the rows before."""
    return F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The rows of all rebuilt conversations: (conv_id, depth, a, b, pa, pb, bytes, ends), depth 0 included.

    A conversation has the first h turns of the first one of its group, then its
    own after its first h.
    """
    pieces = turns.groupBy("conv_id", "piece").agg((F.max("i") + 1).alias("n"))
    over = Window.partitionBy("conv_id").orderBy("piece")
    offsets = pieces.withColumn("offset", F.sum("n").over(over) - F.col("n"))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = convs.join(of_base, "base", "left").withColumn("m", shared).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "m", "length"), "conversations")
    at = offsets.select("conv_id", "piece", "offset").join(convs, "conv_id")
    placed = turns.join(at, ["conv_id", "piece"]).withColumn("pos", F.col("i") + F.col("offset") + 1)

    # the first turns of each conversation, as others begin with them
    heads = placed.filter(F.col("pos") < HEADS).select("conv_id", "pos", "bytes", *_marks("pos"))
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = materialize(heads.select(F.col("conv_id").alias("base"), "pos", "bytes", "x", "y", F.bit_xor("x").over(upto).alias("a"), F.bit_xor("y").over(upto).alias("b")), "heads")
    begun = convs.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "a", "b", "x", "y", "bytes", "length")

    # own turns: running aggregates inside pieces, then over pieces
    own = placed.filter(F.col("pos") > F.col("h")).withColumn("depth", F.col("m") + F.col("pos") - F.col("h"))
    own = own.select("conv_id", "piece", "depth", "bytes", "length", "base", "m", *_marks("depth"))
    carried = own.groupBy("conv_id", "piece").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty")).select("conv_id", "piece", _before("tx", over).alias("cx"), _before("ty", over).alias("cy"))
    start = heads.select("base", F.col("pos").alias("m"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    lead = convs.join(start, ["base", "m"], "left").select("conv_id", F.coalesce("sa", F.lit(0)).alias("sa"), F.coalesce("sb", F.lit(0)).alias("sb"))
    carried = carried.join(lead, "conv_id")
    inside = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = own.withColumns({"rx": F.bit_xor("x").over(inside), "ry": F.bit_xor("y").over(inside)}).join(carried, ["conv_id", "piece"])
    xor3 = lambda p, q, r: F.col(p).bitwiseXOR(F.col(q)).bitwiseXOR(F.col(r))
    own = running.select("conv_id", "depth", xor3("rx", "cx", "sa").alias("a"), xor3("ry", "cy", "sb").alias("b"), "x", "y", "bytes", "length")

    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("x"), zero.alias("y"), zero.alias("bytes"), "length")
    rows = begun.unionByName(own).unionByName(top)
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "bytes", (F.col("depth") == F.col("length")).alias("ends"))


# --------------------------------------------------------------------- roll-up


def _paths(rows: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    """(conv_id, band, path): a conversation's nodes in a band from its top on, at most `height`; values stand where the conversation is the node's first member."""
    valued = rows.select("conv_id", *NAME).join(nodes.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"], "left")
    band = F.floor(F.col("depth") / height).alias("band")
    return valued.groupBy("conv_id", band).agg(F.array_sort(F.collect_list(F.struct(*NAME, "leaves", "saved"))).alias("path"))


def _added(path: Column) -> Column:
    """For each node of a path what it and those below it there bring: added up before anything is shuffled."""

    def total(field: str, below: Column) -> Column:
        return F.aggregate(below, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[field], F.lit(0)))

    def at(x: Column, j: Column) -> Column:
        below = F.slice(path, j + 1, F.size(path))
        return F.struct(*[x[c].alias(c) for c in NAME], total("leaves", below).alias("leaves"), total("saved", below).alias("saved"))

    return F.filter(F.transform(path, at), lambda x: (x["leaves"] != 0) | (x["saved"] != 0))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*NAME).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(rows: DataFrame, nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(depth, a, b, leaves, saved): sums of `leaves` and `saved` over each node's subtree; nodes whose sums are zero may be missing.

    rows has (conv_id, depth, a, b) of all members, nodes one row a node, by its
    first member, with its own values.
    """
    paths = _paths(rows, nodes, height)
    own = _summed(paths.select(F.explode(_added(F.col("path"))).alias("n")).select("n.*"))
    if (rows.agg(F.max("depth")).first()[0] or 0) < height:
        return own
    own, paths = materialize(own, "bands"), materialize(paths, "paths")
    level = (F.col("depth") / height).cast("long").alias("depth")
    roots = F.col("depth") % height == 0
    tops = nodes.filter(roots).select("conv_id", *NAME).join(own, NAME, "left").select("conv_id", level, "a", "b", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    tops = materialize(tops, "band-roots")
    whole = rollup(rows.filter(roots).select("conv_id", level, "a", "b"), tops, height)
    # a completed root of a band adds to its ancestors in the band above
    complete = tops.select("conv_id", *NAME).filter("depth > 0").join(whole, NAME).select("conv_id", (F.col("depth") - 1).alias("band"), "leaves", "saved")
    above = paths.select("conv_id", "band", F.transform("path", lambda x: F.struct(*[x[c].alias(c) for c in NAME])).alias("path"))
    arrived = complete.join(above, ["conv_id", "band"]).select(F.explode("path").alias("n"), "leaves", "saved").select("n.*", "leaves", "saved")
    return _summed(own.unionByName(_summed(arrived)))


# ------------------------------------------------------------- ends of members


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, a, b, conv_id) rows as comma-joined ids, at most CHUNK bytes or so a row."""
    name, first, ids, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*name, first)], pa.array([",".join(ids)])], [*NAME, "first", "ids"])

    for batch in batches:
        for *n, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if n != name or size > CHUNK:
                if name is not None:
                    yield row()
                name, first, ids, size = n, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if name is not None:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of ids, one node after another: the SHA-256 of each node's whole list, as a stream."""
    name, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], [*NAME, "ends_sha256"])

    for batch in batches:
        for *n, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if n == name:
                digest.update(b",")
            else:
                if name is not None:
                    done.append((*name, digest.hexdigest()))
                name, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        yield rows()
        done = []
    if name is not None:
        done.append((*name, digest.hexdigest()))
        yield rows()


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes at which conversations end. Ids are sorted over all tasks; a node's list, however long, is read as a stream of chunks."""
    ends = rows.filter("ends").select(*NAME, "conv_id")
    chunks = ends.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").mapInArrow(_chunked, "depth long, a long, b long, first long, ids string")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(_digested, "depth long, a long, b long, ends_sha256 string")


# ------------------------------------------------------------------- operator


def conversation_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256 for each node. Turns
    are ordered by turn, nulls first, then role and text; null roles and texts are
    empty ones. Repeated rows are turns of their own. Rows without a conv_id take
    no part. Very long texts are handled whole, and so are conversations of any
    number of turns. Other columns are not read. Empty table: no rows, not even a root.
    """
    if height < 2:
        raise ValueError("a band has two levels at least")
    rows = materialize(rebuilt(numbered_turns(conversations)), "trie-rows")
    grouped = rows.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # a node without children is one at which all members end
    values = {"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
    nodes = materialize(grouped.withColumns(values), "trie-nodes")
    totals = rollup(rows, nodes, height)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    of_parents = children.join(nodes.select(*NAME, F.col("conv_id").alias("parent_conv_id")), NAME)
    of_parents = of_parents.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "parent_conv_id", "n_children")
    below = nodes.filter("depth > 0").select(*NAME, "conv_id", "pa", "pb")
    parents = join_spread(below, of_parents, ["depth", "pa", "pb"], "n_children", nodes.count(), ["conv_id"]).select(*NAME, "parent_conv_id")
    out = nodes.select(*NAME, "conv_id", "n_convs").join(totals, NAME, "left").join(children, NAME, "left").join(parents, NAME, "left").join(_ends(rows), NAME, "left")
    none = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        F.coalesce("leaves", none).alias("n_leaves"),
        F.coalesce("saved", none).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
