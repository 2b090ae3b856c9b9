"""Variable-capacity best-fit packing of documents into training sequences.

What is packed is the histogram of piece lengths, which is no longer than the
largest capacity whatever the number of documents: pieces of one length are
alike, and so are bins of the same contents.  Lengths are placed in falling
order, each piece into the fullest bins that it still fits; where none is
left, the permitted capacity with the least cost for what it will hold is
opened.  At the end every bin shrinks to the least capacity for its contents.

The plan says, for each length, which consecutive ranks go to which
consecutive bins.  Ranks are counted over the cluster, and a broadcast of the
plan, of a bounded number of rows, gives every piece its bin and offset.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import partitions, stored, text_or_empty

#: Permitted sequence lengths.
CAPACITIES = (512, 1_024, 2_048, 4_096, 8_192)
#: Cost of a sequence besides its length.
OVERHEAD = 16


@dataclass
class _Bins:
    """Consecutive bins of the same contents."""
    first: int
    count: int
    capacity: int
    used: int


@dataclass
class Plan:
    """Where pieces go: rows (length, from rank, first bin, pieces in a bin, offset in it), and bins."""
    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bin_first: np.ndarray
    bin_capacity: np.ndarray
    bin_used: np.ndarray


def _least_cost(length: int, left: int, smaller: int, capacities: Sequence[int]) -> int:
    """The capacity to open for pieces of ``length``: least cost for each token that it will hold.

    ``left`` such pieces are left and ``smaller`` tokens in shorter ones, which
    can fill what is over.
    """
    def cost(capacity: int) -> tuple[float, int]:
        own = min(capacity // length, left) * length
        held = own + min(capacity - own, smaller)
        shrunk = next(c for c in capacities if c >= held)
        return (shrunk + OVERHEAD) / held, -capacity
    return min((c for c in capacities if c >= length), key=cost)


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES) -> Plan:
    """Pack ``histogram[length]`` pieces of every length."""
    capacities = sorted(capacities)
    open_: list[tuple[int, int]] = []  # (room, index of bins), sorted
    bins: list[_Bins] = []
    rows: list[tuple[int, int, int, int, int]] = []
    opened, smaller = 0, sum(n * k for n, k in histogram.items())
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        smaller -= length * left
        while left:
            at = bisect_left(open_, (length, -1))
            if at < len(open_):
                room, index = open_.pop(at)
            else:
                capacity = _least_cost(length, left, smaller, capacities)
                count = -(-left // (capacity // length))
                room, index = capacity, len(bins)
                bins.append(_Bins(opened, count, capacity, 0))
                opened += count
            group = bins[index]
            per = min(room // length, left)
            filled = min(group.count, left // per)
            if filled < group.count:  # the other bins stay as they are
                bins.append(_Bins(group.first + filled, group.count - filled, group.capacity, group.used))
                insort(open_, (room, len(bins) - 1))
                group.count = filled
            rows.append((length, rank, group.first, per, group.used))
            group.used += per * length
            rank += per * filled
            left -= per * filled
            if group.capacity > group.used:
                insort(open_, (group.capacity - group.used, index))
    bins.sort(key=lambda b: b.first)
    shrunk = [next(c for c in capacities if c >= b.used) for b in bins]
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, np.array([b.first for b in bins], np.int64), np.array(shrunk, np.int64), np.array([b.used for b in bins], np.int64))


def word_tokens(text: Column) -> Column:
    """Tokens of a text in words and one end mark, counted from its white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\v\f"))
    words = F.regexp_count(trimmed, F.lit(r"[ \t\n\r\x0B\f]+"))
    return F.when(F.length(trimmed) > 0, words + 1).otherwise(0).cast("long") + 1


def _placer(kept, span: int):
    """Gives every piece its bin, by length and rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = kept.value
        keys = p.length * span + p.rank
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length * span + rank, "right") - 1
            step = rank - p.rank[row]
            bin_ = p.bin[row] + step // p.per_bin[row]
            group = np.searchsorted(p.bin_first, bin_, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), batch.column("length"), pa.array(bin_), pa.array(p.offset[row] + step % p.per_bin[row] * length),
                 pa.array(p.bin_capacity[group]), pa.array(p.bin_used[group])],
                names=["id", "piece", "length", "bin", "offset", "capacity", "used"])
    return run


def pack(documents: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """One row per piece: id, piece, first_token, n_tokens, bin_id, bin_offset, bin_capacity, bin_tokens.

    A document of more tokens than the largest capacity is cut into pieces of
    that capacity and a rest; a piece lies whole in one bin, and pieces of a
    bin do not overlap.  ``tokens`` is a document's length; by default words
    and an end mark, so that null and empty texts have one token.  A document
    whose length is null or under 1 has one piece of no tokens, in no bin.  Null
    ids and repeated rows are packed like others, and an empty table gives an
    empty table.
    """
    spark, most = documents.sparkSession, max(capacities)
    size = word_tokens(text_or_empty()) if tokens is None else tokens
    docs = documents.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("n"))
    pieces = docs.select("id", F.explode(F.expr(
        f"case when n > 0 then transform(sequence(0L, (n - 1) div {most}), p -> named_struct('piece', p, 'length', least(n - p * {most}, {most}L))) "
        "else array(named_struct('piece', 0L, 'length', 0L)) end")).alias("z"))
    # Shares of the rows, by id, that are each ranked on their own.
    share = F.pmod(F.xxhash64("id", "piece"), F.lit(8 * partitions(spark)))
    pieces = stored(pieces.select("id", "z.piece", "z.length").withColumn("share", share), "packing-pieces")
    nothing, pieces = pieces.filter("length = 0"), pieces.filter("length > 0")
    counts = stored(pieces.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per token of capacity
    kept = spark.sparkContext.broadcast(plan(histogram, capacities))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("length", "share").orderBy("id", "piece")
    ranked = (pieces.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "share"])
              .select("id", "piece", "length", (F.col("start") + F.col("place")).cast("long").alias("rank")))
    span = max([1, *histogram.values()])
    placed = ranked.mapInArrow(_placer(kept, span), "id long, piece long, length long, bin long, offset long, capacity long, used long")
    none = F.lit(None).cast("long")
    placed = placed.union(nothing.select("id", "piece", "length", none, none, none, none))
    return placed.select(
        F.col("id").alias(id_col), "piece", (F.col("piece") * most).alias("first_token"), F.col("length").alias("n_tokens"), F.col("bin").alias("bin_id"),
        F.col("offset").alias("bin_offset"), F.col("capacity").alias("bin_capacity"), F.col("used").alias("bin_tokens"))
