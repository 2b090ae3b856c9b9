"""Near-duplicate embeddings by randomly rotated binary codes.

Each unit vector x is turned by several random rotations.  Of each turned
vector the signs are kept, which name the corner c of the unit cube next to
it, and the correction f = <c, x>.  For another unit vector y, the mean of
<c, y> / f over the rotations is an unbiased estimate of <x, y>, whose error is
about sqrt((1 - f^2) / f^2 / (dim - 1)) for one rotation: ``ERRORS`` times the
error of the mean bounds it, and pairs whose upper bound is under the least
cosine are left out.  The others' cosines are computed anew from the vectors.

Consecutive groups of code bits are the keys of the index: near vectors agree
on all bits of at least one key but for a share ``MISSED`` of those right at
the least cosine.  A pair is looked at only under the first key it agrees on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import partitions, stored

#: Least cosine of a link.
COSINE = 0.95
#: Expected share of pairs of exactly this cosine that agree on no key.
MISSED = 0.005
#: Standard errors between an estimate and its bounds.
ERRORS = 4.0
#: Members of a block; a larger bucket is compared block by block, each pair of blocks in a group of its own.
BLOCK = 1_024
#: Pairs that are estimated at a time.
_PAIRS = 8_192
_SEED = 11


def key_bits(n: int) -> int:
    """Bits of a key: log2 of the number of vectors, so that unlike ones meet about one other in a bucket."""
    return max(8, math.ceil(math.log2(max(n, 2))))


def rotation_count(width: int, dim: int) -> int:
    """Rotations whose codes hold enough keys of ``width`` bits to miss no more than ``MISSED``."""
    agree = (1 - math.acos(COSINE) / math.pi) ** width
    keys = math.ceil(math.log(MISSED) / math.log1p(-agree))
    return -(-keys * width // dim)


def rotations(dim: int, count: int) -> np.ndarray:
    """(dim, count * dim): random orthogonal matrices side by side, the same in every task."""
    rng = np.random.default_rng(_SEED)
    made = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, 1)


def keys_of(signs: np.ndarray, width: int) -> np.ndarray:
    """(rows, keys): the numbers that consecutive groups of ``width`` signs spell."""
    groups = signs[:, :signs.shape[1] // width * width].reshape(len(signs), -1, width).astype(np.int64)
    return groups @ (np.int64(1) << np.arange(width, dtype=np.int64))


def _proper(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows whose vector is not null, empty or zero and has finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter("id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return flat.reshape(rows, -1).astype(np.float64)


def _units(matrix: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _coder(dim: int, count: int):
    """(id, code, factors, small): packed signs, a correction for each rotation, and the vector in 8-bit steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, count)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(_matrix(batch.column("vector")))
            turned = unit @ turn
            factors = np.abs(turned.reshape(len(unit), count, dim)).sum(2).astype("<f4") / np.float32(math.sqrt(dim))
            small = np.rint(unit * 127).astype(np.int8)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "code": pa.array([w.tobytes() for w in np.packbits(turned > 0, axis=1)], pa.binary()),
                "factors": pa.array([f.tobytes() for f in factors], pa.binary()), "small": pa.array([v.tobytes() for v in small], pa.binary())})
    return run


def _signs(column: pa.Array, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1)[:, :bits]


def _keyed(width: int, bits: int):
    """A row for each vector and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = keys_of(_signs(part.column("code"), bits), width)
                number = np.tile(np.arange(keys.shape[1], dtype=np.int64), part.num_rows)
                rows = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(keys.ravel()), *(part.column(n).take(rows) for n in ("id", "code", "factors", "small"))],
                    names=["number", "key", "id", "code", "factors", "small"])
    return run


class Bounds:
    """Upper bounds of cosines between rows, from one row's code and the other's 8-bit vector."""

    def __init__(self, signs: np.ndarray, factors: np.ndarray, small: np.ndarray, turn: np.ndarray) -> None:
        dim, count = turn.shape[0], factors.shape[1]
        weight = 1 / (factors * math.sqrt(dim) * count)
        self.corner = ((signs.astype(np.float32) * 2 - 1).reshape(len(signs), count, dim) * weight[:, :, None]).reshape(len(signs), -1)
        self.turned = (small.astype(np.float32) / 127) @ turn
        error = np.sqrt(((1 - factors ** 2).clip(0) / factors ** 2).sum(1) / max(dim - 1, 1)) / count
        steps = math.sqrt(dim) / 254 * (1 / factors).mean(1)  # at most what the 8-bit steps are off
        self.margin = ERRORS * error + steps

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.corner[a], self.turned[b]) + self.margin[a]


def _pairs_within(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare in rows sorted by group and side: all of a group of side 2, else sides 0 with 1."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    place = np.arange(len(group)) - np.repeat(starts, sizes)
    room = np.repeat(sizes, sizes) - place
    whole = np.flatnonzero(side == 2)
    for step in range(1, int(sizes.max())):
        whole = whole[room[whole] > step]
        if not len(whole):
            break
        yield whole, whole + step
    for at, size in zip(starts, sizes):
        if side[at] != 2:
            left = at + np.flatnonzero(side[at:at + size] == 0)
            right = at + np.flatnonzero(side[at:at + size] == 1)
            for i in left:
                yield np.full(len(right), i), right


def _compare(width: int, dim: int, count: int):
    """Candidate pairs of rows that come sorted by bucket, blocks and side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, count).astype(np.float32)

        def candidates(rows: pa.Table) -> pa.RecordBatch:
            signs = _signs(rows.column("code").combine_chunks(), dim * count)
            factors = np.frombuffer(b"".join(rows.column("factors").to_pylist()), "<f4").reshape(len(signs), count)
            small = np.frombuffer(b"".join(rows.column("small").to_pylist()), np.int8).reshape(len(signs), dim)
            ids, number = rows.column("id").to_numpy(), rows.column("number").to_numpy()
            keys = keys_of(signs, width)
            bounds = Bounds(signs, factors, small, turn)
            earlier = np.arange(keys.shape[1])[None, :] < number[:, None]
            found_a, found_b, held_a, held_b, held = [], [], [], [], 0

            def estimate():
                for at in range(0, held, _PAIRS):
                    a, b = (np.concatenate(h)[at:at + _PAIRS] for h in (held_a, held_b))
                    near = bounds.of(a, b) >= COSINE
                    found_a.append(ids[a[near]])
                    found_b.append(ids[b[near]])

            for a, b in _pairs_within(group_numbers(rows), rows.column("side").to_numpy()):
                for at in range(0, len(a), _PAIRS):
                    x, y = a[at:at + _PAIRS], b[at:at + _PAIRS]
                    first = ~((keys[x] == keys[y]) & earlier[x]).any(1)
                    held_a.append(x[first])
                    held_b.append(y[first])
                    held += int(first.sum())
                if held >= _PAIRS:
                    estimate()
                    held_a, held_b, held = [], [], 0
            estimate()
            x, y = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
            return pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if not rows.num_rows:
                continue
            # Whole groups are compared as they come; the last may go on in the next batch.
            group = group_numbers(rows)
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                for at, to in _runs(group[:cut]):
                    yield candidates(rows.slice(at, to - at))
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield candidates(rest)
    return run


def group_numbers(rows: pa.Table) -> np.ndarray:
    """Numbers, from 0, of the groups of sorted rows."""
    keys = np.stack([rows.column(n).to_numpy() for n in ("number", "key", "lo", "hi")])
    return np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])


def _runs(group: np.ndarray, most: int = 4_096) -> Iterator[tuple[int, int]]:
    """Cuts sorted rows between groups into runs of about ``most`` rows."""
    at = 0
    while at < len(group):
        to = len(group) if at + most >= len(group) else int(np.searchsorted(group, group[at + most - 1], "right"))
        yield at, to
        at = to


def _candidates(reps: DataFrame, n: int, dim: int) -> DataFrame:
    """(a, b): pairs, each once, whose upper bound reaches the least cosine."""
    spark, width = reps.sparkSession, key_bits(n)
    count = rotation_count(width, dim)
    coded = reps.repartition(partitions(spark)).mapInArrow(_coder(dim, count), "id long, code binary, factors binary, small binary")
    coded = stored(coded, "rotation-codes")
    postings = coded.mapInArrow(_keyed(width, dim * count), "number long, key long, id long, code binary, factors binary, small binary")
    large = postings.groupBy("number", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
    placed = (postings.join(stored(large, "rotation-buckets"), ["number", "key"], "left")
              .withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("long")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # A block meets itself (side 2), those above it (side 0) and those below it (side 1).
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(
        "number", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).cast("long").alias("side"),
        "id", "code", "factors", "small")
    ordered = spread.repartition(partitions(spark), "number", "key", "lo", "hi").sortWithinPartitions("number", "key", "lo", "hi", "side")
    return ordered.mapInArrow(_compare(width, dim, count), "a long, b long")


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b) of the pairs with a cosine of at least ``COSINE`` in double precision."""
    both = (pairs.join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("v_a")), "a")
            .join(vectors.select(F.col("id").alias("b"), F.col("vector").alias("v_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _units(_matrix(batch.column("v_a"))), _units(_matrix(batch.column("v_b"))))
                yield batch.select(["a", "b"]).filter(pa.array(cosine >= COSINE))

    return both.select("a", "b", "v_a", "v_b").mapInArrow(run, "a long, b long")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(classes, links): ``classes`` has id, rep and copies of every proper vector, ``links`` pairs of reps.

    Vectors with equal components are one class, whose smallest id takes part.
    Vectors of different lengths are never linked.
    """
    spark = vectors.sparkSession
    proper = stored(_proper(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]), "rotation-vectors")
    groups = proper.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(proper.join(groups, "vector").select("id", "rep", "copies"), "rotation-classes")
    reps = stored(groups.select(F.col("rep").alias("id"), "vector"), "rotation-reps")
    links = spark.createDataFrame([], "a long, b long")
    for row in reps.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        same = reps.filter(F.size("vector") == row["dim"])
        links = links.union(_exact(_candidates(same, row["n"], row["dim"]), same))
    return classes, stored(links, "rotation-links")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Null, empty and zero vectors, and those with null or non-finite
    components, have no links.  Ids are integers; rows with equal id and
    vector count as one vector and keep their own row; rows with a null id
    have no links and a null component.  An empty table gives an empty table.
    """
    classes, links = embedding_links(vectors, id_col, vector_col)
    copies = classes.select("rep", "copies").distinct()
    both = links.union(links.select("b", "a")).toDF("rep", "other")
    near = (both.join(copies.select(F.col("rep").alias("other"), "copies"), "other")
            .groupBy("rep").agg(F.sum("copies").alias("near")))
    component = connected_components(links).select(F.col("node").alias("rep"), "component")
    known = (classes.join(near, "rep", "left").join(component, "rep", "left")
             .select("id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
             .groupBy("id").agg(F.max("n").alias("n"), F.min("component").alias("component")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"))
    return rows.join(known, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"))
