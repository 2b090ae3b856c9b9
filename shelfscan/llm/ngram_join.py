"""Near-duplicate documents by an exact Jaccard join on word n-grams.

Every document is its set of distinct shingles.  In an order of all shingles
that puts rare ones first, two sets of enough likeness share one of their
first few: documents are joined on these prefixes, candidates are thinned by
their sizes, by the positions of the shared shingle and by what follows it
(counts of shingles in hashed buckets), and what is left is verified once on
whole sets.

Components need not know all links.  Lists of documents with a common prefix
shingle are first linked to one of theirs only; later steps look only at pairs
that are still in different components, the likeliest first and then all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .support import discard, partitions, small_batches, stored, text_or_empty
from .words import distinct_shingles, mix64

#: Words in a shingle, and the least likeness of a link in hundredths.
WORDS, PERCENT = 5, 75
#: Bits of the table of shingle counts: 2^20 counters, 4 MB, for a corpus of any size.
TABLE_BITS = 20
#: Counters in one row of the table on its way.
_BLOCK = 1 << 14
#: Bits of the table of wanted documents, by their number: at most 2 MB.  It only thins out what an exact join checks.
WANTED_BITS = (20, 24)
#: Members of a list that travel as one row, and the length from which lists carry bitmaps of their members' sets.
CHUNK_MEMBERS, LONG_LIST = 512, 32
#: Candidates of a document in the step before the last; the last takes all that are left.
LIKELIEST = 8


# --- bounded tables of hashed counts ---------------------------------------

def _count_blocks(bits: int, values):
    """Counts, within a task, hashed values into 2^bits counters; rows are blocks of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for found in values(batch):
                if len(found):
                    at, n = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                    counts[at.astype(np.int64)] += n
        for block in range(0, len(counts), _BLOCK):
            part = counts[block:block + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.astype("<i4").tobytes()], pa.binary())})
    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(counts, "<i4").astype(np.int64)
            held[block] = held[block] + part if block in held else part
    for block, counts in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})


def _table(blocks: DataFrame, bits: int) -> np.ndarray:
    """The 2^bits counters, added up over all tasks."""
    added = blocks.repartition(partitions(blocks.sparkSession), "block").mapInArrow(_add_blocks, "block int, counts binary")
    out = np.zeros(1 << bits, np.int64)
    got = added.toArrow()
    for block, counts in zip(got.column("block").to_pylist(), got.column("counts").to_pylist()):
        out[block:block + _BLOCK] += np.frombuffer(counts, "<i8")
    return out


class _Wanted:
    """Whether an id may be among some: one bit for each hash."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, int(len(table) * 8).bit_length() - 1

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = mix64(ids.view(np.uint64)) >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _wanted(ids: DataFrame) -> _Wanted:
    low, high = WANTED_BITS
    bits = min(max(low, (8 * ids.count()).bit_length()), high)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for block in range(0, len(table), _BLOCK):
            part = table[block:block + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "marks": pa.array([part.tobytes()], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, marks in zip(batch.column("block").to_pylist(), batch.column("marks").to_pylist()):
                part = np.frombuffer(marks, np.uint8)
                held[block] = held[block] | part if block in held else part
        for block, marks in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "marks": pa.array([marks.tobytes()], pa.binary())})

    marked = ids.select("id").mapInArrow(mark, "block int, marks binary")
    got = marked.repartition(partitions(ids.sparkSession), "block").mapInArrow(join, "block int, marks binary").toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    for block, marks in zip(got.column("block").to_pylist(), got.column("marks").to_pylist()):
        out[block:block + _BLOCK] |= np.frombuffer(marks, np.uint8)
    return _Wanted(out)


# --- documents ---------------------------------------------------------------

_SUMMARY = ["id", "n", "print", "sig", "block", "counts"]


def signature(found: np.ndarray) -> bytes:
    """Counts (up to 255) of a set's shingles by their low bits, about 8 in a bucket."""
    buckets = 1 << int(np.clip(np.log2(max(len(found), 1) / 8), 5, 12))
    return np.minimum(np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, set size, hash and signature of the set) of every row, then the task's shingle counts."""
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for found in distinct_shingles(batch.column("text"), WORDS):
            sizes.append(len(found))
            prints.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            signatures.append(signature(found))
            if len(found):
                at, n = np.unique(found >> np.uint64(64 - TABLE_BITS), return_counts=True)
                counts[at.astype(np.int64)] += n
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
             pa.array(signatures, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=_SUMMARY)
    for block in range(0, len(counts), _BLOCK):
        part = counts[block:block + _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()),
                 pa.array([part.astype("<i4").tobytes()], pa.binary())], names=_SUMMARY)


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the size of two sets' symmetric difference, by their signatures."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) > len(y):
        x, y = y, x
    if len(x) != len(y):
        if (x == 255).any() or (y == 255).any():
            return 0
        y = y.reshape(-1, len(x)).sum(0)
    return int(np.abs(x - y).sum())


def _needed(n_a, n_b):
    """Least intersection of linked sets of these sizes: 100 i >= 75 (n_a + n_b - i)."""
    return -(-PERCENT * (n_a + n_b) // (100 + PERCENT))


def _prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _rare_first(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of a set's shingles in the order of all shingles."""
    return np.lexsort((found, table[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]))


def _prefixes(kept):
    """Prefix shingles of every set with their positions, rare ones first by the table of counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept.value
        for batch in batches:
            ids, shingles, places = [], [], []
            for key, found in zip(batch.column("id").to_pylist(), distinct_shingles(batch.column("text"), WORDS)):
                n = len(found)
                if not n:
                    continue
                length = _prefix_length(n)
                order = _rare_first(found, table)[:length]
                ids.append(key)
                shingles.append(found[order].view(np.int64))
                places.append((np.int64(n) << np.int64(32)) + np.arange(length, dtype=np.int64))
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array(ids, pa.int64()), "shingles": pa.array(shingles, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int64()))})
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose shingle is in another row too; equal rows count once."""
    names = ["shingle", "id", "place"]
    last = None  # the last row so far, not given out yet
    open_run = False  # whether rows of its shingle came before it
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy() for n in names]
        if last is not None:
            cols = [np.concatenate([[v], c]) for v, c in zip(last, cols)]
        again = np.zeros(len(cols[0]), bool)  # the same posting as the one before, of a repeated row
        again[1:] = np.all([c[1:] == c[:-1] for c in cols], axis=0)
        cols = [c[~again] for c in cols]
        s = cols[0]
        same = s[1:] == s[:-1]
        keep = np.zeros(len(s), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= open_run and last is not None
        open_run = bool(same[-1]) if len(same) else open_run
        last = [c[-1] for c in cols]
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in cols], names=names)
    if last is not None and open_run:
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in last], names=names)


# --- candidates ----------------------------------------------------------------

def _fits(n_a, at_a, n_b, at_b):
    """Length and positional filter of two sets that share the shingle at these places."""
    most = F.least(at_a, at_b) + 1 + F.least(n_a - at_a, n_b - at_b) - 1
    return ((100 * n_a >= PERCENT * n_b) & (100 * n_b >= PERCENT * n_a)
            & ((100 + PERCENT) * most >= PERCENT * (n_a + n_b)))


def _signature_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose signatures differ by more than linked sets can."""
    for batch in batches:
        keep = [least_difference(x, y) <= n_a + n_b - 2 * _needed(n_a, n_b)
                for n_a, n_b, x, y in zip(*(batch.column(n).to_pylist() for n in ("n_a", "n_b", "sig_a", "sig_b")))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _star_pairs(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each list's members against its smallest one, where all filters pass."""
    n, at = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    hubs = shared.groupBy("shingle").agg(F.min(F.struct("id", "place")).alias("hub"))
    rows = (shared.join(hubs, "shingle").filter("id <> hub.id")
            .filter(_fits(n, at, F.shiftright("hub.place", 32), F.col("hub.place").bitwiseAND(F.lit((1 << 32) - 1)))))
    pairs = rows.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    return _with_signatures(pairs, sets).mapInArrow(_signature_filter, "a long, b long")


def _with_signatures(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")


def _verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets are alike enough; sets are made anew for their documents alone."""
    spark = documents.sparkSession
    sides = [spark.sparkContext.broadcast(_wanted(pairs.select(F.col(c).alias("id")).distinct())) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            on = [side.value(ids) for side in sides]
            batch = batch.append_column("on_a", pa.array(on[0])).append_column("on_b", pa.array(on[1])).filter(pa.array(on[0] | on[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.view(np.int64) for s in distinct_shingles(batch.column("text"), WORDS)], pa.list_(pa.int64())),
                 batch.column("on_a"), batch.column("on_b")], names=["id", "found", "on_a", "on_b"])

    sets = stored(documents.mapInArrow(run, "id long, found array<long>, on_a boolean, on_b boolean"), "jaccard-sets")
    both = (pairs.join(sets.filter("on_a").select(F.col("id").alias("a"), F.col("found").alias("set_a")), "a")
            .join(sets.filter("on_b").select(F.col("id").alias("b"), F.col("found").alias("set_b")), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.mapInArrow(check, "a long, b long"), "jaccard-links")
    discard(sets)
    return links


def _distinct_lists(shared: DataFrame) -> DataFrame:
    """Of lists with the same members, as the shingles of a passage have, one is enough: its pairs are the same."""
    members = [F.bit_xor(F.xxhash64("id")).alias("m1"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 31)).alias("m2"), F.count(F.lit(1)).alias("length")]
    lists = shared.groupBy("shingle").agg(*members).filter("length > 1")
    kept = lists.groupBy("m1", "m2", "length").agg(F.min("shingle").alias("shingle")).select("shingle")
    return shared.join(kept, "shingle", "left_semi")


def _open_lists(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the lists that are in several components, with these and the lists' lengths."""
    rows = shared.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lists = (rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("length"))
             .filter("lo <> hi").select("shingle", "length"))
    return stored(rows.join(lists, "shingle"), "jaccard-open")


def bitmap(found: np.ndarray) -> bytes:
    """A set's shingles as marks in 8 to 16 times as many bits, by their low bits."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(len(found), 1) * 8)), 8, 20))
    marks = np.zeros(bits, bool)
    marks[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _details(documents: DataFrame, ids: DataFrame, table, repeated: bool) -> DataFrame:
    """(id, n, sig, first, bits): signatures and bitmaps of the documents' sets, and the signature's bucket of each
    prefix shingle in the prefix's order.

    Texts of one id have a row each, and equal ones of an id one together
    (``repeated`` says whether there are such).  Some other documents may be there too.
    """
    kept = documents.sparkSession.sparkContext.broadcast(_wanted(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(kept.value(batch.column("id").to_numpy())))
            sizes, sigs, firsts, maps = [], [], [], []
            for found in distinct_shingles(batch.column("text"), WORDS):
                sig = signature(found)
                order = _rare_first(found, table.value)[:_prefix_length(len(found))]
                sizes.append(len(found))
                sigs.append(sig)
                firsts.append((found[order] & np.uint64(len(sig) - 1)).astype("<u2").tobytes())
                maps.append(bitmap(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (sigs, firsts, maps))],
                                             names=["id", "n", "sig", "first", "bits"])

    made = documents.mapInArrow(run, "id long, n long, sig binary, first binary, bits binary")
    return stored(made.distinct() if repeated else made, "jaccard-details")


def _with_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with the counts of the shingles that follow theirs; empty where a count may be larger than it says."""
    for batch in batches:
        rest = []
        for sig, first, place in zip(batch.column("sig"), batch.column("first"), batch.column("place").to_pylist()):
            sig = np.frombuffer(sig.as_buffer(), np.uint8)
            before = np.frombuffer(first.as_buffer(), "<u2")[:(place & ((1 << 32) - 1)) + 1]
            rest.append(b"" if (sig == 255).any() else (sig - np.bincount(before, minlength=len(sig))).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shingle", "length", "id", "place", "component")), pa.array(rest, pa.binary()), batch.column("bits")],
                                         names=["shingle", "length", "id", "place", "component", "rest", "bits"])


class _Rows:
    """Byte strings of members, each a power of two long, folded to a common width where two are compared."""

    def __init__(self, column: pa.Array, fold):
        self.rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
        self.width = np.array([len(x) for x in self.rows], np.int64)
        self.fold, self.folded = fold, {}

    def at(self, width: int) -> np.ndarray:
        """One row of that width for each member that has it or more."""
        if width not in self.folded:
            self.folded[width] = np.array([self.fold(r.reshape(-1, width)) if len(r) >= width else np.zeros(width, np.int64) for r in self.rows])
        return self.folded[width]


class _Block:
    """Members of a list: ids, sizes, places of the list's shingle, components, counts of what follows it, bitmaps."""

    def __init__(self, members: pa.Array):
        cols = {f.name: members.field(i) for i, f in enumerate(members.type)}
        self.id, self.component = cols["id"].to_numpy(), cols["component"].to_numpy()
        place = cols["place"].to_numpy()
        self.n, self.at = place >> 32, place & ((1 << 32) - 1)
        self.rest = _Rows(cols["rest"], lambda r: r.sum(0, dtype=np.int32))
        self.bits = _Rows(cols["bits"], lambda r: np.bitwise_or.reduce(r, axis=0).astype(np.uint8))


def _apart(a: _Rows, b: _Rows, x: np.ndarray, y: np.ndarray, distance) -> np.ndarray:
    """Distances of pairs of rows at the smaller width of both; 0 where one is empty."""
    out = np.zeros(len(x), np.int64)
    width = np.minimum(a.width[x], b.width[y])
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, 1 + len(rows) * int(w) // (1 << 22)):
            out[part] = distance(a.at(int(w))[x[part]], b.at(int(w))[y[part]])
    return out


def likely_links(a: _Block, b: _Block, same: bool, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the members of two blocks of a list that may be linked, by all filters; with ``best``, that many likeliest of each."""
    n_a, n_b = a.n[:, None], b.n[None, :]
    least = _needed(n_a, n_b)
    most = np.minimum(a.at[:, None], b.at) + 1 + np.minimum(n_a - a.at[:, None], n_b - b.at) - 1
    fits = (a.component[:, None] != b.component) & (a.id[:, None] != b.id) & (100 * n_a >= PERCENT * n_b) & (100 * n_b >= PERCENT * n_a) & (most >= least)
    if same:
        fits &= np.triu(np.ones(fits.shape, bool))
    x, y = np.nonzero(fits)
    allowed = (n_a + n_b - 2 * least)[x, y]
    # suffix filter: what follows the shared shingle is apart by its counts at least, what comes before by its number
    suffix = np.abs(a.at[x] - b.at[y]) + _apart(a.rest, b.rest, x, y, lambda u, v: np.abs(u - v).sum(1))
    keep = suffix <= allowed
    x, y, suffix, allowed = x[keep], y[keep], suffix[keep], allowed[keep]
    # in long lists: a mark that only one has stands for a shingle that only one has
    marks = _apart(a.bits, b.bits, x, y, lambda u, v: np.bitwise_count(u ^ v).sum(1))
    keep = marks <= allowed
    x, y, apart = x[keep], y[keep], np.maximum(suffix, marks)[keep]
    if best is not None:
        order = np.lexsort((b.id[y], apart / (a.n[x] + b.n[y]), x))
        first = np.searchsorted(x[order], np.arange(len(a.id)))
        order = order[np.arange(len(order)) - first[x[order]] < best]
        x, y = x[order], y[order]
    return a.id[x], b.id[y]


def _block_pairs(members: DataFrame, details: DataFrame, last: bool) -> DataFrame:
    """(a, b), written: pairs of documents in different components that share a list and pass all filters.

    Lists travel in blocks of members, and blocks meet as wholes: pairs become
    rows only where all filters have let them through.  Before the last step
    each document is compared in its longest list, within its block, and has
    the ``LIKELIEST`` found; the last step compares all blocks of all lists.
    """
    if not last:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("length"), "shingle"))
        members = members.withColumn("rank", rank).filter("rank = 1").drop("rank")
    long = F.when(F.col("length") > LONG_LIST, F.col("bits")).otherwise(F.lit(b""))
    rows = (members.withColumn("n", F.shiftright("place", 32)).join(details, ["id", "n"])
            .select("shingle", "length", "id", "place", "component", "sig", "first", long.alias("bits"))
            .mapInArrow(_with_rest, "shingle long, length long, id long, place long, component long, rest binary, bits binary"))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("length") / CHUNK_MEMBERS))
    blocks = (rows.groupBy("shingle", salt.alias("salt"))
              .agg(F.max("length").alias("length"), F.collect_list(F.struct("id", "place", "component", "rest", "bits")).alias("members")))
    alone = F.lit(None).cast("array<struct<id:bigint,place:bigint,component:bigint,rest:binary,bits:binary>>").alias("members_b")
    if last:
        blocks = stored(blocks, "jaccard-blocks")
        several = blocks.filter(F.col("length") > CHUNK_MEMBERS)
        other = several.select("shingle", F.col("salt").alias("salt_b"), F.col("members").alias("members_b"))
        meets = several.join(other, "shingle").filter("salt < salt_b").select("members", "members_b")
        pairs = blocks.filter("size(members) > 1").select("members", alone).unionByName(meets)
    else:
        pairs = blocks.filter("size(members) > 1").select("members", alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("members"), batch.column("members_b")):
                a = _Block(one.values)
                b = _Block(two.values) if two.is_valid else a
                found = likely_links(a, b, a is b, None if last else LIKELIEST)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    found = pairs.mapInArrow(run, "a long, b long")
    found = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    if last:
        discard(blocks)
    return found


def ngram_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Two rows are linked when their sets of ``WORDS``-word shingles have a
    Jaccard likeness of ``PERCENT`` hundredths or more; a text of fewer words
    is one shingle.  Null, empty and blank texts have no shingles and no links.
    Ids are integers; rows of the same id count as one node and keep their own
    row, and rows with a null id are in no component but their own (null).
    Equal sets are always linked and take part once.  An empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    first = stored(docs.mapInArrow(_summaries, "id long, n long, print long, sig binary, block int, counts binary"), "jaccard-summaries")
    rows = first.filter("block is null").select("id", "n", "print")
    real = rows.filter("id is not null and n > 0")
    classes = real.groupBy("print", "n").agg(F.min("id").alias("rep"))
    members = stored(real.join(classes, ["print", "n"]).select("id", "rep").distinct(), "jaccard-classes")
    table = spark.sparkContext.broadcast(_table(first.filter("block is not null").select("block", "counts"), TABLE_BITS))

    keyed = docs.filter("id is not null")
    made = keyed.mapInArrow(_prefixes(table), "id long, shingles array<long>, places array<long>")
    postings = made.select("id", F.explode(F.arrays_zip("shingles", "places")).alias("z")).select(F.col("z.shingles").alias("shingle"), "id", F.col("z.places").alias("place"))
    listed = (postings.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "id", "place")
              .mapInArrow(_shared, "shingle long, id long, place long"))
    reps = classes.select(F.col("rep").alias("id"))
    lists = stored(listed.join(reps, "id", "left_semi"), "jaccard-lists")
    shared = stored(_distinct_lists(lists), "jaccard-lists")
    discard(lists)
    sets = first.filter("block is null").select("id", "n", "sig").join(reps, "id", "left_semi")

    alike = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    tried = stored(_star_pairs(shared, sets), "jaccard-pairs")
    links = _verified(keyed, tried)
    details = None
    for last in (False, True):
        members = _open_lists(shared, connected_components(links))
        if details is None:
            repeated = bool(real.groupBy("id", "print").count().filter("count > 1").limit(1).count())
            details = _details(keyed, members.select("id").distinct(), table, repeated)
        found = _block_pairs(members, details, last)
        pairs = stored(found.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        discard(members, found)
        more = _verified(keyed, pairs)
        every, done = stored(links.union(more), "jaccard-links"), stored(tried.union(pairs), "jaccard-pairs")
        discard(links, more, tried, pairs)
        links, tried = every, done
    discard(shared, details)
    found = connected_components(links.union(alike))
    return (rows.join(found.withColumnRenamed("node", "id"), "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))


def first_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that have the smallest id of their component, with all their columns.

    Rows without links and rows with a null id stay; rows of one id stay or go
    together.  Most rows are kept by a table of hashed ids of those that go;
    only the others' texts move, to be told apart exactly.
    """
    found = ngram_components(documents, id_col, text_col)
    gone = stored(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct(), "jaccard-gone")
    kept = documents.sparkSession.sparkContext.broadcast(_wanted(gone))
    at = documents.columns.index(id_col)

    def marked(listed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = kept.value(batch.column(at).cast(pa.int64()).fill_null(0).to_numpy())
                yield batch.filter(pa.array(hit if listed else ~hit))
        return documents.mapInArrow(run, documents.schema)

    doubtful = marked(True)
    return marked(False).union(doubtful.join(gone, doubtful[id_col].cast("long") == gone["id"], "left_anti"))
