"""Trie of conversation prefixes, with totals of every subtree.

A node is a distinct sequence of first turns.  Its identity is its depth and
two polynomial sums over the turns' 128-bit digests, which can be summed up
piecewise: a conversation is never held as one row, so that one of very many
turns is spread over tasks like any other rows.

Subtree totals travel from children to parents by time-forward processing.
Nodes are sorted (by Spark, spilling) in reverse level order; a priority queue
that spills sorted runs holds the totals that wait for their parents.  That
runs in shards, subtrees of bounded size, side by side; their roots' totals
are then added up by target and passed on through the nodes above all shards.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import partitions, stored

#: Odd bases of the two polynomial sums, modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MASK = (1 << 64) - 1
#: A subtree of at most so many turns is one shard, or a 4,096th of all turns where that is more:
#: at most 4,096 nodes of one depth are above the shards, whatever the input.
SHARD_TURNS, SHARES = 4_096, 4_096
#: Nodes above the shards that are broadcast to mark them; more of them are joined by a shuffle.
MARKED = 100_000
#: Totals that a queue holds in memory before it spills a sorted run.
QUEUE = 200_000
#: Characters of member ids in one piece of a long list.
PIECE = 1 << 20

KEY = ["depth", "k1", "k2"]


# --- turns, their places and running sums ------------------------------------

def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base^n modulo 2^64, for n of any sign (odd bases have inverses)."""
    out = np.ones(len(n), np.uint64)
    for sign, b in ((1, base), (-1, pow(base, -1, 1 << 64))):
        at = np.maximum(n * sign, 0)
        square = b
        while at.any():
            odd = (at & 1).astype(bool)
            out[odd] *= np.uint64(square)
            square = square * square & _MASK
            at >>= 1
    return out


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


_TURN = "part long, conv long, at long, t1 long, t2 long, k1 long, k2 long, bytes long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of sorted turns within (task, conversation) and sums of digest times base^place up to them."""
    part = TaskContext.get().partitionId()
    last, seen, sums = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        t = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(n, 2)
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        at = np.arange(n) - starts[which] + 1
        if conv[0] == last:
            at[which == 0] += seen
        else:
            sums = [0, 0]
        k = []
        for i, base in enumerate(_BASES):
            total = np.cumsum(t[:, i] * _power(base, at))
            before = np.concatenate([[np.uint64(0)], total])[starts]
            total = total - before[which]
            total[which == 0] += np.uint64(sums[i])
            k.append(total)
        last, seen, sums = conv[-1], int(at[-1]), [int(x[-1]) for x in k]
        yield pa.RecordBatch.from_arrays(
            [_long(np.full(n, part)), batch.column("conv"), _long(at), _long(t[:, 0].copy()), _long(t[:, 1].copy()), *map(_long, k), batch.column("bytes")],
            names=["part", "conv", "at", "t1", "t2", "k1", "k2", "bytes"])


def _carried(turns: DataFrame) -> DataFrame:
    """Turns with the places and sums of whole conversations, from those within tasks.

    Only the first conversation of a task can have turns in tasks before it,
    so that what is carried over is at most one entry a task.
    """
    pieces = turns.groupBy("conv", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("k1", "k2"), "at").alias("k"))
    split = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("tasks"), F.collect_list(F.struct("part", "n", "k")).alias("pieces")).filter("tasks > 1")
    carry: dict[int, tuple] = {}
    for row in split.collect():  # conversations that lie in several tasks: fewer than tasks
        n, sums = 0, [0, 0]
        for piece in sorted(row["pieces"], key=lambda p: p["part"]):
            if n:
                carry[piece["part"]] = (row["conv"], n, *sums)
            for i, base in enumerate(_BASES):
                sums[i] = (sums[i] + pow(base, n, 1 << 64) * (piece["k"][i] & _MASK)) & _MASK
            n += piece["n"]
    if not carry:
        return turns.drop("part")
    known = turns.sparkSession.sparkContext.broadcast(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv").to_numpy()
            at = batch.column("at").to_numpy().copy()
            k = [batch.column(c).to_numpy().view(np.uint64).copy() for c in ("k1", "k2")]
            for p in np.unique(part):
                c, n, *sums = known.value.get(int(p), (None, 0, 0, 0))
                if c is not None:
                    hit = (part == p) & (conv == c)
                    at[hit] += n
                    for i, base in enumerate(_BASES):
                        k[i][hit] = k[i][hit] * np.uint64(pow(base, n, 1 << 64)) + np.uint64(sums[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), _long(at), batch.column("t1"), batch.column("t2"), *map(_long, k), batch.column("bytes")],
                names=["conv", "at", "t1", "t2", "k1", "k2", "bytes"])

    return turns.mapInArrow(run, _TURN.removeprefix("part long, "))


def _digest(role: str, text: str) -> F.Column:
    """128 bits that name a turn: its role's length keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))))


def turn_sums(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, t1, t2, k1, k2, bytes): every turn with its place from 1, its digest, and its prefix's identity."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    rows = rows.select("conv", "turn", _digest("role", "text").alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    # the last key lets a range end among equal turns
    dealt = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(partitions(spark), *order, F.col("salt").asc())
    return stored(_carried(stored(dealt.sortWithinPartitions(*order).mapInArrow(_scan, _TURN), "trie-scan")), "trie-turns")


# --- rebuilt conversations ----------------------------------------------------

def _rebuilt_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of turns that follow a head of another conversation: sums move from place ``at`` to ``depth``."""
    for batch in batches:
        col = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        shift, depth = col["depth"] - col["at"], col["depth"]
        out = {}
        for i, base in enumerate(_BASES, 1):
            own = col[f"k{i}"].view(np.uint64) - col[f"own{i}"].view(np.uint64)
            out[f"k{i}"] = col[f"head{i}"].view(np.uint64) + own * _power(base, shift)
            out[f"p{i}"] = out[f"k{i}"] - col[f"t{i}"].view(np.uint64) * _power(base, depth)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("depth"), *(_long(out[n]) for n in ("k1", "k2", "p1", "p2")), batch.column("bytes"), batch.column("length")],
            names=["conv", "depth", "k1", "k2", "p1", "p2", "bytes", "length"])


_ROW = "conv long, depth long, k1 long, k2 long, p1 long, p2 long, bytes long, length long"


def rebuilt_paths(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, depth, node, parent, bytes, length) of every turn of every rebuilt conversation, and of its root.

    Conversation c takes the first h turns of c - c % ``group``, with
    h = crc32(c as text) % ``heads``, then its own after the first h.
    """
    most = heads - 1
    near = F.when(F.col("at") <= most, F.struct("at", "t1", "t2", "k1", "k2", "bytes"))
    convs = stored(turns.groupBy("conv").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(near)).alias("first")), "trie-convs")
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int"))
    base = convs.select(F.col("conv").alias("base"), F.col("first").alias("lent"))
    plan = convs.join(base, "base", "left").withColumn("lent", F.when(F.col("h") > 0, F.slice(F.coalesce("lent", F.array().cast(base.schema["lent"].dataType)), 1, F.greatest("h", F.lit(1)))))
    plan = plan.withColumn("lent", F.coalesce("lent", F.array().cast(base.schema["lent"].dataType)))
    k = lambda rows, n, name: F.when(n > 0, F.try_element_at(rows, n)[name]).otherwise(F.lit(0))
    hb, ho = F.size("lent"), F.least("h", F.size("first"))
    plan = plan.select("conv", "h", "lent", hb.alias("hb"), (hb + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
                       *(k(F.col("lent"), hb, f"k{i}").alias(f"head{i}") for i in (1, 2)), *(k(F.col("first"), ho, f"k{i}").alias(f"own{i}") for i in (1, 2)))
    plan = stored(plan, "trie-heads")
    lent = plan.select("conv", "length", F.explode("lent").alias("r")).select(
        "conv", F.col("r.at").alias("at"), F.col("r.at").alias("depth"), "r.t1", "r.t2", "r.k1", "r.k2", F.lit(0).cast("long").alias("own1"), F.lit(0).cast("long").alias("own2"),
        F.lit(0).cast("long").alias("head1"), F.lit(0).cast("long").alias("head2"), "r.bytes", "length")
    own = (turns.join(plan.drop("lent"), "conv").filter(F.col("at") > F.col("h"))
           .select("conv", "at", (F.col("hb") + F.col("at") - F.col("h")).cast("long").alias("depth"), "t1", "t2", "k1", "k2", "own1", "own2", "head1", "head2", "bytes", "length"))
    rows = lent.union(own).mapInArrow(_rebuilt_keys, _ROW)
    zero = F.lit(0).cast("long")
    return rows.union(plan.select("conv", zero, zero, zero, zero, zero, zero, "length"))


# --- lists of members that end at a node -----------------------------------------

def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the lists that lie within the task; of its first and last list and of long ones, pieces."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    node, ids, chars, number, first = None, [], 0, 0, True

    def piece(text: str | None, sha: str | None = None) -> None:
        out.append((*node, part, number, text, sha))

    def full() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [*(pa.array(columns[i], pa.int64()) for i in range(5)), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.string())],
            names=[*KEY, "part", "number", "piece", "sha"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv"))):
            if row[:3] != node:
                if node is not None:
                    if not first and not number:
                        piece(None, hashlib.sha256(",".join(ids).encode()).hexdigest())
                    elif ids:
                        piece(",".join(ids))
                    first = False
                node, ids, chars, number = row[:3], [], 0, 0
            ids.append(str(row[3]))
            chars += len(ids[-1]) + 1
            if chars >= PIECE:
                piece(",".join(ids))
                ids, chars, number = [], 0, number + 1
            if len(out) >= 4_096 or (out and out[-1][5] and len(out[-1][5]) > 1 << 16):
                yield full()
    if node is not None:
        if ids:
            piece(",".join(ids))
        if out:
            yield full()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists whose pieces come one after the other."""
    node, state, done = None, None, []
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece"))):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if node is not None:
        done.append((*node, state.hexdigest()))
    if done:
        columns = list(zip(*done))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end.

    Members are sorted over the cluster by node and id, and a list may begin in
    one task and end in another; its pieces, a MB of text each, are then hashed
    in order.
    """
    n = partitions(paths.sparkSession)
    ends = paths.filter("depth = length").select(*KEY, "conv")
    made = stored(ends.repartitionByRange(n, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
                  .mapInArrow(_lists, "depth long, k1 long, k2 long, part long, number long, piece string, sha string"), "trie-ends")
    rest = made.filter("sha is null").repartition(n, *KEY).sortWithinPartitions(*KEY, "part", "number")
    return made.filter("sha is not null").select(*KEY, F.col("sha").alias("ends_sha256")).union(
        rest.mapInArrow(_joined, "depth long, k1 long, k2 long, ends_sha256 string"))


# --- time-forward processing ----------------------------------------------------

class SpillingQueue:
    """Priority queue of tuples: a heap, and sorted runs in the task's own unnamed files once it is full.

    A run's file has no name and lasts as long as the task; a task that is
    repeated on another executor makes its own.
    """

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            for entry in sorted(self.heap):
                pickle.dump(entry, run)
            run.seek(0)
            self.heap = []
            self.runs.append([pickle.load(run), run])

    def _least(self):
        best = min(self.runs, key=lambda r: r[0], default=None)
        return best if best is not None and (not self.heap or best[0] < self.heap[0]) else None

    def peek(self) -> tuple | None:
        run = self._least()
        return run[0] if run else self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        run = self._least()
        if run is None:
            return heapq.heappop(self.heap)
        item = run[0]
        try:
            run[0] = pickle.load(run[1])
        except EOFError:
            run[1].close()
            self.runs = [r for r in self.runs if r is not run]
        return item


_NODE = ["s1", "s2", "s3", "depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "bytes", "last"]
_NODE_SCHEMA = ", ".join(f"{n} long" for n in _NODE)
_DONE = [*_NODE, "n_children", "n_leaves", "saved_tokens"]
_DONE_SCHEMA = ", ".join(f"{n} long" for n in _DONE)


def time_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of shards in reverse level order, with the totals of their subtrees.

    A node takes what its children left in the queue, adds its own share and
    leaves the sum to its parent, unless it is its shard's root.  Rows may
    bring totals of other shards' roots (``c``, ``l``, ``s``).
    """
    queue, shard = SpillingQueue(), None
    for batch in batches:
        made = []
        given = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        extra = zip(*(given[n] for n in "cls")) if "c" in given else None
        for node in zip(*(given[n] for n in _NODE)):
            s1, s2, s3, depth, k1, k2, p1, p2, _, n_convs, size, last = node
            if (s1, s2, s3) != shard:
                shard, queue = (s1, s2, s3), SpillingQueue(queue.most)
            children, leaves, saved = next(extra) if extra else (0, 0, 0)
            while (top := queue.peek()) is not None and top[:3] == (-depth, k1, k2):
                _, _, _, c, l, s = queue.pop()
                children, leaves, saved = children + c, leaves + l, saved + s
            if n_convs == 1:  # the rest of one conversation: a path that saves nothing
                children, leaves = int(depth < last), 1
            leaves = leaves or 1
            saved += (n_convs - 1) * size
            if shard != (depth, k1, k2):
                queue.push((1 - depth, p1, p2, 1, leaves, saved))
            made.append((*node, children, leaves, saved))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=_DONE)


def prefix_trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered by ``turn``, null first, and equal ones by the MD5 digest
    of role and text; null roles and texts are empty.  Rows without a conv_id
    belong to no conversation.  Repeated rows are turns of their own.  Other
    columns are ignored.  No conversations give no nodes, not even a root.
    """
    spark = conversations.sparkSession
    paths = stored(rebuilt_paths(turn_sums(conversations), group, heads), "trie-paths")
    rows = paths.withColumn("below", F.col("length") - F.col("depth") + 1)
    nodes = stored(rows.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("bytes").alias("bytes"), F.max("length").alias("last"), F.sum("below").alias("below")), "trie-nodes")

    # nodes above all shards: those with more turns below them than a shard may have
    limit = max(SHARD_TURNS, paths.count() // SHARES)
    above = stored(nodes.filter((F.col("below") > limit) & (F.col("n_convs") > 1)), "trie-above")
    marks = above.select(*KEY, F.lit(True).alias("is_above"))
    marks = F.broadcast(marks) if above.limit(MARKED + 1).count() <= MARKED else marks
    marked = paths.select("conv", *KEY).join(marks, KEY, "left")
    # the first node of a conversation's path that is not above is the root of its shard
    shards = (marked.filter("is_above is null").groupBy("conv").agg(F.min_by(F.struct(*KEY), "depth").alias("s"))
              .select(F.col("conv").alias("conv_id"), F.col("s.depth").alias("s1"), F.col("s.k1").alias("s2"), F.col("s.k2").alias("s3")))

    # of nodes with one member only the first of a path has totals to pass on
    alone = nodes.filter("n_convs = 1")
    tops = alone.groupBy("conv_id").agg(F.min_by(F.struct(*alone.columns), "depth").alias("r")).select("r.*")
    inner = nodes.filter("n_convs > 1").join(marks, KEY, "left_anti").select(*nodes.columns)
    low = inner.union(tops.select(*nodes.columns)).join(shards, "conv_id").select(*_NODE)
    dealt = low.repartition(partitions(spark), "s1", "s2", "s3").sortWithinPartitions("s1", "s2", "s3", F.desc("depth"), "k1", "k2")
    done = stored(dealt.mapInArrow(time_forward, _DONE_SCHEMA), "trie-low")

    # across shard roots: their totals, added up for each node that they go to
    to = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    sent = (done.filter("depth > 0 and s1 = depth and s2 = k1 and s3 = k2").groupBy(*to)
            .agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")))
    zero = [F.lit(0).cast("long").alias(n) for n in ("s1", "s2", "s3")]
    high = above.join(sent, KEY, "left").select(*zero, *_NODE[3:], *(F.coalesce(n, F.lit(0)).alias(n) for n in "cls"))
    high = high.repartition(1).sortWithinPartitions(F.desc("depth"), "k1", "k2").mapInArrow(time_forward, _DONE_SCHEMA)

    out = [*KEY, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    single = alone.select(*KEY, "p1", "p2", "conv_id", "n_convs", (F.col("depth") < F.col("last")).cast("long").alias("n_children"),
                          F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    every = stored(done.filter("n_convs > 1").select(*out).union(high.select(*out)).union(single), "trie-totals")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (every.join(parents, ["depth", "p1", "p2"], "left").join(_ends(paths), KEY, "left")
            .select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
