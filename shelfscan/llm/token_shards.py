"""Token-id shards with a minimal perfect hash index for keyed access.

A shard file is a run of segments, each followed by a line feed:

    ids        all documents' ids, one after another, little-endian, of
               two bytes where the vocabulary allows and else of four
    directory  for each document in order: key int64, ids uint32
    displaced  uint32 for each bucket of the hash
    slots      for each distinct key: fingerprint uint32, first id uint64, ids uint32
    footer     magic, bytes of an id, ids, documents, distinct keys, buckets
               (uint64 each)

A key is hashed once (64 bits); its bucket's displacement names its slot, so
that a lookup reads three places whatever the number of keys, and the stored
fingerprint rejects keys that the segment does not hold.  The directory lists
the documents in order; lookups do not read it.

Spark's text writer stores the segments and its committer publishes each
task's file once, so that lost executors and repeated tasks leave no partial
file, on any file system that Spark can write.  Files sort in key order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import partitions, shared_folder, stored, text_or_empty
from .words import mix64

MAGIC = 0x3144485350414D31
SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u4")])
ENTRY = np.dtype([("key", "<i8"), ("count", "<u4")])
FOOTER = struct.Struct("<6Q")
#: Keys per bucket of the hash on average.
PER_BUCKET = 4
#: Ids of a segment, but for a single longer document.
SEGMENT_IDS = 4_000_000
#: Segments in a file: it is read as a whole, and has about 100 MB at most unless a single text has more.
SEGMENTS_A_FILE = 8
#: Stands for a null key.
NULL_KEY = -(1 << 63)


# --- index ---------------------------------------------------------------

def _hash(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(max(buckets, 1))).astype(np.int64)


def _slot(hashes: np.ndarray, displacement, slots: int) -> np.ndarray:
    return (mix64(hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(displacement, np.uint64)) % np.uint64(max(slots, 1))).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key) of distinct keys: every slot is taken once.

    Buckets are placed in falling order of size, each by the first
    displacement that sends all its keys to free slots.
    """
    hashes, n = _hash(keys), len(keys)
    buckets = -(-n // PER_BUCKET)
    of = _bucket(hashes, buckets)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    taken, displaced, slots = np.zeros(n, bool), np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    for b in np.argsort(ends[:-1] - ends[1:], kind="stable").tolist():
        members = order[ends[b]:ends[b + 1]]
        if not len(members):
            break
        at = 0
        while True:
            # Many displacements at once: the last buckets find few free slots.
            tried = np.arange(at, at + 64, dtype=np.uint64)
            places = _slot(hashes[members][:, None], tried[None, :], n)
            free = ~taken[places].any(axis=0)
            if len(members) > 1:
                sorted_ = np.sort(places, axis=0)
                free &= (sorted_[1:] != sorted_[:-1]).all(axis=0)
            if free.any():
                k = int(np.argmax(free))
                displaced[b], slots[members] = at + k, places[:, k]
                taken[places[:, k]] = True
                break
            at += 64
    return displaced, slots


def segment(keys: np.ndarray, payloads: list[bytes], width: int) -> bytes:
    """A segment of documents in ascending key order; the index holds a repeated key's first document."""
    counts = np.array([len(p) // width for p in payloads], np.int64)
    starts = np.cumsum(counts) - counts
    distinct, first = np.unique(keys, return_index=True)
    displaced, slots = build_hash(distinct)
    table = np.zeros(len(distinct), SLOT)
    table["print"][slots] = (_hash(distinct) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    table["start"][slots], table["count"][slots] = starts[first], counts[first]
    directory = np.zeros(len(keys), ENTRY)
    directory["key"], directory["count"] = keys, counts
    return b"".join([*payloads, directory.tobytes(), displaced.astype("<u4").tobytes(), table.tobytes(),
                     FOOTER.pack(MAGIC, width, int(counts.sum()), len(keys), len(distinct), len(displaced))])


class Segment:
    """Keyed access to the bytes of one segment."""

    def __init__(self, data: memoryview) -> None:
        magic, width, total, documents, keys, buckets = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = len(data) - FOOTER.size - keys * SLOT.itemsize
        self.slots = np.frombuffer(data, SLOT, keys, at)
        self.displaced = np.frombuffer(data, "<u4", buckets, at := at - 4 * buckets)
        self.directory = np.frombuffer(data, ENTRY, documents, at := at - documents * ENTRY.itemsize)
        self.begin = at - width * total
        self.ids = np.frombuffer(data, f"<u{width}", total, self.begin)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(held, first id, ids) of each key."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h = _hash(keys)
        slot = self.slots[_slot(h, self.displaced[_bucket(h, len(self.displaced))], len(self.slots))]
        return slot["print"] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), slot["start"].astype(np.int64), slot["count"].astype(np.int64)

    def get(self, key: int) -> np.ndarray | None:
        held, start, count = self.find(np.array([key]))
        return self.ids[start[0]:start[0] + count[0]] if held[0] else None


def segments(data: bytes) -> list[Segment]:
    """A shard file's segments in order, found from its end by their footers."""
    found, view = [], memoryview(data)
    while len(view):
        found.append(Segment(view[:-1]))
        view = view[:found[-1].begin]
    return found[::-1]


# --- encoding --------------------------------------------------------------

#: Words that a worker remembers the ids of.
CACHE_ENTRIES = 1_500_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A text with other characters, or with two spaces in a row, is encoded in one piece by the library.
_UNUSUAL = re.compile(f"[^\n\x20-\x7e{_LETTERS}]|  ").search
#: The byte-level pre-tokeniser's pattern (fixed) for texts of the other characters, without apostrophes.
_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+").findall
#: Pieces of at most so many characters are remembered whole.
_SHORT = 8
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Whole-text encoding by the tokenizers library, each distinct word once.

    The byte-level pre-tokeniser always cuts before a space that follows
    another character than white space, so that a text without two spaces in a
    row can be cut there by ``str.split`` and pieces by the pattern; pieces
    with apostrophes go through the library's own pre-tokeniser, and every
    distinct pre-token through its model.
    Ids take two bytes where the vocabulary allows.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.width = id_width(self.whole.get_vocab_size())
        pre = self.whole.pre_tokenizer.pre_tokenize_str
        simple = [chr(c) for c in (10, *range(32, 127), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
        self.shown = {ord(c): "".join(t for t, _ in pre(c)) for c in simple}  # as the vocabulary spells them
        self.cache: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.whole.model.tokenize(token)])

    def _held(self, text: str) -> bytes:
        found = self.cache.get(text)
        if found is None:
            found = self._token(text.translate(self.shown))
            if len(self.cache) < CACHE_ENTRIES:
                self.cache[text] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if "'" in piece:
            return b"".join([self._token(t) for t, _ in self.whole.pre_tokenizer.pre_tokenize_str(piece)])
        parts = _PARTS(piece)
        if len(parts) == 1:
            return self._held(piece)
        found = b"".join([self._held(part) for part in parts])
        if len(piece) <= _SHORT and len(self.cache) < CACHE_ENTRIES:
            self.cache[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian, of ``width`` bytes."""
        if not text:
            return b""
        if _UNUSUAL(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()
        known, piece = self.cache.get, self._piece
        return b"".join([known(p) or piece(p) for p in text.replace(" ", "\0 ").split("\0")])


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def encoder(path: str) -> Encoder:
    """The vocabulary file's encoder, loaded once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- Spark jobs ------------------------------------------------------------

def _segment_writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width, keys, payloads, size = encoder(path).encode, encoder(path).width, [], [], 0
        end = end_id.to_bytes(width, "little")
        row = lambda: pa.RecordBatch.from_pydict({"segment": pa.array([segment(np.array(keys, np.int64), payloads, width)], pa.binary())})
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                ids = encode(text.as_py()) + end
                if keys and size + len(ids) // width > SEGMENT_IDS:
                    yield row()
                    keys, payloads, size = [], [], 0
                keys.append(NULL_KEY if key.as_py() is None else key.as_py())
                payloads.append(ids)
                size += len(ids) // width
        if keys:
            yield row()
    return run


#: Key ranges of the files; Spark's readers of the shards pass over a folder of such a name.
RANGES_FOLDER, RANGES = "_ranges", "file string, low long, high long"


def write_shards(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text and write the shards to the new folder ``path``.

    Rows are stored in ascending order of integer id, then text; null ids
    come first; null texts are empty and have the end id alone; repeated rows
    are stored each; an empty table gives a folder without segments.  Each
    task streams one range of ids and holds one segment.
    """
    n = partitions(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    ordered = docs.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    ordered.mapInArrow(_segment_writer(tokenizer, end_id), "segment binary").select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).text(path)
    files = documents.sparkSession.read.format("binaryFile").load(path).select("path", "content")
    files.mapInArrow(_ranges, RANGES).write.parquet(f"{path}/{RANGES_FOLDER}")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, low, high): each shard file's smallest and largest key."""
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content")):
            held = [s.directory["key"] for s in segments(content.as_py())]
            if held:
                yield pa.RecordBatch.from_pydict({"file": [name.as_py()], "low": [int(held[0][0])], "high": [int(held[-1][-1])]},
                                                 schema=pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content")):
            at = 0
            for s in segments(content.as_py()):
                # The index gives each key's first document; the directory has the order and the repeats that follow it.
                keys, counts = s.directory["key"].astype(np.int64), s.directory["count"].astype(np.int64)
                places = np.cumsum(counts) - counts
                distinct, first, key = np.unique(keys, return_index=True, return_inverse=True)
                held, start, count = s.find(distinct)
                agree = held.all() and (start == places[first]).all() and (count == counts[first]).all()
                starts = start[key] + places - places[first][key]
                counts[first] = count
                if not agree:
                    raise ValueError(f"{name}: the index does not lead to the documents")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(keys)), pa.array(keys, mask=keys == NULL_KEY), pa.array(at + starts), pa.array(counts),
                     pa.array([zlib.crc32(s.ids[a:a + c].astype("<u4")) for a, c in zip(starts, counts)], pa.int64())],
                    names=["file", "key", "place", "count", "crc"])
                at += int(counts.sum())


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, through the index of its segment.

    ``start`` counts the ids of all documents before it in the data set.  Only
    the files' totals meet in one place: a row for each file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    docs = stored(files.mapInArrow(_documents, "file string, key long, place long, count long, crc long"), "shard-documents")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("file").agg(F.sum("count").alias("total"))
    begins = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    return docs.join(begins, "file").select(
        F.col("key").alias(id_col), (F.col("begin") + F.col("place")).alias("start"), F.col("count").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of the given keys that the shards hold: by their indexes, of the files alone whose key ranges hold a key."""
    wanted = np.unique(np.array(keys, np.int64))
    asked = F.broadcast(spark.createDataFrame([(int(k),) for k in wanted], "key long"))
    ranges = spark.read.schema(RANGES).parquet(f"{path}/{RANGES_FOLDER}")
    chosen = [r["file"] for r in ranges.join(asked, F.col("key").between(F.col("low"), F.col("high")), "left_semi").select("file").collect()]
    if not chosen:
        return spark.createDataFrame([], "key long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for s in segments(content.as_py()):
                    span = s.directory["key"]
                    near = wanted[(wanted >= span[0]) & (wanted <= span[-1])]
                    held, start, count = s.find(near)
                    yield pa.RecordBatch.from_pydict(
                        {"key": near[held], "ids": [s.ids[a:a + c].astype(np.int32) for a, c in zip(start[held], count[held])]},
                        schema=pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return spark.read.format("binaryFile").load(chosen).select("content").mapInArrow(run, "key long, ids array<int>")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
