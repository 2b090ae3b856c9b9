"""I-Match fingerprints over several randomised lexicons.

The lexicon is the set of terms whose inverse document frequency lies in a
chosen band.  ``GROUPS`` random partitions cut it into subsets that hold a
half, a quarter, an eighth ... of its terms; a text's distinct terms of each
subset are sorted and hashed.  Two texts agree on a subset when none of the
terms in which they differ falls into it, so sparse subsets survive edits that
dense ones don't: the number of agreements estimates the likeness of the
texts' term sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import range_starts
from .support import partitions, stored, text_or_empty
from .words import NOT_ALNUM, mix64, slices, word_hashes

#: Random partitions of the lexicon, and subsets in each: of 1/2, 1/4, ... of the terms.
GROUPS, LEVELS = 8, 13
#: Band of idf = ln(documents / documents with the term): terms of between 1 in
#: 20 and 1 in 5,000 documents.  A lexicon has at most (mean distinct terms of a
#: document) / MIN_SHARE entries of 8 bytes, whatever the number of documents.
MAX_SHARE, MIN_SHARE = 1 / 20, 1 / 5_000
#: Largest lexicon that is broadcast; a larger one (documents of over 400
#: distinct terms on average) means that MIN_SHARE must be raised.
MAX_LEXICON = 2_000_000
#: Terms that a task counts before it hands the counts on.
FLUSH_TERMS = 2_000_000

_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, GROUPS, dtype=np.uint64)


def distinct_terms(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text; terms are runs of letters and digits, A-Z as a-z."""
    for _, _, data, offsets in slices(column):
        h, first = word_hashes(data, offsets, NOT_ALNUM)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(h[a:b])


def term_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): number of rows with each term, added up within tasks first."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(terms), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at:at + 200_000].view(np.int64)), pa.array(df[at:at + 200_000])], schema=schema)

        for batch in batches:
            for terms in distinct_terms(batch.column(0)):
                held.append(terms)
                size += len(terms)
                if size >= FLUSH_TERMS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    partial = documents.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "term long, df long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(documents: DataFrame, text_col: str = "text", max_share: float = MAX_SHARE, min_share: float = MIN_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents."""
    n = documents.count()
    band = term_counts(documents, text_col).filter(F.col("df").between(min_share * n, max_share * n))
    band = stored(band.select("term"), "lexicon")
    if band.count() > MAX_LEXICON:
        raise ValueError(f"over {MAX_LEXICON} terms in the band; raise min_share")
    return np.sort(band.toArrow().column("term").to_numpy().view(np.uint64))


@dataclass
class Print:
    """A text's fingerprint: a hash of all its lexicon terms, and one of those in each subset (0: none)."""
    whole: int
    subsets: np.ndarray

    @property
    def shown(self) -> np.ndarray:
        """The part of each subset's hash that the text shows, and that likeness goes by (0: no terms)."""
        return (self.subsets & np.uint64(0xFFFF)).astype(">u2")

    def text(self) -> str:
        return f"{self.whole:016x}" + self.shown.tobytes().hex()

    @classmethod
    def of(cls, text: str) -> Print:
        """The fingerprint that a text shows."""
        return cls(int(text[:16], 16), np.frombuffer(bytes.fromhex(text[16:]), ">u2").astype(np.uint64))


def fingerprint(terms: np.ndarray, band: np.ndarray) -> Print:
    """Fingerprint of sorted distinct terms; without a term in the band, all terms count."""
    if len(band) and len(terms):
        at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
        kept = terms[band[at] == terms]
        terms = kept if len(kept) else terms
    subsets = np.zeros(GROUPS * LEVELS, np.uint64)
    if not len(terms):
        return Print(0, subsets)
    for g, seed in enumerate(_SEEDS):
        u = mix64(terms ^ seed) >> np.uint64(11)
        # The leading zeros of 53 random bits: each level has half of the terms of that before.
        level = np.minimum(53 - np.frexp(u.astype(np.float64))[1], LEVELS - 1)
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(LEVELS + 1))
        members = terms[order]
        for k in np.flatnonzero(ends[1:] > ends[:-1]):
            subsets[g * LEVELS + k] = xxhash.xxh3_64_intdigest(members[ends[k]:ends[k + 1]].tobytes(), seed=g) | 1
    return Print(xxhash.xxh3_64_intdigest(terms.tobytes()), subsets)


def likeness(a: Print, b: Print) -> float:
    """1 for equal fingerprints, else the estimated Jaccard likeness of the term sets, by what the fingerprints show.

    Over subsets of shares 1/2, 1/4, ..., the expected number of agreeing
    non-empty subsets of a partition is -log2(1 - J).
    """
    if a.whole == b.whole:
        return 1.0
    agree = int(np.count_nonzero((a.shown == b.shown) & (a.shown != 0)))
    return 1.0 - 2.0 ** (-agree / GROUPS)


def fingerprints(documents: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, whole, subsets) of every row, by a broadcast lexicon.

    Null and empty texts have the fingerprint of no terms (all zeros).
    """
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kept = documents.sparkSession.sparkContext.broadcast(band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, kept.value) for t in distinct_terms(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([p.text() for p in prints], pa.string()),
                 pa.array([np.uint64(p.whole).astype(np.int64) for p in prints], pa.int64()),
                 pa.array([p.subsets.view(np.int64) for p in prints], pa.list_(pa.int64()))],
                names=[id_col, "fingerprint", "whole", "subsets"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, whole long, subsets array<long>")


def _packer(starts: list[int], first: int | None):
    """Packs texts and adds the number of their id's range.

    A range's first rows are also the previous range's tail (the first
    range's that of the last), where they only serve as next documents.
    """
    bounds = np.array(starts, np.int64)
    lowest = -(1 << 63)
    heads = {s: r + 1 for r, s in enumerate(starts)} | {lowest if first is None else first: 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column("id").to_pylist()
            keys = np.array([lowest if i is None else i for i in ids], np.int64)
            ranges = np.searchsorted(bounds, keys, "right").tolist()
            packed = [pack(t.encode()) for t in batch.column("text").to_pylist()]
            rows = [(r, False, i, p) for r, i, p in zip(ranges, ids, packed)]
            rows += [((heads[k] - 1) % (len(starts) + 1), True, i, p) for k, i, p in zip(keys.tolist(), ids, packed) if k in heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()))] if rows else
                [pa.array([], t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.binary())],
                names=["range", "tail", "id", "packed"])
    return run


#: Rows whose texts are hashed together.
_ROWS = 64


def _comparer(kept):
    """Streams ranges in order and compares each text with its edited form and the next text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        band = kept.value
        carried = None  # (range, id, text, print) of the last row so far

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    texts = [unpack(p).decode() for p in part.column("packed").to_pylist()]
                    prints = [fingerprint(t, band) for t in distinct_terms(pa.array(texts, pa.large_string()))]
                    yield list(zip(part.column("range").to_pylist(), part.column("tail").to_pylist(), part.column("id").to_pylist(), texts, prints))

        for block in rows():
            pairs = []
            for number, tail, key, text, print_ in block:
                if carried is not None and carried[0] == number:
                    pairs.append((carried, text, print_))
                carried = None if tail else (number, key, text, print_)
            edited = [a[2][:len(a[2]) - len(a[2]) // 2] + text[:len(a[2]) // 2] for a, text, _ in pairs]
            edited_prints = [fingerprint(t, band) for t in distinct_terms(pa.array(edited, pa.large_string()))]
            yield pa.RecordBatch.from_pydict({
                "id": [a[1] for a, _, _ in pairs], "n_chars": [len(a[2]) for a, _, _ in pairs],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [a[3].text() for a, _, _ in pairs], "edited_fingerprint": [p.text() for p in edited_prints],
                "near_edited": [likeness(a[3], p) for (a, _, _), p in zip(pairs, edited_prints)],
                "near_next": [likeness(a[3], p) for a, _, p in pairs]}, schema=_COMPARED)
    return run


_COMPARED = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit_likeness(documents: DataFrame, band: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint against that of its edited text and of the next row's text.

    Edited: the last half of the code points is replaced by as many of the
    next text's first ones (all of them, if there are fewer).  Next: in
    ascending order of integer id, then text; after the last row comes the
    first, also where it is the only one.  Null ids come first; null texts are
    empty; repeated rows are rows of their own, and an empty table gives an
    empty table.  Texts cross the network once, compressed, into one partition
    for each range of ids; a task streams its range with one text held back.
    """
    spark = documents.sparkSession
    band = lexicon(documents, text_col) if band is None else band
    docs = documents.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    lowest = docs.agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    starts = [s for s in range_starts(docs, "id") if lowest["nulls"] or s > lowest["first"]]
    ranged = (docs.mapInArrow(_packer(starts, None if lowest["nulls"] else lowest["first"]), "range int, tail boolean, id long, packed binary")
              .repartitionById(max(partitions(spark), len(starts) + 1), F.col("range"))
              .sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), "packed"))
    compared = ranged.mapInArrow(
        _comparer(spark.sparkContext.broadcast(band)),
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return compared.withColumnRenamed("id", id_col)
