"""Ranked lexical search over a length-stratified index.

The index is a table of segments.  A segment holds whole documents of a few MB
of text; its documents are grouped into strata of equal length normaliser, and
a term's postings are runs of one stratum and one term frequency, the most
frequent first.  A run's impact on the score is the same for all its documents
and computed once.  For each query the first runs of its terms bound what a
stratum can score; strata are visited in the order of their bounds, until the
next bound is under the worst of the best documents found so far.

Documents never move: segments are built where texts are read, and only counts
and each task's best documents cross the network.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import shared_folder, small_batches, stored, text_or_empty
from .words import NOT_ALNUM, slices, word_hashes

#: Bytes of text in a segment, which holds one text at least, and segments in a file.
SEGMENT_BYTES, SEGMENTS_A_FILE = 8 << 20, 16
#: Rows (query, term) that are searched for at once; larger query sets go in several blocks.
BLOCK_TERMS = 1 << 18
#: Sums of impacts below this are exact as doubles.
_EXACT = 1 << 53


# --- lengths -----------------------------------------------------------------

def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of a task; terms are counted without being hashed."""
    documents = terms = 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            raw = np.frombuffer(data, np.uint8)
            opens = ~NOT_ALNUM[raw]
            fresh = np.zeros(len(raw) + 1, bool)
            fresh[offsets] = True
            if len(raw):
                opens[1:] &= NOT_ALNUM[raw[:-1]] | fresh[1:len(raw)]
            each = np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets])
            documents, terms = documents + int((each > 0).sum()), terms + int(each.sum())
    yield pa.RecordBatch.from_pydict({"documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})


def corpus_lengths(documents: DataFrame) -> tuple[int, int]:
    """Number of documents that have a term, and number of all their terms."""
    counted = documents.select("text").mapInArrow(_lengths, "documents long, terms long")
    row = counted.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def normalisers(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of these lengths: 75 + 25 n N div L."""
    distinct, at = np.unique(lengths, return_inverse=True)
    return np.array([75 + 25 * int(n) * documents // terms for n in distinct], np.int64)[at]


# --- segments ------------------------------------------------------------------

_FIELDS = ["ids", "nulls", "m", "sizes", "terms", "df", "runs", "stratum", "tf", "length", "docs"]
_TYPES = ["<i8", "?", "<i8", "<u4", "<u8", "<u4", "<u4", "<u2", "<u4", "<u4", "<u4"]


def _runs_of(changed: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where ``changed`` is true."""
    starts = np.flatnonzero(changed)
    return np.diff(np.append(starts, len(changed)))


def segment(ids: list, words: list[np.ndarray], documents: int, terms: int) -> dict[str, np.ndarray] | None:
    """The arrays of one segment: documents in strata, postings in runs.

    ``m`` and ``sizes`` are the strata's normalisers and numbers of documents;
    ``df`` and ``runs`` each term's documents and runs; ``stratum``, ``tf`` and
    ``length`` the runs; ``docs`` the places of documents within their stratum.
    """
    lengths = np.array([len(w) for w in words])
    some = np.flatnonzero(lengths)
    if not len(some):
        return None
    m = normalisers(lengths[some], documents, terms)
    known = np.array([0 if ids[i] is None else ids[i] for i in some], np.int64)
    nulls = np.array([ids[i] is None for i in some])
    order = np.lexsort((known, nulls, m))
    levels, sizes = np.unique(m, return_counts=True)
    if len(levels) > 1 << 16:
        raise ValueError("a segment has more strata than two bytes can number")
    stratum = np.repeat(np.arange(len(levels)), sizes)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(some)), lengths[some][order])
    names, term = np.unique(np.concatenate([words[some[i]] for i in order]), return_inverse=True)
    pair, tf = np.unique(term * np.int64(len(some)) + doc, return_counts=True)
    term, doc = np.divmod(pair, len(some))
    # terms in order, then strata, then falling frequencies, then documents
    by = np.lexsort((doc, -tf, stratum[doc], term))
    term, doc, tf = term[by], doc[by], tf[by]
    level = stratum[doc]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (level[1:] != level[:-1]) | (tf[1:] != tf[:-1])
    at = np.flatnonzero(fresh)
    return dict(ids=known[order], nulls=nulls[order], m=levels, sizes=sizes, terms=names, df=np.bincount(term, minlength=len(names)),
                runs=np.bincount(term[at], minlength=len(names)), stratum=level[at], tf=tf[at], length=_runs_of(fresh), docs=doc - begin[level])


def _segments(documents: int, terms: int):
    def row(ids, words):
        made = segment(ids, words, documents, terms)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made[f].astype(t).tobytes()], pa.binary()) for f, t in zip(_FIELDS, _TYPES)], names=_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for batch in batches:
            keys = batch.column("id").to_pylist()
            for a, b, data, offsets in slices(batch.column("text")):
                h, first = word_hashes(data, offsets, NOT_ALNUM)
                if ids and (held + len(data) > SEGMENT_BYTES or len(ids) + b - a > 1 << 16):
                    yield from row(ids, words)
                    ids, words, held = [], [], 0
                ids += keys[a:b]
                words += [h[x:y] for x, y in zip(first[:-1], first[1:])]
                held += len(data)
        if ids:
            yield from row(ids, words)
    return run


class LexicalIndex:
    """Segments of all documents, written to the shared folder, and the corpus's lengths."""

    def __init__(self, segments: DataFrame, documents: int, terms: int):
        self.segments, self.documents, self.terms = segments, documents, terms


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Index every row's whole text; texts without terms are in no segment."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n, l = corpus_lengths(docs)
    schema = ", ".join(f"{f} binary" for f in _FIELDS)
    path = f"{shared_folder(spark)}/lexical-index-{uuid.uuid4().hex}"
    docs.mapInArrow(_segments(n, l), schema).write.option("maxRecordsPerFile", SEGMENTS_A_FILE).option("compression", "zstd").parquet(path)
    return LexicalIndex(spark.read.schema(schema).parquet(path), n, l)


# --- queries -----------------------------------------------------------------------

def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            h, first = word_hashes(data, offsets, NOT_ALNUM)
            each = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), each))), pa.array(h[first[0]:first[-1]].view(np.int64))], names=["item", "term"])


def _frequencies(wanted):
    """Documents of each wanted term in a task's segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for names, df in zip(batch.column("terms"), batch.column("df")):
                names, df = np.frombuffer(names.as_buffer(), "<u8"), np.frombuffer(df.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
                total += np.where(names[at] == terms, df[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])
    return run


class _Best:
    """The k best documents of one query so far: by score, then null ids last, then id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, null, key) -> None:
        score, null, key = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, key])
        order = np.lexsort((key, null, -score))[:self.k]
        self.score, self.null, self.id = score[order], null[order], key[order]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges that begin at ``starts`` and have ``counts`` members."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def search_segment(seg: dict[str, np.ndarray], terms: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], best: list[_Best]) -> int:
    """Offer a segment's documents to the queries, (places of terms, weights) each; the number of strata visited."""
    at = np.minimum(np.searchsorted(seg["terms"], terms), len(seg["terms"]) - 1)
    there = seg["terms"][at] == terms
    run_end, post_end, doc_end = np.cumsum(seg["runs"]), np.cumsum(seg["length"]), np.cumsum(seg["sizes"])
    run_count = np.where(there, seg["runs"][at], 0).astype(np.int64)
    run_start = run_end[at].astype(np.int64) - seg["runs"][at]
    stratum, tf = seg["stratum"], seg["tf"]
    visited = 0
    # impacts, once for each run of a term that some query has
    used = _spread(run_start, run_count)
    impact = np.zeros(len(tf), np.int64)
    f = tf[used].astype(np.int64)
    impact[used] = 1_000_000_000 * f // (1000 * f + 12 * seg["m"][stratum[used]])
    for (mine, weights), top in zip(queries, best):
        count = run_count[mine]
        runs = _spread(run_start[mine], count)
        if not len(runs):
            continue
        value, level = impact[runs] * np.repeat(weights, count), stratum[runs]
        first = np.ones(len(runs), bool)
        first[1:] = level[1:] != level[:-1]
        first[np.cumsum(count)[:-1][np.cumsum(count)[:-1] < len(runs)]] = True
        bound = np.zeros(len(seg["m"]), np.int64)
        np.add.at(bound, level[first], value[first])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        begin, width = 0, 1
        while begin < len(order) and bound[order[begin]] >= top.least:
            chosen = order[begin:begin + width]
            chosen = chosen[bound[chosen] >= top.least]
            visited += len(chosen)
            hit = np.isin(level, chosen) if len(chosen) < len(order) else np.ones(len(runs), bool)
            r = runs[hit]
            size = seg["length"][r].astype(np.int64)
            places = _spread(post_end[r].astype(np.int64) - size, size)
            doc = seg["docs"][places] + np.repeat((doc_end[level[hit]] - seg["sizes"][level[hit]]).astype(np.int64), size)
            value_of = np.repeat(value[hit], size)
            if bound[order[0]] < _EXACT:
                score = np.bincount(doc, weights=value_of, minlength=len(seg["ids"])).astype(np.int64)
            else:
                score = np.zeros(len(seg["ids"]), np.int64)
                np.add.at(score, doc, value_of)
            good = np.flatnonzero(score >= top.least)
            top.add(score[good], seg["nulls"][good], seg["ids"][good])
            begin, width = begin + width, width * 2
    return visited


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, queries = block.value
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                seg = {f: np.frombuffer(batch.column(f)[i].as_buffer(), t) for f, t in zip(_FIELDS, _TYPES)}
                search_segment(seg, terms, queries, best)
        query = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        null = np.concatenate([b.null for b in best]) if best else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(np.concatenate([b.id for b in best]) if best else [], pa.int64(), mask=null),
             pa.array(np.concatenate([b.score for b in best]) if best else [], pa.int64())], names=["query", "doc", "score"])
    return run


def search(index: LexicalIndex, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item, rank, id, score): each item's ``k`` best documents with a score above 0.

    Rows of one item id are one query of all their terms; an item without
    terms, or whose terms no document has, has no rows.  Every row of the
    documents is a document of its own, also where ids repeat.  Equal scores
    come by ascending id, a null id last.  Terms are told apart by 64-bit
    hashes.  An empty index or no items give no rows.
    """
    spark = items.sparkSession
    given = items.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    kind = given.schema["item"].dataType.simpleString()
    found = given.mapInArrow(_query_terms, f"item {kind}, term long")
    terms = stored(found.groupBy("item", "term").agg(F.count(F.lit(1)).alias("n")), "lexical-queries")
    blocks = 1 + terms.count() // BLOCK_TERMS
    parts = []
    for b in range(blocks if index.documents else 0):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
        if not rows.num_rows:
            continue
        names, at = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
        wanted = spark.sparkContext.broadcast(names)
        counted = index.segments.select("terms", "df").mapInArrow(_frequencies(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = dict(zip(counted.column("term").to_numpy().view(np.uint64).tolist(), counted.column("df").to_pylist()))
        weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t in names.tolist()], np.int64)
        item = rows.column("item").to_pylist()
        starts = [i for i in range(len(item)) if i == 0 or item[i] != item[i - 1]]
        queries = [(at[x:y], weight[at[x:y]] * rows.column("n").to_numpy()[x:y]) for x, y in zip(starts, [*starts[1:], len(item)])]
        block = spark.sparkContext.broadcast((names, queries))
        best = index.segments.mapInArrow(_search(block, k), "query long, doc long, score long")
        numbered = spark.createDataFrame([(i, item[s]) for i, s in enumerate(starts)], f"query long, item {kind}")
        parts.append(stored(best, "lexical-best").join(F.broadcast(numbered), "query").select("item", "doc", "score"))
    if not parts:
        parts = [terms.limit(0).select("item", F.col("term").alias("doc"), F.col("n").alias("score"))]
    every = reduce(DataFrame.union, parts)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index ``documents`` and search them for every row of ``items``."""
    return search(build_index(documents), items, k)
