"""Byte-level BPE by rank files, with overlapping chunks for long texts.

A long text is cut into overlapping chunks that tasks pre-tokenise on their
own.  The pattern looks only forward, so from any boundary that two chunks
share they agree; there the text is cut into pieces that are encoded on their
own and concatenated.  Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import partitions, stored, text_or_empty

#: Characters that a chunk owns, and how far it reads on into the next one.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: A boundary this near to a chunk's end may depend on characters beyond it.
LOOKAHEAD = 4
#: Rows of one Arrow batch of ids.
BATCH_ROWS = 512

_encodings: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """The rank file's encoder, loaded once in each Python worker."""
    import tiktoken

    key = (ranks_path, pattern)
    if key not in _encodings:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def boundaries(chunk: str, pattern: str, last: bool) -> list[int]:
    """Ends of the chunk's pre-tokens at which the text may be cut.

    A cut after white space could join two tokens of a run, and a boundary
    near a chunk's end may come from that end alone: neither counts.
    """
    import regex

    limit = len(chunk) if last else len(chunk) - LOOKAHEAD
    return [m.end() for m in regex.compile(pattern).finditer(chunk)
            if m.end() <= limit and not chunk[m.end() - 1].isspace()]


def _encoder(ranks_path: str, pattern: str, keys: list[str]):
    """Encodes the column ``text`` and keeps the columns ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = [enc.encode_to_numpy(t, disallowed_special=()) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*keys, "ids"])
    return run


def _chunker(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                starts = range(0, len(text), chunk)
                yield pa.RecordBatch.from_pydict(
                    {"doc": [doc] * len(starts), "number": list(range(len(starts))), "chunks": [len(starts)] * len(starts), "text": [text[s:s + chunk + overlap] for s in starts]},
                    schema=pa.schema([("doc", pa.int64()), ("number", pa.int32()), ("chunks", pa.int32()), ("text", pa.string())]))
    return run


def _edge_finder(pattern: str, chunk: int):
    """Safe boundaries before a chunk's overlap with its predecessor ends, and in that with its successor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for number, count, text in zip(*(batch.column(n).to_pylist() for n in ("number", "chunks", "text"))):
                ends = boundaries(text, pattern, number + 1 == count)
                heads.append([b for b in ends if b < len(text) - chunk or b < OVERLAP_CHARS])
                tails.append([b - chunk for b in ends if b >= chunk])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("number"), batch.column("chunks"),
                 pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=["doc", "number", "chunks", "heads", "tails"])
    return run


def _encode_long(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, ids) of documents of more than one chunk."""
    spark = docs.sparkSession
    docs = stored(docs.withColumn("doc", F.monotonically_increasing_id()), "bpe-long")
    chunks = (docs.select("doc", "text").mapInArrow(_chunker(chunk, overlap), "doc long, number int, chunks int, text string")
              .repartition(partitions(spark), "doc", "number"))
    edges = chunks.mapInArrow(_edge_finder(pattern, chunk), "doc long, number int, chunks int, heads array<int>, tails array<int>")
    one = Window.partitionBy("doc").orderBy("number")
    # Chunk n's piece runs from its own cut to the next chunk's, both counted from its start.
    cuts = edges.withColumn("cut", F.array_min(F.array_intersect(F.lag("tails").over(one), "heads")))
    cuts = cuts.select(
        "doc", "number", "chunks", F.when(F.col("number") == 0, 0).otherwise(F.col("cut")).alias("lo"),
        F.lead("cut").over(one).alias("next"))
    cuts = cuts.withColumn("open", (F.col("number") > 0) & F.col("lo").isNull())
    cuts = stored(cuts.withColumn("broken", F.max("open").over(Window.partitionBy("doc"))), "bpe-cuts")
    piece = F.expr(f"substring(text, lo + 1, if(number + 1 = chunks, length(text), next + {chunk}) - lo)")
    pieces = (chunks.join(cuts.filter(~F.col("broken")).drop("chunks", "open", "broken"), ["doc", "number"])
              .select("doc", "number", piece.alias("text")))
    # No shared boundary, as within one huge word: the text is encoded as one piece.
    whole = docs.join(cuts.filter("broken").select("doc").distinct(), "doc", "left_semi").select("doc", F.lit(0).alias("number"), "text")
    ids = pieces.unionByName(whole).mapInArrow(_encoder(ranks_path, pattern, ["doc", "number"]), "doc long, number int, ids array<int>")
    joined = ids.groupBy("doc").agg(F.expr("flatten(transform(array_sort(collect_list(struct(number, ids))), p -> p.ids))").alias("ids"))
    return docs.select("doc", "id").join(joined, "doc").select("id", "ids")


def encode(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id_col, ids) of every row: the whole text's token ids, without special tokens.

    Null and empty texts have no ids; repeated rows and null ids are encoded
    row by row; an empty table gives an empty table; other columns are ignored.
    Memory: one text and its ids at a time, plus one Arrow batch.
    """
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    short = docs.filter(F.length("text") <= chunk).mapInArrow(_encoder(ranks_path, pattern, ["id"]), f"id {kind}, ids array<int>")
    long = _encode_long(docs.filter(F.length("text") > chunk), ranks_path, pattern, chunk, overlap)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded``, the concatenated bytes of the column ``ids``."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column("ids"), pa.array([enc.decode_bytes(x) for x in part.column("ids").to_pylist()], pa.binary())],
                    names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
