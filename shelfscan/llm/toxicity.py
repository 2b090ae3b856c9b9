"""Toxicity by compression distance with two trained zstandard dictionaries.

A window of text is compressed twice: with a dictionary trained on ordinary
text, and with one trained on toxic text in front of it.  What the toxic
dictionary saves is the window's distance towards toxic text: ordinary
windows find all they can in the ordinary part, and save nothing.

The toxic dictionary starts from all windows of toxic documents, most of which
are ordinary.  Each round keeps the windows that save more than nearly all
ordinary windows do, narrows each to the word that its saving hangs on, and
trains the next dictionary on those words.  Another fold of labelled documents
calibrates the documents' largest savings to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stored, text_or_empty

#: Labelled documents of each class and fold that a model is fitted on, at most.
SAMPLE = 2_500
#: Bytes of windows of each class that come to the driver, about: beyond, an even share of all of them.
DRIVER_BYTES = 32_000_000
#: Longer windows (of a very long word) train in pieces of so many bytes.
PIECE = 1_024
#: Bytes of a window; it ends with the word that reaches them.
WINDOW = 80
LEVEL = 9
#: Ordinary windows for the ordinary dictionary, and for the noise of savings.
BASE_WINDOWS, NOISE_WINDOWS = 60_000, 40_000
BASE_BYTES = 65_536
#: Bytes of the pieces that the toxic dictionary is put together from.
SEGMENT = 24
#: Sizes of the toxic dictionary, round by round.
ROUNDS = (16_384, 8_192, 4_096, 2_048, 2_048)
#: Share of ordinary windows that save less than a window must to count as toxic in training.
QUANTILE = 0.998
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7


def windows(text: str) -> list[bytes]:
    """Consecutive runs of lower-case words of about ``WINDOW`` bytes that cover the whole text."""
    out, held, size = [], [], 0
    for word in text.lower().encode().split():
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(held) + b" ")
            held, size = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=2 * WINDOW, write_content_size=0, write_dict_id=0, write_checksum=0)
    return zstandard.ZstdCompressor(compression_params=options, dict_data=made)


def _lengths(compressor: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    compress = compressor.compress
    return np.array([len(compress(p)) for p in parts], np.int64)


def _trained(samples: list[bytes], size: int, segment: int, run: int) -> bytes:
    """A trained dictionary's content; of too few samples for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=run).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    """Dictionaries and calibration; ``weights`` are of 1 and of the features."""
    base: bytes
    toxic: bytes
    weights: np.ndarray

    def savings(self) -> Savings:
        return Savings(self)


class Savings:
    """Document features by a model: what its best windows save."""

    def __init__(self, model: Model) -> None:
        self.weights = model.weights
        self.ordinary = _compressor(model.base) if model.base else None
        self.both = _compressor(model.toxic + model.base) if model.toxic else None

    def features(self, text: str) -> np.ndarray:
        """The three largest savings of the text's windows, and the share of windows that save."""
        parts = windows(text)
        if not parts or self.both is None:
            return np.zeros(FEATURES)
        saved = np.maximum(_lengths(self.ordinary, parts) - _lengths(self.both, parts), 0)
        top = np.zeros(3)
        best = np.sort(saved)[::-1][:3]
        top[:len(best)] = best
        return np.array([*np.sqrt(top), np.count_nonzero(saved >= 2) / len(parts) * 10, np.log1p(len(parts)) / 5])

    def score(self, text: str) -> float:
        z = self.weights[0] + self.features(text) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


FEATURES = 5


def _narrowed(parts: list[bytes], ordinary, both) -> list[bytes]:
    """Of each window, the word without which it saves least."""
    out = []
    for part in parts:
        words = part.split()
        if len(words) > 1:
            rest = [b" " + b" ".join(words[:i] + words[i + 1:]) + b" " for i in range(len(words))]
            out.append(b" " + words[int(np.argmin(_lengths(ordinary, rest) - _lengths(both, rest)))] + b" ")
        else:
            out.append(part)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of 1 and of the columns of x by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary from windows of documents of either class."""
    rng = np.random.default_rng(5)
    ordinary_parts = [ordinary[i] for i in rng.permutation(len(ordinary))]
    middle = len(ordinary_parts) // 2
    base = _trained(ordinary_parts[:middle][:BASE_WINDOWS] or ordinary_parts, BASE_BYTES, 64, 8)
    noise = ordinary_parts[middle:][:NOISE_WINDOWS]
    plain_compressor = _compressor(base)
    plain, plain_noise = _lengths(plain_compressor, toxic), _lengths(plain_compressor, noise)
    content = _trained(toxic, ROUNDS[0], SEGMENT, 6)
    for size in ROUNDS[1:]:
        both = _compressor(content + base)
        noisy = plain_noise - _lengths(both, noise)
        least = np.quantile(noisy, QUANTILE)
        chosen = [p for p, s in zip(toxic, plain - _lengths(both, toxic)) if s > least]
        usual = set(_narrowed([p for p, s in zip(noise, noisy) if s > least], plain_compressor, both))
        words = [w for w in _narrowed(chosen, plain_compressor, both) if w not in usual]
        if len(words) < 8:
            break
        words = [words[i] for i in rng.permutation(len(words))]
        content = _trained([b"".join(words[i:i + 4]) for i in range(0, len(words), 4)], size, SEGMENT, 6)
    return base, content


def calibrated(features: list[list[float]], toxic: list[int], shares: tuple[float, float]) -> np.ndarray | None:
    """Weights of 1 and of the features; None without documents of both classes."""
    y = np.array(toxic, np.int64)
    counts = np.bincount(y, minlength=2)
    if not counts.all():
        return None
    weight = np.where(y == 1, shares[1] / counts[1], shares[0] / counts[0]) * len(y)
    return _logistic(np.array(features), y, weight)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, toxic, at, part): the windows of each document in order."""
    for batch in batches:
        for k, text in enumerate(batch.column("text")):
            parts = [w[i:i + PIECE] for w in windows(text.as_py()) for i in range(0, len(w), PIECE)]
            row = pa.array([k] * len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), batch.column("toxic").take(row), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["id", "toxic", "at", "part"])


def sample_windows(texts: DataFrame, most: int = DRIVER_BYTES) -> tuple[list[bytes], list[bytes]]:
    """Windows of ordinary and of toxic documents (id, toxic, text) by id, from the whole texts.

    Where a class has more than ``most`` bytes, those whose hashes of id and
    place are among that share.
    """
    kind = texts.schema["id"].dataType.simpleString()
    cut = stored(texts.select("id", "toxic", "text").mapInArrow(_cut, f"id {kind}, toxic int, at long, part binary"), "toxicity-windows")
    sizes = {r["toxic"]: r["n"] for r in cut.groupBy("toxic").agg(F.sum(F.length("part")).alias("n")).collect()}
    out = []
    for toxic in (0, 1):
        of = cut.filter(F.col("toxic") == toxic)
        if sizes.get(toxic, 0) > most:
            of = of.filter(F.pmod(F.xxhash64("id", "at"), F.lit(1_000_000)) < 1_000_000 * most // sizes[toxic])
        out.append(of.select("id", "at", "part").toArrow().sort_by([("id", "ascending"), ("at", "ascending")]).column("part").to_pylist())
    return out[0], out[1]


def remainder(id_col: str):
    """crc32 of the id's text modulo 3: the fold that a row is in."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled documents whose remainder is not 1.

    Of each class, at most ``sample`` documents of remainder 0 train the
    dictionaries and as many of remainder 2 the calibration: those whose ids
    have the smallest hashes, and of a repeated id the text with the smallest.
    To the driver come about ``DRIVER_BYTES`` of windows of each class, and
    ``FEATURES`` numbers for each document of the calibration.  Without texts
    of both classes every score is the share of toxic documents.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
             .groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder("id")).filter("fold <> 1"))
    texts = documents.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for toxic in (0, 1):
        for fold in (0, 2):
            part = known.filter((F.col("toxic") == toxic) & (F.col("fold") == fold)).orderBy(F.xxhash64("id"), "id").limit(sample)
            chosen = part if chosen is None else chosen.union(part)
    # At most 4 * sample ids, so that the texts need not move; of each id one text is kept.
    once = F.min(F.struct(F.xxhash64("text").alias("print"), "text"))["text"].alias("text")
    rows = stored(texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "fold").agg(once), "toxicity-sample")
    total = max(sum(counts.values()), 1)
    shares = counts.get(0, 0) / total, counts.get(1, 0) / total
    prior = np.clip(shares[1], 1e-6, 1 - 1e-6)
    nothing = np.concatenate([[np.log(prior / (1 - prior))], np.zeros(FEATURES)])
    ordinary, foul = sample_windows(rows.filter("fold = 0"))
    if not ordinary or not foul:
        return Model(b"", b"", nothing)
    base, content = dictionaries(ordinary, foul)
    model = Model(base, content, nothing)
    kept = documents.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = kept.value.savings()
        for batch in batches:
            found = [savings.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["id", "toxic", "features"])

    own = rows.filter("fold = 2").select("id", "toxic", "text").mapInArrow(run, f"id {kind}, toxic int, features array<double>").toArrow().sort_by("id")
    weights = calibrated(own.column("features").to_pylist(), own.column("toxic").to_pylist(), shares)
    return model if weights is None else Model(base, content, weights)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row from its whole text; null texts are empty and have the score of no windows."""
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    kept = documents.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = kept.value.savings()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([savings.score(t.as_py()) for t in batch.column("text")], pa.float64())], names=[id_col, "score"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, score double")


def reject_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is under ``THRESHOLD``, with all their columns."""
    kept = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = kept.value.savings()
        for batch in batches:
            keep = [savings.score(t.as_py() or "") < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Labels of rows with remainder 1 are never used, and labels, language,
    source and id are no input of a score.  Labels that are null or neither 0
    nor 1 are ignored, a document labelled both ways counts as toxic, repeated
    rows are scored each, and empty tables give an empty table.
    """
    scored = score(documents, fit(documents, labels, id_col), id_col)
    return scored.select(id_col, (remainder(id_col) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
