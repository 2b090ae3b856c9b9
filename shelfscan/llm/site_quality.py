"""Document quality with site priors, by hierarchical empirical Bayes.

A document's own evidence is the likelihood ratio of good against bad for a few
features of its whole text, cut into bins and counted over labelled documents.
Sites add what they know: the expected number of good documents of a host is
summed over all its documents, labelled or not, and shrunk towards the global
share; a path's is shrunk towards its host's.  How strongly sparse sites shrink
is estimated from how much sites differ.  A document's posterior combines its
path's share, as the prior, with its own evidence; what the document itself
added to the shares is taken off first, so that its evidence counts once.

Texts become bins within tasks; all that is learnt is grouped aggregation, and
a hot host is added up within tasks before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import stored, text_or_empty
from .words import SPACES, slices, word_hashes

#: Bins of a feature; shares are cut at powers of two.
BINS = 12
#: Pseudo-count of every bin and class.
SMOOTHING = 1.0
#: Bounds of the strength (in documents) with which sites shrink towards the level above.
STRENGTH = (1.0, 1_000.0)
#: Posterior under which a document is rejected.
THRESHOLD = 0.5
#: Weight of the summed evidence: features of one text are not independent.
TEMPER = 0.7


#: Bytes by what they are: 0 other (white space, brackets, dashes, quotes), 1 small letters and
#: bytes of other scripts, 2 capitals, 3 digits, 4 marks, 5 full stops and commas.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ";:'\"?()-"]] = 4
_CLASS[[ord("."), ord(",")]] = 5
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = 3
_CLASS[[b for b in range(128) if chr(b).isupper()]] = 2
_CLASS[[b for b in range(256) if b > 127 or chr(b).islower()]] = 1
_LINE_ENDS = np.zeros(256, bool)
_LINE_ENDS[10] = True
FEATURES = ("letters", "capitals", "digits", "marks", "stops", "words", "distinct_words", "distinct_lines", "length")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of shares: 0 for none, else by the binary logarithm, up to all."""
    with np.errstate(divide="ignore"):
        at = np.floor(np.log2(part / np.maximum(whole, 1)) * 1.5 + BINS - 1)
    return np.where(part <= 0, 0, np.clip(at, 1, BINS - 1)).astype(np.int32)


def _distinct(data: bytes, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts between separators and of different ones, in each text."""
    h, first = word_hashes(data, offsets, separators)
    return np.diff(first), np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])], np.int64)


def binned(column: pa.Array) -> np.ndarray:
    """(texts, features): bins of what each whole text is made of and how much of it repeats."""
    out = [np.zeros((0, len(FEATURES)), np.int32)]
    for at, to, data, offsets in slices(column):
        rows, sizes = to - at, np.diff(offsets)
        kinds = np.bincount(np.repeat(np.arange(rows) * 6, sizes) + _CLASS[np.frombuffer(data, np.uint8)], minlength=6 * rows).reshape(rows, 6)
        words, different = _distinct(data, offsets, SPACES)
        lines, different_lines = _distinct(data, offsets, _LINE_ENDS)
        letters = kinds[:, 1] + kinds[:, 2]
        out.append(np.stack([
            _share(letters, sizes), _share(kinds[:, 2], letters), _share(kinds[:, 3], sizes), _share(kinds[:, 4], sizes), _share(kinds[:, 5], sizes),
            _share(words * 8, sizes), _share(different, words), _share(different_lines, lines),
            np.minimum(np.log2(sizes + 1) * 0.75, BINS - 1).astype(np.int32)], 1))
    return np.concatenate(out)


def with_bins(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with the column __bins, in the order of ``FEATURES``."""
    schema = T.StructType([*documents.schema.fields, T.StructField("__bins", T.ArrayType(T.IntegerType()))])
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(batch.column(at).cast(pa.string()))
            offsets = np.arange(0, bins.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(bins.ravel()))], names=[*batch.schema.names, "__bins"])

    return documents.mapInArrow(run, schema)


def _evidence(featured: DataFrame, labels: DataFrame) -> tuple[dict[tuple[int, int], float], float]:
    """Log likelihood ratio of each (feature, bin) with labels, and the smoothed share of good documents."""
    counts = (featured.join(labels, "doc").select("good", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin")
              .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect())  # features * BINS rows at most
    good, bad = (float(sum(r[c] for r in counts if r["feature"] == 0)) for c in ("good", "bad"))
    room = SMOOTHING * BINS
    table = {(r["feature"], r["bin"]): math.log((r["good"] + SMOOTHING) / (good + room)) - math.log((r["bad"] + SMOOTHING) / (bad + room)) for r in counts}
    return table, (good + 1) / (good + bad + 2)


def _shrunk(good: Column, n: Column, towards: Column, strength: Column) -> Column:
    return (good + strength * towards) / (n + strength)


def _strength(sites: DataFrame, good: str, n: str, towards: Column) -> float:
    """Prior strength of a level by moments: sites' spread about the level above, less what chance explains.

    With a spread v of true shares about m, a beta prior has the strength
    m (1 - m) / v - 1; large sites say most about v.
    """
    p = F.col(good) / F.col(n)
    noise = towards * (1 - towards) / F.col(n)
    row = sites.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * ((p - towards) ** 2 - noise)).alias("spread"), F.sum(F.col(n) * towards * (1 - towards)).alias("base"), F.sum(n).alias("n")).first()
    if not row["n"] or not row["spread"] or row["spread"] <= 0:
        return STRENGTH[1]
    return float(min(max(row["base"] / row["spread"] - 1, STRENGTH[0]), STRENGTH[1]))


@dataclass
class Model:
    """What the documents' own features say, and the sums of good documents by host and path.

    ``share`` is that of good documents among the labelled ones, ``overall``
    the expected one among all.
    """
    ratios: dict[tuple[int, int], float]
    share: float
    sites: DataFrame
    overall: float = 0.5
    host_strength: float = 0.0
    path_strength: float = 0.0

    def evidence(self, bins: Column) -> Column:
        """Log likelihood ratio of good against bad; a bin without labelled documents says nothing."""
        rows = F.array(*(F.array(*(F.lit(self.ratios.get((f, b), 0.0)) for b in range(BINS))) for f in range(len(FEATURES))))
        parts = F.transform(bins, lambda b, i: F.coalesce(F.get(F.get(rows, i), b), F.lit(0.0)))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) * TEMPER

    def expected(self, evidence: Column) -> Column:
        """What a document adds to the good ones of its sites: its probability without them."""
        return 1 / (1 + F.exp(-evidence) * ((1 - self.share) / self.share))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang",
        label_col: str = "quality", learn: Column | None = None) -> Model:
    """A model from all documents and their labels.

    ``learn`` selects the rows of ``labels`` to use.  Null labels and those
    other than 0 and 1 are ignored; a document labelled both ways is bad.
    """
    known = (labels if learn is None else labels.filter(learn)).select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("good"))
    known = known.filter("doc is not null and good in (0, 1)").groupBy("doc").agg(F.min("good").alias("good"))
    named = documents.select(F.col(id_col).alias("doc"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), text_or_empty().alias("text"))
    featured = stored(with_bins(named).select("doc", "host", "path", F.col("__bins").alias("bins")), "quality-features")
    ratios, share = _evidence(featured, known)
    model = Model(ratios, share, featured)
    own = model.expected(model.evidence(F.col("bins")))
    paths = stored(featured.groupBy("host", "path").agg(F.sum(own).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    model.overall = ((total["good"] or 0.0) + share) / ((total["n"] or 0) + 1)
    model.host_strength = _strength(hosts, "host_good", "host_n", F.lit(model.overall))
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    host_share = _shrunk(F.col("host_good"), F.col("host_n"), F.lit(model.overall), F.lit(model.host_strength))
    model.path_strength = _strength(sites.withColumn("host_share", host_share), "good", "n", F.col("host_share"))
    model.sites = stored(sites.select("host", "path", "good", "n", "host_good", "host_n"), "quality-sites")
    return model


def judge(documents: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The ``documents`` that the model was fitted on, with the columns __evidence, __host_share, __path_share, __posterior and __keep.

    The shares are those of the other documents of a document's host and path.
    The sites are joined as a table; only where they turn out small does Spark
    broadcast them.
    """
    sites = model.sites.toDF("__host", "__path", "__good", "__n", "__host_good", "__host_n")
    rows = with_bins(documents).withColumn("__evidence", model.evidence(F.col("__bins"))).drop("__bins")
    same = rows[host_col].cast("string").eqNullSafe(sites["__host"]) & rows[path_col].cast("string").eqNullSafe(sites["__path"])
    own = model.expected(F.col("__evidence"))
    placed = (rows.join(sites, same, "left")
              .withColumn("__host_share", _shrunk(F.col("__host_good") - own, F.col("__host_n") - 1, F.lit(model.overall), F.lit(model.host_strength)))
              .withColumn("__path_share", _shrunk(F.col("__good") - own, F.col("__n") - 1, F.col("__host_share"), F.lit(model.path_strength)))
              .drop("__host", "__path", "__good", "__n", "__host_good", "__host_n"))
    odds = F.col("__path_share") / (1 - F.col("__path_share"))
    placed = placed.withColumn("__posterior", 1 / (1 + F.exp(-F.col("__evidence")) / odds))
    return placed.withColumn("__keep", F.coalesce(F.col("__posterior") >= THRESHOLD, F.lit(True)))


def site_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang",
                 label_col: str = "quality", learn: Column | None = None) -> DataFrame:
    """(id, host, path, evidence, host_share, path_share, posterior, keep) of every document row.

    Null hosts and paths are sites of their own, null texts are empty, repeated
    rows count and are judged each, and an empty table gives an empty table.
    Without labels there is no evidence and every posterior is a half.  A
    document whose posterior is under ``THRESHOLD`` is not to keep.
    """
    judged = judge(documents, fit(documents, labels, id_col, host_col, path_col, label_col, learn), host_col, path_col)
    return judged.select(id_col, host_col, path_col, *(F.col(f"__{c}").alias(c) for c in ("evidence", "host_share", "path_share", "posterior", "keep")))


def reject_bad(documents: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows to keep, with all their columns."""
    return judge(documents, model, host_col, path_col).filter("__keep").select(*documents.columns)
