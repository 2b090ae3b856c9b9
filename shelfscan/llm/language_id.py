"""Language identification by cross-parsing entropy.

Each language has a bounded sample of labelled text and the suffix automaton of
it.  A text is parsed against a language from left to right into phrases, each
the longest match that the sample holds at that place; the fewer phrases, times
the bits that name a place in the sample, the closer the text.  The language
that needs the fewest bits wins.

Parsing needs transitions only: from the automaton's first state, a match grows
while there is a transition and ends where there is none.  Texts are cut into
windows that are parsed side by side with arrays, a character at a time.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import small_batches, stored, text_or_empty

#: The sample: so many excerpts of distinct texts of each language, of so many characters each;
#: with many languages fewer excerpts each, so that all samples have at most ``SAMPLE_CHARACTERS``.
EXCERPTS, EXCERPT_CHARACTERS, SAMPLE_CHARACTERS = 48, 600, 1 << 18
#: Characters that are parsed together; a phrase ends at the end of its window.
WINDOW = 512
#: Characters of text whose windows are held at once.
HELD = 1 << 20
#: Letters with a class of their own; rarer ones share the classes that are left.
OWN_LETTERS, CLASSES = 96, 128
#: Share of the bits that count as independent evidence for the score.
EVIDENCE = 0.25


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


# --- suffix automata -------------------------------------------------------------

def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads all substrings; state 0 is the first."""
    follow: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
        last = new
    return follow


# --- symbols -----------------------------------------------------------------------

@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and its lower case (one code point)."""
    points = range(0x110000)
    letter = np.array([unicodedata.category(chr(p))[0] == "L" for p in points])
    lower = np.arange(0x110000, dtype=np.int32)
    for p in np.flatnonzero(letter):
        small = chr(p).lower()
        lower[p] = ord(small) if len(small) == 1 else p
    return letter, lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Reader:
    """Turns text into symbols: 0 between letters (runs of it are one), and classes of letters."""

    def __init__(self, samples: list[str]):
        letter, lower = _letters()
        seen = Counter(int(lower[p]) for text in samples for p in _points(text) if letter[p])
        own = sorted(seen, key=lambda p: (-seen[p], p))[:OWN_LETTERS]
        self.first_shared = len(own) + 1
        table = (self.first_shared + (lower >> 6) % (CLASSES - self.first_shared)).astype(np.uint8)
        for i, p in enumerate(own):
            table[lower == p] = i + 1
        table[~letter] = 0
        self.table = table

    def symbols(self, points: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of concatenated texts without needless separators, and the texts' new ends."""
        s = self.table[points]
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        starts = np.concatenate([[0], text_ends[:-1]])
        starts = starts[starts < len(s)]
        keep[starts] = s[starts] > 0
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[text_ends]


class Model:
    """Languages with their samples; automata are made where they are needed, once for each process."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.samples = {k: sorted(samples[k]) for k in self.languages}
        self.reader = self.tables = self.bits = None

    def __getstate__(self):
        return {"languages": self.languages, "samples": self.samples, "reader": None, "tables": None, "bits": None}

    def prepare(self) -> "Model":
        if self.reader is None:
            self.reader = Reader([t for k in self.languages for t in self.samples[k]])
            self.tables, self.bits = [], []
            for k in self.languages:
                points = [_points(t) for t in self.samples[k]]
                joined, _ = self.reader.symbols(np.concatenate([np.append(p, 32) for p in points]), np.array([sum(len(p) + 1 for p in points)]))
                follow = suffix_automaton(joined.tolist())
                table = np.zeros((len(follow), CLASSES), np.int32)
                for state, out in enumerate(follow):
                    table[state, list(out)] = list(out.values())
                self.tables.append(table.ravel())
                self.bits.append(np.log2(max(len(joined), 2)))
        return self

    def phrases(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts x languages) numbers of phrases of concatenated texts' symbols."""
        sizes = np.diff(np.concatenate([[0], ends]))
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), windows)
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        if not len(owner):
            return out
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = (ends - sizes)[owner] + number * WINDOW
        length = np.minimum(sizes[owner] - number * WINDOW, WINDOW)
        order = np.argsort(-length, kind="stable")  # those that still go on come first
        begin, length, owner = begin[order], length[order], owner[order]
        going = np.searchsorted(-length, -np.arange(WINDOW), "left")  # windows longer than each place
        for l, table in enumerate(self.tables):
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for t in range(int(length[0])):
                n = going[t]
                c = symbols[begin[:n] + t]
                to = table[state[:n].astype(np.int64) * CLASSES + c]
                stop = np.flatnonzero(to == 0)  # the match ends here; no transition leads to the first state
                if len(stop):
                    again = table[c[stop]]
                    # a phrase is done if one was open, and a symbol that no sample has is one by itself
                    count[stop] += (state[stop] > 0).astype(np.int32) + (again == 0)
                    to[stop] = again
                state[:n] = to
            count += state > 0
            out[:, l] = np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64)
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and mean phrase length of every text."""
        self.prepare()
        points = [_points(t) for t in texts]
        symbols, ends = self.reader.symbols(np.concatenate(points) if points else np.zeros(0, np.uint32), np.cumsum([len(p) for p in points]).astype(np.int64))
        sizes = np.diff(np.concatenate([[0], ends]))
        count = self.phrases(symbols, ends)
        bits = count * np.array(self.bits)
        best = np.argmin(bits, axis=1)  # of equal ones the first by name
        share = np.exp2(-EVIDENCE * (bits - bits.min(axis=1, keepdims=True)))
        score = 1.0 / share.sum(axis=1)
        found = sizes > 0
        mean = np.where(found, sizes / np.maximum(count[np.arange(len(texts)), best], 1), 0.0)
        return [self.languages[b] if f else "und" for b, f in zip(best, found)], np.where(found, score, 0.0), mean


# --- Spark ----------------------------------------------------------------------------

def fit(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Samples of the languages of the rows that ``learn`` names.

    A language's excerpts come from the distinct texts whose hashes, modulo
    2^40, are smallest, each from a place that its hash gives; copies of a text
    count once.  At most
    ``SAMPLE_CHARACTERS`` characters come to the driver.
    """
    text = F.col(text_col).cast("string")
    known = documents.filter(learn & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.alias("text"))
    hashes = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"))
    sizes = stored(hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")), "language-sizes")  # a row for each language
    excerpts = max(1, min(EXCERPTS, SAMPLE_CHARACTERS // (EXCERPT_CHARACTERS * max(1, sizes.count()))))
    # hashes are evenly spread: a few times as many as are wanted lie under this share of their range
    low = F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < F.lit(8.0 * excerpts) / F.col("texts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "h"))
    few = hashes.join(F.broadcast(sizes), "lang").filter(low).withColumn("order", F.pmod("h", F.lit(1 << 40)))
    chosen = stored(few.withColumn("place", place).filter(F.col("place") <= excerpts).select("lang", "h"), "language-sample")
    room = F.greatest(F.length("text") - EXCERPT_CHARACTERS + 1, F.lit(1))
    cut = known.join(F.broadcast(chosen), ["lang", "h"]).select(
        "lang", "h", F.substring("text", (F.pmod(F.xxhash64("h"), room) + 1).cast("int"), F.lit(EXCERPT_CHARACTERS)).alias("excerpt"))
    samples: dict[str, list[str]] = {}
    for row in cut.groupBy("lang", "h").agg(F.min("excerpt").alias("excerpt")).collect():
        samples.setdefault(row["lang"], []).append(row["excerpt"])
    return Model(samples)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, phrase_length) of every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if there was nothing to learn from.  Equal languages: the first by
    name.  Repeated ids and null ids keep their rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not model.languages:
                langs, score, mean = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(score), pa.array(mean)], names=names)
                continue
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= HELD):
                    held += len(texts[to])
                    to += 1
                langs, score, mean = model.judge(texts[at:to])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(langs, pa.string()), pa.array(score), pa.array(mean)], names=names)
                at = to

    names = ["id", "lang_pred", "score", "phrase_length"]
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, lang_pred string, score double, phrase_length double").withColumnRenamed("id", id_col)


def language_id(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learns from the rows whose remainder is not 0 and judges all; a null id has no remainder and is not learned from."""
    model = fit(documents, remainder(id_col) != 0, id_col)
    return identify(documents, model, id_col).withColumn("held_out", F.coalesce(remainder(id_col) == 0, F.lit(False)))
