"""Toxicity from two Kneser-Ney models of how words are spelt, one of toxic text and one of ordinary text.

Words are spelt letter by letter between marks of begin and end. The longest
order of letter sequences is counted for each class by itself, with absolute
discounting; what it lacks comes from orders below it, whose Kneser-Ney counts
(in how many different surroundings a sequence was seen) both classes share. So a
rare expression says nothing unless its class has counts of its own: where neither
class knows a context the two likelihoods are equal.

A toxic text is ordinary in most of its words. Its likelihood of a word is a
mixture, ``SHARE`` of the toxic model and the rest of the ordinary one. The
difference of the two log-likelihoods, summed over a text's words and divided by
their number (``PRIOR_WORDS`` more, so a few words decide less), is the only
feature, on a logarithmic scale; a logistic curve fitted on labelled texts that are in neither model
turns it into a score.

The model is fitted on a bounded sample of labelled rows, ``MAX_PER_CLASS`` of
each label and texts of at most ``MAX_CHARS`` characters, taken in hash order,
each text once; Spark counts its words, the driver gets the word counts of the
sample and makes two tables of them. Every row is scored, on its whole text.

Nulls: a null text is empty, and scores like text without known expressions; a
null label or id is no label; of several labels for an id the larger counts.
With only one class labelled, the score is that class's share. An empty table
gives an empty result; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ByteHash, Scratch, map_arrow, mix64, text_batches
from .quality import calibrate

#: The bounds of the labelled sample.
MAX_PER_CLASS, MAX_CHARS = 4000, 16384
#: Letters in a sequence, its last one predicted; discount of counts.
ORDER, DISCOUNT = 6, 0.95
#: Share of the toxic model in a toxic text's words; words that a text counts as longer.
SHARE, PRIOR_WORDS = 0.02, 5
#: Of five labelled texts one calibrates, the others are counted.
CALIBRATE_EVERY = 5
#: Added to differences before their logarithm is taken.
LEAST = 0.01
LETTERS = 1000  # the lowest order spreads what it discounts over so many letters
BEGIN, END, BLANK = 2, 3, 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _lower() -> np.ndarray:
    """Each code point of the basic plane as a lower-case letter, BLANK where it is none."""
    letters = (x if (x := chr(i)).isalpha() else " " for i in range(1 << 16))
    return np.fromiter((ord(y) if len(y := x.lower()) == 1 else ord(x) for x in letters), np.uint32, 1 << 16)


def spelling(texts: list[str]) -> np.ndarray:
    """The letters of all texts, lower-cased, BLANK for all else and at both ends."""
    codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1 << 16, _lower()[np.minimum(codes, 0xFFFF)], BLANK)


def words_of(text: str) -> list[str]:
    return spelling([text]).astype("<u4").tobytes().decode("utf-32-le").split()


def _bounds(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    edge = np.flatnonzero(np.diff(letters != BLANK)) + 1
    return edge[::2], edge[1::2]


def _spelt(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between ``start`` and ``end`` with marks around them, the places that a sequence ends at, and each place's word."""
    size = end - start + 1
    which = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(np.cumsum(size + ORDER - 1) - size, size) + inside
    data = np.full(int(size.sum()) + len(size) * (ORDER - 1), BEGIN, np.uint64)
    data[places] = letters[np.repeat(start, size) + inside]
    data[places[np.cumsum(size) - 1]] = END
    return data, places, which


def _hash(data: np.ndarray, places: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """Hashes of the ``order`` letters that end at each place, without the last ``skip`` of them."""
    out = np.zeros(len(places), np.uint64)
    for k in range(order - 1, skip - 1, -1):
        out *= _STEP
        out += data[places - k]
    return mix64(out + np.uint64(order - skip))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    # sequences repeat: each is looked up once, in order
    each, back = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, each), len(keys) - 1)
    return at[back], (keys[at] == each)[back]


class WordHash(ByteHash):
    """Hashes of ranges of letters."""

    def __init__(self, letters: np.ndarray):
        powers, self.inverse = self._tables(len(letters) + 1)
        self.prefix = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(mix64(letters.astype(np.uint64) + np.uint64(1)) * powers[: len(letters)], out=self.prefix[1:])


@dataclass
class Sequences:
    """Counts of the distinct sequences of one order: ``places`` holds one place of each."""

    places: np.ndarray
    keys: np.ndarray
    counts: np.ndarray  # (class, sequence)
    contexts: np.ndarray
    totals: np.ndarray  # (class, context): sum of counts
    kinds: np.ndarray  # (class, context): sequences that have counts

    @classmethod
    def of(cls, data: np.ndarray, places: np.ndarray, weight: np.ndarray, order: int) -> Sequences:
        keys, first, back = np.unique(_hash(data, places, order), return_index=True, return_inverse=True)
        counts = np.stack([np.bincount(back, row, len(keys)) for row in weight])
        contexts, of = np.unique(_hash(data, places[first], order, 1), return_inverse=True)
        sums = [np.stack([np.bincount(of, row, len(contexts)) for row in x]) for x in (counts, (counts > 0).astype(float))]
        return cls(places[first], keys, counts, contexts, *sums)

    def given(self, data: np.ndarray, places: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
        """(class, place) probability of each place's letter, with ``lower`` where counts are discounted or missing."""
        at, known = _find(self.keys, _hash(data, places, order))
        near, seen = _find(self.contexts, _hash(data, places, order, 1))
        counts, total, kinds = self.counts[:, at] * known, self.totals[:, near] * seen, self.kinds[:, near] * seen
        own = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1)
        return np.where(total > 0, own, lower)


@dataclass
class Model:
    """Log of toxic over ordinary likelihood: of sequences that either class has seen, and of other letters after contexts that either has seen."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    elsewhere: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    slope: float = 0.0
    intercept: float = 0.0
    def words(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in a toxic text less that in an ordinary one."""
        data, places, which = _spelt(letters, start, end)
        near, seen = _find(self.contexts, _hash(data, places, ORDER, 1))
        at, known = _find(self.keys, _hash(data, places, ORDER)[seen])
        ratio = self.elsewhere[near[seen]]
        ratio[known] = self.ratios[at[known]]
        total = np.bincount(which[seen], ratio, len(start))
        return np.log1p(SHARE * np.expm1(np.minimum(total, 60)))

    def features(self, texts: list[str]) -> np.ndarray:
        """Logarithm of the difference of log-likelihoods a word, counted from the least there can be, of whole texts."""
        letters = spelling(texts)
        start, end = _bounds(letters)
        total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if len(start):
            _, first, back = np.unique(WordHash(letters).slices(start, end), return_index=True, return_inverse=True)
            of = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), start)
            total = np.bincount(of, self.words(letters, start[first], end[first])[back], len(texts))
            size = np.bincount(of, minlength=len(texts))
        return np.log(total / (size + PRIOR_WORDS) - np.log1p(-SHARE) + LEAST)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.features(texts) + self.intercept, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _tables(words: list[str], counts: np.ndarray) -> Model:
    """Tables of the counted words: the longest order by class, all orders below by both."""
    letters = spelling(words)
    data, places, which = _spelt(letters, *_bounds(letters))
    top = Sequences.of(data, places, counts[:, which], ORDER)
    shared, below = {}, top
    for order in range(ORDER - 1, 0, -1):  # each different longer sequence counts one
        shared[order] = below = Sequences.of(data, below.places, np.ones((1, len(below.places))), order)
    lower = np.full((1, len(top.places)), 1 / LETTERS)
    for order in range(1, ORDER):
        lower = shared[order].given(data, top.places, order, lower)
    own = top.given(data, top.places, ORDER, lower)
    left = np.where(top.totals > 0, DISCOUNT * top.kinds / np.maximum(top.totals, 1), 1)
    ratio = lambda x: (np.log(x[1]) - np.log(x[0])).astype(np.float32)
    return Model(top.keys, ratio(own), top.contexts, ratio(left))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from the labelled rows that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = [counted.get(0, 0), counted.get(1, 0)]
    prior = float(np.log((total[1] + 1) / (total[0] + 1)))
    if not all(total):
        return Model(intercept=prior)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # twice the bound: some may be too long or missing in docs; bounded, so it may be broadcast
    chosen = known.where("y = 1").orderBy(*order).limit(2 * max_per_class).unionByName(known.where("y = 0").orderBy(*order).limit(2 * max_per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.char_length("text") > 0) & (F.char_length("text") <= max_chars))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    found = scratch.table(found.where("y = 1").orderBy(*order).limit(max_per_class).unionByName(found.where("y = 0").orderBy(*order).limit(max_per_class)), "sample")
    checks = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE_EVERY)) == 0

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, piece in text_batches(batch, "text"):
            own = [words_of(x) for x in piece]
            y = np.repeat(batch.column("y").to_numpy()[at : at + len(piece)], [len(x) for x in own])
            yield {"word": [w for x in own for w in x], "y": y}

    spread = found.repartition("doc_id")
    rows = map_arrow(spread.where(~checks), count, "word string, y int").groupBy("word").agg(F.count_if(F.col("y") == 0).alias("ordinary"), F.count_if(F.col("y") == 1).alias("toxic")).toArrow().sort_by("word")
    model = _tables(rows.column("word").to_pylist(), np.stack([rows.column(c).to_numpy().astype(float) for c in ("ordinary", "toxic")])) if len(rows) else Model()

    def feature(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, piece in text_batches(batch, "text"):
            yield {"x": model.features(piece), "y": batch.column("y").slice(at, len(piece)), "doc_id": batch.column("doc_id").slice(at, len(piece))}

    check = map_arrow(spread.where(checks), feature, "x double, y int, doc_id long").toArrow().sort_by("doc_id")
    x, y = check.column("x").to_numpy(), check.column("y").to_numpy().astype(float)
    each = [int((y == k).sum()) for k in (0, 1)]
    scratch.drop("sample")
    if not all(each):
        model.intercept = prior
        return model
    weight = np.array([total[k] / each[k] for k in (0, 1)])[y.astype(int)] * len(y) / sum(total)
    model.slope, model.intercept = calibrate(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of the bounded sample

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, piece in text_batches(batch, "text"):
            values = shared.value.scores(piece)
            yield {"doc_id": batch.column("doc_id").slice(at, len(piece)), "score": values, "predicted": (values >= threshold).astype(np.int32)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double, predicted int")
