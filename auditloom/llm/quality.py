"""Quality scores from compression: two zstandard dictionaries, one of good text and one of bad.

A text is compressed in chunks with either dictionary. The difference of the
two sizes, divided by the text's length (short texts are drawn to what scores the
share of good labels), is the only feature; a logistic curve fitted on labelled texts
that neither dictionary has seen turns it into a score between 0 and 1.

The model is fitted on a bounded sample of labelled rows, ``MAX_PER_CLASS`` of
each label and texts of at most ``MAX_CHARS`` characters, taken in hash order;
every row is scored, on its whole text. Only the text enters a score. Calibration
weighs its rows by the counts of all labels that may be learnt from, so a score
means the same however large the sample is.

Nulls: a null text is empty, and scores the share of good labels; a null label
or id is no label; of several labels for an id the larger counts. With
only one class labelled, the score is that class's share. An empty table gives
an empty result; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The bounds of the labelled sample.
MAX_PER_CLASS, MAX_CHARS = 2000, 16384
DICTIONARY_BYTES, CHUNK, LEVEL = 65536, 1024, 3
#: Texts count as this many bytes longer, at the difference that scores the share of good labels.
PRIOR_BYTES = 48
#: Of five labelled texts one calibrates, the others make dictionaries.
CALIBRATE_EVERY = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool
    mean: float
    slope: float
    intercept: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        out = []
        for data in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(data, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def differences(self, texts: list[str]) -> np.ndarray:
        """(bad size - good size) / length of each text, drawn to ``mean`` when short."""
        if not self.good:
            return np.zeros(len(texts))
        good, bad = self.compressors()
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            gain = 0
            for at in range(0, len(raw), CHUNK):
                piece = raw[at : at + CHUNK]
                gain += len(bad.compress(piece)) - len(good.compress(piece))
            out[i] = (gain + PRIOR_BYTES * self.mean) / (len(raw) + PRIOR_BYTES)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.slope * self.differences(texts) + self.intercept, -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes, bool]:
    """Trained dictionaries; the texts themselves where there are too few to train on."""
    pieces = [[x[i : i + CHUNK] for x in own for i in range(0, len(x), CHUNK)] for own in (good, bad)]
    try:
        return (*(zstandard.train_dictionary(DICTIONARY_BYTES, own).as_bytes() for own in pieces), False)
    except zstandard.ZstdError:
        return (*(b"\n".join(own)[:DICTIONARY_BYTES] for own in pieces), True)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over weighted rows, by Newton's method with a weak prior."""
    spread = float(x.std()) or 1.0
    z, w = (x - x.mean()) / spread, np.zeros(2)
    rows = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([0.05, 1e-6]), rows.T @ (weight * (y - p)) - np.array([0.05, 0]) * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from the labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # twice the bound: some may be too long or missing in docs; bounded, so it may be broadcast
    chosen = known.where("y = 1").orderBy(*order).limit(2 * max_per_class).unionByName(known.where("y = 0").orderBy(*order).limit(2 * max_per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.char_length("text") > 0) & (F.char_length("text") <= max_chars))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = []
    for y in (0, 1):
        rows += found.where(F.col("y") == y).orderBy(*order).limit(max_per_class).collect()
    sides = [[r["text"].encode("utf-8") for r in rows if r["y"] == y] for y in (0, 1)]
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = [counted.get(0, 0), counted.get(1, 0)]
    prior = float(np.log((total[1] + 1) / (total[0] + 1)))
    if not sides[0] or not sides[1]:
        return Model(b"", b"", True, 0.0, 0.0, prior)
    learn = [[x for i, x in enumerate(own) if i % CALIBRATE_EVERY or len(own) < CALIBRATE_EVERY] for own in sides]
    check = [[x for i, x in enumerate(own) if not i % CALIBRATE_EVERY] for own in sides]
    bad, good, raw = _dictionaries(*learn)
    model = Model(good, bad, raw, 0.0, 1.0, 0.0)
    size = np.array([len(x) + PRIOR_BYTES for own in check for x in own])
    gain = model.differences([x.decode("utf-8") for own in check for x in own]) * size
    y = np.repeat([0.0, 1.0], [len(own) for own in check])
    each = np.array([total[k] / len(check[k]) for k in (0, 1)])
    weight = each[y.astype(int)] * len(y) / sum(total)
    for _ in range(8):  # the difference that scores the prior and the curve depend on each other
        model.slope, model.intercept = calibrate((gain + PRIOR_BYTES * model.mean) / size, y, weight)
        model.mean = (prior - model.intercept) / model.slope if abs(model.slope) > 1e-9 else 0.0
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        values = model.scores([x or "" for x in batch.column("text").to_pylist()])
        yield {"doc_id": batch.column("doc_id"), "score": values, "predicted": (values >= threshold).astype(np.int32)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    columns = docs.columns

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        kept = batch.filter(pa.array(model.scores([x or "" for x in batch.column("text").to_pylist()]) >= threshold))
        yield {c: kept.column(c) for c in columns}

    return map_arrow(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
