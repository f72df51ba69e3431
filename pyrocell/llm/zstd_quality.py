"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

Two dictionaries are trained on a bounded sample of labelled texts, one of label 1 and one of label 0. A text
is compressed with each; its raw signal is the difference of the two compressed sizes over their sum, so a text
that the good dictionary explains better scores above zero. Texts are read whole, in frames of FRAME bytes
whose sizes add up, so a dictionary stays useful on long texts and memory is bounded.

Calibration. Half of the sample builds the dictionaries, the other half fits a logistic curve over the signal, which
is all that a score comes from, by Newton's method.

Bounded sample, by parameters of ``train``: at most about ``per_label`` rows of each label, by a hash of the id, are joined
with their texts and reach the driver, at most ``most_bytes`` of each: a longer text is learned from by eight evenly
spaced slices. A dictionary has at most ``dictionary`` bytes and is made of a hundred times as many. Everything is
scored, whole.

Null or empty text: size zero, signal 0; the score is the calibrated share of label 1. Without labels of both
kinds every score is the share of label 1 seen (0.5 if none). Rows of a null id are scored, not learned from.
Repeated labels of an id are one vote each. Extra columns are ignored; an empty table gives no rows. A score equal to
the threshold of 0.3 predicts 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import as_bytes, crc_mod
from pyrocell.llm.langid import hash_order, sample

FRAME = 1 << 14
LEVEL = 3


def frames(text: bytes) -> list[bytes]:
    return [text[i : i + FRAME] for i in range(0, len(text), FRAME)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    level: float

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.level

    def __setstate__(self, state):
        self.good, self.bad, self.slope, self.level = state
        self._pair = None

    def compressors(self) -> list:
        if self._pair is None:
            out = []
            for d in (self.good, self.bad):
                data = zstandard.ZstdCompressionDict(d)
                data.precompute_compress(level=LEVEL)
                out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
            self._pair = out
        return self._pair

    def signal(self, text: bytes) -> float:
        """The normalised difference of the compressed sizes."""
        if not self.good or not text:
            return 0.0
        good, bad = (sum(len(c.compress(f)) for f in frames(text)) for c in self.compressors())
        return (bad - good) / (bad + good)

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.signal(text or b"") + self.level, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, bytes]], dictionary: int = 1 << 16) -> QualityModel:
    """A model from (label, text) rows, every other one of each label for the dictionaries."""
    good, bad = ([t for y, t in rows if y == label and t] for label in (1, 0))
    share = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1)
    if len(good) < 4 or len(bad) < 4:
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    # equal bytes for both dictionaries, so neither wins by having seen more
    room = min(sum(map(len, good[::2])), sum(map(len, bad[::2])), 100 * dictionary)
    size = min(dictionary, max(1024, room // 8))
    dicts = []
    for texts in (good[::2], bad[::2]):
        taken, total = [], 0
        for t in texts:
            if total >= room:
                break
            taken += [t[i : i + 1024] for i in range(0, len(t), 1024)]
            total += len(t)
        dicts.append(zstandard.train_dictionary(size, taken).as_bytes() if len(taken) >= 8 else b"".join(taken)[-size:])
    model = QualityModel(*dicts, 0.0, 0.0)
    held = [(1, t) for t in good[1::2]] + [(0, t) for t in bad[1::2]]
    x = np.array([[model.signal(t), 1.0] for _, t in held])
    scale = np.array([max(np.abs(x[:, 0]).max(), 1e-9), 1.0])
    w = logistic(x / scale, np.array([y for y, _ in held], float)) / scale
    model.slope, model.level = float(w[0]), float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, most_bytes: int = 1 << 16, dictionary: int = 1 << 16) -> QualityModel:
    """docs (id, text), labels (id, label): learns from a bounded sample of the labelled rows."""
    part = most_bytes // 8
    slices = F.concat(*(F.expr(f"substring(text, cast(length(text) * {k} / 8 as int) + 1, {part})") for k in range(8)))
    cut = F.when(F.octet_length("text") > most_bytes, slices).otherwise(F.col("text"))
    rows = sample(labels.where("id IS NOT NULL AND label IN (0, 1)"), "label", per_label)
    rows = F.broadcast(rows)  # the bounded sample: about 2 * per_label rows
    got = docs.join(rows, "id").select("id", "label", cut.cast("binary").alias("text")).collect()
    got.sort(key=lambda r: (hash_order(r.id), r.label, bytes(r.text or b"")))
    return fit([(r.label, bytes(r.text or b"")) for r in got], dictionary)


def score_column(df: DataFrame, model: QualityModel, text: Column) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded bytes

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([m.score(t) for t in as_bytes(texts)], pa.float64())

    return of(text)


def held_out_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels whose crc32(id) mod 5 is not 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train(rows, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(crc_mod(F.col("id"), 5) != 0))
    out = rows.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"), score_column(docs, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
