"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL.

Features. Lower-cased code points; 1- to 3-grams of the text padded by a blank hash into 2^16 buckets; value =
(count / number of n-grams) * idf * SCALE. The model is linear in these values, so a text's score is a sum of
table rows over its n-grams and texts of any length are read whole in slices of bounded size.

Training. Document frequencies count every labelled row that may be learned from. The classifier itself is
fitted by follow-the-regularised-leader with elastic-net penalties on a sample of at most about ``per_label``
rows for each label, taken by a hash of the id (a documented bound: ``per_label`` * number of labels rows reach
the driver, each as sparse features). A fifth of the sample is kept back to fit the temperature.

Prediction. Softmax of scores over temperature; ``und`` with score 1 if the text is null or has no letter.
Ties go to the first label in sorted order. With nothing to learn from, every text is ``und`` with score 0
(1 without a letter). Rows of a null id are predicted but neither learned from nor held out. Labels, sources
and ids are never inputs. Extra columns are kept by ``predict`` and ignored by ``held_out_predictions``; an empty table gives
no rows. More than 1,000 labels are an error: a sample of each reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import crc_mod, materialise, trim

BITS, ORDERS, SCALE, SLICE = 16, (1, 2, 3), 100.0, 1 << 20
LETTER = regex.compile(r"\p{L}")
MULTIPLY = np.uint32(0x9E3779B1)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, a slice at a time; neighbours overlap so none is lost."""
    text = f" {text.lower()} "
    keep = max(ORDERS) - 1
    for start in range(0, len(text) - keep, SLICE):
        c = np.frombuffer(text[start : start + SLICE + keep].encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = start + SLICE + keep >= len(text)
        h = np.zeros(len(c), np.uint32)
        for n in ORDERS:
            m = len(c) - n + 1 if whole else SLICE
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * MULTIPLY
            h ^= h >> np.uint32(15)
            yield (h[:m] * MULTIPLY) >> np.uint32(32 - BITS)


@dataclass
class LanguageModel:
    """labels, table (2^BITS, labels) with the idf and scale inside, bias, temperature."""

    labels: list[str]
    table: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def score(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for idx in buckets(text):
            seen = np.bincount(idx, minlength=1 << BITS).astype(np.float32)
            total += seen @ self.table
            n += len(idx)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text):
            return "und", 1.0
        if not self.labels:
            return "und", 0.0
        p = softmax(self.score(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over every row of a column ``text``: in how many texts each bucket occurs, and how many texts there are.
    At most 2^BITS rows come back, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen = np.zeros(1 << BITS, bool)
                for idx in buckets(t.as_py() or ""):
                    seen[idx] = True
                df[:-1] += seen
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    rows = texts.select("text").mapInArrow(count, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        df[r.bucket] = r.df
    return df[:-1], int(df[-1])


def sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows for each label, by a hash of the id: the same rows at every run."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    if len(counts) > 1000:
        raise ValueError(f"{len(counts)} labels; at most 1000 can be learned")
    part = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n)))) if counts else F.lit(None)
    return rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < part[F.col(label)] * (1 << 20)) if counts else rows


def features(rows: DataFrame, label: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of each row of a bounded sample, in a fixed order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for t in batch.column(2):
                seen, n = np.zeros(1 << BITS, np.int64), 0
                for idx in buckets(t.as_py() or ""):
                    seen += np.bincount(idx, minlength=1 << BITS)
                    n += len(idx)
                k = np.flatnonzero(seen)
                at.append(k.astype(np.uint16).tobytes())
                share.append((seen[k] / max(n, 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["id", "label", "at", "share"])

    got = rows.select("id", F.col(label).alias("label"), "text").mapInArrow(of, "id bigint, label string, at binary, share binary").collect()
    got.sort(key=lambda r: (hash_order(r.id), r.at, r.label))
    return [(r.label, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.share, np.float32)) for r in got]


def hash_order(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2^BITS, k) and bias of multinomial logistic regression; l1 keeps rare buckets at zero."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        w[np.abs(zz) <= l1] = 0
        return w

    for _ in range(epochs):
        for y, at, x in rows:
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(rows: DataFrame, per_label: int = 1000) -> LanguageModel:
    """A model from (id, text, label) rows with a label; see the module's text for what is bounded."""
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    got = features(sample(rows, "label", per_label), "label")
    labels = sorted({r[0] for r in got})
    if not labels:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    data = [(labels.index(lab), at, share * idf[at] * SCALE) for lab, at, share in got]
    fit, held = [r for i, r in enumerate(data) if i % 5], data[::5]
    w, bias = ftrl(fit or data, len(labels))
    scores = np.array([x @ w[at] + bias for _, at, x in held])
    return LanguageModel(labels, (w * (idf * SCALE)[:, None]).astype(np.float32), bias, temperature(scores, np.array([y for y, *_ in held])))


def predict_column(df: DataFrame, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column. The model is 2^BITS * labels floats: bounded."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        m = sent.value
        got = [m.predict(t.as_py()) for t in texts]
        trim()
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return of(text)


def held_out_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows whose crc32(id) mod 3 is not 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    model = train(rows.where(crc_mod(F.col("id"), 3) != 1))
    out = rows.select("id", "text", F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"))
    return out.select(F.col("id").alias("doc_id"), "held_out", predict_column(docs, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")
