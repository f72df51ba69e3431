"""Gaussian mixtures of several sizes fitted together, and the best by BIC."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.storage import materialise

#: Rows that the first centres are chosen from.
SEEDS = 4096
#: Rows that densities are taken of at once.
STEP = 4096


@dataclass
class Mixture:
    """Components over named columns; each has a weight, a mean and a covariance."""

    cols: list[str]
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Rows by components, weights included."""
        out = np.empty((len(x), len(self.weights)))
        for c, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covs)):
            z = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
            out[:, c] = math.log(max(w, 1e-300)) - (z * z).sum(axis=0) / 2 - np.linalg.slogdet(2 * np.pi * cov)[1] / 2
        return out

    def scores(self, cols: Sequence[str]) -> list[Column]:
        """Log weight times density of each component over some of the columns, as expressions."""
        at = [self.cols.index(c) for c in cols]
        out = []
        for weight, mean, cov in zip(self.weights, self.means[:, at], self.covs[:, at][:, :, at]):
            inverse, (_, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
            z = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, mean)]
            form = sum((z[i] * z[j] * F.lit(float(inverse[i, j])) for i in range(len(at)) for j in range(len(at))), F.lit(0.0))
            out.append(F.lit(math.log(max(weight, 1e-300)) - log_det / 2) - form / 2)
        return out


def _first(sample: np.ndarray, cov: np.ndarray, k: int, cols: list[str], seed: int) -> Mixture:
    """Centres far from each other, each taken with chances as its squared distance to the nearest one so far."""
    rng, scale = np.random.default_rng(seed + k), np.sqrt(np.diag(cov))
    x = sample / scale
    chosen = [int(rng.integers(len(x)))]
    for _ in range(1, k):
        d = np.min([((x - x[i]) ** 2).sum(axis=1) for i in chosen], axis=0)
        chosen.append(int(rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))))
    return Mixture(cols, np.full(k, 1 / k), sample[chosen].astype(float), np.repeat(cov[None] / k, k, axis=0))


def fit_mixtures(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 1, rounds: int = 100, tolerance: float = 1e-5) -> list[tuple[float, int, Mixture]]:
    """(BIC, k, mixture) for every k, BIC being 2 log likelihood - parameters * ln n over the rows complete in ``cols``.

    Equal rows are counted first: a distinct row takes part in each round once, times its count. The mixtures are fitted
    side by side: a round reads the distinct rows once, a task adds up each component's share of them, of their sums and
    of their products, and those sums, not rows, are added across tasks. A mixture is done once its log likelihood a row
    grows by less than ``tolerance``. The first centres come from SEEDS rows, the same on every run; all rows take part in
    each round. Variances are kept above a millionth of the whole's."""
    cols, d, spark = list(cols), len(cols), df.sparkSession
    whole_rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    times = "times" + "_" * max(map(len, cols))  # no column's name
    data = materialise(whole_rows.groupBy(*cols).agg(F.count("*").cast("double").alias(times)))
    total = lambda c: F.sum(F.col(times) * c)
    distinct, n, *sums = data.agg(F.count("*"), F.sum(times), *(total(F.col(c)) for c in cols)).first()
    if not n:
        raise ValueError("no complete row to fit burn classes to")
    if distinct > STEP:  # a round costs by rows and components, not by bytes: all cores take part
        data = materialise(data.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    off = [F.col(c) - F.lit(s / n) for c, s in zip(cols, sums)]
    whole = np.array(data.agg(*(total(a * b) / n for a in off for b in off)).first(), float).reshape(d, d)
    floor = np.diag(np.maximum(np.diag(whole), 1e-12) * 1e-6)
    picked = data.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(SEEDS)
    sample = np.array(picked.collect(), float)
    live = {k: _first(sample, whole + floor, k, cols, seed) for k in ks}
    likelihood, done = dict.fromkeys(ks, -math.inf), {}
    for step in range(rounds + 1):
        sums = _sums(data, live)
        for k, model in list(live.items()):
            total, own = sums[k]
            if step == rounds or total - likelihood[k] < tolerance * n:
                done[k] = (2 * total - (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n), k, model)
                del live[k]
                continue
            likelihood[k] = total
            share = np.maximum(own[:, 0], 1e-12)
            means = own[:, 1 : 1 + d] / share[:, None]
            covs = own[:, 1 + d :].reshape(k, d, d) / share[:, None, None] - means[:, :, None] * means[:, None, :] + floor
            live[k] = Mixture(cols, own[:, 0] / n, means, _proper(covs, floor))
        if not live:
            break
    return [done[k] for k in ks]


def _proper(covs: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Covariances that rounding left without an inverse get one."""
    for c in covs:
        low = np.linalg.eigvalsh(c)[0]
        if low <= 0:
            c += np.eye(len(c)) * (floor.max() - low)
    return covs


def _sums(data: DataFrame, models: dict[int, Mixture]) -> dict[int, tuple[float, np.ndarray]]:
    """For each mixture the log likelihood of counted rows, and for each component its share, sums and products."""
    d = len(next(iter(models.values())).cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, own = dict.fromkeys(models, 0.0), {k: np.zeros((k, 1 + d + d * d)) for k in models}
        for batch in batches:
            *columns, times = (c.to_numpy() for c in batch.columns)
            rows = np.stack(columns, axis=1)
            for at in range(0, len(rows), STEP):
                x, n = rows[at : at + STEP], times[at : at + STEP, None]
                stats = np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)], axis=1)
                for k, m in models.items():
                    p = m.log_densities(x)
                    top = p.max(axis=1, keepdims=True)
                    p = np.exp(p - top)
                    norm = p.sum(axis=1, keepdims=True)
                    totals[k] += float((n * (top + np.log(norm))).sum())
                    own[k] += (p * (n / norm)).T @ stats
        out = [(k, -1, 0, totals[k]) for k in models] + [(k, c, i, float(v)) for k in models for c, row in enumerate(own[k]) for i, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["k", "c", "i", "v"])

    added = data.mapInArrow(run, "k bigint, c bigint, i bigint, v double").groupBy("k", "c", "i").agg(F.sum("v").alias("v")).collect()  # a number of each component's
    out = {k: [0.0, np.zeros((k, 1 + d + d * d))] for k in models}
    for r in added:
        if r.c < 0:
            out[r.k][0] = r.v
        else:
            out[r.k][1][r.c, r.i] = r.v
    return {k: (v[0], v[1]) for k, v in out.items()}
