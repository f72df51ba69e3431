"""Katz back-off language model over words, and its scores.

A text's tokens are its words (A-Z lowered) and one end token. Model, order 2:
    P(w | h) = d(c(h, w)) c(h, w) / c(h)          if the pair was seen in training,
    P(w | h) = alpha(h) P(w)                      otherwise,
    P(w)     = d1(c(w)) c(w) / N,  and for unknown words together what the discounts leave over.
d and d1 are Good-Turing discount ratios for counts up to K (absolute discounting where the counts of counts
don't allow them). alpha(h) = (1 - sum of P(w | h) over seen pairs) / (1 - sum of P(w) over the same w): summed
over every seen pair of h, so each history's probabilities add up to one. If no discount leaves anything, the
seen pairs of h give up 1 / (c(h) + 1).

Work. Chunks of rows exchange packed keys with buckets (see ``chunks``):
 1. each chunk sends its distinct word hashes with training counts; buckets merge them and words get numbers by
    descending count, so a number tells its count by a table with a row per distinct count (at most
    sqrt(2 N) rows, the one thing besides the hot histories that is broadcast);
 2. each chunk sends its distinct word pairs with training counts. A pair's bucket follows its history, except
    for the HOT most frequent histories, whose pairs are spread over all buckets by pair, so no history is a
    hot group; their sums are added up across buckets (HOT rows at most);
 3. buckets hold the merged pair table (the model, one partition per bucket) and answer each chunk the log
    probability of each pair it sent, backed off if unseen in training (an unknown word is a word of its own
    here); a word after an unknown one has no history and takes P(w) in the chunk itself.
Everything counted covers all training rows whole; no n-gram is dropped.

Null text: no words, only the end token. Rows of a null id are scored and not learned from. Repeated rows count
each. Extra columns are ignored. Without training tokens every unknown token has probability 1 (score 0) and
base_score uses N = V = 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.llm.chunks import bucket_count, chunked, from_ipc, to_ipc
from pyrocell.llm.common import as_bytes, crc_mod, materialise, pack, pack_sorted, trim, unpack, unpack_sorted

K = 5
HOT = 4096
END = b"\n"  # no word has one
UNKNOWN, START = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LN10 = float(np.log(10))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    h = h * FACTOR
    h ^= h >> np.uint64(31)
    return ((h * FACTOR) >> np.uint64(33)).astype(np.int64) % n


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d(r) for r = 0..K (d(0) unused), Good-Turing where valid, else absolute."""
    n = [float(counts_of_counts.get(r, 0)) for r in range(K + 2)]
    d = np.ones(K + 1)
    if n[1]:
        tail = (K + 1) * n[K + 1] / n[1]
        good = [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in good):
            d[1:] = good
        else:
            give = n[1] / (n[1] + 2 * n[2])
            d[1:] = [(r - min(give, 0.99)) / r for r in range(1, K + 1)]
    return d


@dataclass
class Unigrams:
    """Counts of numbered words as steps: words numbered first[i] .. first[i + 1] - 1 occur counts[i] times."""

    first: np.ndarray
    counts: np.ndarray
    total: int
    types: int
    starts: int  # training rows: how often the start is a history
    end: int  # the end token's number

    def __post_init__(self):
        n = np.diff(np.append(self.first, self.types))
        self.d = discounts(dict(zip(self.counts.tolist(), n.tolist())))
        if self.total:
            self.p = self._ratio(self.counts) * self.counts / self.total
            left = 1 - float((self.p * n).sum())
            if left <= 1e-12:  # nothing was discounted
                self.p = self.p * self.total / (self.total + 1)
                left = 1 / (self.total + 1)
            self.unknown = left
        else:
            self.p, self.unknown = np.zeros(0), 1.0

    def _ratio(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.d[np.minimum(c, K)], 1.0)

    def step(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, number, side="right") - 1

    def count(self, number: np.ndarray) -> np.ndarray:
        """0 for an unknown word; the start's number gives the training rows."""
        if not len(self.first):
            return np.zeros(len(number), np.int64)
        out = self.counts[np.maximum(self.step(number), 0)]
        return np.where(number == UNKNOWN, 0, np.where(number == START, self.starts, out))

    def prob(self, number: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.full(len(number), self.unknown)
        return np.where(number == UNKNOWN, self.unknown, self.p[np.maximum(self.step(number), 0)])


def local_words(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, each text closed by END, as places in their distinct hashes; those hashes ordered by
    bucket and hash; the number of tokens of each text."""
    seen: dict[bytes, int] = {END: 0}
    tokens, sizes = [], []
    put = seen.setdefault
    for t in texts:
        ws = (t or b"").lower().split()
        tokens += [put(w, len(seen)) for w in ws]
        tokens.append(0)
        sizes.append(len(ws) + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
    order = np.lexsort((h, bucket_of(h, buckets)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[np.array(tokens, np.int64)], h[order], np.array(sizes, np.int64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Each bucket present, of ascending bucket numbers, with where it begins and ends."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist()))


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return k[new], np.add.reduceat(c, np.flatnonzero(new)) if len(k) else c


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def sent_rows(chunk: int, full: list[tuple[int, int, int]], keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([b for b, _, _ in full], pa.int64()), pa.array([chunk] * len(full), pa.int64()), pa.array([pack_sorted(keys[x:y]) for _, x, y in full], pa.binary()),
        pa.array([pack(small(counts[x:y])) for _, x, y in full], pa.binary()),
    ], ["bucket", "chunk", "keys", "counts"])


KEYS = "bucket bigint, chunk bigint, keys binary, counts binary"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows
    whose crc32(id) mod folds is not held."""
    spark = docs.sparkSession
    # a bucket's share of words and pairs is bounded: it follows the text, not the session's setting
    buckets = bucket_count(docs, (docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // 2)
    fold = crc_mod(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.coalesce(fold != held, F.lit(False)).alias("train"), F.col(text_col).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two kinds of rows: the chunk's texts as places in its words (bucket -1), and its words by bucket."""
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                t = from_ipc(payload.as_py())
                tokens, h, sizes = local_words(as_bytes(t.column("text").combine_chunks()), buckets)
                train = np.repeat(t.column("train").to_numpy(), sizes)
                counts = np.bincount(tokens[train], minlength=len(h))
                kept = t.drop_columns(["text"]).append_column("n", pa.array(sizes)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([chunk]), pa.array([to_ipc(kept)], pa.binary()), pa.array([pack(tokens.astype(np.uint32))], pa.binary())], ["bucket", "chunk", "keys", "counts"])
                yield sent_rows(chunk, by_bucket(bucket_of(h, buckets)), h, counts)
        trim()

    first = materialise(chunked(rows).mapInArrow(tokenise, KEYS).withColumn("texts", F.col("bucket") < 0), "texts")
    texts, vocabulary = first.where("texts").select("chunk", F.col("keys").alias("rows"), F.col("counts").alias("tokens")), first.where("NOT texts").drop("texts")

    def tally(t: pa.Table) -> pa.Table:
        k, c = merge([unpack_sorted(x.as_py()) for x in t.column("keys")], [unpack(x.as_py()).astype(np.int64) for x in t.column("counts")])
        values, n = np.unique(c[c > 0], return_counts=True)
        trim()
        return pa.table([pa.array([t.column("bucket")[0].as_py()] * len(values), pa.int64()), pa.array(values), pa.array(n)], names=["bucket", "count", "n"])

    tallies = materialise(vocabulary.groupBy("bucket").applyInArrow(tally, "bucket bigint, count bigint, n bigint"))
    # one row per distinct count: at most sqrt(2 N) of them
    steps = sorted(((r[0], r[1]) for r in tallies.groupBy("count").agg(F.sum("n")).collect()), reverse=True)
    counts_, sizes_ = np.array([s[0] for s in steps], np.int64), np.array([s[1] for s in steps], np.int64)
    first_of = np.concatenate([[0], np.cumsum(sizes_)])[:-1].astype(np.uint64) if len(steps) else np.zeros(0, np.uint64)
    trained = rows.where("train").count()
    uni = Unigrams(first_of, counts_, int((counts_ * sizes_).sum()), int(sizes_.sum()), trained, -1)
    sent_uni = spark.sparkContext.broadcast(uni)
    # numbers of a bucket's words: within one count, buckets follow each other
    before = F.coalesce(F.sum("n").over(W.partitionBy("count").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = tallies.select("bucket", "count", before.alias("before"))

    def number(words: pa.Table, offs: pa.Table) -> pa.Table:
        u = sent_uni.value
        if not words.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["chunk", "bucket", "numbers"])
        keys = [unpack_sorted(x.as_py()) for x in words.column("keys")]
        k, c = merge(keys, [unpack(x.as_py()).astype(np.int64) for x in words.column("counts")])
        value, base = offs.column("count").to_numpy(), offs.column("before").to_numpy()
        order = np.argsort(value)
        value, base = value[order], base[order]
        by = np.argsort(c, kind="stable")
        rank = np.empty(len(c), np.int64)
        rank[by] = np.arange(len(c)) - np.searchsorted(c[by], c[by])
        at = np.minimum(np.searchsorted(value, c), max(0, len(value) - 1))
        ids = np.full(len(c), UNKNOWN)
        known = c > 0
        if known.any():
            start = u.first[len(u.counts) - 1 - np.searchsorted(u.counts[::-1], c[known])]
            ids[known] = start + base[at[known]].astype(np.uint64) + rank[known].astype(np.uint64)
            if ids[known].max() >= START:  # as 32 bits it would pass for another word
                raise ValueError("more than 2 ** 32 - 2 distinct words")
        got = [pack(ids[np.searchsorted(k, x)].astype(np.uint32)) for x in keys]
        trim()
        return pa.table([words.column("chunk"), words.column("bucket"), pa.array(got, pa.binary())], names=["chunk", "bucket", "numbers"])

    numbers = vocabulary.groupBy("bucket").cogroup(offsets.groupBy("bucket")).applyInArrow(number, "chunk bigint, bucket bigint, numbers binary")
    numbers = numbers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "numbers"))).alias("numbers"))
    numbered = materialise(texts.join(numbers, "chunk"))

    def pairs_of(rows_: bytes, tokens: bytes, numbers_: list[dict]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's rows, the number of each token, of the one before it, and the row each token is in."""
        t = from_ipc(rows_)
        ids = np.concatenate([unpack(x["numbers"]) for x in numbers_]).astype(np.uint64)[unpack(tokens)]
        n = t.column("n").to_numpy()
        before_ = np.empty_like(ids)
        before_[1:] = ids[:-1]
        before_[np.cumsum(n) - n] = START
        return t, ids, before_, np.repeat(np.arange(len(n)), n)

    def pair_bucket(key: np.ndarray) -> np.ndarray:
        h = key >> np.uint64(32)
        hot = (h < HOT) | (h == START)
        return bucket_of(np.where(hot, key, h), buckets)

    def distinct(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that need an answer, the distinct pairs ordered by bucket and key, their buckets, each token's pair."""
        asked = h != UNKNOWN
        key, inverse = np.unique((h[asked] << np.uint64(32)) | w[asked], return_inverse=True)
        bucket = pair_bucket(key)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return asked, key[order], bucket[order], place[inverse]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("chunk", "rows", "tokens", "numbers")}
                t, w, h, doc = pairs_of(r["rows"], r["tokens"], r["numbers"])
                asked, key, bucket, place = distinct(w, h)
                counts = np.bincount(place[t.column("train").to_numpy()[doc[asked]]], minlength=len(key))
                yield sent_rows(r["chunk"], by_bucket(bucket), key, counts)
        trim()

    def gather(t: pa.Table) -> pa.Table:
        """One row per bucket: its part of the pair table, and where each chunk's pairs are in it."""
        keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
        k, c = merge(keys, [unpack(x.as_py()).astype(np.int64) for x in t.column("counts")])
        at = [{"chunk": ch, "at": pack_sorted(np.searchsorted(k, x).astype(np.uint64))} for ch, x in zip(t.column("chunk").to_pylist(), keys)]
        trim()
        return pa.table([pa.array([t.column("bucket")[0].as_py()], pa.int64()), pa.array([pack_sorted(k)], pa.binary()), pa.array([pack(c)], pa.binary()), pa.array([at], pa.list_(pa.struct([("chunk", pa.int64()), ("at", pa.binary())])))], names=["bucket", "keys", "counts", "chunks"])

    model = materialise(numbered.mapInArrow(send, KEYS).groupBy("bucket").applyInArrow(gather, "bucket bigint, keys binary, counts binary, chunks array<struct<chunk:bigint,at:binary>>"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                n = np.bincount(np.minimum(unpack(x.as_py()), K + 2), minlength=K + 3)[1 : K + 2]
                yield pa.RecordBatch.from_arrays([pa.array(range(1, K + 2), pa.int64()), pa.array(n)], ["r", "n"])

    seen = model.select("counts").mapInArrow(counted, "r bigint, n bigint").groupBy("r").agg(F.sum("n")).collect()
    d2 = discounts({r[0]: r[1] for r in seen})

    def sums(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each history of trained pairs: sum of discounted counts, and of its words' unigram probabilities."""
        key, c = key[c > 0], c[c > 0]
        h, first_at = np.unique(key >> np.uint64(32), return_index=True)
        star = np.where(c <= K, d2[np.minimum(c, K)], 1.0) * c
        p = sent_uni.value.prob(key & UNKNOWN)
        if not len(h):
            return h, np.zeros(0), np.zeros(0)
        return h, np.add.reduceat(star, first_at), np.add.reduceat(p, first_at)

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, a, b = sums(unpack_sorted(batch.column(0)[row].as_py()), unpack(batch.column(1)[row].as_py()))
                hot = (h < HOT) | (h == START)
                yield pa.RecordBatch.from_arrays([pa.array(h[hot].astype(np.int64)), pa.array(a[hot]), pa.array(b[hot])], ["h", "star", "p"])

    hot = sorted(tuple(r) for r in model.select("keys", "counts").mapInArrow(hot_sums, "h bigint, star double, p double").groupBy("h").agg(F.sum("star"), F.sum("p")).collect())
    sent_hot = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in hot], t) for i, t in enumerate((np.uint64, float, float))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = sent_uni.value
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, keys, counts, chunks = (batch.column(i)[row].as_py() for i in range(4))
                key, c = unpack_sorted(keys), unpack(counts)
                h, star, p = sums(key, c)
                cold = (h >= HOT) & (h != START)
                h, star, p = (np.concatenate([x, y[cold]]) for x, y in zip(sent_hot.value, (h, star, p)))
                order = np.argsort(h)
                h, star, p = h[order], star[order], p[order]
                of = key >> np.uint64(32)
                total = u.count(of).astype(float)
                at = np.minimum(np.searchsorted(h, of), max(0, len(h) - 1))
                trained_h = h[at] == of if len(h) else np.zeros(len(of), bool)
                star_h, p_h = (np.where(trained_h, x[at], 0.0) if len(h) else np.zeros(len(of)) for x in (star, p))
                spent = np.where(total > 0, star_h / np.maximum(total, 1), 0.0)
                none_left = trained_h & (1 - spent < 1e-12)
                scale = np.where(none_left, total / (total + 1), 1.0)
                left = np.where(none_left, 1 / (total + 1), 1 - spent)
                back = left / np.maximum(1 - p_h, 1e-300) * u.prob(key & UNKNOWN)
                direct = np.where(c <= K, d2[np.minimum(c, K)], 1.0) * c / np.maximum(total, 1) * scale
                value = np.log10(np.where(c > 0, direct, back)).astype(np.float32)
                got = [unpack_sorted(x["at"]).astype(np.int64) for x in chunks]
                yield pa.RecordBatch.from_arrays([pa.array([x["chunk"] for x in chunks], pa.int64()), pa.array([bucket] * len(chunks), pa.int64()), pa.array([pack(value[g]) for g in got], pa.binary())], ["chunk", "bucket", "value"])
        trim()

    answers = model.mapInArrow(answer, "chunk bigint, bucket bigint, value binary")
    answers = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("answers"))
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = sent_uni.value
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("rows", "tokens", "numbers", "answers")}
                t, w, h, doc = pairs_of(r["rows"], r["tokens"], r["numbers"])
                asked, _, _, place = distinct(w, h)
                value = np.log10(np.maximum(u.prob(w), 1e-300))
                if r["answers"]:
                    value[asked] = np.concatenate([unpack(x["value"]) for x in r["answers"]])[place]
                n = t.num_rows
                base = np.log10((u.count(w) + 1) / (u.total + u.types + 1))
                yield pa.RecordBatch.from_arrays([
                    t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks(), t.column("n").combine_chunks(), pa.array(np.bincount(doc[w != UNKNOWN], minlength=n)),
                    pa.array(np.full(n, u.total)), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, value, n)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        trim()

    return numbered.join(answers, "chunk", "left").mapInArrow(finish, out)
