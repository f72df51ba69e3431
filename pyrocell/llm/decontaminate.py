"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are compared as words: A-Z lowered, ASCII punctuation read as a space. A document leaks an item
of L words if some run of its words is within k = floor((1 - SIMILARITY) * L) word edits of it.

Windows. Item-sized windows are laid where a match can be. By the q-gram lemma a match holds at least L - 2 - 3 k of
the item's word triples (items of five words: L - 1 - 2 k = 2 of its pairs, as a changed middle word leaves no triple),
and a triple at offset o of an item places the window o words before it. Places with fewer have no leak; no other
place is left out.

Embedding. A random walk reads a sequence: at each of 3 L steps it writes the word under its pointer, and the
pointer moves on if a random bit of (step, word) is set. After an edit two walks fall into step again, so edit
distance becomes Hamming distance. WALKS walks are sampled TABLES times each; a window and an item that agree in
one whole sample are a candidate pair. The share p of equal places falls with L (at the edit limit about 0.5 at 20
words, 0.2 at 300), so how many places a sample has follows from L: as many, MOST_BITS at most, as still give pairs at
the limit a recall 1 - (1 - p ** bits) ** (WALKS * TABLES) of TARGET, by simulated edits of random sequences.

Verification. Candidate windows of an item that overlap are one stretch of text, which is checked exactly: least edit
distance between the item and any run of its words. Items of under three words are compared as they stand.

Null texts and items have no words; items without words match nothing. Repeated ids and items give a row each
pair of ids once (the best place; ties: the first), rows of a null id as one document. Extra columns are ignored, an
empty table gives no rows. Very long texts are searched whole. Items pass through the driver in blocks of at most
BLOCK_WORDS words, so what is sent is bounded; each block is one pass over the documents, which suits benchmarks of
the usual size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import as_bytes
from pyrocell.llm.substring_dedup import FACTORS, mix, runs

SIMILARITY = 0.8
SEED = 42
WALKS, TABLES, MOST_BITS, TARGET = 4, 16, 4, 0.999
BLOCK_WORDS = 2_000_000
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, SEED) for w in ws), np.uint64, len(ws))


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between item and any run of text, and that run's bounds."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for k, w in enumerate(item.tolist(), 1):
        diagonal = cost[:-1] + (text != w)
        c = np.minimum(np.append(cost[0] + 1, np.minimum(diagonal, cost[1:] + 1)), n + k + 1)
        s = np.append(start[0], np.where(diagonal <= cost[1:] + 1, start[:-1], start[1:]))
        # insertions of text words: a running minimum of cost - place
        shifted = c - np.arange(n + 1)
        low = np.minimum.accumulate(shifted)
        origin = np.maximum.accumulate(np.where(shifted == low, np.arange(n + 1), 0))
        cost, start = low + np.arange(n + 1), s[origin]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def walk(seq: np.ndarray, at: np.ndarray, length: int, number: int) -> np.ndarray:
    """CGK embedding of the windows of ``length`` words at the places: (3 * length, windows)."""
    i = np.zeros(len(at), np.int64)
    out = np.zeros((3 * length, len(at)), np.uint64)
    for j in range(3 * length):
        word = np.where(i < length, seq[np.minimum(at + i, len(seq) - 1)], np.uint64(0))
        out[j] = word
        i += (mix(word ^ np.uint64((number << 32) | (j + 1)), FACTORS[0]) >> np.uint64(63)).astype(np.int64)
    return out


def signatures(seq: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    """(WALKS * TABLES, windows) hashes of the sampled places."""
    out = np.zeros((WALKS * TABLES, len(at)), np.uint64)
    for number in range(WALKS):
        e = walk(seq, at, length, number)
        # a walk has read its window after 2 L steps on average: later places are padding
        places = np.random.default_rng([SEED, length, number]).integers(0, 2 * length, (TABLES, bits))
        for t in range(TABLES):
            row = number * TABLES + t
            out[row] = row
            for p in places[t]:
                out[row] = mix(out[row] ^ e[p], FACTORS[1])
    return out


def sample_bits(length: int, edits: int, pairs: int = 100) -> int:
    """How many places a sample may have so that windows at the edit limit are found with probability TARGET."""
    if not edits:
        return MOST_BITS
    rng = np.random.default_rng([SEED, length])
    a = rng.integers(1, 1 << 63, (pairs, length), np.uint64)
    b = a.copy()
    for i in range(pairs):
        at = np.sort(rng.choice(length, edits, replace=False))
        if i % 2:  # substitutions alone
            b[i, at] = rng.integers(1, 1 << 63, edits, np.uint64)
        else:  # a deletion shifts what follows, an insertion shifts it back
            half = edits // 2
            left = np.insert(np.delete(a[i], at[:half]), at[half:] - half, rng.integers(1, 1 << 63, edits - half, np.uint64))
            b[i] = np.append(left, rng.integers(1, 1 << 63, length, np.uint64))[:length]
    place = np.arange(pairs) * length
    equal = np.stack([(walk(a.ravel(), place, length, w)[: 2 * length] == walk(b.ravel(), place, length, w)[: 2 * length]).mean(0) for w in range(WALKS)])
    for bits in range(MOST_BITS, 1, -1):
        if 1 - np.prod((1 - equal**bits) ** TABLES, 0).mean() >= TARGET:
            return bits
    return 1


class Embedded:
    """The LSH tables of the items of one length."""

    def __init__(self, items: np.ndarray, seqs: list[np.ndarray], length: int, edits: int):
        self.length, self.bits = length, sample_bits(length, edits)
        sig = signatures(np.concatenate([seqs[k] for k in items]), np.arange(len(items)) * length, length, self.bits)
        order = np.argsort(sig.ravel(), kind="stable")
        self.key, self.item = sig.ravel()[order], np.tile(items, len(sig))[order]

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of each pair that agrees in a sample; h must go on for a window beyond the last place."""
        windows, items = [], []
        for i in range(0, len(at), 4096):
            sig = signatures(h, at[i : i + 4096], self.length, self.bits)
            lo = np.searchsorted(self.key, sig, "left")
            n = np.searchsorted(self.key, sig, "right") - lo
            hit = n > 0
            lo, n, which = lo[hit], n[hit], np.nonzero(hit)[1]
            entry = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pair = np.unique(np.stack([np.repeat(which, n) + i, self.item[entry]], 1), axis=0)
            windows.append(pair[:, 0]), items.append(pair[:, 1])
        return np.concatenate(windows), np.concatenate(items)


class Grams:
    """The runs of q words of some items, sorted by hash."""

    def __init__(self, seqs: dict[int, np.ndarray], q: int):
        self.q = q
        keys, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, s in seqs.items():
            g = runs(s, q, FACTORS[0])
            keys.append(g), owner.append(np.full(len(g), k)), offset.append(np.arange(len(g)))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.offset = key[order], np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.bits = max(16, len(key).bit_length() + 6)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.key >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, text number, place, offset) of each run of the texts' words that an item has too."""
        g = runs(h, self.q, FACTORS[0])
        hit = np.flatnonzero(self.filter[(g >> np.uint64(64 - self.bits)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, g[hit], "left"), np.searchsorted(self.key, g[hit], "right")
        doc = np.searchsorted(ends, hit, "right")
        at = (hi > lo) & (hit + self.q <= ends[np.minimum(doc, len(ends) - 1)])
        hit, lo, n, doc = hit[at], lo[at], (hi - lo)[at], doc[at]
        which = np.repeat(np.arange(len(hit)), n)
        entry = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return self.owner[entry], doc[which], hit[which], self.offset[entry]


class Items:
    """Benchmark items ready for matching."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids, self.seqs, seen = [], [], set()
        for i, text in sorted(rows, key=lambda r: (r[0], r[1] or b"")):
            h = word_hashes(words(text))
            if len(h) and (i, h.tobytes()) not in seen:
                seen.add((i, h.tobytes()))
                self.ids.append(i)
                self.seqs.append(h)
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        self.edits = np.floor((1 - SIMILARITY) * self.lengths + 1e-9).astype(np.int64)
        of = {3: {}, 2: {}}
        for k, s in enumerate(self.seqs):
            if len(s) >= 3:
                of[3 if len(s) - 2 - 3 * int(self.edits[k]) > 0 else 2][k] = s
        self.grams = [Grams(seqs, q) for q, seqs in of.items() if seqs]
        lengths = sorted({int(n) for n in self.lengths if n >= 3})
        self.embedded = {n: Embedded(np.flatnonzero(self.lengths == n), self.seqs, n, int((1 - SIMILARITY) * n + 1e-9)) for n in lengths}
        self.short: dict[int, list[int]] = {}
        for k, s in enumerate(self.seqs):
            if len(s) < 3:
                self.short.setdefault(int(runs(s, len(s), FACTORS[0])[0]), []).append(k)

    def leaks(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, first word, end, edits) of every leak, best place of each pair."""
        split = [words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        h = word_hashes([w for ws in split for w in ws])
        if not len(h) or not len(self.seqs):
            return
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in range(len(self.short) and len(h)):
            for n in (1, 2):
                d = int(np.searchsorted(ends, k, "right"))
                if k + n <= ends[d]:
                    for item in self.short.get(int(runs(h[k : k + n], n, FACTORS[0])[0]), ()):
                        best.setdefault((d, item), (0, k - int(starts[d]), k + n - int(starts[d])))
        padded = np.append(h, np.zeros(int(self.lengths.max()), np.uint64))
        for grams in self.grams:
            item, d, place, offset = grams.hits(h, ends)
            length, edits = self.lengths[item], self.edits[item]
            at = np.clip(place - offset, starts[d], np.maximum(starts[d], ends[d] - length))
            # places of an item's runs, in order: those of one item are a stretch of one number line
            line = len(h) + 1
            places = np.unique(item * line + place)
            reach = lambda x: np.searchsorted(places, item * line + x)
            shared = reach(np.minimum(at + length + edits, ends[d])) - reach(np.maximum(at - edits, starts[d]))
            enough = (shared >= length - (grams.q - 1) - grams.q * edits) & (ends[d] - starts[d] >= length - edits)
            windows = np.unique(np.stack([length[enough], d[enough], at[enough]], 1), axis=0)
            pairs = [np.zeros((0, 3), np.int64)]
            for n in np.unique(windows[:, 0]).tolist():
                mine = windows[windows[:, 0] == n]
                w, kk = self.embedded[n].candidates(padded, mine[:, 2])
                pairs.append(np.stack([kk, mine[w, 1], mine[w, 2]], 1))
            pairs = np.concatenate(pairs)
            k, d, at = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))].T
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (at[1:] - at[:-1] > self.lengths[k[1:]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(k)) - 1
            for i, j in zip(first.tolist(), last.tolist()):
                kk, dd = int(k[i]), int(d[i])
                e, begin = int(self.edits[kk]), int(starts[dd])
                a, b = max(begin, int(at[i]) - 2 * e), min(int(ends[dd]), int(at[j]) + int(self.lengths[kk]) + 2 * e)
                cost, x, y = edit_distance(self.seqs[kk], h[a:b])
                found = (cost, a + x - begin, a + y - begin)
                if cost <= e and found < best.get((dd, kk), (1 << 60, 0, 0)):
                    best[dd, kk] = found
        for (dd, k), (cost, a, b) in sorted(best.items()):
            yield dd, k, a, b, cost


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most about block_words words (one item at least)."""
    rows, n = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id IS NOT NULL").toLocalIterator():
        size = len(r.text or b"") // 4 + 1
        if rows and n + size > block_words:
            yield rows
            rows, n = [], 0
        rows.append((r.id, bytes(r.text or b"")))
        n += size
    yield rows


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, edits, similarity): one row per document and item it leaks."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def passed(rows: list[tuple[int, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sent.value
            for batch in batches:
                got = []
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    ids = part.column("doc_id").to_pylist()
                    got += [(ids[d], found.ids[k], a, b, e, 1 - e / int(found.lengths[k])) for d, k, a, b, e in found.leaks(as_bytes(part.column("text")))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names)

        return texts.mapInArrow(run, "doc_id bigint, item_id bigint, first_word int, end_word int, edits int, similarity double")

    names, kinds = ["doc_id", "item_id", "first_word", "end_word", "edits", "similarity"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    every = [passed(rows) for rows in blocks_of(items, item_col, item_text, block_words)]
    best = F.min(F.struct("edits", "first_word", "end_word", "similarity")).alias("b")  # rows that share an id are one document
    return reduce(DataFrame.unionByName, every).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.first_word", "b.end_word", "b.edits", "b.similarity")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text leaks an item; all their columns. Each row is judged by its own text alone,
    whatever its id."""

    def leaky(rows: list[tuple[int, bytes]]) -> Column:
        sent = docs.sparkSession.sparkContext.broadcast(Items(rows))

        @F.arrow_udf("boolean")
        def of(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for at in range(0, len(texts), 2000):
                for d, *_ in sent.value.leaks(as_bytes(texts.slice(at, 2000))):
                    out[at + d] = True
            return pa.array(out)

        return of(F.col(f"`{text_col}`"))

    for rows in blocks_of(items, item_col, item_text, BLOCK_WORDS):
        docs = docs.where(~leaky(rows))
    return docs
