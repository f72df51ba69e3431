"""Substring deduplication: every word covered by a window of words that also starts earlier is removed.

A window is WINDOW consecutive words of one text. Order: ascending id (null first), then place in the text; rows
that share an id are ordered as the sort leaves them. Windows are judged on the input, not on what is left.

Count-min prefilter. Each window has an anchor: of its SHINGLE-word runs the one of least hash, the leftmost on
ties. Equal windows have equal anchors at different places, so an anchor that occurs once proves that its
windows do. The sketch has DEPTH rows of saturating counters (none, one, more) for each slice of the anchors, slices
being ranges of another hash. A chunk counts its anchors in a sparse sketch, the counters it reached, and sends
each slice its part; a slice merges the parts by adding and answers each chunk one bit per counter: did it reach two? The
merged sketch can only overestimate. Slices and counters follow the number of words, so the filter is as sharp at any
size, and no worker, nor the driver, holds more than one slice.

Second pass. Chunks of texts in order send the distinct hashes of the windows left to buckets; a bucket finds
the first chunk of each hash and answers each chunk one bit per hash: does it occur in an earlier chunk? In its
own chunk a window is repeated if the bit is set or it isn't the chunk's first. A window is compared by 64 bits of one
hash of its words, and by 32 bits and the bucket's number of another: over 10^13 different windows, the odds that
any two are taken for one are under 10^-3.

Null and empty texts have no words. Texts under WINDOW words lose nothing. Other columns are carried along by
``deduplicate``, whatever their names; an empty table gives an empty result. A very long text is one chunk.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pyrocell.llm.chunks import bucket_count, chunked, from_ipc
from pyrocell.llm.common import as_bytes, fresh, materialise, pack_sorted, trim, unpack_sorted

WINDOW, SHINGLE = 20, 8
DEPTH = 2
#: Counters a row of the sketch for each byte of compressed chunks, which have some two bytes a word; a seventh of the
#: words are anchors: several counters each.
COUNTERS = 1 / 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = h * factor
    h ^= h >> np.uint64(29)
    h *= FACTORS[2]
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of k values, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    step, width, left = h, 1, k
    while left:
        if left & 1:
            if out is None:
                out, have = step, width
            else:
                n = len(step) - have
                out, have = out[:n] * power_of(factor, width) + step[have:], have + width
        left >>= 1
        if left:
            step = step[:-width] * power_of(factor, width) + step[width:]
            width *= 2
    return out


def power_of(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


class Words:
    """The words of a chunk's texts one after another, with the window hashes of those within one text."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        h = xxhash.xxh64_intdigest
        self.words = split
        self.h = np.fromiter((h(w) for ws in split for w in ws), np.uint64, int(self.starts[-1]))

    def windows(self) -> np.ndarray:
        """Places where a window starts."""
        fits = self.sizes >= WINDOW
        if not fits.any():
            return np.zeros(0, np.int64)
        n = self.sizes[fits] - WINDOW + 1
        first = np.repeat(self.starts[:-1][fits], n)
        return first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)

    def anchors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows at the places: the place and the hash of each one's anchor."""
        g = mix(runs(self.h, SHINGLE, FACTORS[0]), FACTORS[1])
        span = WINDOW - SHINGLE + 1
        low = g.copy()
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[at], low[at + span - width])
        place = np.zeros(len(at), np.int64)
        for o in range(span - 1, -1, -1):
            place[g[at + o] == low] = o
        return at + place, low

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return runs(self.h, WINDOW, FACTORS[0])[at], mix(runs(self.h, WINDOW, FACTORS[1])[at], FACTORS[0])


@dataclass(frozen=True)
class Layout:
    """The sketch: slices of DEPTH rows of 2^bits counters. A cell is its slice, row and counter in one number."""

    slices: int
    bits: int

    @property
    def width(self) -> int:
        return DEPTH << self.bits

    def cells(self, anchor: np.ndarray) -> np.ndarray:
        """The cell of each anchor in each row, DEPTH x anchors."""
        first = (mix(anchor, FACTORS[2]) >> np.uint64(24)) % np.uint64(self.slices) * np.uint64(self.width)
        return np.stack([first + np.uint64(row << self.bits) + (mix(anchor, f) >> np.uint64(64 - self.bits)) for row, f in enumerate(FACTORS[:DEPTH])])


def layout(size: int, slices: int) -> Layout:
    return Layout(slices, max(4, math.ceil(math.log2(size * COUNTERS / slices + 1))))


def split(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups present, of ascending group numbers, and where each begins, with the end."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return group[at], np.append(at, len(group))


def anchor_cells(w: Words, at: np.ndarray, sketch: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the windows' anchors, each place once, and the anchor of each window among them."""
    place, anchor = w.anchors(at)
    new = np.r_[True, place[1:] != place[:-1]]  # places ascend with their windows
    return sketch.cells(anchor[new]), np.cumsum(new) - 1


def sparse_sketch(w: Words, sketch: Layout) -> pa.RecordBatch:
    """The counters a chunk reached, by slice, and which of them it reached twice."""
    at = w.windows()
    cells, n = np.unique(anchor_cells(w, at, sketch)[0], return_counts=True) if len(at) else (at.astype(np.uint64), at)
    slices, ends = split((cells // np.uint64(sketch.width)).astype(np.int64))
    cells = cells % np.uint64(sketch.width)
    parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    keys, more = [pack_sorted(cells[a:b]) for a, b in parts], [np.packbits(n[a:b] > 1).tobytes() for a, b in parts]
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(keys, pa.binary()), pa.array(more, pa.binary())], ["slice", "cells", "more"])


def merged(t: pa.Table, sketch: Layout) -> pa.Table:
    """One slice: the sum of the chunks' sparse sketches, and for each chunk whether its counters reached two in it."""
    once, twice = np.zeros(sketch.width, bool), np.zeros(sketch.width, bool)
    for cells, more in zip(t.column("cells"), t.column("more")):
        k = unpack_sorted(cells.as_py()).astype(np.int64)
        again = once[k] | np.unpackbits(np.frombuffer(more.as_py(), np.uint8), count=len(k)).astype(bool)
        twice[k[again]] = True
        once[k] = True
    bits = [np.packbits(twice[unpack_sorted(cells.as_py()).astype(np.int64)]).tobytes() for cells in t.column("cells")]
    return pa.table([t.column("chunk"), t.column("slice"), pa.array(bits, pa.binary())], names=["chunk", "slice", "reached"])


def estimated_repeated(w: Words, at: np.ndarray, reached: dict[int, bytes], sketch: Layout) -> np.ndarray:
    """Whether the sketch puts the anchor of a window at two or more: never false for one that occurs twice."""
    cells, which = anchor_cells(w, at, sketch)
    known, inverse = np.unique(cells, return_inverse=True)
    slices, ends = split((known // np.uint64(sketch.width)).astype(np.int64))
    two = np.concatenate([np.unpackbits(np.frombuffer(reached[s], np.uint8), count=n) for s, n in zip(slices.tolist(), np.diff(ends).tolist())])
    return two[inverse.reshape(cells.shape)].all(axis=0)[which]


def candidates(w: Words, reached: dict[int, bytes], sketch: Layout, buckets: int) -> tuple[np.ndarray, ...]:
    """Places, buckets, hashes and check hashes of windows that may be repeated, ordered by bucket, hashes and place;
    and whether each is the first of its hashes."""
    at = w.windows()
    if len(at):
        at = at[estimated_repeated(w, at, reached, sketch)]
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(np.uint32), at.astype(bool)
    h, other = w.hashes(at)
    bucket, check = (other % np.uint64(buckets)).astype(np.int64), (other >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((at, check, h, bucket))
    at, bucket, h, check = at[order], bucket[order], h[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (bucket[1:] != bucket[:-1])
    return at, bucket, h, check, new


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The columns of docs with the removed words cut out of the text (texts that lose nothing are unchanged),
    plus n_words and n_removed (underscores are appended where docs has such a column); with digest instead doc_id,
    n_words, n_removed, kept_sha256."""
    chunks = materialise(chunked(docs.select(id_col, text_col) if digest else docs, id_col))
    size = chunks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    buckets = bucket_count(docs, size)
    sketch = layout(size, buckets)

    def texts(payload: bytes) -> list[bytes | None]:
        return as_bytes(from_ipc(payload).column(text_col).combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                rows = sparse_sketch(Words(texts(payload.as_py())), sketch)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * rows.num_rows, pa.int64()), *rows.columns], ["chunk", *rows.schema.names])
        trim()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, got in zip(batch.column("chunk").to_pylist(), batch.column("payload"), batch.column("sketch")):
                _, bucket, h, check, new = candidates(Words(texts(payload.as_py())), reached(got), sketch, buckets)
                bucket, h, check = bucket[new], h[new], check[new]
                full, ends = split(bucket)
                parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()), pa.array([pack_sorted(h[a:b]) for a, b in parts], pa.binary()), pa.array([check[a:b].tobytes() for a, b in parts], pa.binary())], ["bucket", "chunk", "keys", "checks"])
        trim()

    def resolve(t: pa.Table) -> pa.Table:
        """For each chunk, a bit per key: does an earlier chunk have it?"""
        who = np.array(t.column("chunk").to_pylist(), np.int64)
        keys = [unpack_sorted(k.as_py()) for k in t.column("keys")]
        which = np.repeat(np.arange(len(who)), [len(k) for k in keys])
        h, check = np.concatenate(keys), np.frombuffer(b"".join(t.column("checks").to_pylist()), np.uint32)
        rank = np.empty(len(who), np.int64)
        rank[np.argsort(who, kind="stable")] = np.arange(len(who))
        order = np.lexsort((rank[which], check, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
        ends = np.cumsum([len(k) for k in keys])
        bits_ = [np.packbits(later[e - len(k) : e]).tobytes() for k, e in zip(keys, ends)]
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array(bits_, pa.binary())], names=["chunk", "bucket", "later"])

    def reached(got: pa.ListScalar) -> dict[int, bytes]:
        return {a["slice"]: a["reached"] for a in got.as_py() or []}

    counted = chunks.select("chunk", "payload").mapInArrow(count, "chunk bigint, slice bigint, cells binary, more binary")
    estimates = counted.groupBy("slice").applyInArrow(lambda t: merged(t, sketch), "chunk bigint, slice bigint, reached binary")
    estimates = estimates.groupBy("chunk").agg(F.collect_list(F.struct("slice", "reached")).alias("sketch"))
    chunks = chunks.select("chunk", "payload").join(estimates, "chunk", "left")
    sent_keys = chunks.mapInArrow(send, "bucket bigint, chunk bigint, keys binary, checks binary")
    answers = sent_keys.groupBy("bucket").applyInArrow(resolve, "chunk bigint, bucket bigint, later binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "later")).alias("answers"))
    both = chunks.join(answers, "chunk", "left").select("payload", "sketch", "answers")
    named = [fresh(c, docs.columns) for c in ("n_words", "n_removed")]
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" if digest else StructType([*docs.schema.fields]).add(named[0], "long").add(named[1], "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, known, got in zip(batch.column("payload"), batch.column("sketch"), batch.column("answers")):
                rows = from_ipc(payload.as_py())
                text = as_bytes(rows.column(text_col).combine_chunks())
                w = Words(text)
                gone = covered(w, {a["bucket"]: a["later"] for a in got.as_py() or []}, reached(known), sketch, buckets)
                lost = [gone[a:b] for a, b in zip(w.starts[:-1], w.starts[1:])]
                n_removed = pa.array([int(x.sum()) for x in lost], pa.int64())
                n_words = pa.array(w.sizes)
                if digest:
                    kept = [hashlib.sha256(b" ".join([x for x, g in zip(ws, ls.tolist()) if not g] if ls.any() else ws)).hexdigest() for ws, ls in zip(w.words, lost)]
                    yield pa.RecordBatch.from_arrays([rows.column(id_col).combine_chunks().cast(pa.int64()), n_words, n_removed, pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    at = rows.schema.get_field_index(text_col)
                    new = [t if not ls.any() else cut(t, ls) for t, ls in zip(text, lost)]
                    rows = rows.set_column(at, rows.schema.field(at), pa.array(new, pa.binary()).cast(pa.string()).cast(rows.schema.field(at).type))
                    yield from rows.append_column(named[0], n_words).append_column(named[1], n_removed).combine_chunks().to_batches()
        trim()

    return both.mapInArrow(apply, schema)


def covered(w: Words, answers: dict[int, bytes], reached: dict[int, bytes], sketch: Layout, buckets: int) -> np.ndarray:
    """Which words of a chunk a repeated window covers."""
    at, bucket, h, _, new = candidates(w, reached, sketch, buckets)
    edge = np.zeros(len(w.h) + 1, np.int64)
    if len(at):
        full, ends = split(bucket[new])
        later = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=n) for b, n in zip(full.tolist(), np.diff(ends).tolist())]
        repeated = np.concatenate(later).astype(bool)[np.cumsum(new) - 1] | ~new
        at = at[repeated]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def cut(text: bytes, lost: np.ndarray) -> bytes:
    """The text without its lost words; what stood between kept neighbours stays, a gap becomes what preceded it."""
    out, end, gap = [], 0, b""
    for m, gone in zip(WORD.finditer(text), lost.tolist()):
        if gone:
            gap = gap or text[end : m.start()]
        else:
            out += [gap or text[end : m.start()], m[0]] if out or not gap else [m[0]]
            gap = b""
        end = m.end()
    return b"".join(out)
