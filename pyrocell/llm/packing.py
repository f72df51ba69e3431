"""Packing of token ids into sequences by minimum bin slack.

A document's ids (the library's, then end_id) are cut into pieces of ``capacity``; each of those is a sequence of its
own, and what remains of a document is a piece of a shorter length. A pool counts the pieces of each length. A sequence
takes the longest piece, and of all multisets of the other lengths in the pool the one that fills the rest closest to
capacity: ``closest`` finds it by subset sums, an integer's bits being the reachable sums, one shift and or for each
power of two of a length's count, longest lengths first and no further than an exact fill; the counts are found by going
back over the bits of each step. A multiset found to fill exactly is used as often as the pool has all of it.

Cutting is free, padding isn't. Where no multiset fills a sequence, no piece left is as short as the slack: the longest
is cut to close the sequence, and what remains of it is a piece in the pool again. The ids that are left at the very end
fill sequences of lengths that are powers of two, which aren't padded. So no sequence has padding.

Each partition packs its own documents: no shuffle, nothing on the driver. A task holds the ids of HELD tokens; pieces
that don't fill a sequence exactly wait for later ones, and are cut once they make up half of that.

Null text: empty, so its only id is end_id. A null id is kept. Repeated rows are documents of their own; pieces of one
length are interchangeable, the last one in goes first. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import texts_of, trim
from pyrocell.llm.filter_audit import AFTER, distinct

CAPACITY = 4096
#: Tokens that a task holds before it packs them.
HELD = 12_000_000
#: Runs of bytes and pieces whose ids a worker remembers; longer ones aren't.
CACHE, LONG = 1 << 20, 64
#: Bytes of text that are encoded together.
TOGETHER = 1 << 21
OUT = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: How the file's pre-tokenizer splits a lower-cased run of Latin-1 characters without white space. It
#: splits at none of these: an apostrophe form, letters, one digit, other characters. The space stands between runs.
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS} ]+| ")
WHITE = re.compile("[\x85\xa0]")


class Ids:
    """Ids by the library of texts as UTF-8 bytes, unsigned 32-bit, and a bounded memory of what was encoded.

    The file's tokenizer drops white space, and no token or normal form of it reaches across ASCII white space: a text's
    ids are those of the runs between it. Runs not met before are cut in pieces as the pre-tokenizer does, where they are
    all Latin-1, whose lower case and normal form work on characters alone, else encoded by themselves. New pieces
    of many texts go to the library as one text: each ends with the one token of a word's end. A text that holds
    an added token is encoded whole."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = json.loads(file)["model"].get("end_of_word_suffix")
        ends = [(i, bool(suffix) and t.endswith(suffix)) for t, i in self.tokenizer.get_vocab().items()]
        self.ends = np.zeros(1 + max(i for i, _ in ends), bool)
        self.ends[[i for i, end in ends if end]] = True
        self.runs: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs, by their pieces."""
        plain = lambda t: t.isascii() or (max(t) < "\u0100" and not WHITE.search(t))
        text, own = b" ".join(runs).decode(), {}
        if not plain(text):
            each = text.split(" ")
            own = {r: self.whole(t) for r, t in zip(runs, each) if not plain(t)}
            runs = [r for r in runs if r not in own]
            text = b" ".join(runs).decode()
        pieces = PIECES.findall(text.lower())
        wanted = set(pieces)
        wanted.discard(" ")
        if len(self.pieces) + len(wanted) > CACHE // 2:
            self.pieces.clear()
        new = list(wanted.difference(self.pieces))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(some):
                data = ids.tobytes()
                self.pieces.update((p, data[4 * a : 4 * b]) for p, a, b in zip(some, [0, *end[:-1].tolist()], end.tolist()))
            else:
                self.pieces.update((p, self.whole(p)) for p in some)
        self.pieces[" "] = b"\xff" * 4  # no id: what lies between two is a run's
        each = b"".join(map(self.pieces.__getitem__, pieces)).split(b"\xff" * 4)
        return own | dict(zip(runs, each))

    def of(self, texts: list[bytes]) -> list[bytes]:
        plain = [not any(a in t for a in self.added) for t in texts]
        data = b" ".join([b" ", *(t if p else b"" for t, p in zip(texts, plain)), b" " * 8])
        buffer = np.frombuffer(data, np.uint8)
        turn = np.flatnonzero(np.diff(AFTER[buffer[:-7]].view(np.int8))) + 1
        start, size = turn[::2], turn[1::2] - turn[::2]
        first, of = distinct(buffer, start, size)
        runs = [data[a : a + n] for a, n in zip(start[first].tolist(), size[first].tolist())]
        ids = list(map(self.runs.get, runs))
        missed = [k for k, x in enumerate(ids) if x is None]
        learned = self._learn([runs[k] for k in missed])
        if len(self.runs) + len(learned) > CACHE:
            self.runs.clear()
        self.runs.update((r, x) for r, x in learned.items() if len(r) <= LONG)
        for k in missed:
            ids[k] = learned[runs[k]]
        n = np.array([len(x) for x in ids], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        upto = np.concatenate([[0], np.cumsum(n[of])])
        whole = flat[np.repeat(begin[of] - upto[:-1], n[of]) + np.arange(upto[-1])].tobytes()
        ends = np.cumsum([len(t) + 1 if p else 1 for t, p in zip(texts, plain)]) + 1
        cut = (4 * upto[np.searchsorted(start, ends)]).tolist()
        return [whole[a:b] if p else self.whole(t.decode()) for a, b, t, p in zip([0, *cut], cut, texts, plain)]


_tokenizers: dict[int, Ids] = {}


def ids_by(file: str) -> Ids:
    """The tokenizer of a file's text, once in a worker."""
    if hash(file) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[hash(file)] = Ids(file)
    return _tokenizers[hash(file)]


def closest(pool: Mapping[int, int], target: int, lengths: Sequence[int] | None = None) -> dict[int, int]:
    """Of all multisets of the pool (length -> count) with a sum of at most target one of the greatest sum, as
    length -> count. lengths: those of the pool, ascending."""
    lengths = sorted(pool) if lengths is None else lengths
    full, reach, steps = (1 << (target + 1)) - 1, 1, []
    for k in range(bisect.bisect_right(lengths, target) - 1, -1, -1):
        length = lengths[k]
        left, times = min(pool[length], target // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> target:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return taken


class Packer:
    """Pieces go in, whole sequences come out: lists of (document, start, length)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.pool: dict[int, list[tuple[int, int]]] = {}
        self.count: dict[int, int] = {}  # pieces of each length, but for one that a sequence is begun with
        self.lengths: list[int] = []  # of the pool, ascending
        self.tokens = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.pool:
            self.pool[length], self.count[length] = [], 0
            bisect.insort(self.lengths, length)
        self.pool[length].append((doc, start))
        self.count[length] += 1
        self.tokens += length

    def _take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.pool[length].pop()
        self.count[length] -= 1
        if not self.pool[length]:
            del self.pool[length], self.count[length], self.lengths[bisect.bisect_left(self.lengths, length)]
        self.tokens -= length
        return doc, start, length

    def _filling(self, room: int) -> dict[int, int]:
        """The longest piece that fits, and what fills the rest closest to room."""
        longest = self.lengths[-1]
        if longest > room:
            return closest(self.count, room, self.lengths)
        self.count[longest] -= 1
        chosen = closest(self.count, room - longest, self.lengths)
        self.count[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        return chosen

    def exact(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences filled without a cut; pieces that found none wait."""
        waiting = []
        while self.lengths:
            chosen = self._filling(self.capacity)
            if sum(x * n for x, n in chosen.items()) < self.capacity:
                longest = self.lengths.pop()
                waiting.append((longest, self.pool.pop(longest), self.count.pop(longest)))
                continue
            for _ in range(min(self.count[x] // n for x, n in chosen.items())):
                yield [self._take(x) for x, n in chosen.items() for _ in range(n)]
        for length, pieces, n in reversed(waiting):
            self.pool[length], self.count[length] = pieces, n
            self.lengths.append(length)

    def cut(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences of what waits, closed by a piece that is cut; the last ones at powers of two."""
        while self.tokens >= self.capacity or (last and self.tokens):
            room = self.capacity if self.tokens >= self.capacity else 1 << (self.tokens.bit_length() - 1)
            chosen = self._filling(room)
            sequence = [self._take(x) for x, n in chosen.items() for _ in range(n)]
            slack = room - sum(x * n for x, n in chosen.items())
            if slack:  # every piece left is longer
                doc, start, length = self._take(self.lengths[-1])
                sequence.append((doc, start, slack))
                self.add(doc, start + slack, length - slack)
            yield sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset (the ids before it in its sequence)."""
    with open(tokenizer, encoding="utf-8") as f:  # a vocabulary file of a few MB
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ids_by(sent.value)
        known: dict[int, tuple[int | None, bytes, int]] = {}  # documents with pieces in the pool: id, ids from their last cut on, where those start
        first = TaskContext.get().partitionId() << 40
        packer, rows, sequences, seen = Packer(capacity), [], 0, 0

        def encoded(texts: Iterator[bytes]) -> Iterator[bytes]:
            held, n = [], 0
            for text in texts:
                held.append(text)
                n += len(text)
                if n >= TOGETHER:
                    yield from tokens.of(held)
                    held, n = [], 0
            yield from tokens.of(held)

        def close(made: Iterator[list[tuple[int, int, int]]]) -> None:
            nonlocal sequences
            for pieces in made:
                at = 0
                for doc, start, length in pieces:
                    doc_id, ids, total = known[doc]
                    behind = total - len(ids) // 4
                    rows.append((doc_id, start, length, ids[4 * (start - behind) : 4 * (start + length - behind)], total, first + sequences, at))
                    at += length
                sequences += 1

        def flush(all_: bool = False) -> Iterator[pa.RecordBatch]:
            while len(rows) >= 4096 or (all_ and rows):
                some, rows[:4096] = rows[:4096], []
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*some))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts_of(batch.column(1)))):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], total, first + sequences, 0))
                    sequences += 1
                if whole < total:
                    known[seen] = doc_id, ids[4 * whole :], total
                    packer.add(seen, whole, total - whole)
                    seen += 1
                if packer.tokens >= held:
                    close(packer.exact())
                    if packer.tokens >= held // 2:
                        close(packer.cut(False))
                    live = {doc for pieces in packer.pool.values() for doc, _ in pieces}
                    known = {doc: known[doc] for doc in live}
                yield from flush()
        close(packer.exact())
        close(packer.cut(True))
        yield from flush(True)
        known = {}
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)
