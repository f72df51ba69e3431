"""Token ids in a binary file format: an adaptive context-mixing range coder over independently reset blocks.

Files. A table of chunks in ascending id order: the ids of the rows (key and number of tokens of each), and a
payload of blocks. A block is at most BLOCK tokens: every block starts with an empty model, ends with its own
coder state and has a crc32 of its ids, so blocks are read alone and damage is noticed and stays in one block.
Payload: magic, number of blocks, then for each block its number of tokens, crc32, number of 32-bit words; then
the words of all blocks.

Model. Two predicted ids per place: the id that last followed the two ids before it (order 2, a hash table) and
the one that last followed the id before it (order 1), each with a confidence that grows when it was right. A
three-way symbol says whether the order-2 prediction holds, else whether the order-1 prediction holds, else
neither; its frequencies mix those seen at the order-2 confidence and those seen at the order-1 confidence. The
weights of the two follow the bits that each would have taken so far, later bits counting more. If neither
holds the id is coded by order 0: its high byte by the counts of high bytes seen in the block, then its low byte
by those of low bytes. Predictions change with each token, frequencies and weights at the places RENEW of a block.

Coder. 64-bit range coder with 32-bit output. All blocks of a chunk are coded in step, a numpy lane for each, so
the work is in array operations; all numbers are integers, so any machine reads what another wrote.

Ids. Texts are split as PIECES does by array operations over their characters; the library encodes each piece that
a worker doesn't remember, many in a call.

Null text: no ids but the end id. Rows of a null id come first. Repeated ids stay rows of their own. Extra
columns are ignored. An empty table gives an empty table of chunks.
"""

from __future__ import annotations

import math
import os
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.llm.bpe import byte_alphabet
from pyrocell.llm.chunks import cut, ranged
from pyrocell.llm.common import as_bytes, trim

MAGIC = b"TOK2"
BLOCK = 2048
SLOTS, HASH = 1 << 10, np.uint32(32 - 10)
#: Steps of a block before which its frequencies are renewed.
RENEW = (0, 32, 128, 320, 640, 1024, 1536, BLOCK)
#: Bits of the sums of frequencies: of the three-way symbol, of a byte. One of the first and two of the second fit 32.
KIND, BYTE = 10, 11
#: Weight of a byte seen against one not seen.
SEEN = 16
UNIT = 1 << 12
#: Bits, times 16, of a symbol of a share of UNIT, and order 1's weight of 256 by how many bits more it took.
COST = np.array([16 * 12] + [round(16 * (12 - math.log2(x))) for x in range(1, UNIT + 1)], np.int64)
WEIGHT = np.array([max(1, min(255, round(256 / (1 + 2 ** (d / 8))))) for d in range(-64, 65)], np.int64)
LOW, WORD, SIXTEEN, SIZE, ALL = np.uint64(1 << 32), np.uint64(32), np.uint64(16), np.uint64(0xFFFF), np.uint64(1)
LAST = np.uint64((1 << BYTE) - 1)
#: Bytes of text in a chunk; half the pieces, and bytes of the longest, that a worker remembers; bytes of text whose
#: pieces are looked up together, and that are split together.
TEXT, CACHE, LONG, TOGETHER, SPLIT = 8 << 20, 1 << 18, 64, 8 << 20, 1 << 19


class LaneModel:
    """The adaptive state of n blocks coded in step."""

    def __init__(self, n: int):
        self.n, self.base = n, np.arange(n) * SLOTS
        self.lane16 = np.arange(n) * 16
        self.guess1, self.guess2 = np.zeros(n * SLOTS, np.uint32), np.zeros(n * SLOTS, np.uint32)  # confidence, 16 bits of id
        self.seen1, self.seen2 = np.ones((n, 4, 3), np.int64), np.ones((n, 4, 3), np.int64)
        self.cost1, self.cost2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.bytes = [np.zeros((n, 256), np.uint32), np.zeros((n, 256), np.uint32)]
        self.a, self.of_b = np.zeros(n, np.uint32), np.zeros(n, np.uint32)  # the last id; the one before it, times a constant

    def live(self, n: int) -> None:
        """Only the first n lanes still run."""
        self.base, self.lane16, self.a, self.of_b = self.base[:n], self.lane16[:n], self.a[:n], self.of_b[:n]

    def learn(self, coded: list[np.ndarray], tokens: list[np.ndarray]) -> None:
        """Counts what was coded since the last call: for each step 3 * context + kind, and the ids, of its lanes."""
        n = self.n
        kinds = np.bincount(np.concatenate(coded), minlength=n * 48).reshape(n, 4, 4, 3)  # lane, order 2, order 1, kind
        by1, by2 = kinds.sum(1), kinds.sum(2)
        self.cost1 = self.cost1 // 2 + (by1 * COST[self.share(self.seen1)]).sum((1, 2))
        self.cost2 = self.cost2 // 2 + (by2 * COST[self.share(self.seen2)]).sum((1, 2))
        self.seen1 += by1
        self.seen2 += by2
        at, ids = [], []
        for c, t in zip(coded, tokens):
            missed = np.flatnonzero(c % 3 == 2)
            at.append(missed * 256)
            ids.append(t[missed])
        at, ids = np.concatenate(at), np.concatenate(ids)
        for table, byte in zip(self.bytes, (ids >> 8, ids & 255)):
            table += np.bincount(at + byte, minlength=n * 256).reshape(n, 256).astype(np.uint32)

    @staticmethod
    def share(seen: np.ndarray) -> np.ndarray:
        return seen * UNIT // seen.sum(2, keepdims=True)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The three-way symbol's frequencies in each context of each lane, orders 1 and 2 mixed: the two ends inside, 16 bits
        each, and for each kind start and size, 16 bits each."""
        w = WEIGHT[np.clip((self.cost1 - self.cost2) // 16, -64, 64) + 64][:, None, None, None]
        mixed = w * self.share(self.seen1)[:, None] + (256 - w) * self.share(self.seen2)[:, :, None]
        size = 1 + mixed * ((1 << KIND) - 3) // mixed.sum(3, keepdims=True)
        a, b = size[..., 0], size[..., 0] + size[..., 1]
        cells = np.stack([a, a << 16 | (b - a), b << 16 | ((1 << KIND) - b)], 3)
        return (b << 16 | a).ravel().astype(np.uint64), cells.ravel().astype(np.uint64)

    def order0(self) -> list[np.ndarray]:
        """The frequencies of high and of low bytes, (lanes, 256): start and size, 16 bits each."""
        out = []
        for table in self.bytes:
            k = np.arange(1, 257, dtype=np.uint32)
            sums = np.cumsum(table, axis=1, dtype=np.uint32) * np.uint32(SEEN) + k
            ends = k + sums * np.uint32((1 << BYTE) - 256) // sums[:, -1:]
            size = np.diff(ends, axis=1, prepend=np.uint32(0))
            out.append((ends - size) << np.uint32(16) | size)
        return out

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids predicted by orders 1 and 2, and the context of the three-way symbol."""
        self.s1 = self.base + ((self.a * np.uint32(0x9E3779B1)) >> HASH)
        self.s2 = self.base + ((((self.a * np.uint32(0x85EBCA6B)) ^ self.of_b) * np.uint32(0x9E3779B1)) >> HASH)
        self.e1, self.e2 = self.guess1[self.s1], self.guess2[self.s2]
        self.p1, self.p2 = self.e1 & np.uint32(0xFFFF), self.e2 & np.uint32(0xFFFF)
        return self.p1, self.p2, self.lane16 + ((self.e2 >> np.uint32(16)) * np.uint32(4) + (self.e1 >> np.uint32(16)))

    def update(self, token: np.ndarray) -> None:
        one, sure = np.uint32(1 << 16), np.uint32(3 << 16)
        for guess, s, e, p in ((self.guess1, self.s1, self.e1, self.p1), (self.guess2, self.s2, self.e2, self.p2)):
            guess[s] = np.where(p == token, np.minimum(e + one, p | sure), token)
        self.of_b, self.a = self.a * np.uint32(0xC2B2AE35), token


def live_at(sizes: np.ndarray, step: int) -> int:
    """How many of the blocks, longest first, are longer than step."""
    return int(np.searchsorted(-sizes, -step))


def encode(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each block and their number; ids (steps, blocks). A renewal's steps are first predicted, then looked
    up in its frequencies together, then coded."""
    n, steps = len(sizes), len(ids)
    model = LaneModel(n)
    low, range_ = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    cap = steps + 2
    out, count = np.zeros(n * cap, np.uint32), np.arange(n) * cap
    row = np.arange(n) * 256
    for a, b in zip(RENEW, RENEW[1:]):
        tokens, coded, misses = [], [], []
        for step in range(a, min(b, steps)):
            token = ids[step, : live_at(sizes, step)]
            if len(token) < len(model.base):
                model.live(len(token))
            p1, p2, at = model.predict()
            wrong = token != p2
            missed = wrong & (token != p1)
            coded.append(at * 3 + wrong + missed)
            misses.append(missed)
            tokens.append(token)
            model.update(token)
        if not tokens:
            break
        cells, tables = model.kinds()[1], [t.ravel().astype(np.uint64) for t in model.order0()]
        for token, c, missed in zip(tokens, coded, misses):
            m = len(token)
            before, cell = low[:m], cells[c]
            unit = range_[:m] >> np.uint64(KIND)
            now = before + unit * (cell >> SIXTEEN)
            wide = unit * (cell & SIZE)
            shift = missed * np.uint64(BYTE)
            for table, byte in zip(tables, (token >> np.uint32(8), token & np.uint32(255))):
                cell = np.where(missed, table[row[:m] + byte], ALL)
                unit = wide >> shift
                now += unit * (cell >> SIXTEEN)
                wide = unit * (cell & SIZE)
            for lane in (now < before).nonzero()[0].tolist():  # carried into the words that are out
                k = int(count[lane]) - 1
                while out[k] == 0xFFFFFFFF:
                    out[k] = 0
                    k -= 1
                out[k] += np.uint32(1)
            move = (wide < LOW).nonzero()[0]
            moved = now[move]
            at = count[move]
            out[at] = moved >> WORD
            count[move] = at + 1
            now[move] = moved << WORD
            wide[move] <<= WORD
            low[:m], range_[:m] = now, wide
        model.learn(coded, tokens)
    for word in (low >> WORD, low & np.uint64(0xFFFFFFFF)):
        out[count] = word
        count += 1
    return out.reshape(n, cap), count - np.arange(n) * cap


def decode(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each block (steps, blocks), and what is left of its code: 0 unless it is damaged."""
    n, steps, last = len(sizes), int(sizes.max(initial=0)), np.int64(len(words) - 1)
    model = LaneModel(n)
    word = lambda at: words[np.minimum(at, last)].astype(np.uint64)
    code, range_, place = (word(starts) << WORD) | word(starts + 1), np.full(n, (1 << 64) - 1, np.uint64), starts + 2
    out = np.zeros((steps, n), np.uint32)
    for a, b in zip(RENEW, RENEW[1:]):
        if a >= steps:
            break
        tokens, coded = [], []
        (bounds, kinds), tables = model.kinds(), []
        for cells in model.order0():
            tables.append((np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), (cells & np.uint32(0xFFFF)).ravel()), cells.ravel().astype(np.uint64)))
        for step in range(a, min(b, steps)):
            m = live_at(sizes, step)
            if m < len(model.base):
                model.live(m)
            p1, p2, at = model.predict()
            unit, left, bound = range_[:m] >> np.uint64(KIND), code[:m], bounds[at]
            value = left // unit
            wrong, missed = value >= (bound & SIZE), value >= (bound >> SIXTEEN)
            c = at * 3 + wrong + missed
            cell = kinds[c]
            left = left - unit * (cell >> SIXTEEN)
            wide = unit * (cell & SIZE)
            token = np.where(wrong, p1, p2)
            missed = missed.nonzero()[0]
            some, width, made = left[missed], wide[missed], None
            for symbols, cells in tables:
                unit = width >> np.uint64(BYTE)
                value = np.minimum(some // unit, LAST).view(np.int64)
                value += missed << BYTE
                symbol = symbols[value]
                cell = cells[(missed << 8) + symbol]
                some -= unit * (cell >> SIXTEEN)
                width = unit * (cell & SIZE)
                made = symbol.astype(np.uint32) if made is None else made << np.uint32(8) | symbol
            token[missed], left[missed], wide[missed] = made, some, width
            move = (wide < LOW).nonzero()[0]
            at = place[move]
            left[move] = (left[move] << WORD) | word(at)
            wide[move] <<= WORD
            place[move] = at + 1
            code[:m], range_[:m] = left, wide
            coded.append(c)
            tokens.append(token)
            model.update(token)
            out[step, :m] = token
        model.learn(coded, tokens)
    return out, code


def compress(ids: np.ndarray) -> bytes:
    """The payload of a run of 16-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<I", 0)
    sizes = np.full(n, BLOCK, np.int64)
    sizes[-1] = len(ids) - BLOCK * (n - 1)
    lanes = np.zeros((n, BLOCK), np.uint32)
    lanes.ravel()[: len(ids)] = ids
    words, count = encode(np.ascontiguousarray(lanes[:, : sizes[0]].T), sizes)
    head = np.stack([sizes, [zlib.crc32(lanes[i, :k].astype("<u4")) for i, k in enumerate(sizes.tolist())], count], 1).astype("<u4")
    return b"".join([MAGIC, struct.pack("<I", n), head.tobytes(), *(words[i, :w].astype("<u4").tobytes() for i, w in enumerate(count.tolist()))])


def decompress(payload: bytes) -> np.ndarray:
    """The ids of a payload; raises ValueError if it is damaged."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", payload, 4)
    head = np.frombuffer(payload, "<u4", 3 * n, 8).reshape(n, 3).astype(np.int64)
    if not n:
        return np.zeros(0, np.uint16)
    words = np.frombuffer(payload, "<u4", offset=8 + 12 * n)
    sizes, starts = head[:, 0], np.cumsum(head[:, 2]) - head[:, 2]
    got, left = decode(words, starts, sizes)
    got = np.ascontiguousarray(got.T)
    for i, k in enumerate(sizes.tolist()):
        if left[i] or zlib.crc32(got[i, :k].astype("<u4")) != head[i, 1]:
            raise ValueError(f"block {i} of a token file is damaged")
    return got.ravel()[: sizes.sum()].astype(np.uint16)  # all blocks but the last are as long as the first


LETTER, DIGIT, OTHER, SPACE = range(4)
_classes: list[np.ndarray] = []


def class_of() -> np.ndarray:
    """What PIECES takes each code point for; made once in a worker."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for first in range(0, len(table), 1 << 16):
            chars = "".join(map(chr, range(first, first + (1 << 16))))
            for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, chars):
                    table[first + m.start() : first + m.end()] = kind
        _classes.append(table)
    return _classes[0]


def runs(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive places whose sizes come to about so much; each has one place at least."""
    cuts = np.unique((np.cumsum(size) - size) // most, return_index=True)[1].tolist()
    return list(zip(cuts, [*cuts[1:], len(size)]))


def pieces_of(data: bytes, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin in their UTF-8 bytes, one text after another."""
    begins = begins[size > 0]
    if not data:
        return begins
    if data.isascii():
        chars, place = np.frombuffer(data, np.uint8), None
    else:
        raw = np.frombuffer(data, np.uint8)
        chars, place = np.frombuffer(data.decode().encode("utf-32-le"), "<u4"), np.flatnonzero((raw & 0xC0) != 0x80)
        begins = np.searchsorted(place, begins)
    n = len(chars)
    kind = class_of()[chars]
    first = np.zeros(n + 1, bool)  # of a text
    first[begins] = first[n] = True
    turn = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=turn[1:n])
    turn |= first
    # The last space before other characters is a piece of its own, or if it is a blank the first of theirs.
    last = np.flatnonzero((kind == SPACE) & turn[1:] & ~first[1:])
    turn[last] = True
    turn[last[chars[last] == 32] + 1] = False
    quote = np.flatnonzero(chars == 39)
    quote = quote[turn[quote] & ~first[quote + 1]]
    if len(quote):
        a = chars[quote + 1]
        pair = quote + 2 < n
        b = np.where(pair & ~first[np.minimum(quote + 2, n)], chars[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(a, [*b"stmd"])
        long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        turn[quote[short | long] + 1] = False
        turn[quote[short] + 2] = True
        turn[quote[long] + 3] = True
    at = np.flatnonzero(turn[:n])
    return at if place is None else place[at]


class Ids:
    """Ids by the library of texts, 16 bits each, and a bounded memory of the pieces that were encoded."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = t = Tokenizer.from_str(file)
        t.no_truncation(), t.no_padding()
        if t.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit 16 bits")
        self.added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        # The same without its split of text, for bytes that already are the characters of its tokens: none is a blank.
        self.merges = Tokenizer.from_str(file)
        self.merges.no_truncation(), self.merges.no_padding()
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.char = np.zeros(256, "<u4")
        for c, b in byte_alphabet().items():
            self.char[b] = ord(c)
        self.length = np.zeros(1 << 16, np.int64)  # a byte is one character of a token
        for token, i in t.get_vocab(with_added_tokens=False).items():
            self.length[i] = len(token)
        self.pieces: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # those of before it was full

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Pieces not met before with their ids, many in a call."""
        learned: dict[bytes, bytes] = {}
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            size = np.array([len(p) for p in some])
            ends = np.cumsum(size)
            text = np.insert(self.char[np.frombuffer(b"".join(some), np.uint8)], ends[:-1], 32)
            ids = np.array(self.merges.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u2")
            upto = np.cumsum(self.length[ids])
            last = np.searchsorted(upto, ends)
            if upto[-1:].tolist() != ends[-1:].tolist() or (upto[last] != ends).any():  # a vocabulary without some byte
                learned.update((p, self.whole(p.decode())) for p in some)
                continue
            flat, cut = ids.tobytes(), (2 * last + 2).tolist()
            learned.update((p, flat[a:b]) for p, a, b in zip(some, [0, *cut[:-1]], cut))
        return learned

    def of(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by end_id, and how many each has."""
        special = {k: self.whole(t.decode()) for k, t in enumerate(texts) if any(a in t for a in self.added)}  # the library splits at these first
        plain = [b"" if k in special else t for k, t in enumerate(texts)]
        data, size = b"".join(plain), np.array([len(t) for t in plain], np.int64)
        begins = np.cumsum(size) - size
        at = np.concatenate([pieces_of(data[begins[a] : begins[b - 1] + size[b - 1]], begins[a:b] - begins[a], size[a:b]) + begins[a] for a, b in runs(size, SPLIT)])
        met = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        of, (_, offsets, flat) = met.indices, met.dictionary.buffers()
        held, ends = (flat or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(offsets, np.int64, len(met.dictionary) + 1).tolist()
        known = [held[a:b] for a, b in zip(ends, ends[1:])]
        ids = list(map(self.pieces.get, known))
        missed = [k for k, x in enumerate(ids) if x is None]
        if len(self.pieces) + len(missed) > CACHE:
            self.before, self.pieces = self.pieces, {}
        for k in missed:
            ids[k] = self.before.get(known[k])
        self.pieces.update((known[k], ids[k]) for k in missed if ids[k] is not None)
        missed = [k for k in missed if ids[k] is None]
        learned = self._learn([known[k] for k in missed])
        for k in missed:
            ids[k] = learned[known[k]]
        self.pieces.update((p, x) for p, x in learned.items() if len(p) <= LONG)
        each = pa.array(ids, pa.large_binary()).take(of)
        _, offsets, flat = each.buffers()
        upto = np.frombuffer(offsets, np.int64, len(at) + 1) // 2
        tokens = np.frombuffer(flat or b"", "<u2", upto[-1])
        cut = upto[np.searchsorted(at, begins + size)]
        sizes = np.diff(cut, prepend=0) + 1
        tokens = np.insert(tokens, cut, end_id)
        if special:
            parts = np.split(tokens, np.cumsum(sizes)[:-1])
            for k, x in special.items():
                parts[k] = np.append(np.frombuffer(x, "<u2"), np.uint16(end_id))
                sizes[k] = len(parts[k])
            tokens = np.concatenate(parts)
        return tokens, sizes


_tokenizers: dict[int, Ids] = {}


def ids_by(file: str) -> Ids:
    """The library's tokenizer over a byte-level BPE file, which splits text as PIECES does, once in a worker."""
    if hash(file) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[hash(file)] = Ids(file)
    return _tokenizers[hash(file)]


def ids_of(column: pa.Array, ids: Ids, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As Ids.of, of a column, about TOGETHER bytes at a time."""
    step = max(1, len(column) * TOGETHER // max(1, column.nbytes))
    parts = [ids.of([t or b"" for t in as_bytes(column.slice(at, step))], end_id) for at in range(0, len(column), step)]
    return np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each closed by end_id, in ascending id order as a table at path."""
    with open(tokenizer, encoding="utf-8") as f:  # a vocabulary file of a few MB
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_by(sent.value)
        first = TaskContext.get().partitionId() << 24
        for k, t in enumerate(cut(batches, TEXT)):
            tokens, sizes = ids_of(t.column("text").combine_chunks(), ids, end_id)
            yield pa.RecordBatch.from_arrays([
                pa.array([first + k], pa.int64()), lists(t.column("doc_id").combine_chunks()), lists(pa.array(sizes, pa.int64())), pa.array([len(tokens)], pa.int64()), pa.array([compress(tokens)], pa.binary()),
            ], ["chunk", "doc_ids", "sizes", "n_tokens", "payload"])
            trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged(rows, "doc_id").mapInArrow(run, "chunk bigint, doc_ids array<bigint>, sizes array<bigint>, n_tokens bigint, payload binary").write.parquet(path)


def lists(values: pa.Array) -> pa.Array:
    """One row: the list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def starts(files: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all chunks before. Totals of the writing tasks are added up first, so no
    task sees more than those or one task's chunks."""
    part = F.shiftright("chunk", 24)
    sizes = files.select("chunk", "n_tokens", part.alias("part"))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("inside", inside).join(totals.select("part", upto.alias("upto")), "part").select("chunk", (F.col("inside") + F.col("upto")).alias("start"))
    return files.join(at, "chunk")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each row, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, payload, start = (batch.column(c)[row].as_py() for c in ("doc_ids", "sizes", "payload", "start"))
                ids = decompress(payload).astype("<u4")
                ends = np.cumsum(sizes)
                for a in range(0, len(sizes), 512):
                    b = slice(a, a + 512)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids[b], pa.int64()), pa.array(start + ends[b] - sizes[b], pa.int64()), pa.array(sizes[b], pa.int64()),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[b], sizes[b])], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])
                del ids
                trim()

    return starts(files).select("doc_ids", "sizes", "payload", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
