"""BPE encoding and decoding as streaming transducers.

Encoding. The merge list itself tells how far to the right a token's end can depend on the text. A rule
(a, b) fails to close a token at some place only if an earlier rule takes a token off the right spine of b
across that place; that rule's own right side can in turn be taken by a still earlier rule, and so on. The
longest such chain, in bytes, is the *sufficient lookahead*: once that many bytes behind a token's end have
been read, the token is final. ``Transducer.feed`` emits final tokens only and keeps the rest, so a text, or
one unbroken run of letters, of any length passes through memory bounded by the chunk and the lookahead.

Decoding. ``TextMachine`` takes ids, appends their bytes and gives out text up to the last whole character.

Null text: empty, no ids. Repeated rows and ids are handled row by row. Extra columns are ignored, an empty table gives
no rows. Equal ranks can't tie: a merge has a rank of its own, and of one merge the leftmost place goes first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import as_bytes, trim

# The byte-level pre-tokenizer's pattern.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
RUNS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
#: Characters a piece needs behind its end before it is settled: an apostrophe can still become 'll.
HOLD = 2
CHUNK = 1 << 16
LONG = 1 << 12
#: No rule joins the pair; above every rank.
NONE = 1 << 62
CACHE = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Merge rules and vocabulary of a byte-level BPE file, with a bounded cache of encoded pieces."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_alphabet()
        vocab = spec["model"]["vocab"]
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = to_bytes(s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.of_byte = [0] * 256
        for s, i in vocab.items():
            if len(s) == 1:
                self.of_byte[letters[s]] = i
        self.shift = size.bit_length()
        self.mask = (1 << self.shift) - 1
        self.rule: dict[int, int] = {}  # the pair in one number -> rank and new token in one number
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rule.setdefault(vocab[a] << self.shift | vocab[b], rank << self.shift | vocab[a + b])
        self.lookahead = self._lookahead()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache = Cache(self)

    def _lookahead(self) -> int:
        """The longest chain, in bytes, of rules each of which can take a token from the one before it."""
        right: dict[int, int] = {}  # token -> right side of the first rule that makes it
        best: dict[int, int] = {}  # token -> longest chain of earlier rules starting with it on the left
        longest = max(map(len, self.token))
        most = 0
        for pair, ranked in sorted(self.rule.items(), key=lambda x: x[1]):
            a, b, made = pair >> self.shift, pair & self.mask, ranked & self.mask
            reach, t = best.get(b, 0), b
            while t in right:
                t = right[t]
                reach = max(reach, best.get(t, 0))
            reach += len(self.token[b])
            best[a] = max(best.get(a, 0), reach)
            right.setdefault(made, b)
            most = max(most, reach)
        return most + longest

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a byte string: always the lowest-ranked pair, leftmost first."""
        ids = [self.of_byte[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, shift, mask = self.rule.get, self.shift, self.mask
        found = [get(a << shift | b, NONE) for a, b in zip(ids, ids[1:])]
        while found:
            low = min(found)
            if low == NONE:
                break
            i = found.index(low)
            ids[i] = new = low & mask
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << shift | new, NONE)
            if i < len(found):
                found[i] = get(new << shift | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for windows of long runs."""
        n, rule = len(ids), self.rule
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r >> self.shift, i, r & self.mask, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule.get(ids[i] << self.shift | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rule.get(ids[x] << self.shift | ids[y])) is not None:
                    heapq.heappush(heap, (r >> self.shift, x, r & self.mask, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= CHUNK:
            t = Transducer(self)
            return t.feed(text, last=True)
        t = Transducer(self)
        parts = [t.feed(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        return b"".join([*parts, t.feed("", last=True)])


class Cache(dict):
    """piece -> its ids as bytes; emptied when full, so memory stays bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.model.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Text in chunks in, final ids out. State: the unsettled tail, and an open long run's last bytes."""

    def __init__(self, model: Model):
        self.model, self.tail = model, ""
        self.run: regex.Pattern | None = None  # the class of the long run that is open
        self.pending = b""

    def feed(self, chunk: str, last: bool = False) -> bytes:
        text = self.tail + chunk
        self.tail = ""
        out: list[bytes] = []
        held = ""
        m = self.model
        if m.split:
            if not last:  # the start of a special token may stand at the end
                n = max((k for s in m.special for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
                text, held = text[: len(text) - n], text[len(text) - n :]
            *done, text = m.split.split(text) if any(s in text for s in m.special) else [text]
            for part in done:
                if part in m.special:
                    out.append(np.array([m.special[part]], "<u4").tobytes())
                else:
                    self._plain(part, True, out)
        self._plain(text, last, out) if not held else self._plain(text, False, out)
        self.tail += held
        return b"".join(out)

    def _plain(self, text: str, last: bool, out: list[bytes]) -> None:
        text = self.tail + text
        self.tail = ""
        if self.run is not None:
            end = x.end() if (x := self.run.match(text)) else 0
            if end == len(text) and not last:
                self._bytes(text[:-1].encode(), False, out)
                self.tail = text[-1:]
                return
            if self.run is RUNS[3] and end < len(text):  # the last space goes with what follows it
                end = max(0, end - 1)
            self._bytes(text[:end].encode(), True, out)
            self.run, text = None, text[end:]
        pieces = PIECES.findall(text)
        if not last:
            kept = 0
            while pieces and kept < HOLD:
                self.tail = (p := pieces.pop()) + self.tail
                kept += len(p)
            if pieces and len(p) <= HOLD:  # a run of spaces before the held pieces is settled with them
                self.tail = pieces.pop() + self.tail
        out.extend(map(self.model.cache.__getitem__, pieces))
        if not last and len(self.tail) > LONG:
            first = PIECES.match(self.tail)
            if first.end() == len(self.tail):
                body = self.tail[1:] if self.tail[0] == " " and not self.tail.isspace() else self.tail
                self.run = next(r for r in RUNS if r.match(body))
                self._bytes(self.tail[:-1].encode(), False, out)
                self.tail = self.tail[-1:]

    def _bytes(self, more: bytes, last: bool, out: list[bytes]) -> None:
        """Bytes of one long run: emit the tokens that end a sufficient lookahead before what was read."""
        self.pending += more
        if not last and len(self.pending) < 2 * self.model.lookahead:
            return
        ids = self.model.merge(self.pending)
        if last:
            self.pending = b""
        else:
            ends = np.cumsum([len(self.model.token[i]) for i in ids])
            n = int(np.searchsorted(ends, len(self.pending) - self.model.lookahead, side="right"))
            ids = ids[:n]
            self.pending = self.pending[int(ends[n - 1]) if n else 0 :]
        out.append(np.array(ids, "<u4").tobytes())


class TextMachine:
    """Ids in, text out; keeps at most three bytes of an unfinished character."""

    def __init__(self, model: Model):
        self.token, self.rest = model.token, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.rest + b"".join([self.token[i] for i in ids])
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: is its character complete?
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def decode(model: Model, ids: bytes) -> str:
    """Text of ids given as little-endian unsigned 32-bit integers, a bounded number at a time."""
    machine, step = TextMachine(model), 4 * CHUNK
    parts = [machine.feed(np.frombuffer(ids[i : i + step], "<u4").tolist()) for i in range(0, len(ids), step)]
    return "".join([*parts, machine.finish()])


class _Held:
    """A broadcast vocabulary file (a few MB, read on the driver alone) under a name that survives pickling."""

    def __init__(self, df: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            self.sent = df.sparkSession.sparkContext.broadcast(f.read())
        self.id = path

    @property
    def value(self):
        return self.sent.value


_models: dict[int, Model] = {}


def model_of(text: _Held) -> Model:
    """The model of a broadcast file, built once in each worker."""
    if text.id not in _models:
        _models.clear()
        _models[text.id] = Model(text.value)
    return _models[text.id]


def in_steps(column: pa.Array, f: Callable, kind: pa.DataType, step: int = 256) -> pa.Array:
    """f of each value, a few at a time: beside the batch only what comes out of it is held, and what it needed goes back
    to the system when it is done."""
    parts = [pa.array([f(v) for v in column.slice(at, step).to_pylist()], kind) for at in range(0, len(column), step)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    trim()
    return out


def encode_batch(m: Model, texts: pa.Array) -> pa.Array:
    return in_steps(texts, lambda t: m.encode(t) if t else b"", pa.binary())


def decode_batch(m: Model, rows: pa.Array) -> pa.Array:
    return in_steps(rows, lambda b: decode(m, b or b""), pa.string())


def encode_column(df: DataFrame, text: Column, path: str) -> Column:
    """A text column's ids as binary: little-endian unsigned 32-bit integers, empty for null."""
    held = _Held(df, path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_batch(model_of(held), texts)

    return encode(text)


def decode_column(df: DataFrame, ids: Column, path: str) -> Column:
    """The text of a binary column of ids."""
    held = _Held(df, path)

    @F.arrow_udf("string")
    def back(rows: pa.Array) -> pa.Array:
        return decode_batch(model_of(held), rows)

    return back(ids)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes, then decodes what it encoded."""
    held = _Held(docs, path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        m = model_of(held)
        n, a, b = [], [], []
        for t in texts:
            ids = m.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(decode(m, ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")
