"""How filters overlap: what each removes first, what an earlier one took, in every order they can be applied in.

Counting. A table-driven byte transducer reads a text's UTF-8 bytes once. Its state is whether the last byte was of a
word; a table gives, for a state and a byte, the next state and what to do: begin a word, end one, count a capital, a
code point or a symbol. Each state is entered by bytes of its own kind alone, so the states of a block are the table's
column of the bytes before, and numpy looks the whole block up at once. Word spans go into a hash table with open
addresses: spans that claim a slot together or meet a taken one are compared byte by byte, so that equal hashes never
make two words one; what is inserted are a document's distinct words. A text is read in blocks of BLOCK bytes with
the state and an open word carried over; the table grows with the distinct words.

Audit. Filters A to D follow from a text's own counts, so rows of one text, part and labels are one group from the start
and a text that a third of all rows share costs each task a few rows. E compares texts by SHA-256. Then each part has a
histogram of 32 failure sets, from which each filter behind each set of earlier filters, and so each of the
120 orders, is a sum.

Null text: empty. Null source: the part ''. A null id equals no id and is less than none: such a row never fails E and
has no label. Repeated rows each count; rows of one id and text don't fail E by each other. Several labels of an id: 1 if
any is 1. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.llm.common import texts_of

BLOCK = 1 << 20
BEGIN, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
OUTSIDE, INSIDE = 0, 1
# The bytes between words and the symbols.
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """State after a byte; actions by state * 256 + byte."""
    after = np.array([OUTSIDE if b in SPACES else INSIDE for b in range(256)], np.uint8)
    own = np.array([CAPITAL * (65 <= b <= 90) | POINT * (b & 0xC0 != 0x80) | SYMBOL * (b in SYMBOLS) for b in range(256)], np.uint8)
    return after, np.concatenate([own | BEGIN * (after == INSIDE), own | END * (after == OUTSIDE)]).astype(np.uint8)


AFTER, ACTION = _tables()
#: The low bytes of a 64-bit word that belong to a span with so many bytes left.
LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Spans:
    """A hash table of spans of a buffer, which has eight more bytes at its end; spans of two owners are never equal."""

    def __init__(self, buffer: np.ndarray):
        self.at = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))  # eight bytes from each place on
        self.slots = np.full(1 << 12, -1, np.int64)
        self.n = 0
        self.start = self.size = self.owner = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)

    def _word(self, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        return self.at[start + k] & LOW[np.minimum(size - k, 8)]

    def _hash(self, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
        h = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        on = np.arange(len(start))
        k = 0
        while len(on):
            x = (h[on] ^ self._word(start[on], size[on], k)) * np.uint64(0xD6E8FEB86659FD93)
            h[on] = x ^ (x >> np.uint64(32))
            k += 8
            on = on[size[on] > k]
        return h

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (self.hash[a] == self.hash[b]) & (self.owner[a] == self.owner[b]) & (self.size[a] == self.size[b])
        on = np.flatnonzero(same)
        k = 0
        while len(on):
            u, v = a[on], b[on]
            off = self._word(self.start[u], self.size[u], k) != self._word(self.start[v], self.size[v], k)
            same[on[off]] = False
            k += 8
            on = on[~off]
            on = on[self.size[a[on]] > k]
        return same

    def _place(self, new: np.ndarray) -> np.ndarray:
        """Puts spans into slots; those that became an entry, ascending."""
        mask = len(self.slots) - 1
        place = (self.hash[new] & np.uint64(mask)).astype(np.int64)
        made = []
        while len(new):
            free = self.slots[place] < 0
            self.slots[place[free]] = new[free]  # of several the last stays
            there = self.slots[place]
            own = there == new
            made.append(new[own])
            again = ~own
            again[again] = ~self._equal(new[again], there[again])
            new, place = new[again], (place[again] + 1) & mask
        return np.sort(np.concatenate(made)) if made else new

    def insert(self, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Owners of the spans that weren't there yet."""
        end = self.n + len(start)
        if 2 * end > len(self.slots):
            self.slots = np.full(1 << (2 * end).bit_length(), -1, np.int64)
            self._place(np.arange(self.n))
        if end > len(self.start):
            more = end + len(self.start) // 2
            self.start, self.size, self.owner, self.hash = (np.concatenate([x[: self.n], np.zeros(more - self.n, x.dtype)]) for x in (self.start, self.size, self.owner, self.hash))
        block = slice(self.n, end)
        self.start[block], self.size[block], self.owner[block] = start, size, owner
        self.hash[block] = self._hash(start, size, owner)
        made = self._place(np.arange(self.n, end))
        kept = slice(self.n, self.n + len(made))
        number = np.zeros(end - self.n, np.int64)
        number[made - self.n] = np.arange(kept.start, kept.stop)
        moved = self.slots >= self.n
        self.slots[moved] = number[self.slots[moved] - self.n]
        for x in (self.start, self.size, self.owner, self.hash):
            x[kept] = x[made]
        self.n = kept.stop
        return self.owner[kept]


def distinct(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal spans, and for each span its set's place there: sets by hash, whose spans are then
    compared byte by byte; one that differs from the first of its hash is a set of its own."""
    spans = Spans(buffer)
    spans.start, spans.size, spans.owner = start, size, np.zeros(len(start), np.int64)
    spans.hash = spans._hash(start, size, spans.owner)
    _, first, of = np.unique(spans.hash, return_index=True, return_inverse=True)
    other = np.flatnonzero(~spans._equal(np.arange(len(start)), first[of]))
    of[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), of


def counts(texts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """COUNTS of each text, a row each."""
    buffer = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    size = len(buffer) - 8
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    table, state, open_at = Spans(buffer), OUTSIDE, -1
    for at in range(0, size, block):
        data = buffer[at : min(size, at + block)]
        before = np.empty(len(data), np.uint16)
        before[0] = state
        before[1:] = AFTER[data[:-1]]
        state = AFTER[data[-1]]
        did = ACTION[before * np.uint16(256) + data]
        first = np.searchsorted(begins, at, "right") - 1
        last = np.searchsorted(begins, at + len(data), "left")
        edges = np.maximum(begins[first:last] - at, 0)
        for k, what in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            out[first:last, k] += np.add.reduceat((did & what) != 0, edges, dtype=np.int64)
        start, end = np.flatnonzero(did & BEGIN) + at, np.flatnonzero(did & END) + at
        if open_at >= 0:
            start = np.concatenate([[open_at], start])
        open_at = start[-1] if len(start) > len(end) else -1
        start = start[: len(end)]
        if len(start):
            owner = np.searchsorted(begins, start, "right") - 1
            out[:, 0] += np.bincount(owner, minlength=len(texts))
            out[:, 1] += np.bincount(table.insert(start, end - start, owner), minlength=len(texts))
    out[:, 3] -= 1  # the space behind each text
    return out


def counts_column(text: Column) -> Column:
    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        rows, held, n = [], [], 0
        for t in texts_of(texts):
            held.append(t)
            n += len(t)
            if n >= BLOCK:
                rows.append(counts(held))
                held, n = [], 0
        if held:
            rows.append(counts(held))
        columns = np.concatenate(rows).T if rows else np.zeros((len(COUNTS), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(COUNTS))

    return of(text)


FILTERS = "ABCDE"


def own_failures() -> Column:
    """The set of filters A to D that a text with the counts fails, a bit each."""
    fails = (F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * F.col("n_capitals") > 2 * F.col("n_points"), F.col("n_symbols") > 0)
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def histogram(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, good, toxic, n): the rows of each part, set of failed filters and labels."""
    of = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(of, 256)).alias("text"), counts_column(F.col(text_col)).alias("c"))
    rows = rows.select("doc_id", "part", "text", "c.*").select("doc_id", "part", "text", own_failures().alias("failed"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "text", "failed", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    alike = ("text", "part", "failed", "good", "toxic")
    by_id = rows.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy(*alike).agg(low.alias("low"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = F.min("low.doc_id").over(W.partitionBy("text"))
    fine = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    halves = F.inline(F.array(F.struct(F.col("failed"), F.col("fine").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("fine")).alias("n"))))
    split = by_text.withColumn("least", least).withColumn("fine", fine).select("part", "good", "toxic", halves)
    return split.where("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(filters: str = FILTERS) -> list[tuple[int, int, list[str]]]:
    """(set of earlier filters, filter, the orders in which exactly those stand before it)."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in itertools.permutations(range(len(filters))):
        earlier = 0
        for k in order:
            found.setdefault((earlier, k), []).append("".join(filters[i] for i in order))
            earlier |= 1 << k
    return [(earlier, k, names) for (earlier, k), names in found.items()]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, a row for each part, order and step."""
    cases = F.inline(F.array(*(F.struct(F.lit(earlier).alias("earlier"), F.lit(k).alias("k"), F.lit(1 << k).alias("bit"), F.lit(bin(earlier).count("1") + 1).alias("step")) for earlier, k, _ in orders())))
    each = histogram(docs, labels).select("part", "failed", "good", "toxic", "n", cases)
    failed, by = F.col("failed"), F.col("failed").bitwiseAND(F.col("bit")) != 0
    before = failed.bitwiseAND(F.col("earlier")) != 0
    total = lambda when, of=F.col("n"): F.sum(F.when(when, of).otherwise(0))
    sums = each.groupBy("part", "earlier", "k", "step").agg(
        total(~by & ~before).alias("kept"), total(by & ~before).alias("removed"), total(by & before).alias("redundant"), total(failed == F.col("bit")).alias("unique_fails"),
        total(by & ~before, F.col("n") * F.col("good")).alias("good_lost"), total(by & ~before, F.col("n") * F.col("toxic")).alias("toxic_lost"),
    )
    n = len(FILTERS)
    ways = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(n - 1 - s)) for s in range(n))), F.col("step"))  # orders of what stands before and behind
    whole = sums.withColumn("shapley", F.sum(F.col("removed") * ways).over(W.partitionBy("part", "k")))
    names = F.create_map(*(x for earlier, k, of in orders() for x in (F.lit(earlier * n + k), F.array(*map(F.lit, of)))))
    kept = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return whole.select("part", F.explode(F.element_at(names, F.col("earlier") * n + F.col("k"))).alias("filter_order"), "step", *kept)
