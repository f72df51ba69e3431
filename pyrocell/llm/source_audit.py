"""How the terms of each source differ from its language's other sources and from the language.

Vocabulary. Terms in at least ``least`` documents of a language are kept. They are sorted by range partitions, and a
task builds of its sorted terms minimal acyclic transducers: states with equal suffixes are one, and a transition puts
out how many terms go by smaller bytes, so that the outputs on a term's path add up to its ordinal. A slice
has about SLICE terms and begins where the first eight bytes of a term change, so those bytes name a term's slice.

Recount. While the slices take HELD bytes at most every task holds them and streams its texts through: numpy moves all
terms of a block one byte on together, in a table of transitions with open addresses. Beyond that a task counts the
terms of its texts, counts are summed by term, and those of a slice stream through that slice alone. Both ways give
(lang, source, ordinal, n).

Audit. Terms of a language are cut by ordinal in blocks of which a task holds the counts of all sources, zeros
included: it adds up what each pair of sources differs by there and keeps each source's first terms. Sums and ranks over
blocks are Spark's. Ordinals break ties: they ascend as the terms do in UTF-8.

Null text, language or source: ''. A null id doesn't matter, rows of one id are documents of their own. Extra columns
are ignored. A language without kept terms has pairs of value 0, a source alone in its language none. An empty
table gives no rows. All arithmetic is in integers: shares by long division, exact to 9e15 terms of a language, an
error beyond.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.llm.common import as_bytes, materialise, pack, texts_of, trim, unpack

#: The bytes of terms, A-Z lower-cased; a space for every other byte.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST = 10
SLICE, HELD = 1 << 16, 32 << 20
#: Bytes of text that stream through at once; entries that a task counts before it sends them.
BLOCK, ENTRIES = 1 << 20, 1 << 20
#: Counts of a block: sources times terms.
CELLS = 1 << 18
UNIT, TOP = 1_000_000_000, 10


def build(terms: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of ascending terms: transitions (from, byte, to, out), final states, and the root,
    which is the last state."""
    register: dict[tuple, int] = {}
    below: list[int] = []  # terms from a state on
    stack: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    before = b""

    def freeze(depth: int) -> None:
        while len(stack) > depth:
            final, edges = stack.pop()
            state = register.setdefault((final, tuple(edges)), len(below))
            if state == len(below):
                below.append(final + sum(below[to] for _, to in edges))
            if stack:
                stack[-1][1].append((before[len(stack) - 1], state))

    for term in terms:
        same = 0
        while same < min(len(term), len(before)) and term[same] == before[same]:
            same += 1
        freeze(same + 1)
        stack.extend((False, []) for _ in term[same:])
        stack[-1] = True, stack[-1][1]
        before = term
    freeze(0)
    edges, final = [], np.zeros(len(below), np.uint8)
    for (ends, out), state in register.items():
        final[state], passed = ends, int(ends)
        for byte, to in out:
            edges.append((state, byte, to, passed))
            passed += below[to]
    state, byte, to, out = np.ascontiguousarray(np.array(edges, np.int64).reshape(-1, 4).T)
    return {"key": state << 8 | byte, "to": to, "out": out, "final": final}


def prefix(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of spans as numbers in byte order, zeros behind shorter ones."""
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | np.where(size > k, data[np.minimum(start + k, len(data) - 1)], 0).astype(np.uint64)
    return out


class Transducers:
    """The slices of one language, or a part of them."""

    def __init__(self, slices: list[tuple[int, bytes, bytes]]):
        """(ordinals before the slice, its first term, payload) in ascending order."""
        keys, to, out, final, roots = [], [], [], [], []
        states = 0
        for base, _, payload in slices:
            part = unload(payload)
            keys.append(part["key"] + (states << 8))
            to.append(part["to"] + states)
            out.append(part["out"])
            final.append(part["final"])
            states += len(part["final"])
            roots.append((states - 1, base))
        self.root, self.base = np.array(roots, np.int64).reshape(-1, 2).T
        firsts = [np.frombuffer(first or b"\0", np.uint8) for _, first, _ in slices]
        self.first = np.concatenate([prefix(x, np.zeros(1, np.int64), np.array([len(x)])) for x in firsts]) if firsts else np.zeros(0, np.uint64)
        self.final = np.concatenate(final) if final else np.zeros(0, np.uint8)
        key, to_, out_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to, out))
        size = 1 << (2 * len(key) + 1).bit_length()
        self.mask = size - 1
        self.key, self.to, self.out = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        place, new = self._place(key), np.arange(len(key))
        while len(new):
            free = self.key[place] < 0
            self.key[place[free]] = key[new[free]]
            own = self.key[place] == key[new]
            self.to[place[own]], self.out[place[own]] = to_[new[own]], out_[new[own]]
            new, place = new[~own], (place[~own] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)

    def ordinals(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ordinal of each span, -1 for one that isn't a term."""
        found = np.full(len(start), -1, np.int64)
        if not len(self.root):
            return found
        slot = np.searchsorted(self.first, prefix(data, start, size), "right") - 1
        live = np.flatnonzero(slot >= 0)
        state, total, k = self.root[slot[live]], self.base[slot[live]], 0
        while len(live):
            ended = size[live] == k
            if ended.any():
                done = ended & (self.final[state] == 1)
                found[live[done]] = total[done]
                live, state, total = live[~ended], state[~ended], total[~ended]
            key = state << 8 | data[start[live] + k]
            place = self._place(key)
            there = self.key[place]
            while (off := np.flatnonzero((there != key) & (there >= 0))).size:
                place[off] = (place[off] + 1) & self.mask
                there[off] = self.key[place[off]]
            went = there == key
            live, place, total = live[went], place[went], total[went]
            state = self.to[place]
            total = total + self.out[place]
            k += 1
        return found

    def terms(self) -> Iterator[tuple[int, bytes]]:
        """(ordinal, term) in ascending order."""
        edges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, to in sorted((k, t) for k, t in zip(self.key.tolist(), self.to.tolist()) if k >= 0):
            edges[key >> 8].append((key & 255, to))
        for root, base in zip(self.root.tolist(), self.base.tolist()):
            left = [(root, b"")]
            while left:
                state, term = left.pop()
                if self.final[state]:
                    yield base, term
                    base += 1
                left.extend((to, term + bytes([byte])) for byte, to in reversed(edges[state]))


def dump(t: dict[str, np.ndarray]) -> bytes:
    parts = [pack(t[k]) for k in ("key", "to", "out", "final")]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unload(payload: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in ("key", "to", "out", "final"):
        n = int.from_bytes(payload[at : at + 4], "little")
        out[k] = unpack(payload[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def rows_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))


def kept_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term): the terms in at least so many rows of their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                keys = list(terms)
                for at in range(0, len(keys), 1 << 16):
                    some = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([terms[t] for t in some], pa.int64())], ["lang", "term", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                seen[lang].update(set(text.translate(FOLD).split()))
            if sum(map(len, seen.values())) >= ENTRIES:
                yield from out()
        yield from out()
        trim()

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def slices_of(kept: DataFrame, most: int = SLICE) -> DataFrame:
    """(slice, lang, base, first, n, payload): transducers of the terms, base ordinals of their language before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lang, held = TaskContext.get().partitionId() << 24, None, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([held[0]], pa.binary()), pa.array([len(held)], pa.int64()), pa.array([dump(build(held))], pa.binary())], ["slice", "lang", "first", "n", "payload"])
                number += 1
                held.clear()

        for batch in batches:
            for of, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != lang or (len(held) >= most and term[:8] != held[-1][:8]):
                    yield from out()
                    lang = of
                held.append(term)
        yield from out()

    start = F.substring("term", 1, 8)
    ranged = kept.repartitionByRange("lang", start).sortWithinPartitions("lang", "term")  # terms of one start stay together
    made = materialise(ranged.mapInArrow(run, "slice bigint, lang string, first binary, n bigint, payload binary"))
    earlier = W.partitionBy("lang").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice
    bases = made.select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return materialise(made.join(bases, "slice"))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of bytes other than spaces; the last byte is a space."""
    inside = np.concatenate([[False], data != 32])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return turn[::2], turn[1::2] - turn[::2]


def streamed(rows: DataFrame, slices: list[tuple[str, int, bytes, bytes]]) -> DataFrame:
    """(lang, source, ordinal, n) with every slice held by every task."""
    sent = rows.sparkSession.sparkContext.broadcast(slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list] = defaultdict(list)
        for lang, base, first, payload in sorted(sent.value):
            of[lang].append((base, first, payload))
        machines: dict[str, Transducers] = {}
        held: dict[str, list[tuple[str, bytes]]] = defaultdict(list)
        sizes: Counter = Counter()
        counts: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        entries = 0

        def through(lang: str) -> int:
            """Counts the terms held of a language."""
            docs = sorted(held.pop(lang), key=lambda d: d[0])
            sizes[lang] = 0
            if lang not in machines:
                machines[lang] = Transducers(of[lang])
            data = np.frombuffer(b"".join(t.translate(FOLD) + b" " for _, t in docs), np.uint8)
            ends = np.cumsum([len(t) + 1 for _, t in docs])
            start, size = spans(data)
            ordinal = np.concatenate([machines[lang].ordinals(data, start[a : a + (1 << 18)], size[a : a + (1 << 18)]) for a in range(0, len(start), 1 << 18)]) if len(start) else start
            cut, added = np.searchsorted(start, ends), 0
            for source, of_source in itertools.groupby(range(len(docs)), key=lambda k: docs[k][0]):
                numbers = list(of_source)
                mine = ordinal[cut[numbers[0] - 1] if numbers[0] else 0 : cut[numbers[-1]]]
                key, n = np.unique(mine[mine >= 0], return_counts=True)
                counts[lang, source].append((key, n))
                added += len(key)
            return added

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), parts in counts.items():
                key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, at, np.concatenate([c for _, c in parts]))
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([source] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "source", "ordinal", "n"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                held[lang].append((source, text))
                sizes[lang] += len(text)
                if sizes[lang] >= BLOCK:
                    entries += through(lang)
                    if entries >= 4 * ENTRIES:
                        yield from out()
                        entries = 0
        for lang in list(held):
            through(lang)
        yield from out()
        trim()

    got = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal bigint, n bigint")
    return got.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def sent_to_slices(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n) with each slice held by one task at a time: counted terms go where their slice is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in seen.items():
                keys = list(terms)
                for at in range(0, len(keys), 1 << 16):
                    some = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([terms[t] for t in some], pa.int64())], ["lang", "source", "term", "n"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                seen[lang, source].update(text.translate(FOLD).split())
            if sum(map(len, seen.values())) >= ENTRIES:
                yield from out()
        yield from out()

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            lang, source, term, n, base, first, payload = (batch.column(k) for k in range(1, 8))
            machines = set(np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False)).tolist())
            for a, b in itertools.pairwise(sorted({0, *machines, batch.num_rows})):
                if a in machines:  # before the terms of its slice
                    machine = Transducers([(base[a].as_py(), first[a].as_py(), payload[a].as_py())])
                    a += 1
                if a == b:
                    continue
                words = as_bytes(term.slice(a, b - a))
                data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
                size = np.array([len(w) for w in words], np.int64)
                got = machine.ordinals(data, np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size)
                yes = pa.array(np.flatnonzero(got >= 0))
                yield pa.RecordBatch.from_arrays([lang.slice(a, b - a).take(yes), source.slice(a, b - a).take(yes), pa.array(got[got >= 0]), n.slice(a, b - a).take(yes)], ["lang", "source", "ordinal", "n"])

    schema = "slice bigint, lang string, source string, term binary, n bigint"
    counted = rows.select("lang", "source", "text").mapInArrow(count, schema.partition(", ")[2]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    starts: dict[str, list[tuple[bytes, int]]] = defaultdict(list)
    for r in slices.select("lang", "first", "slice").toLocalIterator():  # one for each SLICE kept terms
        starts[r.lang].append((bytes(r.first)[:8].ljust(8, b"\0"), r.slice))
    starts = {lang: sorted(x) for lang, x in starts.items()}

    @F.arrow_udf("bigint")
    def slice_of(langs: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for lang, term in zip(langs.to_pylist(), as_bytes(terms)):
            at = np.searchsorted([s for s, _ in starts.get(lang, [])], term[:8].ljust(8, b"\0"), "right") if lang in starts else 0
            out.append(starts[lang][at - 1][1] if at else None)
        return pa.array(out, pa.int64())

    parts = counted.select(slice_of("lang", "term").alias("slice"), "lang", "source", "term", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("base", "bigint"), ("first", "binary"), ("payload", "binary")))).where("slice IS NOT NULL")
    machines = slices.select("slice", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("term", "binary"), ("n", "bigint"))), "base", "first", "payload")
    together = parts.unionByName(machines).repartition("slice").sortWithinPartitions("slice", F.col("payload").isNull())
    return together.mapInArrow(recount, "lang string, source string, ordinal bigint, n bigint")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total) for n up to total, by long division three digits at a time."""
    if total.size and int(total.max()) > 9 * 10**15:
        raise OverflowError("shares are exact up to 9e15 terms of a language")
    q, r = np.divmod(n, total)
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _block(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of a language's terms: partial sums of each pair of sources, first terms of each source."""
    lang, block = key[0].as_py(), key[1].as_py()
    first = groups.slice(0, 1).to_pylist()[0]
    vocabulary, width, of_lang = first["vocabulary"], first["width"], first["of_lang"]
    n = max(0, min(width, vocabulary - block * width))
    names, totals = groups["source"].to_pylist(), groups["total"].to_numpy()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names, totals = [names[i] for i in order], totals[order]
    at = {s: i for i, s in enumerate(names)}
    c = np.zeros((len(names), n), np.int64)
    if counts.num_rows:
        c[[at[s] for s in counts["source"].to_pylist()], counts["ordinal"].to_numpy() - block * width] = counts["n"].to_numpy()
    out: list[tuple] = []
    if n:
        p = shares(c + 2, (totals + 2 * vocabulary)[:, None])
        q = shares(c.sum(axis=0) + 2, np.array(of_lang + 2 * vocabulary))
    for i, name in enumerate(names):
        sums = divergence(p[i], p).sum(axis=1).tolist() if n else [0] * len(names)
        out.extend((lang, name, "pair", other, None, v) for k, (other, v) in enumerate(zip(names, sums)) if k != i)
        if n:
            mine = np.flatnonzero((c[i] > 0) & (p[i] > q))
            f = divergence(p[i][mine], q[mine])
            best = np.lexsort((mine, -f))[:TOP]
            out.extend((lang, name, "term", None, block * width + int(mine[k]), int(f[k])) for k in best)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _KINDS)], names=_NAMES) if out else pa.Table.from_arrays([pa.array([], t) for t in _KINDS], names=_NAMES)


_NAMES = ["lang", "source", "part", "other", "ordinal", "value"]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def audit(docs: DataFrame, least: int = LEAST, held: int = HELD, slice_terms: int = SLICE, cells: int = CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = rows_of(docs, text_col, lang_col, source_col)
    slices = slices_of(materialise(kept_terms(rows, least)), slice_terms)
    if (slices.agg(F.sum(F.length("payload")).alias("n")).first().n or 0) <= held:
        counts = streamed(rows, [(r.lang, r.base, bytes(r.first), bytes(r.payload)) for r in slices.collect()])  # held bytes at most
    else:
        counts = sent_to_slices(rows, slices)
    counts = materialise(counts)
    groups = rows.groupBy("lang", "source").count().drop("count").join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"), F.count("*").alias("sources"))
    langs = langs.join(slices.groupBy("lang").agg(F.sum("n").alias("vocabulary")), "lang", "left").fillna(0, ["vocabulary"])
    langs = langs.select("lang", "of_lang", "vocabulary", F.greatest(F.lit(1), F.least(F.lit(cells), F.floor(F.lit(cells) / F.col("sources")))).alias("width"))
    langs = materialise(langs)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("vocabulary") / F.col("width")) - 1, F.lit(0)).cast("long"))).alias("block")
    right = groups.join(langs, "lang").select("lang", blocks, "source", "total", "of_lang", "vocabulary", "width")
    left = counts.join(langs.select("lang", "width"), "lang").select("lang", F.floor(F.col("ordinal") / F.col("width")).alias("block"), "source", "ordinal", "n")
    found = materialise(left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, other string, ordinal bigint, value bigint"))
    group = W.partitionBy("lang", "source")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= TOP)
    named = top.join(terms_of(slices), ["lang", "ordinal"]).select("lang", "source", "part", F.col("term").alias("item"), "value", "rank")
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(named)


def terms_of(slices: DataFrame) -> DataFrame:
    """(lang, ordinal, term) of all kept terms, read off the transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ordinal, term = zip(*Transducers([(r["base"], r["first"], r["payload"])]).terms())
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(term), pa.string()), pa.array(ordinal, pa.int64()), pa.array([t.decode() for t in term], pa.string())], ["lang", "ordinal", "term"])

    return slices.select("lang", "base", "first", "payload").mapInArrow(run, "lang string, ordinal bigint, term string")
