"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints. Word shingles (repeats included) hash to 64 bits by XXH64, seed 42; a bit of the fingerprint is
1 if it is set in over half the hashes. Fewer words than a shingle: the whole sequence is the one shingle.
No word (null, empty or white space): fingerprint zero, which links like any other.

Links. Distinct fingerprints fall into tiles by the population counts of their ``parts`` equal bit fields.
Two fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of those counts, so a tile
meets only the tiles within that distance: no link is lost and the other tile pairs are skipped. Tiles are cut
into blocks of bounded size and block pairs are compared by numpy exclusive-or and bit counts. Copies collapse
to one fingerprint first, and within a block pair only a spanning forest of the sure links leaves the task, so
a group of n copies or near copies gives n links, not n squared.

Groups. Connected components: tasks contract the links they hold, then large-star and small-star rounds, each
written to the shared folder, join the rest.

Ties and repeated ids: every row gets its own output row. A null id never becomes the name of a group; a group
of null ids alone has a null component_id. Extra columns are ignored, whatever their names; an empty table gives no rows.
Very long texts are hashed whole, their bits summed in bounded pieces.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocell.llm.common import discard, materialise, recording, texts_of, trim
from pyrocell.llm.substring_dedup import FACTORS, mix
from pyrocell.operators.components import components

SEED = 42
#: Near copies: minwise bands, minima of each, nodes of a block, and up to how many a tile's pairs are listed at once.
BANDS, ROWS, BLOCK, SMALL = 12, 3, 1024, 24
HOT = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words joined by a space; of the whole sequence if it is shorter; none if empty."""
    h, seed = xxhash.xxh64_intdigest, SEED
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    if k == 3:
        return np.array([h(b"%b %b %b" % x, seed) for x in zip(words, words[1:], words[2:])], np.uint64)
    return np.array([h(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(k)))], np.uint64)


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """As a signed 64-bit integer."""
    h = shingle_hashes((text or b"").lower().split(), k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory on very long texts
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h)).view(np.int64)[0])


def fingerprint_column(text: Column, k: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, k) for t in texts_of(texts)], pa.int64())

    return of(text)


def _near(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the tile offsets within radius, the zero offset first."""
    all_ = itertools.product(range(-radius, radius + 1), repeat=parts)
    zero = (0,) * parts
    return [zero, *(o for o in all_ if sum(map(abs, o)) <= radius and o > zero)]


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Rows of pairs that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(pairs), bool)
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            keep[i] = True
    return keep


def compare(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) that differ in at most radius bits, with the distance."""
    for i in range(0, len(a), rows):
        d = np.bitwise_count(a[i : i + rows, None] ^ b[None, :])
        x, y = np.nonzero(d <= radius)
        if len(x):
            yield x + i, y, d[x, y]


def block_pairs(fps: DataFrame, radius: int, parts: int, block: int) -> DataFrame:
    """Pairs of blocks (fps_a, fps_b: arrays of fp, same: is it one block?) that may hold fingerprints within radius."""
    width = 64 // parts
    base = width + 1
    field = lambda i: F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) if parts > 1 else F.col("fp"))
    tiled = fps.withColumns({f"p{i}": field(i) for i in range(parts)})
    code = lambda cols: sum((c.cast("long") * base**i for i, c in enumerate(cols)), F.lit(0).cast("long"))
    tiled = tiled.withColumn("tile", code([F.col(f"p{i}") for i in range(parts)]))
    # one row per tile: at most base ** parts (83,521 for four parts), so it may be broadcast
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")
        .withColumn("blk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block)).cast("int"))
        .groupBy("tile", *(f"p{i}" for i in range(parts)), "blk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialise(blocks)
    other = _moved(blocks, parts, radius, base)
    return (
        blocks.select("tile", F.col("blk").alias("blk_a"), F.col("fps").alias("fps_a"))
        .join(other, "tile")
        .where((F.col("tile") != F.col("from")) | (F.col("blk_a") <= F.col("blk_b")))
        .select("fps_a", "fps_b", ((F.col("tile") == F.col("from")) & (F.col("blk_a") == F.col("blk_b"))).alias("same"))
    )


def links(fps: DataFrame, radius: int = 2, parts: int = 4, block: int = 512) -> DataFrame:
    """Links (a, b), a and b distinct fingerprints, over a column ``fp`` of distinct fingerprints: of each block
    pair a spanning forest of its links, which joins the same fingerprints as all of them."""
    pairs = block_pairs(fps, radius, parts, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for row in range(batch.num_rows):
                a = batch.column(0)[row].values.to_numpy().view(np.uint64)
                b = batch.column(1)[row].values.to_numpy().view(np.uint64)
                same = batch.column(2)[row].as_py()
                found = [*compare(a, b, radius)]
                if not found:
                    continue
                x, y = (np.concatenate(z) for z in list(zip(*found))[:2])
                if same:
                    x, y = x[x < y], y[x < y]
                ends = np.stack([x, y if same else y + len(a)], 1)
                x, y = ends[_forest(ends, len(a) + len(b))].T
                both = a if same else np.concatenate([a, b])
                xs.append(both[x]), ys.append(both[y])
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (xs, ys)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs x < y inside each of many short runs."""
    xs, ys = [], []
    for size in np.unique(sizes):
        x, y = np.triu_indices(int(size), 1)
        at = starts[sizes == size]
        xs.append((at[:, None] + x).ravel()), ys.append((at[:, None] + y).ravel())
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tile_pairs(fp: np.ndarray, rows: np.ndarray, others: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within radius inside ``rows``, or between rows and others: both are put in order of population
    count and only the stretch of counts within the radius is compared."""
    count = np.bitwise_count(fp).astype(np.int64)
    a = rows[np.argsort(count[rows], kind="stable")]
    b = a if others is None else others[np.argsort(count[others], kind="stable")]
    high = count[b]
    for i in range(0, len(a), 128):
        part = a[i : i + 128]
        lo = np.searchsorted(high, count[part[0]] - radius, "left")
        hi = np.searchsorted(high, count[part[-1]] + radius, "right")
        for x, y, _ in compare(fp[part], fp[b[lo:hi]], radius):
            if others is None:
                at = i + x < lo + y
                x, y = x[at], y[at]
            yield part[x], b[lo + y]


def _shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two texts share at most, by the 16-bit pieces of their hashes (sorted, repeats included)."""
    keys = []
    for x in (a, b):
        n = np.arange(len(x)) - np.searchsorted(x, x)  # the how-manieth of its value
        keys.append((x.astype(np.int64) << 32) | n)
    return len(np.intersect1d(*keys, assume_unique=True))


def tile_links(tiles: DataFrame, radius: int, wide: int, least: float) -> DataFrame:
    """Links (a, b), a below b, inside the tiles (nodes: array of (side, key, fp, w1, w2, w3, pieces, grp, refused)).

    A link joins nodes of different groups whose fp differs in at most ``radius`` bits, whose four words together
    differ in at most ``wide``, that haven't refused each other, and whose shingles' 16-bit ``pieces`` leave it possible that
    they share ``least`` of them. With two sides only links across count. Of a tile's links those of the
    spanning forest of its groups with the fewest bits are returned: a tile of n nodes gives n - 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("nodes")
            ends = lists.offsets.to_numpy().astype(np.int64)
            items = lists.values
            side, key, grp = (items.field(f).to_numpy() for f in ("side", "key", "grp"))
            words = np.stack([items.field(f).to_numpy() for f in ("fp", "w1", "w2", "w3")], 1).view(np.uint64)
            pieces, refused = items.field("pieces"), items.field("refused")
            starts, sizes = ends[:-1], np.diff(ends)
            size = pc.binary_length(pieces).to_numpy().astype(np.int64) // 2
            of = functools.lru_cache(4096)(lambda i: np.frombuffer(pieces[i].as_py(), "<u2"))

            def possible(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Of the pairs those that may be links, by what array operations can tell."""
                small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                at = (grp[x] != grp[y]) & (small >= least * large)
                x, y = x[at], y[at]
                apart = np.bitwise_count(words[x] ^ words[y])
                d = apart.sum(1, dtype=np.int64)
                at = (apart[:, 0] <= radius) & (d <= wide)
                x, y, d = x[at], y[at], d[at]
                ok = np.ones(len(x), bool)
                for i in range(0, len(x), 1 << 13):
                    z = slice(i, i + (1 << 13))
                    used, where = np.unique(np.concatenate([x[z], y[z]]), return_inverse=True)
                    value = np.concatenate([of(k) for k in used.tolist()])
                    table = np.bincount(np.repeat(np.arange(len(used)) << 8, size[used]) + (value >> 8), minlength=len(used) << 8).reshape(-1, 256).astype(np.int32)
                    half = len(where) // 2
                    most = np.minimum(table[where[:half]], table[where[half:]]).sum(1)
                    ok[z] = most >= least * (size[x[z]] + size[y[z]] - most)
                return x[ok], y[ok], d[ok]

            out = []

            def forest(x: np.ndarray, y: np.ndarray, d: np.ndarray, tile: np.ndarray) -> None:
                parent: dict[tuple[int, int], tuple[int, int]] = {}

                def root(n: tuple[int, int]) -> tuple[int, int]:
                    while (up := parent.get(n, n)) != n:
                        parent[n] = parent.get(up, up)
                        n = up
                    return n

                tie = mix((key[x] ^ key[y]).view(np.uint64), FACTORS[1])  # the same order in every band
                by = np.lexsort((tie, d))
                for i, j, t in zip(x[by].tolist(), y[by].tolist(), tile[by].tolist()):
                    a, b = root((t, int(grp[i]))), root((t, int(grp[j])))
                    if a == b or int(key[j]) in (refused[i].as_py() or ()) or int(key[i]) in (refused[j].as_py() or ()):
                        continue
                    most = _shared_at_most(of(i), of(j))
                    if most >= least * (size[i] + size[j] - most):
                        parent[a] = b
                        out.append((min(key[i], key[j]), max(key[i], key[j])))

            small = np.flatnonzero(sizes <= SMALL)
            for i in range(0, len(small), 1 << 12):
                which = small[i : i + (1 << 12)]
                x, y = _pairs_within(starts[which], sizes[which])
                owner = which[np.searchsorted(starts[which], x, "right") - 1]
                sided = np.zeros(len(sizes), bool)
                sided[owner[side[x] != side[y]]] = True
                at = (side[x] != side[y]) | ~sided[owner]
                x, y, d = possible(x[at], y[at])
                forest(x, y, d, which[np.searchsorted(starts[which], x, "right") - 1])
            for t in np.flatnonzero(sizes > SMALL).tolist():
                rows = np.arange(starts[t], ends[t + 1])
                left = side[rows] == side[rows].min()
                found = [possible(x, y) for x, y in (_tile_pairs(words[:, 0], rows, None, radius) if left.all() else _tile_pairs(words[:, 0], rows[left], rows[~left], radius))]
                if found:
                    x, y, d = (np.concatenate(z) for z in zip(*found))
                    forest(x, y, d, np.full(len(x), t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out)], ["a", "b"])
        trim()

    return tiles.select("nodes").mapInArrow(run, "a bigint, b bigint")


def banded(nodes: DataFrame) -> DataFrame:
    """(band, n, key) for each band that two nodes or more share; n: how many."""
    rows = nodes.select("key", F.explode("bands").alias("band"))
    return rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows (tile, and those of ``tile_links``) gathered to tiles that hold two groups."""
    node = F.struct(F.col("blk").alias("side"), "key", "fp", "w1", "w2", "w3", "pieces", "grp", "refused")
    return rows.groupBy("tile").agg(F.collect_list(node).alias("nodes"), F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 <> g2").select("nodes")


def first_tiles(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """Every band's blocks, each alone; a node is a group."""
    blk = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int")
    rows = shared.join(sketches, "key").withColumns({"grp": F.col("key"), "blk": blk, "refused": F.lit(None).cast("array<bigint>")})
    return _tiled(rows.withColumn("tile", F.xxhash64("band", "blk")))


def later_tiles(shared: DataFrame, sketches: DataFrame, grouped: DataFrame, refused: DataFrame) -> DataFrame:
    """All pairs of blocks of the bands that hold two groups. A band's largest group is in blocks of its own, which don't
    meet each other: n nodes of one group and m others make n + m + n m / BLOCK rows, not n squared. A node goes
    to each tile of its block, so a tile is bounded and no join makes the pairs."""
    labelled = materialise(shared.drop("n").join(grouped, "key"))
    sizes = labelled.groupBy("band", "grp").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("grp", "k").alias("major")).where("most < n")
    cut, h = F.col("n") > BLOCK, F.xxhash64("key")
    counts = {"own": F.when(cut, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int"), "rest": F.when(cut, F.ceil((F.col("n") - F.col("most")) / BLOCK)).otherwise(1).cast("int"), "of_major": cut & (F.col("grp") == F.col("major"))}
    blk = F.when(F.col("of_major"), F.pmod(h, F.greatest("own", F.lit(1)))).otherwise(F.col("own") + F.pmod(h, "rest")).cast("int")
    met = F.explode(F.sequence(F.when(F.col("of_major"), F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1))
    rows = labelled.join(sizes, "band").withColumns(counts).withColumn("blk", blk)
    pairs = refused.groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("refused"))
    rows = rows.join(sketches, "key").join(pairs, "key", "left").select("*", met.alias("met"))
    return _tiled(rows.withColumn("tile", F.xxhash64("band", F.least("blk", "met"), F.greatest("blk", "met"))))


def _moved(blocks: DataFrame, parts: int, radius: int, base: int) -> DataFrame:
    """Each block once for every tile it must meet, itself included."""
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(o))) for o in _near(parts, radius)))
    out = blocks.select("fps", "blk", "tile", *(f"p{i}" for i in range(parts)), F.explode(steps).alias("o"))
    inside = F.lit(True)
    move = F.lit(0).cast("long")
    for i in range(parts):
        there = F.col(f"p{i}") + F.col(f"o.d{i}")
        inside = inside & there.between(0, base - 1)
        move = move + F.col(f"o.d{i}").cast("long") * base**i
    return out.where(inside).select((F.col("tile") + move).alias("tile"), F.col("tile").alias("from"), F.col("blk").alias("blk_b"), F.col("fps").alias("fps_b"))


def near_duplicates(docs: DataFrame, radius: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable through links."""
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), k).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    groups = components(links(nodes.select("fp"), radius).select("a", "b"))
    named = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = materialise(named)
    # only groups of two or more fingerprints need a second look: few rows, joined back by fingerprint
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = materialise(named.select("fp", "root", "n").join(lows, "root").select("fp", "n", "component_id"))
    # a fingerprint of over 1 / HOT of all rows would be one hot key: there are under HOT of them, so they are broadcast
    often = F.col("n") * HOT > rows.count()
    common = F.broadcast(labels.where(often).select("fp", "component_id"))
    others = rows.join(common, "fp", "left_anti").join(labels.where(~often).select("fp", "component_id"), "fp")
    return rows.join(common, "fp").unionByName(others).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def set_sketch(h: np.ndarray) -> tuple[int, int, int, int, int]:
    """(key, fp, w1, w2, w3) of shingle hashes as a set: XXH64 of the sorted set, equal for equal sets, and a SimHash
    of 256 bits, whose first 64 are ``fp``."""
    h = np.unique(h)
    ones = np.zeros(256, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory on very long texts
        x = h[i : i + (1 << 14)]
        more = [mix(x ^ np.uint64(w << 32), FACTORS[0]) for w in (1, 2, 3)]
        ones += np.unpackbits(np.stack([x, *more], 1).view(np.uint8).reshape(-1, 32), axis=1).sum(0, dtype=np.uint16)
    return (xxhash.xxh64_intdigest(h.tobytes(), SEED), *np.packbits(ones * 2 > len(h)).view(np.uint64).tolist())


#: Odd multipliers of the minwise permutations, from a fixed seed.
PERMUTATIONS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def minwise_bands(h: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS minima of permuted shingle hashes: two sets of similarity s share a given one with
    probability s ** ROWS."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    x = h ^ (h >> np.uint64(31))
    for i in range(0, len(h), 1 << 11):
        np.minimum(low, (PERMUTATIONS[:, None] * x[None, i : i + (1 << 11)]).min(1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for m in low.reshape(BANDS, ROWS).T:
        out = mix(out ^ m, FACTORS[0])
    return out


def set_sketch_column(text: Column, k: int) -> Column:
    @F.arrow_udf("struct<key:bigint,fp:bigint,w1:bigint,w2:bigint,w3:bigint,bands:array<bigint>>")
    def of(rows: pa.Array) -> pa.Array:
        sketch, bands = np.zeros((len(rows), 5), np.uint64), np.zeros((len(rows), BANDS), np.uint64)
        for i, t in enumerate(texts_of(rows)):
            h = np.unique(shingle_hashes(t.lower().split(), k))
            sketch[i], bands[i] = set_sketch(h), minwise_bands(h)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
        columns = [pa.array(np.ascontiguousarray(c)) for c in sketch.view(np.int64).T]
        trim()
        columns.append(pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel())))
        return pa.StructArray.from_arrays(columns, ["key", "fp", "w1", "w2", "w3", "bands"])

    return of(text)


def radius_of(similarity: float, bits: int, deviations: float) -> int:
    """How many of ``bits`` SimHash bits sets of this Jaccard similarity differ in at most, that many standard
    deviations above the mean. The cosine of two sets is least if they are of one size: 2 s / (1 + s)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def shingle_sets(text: Column, k: int) -> Column:
    """s: the distinct k-word shingle hashes of a text, sorted, as bytes; pieces: 16 bits of each, sorted."""

    @F.arrow_udf("struct<s:binary,pieces:binary>")
    def of(rows: pa.Array) -> pa.Array:
        sets, pieces = [], []
        for t in texts_of(rows):
            h = np.unique(shingle_hashes(t.lower().split(), k))
            sets.append(h.tobytes())
            pieces.append(np.sort((h & np.uint64(0xFFFF)).astype("<u2")).tobytes())
        trim()
        return pa.StructArray.from_arrays([pa.array(sets, pa.binary()), pa.array(pieces, pa.binary())], ["s", "pieces"])

    return of(text)


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, near): do the sets (key, s) of a pair share at least ``least`` of their shingles?"""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    return joined.select("a", "b", (jaccard(F.col("sa"), F.col("sb")) >= least).alias("near"))


def picked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose ``row`` (0 or above) is among the chosen ones. Of ``chosen`` a bit a row is broadcast, 4 KB for each 32,768
    numbers that are in use, so rows with their texts stay where they are read and none is shuffled."""
    bucket, at = F.bitmap_bucket_number(F.col("row") + 1), F.bitmap_bit_position(F.col("row") + 1)
    bits = chosen.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))) > 0
    return rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").where(found).drop("bucket", "bits")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one of least id (null first; ties: the first read); all columns of docs.

    Texts are near copies if they share ``similarity`` of their five-word shingles. Texts of equal shingle sets are
    one node, named by a hash of the set; no other texts are joined unverified. Texts without words are one group.

    Tiles. Comparing all nodes with all would grow with the square of the corpus, as radii this wide rule out few
    population counts. So nodes are tiled by BANDS minwise hashes of ROWS values first: a pair at similarity 0.8 shares
    none with probability (1 - 0.8 ** 3) ** 12 = 0.0002. Inside a tile, fingerprints are compared exactly:
    candidates differ in at most 22 of 64 and 72 of 256 bits of a SimHash of the set (at the limit a bit differs with
    probability 0.15, so these are 4.5 and six standard deviations above the mean), where the population counts are
    within the radius. A tile is at most two blocks of about BLOCK nodes; a band of more nodes is cut into block pairs.

    Rounds. Each tile proposes the spanning forest of its candidate links, 16 bits of each shingle's hash deciding which
    pairs may share enough; so a band of n nodes gives n - 1 links at most. Those are verified on the whole shingle sets.
    Accepted links merge groups; refused ones (16 bits agreed by chance) aren't proposed again. The first round takes
    blocks alone, the next ones the block pairs of bands that hold two groups. The last round is the one that refused
    nothing: then no candidate joins two final groups. A band whose nodes are one group costs nothing more.
    """
    spark, tables = docs.sparkSession, []
    # the row is one struct column: names of docs can't clash with those used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows.select("*", set_sketch_column(F.col(f"doc.`{text_col}`"), shingle).alias("set")))
    radius, wide = radius_of(similarity, 64, 4.5), radius_of(similarity, 256, 6)
    with recording(tables):
        low = F.min(F.struct(F.col(f"doc.`{id_col}`").alias("id"), "row")).alias("low")
        nodes = materialise(rows.groupBy("set.key").agg(low, F.first("set").alias("set")).select("set.*", "low"))
        shared = materialise(banded(nodes))
        wanted = nodes.join(shared.select("key").distinct(), "key", "left_semi").select("low.row")
        sets = picked(rows, wanted).withColumn("sets", shingle_sets(F.col(f"doc.`{text_col}`"), shingle))
        sets = materialise(sets.select(*(f"set.{c}" for c in ("key", "fp", "w1", "w2", "w3")), "sets.*"))
        sketches, tried = sets.drop("s"), None
        grouped = sets.select("key", F.col("key").alias("grp"))
        while True:
            refused = None if tried is None else tried.where("NOT near")
            tiles = first_tiles(shared, sketches) if tried is None else later_tiles(shared, sketches, grouped, refused)
            verdicts = materialise(verify(tile_links(tiles, radius, wide, similarity).distinct(), sets, similarity))
            grouped = _regroup(grouped, verdicts.where("near"))
            if tried is not None and verdicts.where("NOT near").isEmpty():
                break
            tried = verdicts if tried is None else tried.union(verdicts)
        heads = nodes.join(grouped, "key", "left").groupBy(F.coalesce("grp", "key").alias("grp")).agg(F.min("low").alias("low"))
    heads = materialise(heads.select(F.col("low.row").alias("row")))
    discard(spark, tables)
    return picked(rows, heads).select("doc.*")


def _regroup(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """``grouped`` (key, grp) with the groups merged that edges (a, b) of nodes join."""
    ga, gb = (grouped.select(F.col("key").alias(c), F.col("grp").alias(f"g{c}")) for c in "ab")
    between = edges.select("a", "b").join(ga, "a").join(gb, "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    merged = components(between).select(F.col("node").alias("grp"), "root")
    return materialise(grouped.join(merged, "grp", "left").select("key", F.coalesce("root", "grp").alias("grp")))
