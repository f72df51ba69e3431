"""Packing, filter audit and source audit against plain second ways, over a small table, odd texts and planted groups."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pyrocell.llm import filter_audit, packing, queries, source_audit

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "it's I'LL WE'VE <|endoftext|> x<|startoftext|>y", "é́ é ΑΣ ΟΔΟΣ İ    x\x1cy\x85z 日本語 🙂", "word " * 9000, "x" * 30_000, "A" * 3 + "\n" * 9 + "é" * 5000, "#", "one two one two",
    "one two one two", "́start", "Z\x00z Zz-zZ_\x7fq", "tab\tnew\nline\x0bform\x0cfeed\rreturn",
]
PATH = public_tokenizers.path(queries.WORD_TOKENIZER)


def odd(spark):
    """Repeated ids, null keys, and columns whose names the operators use themselves."""
    rows = [(i if i != 11 else 10, t, None if i % 3 == 0 else "en", "" if i % 4 == 0 else "web", 7, 7, "p", 0.5, 3) for i, t in enumerate(ODD)]
    rows += [(None, "one two one two", None, None, 7, 7, "p", 0.5, 3)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, n_words int, part string, failed double, term int")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(pieces, documents, capacity, n_partitions, repeated=()):
    """Every id once, sequences without gap or padding, of one length but for the last few of a partition."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.length == len(r.ids) // 4 > 0
        if r.doc_id not in repeated:
            of_doc[r.doc_id, r.doc_tokens].append(r)
        of_sequence[r.sequence_id].append(r)
    whole = Counter()
    for (doc_id, _), rows in of_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == list(itertools.accumulate([0, *(r.length for r in rows[:-1])]))
        whole[doc_id, b"".join(bytes(r.ids) for r in rows)] += 1
    assert whole == Counter((i, np.array(ids, "<u4").tobytes()) for i, ids in documents if i not in repeated)
    short = 0
    for rows in of_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *(r.length for r in rows[:-1])]))
        n = sum(r.length for r in rows)
        assert n == capacity or n.bit_count() == 1
        short += n != capacity
    assert short <= capacity.bit_length() * n_partitions


def test_packing_keeps_every_id_and_pads_nothing(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    rows = docs.collect()
    for n, held in ((1, packing.HELD), (3, 9000)):
        pieces = packing.pack(docs.repartition(n), PATH, held=held).collect()
        check_packing(pieces, [(r.doc_id, library(r.text)) for r in rows], packing.CAPACITY, n)


def test_packing_of_odd_tables(spark, library):
    docs = odd(spark)
    pieces = packing.pack(docs.coalesce(1), PATH, capacity=64).collect()
    check_packing(pieces, [(r.doc_id, library(r.text)) for r in docs.collect()], 64, 1, repeated=(10, None))
    assert sum(r.length for r in pieces) == sum(len(library(r.text)) for r in docs.collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_the_query_packs_the_whole_table(spark, library):
    got = queries.op11_bin_slack_packing(spark, SMALL).collect()
    texts = {r.doc_id: library(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    covered = defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].extend(range(r.start, r.start + r.length))
    assert {i: sorted(x) for i, x in covered.items()} == {i: list(range(len(x))) for i, x in texts.items()}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 3), max_size=5), st.integers(0, 70))
def test_the_closest_multiset_is_the_best_of_all(pool, target):
    chosen = packing.closest(pool, target)
    assert all(0 < n <= pool[x] for x, n in chosen.items())
    every = [sum(x * n for x, n in zip(pool, ns)) for ns in itertools.product(*(range(n + 1) for n in pool.values()))]
    assert sum(x * n for x, n in chosen.items()) == max(s for s in every if s <= target)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_packer_fills_windows_from_any_lengths(lengths):
    packer = packing.Packer(64)
    for doc, n in enumerate(lengths):
        packer.add(doc, 0, n)
    made = [*packer.exact(), *packer.cut(True)]
    sums = [sum(n for _, _, n in s) for s in made]
    assert sum(sums) == sum(lengths) and sums.count(64) == sum(lengths) // 64
    seen = Counter((doc, i) for s in made for doc, start, n in s for i in range(start, start + n))
    assert seen == Counter((doc, i) for doc, n in enumerate(lengths) for i in range(n))


def plain_counts(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    s = text.decode()
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in s), len(s), sum(c in "#$%&*|" for c in s)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB #\n\té日🙂|"), max_size=40), max_size=8), st.sampled_from([1, 3, 16, 1 << 20]))
def test_one_pass_counts_what_patterns_count(texts, block):
    raw = [t.encode() for t in texts]
    assert filter_audit.counts(raw, block).tolist() == [plain_counts(t) for t in raw]


def test_words_of_one_hash_stay_two(monkeypatch):
    monkeypatch.setattr(filter_audit.Spans, "_hash", lambda self, start, size, owner: np.full(len(start), 5, np.uint64))
    raw = [("a b longer-than-eight longer-than-eighT a " * 3).encode(), b"a a b"]
    assert filter_audit.counts(raw).tolist() == [plain_counts(t) for t in raw]


def same_as(con, sql, df):
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(got, key=str) == sorted(q.fetchall(), key=str)


def tables(docs, labels=None):
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "lang", "source").toPandas())
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM d")
    if labels is not None:
        con.register("labels", labels.toPandas())
    return con


def planted(spark):
    """Copies across parts and labels, ties, and a text that a third of all rows hold."""
    rows = [(i, ["same text here", "Other #1", "CAPS AND CAPS", "w " * 250, " ".join(map(str, range(260)))][i % 5 if i % 3 else 0], "en" if i % 2 else "fr", f"s{i % 4}" if i % 7 else None) for i in range(240)]
    rows += [(3, "same text here", "en", "s3"), (0, "same text here", "fr", None), (0, "same text here", "fr", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_filter_audit_of_odd_and_planted_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)] + [(3, 0, 1), (6, None, None), (6, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd(spark), planted(spark), planted(spark).limit(0)):
        same_as(tables(docs, labels), queries.filters_sql(), filter_audit.audit(docs, labels))


def test_filter_audit_without_labels(spark):
    got = filter_audit.audit(planted(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.good_lost + r.toxic_lost for r in got} == {0} and len(got) == 5 * 120 * 5


@pytest.mark.parametrize("way", [{}, {"held": 0, "slice_terms": 3}, {"held": 0}, {"cells": 8}])
def test_source_audit_of_odd_and_planted_tables(spark, way):
    for docs in (planted(spark), odd(spark), planted(spark).limit(0)):
        same_as(tables(docs), queries.sources_sql(), source_audit.audit(docs, **way))


def test_source_audit_by_slices_equals_the_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same_as(tables(docs), queries.sources_sql(), source_audit.audit(docs, held=0, slice_terms=40, cells=2000))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=12).filter(lambda b: b" " not in b), max_size=40), st.lists(st.binary(min_size=1, max_size=12).filter(lambda b: b" " not in b), max_size=20), st.integers(1, 9))
def test_transducers_number_terms_in_byte_order(terms, others, most):
    ordered = sorted(terms)
    parts, slices = [], []
    for t in ordered:
        if not parts or (len(parts[-1]) >= most and t[:8] != parts[-1][-1][:8]):
            parts.append([])
        parts[-1].append(t)
    base = 0
    for p in parts:
        slices.append((base, p[0], source_audit.dump(source_audit.build(p))))
        base += len(p)
    machine = source_audit.Transducers(slices)
    asked = ordered + [o for o in others] + [t + b"x" for t in ordered] + [t[:-1] for t in ordered if len(t) > 1]
    data = np.frombuffer(b" ".join([*asked, b""]), np.uint8)
    size = np.array([len(a) for a in asked], np.int64)
    got = machine.ordinals(data, np.cumsum(size + 1) - size - 1, size)
    number = {t: i for i, t in enumerate(ordered)}
    assert got.tolist() == [number.get(a, -1) for a in asked]
    assert [x for s in slices for x in source_audit.Transducers([s]).terms()] == list(enumerate(ordered))


def test_the_transducer_is_minimal():
    t = source_audit.build([b"tap", b"taps", b"top", b"tops"])
    assert len(t["final"]) == 5 and len(t["key"]) == 5  # t, a or o, p, s: one state for both middles and one for both ends


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**15, 400)
    n = (total * rng.random(400)).astype(np.int64)
    assert source_audit.shares(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]
    with pytest.raises(OverflowError):
        source_audit.shares(np.array([1]), np.array([10**16]))
