"""The models' results over a whole small table against plain Python that follows the docstrings' formulas."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from pyrocell.llm import quality_rules, queries, token_files, zstd_quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def discount(counts):
    """Good-Turing ratios of the counts 1 to 5 where they lie between 0 and 1, else what absolute discounting leaves."""
    n = Counter(min(c, 7) for c in counts if c)
    tail = 6 * n[6] / n[1]
    ratios = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0 for r in range(1, 6)]
    if not all(0 < x < 1 for x in ratios):
        give = min(n[1] / (n[1] + 2 * n[2]), 0.99)
        ratios = [(r - give) / r for r in range(1, 6)]
    return lambda c: ratios[c - 1] if c <= 5 else 1.0


def test_katz_scores(spark, docs):
    tokens = {r.doc_id: [w.lower() for w in (r.text or "").encode().split()] + ["END"] for r in docs}
    train = [t for i, t in tokens.items() if remainder(i, 7) != 2]
    uni, pair = Counter(w for t in train for w in t), Counter((a, b) for t in train for a, b in zip(["START", *t], t))
    total, d1, d2 = uni.total(), discount(uni.values()), discount(pair.values())
    history = Counter(a for t in train for a in ["START", *t[:-1]])
    history["END"] = uni["END"]
    p = {w: d1(c) * c / total for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    spent, known = defaultdict(float), defaultdict(float)
    for (a, b), c in pair.items():
        spent[a] += d2(c) * c / (uni[a] if a != "START" else history[a])
        known[a] += p[b]

    def prob(a, b):
        if a != "START" and a not in uni:
            return p.get(b, unknown)
        of = uni[a] if a != "START" else history[a]
        none_left = 1 - spent[a] < 1e-12  # then seen pairs give up a share of one in c(h) + 1
        if c := pair.get((a, b)):
            return d2(c) * c / of * (of / (of + 1) if none_left else 1)
        return (1 / (of + 1) if none_left else 1 - spent[a]) / (1 - known[a]) * p.get(b, unknown)

    for r in queries.op6_katz_scores(spark, SMALL).collect():
        t = tokens[r.doc_id]
        assert r.held_out == (remainder(r.doc_id, 7) == 2) and r.train_tokens == total and r.n_known == sum(w in uni for w in t)
        assert r.score == pytest.approx(sum(math.log10(prob(a, b)) for a, b in zip(["START", *t], t)), rel=1e-5)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t), rel=1e-9)
    for a in [*list(uni)[:40], "START"]:  # each history's probabilities add up to one
        if history[a] == (uni[a] if a != "START" else history[a]):
            assert sum(prob(a, b) for b in uni) + prob(a, "a word never seen") == pytest.approx(1)


def test_kept_by_quality_rules(spark, docs):
    gamma = (1 + quality_rules.ERROR) / (1 - quality_rules.ERROR)
    rows = {}
    for r in docs:
        n, chars, symbols, dup, rep = quality_rules.counts((r.text or "").encode())
        values = (symbols / chars, dup / ((r.text or "").count("\n") + 1), rep / n, chars / n) if n else None
        rows[r.doc_id] = (r.lang, r.source, n < 50 or 100 * rep > 50 * n, values)
    bucket = lambda v: -100000 if v <= 1e-6 else math.ceil(math.log(v) / math.log(gamma) - 1e-12)
    value = lambda b: 0.0 if b == -100000 else 2 * gamma**b / (gamma + 1)
    fine = [(lang, source, v) for lang, source, failed, v in rows.values() if not failed]

    def limits(lang, source, k):
        for group in ([v for a, b, v in fine if (a, b) == (lang, source)], [v for a, _, v in fine if a == lang], [v for _, _, v in fine]):
            if len(group) >= quality_rules.MIN_ROWS or len(group) == len(fine):
                break
        ordered = sorted(bucket(v[k]) for v in group)
        at = lambda q: value(ordered[math.floor(q * (len(ordered) - 1))])
        slack = (0.02, 0.02, 0.02, 1.0)[k]
        half = 6 * max(at(0.5) - at(0.25), at(0.75) - at(0.5)) if k == 3 else 3 * (at(0.9) - at(0.5))
        return (at(0.5) - half - slack if k == 3 else -math.inf), at(0.5) + half + slack

    wrong = 0
    for r in queries.op5_quality_rules(spark, SMALL).collect():
        lang, source, failed, v = rows[r.doc_id]
        assert r.base_failed == failed
        if failed:
            assert not r.kept
            continue
        inside = [lo <= x <= hi for x, (lo, hi) in zip(v, (limits(lang, source, k) for k in range(4)))]
        wrong += r.kept != all(inside)
    assert wrong == 0


def test_quality_scores_follow_the_difference_of_sizes(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = labels.where(quality_rules.F.col("quality").isNotNull()).selectExpr("doc_id AS id", "quality AS label").where("crc32(CAST(CAST(id AS STRING) AS BINARY)) % 5 <> 0")
    model = zstd_quality.train(table.selectExpr("doc_id AS id", "text"), seen)
    pair = []
    for d in (model.good, model.bad):
        data = zstandard.ZstdCompressionDict(d)
        pair.append(lambda piece, data=data: len(zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress(piece)))
    for r in queries.op10_zstd_quality(spark, SMALL).collect():
        text = (next(d.text for d in docs if d.doc_id == r.doc_id) or "").encode()
        good, bad = (sum(f(text[a : a + zstd_quality.FRAME]) for a in range(0, len(text), zstd_quality.FRAME)) for f in pair)
        x = (bad - good) / (bad + good) if text else 0.0
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * x + model.level)))), rel=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (remainder(r.doc_id, 5) == 0)
    assert model.slope > 0


def test_a_damaged_block_is_noticed():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint16)
    payload = token_files.compress(ids)
    assert (token_files.decompress(payload) == ids).all()
    for at in (60, len(payload) - 9):
        broken = bytearray(payload)
        broken[at] ^= 0x55
        with pytest.raises(ValueError, match="damaged"):
            token_files.decompress(bytes(broken))
    with pytest.raises(ValueError, match="not a token file"):
        token_files.decompress(b"x" + payload[1:])
