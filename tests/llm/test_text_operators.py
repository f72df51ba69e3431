import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pyrocell.llm import bpe, decontaminate, html_text, quality_rules, simhash, substring_dedup, token_files, zstd_quality

TEXTS = ["the cat sat on the mat", "", None, "a" * 5000, "é ü 日本 🙂\n\n  x <|endoftext|> it's", "the cat sat on the mat"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")


def test_bpe_equals_the_library_in_any_chunks():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, library = bpe.Model(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t in TEXTS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(model.encode(t or ""), "<u4").tolist() == want
        tr = bpe.Transducer(model)
        parts = [tr.feed((t or "")[i : i + 3]) for i in range(0, len(t or ""), 3)] + [tr.feed("", last=True)]
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == want
        assert bpe.decode(model, b"".join(parts)) == (t or "")


def test_token_files_round_trip():
    for ids in (np.zeros(0, np.uint16), np.arange(5000).astype(np.uint16), np.full(4097, 65535, np.uint16)):
        assert (token_files.decompress(token_files.compress(ids)) == ids).all()


def test_simhash_groups(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, TEXTS)).collect()}
    assert len(got) == 6 and got[5].component_id == 0 and got[2].component_id == got[1].component_id == 1
    assert got[1].fingerprint == "0" * 16


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", "one two"]
    for group in range(6):
        base = [f"g{group}w{i}" for i in rng.integers(0, 10**6, 150)]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 4)):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    sets = [np.unique(simhash.shingle_hashes((t or "").encode().lower().split(), 5)) for t in texts]
    bits = [simhash.fingerprint((t or "").encode()) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:  # labels sink to the least of each group
        for i in range(len(texts)):
            for j in range(i):
                apart = bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1")
                both = len(np.intersect1d(sets[i], sets[j]))
                if apart <= 4 or (apart <= 12 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                    low[i] = low[j] = min(low[i], low[j])
    got = sorted(r.doc_id for r in simhash.deduplicate(docs(spark, texts)).collect())
    assert got == sorted(set(low)) and len(got) < 20
    assert simhash.deduplicate(docs(spark, texts).limit(0)).count() == 0


def test_substring_dedup_against_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(["x", *words[10:40], "y"]), None, "", " ".join(words[:19])]
    got = {r.doc_id: r for r in substring_dedup.deduplicate(docs(spark, texts), digest=True).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 30, 0, 0, 0]
    assert got[1].kept_sha256 == hashlib.sha256(b"x y").hexdigest()


def test_leaks_are_found_and_clean_texts_left(spark):
    item = " ".join(f"item{i}" for i in range(30))
    changed = item.replace("item7", "other").replace("item20 ", "")
    found = decontaminate.leaks(docs(spark, ["pre " + item + " post", "a " + changed, "nothing here", None, ""]), spark.createDataFrame([(9, item), (8, None)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [0, 1]


def test_counts_and_main_text():
    assert quality_rules.counts(b"a b c\na b c\nx #") == (8, 8, 1, 1, 6)
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p>one\n two<p>three</article><footer>f</footer></body></html>"
    assert html_text.extract(page) == "T & t\n\none two\n\nthree" and html_text.extract(None) == ""


def test_compression_model_without_labels():
    assert zstd_quality.fit([]).score(None) == 0.5


def test_simhash_groups_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    bits = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in texts.items()}
    low = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            least = min(low[j] for j in texts if (bits[i] ^ bits[j]).bit_count() <= 2)
            changed |= least < low[i]
            low[i] = min(low[i], least)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: (f"{bits[i]:016x}", low[i]) for i in texts}


def test_components_against_search(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    edges = [*chain, (5, 5), *((int(a), int(b)) for a, b in rng.integers(-200, 200, (150, 2))), (7, 3), (3, 7)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(low[a], low[b])
            changed |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in simhash.components(table).collect()}
    assert got == {x: r for x, r in low.items() if x != r}
    assert simhash.components(table.limit(0)).count() == 0


def test_close_fingerprints_are_verified(spark):
    """Texts under the limit stay, even if their fingerprints are equal; texts of one shingle set are one."""
    common = " ".join(["same old words"] * 60)
    texts = [f"{common} " + " ".join(f"{c}{i}" for i in range(40)) for c in "pq"]
    texts += [" ".join(["again and over"] * 9), " ".join(["again and over"] * 20)]
    assert simhash.fingerprint(texts[0].encode()) == simhash.fingerprint(texts[1].encode())
    assert sorted(r.doc_id for r in simhash.deduplicate(docs(spark, texts)).collect()) == [0, 1, 2]


def test_near_copies_equal_plain_jaccard(spark):
    """Texts at the limit, by appended words or a replaced block, are found whatever their fingerprints' distance."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    texts = []
    for n in (8, 20, 60, 300, 300, 300, 300, 2000):
        for share in (0.19, 0.22, 0.24, 0.27):
            base = words(n)
            texts += [" ".join(base), " ".join(base + words(int(share * n)))]
        for share in (0.08, 0.1, 0.13):
            base, block = words(n), max(1, int(share * n))
            texts += [" ".join(base), " ".join(base[: n // 2] + words(block) + base[n // 2 + block :])]
    sets = [set(simhash.shingle_hashes(t.encode().split(), 5).tolist()) for t in texts]
    copies = {i for i in range(1, len(texts), 2) if len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])}
    far = [i for i in copies if ((simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[i - 1].encode())) & (2**64 - 1)).bit_count() > 12]
    got = {r.doc_id for r in simhash.deduplicate(docs(spark, texts)).collect()}
    assert got == set(range(len(texts))) - copies and far and len(copies) < len(texts) // 2


def test_recall_at_the_limit():
    rng = np.random.default_rng(5)
    radius, wide = simhash.radius_of(0.8, 64, 4.5), simhash.radius_of(0.8, 256, 6)
    for n in (4, 5, 9, 20, 100, 600):
        missed = 0
        for _ in range(300):
            h = rng.integers(0, 2**64, n + n // 4, np.uint64)
            a, b = (np.array(simhash.set_sketch(x)[1:], np.uint64) for x in (h[:n], h))
            apart = np.bitwise_count(a ^ b)
            missed += apart[0] > radius or apart.sum() > wide
        assert missed <= 2


def test_leaks_at_the_edit_limit_by_length():
    rng = np.random.default_rng(2)
    items = [(n, [f"i{n}x{i}" for i in range(n)]) for n in (3, 4, 5, 6, 7, 9, 10, 14, 15, 20, 50, 100, 300)]
    found = decontaminate.Items([(n, " ".join(ws).encode()) for n, ws in items])
    for spread in range(4):
        texts, want = [], []
        for n, ws in items:
            for over in (0, 1):
                copy, k = list(ws), n // 5 + over
                places = np.linspace(n // 2 if k == 1 else 1, n - 2, k).astype(int) if spread == 0 else rng.choice(n, k, replace=False)
                for at in sorted(places.tolist(), reverse=True):
                    copy[at : at + 1] = [["other"], ["other"], [], [copy[at], "new"]][rng.integers(4) if spread else 0]
                text = ["before"] * int(rng.integers(9)) + copy + ["after"] * int(rng.integers(9))
                e = decontaminate.edit_distance(found.seqs[found.ids.index(n)], decontaminate.word_hashes([w.encode() for w in text]))[0]
                if e <= n // 5:
                    want.append((len(texts), n))
                texts.append(" ".join(text).encode())
        assert [(d, found.ids[k]) for d, k, *_ in found.leaks(texts)] == want and len(want) >= len(items)


def test_repeated_lines_and_words_fail(spark):
    line = lambda i, j: f"doc{i} line{j} " + " ".join(f"w{i}x{j}x{k}" for k in range(8))
    texts = ["\n".join(line(i, j) for j in range(12)) for i in range(60)]
    texts += ["\n".join([*(line(i, j) for j in range(9)), *[line(i, 0)] * 3]) for i in (60, 61)]
    texts.append("\n".join(f"{line(62, j)} buy it now" if j < 9 else line(62, j) for j in range(12)))
    table = docs(spark, texts).selectExpr("doc_id", "text", "'en' AS lang", "fp AS source")
    got = {r.doc_id: r for r in quality_rules.judge(table).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in sorted(got) if not got[i].kept] == [60, 61, 62]


def test_near_dedup_moves_no_texts(spark):
    rows = spark.range(0, 200_000, 1, 3).select(F.expr("id + (id div 70000) * 8589934592").alias("row"))
    chosen = rows.where("row % 7 < 3 OR row IN (0, 32767, 32768, 32769)").select("row")
    want = sorted(r.row for r in chosen.collect())
    assert sorted(r.row for r in simhash.picked(rows, chosen).collect()) == want
    assert simhash.picked(rows, chosen.limit(0)).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.deduplicate(docs(spark, TEXTS))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
