"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every text operator."""

import public_tokenizers
import pytest

from pyrocell.llm import bpe, decontaminate, html_text, katz, langid, quality_rules, queries, simhash, substring_dedup, token_files, zstd_quality

PATH = public_tokenizers.path(queries.TOKENIZER)
TEXTS = [None, "", " \n\t", "one", "the same words again and again " * 12, "the same words again and again " * 12, "word " * 60_000, "x" * 200_000, "é 日本 🙂 #*$\x00"]
CLASH = ", n_words int, n_tokens int, score double, start int, bucket int, chunk int, fp int, fingerprint string, kept boolean, lang_pred string, label string, id int"


def table(spark):
    rows = [(i if i != 5 else 4, t, "en" if i % 2 else None, "web", *(7,) * 2, 0.5, *(7,) * 4, "f", True, "zz", "l", 7) for i, t in enumerate(TEXTS)]
    rows.append((None, "a row without an id", None, None, *(7,) * 2, 0.5, *(7,) * 4, "f", True, "zz", "l", 7))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string{CLASH}")


def files(docs):
    from pyrocell.llm.common import scratch

    path = scratch(docs.sparkSession, "tokens")
    token_files.write(docs, path, PATH)
    return token_files.read(docs.sparkSession.read.parquet(path))


def scored(docs):
    return zstd_quality.held_out_scores(docs, docs.sparkSession.createDataFrame([(3, 1), (3, 1), (6, 0), (None, 1), (99, None)], "doc_id long, quality int"))


EACH = {
    "bpe": lambda d: bpe.round_trip(d, PATH), "files": files, "language": langid.held_out_predictions, "rules": quality_rules.judge, "katz": katz.score,
    "substring": lambda d: substring_dedup.deduplicate(d, digest=True), "simhash": simhash.near_duplicates, "quality": scored,
    "pages": lambda d: html_text.main_text(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "n_words AS n_chars")),
}


@pytest.mark.parametrize("name", EACH)
def test_every_row_has_a_result(spark, name):
    docs = table(spark)
    key = "page_id" if name == "pages" else "doc_id"
    got = [getattr(r, key) for r in EACH[name](docs).collect()]
    assert sorted(got, key=str) == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
    assert EACH[name](docs.limit(0)).count() == 0


def test_operators_that_return_rows_keep_all_columns(spark):
    docs = table(spark)
    items = spark.createDataFrame([(1, "the same words again and again the same"), (2, None), (None, "x")], "item_id long, text string")
    cut = substring_dedup.deduplicate(docs)
    assert cut.columns == [*docs.columns, "n_words_", "n_removed"] and cut.count() == docs.count()
    single = simhash.deduplicate(docs)
    assert single.columns == docs.columns and single.count() == 7  # of ten rows three have no word and are one group, two are copies
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert decontaminate.leaks(docs, items).count() == 1  # both copies have one id
    for empty in (substring_dedup.deduplicate(docs.limit(0)), simhash.deduplicate(docs.limit(0)), decontaminate.clean(docs.limit(0), items), decontaminate.leaks(docs, items.limit(0))):
        assert empty.count() == 0


def test_a_batch_is_not_held_twice_to_be_encoded():
    """Of a batch's texts only a few are Python strings at once."""
    import tracemalloc

    import pyarrow as pa

    from pyrocell.llm import bpe

    class Plain:
        def encode(self, text: str) -> bytes:
            return text[:1].encode()

    texts = pa.array([chr(97 + i % 26) * 10000 for i in range(2048)] + [None])
    tracemalloc.start()
    got = bpe.encode_batch(Plain(), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[27].as_py() == b"b" and got[2048].as_py() == b"" and len(got) == 2049
    assert peak < 2048 * 10000 / 4
