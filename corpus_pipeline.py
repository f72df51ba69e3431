"""The corpus pipeline: five stages from documents to tokens, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads again for the next. So when
a stage begins the one before is written, and the tables it had made on the way are deleted. All but the last return
the columns of documents; an empty table passes through every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocell.llm import bpe, decontaminate, langid, simhash, substring_dedup
from pyrocell.llm.common import discard, fresh, materialise, recording
from pyrocell.llm.queries import TOKENIZER, public_tokenizers

#: A language named with less confidence is no language: the text is rejected.
LEAST_CONFIDENCE = 0.5


_tables: list[str] = []


def stage(f):
    @functools.wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _tables)
        with recording(_tables):
            return f(spark, docs, sf_dir)

    return run_


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is recognised; rejects null and letterless texts and unsure guesses."""
    model = langid.train(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    name = fresh("language", docs.columns)
    judged = docs.withColumn(name, langid.predict_column(docs, model, F.col("text")))
    return judged.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_CONFIDENCE)).select(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of copies and near copies."""
    return simhash.deduplicate(docs)


@stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier out of the texts; n_chars follows. No row is dropped."""
    cut = substring_dedup.deduplicate(docs)
    changed = F.col(cut.columns[-1]) > 0
    return cut.select(*(F.when(changed, F.length("text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    path = public_tokenizers.path(TOKENIZER)
    coded = docs.select("doc_id", "lang", "source", "text", bpe.encode_column(docs, F.col("text"), path).alias("ids"))
    same = bpe.decode_column(docs, F.col("ids"), path) == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup_stage), ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: SQL can express neither the trained model nor the walks: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = materialise(f(spark, docs, sf_dir))
    return docs
