"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Signals are counted per text, whole. For each (language, source) every signal's values go into a quantile
sketch with relative error ERROR: a value's bucket is the ceiling of its logarithm to base GAMMA, and a sketch
is the count of each bucket. Sketches of partitions merge by adding counts, in any order with the same result,
which is what the partial aggregation before the shuffle does; a hot source therefore moves a few hundred rows
per task. Sketches of one language's sources, and of all languages, merge the same way: a group of fewer than
MIN_ROWS rows takes its thresholds from its language, failing that from all rows.

word_length fails outside median -/+ SPREAD times the larger quartile distance. Most texts have none of what the
shares count, so their quartiles are zero: a share fails above median + TAIL_SPREAD times the distance from the median
to the 0.9 quantile (on normal values both rules are near four standard deviations). Limits are widened by a slack so
that a signal which is constant in a group does not reject on rounding. Texts that fail the base rule set no limits.
No share of the rows is rejected by construction: rows that are alike are all kept.

Null text: no words, so base_failed. Null language or source: a group of its own. Repeated rows count each.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyrocell.llm.common import as_bytes, materialise

ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Values at or below this are one bucket.
LEAST = 1e-6
ZERO_BUCKET = -100000
MIN_ROWS = 20
SPREAD = 6.0
TAIL_SPREAD = 3.0
#: Signal -> slack, and whether its limits come from the quartiles and a low value fails too.
SIGNALS = {"symbol_share": (0.02, False), "dup_line_share": (0.02, False), "repeat_share": (0.02, False), "word_length": (1.0, True)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Thresholds are sent to every task only up to this many groups.
BROADCAST_GROUPS = 10_000


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or b""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        threes = list(zip(words, words[1:], words[2:]))
        seen = Counter(threes)
        if len(seen) < len(threes):
            covered = bytearray(len(words))
            for i, t in enumerate(threes):
                if seen[t] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeated = sum(covered)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def counts_column(text: Column) -> Column:
    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in (*COUNTS, "n_lines")) + ">")
    def of(texts: pa.Array) -> pa.Array:
        rows = [(*counts(t), (t or b"").count(b"\n") + 1) for t in as_bytes(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], [*COUNTS, "n_lines"])

    return of(text)


def signals(rows: DataFrame) -> DataFrame:
    """Adds the signals; null where a text has no words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": F.when(F.col("n_words") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    })


def bucket(value: Column) -> Column:
    return F.when(value <= LEAST, F.lit(ZERO_BUCKET)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).cast("int")


def unbucket(b: Column) -> Column:
    """The value a bucket stands for: within ERROR of every value in it."""
    return F.when(b == ZERO_BUCKET, F.lit(0.0)).otherwise(2 * F.exp(b * F.lit(math.log(GAMMA))) / (GAMMA + 1))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): one mergeable sketch per group and signal."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), bucket(F.col(s)).alias("bucket")) for s in SIGNALS))).alias("x")
    return rows.select("lang", "source", each).select("lang", "source", "x.*").where("bucket IS NOT NULL").groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """total, q25, q50, q75, q90 of each sketch after merging those that agree in keys and signal."""
    merged = sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "signal")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    at = lambda q: unbucket(F.min(F.when(F.col("upto") >= F.floor(q * (F.col("total") - 1)) + 1, F.col("bucket"))))
    return ranked.groupBy(*keys, "signal").agg(F.max("total").alias("total"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), at(0.9).alias("q90"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, signal, low, high): each group's own, its language's or the overall thresholds."""
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("signal").alias("ls"), F.struct("total", "q25", "q50", "q75", "q90").alias("of_lang"))
    over = quantiles(sketch, []).select(F.col("signal").alias("s"), F.struct("total", "q25", "q50", "q75", "q90").alias("of_all"))
    all_ = own.join(by_lang, own.lang.eqNullSafe(F.col("l")) & (own.signal == F.col("ls"))).join(over, own.signal == F.col("s"))
    q = F.when(F.col("total") >= MIN_ROWS, F.struct("total", "q25", "q50", "q75", "q90")).when(F.col("of_lang.total") >= MIN_ROWS, F.col("of_lang")).otherwise(F.col("of_all"))
    all_ = all_.select(own.lang, own.source, own.signal, q.alias("q"))
    half = SPREAD * F.greatest(F.col("q.q50") - F.col("q.q25"), F.col("q.q75") - F.col("q.q50"))
    tail = TAIL_SPREAD * (F.col("q.q90") - F.col("q.q50"))
    slack, low = F.lit(None).cast("double"), F.lit(False)
    for s, (room, both) in SIGNALS.items():
        slack = F.when(F.col("signal") == s, F.lit(room)).otherwise(slack)
        low = F.when(F.col("signal") == s, F.lit(both)).otherwise(low)
    return all_.select("lang", "source", "signal", F.when(low, F.col("q.q50") - half - slack).alias("low"), (F.col("q.q50") + F.when(low, half).otherwise(tail) + slack).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), counts_column(F.col(text_col)).alias("c"))
    rows = signals(materialise(rows.select("doc_id", "lang", "source", "c.*")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = thresholds(sketches(rows.where(~base)))
    wide = limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("signal") == s, F.col(x))).alias(f"{x}_{s}") for s in SIGNALS for x in ("low", "high")))
    wide = materialise(wide)
    groups = wide.count()
    joined = rows.join(F.broadcast(wide) if groups <= BROADCAST_GROUPS else wide, ["lang", "source"], "left")
    fine = F.lit(True)
    for s in SIGNALS:
        fine = fine & F.coalesce(F.col(s) <= F.col(f"high_{s}"), F.lit(True)) & F.coalesce(F.col(s) >= F.col(f"low_{s}"), F.lit(True))
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & fine).alias("kept"))
