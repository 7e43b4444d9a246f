"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed rules decide the base verdict. Then every measure of a document is held
against what is usual for its language and source. What is usual comes from
quantile sketches: logarithmic histograms whose buckets are a constant ratio
wide, so a quantile has a relative error of at most half that ratio, and whose
counts add up when sketches are merged. They are merged within tasks, across
tasks, and, where a source has too few documents of a language, over its
sources, and over all languages. Merging is exact, so thresholds don't depend on how
rows are spread. The thresholds, a row for each language and source, are joined
to the documents' measures.

A document is rejected where a measure is above its group's median by more than ``FENCE``
times the distance from there to the upper decile (or, for word length, as far below with the lower
decile), and by an allowance for chance besides, which shrinks with the square root of the
document's words or lines: a text of three lines may repeat one. Where nine documents of ten
have none of something, the allowance alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.text_units import utf8
from corpusprep.session import materialize

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SYMBOL_TABLE = bytes(SYMBOLS)
_BLANKS = b" \t\n\x0b\x0c\r"
#: Ratio of a bucket's ends.
GAMMA = 1.02
FENCE = 3
#: Documents from which a group's own sketch is used.
MIN_DOCS = 200


class Measure(NamedTuple):
    value: Column
    #: Allowance of a document of one unit; of n, it is this over the root of n.
    allowance: float
    units: Column
    two_sided: bool = False


def measures() -> dict[str, Measure]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": Measure(F.col("n_symbols") / words, 1.0, words),
        "repeated_words": Measure(F.col("n_repeat_words") / words, 2.0, words),
        "repeated_lines": Measure(F.col("n_dup_lines") / lines, 0.6, lines),
        "word_length": Measure(F.col("word_chars") / words, 2.0, words, True),
    }


def n_repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first time included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words])
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[at] > 1)
    if not len(twice):
        return 0
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[twice + i] = True
    return int(hit.sum())


def measured(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word) of a text."""
    data = utf8(text)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    return (
        len(words), len(text or "") - (len(data) - len(data.translate(None, _BLANKS))), len(data) - len(data.translate(None, _SYMBOL_TABLE)),
        len(lines) - len(set(lines)), n_repeated_words(words), len(lines),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the counts of ``measured`` and base_failed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "lang", "source", *_COUNTS],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.mapInArrow(scan, schema).withColumn("base_failed", failed)


def _bucket(value: Column) -> Column:
    """Bucket of a value: 0 holds zeros, any other i the values up to GAMMA**i (null: none)."""
    small = 1e-4
    return F.when(value < small, F.lit(0)).otherwise(F.ceil(F.log(value / small) / float(np.log(GAMMA))) + 1).cast("int")


def _bucket_value(bucket: Column) -> Column:
    return F.when(bucket == 0, 0.0).otherwise(1e-4 * F.pow(F.lit(GAMMA), bucket - 1) * 2 / (1 + GAMMA))


#: From the finest groups to all documents.
_LEVELS = 3


def _group(level: int) -> list[Column]:
    """lang and source of the group of a level, as keys without nulls."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [(key("lang") if level < 2 else F.lit("")).alias("lang_key"), (key("source") if level < 1 else F.lit("")).alias("source_key")]


def sketches(rows: DataFrame) -> DataFrame:
    """level, lang_key, source_key, measure, bucket, n: the sketches of all groups, the coarser ones merged from the finest."""
    values = F.array(*(F.struct(F.lit(k).alias("measure"), _bucket(m.value).alias("bucket")) for k, m in measures().items()))
    finest = rows.select("lang", "source", F.inline(values)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    finest = materialize(finest)
    out = None
    for level in range(_LEVELS):
        own = finest.select(F.lit(level).alias("level"), *_group(level), "measure", "bucket", "n")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("level", "lang_key", "source_key", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, fence: float = FENCE) -> DataFrame:
    """level, lang_key, source_key, n, limits (measure to its least, null for none, and largest value, without the allowance)."""
    group = ["level", "lang_key", "source_key", "measure"]
    below = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))  # as many rows as a sketch has buckets
    ranks = sketch.withColumn("below", below).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    decile = lambda q: _bucket_value(F.min(F.when(F.col("below") * 10 >= F.col("all") * q, F.col("bucket"))))
    two_sided = F.col("measure").isin([k for k, m in measures().items() if m.two_sided])
    q = ranks.groupBy(*group).agg(decile(1).alias("q1"), decile(5).alias("q5"), decile(9).alias("q9"), F.max("all").alias("n"))
    low = F.when(two_sided, F.col("q5") - fence * (F.col("q5") - F.col("q1")))
    high = F.col("q5") + fence * (F.col("q9") - F.col("q5"))
    limits = F.map_from_entries(F.collect_list(F.struct("measure", F.struct(low.alias("low"), high.alias("high")))))
    return q.groupBy(*group[:3]).agg(F.max("n").alias("n"), limits.alias("limits"))


def thresholds(rows: DataFrame, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """limits for each lang and source in ``rows``: of the finest group with ``min_docs`` documents that passed the base rules."""
    table = materialize(fences(sketches(rows.where(~F.col("base_failed"))), fence))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), *_group(i)) for i in range(_LEVELS)))).alias("g")
    wanted = groups.select("lang", "source", levels).select("lang", "source", "g.*")
    found = wanted.join(table, ["level", "lang_key", "source_key"]).where((F.col("n") >= min_docs) | (F.col("level") == _LEVELS - 1))
    return found.groupBy("lang", "source").agg(F.min_by(F.struct("level", "limits"), "level").alias("used")).select("lang", "source", "used.*")


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                        min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept, failed (measures out of their limits), level (of the sketch used).

    A null text has no words and fails the base rules; null languages and sources are groups like
    others. If no document passes the base rules there are no limits, and none is kept.
    """
    rows = materialize(text_measures(docs, id_col, text_col, lang_col, source_col))
    limits = materialize(thresholds(rows, min_docs, fence)).withColumnsRenamed({"lang": "l_lang", "source": "l_source"})
    same = F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source"))
    out = []
    for k, m in measures().items():
        allowance = m.allowance / F.sqrt(m.units)
        limit = F.col("limits")[k]
        over = (m.value > limit["high"] + allowance) | F.coalesce(m.value < limit["low"] - allowance, F.lit(False))
        out.append(F.when(over, F.lit(k)))
    joined = rows.join(limits, same, "left").withColumn("failed", F.array_compact(F.array(*out)))
    return joined.select(
        "doc_id", "lang", "source", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed", "level"
    )
