"""A training corpus from ``documents``: each stage works on what its predecessor kept.

For all stages: null texts are like empty ones, texts are taken whole however long, rows with null or
equal ids are rows of their own, columns other than those of ``documents`` are left out whatever
their names, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavouch.llm import bpe, decontaminate, nearcopies, quality, substrings
from datavouch.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = COLUMNS[1:]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score below 0.5; a score of 0.5, as all
    have where nothing could be learned, stays). Repeated rows score, and stay or go, alike."""
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=_REST)
    return scored.filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word Jaccard similarity of 0.8 or more): that of
    the smallest id, nulls last, of equal ids that of the smallest hash of its text. Repeated rows
    are copies; all texts without words are one group."""
    return nearcopies.without_copies(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 20 words or more that occur earlier in the corpus (smaller id, null ids first,
    or earlier in the same document). Of repeated rows with one id neither is earlier. A text without
    a repeat stays as it is; null becomes null, and n_chars is counted anew."""
    cut = substrings.remove_repeats(docs, keep=("lang", "source"), with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by benchmark items: those in which hit words are a twentieth or
    more; documents without words are clean. Repeated rows stay or go alike."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=_REST)
    return judged.filter("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left, a row for each row; texts without characters have
    no tokens."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("benchmark", drop_benchmark), ("tokens", encode)]
#: The classifier, the pattern's tokens and the near copies are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
