"""The corpus pipeline: each stage works on what the one before it kept, written as Parquet and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.session import MADE, forget, setting, table, written
from setweave.llm import langid, packing, simhash, suffix_dedup, toxicity
from setweave.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fifth, does not predict toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is settled."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each group linked by SimHash and verified on five-word shingles; rows without an id stay."""
    return simhash.keep_one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat in strings of 200; none is left out."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


#: Rows of an Arrow batch while the stages run: whole texts make the default of 10,000 rows large on both sides.
ARROW_ROWS, ARROW_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_LEFT: list[DataFrame] = []


def _stage(work):
    """A stage that first deletes the tables the one before it worked with: its result is written by now.

    A stage's own result is computed when it is written, so the size of Arrow batches stays set; run() restores it.
    """

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(*_LEFT)
        spark.conf.set(ARROW_KEY, ARROW_ROWS)
        before = set(MADE)
        out = work(spark, docs, sf_dir)
        _LEFT[:] = [made for name, made in MADE.items() if name not in before]
        return out

    return run


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("language ID", _stage(keep_identified)),
    ("SimHash near-dedup", _stage(drop_near_duplicates)),
    ("suffix-array dedup", _stage(drop_repeats)),
    ("packing", _stage(pack)),
]

#: SQL can express neither the classifiers nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    before = None
    with setting(spark, ARROW_KEY, ARROW_ROWS):
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
            forget(*_LEFT, *([before] if before is not None else []))
            _LEFT.clear()
            before = docs
    return docs
