"""The training-data pipeline: STAGES over ``documents``, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  Nulls, empty and very long texts,
repeated rows and empty tables are handled as the operators' docstrings say:
null and empty texts are rejected by the first stage, and of repeated rows
one stays after the second.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from repeatlens.llm import bpe, decontam, near_dup, quality, secrets
from repeatlens.llm.common import table
from repeatlens.session import write_shared


#: Documents are long: batches of this many rows pass to Python, not 10,000.
BATCH_ROWS = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark):
    """Bounds what a batch takes on both sides, for the jobs run inside; the
    session is left as it was."""
    before = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, BATCH_ROWS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS)
        else:
            spark.conf.set(_ROWS, before)


def quality_rules(spark, docs, sf_dir: str):
    """Drops the documents that the quality rules reject."""
    return quality.drop_rejected(docs)


def near_dedup(spark, docs, sf_dir: str):
    """Keeps one document, that with the smallest id, of each group."""
    with small_batches(spark):
        return near_dup.drop_near_duplicates(docs)  # its Python jobs have run


def decontamination(spark, docs, sf_dir: str):
    """Drops the documents that hold an item of ``benchmark``."""
    with small_batches(spark):
        return write_shared(decontam.drop_leaky(docs, table(spark, sf_dir, "benchmark")), "decontaminated")


def secret_scans(spark, docs, sf_dir: str):
    """Masks live-looking credentials; the documents stay."""
    return secrets.redact(docs)


def bpe_codec(spark, docs, sf_dir: str):
    """doc_id, lang, source, token ids and their number, and the digest of
    the text that the ids decode to."""
    kept = docs.select("doc_id", "lang", "source", "text")
    with small_batches(spark):
        both = bpe.recode(kept, bpe.default_tokenizer())
        return write_shared(both.select(
            "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"),
            "token_ids", F.sha2("decoded", 256).alias("decoded_sha256")), "tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("bpe_codec", bpe_codec),
]

#: MinHash, edit distance and BPE are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
