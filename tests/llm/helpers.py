"""Tables for the corpus tests."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """documents rows from (doc_id, text[, lang, source]) tuples."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
             len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (None, "alpha beta gamma delta epsilon zeta"),
            (4, long, None, None), (5, "one"), (6, "alpha beta gamma delta epsilon zeta"),
            (6, "alpha beta gamma delta epsilon zeta"), (7, "x" * 50_000), (8, "Ünïcode ΣΑΣ 中文 🎉")]


def with_clashes(df, *names):
    """``df`` with further columns named like an operator's own."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("other").alias(n) for n in names))


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n)]


def table(spark, name: str, sf: str = SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")
