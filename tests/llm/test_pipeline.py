import re

import corpus_pipeline as C
from pyspark.sql import functions as F

from repeatlens.llm import bpe, decontam, quality, secrets
from tests.llm.helpers import SMALL, docs, odd_rows, prose, table, with_clashes
from tests.llm.test_near_dup import brute


def written(df, tmp_path, name):
    """As the driver does: written as Parquet and read again."""
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_against_brute_force(spark, tmp_path):
    d = table(spark, "documents")
    columns = d.columns
    bench = [decontam.normalize(r.text) for r in table(spark, "benchmark").collect()]
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in d.collect()}
        d = written(stage(spark, d, SMALL), tmp_path, name)
        after = {r.doc_id: r for r in d.collect()}
        if name != C.STAGES[-1][0]:
            assert d.columns == columns
            unchanged = all(after[i] == before[i] for i in after)
            assert unchanged == (name != "secret_scans")
        if name == "quality_rules":
            marks = {r.doc_id for r in quality.quality(table(spark, "documents")).filter("kept").collect()}
            assert set(after) == marks and 0.5 * len(before) < len(after) < len(before)
        elif name == "near_dedup":
            rows = [(i, r.text) for i, r in before.items()]
            assert set(after) == {c for *_, c in brute(rows)} and len(after) < len(before)
        elif name == "decontamination":
            hit = {i for i, r in before.items() if any(b in decontam.normalize(r.text) for b in bench)}
            assert hit and set(after) == set(before) - hit  # the planted passages are exact
        elif name == "secret_scans":
            assert set(after) == set(before)
            for i, r in before.items():
                if not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9_-]{24}|[:=]", r.text):
                    assert after[i].text == r.text
            left = secrets.scan(d).filter(F.exists("judged", lambda s: s["live"])).count()
            assert left == 0
        else:
            with open(bpe.default_tokenizer(), encoding="utf-8") as f:
                encoder = bpe.Encoder(bpe.Codec(f.read()))
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.token_ids == encoder.encode(before[i].text).tolist() and r.n_tokens == len(
                    r.token_ids)


def test_run_equals_the_stages(spark, tmp_path):
    d = table(spark, "documents")
    for name, stage in C.STAGES:
        d = written(stage(spark, d, SMALL), tmp_path, name)
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert key(C.run(spark, SMALL)) == key(d)


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(100 + i, " ".join(prose(i, 30))) for i in range(5)] + odd_rows()
    names = ("kept", "fp", "spans", "_id", "n_words", "item_id", "judged")
    for k, d in enumerate([with_clashes(docs(spark, rows), *names), docs(spark, [])]):
        columns = d.columns
        for name, stage in C.STAGES:
            d = written(stage(spark, d, SMALL), tmp_path, f"{k}-{name}")
            assert d.columns == columns or name == C.STAGES[-1][0]
        ids = {r.doc_id for r in d.collect()}
        assert ids == ({100, 101, 102, 103, 104} if k == 0 else set())


def test_registered():
    import __spark_entry__ as E
    from repeatlens.llm import registry
    names = E.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)


def test_the_session_stays_as_it_is(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 777)
    try:
        C.bpe_codec(spark, docs(spark, [(1, "one two")]), SMALL)
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.set(key, before)
