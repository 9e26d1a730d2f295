import re

import duckdb
import pytest

from repeatlens.llm import quality
from tests.llm.helpers import SMALL, docs, odd_rows, prose, table, with_clashes


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in windows if windows.count(g) > 1} if len(w) < 2000 else None
    covered = {i + k for i, g in enumerate(windows) if twice and g in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(spark):
    rep = "a b c d e f a b c d e x y a b c d e"
    rows = [(1, rep), (2, "a a a a a a a"), (3, "x\nx\n\n \nx\ny"), (4, "é # ü%%\x0bw z"),
            (5, " ".join(prose(1, 50) * 2)), (6, None), (7, "a b c d"), (8, "#|<>")]
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in quality.quality(docs(spark, rows)).collect()}
    assert got == {i: counts(t) for i, t in rows}
    assert got[2][4] == 7 and got[1][4] == 15


def test_base_failures(spark):
    rows = [(1, " ".join(prose(1, 9))), (2, " ".join(prose(1, 10))),
            (3, " ".join(prose(1, 5) * 2 + prose(2, 30))), (4, " ".join(prose(1, 6) * 2 + prose(2, 30)))]
    got = {r.doc_id: r.base_failed for r in quality.quality(docs(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: 10 * 100 > 20 * 40, 4: 12 * 100 > 20 * 42}


def test_outliers_are_judged_by_their_own_group(spark):
    plain = [(i, " ".join(prose(i, 40)), "en", "prose") for i in range(150)]
    tables = [(1000 + i, " | ".join(prose(500 + i, 40)), "en", "tables") for i in range(150)]
    odd = [(5000, " ".join(w + "$$$" for w in prose(9, 40)), "en", "prose"),
           (5001, " ".join(w + "$$$" for w in prose(9, 40)), "en", "rare"),
           (5002, "\n".join([" ".join(prose(900 + i, 4)) for i in range(20)] * 1
                            + ["same line"] * 30), "en", "prose")]
    out = {r.doc_id: r.kept for r in quality.quality(docs(spark, plain + tables + odd)).collect()}
    assert all(out[i] for i, *_ in plain + tables)
    assert not out[5000] and not out[5002]


def test_sketch_quantiles_and_merging(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    values = {s: np.sort((rng.lognormal(5, 1, 400)).astype(int)) for s in ("a", "b")}
    rows = [("en", s, int(v), 0, 0, 0) for s, x in values.items() for v in x]
    m = spark.createDataFrame(rows, "lang string, source string, symbols long, dup_lines long, "
                                    "repeats long, word_len long")
    sketch = quality.sketches(m)
    for keys, data in ((["lang", "source"], values["a"]),
                       (["lang"], np.sort(np.concatenate(list(values.values()))))):
        row = quality._fences(sketch, keys).filter("source = 'a'" if len(keys) > 1 else "true").first()
        q1, q3 = data[len(data) // 4 - 1], data[len(data) * 3 // 4 - 1]
        exact = q3 + quality.FENCE * (q3 - q1) + quality.METRICS["symbols"][1]
        assert exact <= row.symbols <= exact * 1.4
        assert row.total == len(data)


def test_odd_rows_and_empty_table(spark):
    names = ("n_words", "kept", "counts", "t_symbols")
    d = with_clashes(docs(spark, odd_rows()), *names)
    out = quality.quality(d).collect()
    assert len(out) == len(odd_rows())
    by = {r.doc_id: r for r in out}
    assert by[1].base_failed and by[2].base_failed and by[4].n_words == 60_000
    assert quality.drop_rejected(d).columns == d.columns
    assert quality.quality(docs(spark, [])).collect() == []
    assert quality.drop_rejected(docs(spark, [])).collect() == []


def test_thresholds_join_without_broadcast(spark, monkeypatch):
    d = table(spark, "documents")
    a = sorted(quality.quality(d).collect())
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert sorted(quality.quality(d).collect()) == a


@pytest.mark.parametrize("name", ["op3_warc_archives", "op5_secret_scans", "op6_url_filters",
                                  "op9_quality_rules"])
def test_oracles(spark, name):
    from repeatlens.llm import registry
    got = registry.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{SMALL}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = [c for c in ("doc_id", "page_id") if c in cols]
    got, want = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        a, b = got[c], want[c]
        assert ((a == b) | (a.isna() & b.isna())).all(), c
