import math
import random
import zlib

import pytest

from repeatlens.llm import toxicity as X
from tests.llm.helpers import docs, odd_rows, prose, table, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=1):
    """Documents of eight sentences; toxic ones hold a bad word in one."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(prose(seed * 10_000 + i * 8 + k, 9)) for k in range(8)]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(8)
            s[k] += f" {rng.choice(['zzvile', 'zzfoul', 'zzrotten'])} " + s[k][:5]
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_sentences_from_document_labels(spark):
    rows, labels = corpus()
    d = docs(spark, rows)
    model = X.train(d, spark.createDataFrame(labels, LABELS))
    text = dict(rows)
    for r in X.score(d, model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        if r.score >= 0.5:
            assert all("zz" in text[r.doc_id][s.start:s.end] for s in r.offending)
    fresh = docs(spark, corpus(80, seed=7)[0])
    wrong = X.score(fresh, model).filter("(score >= 0.5) != (doc_id % 4 = 0)").count()
    assert wrong == 0


def test_noisy_or_of_the_sentences():
    s = X.Scorer({"bias": -2.0, "weights": {"bad": 3.0, "^bad$": 0.5}})
    p = lambda z: 1 / (1 + math.exp(-z))
    score, top = s.score("bad bad thing. fine here! badly so\nok. 12")
    # "bad" holds the mark "^bad$" only, "badly" neither; digits are no words
    probabilities = [p(-2 + z) for z in (0.5, 0, 0, 0)]
    assert score == pytest.approx(1 - math.prod(1 - q for q in probabilities))
    assert top == []
    assert s.score("") == (0.0, []) and s.score(None) == (0.0, [])
    score, top = X.Scorer({"bias": -2.0, "weights": {"^bad$": 5.0}}).score("all fine. a bad one")
    assert [(a, b) for a, b, _ in top] == [(9, 19)] and top[0][2] == pytest.approx(p(3.0))


def test_held_out_rows_and_accuracy_on_the_driver_table(spark):
    sf = "/root/testdata/sf0.01"
    out = X.op7_toxicity(spark, sf)
    rows = out.join(table(spark, "labels", sf), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    seen = [r for r in rows if not r.held_out]
    assert sum(r.predicted == r.toxic for r in seen) > 0.95 * len(seen)
    test = [r for r in rows if r.held_out]
    toxic, clean = ([r.score for r in test if r.toxic == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.8  # about 300 training documents; over 0.97 at ten times as many


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, LABELS)
    flipped = lab.selectExpr("doc_id", "quality", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, "
                             "1 - toxic, toxic) toxic")
    d = docs(spark, rows)
    assert X.train(d, lab) == X.train(d, flipped)
    other = d.selectExpr("doc_id", "text", "'xx' lang", "'s' source", "0L n_chars")
    assert X.train(other, lab) == X.train(d, lab)


def test_sample_bounds(spark):
    rows, labels = corpus(200)
    d, lab = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    few = X.train(d, lab, max_docs=10)
    assert isinstance(few["bias"], float)
    assert X.train(d, lab, max_chars=1)["weights"] == {}  # one document: nothing to compare


def test_a_text_over_the_budget_does_not_end_the_sample(spark):
    rows, labels = corpus(60)
    d, lab = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    want = X.train(d, lab)
    for i in (10 ** 6, 10 ** 6 + 2, 10 ** 6 + 3):  # wherever their hashes stand
        d = d.union(docs(spark, [(i, "long word " * 5000)]))
        lab = lab.union(spark.createDataFrame([(i, 1, 0)], LABELS))
    assert X.train(d, lab, max_chars=45_000) == want and want["weights"]


def test_odd_rows_and_empty_tables(spark):
    rows, labels = corpus(100)
    odd = [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in odd_rows()]
    d = with_clashes(docs(spark, rows + odd), "toxic", "h", "n", "score")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (0, 1, None), (1006, 0, 1), (1006, 0, 0),
                                          (10**9, 1, 1)], LABELS)
    out = X.score(d, X.train(d, lab)).collect()
    assert len(out) == 100 + len(odd)
    text = {r.doc_id: r.text for r in d.collect()}
    assert all(r.score == 0 for r in out if not (text[r.doc_id] or "").strip())
    empty = docs(spark, [])
    assert X.score(empty, X.train(empty, lab)).collect() == []
    untrained = X.score(d, X.train(d, lab.limit(0))).collect()
    assert all(r.score < 0.5 for r in untrained)
    held = d.select("doc_id", X.held_out(d.doc_id).alias("x")).filter("doc_id is null").first()
    assert held.x is False
