import random

from repeatlens.llm import decontam as D
from tests.llm.helpers import docs, odd_rows, prose, table, with_clashes

ITEMS = "item_id long, text string"


def distance(p, t):
    """Least edit distance of p to a substring of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_myers_against_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abcd", k=rng.randint(0, 100)))
        if rng.random() < 0.6:
            q = list(p)
            for _ in range(3):
                q[rng.randrange(len(q))] = rng.choice(["z", "", "ab"])
            t = t[:40] + "".join(q) + t[40:]
        got, end = D.myers(D._masks(p), len(p), t, False)
        assert got == distance(p, t)
        whole, length = D.myers(D._masks(p[::-1]), len(p), t[:end][::-1], True)
        assert whole == got and (got == len(p) or distance(p, t[end - length:end]) == got)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i] = rng.choice(["", s[i] + "q", "q"])
    return "".join(s)


def test_finds_what_all_pairs_find(spark):
    rng = random.Random(3)
    items = [(i, " ".join(prose(100 + i, rng.randint(5, 40)))) for i in range(25)]
    rows = []
    for i in range(120):
        text = prose(1000 + i, 60)
        _, t = items[i % 25]
        norm = D.normalize(t)
        k = int(D.ERROR_RATE * len(norm))
        noisy = edited(rng, norm, rng.randint(0, 2 * k + 1))
        rows.append((i, " ".join(text[:30]) + " \n " + noisy.upper() + " " + " ".join(text[30:])))
    got = {(r.doc_id, r.item_id): r.distance for r in
           D.find_leaks(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for i, t in rows:
        for n, item in items:
            p = D.normalize(item)
            d = distance(p, D.normalize(t))
            if d <= int(D.ERROR_RATE * len(p)):
                want[i, n] = d
    assert got == want
    assert 40 < len(want) < 120


def test_places_and_groups(spark):
    item = "The quick brown fox jumps\nover the lazy dog and runs home again"
    rows = [(1, f"Once {item.upper().replace(' ', '  ')} end"), (2, "nothing of the kind"),
            (3, item.replace("brown", "brawn"))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "x"), (11, "kind")], ITEMS)
    for size in (1 << 20, 10):  # one group, and one for each few characters
        got = sorted(tuple(r) for r in D.find_leaks(docs(spark, rows), bench, group_bytes=size).collect())
        assert got == [(1, 7, 0, 1, 14), (2, 11, 0, 3, 4), (3, 7, 1, 0, 13)]
        left = D.drop_leaky(docs(spark, rows), bench, group_bytes=size)
        assert left.collect() == []
    long_only = bench.filter("item_id = 7")
    assert [r.doc_id for r in D.drop_leaky(docs(spark, rows), long_only).collect()] == [2]


def test_groups_are_held_one_after_another(spark, monkeypatch):
    """Of many groups each broadcast is given up before the next is read."""
    held, most = [], []
    real = spark.sparkContext.broadcast

    def broadcast(value):
        b = real(value)
        gone = b.destroy
        held.append(b)
        most.append(len(held))
        b.destroy = lambda *a: (held.remove(b), gone(*a))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    items = [(i, " ".join(prose(i, 12))) for i in range(40)]
    rows = [(i, "x " + items[i % 40][1] + " y") for i in range(80)] + [(100, "clean")]
    bench, d = spark.createDataFrame(items, ITEMS), docs(spark, rows)
    size = sum(len(t) for _, t in items) // 5
    got = D.find_leaks(d, bench, group_bytes=size).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((i, i % 40) for i in range(80))
    assert [r.doc_id for r in D.drop_leaky(d, bench, group_bytes=size).collect()] == [100]
    assert max(most) == 1 and len(most) >= 10 and not held


def test_a_long_text_with_many_hits():
    import time
    item = " ".join(prose(5, 12))
    m = D.Matcher([(1, item)], D.ERROR_RATE)
    near = item[:9] + "q" + item[9:]
    text = " ".join([near] * 15_000)  # over 1 MB
    t = time.perf_counter()
    assert [h[:2] for h in m.find(text)] == [(1, 1)] and time.perf_counter() - t < 10


def test_driver_table_by_plain_search(spark):
    d, b = table(spark, "documents"), table(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(d, b).filter("distance = 0").collect()}
    items = [(r.item_id, D.normalize(r.text)) for r in b.collect()]
    want = {(r.doc_id, i) for r in d.collect() for i, t in items if t in D.normalize(r.text)}
    assert got == want and want


def test_odd_rows_and_empty_tables(spark):
    d = with_clashes(docs(spark, odd_rows()), "item_id", "distance", "_leaky_id")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (None, None)], ITEMS)
    got = D.find_leaks(d, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["6", "6", "None"]
    left = D.drop_leaky(d, bench)
    assert left.columns == d.columns and left.count() == len(odd_rows()) - 3
    assert D.find_leaks(docs(spark, []), bench).collect() == []
    assert D.find_leaks(d, bench.limit(0)).collect() == []
    assert D.drop_leaky(d, bench.limit(0)).count() == len(odd_rows())
