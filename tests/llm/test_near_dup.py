import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from repeatlens.llm import hashing, near_dup
from repeatlens.llm.components import connected_components
from tests.llm.helpers import docs, odd_rows, prose, table, with_clashes


def brute(rows, percent=85):
    """{row number: (set size, component)} by comparing all pairs that share a shingle."""
    sets, parent = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        parent[len(sets) - 1] = len(sets) - 1

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(k)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    names = defaultdict(list)
    for k in parent:
        names[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((x for x in names[find(k)] if x is not None),
                                           default=None)) for k in range(len(rows))]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()),
                  key=lambda r: tuple((x is None, x) for x in r))


def want(rows):
    return sorted(brute(rows), key=lambda r: tuple((x is None, x) for x in r))


def test_driver_table_against_all_pairs(spark):
    d = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert got(near_dup.near_duplicates(d)) == want(rows)


def near_copies(n=120, edits=(0, 12)):
    """Copies of one text with a few words changed: similarities from 0.5 to 1,
    and links that exist only between copies."""
    base, rows = prose(1, 160), []
    rng = np.random.default_rng(5)
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(*edits)):
            w[j] = f"new{i}x{j}"
        rows.append((1000 - i, " ".join(w)))
    return rows


def test_group_of_near_copies_loses_no_link(spark):
    rows = near_copies() + [(5000 + i, " ".join(prose(50 + i, 60))) for i in range(10)]
    assert got(near_dup.near_duplicates(docs(spark, rows))) == want(rows)


def test_chain_is_one_component(spark):
    w = prose(9, 400)
    rows = []
    for i in range(12):  # each differs from the one before by one word
        w = list(w)
        w[i * 30] = f"step{i}"
        rows.append((i, " ".join(w)))
    expected = want(rows)
    assert {c for *_, c in expected} == {0}
    assert got(near_dup.near_duplicates(docs(spark, rows))) == expected


def test_odd_rows(spark):
    rows = odd_rows()
    d = with_clashes(docs(spark, rows), "component_id", "kept", "fp", "vid", "id")
    out = near_dup.near_duplicates(d)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == want([(r[0], r[1]) for r in rows])
    kept = {(r.doc_id, r.kept) for r in out.collect()}
    assert (None, False) in kept and (6, True) in kept and (1, True) in kept


def test_empty_table(spark):
    out = near_dup.near_duplicates(docs(spark, []))
    assert out.collect() == []
    assert near_dup.drop_near_duplicates(docs(spark, [])).collect() == []


def test_drop_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = odd_rows() + near_copies(30, (0, 3)) + [(2000, "Alpha beta gamma delta epsilon zeta")]
    d = with_clashes(docs(spark, rows), "fp", "kept")
    out = near_dup.drop_near_duplicates(d)
    assert out.columns == d.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    n_groups = len({c for _, n, c in brute([(r[0], r[1]) for r in rows]) if n})
    assert len(ids) == n_groups + 3  # and three texts without words
    assert [i for _, i in ids].count(6) == 1 and (False, 2000) not in ids


def test_rows_of_one_id_with_different_texts(spark):
    a, b = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    out = near_dup.drop_near_duplicates(docs(spark, [(1, a), (2, b), (2, a), (3, b), (3, None)]))
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, a), (2, b)]
    assert out.filter("text is null").count() == 1


def test_unlinked_texts_under_one_id_all_stay(spark):
    a, b, c, d, e = (prose(70 + i, 60) for i in range(5))
    near = [*d[:59], "changed"]
    rows = [(i, " ".join(w)) for i, w in [(5, a), (5, b), (None, c), (None, d), (None, d),
                                          (None, near), (7, b), (8, e), (8, e), (None, e)]]
    sets = [set(hashing.shingles(t).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 85 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for g in set(group):
        of = [r for r, k in zip(rows, group) if k == g]
        least = min((i for i, _ in of if i is not None), default=None)
        want.append((least, min(t for i, t in of if i == least)))
    out = near_dup.drop_near_duplicates(docs(spark, rows)).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(((r.doc_id, r.text) for r in out), key=key) == sorted(want, key=key)
    assert len(want) == 5


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    pairs += [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {(r.id, r.component) for r in connected_components(df).collect()} == {
        (x, find(x)) for x in list(parent)}
    assert connected_components(df.limit(0)).collect() == []


def test_words_and_shingles():
    assert len(hashing.shingles("A b\tC\x0bd  E f")) == 2
    assert len(hashing.shingles("a b c")) == 1 and len(hashing.shingles(None)) == 0
    assert (hashing.shingles("A B c d e") == hashing.shingles("a b C D E")).all()
    # only A-Z fold, and only the six blanks part words
    assert hashing.shingles("Ä b") != hashing.shingles("ä b")
    assert len(hashing.split("a\xa0b")) == 1
    long = "y" * 9000
    h = hashing._hash_words(hashing.split(f"a {long} b"))
    assert len(h) == 3 and h[0] == hashing._hash_words([b"a"])[0]


def test_many_lines_at_once():
    lines = [prose(i, n) for i, n in enumerate((1, 4, 5, 6, 0, 300, 2000, 7))]
    one = [hashing.shingles(" ".join(x)) for x in lines]
    many = hashing.shingles_of([hashing.split(" ".join(x)) for x in lines])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(one, many))
    sets = [s for s in one if len(s)]
    assert (hashing.minima_of(sets, 64, block=97) == [hashing.minima(s, 64) for s in sets]).all()
    a, b = hashing._permutations(64)
    assert (hashing.minima(sets[-1], 64) == (sets[-1][None] * a + b).min(axis=1)).all()


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_b_bit_estimate(spark, share):
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**62, 4000).astype(np.uint64)
    n = int(4000 * (1 - share) / 2)
    a, b = both[n:], both[:4000 - n]
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sig = [[int(x) for x in hashing.pack_low_bits(hashing.minima(s, 512), 2)] for s in (a, b)]
    df = spark.createDataFrame([tuple(sig)], "a_sig array<long>, b_sig array<long>")
    agree = near_dup.agreeing_minima(df.a_sig, df.b_sig, 512)
    est = df.select(near_dup.estimated_similarity(agree, 512)).first()[0]
    assert abs(est - exact) < 0.1


def test_bands_are_tuned_to_the_recall():
    for s in (near_dup.Scheme(), near_dup.Scheme(80, 2, 0.999, 64)):
        t = s.percent / 100
        assert 1 - (1 - t ** s.rows) ** s.bands >= s.recall
        assert s.bands * s.rows <= s.minima
