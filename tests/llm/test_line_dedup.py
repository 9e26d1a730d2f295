import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repeatlens.llm import line_dedup as L
from tests.llm.helpers import SMALL, docs, odd_rows, prose, table, with_clashes

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, keep="none"):
    """(doc_id, n_lines, n_dropped, kept) for each row, sorted."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(STRIP).translate(LOWER)
    count = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    gone = {k for k, n in count.items() if n >= min_docs}
    first = {}
    order = sorted(range(len(rows)), key=lambda r: (
        rows[r][0] is not None, rows[r][0] or 0, L.digest((rows[r][1] or "").encode())))
    for r in order:
        for i, x in enumerate(split[r][1]):
            first.setdefault(key(x), (rows[r], i))
    out = []
    for r, (i, lines) in enumerate(split):
        kept = [x for j, x in enumerate(lines) if key(x) not in gone
                or (keep == "first" and first[key(x)] == (rows[r], j))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def texts(n=60):
    pool = [" ".join(prose(s, 4)) for s in range(40)] + ["", "  ", "Σ É", "x" * 9000]
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        lines = [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 12))]
        lines = [f" {x.upper()}\r" if rng.random() < 0.3 else x for x in lines]
        out.append((int(i), "\n".join([*lines, f"own {i}", "seen by all"])))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_against_brute_force(spark, keep, broadcast):
    rows = texts() + odd_rows_two()
    df = with_clashes(docs(spark, rows), "digest", "kept", "block", "first").repartition(7)
    assert got(L.dedup_lines(df, 4, keep, broadcast)) == brute(rows, 4, keep)


def odd_rows_two():
    """Null ids, repeated rows, nulls, empty and very long texts with many hits."""
    many = "\n".join(f"line {i % 500}" for i in range(20_000))
    return [(r[0], r[1]) for r in odd_rows()] + [(90 + i, many) for i in range(4)] + [
        (None, "seen by all\nline 3"), (None, None), (7, "\n\n\n"), (7, "\n\n\n")]


def test_whole_table_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows, 10)]
    out = L.op11_line_dedup(spark, SMALL)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert sum(w[2] for w in want) > 0
    assert L.dedup_lines(docs(spark, [])).count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    """Filters far too small call everything a suspect; the result is the same."""
    monkeypatch.setattr(L, "filter_bits", lambda texts: 64)
    rows = texts(30)
    assert got(L.dedup_lines(docs(spark, rows), 3)) == brute(rows, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=8, unique=True), max_size=12),
       st.randoms(use_true_random=False))
def test_merged_filters_hold_every_repeat(groups, rng):
    spread = lambda x: np.uint64(x * 0x9E3779B97F4A7C15 % 2**64)
    count = Counter(x for g in groups for x in g)
    parts = []
    for g in groups:
        b = L.Bloom(1 << 16)
        b.add(np.array([spread(x) for x in g], np.uint64))
        parts.append((b.once, b.twice))
    rng.shuffle(parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [L.merge(parts[i], parts[i + 1])]
    for x, n in count.items():
        one = np.array([spread(x)], np.uint64)
        assert L.Bloom.member(parts[0][0], one)[0]
        assert L.Bloom.member(parts[0][1], one)[0] == (n > 1)  # 31 keys in 65,536 bits
