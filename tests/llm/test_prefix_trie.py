import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from repeatlens.llm import prefix_trie as P
from tests.llm.helpers import SMALL, table, with_clashes

CONV = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Node tuples of the contract, sorted."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role, name), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        src = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        seq = own.get(src, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (
            (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]),
                   leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
                  for n, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n=120):
    """Families with common beginnings, copies, a long conversation and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 12))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"é{rng.integers(0, 3)}"))
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(40) for t in range(15)]
    rows += [(2003, t, "user", f"long {t % 7}") for t in range(700)]
    rows += [(2008, t, "user", f"long {t % 7}") for t in range(650)]
    rows += [(3, None, None, None), (3, None, "user", ""), (4, 0, "user", "tie"), (4, 0, "user", "tie"),
             (4, 0, "user", "tia"), (None, 1, "user", "lost"), (-7, 1, "a", "b"), (-5, 1, "ab", ""),
             (7001, 0, "", "ab"), (7002, 0, "a", "b"), (8000, 1, "user", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("chunk, shard", [(4096, 200_000), (16, 60), (3, 5)])
def test_against_brute_force(spark, monkeypatch, chunk, shard):
    """Also with chunks and shards so small that most nodes are shared."""
    monkeypatch.setattr(P, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(P, "SHARD_TURNS", shard)
    rows = conversations(chunk)
    df = with_clashes(spark.createDataFrame(rows, CONV), "node", "pos", "depth").repartition(5)
    assert got(P.conversation_trie(df)) == brute(rows)


def test_whole_table_and_empty(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    out = P.op12_conversation_prefix_trie(spark, SMALL)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    assert {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    assert got(out) == brute(rows)
    assert P.conversation_trie(spark.createDataFrame([], CONV)).count() == 0


def test_double_array_holds_exactly_its_edges():
    rng = np.random.default_rng(3)
    for _ in range(30):
        roots, n, codes = int(rng.integers(1, 4)), int(rng.integers(0, 200)), int(rng.integers(1, 60))
        edges = {}
        for node in range(roots, roots + n):  # a child of an earlier node by an arc that it lacks
            while True:
                arc = int(rng.integers(0, node)), int(rng.integers(0, codes))
                if arc not in edges:
                    edges[arc] = node
                    break
        parent = np.array([p for p, _ in edges], np.int64)
        code = np.array([c for _, c in edges], np.int64)
        t = P.DoubleArray(parent, code, roots)
        assert len(set(t.cell.tolist())) == roots + n
        for p in range(roots + n):
            to = t.step(np.full(codes, t.cell[p]), np.arange(codes))
            for c in range(codes):
                want = edges.get((p, c))
                assert to[c] == (-1 if want is None else t.cell[want])


def test_single_children_fill_the_cells_that_others_leave():
    parent = np.array([0] * 50 + list(range(1, 51)), np.int64)  # a root of 50, each with one child
    code = np.array([*range(0, 100, 2), *range(50)], np.int64)
    t = P.DoubleArray(parent, code, 1)
    assert len(t.check) <= 102
