import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repeatlens.llm import conversation_repair as R
from tests.llm.helpers import SMALL, table, with_clashes

CONV = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """Cheapest and then least edits over all of them; rows: (initial, must_go, truncated)."""
    best = None
    for gaps in product(range(3), repeat=len(rows) + 1):
        for per_row in product("DKR", repeat=len(rows)):
            if any(e != "D" and go for e, (_, go, _) in zip(per_row, rows)):
                continue
            edits = "".join("I" * g + e for g, e in zip(gaps, per_row)) + "I" * gaps[-1]
            cost = sum(4 if e == "D" else 3 for e in edits if e != "K") + sum(
                3 for e, (_, _, cut) in zip(per_row, rows) if e != "D" and cut)
            if best is not None and (cost, edits) >= best:
                continue
            written = [["u", "a"] if e != "K" else [c] for e, c in _written(edits, rows)]
            if any(LEGAL.fullmatch("".join(w)) for w in product(*written)):
                best = cost, edits
    return best


def _written(edits, rows):
    left = iter(rows)
    for e in edits:
        initial = None if e == "I" else next(left)[0]
        if e != "D":
            yield e, initial or "?"


def by_suffix(rows):
    """The same from the end: edits that start alike differ in their rest only."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}

    @lru_cache(None)
    def best(i, state, ins):
        out = []
        if i == len(rows):
            if state in (0, 3):
                out.append((0, ""))
        else:
            initial, go, cut = rows[i]
            c, s = best(i + 1, state, 0)
            out.append((c + 4, "D" + s))
            if not go:
                to = {"s": 1 if state == 0 else None, "u": 2 if state in (0, 1, 3) else None,
                      "a": 3 if state == 2 else None}.get(initial)
                if to:
                    c, s = best(i + 1, to, 0)
                    out.append((c + 3 * cut, "K" + s))
                c, s = best(i + 1, 2 if after[state] == "u" else 3, 0)
                out.append((c + 3 + 3 * cut, "R" + s))
        if ins < 2:
            c, s = best(i, 2 if after[state] == "u" else 3, ins + 1)
            out.append((c + 3, "I" + s))
        return min(out, default=(10**9, ""))

    for i in range(len(rows), -1, -100):
        for state, ins in product(range(4), range(3)):
            best(i, state, ins)
    return best(0, 0, 0)


def search(rows):
    s = R.Survivors()
    out = []
    held = 0
    for initial, go, cut in rows:
        out += s.push(R._STATE.get(initial), go, cut)
        held = max(held, len([n for n in s.at if n]))
    rest, end = s.finish()
    assert len(out) + len(rest) == len(rows)
    return s.least, "".join(out + rest) + end


ROW = st.tuples(st.sampled_from("suax"), st.sampled_from([False] * 4 + [True]), st.booleans())


@settings(max_examples=120, deadline=None)
@given(st.lists(ROW, max_size=4))
def test_search_is_exhaustive(rows):
    rows = [(i, g, c and not g) for i, g, c in rows]
    assert search(rows) == exhaustive(rows) == by_suffix(tuple(rows))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=60))
def test_search_of_longer_conversations(rows):
    rows = [(i, g, c and not g) for i, g, c in rows]
    assert search(rows) == by_suffix(tuple(rows))


def test_memory_holds_unresolved_rows_only():
    s, held = R.Survivors(), 0
    rng = np.random.default_rng(1)
    for n in range(1, 20_001):
        held -= len(s.push([R.S, R.U, R.A, None][rng.integers(0, 4)], rng.random() < 0.1, False)) - 1
        assert n < 100 or held < 100
    # survivors that never meet: rows of another role are all reroled, one way or the other
    s = R.Survivors()
    assert sum(len(s.push(None, False, False)) for _ in range(20_000)) < 10
    assert len(s.finish()[0]) > 19_990


def brute(rows):
    """The contract's row of each conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        convs[c]
        role, text = (" " if v is None else v for v in (role, text))
        n = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        row = (turn is not None, turn or 0, "user" if n == 4 else role, text)
        convs[c] += [row] * (2 if n == 3 else 1)
    out = []
    for c, rs in convs.items():
        rs.sort()
        turns = [r[1] for r in rs if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marks, count = set(), [], [0, 0, 0]
        for _, _, role, text in rs:
            end = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            marks.append((role[:1], fault in (0, 1), fault == 2))
            if fault is not None:
                count[fault] += 1
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit = by_suffix(tuple(marks))
        lines, left, state = [], iter(rs), ""
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            state = row[2][0] if e == "K" else "a" if state == "u" else "u"
            role = row[2] if e == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{row[3] if row else ''}")
        out.append((c, gaps, *count, illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def odd_conversations():
    rng = np.random.default_rng(4)
    roles = ["system", "user", "assistant", "tool", "", None, "usurper"]
    texts = ["Fine.", "cut", "", None, " \n", "Really?  ", "Σ!", "a b c."]
    rows = [(int(rng.integers(0, 60)), None if rng.random() < 0.1 else int(rng.integers(0, 30)),
             roles[rng.integers(0, 7)], texts[rng.integers(0, 8)]) for _ in range(700)]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(3000)]
    rows += [(101, t, "tool", f"row {t}.") for t in range(1500)]
    rows += [(102, t, "user", "the same") for t in range(1500)]
    rows += [(None, 1, "user", "lost"), (103, 9_000_000_000, "user", "x" * 400_000 + ".")]
    rows += [(200 + i, 0, "user", "gone or not.") for i in range(60)]  # some have no row left
    return rows + rows[:20]


def test_against_brute_force(spark):
    rows = odd_conversations()
    df = with_clashes(spark.createDataFrame(rows, CONV), "key", "again", "blank", "there2").repartition(6)
    got = sorted(map(tuple, R.summaries(R.damage(df)).collect()))
    want = brute(rows)
    assert got == want
    assert any(w[7] == "" and w[8] == hashlib.sha256().hexdigest() for w in want)


def test_edits_are_the_audit(spark):
    rows = odd_conversations()
    d = R.damage(spark.createDataFrame(rows, CONV))
    edits = defaultdict(list)
    for r in R.repair(d).collect():
        edits[r.conv_id].append(r)
    for r in R.summaries(d).collect():
        own = sorted(edits[r.conv_id], key=lambda e: e.step)
        assert [e.step for e in own] == list(range(len(own)))
        assert "".join(e.edit for e in own) == r.audit
        kept = [e for e in own if e.edit != "D"]
        assert LEGAL.fullmatch("".join(e.role[0] for e in kept))
        text = "\n".join(f"{e.role}:{e.text}" for e in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_oracle_against_brute_force():
    import duckdb
    rows = [r for r in odd_conversations() if r[0] is None or r[0] not in (100, 101, 102)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(R.oracle()).fetchall()) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a.")]])
def test_empty(spark, rows):
    assert R.summaries(R.damage(spark.createDataFrame(rows, CONV))).count() == 0
    assert R.repair(spark.createDataFrame(rows, CONV)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    out = R.op13_conversation_repair(spark, SMALL)
    assert sorted(map(tuple, out.collect())) == brute(rows)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                           "audit", "repaired_sha256"]
