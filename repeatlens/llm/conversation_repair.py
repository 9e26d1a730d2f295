"""Conversation structure repair with a survivor-coalescence Viterbi search.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?`` and
no row is blank or a duplicate.  Rows are kept (0), get the role user or
assistant (3) or are deleted (4; blank and duplicate rows must be); rows with
empty text and the role user or assistant are inserted anywhere (3); a
truncated row that stays costs 3 more.  Wanted are the cheapest edits and, of
those, the ASCII-least string of their initials K, R, D, I.

The search reads the rows once.  Its states are the initials written last
(none, s, u, a); each state has one *survivor*, the best edits that lead to
it, held as a path of a backpointer tree whose nodes count their children.
A node without children is freed.  Once the root has one child, all
survivors share that edit: it is emitted and the child becomes the root, so
memory holds the unresolved rows only.  Survivors that can no longer win are
dropped (``_SPARE``), else "all deleted so far" would never share an edit.  Ties are decided by the whole
unresolved strings of edits: survivors of one row end in that row's own edit,
so none is a prefix of another, and their order, carried along as ranks, is
the order of all their continuations.

Spark sorts the rows by conversation and turn and marks repeated rows; each
conversation is then read as one stream, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import stream, table
from repeatlens.llm.prefix_trie import crc32_sql

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The states: initials written last.
NONE, S, U, A = range(4)
_STATE = {"s": S, "u": U, "a": A}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\f\r"

#: Where a user or assistant row leads; other initials but a first s are not kept.
_AFTER_KEEP = {S: {NONE: S}, U: {NONE: U, S: U, A: U}, A: {U: A}}
_AFTER_ROLE = {NONE: U, S: U, U: A, A: U}

#: (q, p): whatever follows p can follow q for so much more, by an insertion, by
#: deleting a system row that p would keep, or both.  A survivor that costs
#: more than another and this is never part of the cheapest edits.
_SPARE = {(A, NONE): DELETE, (U, NONE): INSERT + DELETE, (S, NONE): 2 * INSERT, (A, S): 0,
          (U, S): INSERT, (A, U): INSERT, (U, A): INSERT}

_EDITS = "conv_id long, step long, edit string, turn long, role string, text string"
_SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
            "cost long, audit string, repaired_sha256 string")


def _inserts(state: int) -> Iterator[tuple[int, str, int]]:
    """(state, edits, cost) after no to two insertions; a third returns to a state."""
    for n in range(3):
        yield state, "I" * n, n * INSERT
        state = _AFTER_ROLE[state]


def _options(initial: int | None, must_go: bool, truncated: bool):
    """(state before, edits, state after, cost) of a row with the insertions before it."""
    extra = TRUNCATED if truncated else 0
    for p in (NONE, S, U, A):
        for q, ins, cost in _inserts(p):
            yield p, ins + "D", q, cost + DELETE
            if must_go:
                continue
            to = _AFTER_KEEP.get(initial, {}).get(q)
            if to is not None:
                yield p, ins + "K", to, cost + KEEP + extra
            yield p, ins + "R", _AFTER_ROLE[q], cost + REROLE + extra


class _Node:
    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent, edits):
        self.parent, self.edits, self.children = parent, edits, []


class Survivors:
    """The search over one conversation's rows; ``push`` and ``finish`` return
    the edits of rows that are resolved, one string per row, in order."""

    #: (costs and ranks of the survivors, row) -> what follows; few differ
    _known: dict = {}

    def __init__(self):
        self.root = _Node(None, "")
        self.at: list[_Node | None] = [self.root, None, None, None]
        self.costs: tuple = (0, None, None, None)   # less the least
        self.ranks: tuple = (0, None, None, None)
        self.least = 0

    @classmethod
    def _step(cls, costs, ranks, row):
        """New costs, their least, ranks and (state before, edits) of each state."""
        best: list = [None] * 4
        for p, edits, to, cost in _options(*row):
            if costs[p] is not None:
                new = (costs[p] + cost, ranks[p], edits, p)
                if best[to] is None or new < best[to]:
                    best[to] = new
        best = [b and (b if all(best[q] is None or b[0] <= best[q][0] + spare
                                for (q, other), spare in _SPARE.items() if other == p) else None)
                for p, b in enumerate(best)]
        least = min(b[0] for b in best if b)
        order = sorted(b[1:3] for b in best if b)
        return (tuple(b and b[0] - least for b in best), least,
                tuple(b and order.index(b[1:3]) for b in best),
                tuple(b and (b[3], b[2]) for b in best))

    def push(self, initial: int | None, must_go: bool, truncated: bool) -> list[str]:
        key = self.costs, self.ranks, (initial, must_go, truncated)
        step = self._known.get(key)
        if step is None:
            step = self._known[key] = self._step(*key)
        self.costs, least, self.ranks, moves = step
        self.least += least
        old = self.at
        self.at = [None] * 4
        for state, move in enumerate(moves):
            if move:
                parent = old[move[0]]
                node = self.at[state] = _Node(parent, move[1])
                parent.children.append(node)
        for node in old:  # free what no survivor hangs on
            while node is not None and not node.children and node is not self.root:
                parent = node.parent
                parent.children.remove(node)
                node = parent
        out = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out.append(self.root.edits)
        return out

    def finish(self) -> tuple[list[str], str]:
        """The edits of the unresolved rows and the insertions at the end."""
        best = min((cost + more, self.ranks[p], ins, p)
                   for p, cost in enumerate(self.costs) if cost is not None
                   for q, ins, more in _inserts(p) if q in (NONE, A))
        self.least += best[0]
        out, node = [], self.at[best[3]]
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1], best[2]


class Conversation:
    """Faults, search and repaired rows of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.search = Survivors()
        self.waiting: deque = deque()   # unresolved rows
        self.state = NONE               # of the rows written
        self.steps = 0
        self.faults = [0, 0, 0]         # blank, duplicate, truncated
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def _edits(self, edits: str, row) -> Iterator[tuple]:
        """(edit, turn, role, text) of one row's edits."""
        for e in edits:
            self.steps += 1
            if e == "D":
                yield (e, *row)
                continue
            turn, role, text = (None, None, "") if e == "I" else row
            if e == "K":
                self.state = _STATE[role[0]]
            else:
                self.state = _AFTER_ROLE[self.state]
                role = "user" if self.state == U else "assistant"
            yield e, turn, role, text

    def add(self, turn, role, text, blank, truncated, again) -> Iterator[tuple]:
        before, self.before = self.before, (turn, role, text)
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if before is not None:
            self.illegal += before[1][:1] + role[:1] not in _LEGAL
        duplicate = again or before == self.before
        fault = 0 if blank else 1 if duplicate else 2 if truncated else None
        if fault is not None:
            self.faults[fault] += 1
        self.waiting.append((turn, role, text))
        for edits in self.search.push(_STATE.get(role[:1]), fault in (0, 1), fault == 2):
            yield from self._edits(edits, self.waiting.popleft())

    def finish(self) -> Iterator[tuple]:
        edits, at_end = self.search.finish()
        for e in edits:
            yield from self._edits(e, self.waiting.popleft())
        yield from self._edits(at_end, None)

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, edit) for each edit and (conversation, None) at its end."""
    conv = None
    for conv_id, there, *row in rows:
        if conv is None or conv.conv_id != conv_id:
            if conv is not None:
                yield from ((conv, e) for e in conv.finish())
                yield conv, None
            conv = Conversation(conv_id)
        if there:
            yield from ((conv, e) for e in conv.add(*row))
    if conv is not None:
        yield from ((conv, e) for e in conv.finish())
        yield conv, None


def _edit_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    step = -1
    for conv, edit in _conversations(rows):
        step += 1
        if edit is None:
            step = -1
        else:
            yield (conv.conv_id, step, *edit)


def _summary_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    audit, digest, written = [], hashlib.sha256(), False
    for conv, edit in _conversations(rows):
        if edit is not None:
            audit.append(edit[0])
            if edit[0] != "D":
                digest.update(("\n" * written + f"{edit[2]}:{edit[3]}").encode())
                written = True
            continue
        yield (conv.conv_id, conv.gaps(), *conv.faults, conv.illegal, conv.search.least,
               "".join(audit), digest.hexdigest())
        audit, digest, written = [], hashlib.sha256(), False


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` damaged row by row by crc32("conv_id:turn") % 20: 0
    drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes its role user.  Null turns, roles and texts count as one space there
    and null roles and texts become one.

    (conv_id, turn, role, text, there): a dropped row stays as a row that is
    not there, so that its conversation is known.  Rows without conv_id are
    left out.
    """
    blank = F.lit(" ")
    c = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(
        F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(c == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(c == 1, "").when(c == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (c != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(c == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows in order, with their faults; ``again``: an equal row has an
    earlier turn (an equal row of the same turn stands next to it)."""
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("key", F.when(F.col("there"), key))
    repeated = (keyed.filter("there").groupBy("conv_id", "key")
                .agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
                .filter("earliest < latest").drop("latest"))
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    return keyed.join(repeated, ["conv_id", "key"], "left").select(
        "conv_id", "there", "turn", "role", "text", (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(F.col("earliest") < at, F.lit(False)).alias("again")) \
        .repartition("conv_id").sortWithinPartitions(
            "conv_id", F.asc_nulls_first("turn"), "role", "text")


def _prepared(rows: DataFrame) -> DataFrame:
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    return rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        there.alias("there"))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order: conv_id, step (from 0), edit
    (K, R, D or I), the row's turn (null: inserted), role and text after the
    edit (of a deleted row: before).  Without the deleted rows these are the
    repaired conversations.

    ``rows``: conv_id, turn, role, text and, if wanted, ``there`` (false: a
    row that only names its conversation).  Order: turn (null first), then
    role and text; null roles and texts are one space, an empty role is none
    that can be kept, rows without conv_id are left out, repeated rows are
    duplicates.  No rows, no output.
    """
    return stream(_marked(_prepared(rows)), _edit_rows, _EDITS)


def summaries(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of each conversation of ``rows`` (see ``repair``)
    with the SHA-256 of its repaired ``role:text`` lines."""
    return stream(_marked(_prepared(rows)), _summary_rows, _SUMMARY)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return summaries(damage(table(spark, sf_dir, "conversations")))


def oracle() -> str:
    """DuckDB SQL of ``op13_conversation_repair``: the cheapest edits from each
    row on, row by row from the end.  Edits that start from one state and row
    differ in their first letter or lead to one state, so the best of the rest
    is part of the best of all."""
    crc = crc32_sql("conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    space = " || ".join(f"chr({ord(c)})" for c in _SPACE)

    def best(options: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o.cost IS NOT NULL))[1]"

    def option(cost: str, edit: str, rest: str) -> str:
        return f"{{'cost': {cost} + {rest}.cost, 'edits': '{edit}' || {rest}.edits}}"

    extra = f"CASE WHEN fault = 2 THEN {TRUNCATED} ELSE 0 END"
    row = []
    for q in (NONE, S, U, A):
        to = {i: _AFTER_KEEP[s][q] for i, s in _STATE.items() if q in _AFTER_KEEP[s]}
        kept = [option(f"CASE WHEN fault IN (0, 1) OR initial <> '{i}' THEN NULL ELSE {extra} END", "K", f"g{t}")
                for i, t in to.items()]
        row.append(best([option(str(DELETE), "D", f"g{q}"), *kept, option(
            f"CASE WHEN fault IN (0, 1) THEN NULL ELSE {REROLE} + {extra} END", "R",
            f"g{_AFTER_ROLE[q]}")]) + f" AS r{q}")
    gaps = []
    for q in (NONE, S, U, A):
        gaps.append(best([option(str(cost), ins, f"r{to}") for to, ins, cost in _inserts(q)]) + f" AS g{q}")
    ends = ", ".join(best([f"{{'cost': CAST({cost} AS BIGINT), 'edits': '{ins}'}}" for to, ins, cost in _inserts(q)
                           if to in (NONE, A)]) + f" AS g{q}" for q in (NONE, S, U, A))
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {crc} % 20 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), damaged AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE k <> 0
), placed AS (
  SELECT c, turn, r, x, rtrim(x, {space}) AS body, substr(r, 1, 1) AS initial,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, x) AS i
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN body = '' THEN 0 WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 1
                 WHEN substr(body, length(body), 1) NOT IN ('.', '!', '?') THEN 2 END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY i) AS earlier
  FROM placed
), stats AS (
  SELECT k.c, count(m.c) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(CASE WHEN fault = 0 THEN 1 END) AS blank, count(CASE WHEN fault = 1 THEN 1 END) AS duplicate,
         count(CASE WHEN fault = 2 THEN 1 END) AS truncated,
         count(CASE WHEN earlier || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal
  FROM (SELECT DISTINCT c FROM src) AS k LEFT JOIN marked AS m ON m.c = k.c GROUP BY k.c
), dp AS (
  SELECT c, n + 1 AS i, {ends} FROM stats
  UNION ALL
  SELECT c, i, {', '.join(gaps)}
  FROM (SELECT dp.c, m.i, {', '.join(row)} FROM dp JOIN marked AS m ON m.c = dp.c AND m.i = dp.i - 1) AS x
), audits AS (
  SELECT c, g0.cost AS cost, g0.edits AS audit FROM dp WHERE i = 1
), letters AS (
  SELECT c, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i,
         length(replace(substr(audit, 1, p), 'D', '')) AS written
  FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits) AS x
), rows_left AS (
  SELECT l.c, p, e, written, r, x,
         bool_or(written = 1 AND e = 'K' AND initial = 's') OVER (PARTITION BY l.c) AS led
  FROM letters AS l LEFT JOIN marked AS m ON m.c = l.c AND m.i = l.i AND e <> 'I'
  WHERE e <> 'D'
), texts AS (
  SELECT c, string_agg(CASE WHEN e = 'K' THEN r WHEN (written + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1
                            THEN 'user' ELSE 'assistant' END
                       || ':' || CASE WHEN e = 'I' THEN '' ELSE x END, chr(10) ORDER BY p) AS t
  FROM rows_left GROUP BY c
)
SELECT s.c AS conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank,
       CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
       CAST(illegal AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM stats AS s JOIN audits AS a ON a.c = s.c LEFT JOIN texts ON texts.c = s.c
"""
