"""Conversation prefix trie from double-array tries of shards.

Conversations that begin with the same turns share nodes of one trie; a node
is a sequence of turns (role, text), named by a 128-bit digest chained over
its turns' digests.

1. Each conversation becomes rows of at most ``CHUNK_TURNS`` turn digests
   with the node that the chunk starts from, streamed in order.  The rows are
   range-partitioned by (nodes of the first turns, conversation): a range is
   a *prefix shard*, and a prefix that too many conversations share is cut
   between shards by conversation.
2. A task packs up to ``SHARD_TURNS`` turns at a time into a double-array
   trie (``DoubleArray``): distinct turns get dense ids, BASE and CHECK are
   packed over them, and the conversations traverse the arrays to count the
   members of every node and to sum its subtree.
3. Nodes are merged globally.  A node that only one shard holds has its whole
   subtree there, and the shard's sums are final.  The others -- the *shared
   upper nodes*, among them the root and the path to a chunk that continues
   elsewhere -- take their own counts and those of the final children; sums
   over shared subtrees follow by pointer jumping, in rounds that double the
   height covered.

Text leaves the data with the first projection; what is shuffled are digests.
No task holds more than a shard, and the ids of a node's ending conversations
are hashed as a stream of sorted blobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import stream, table
from repeatlens.session import write_shared

#: Conversations whose ids have the same quotient borrow turns from the first.
FAMILY, MAX_SHARED = 5, 9
#: Turns in a row of the sequences, and in a shard's trie.
CHUNK_TURNS, SHARD_TURNS = 4096, 200_000
#: Shards are cut by the nodes of the first so many turns.
SHARD_DEPTH = 8
#: Shared nodes (24 bytes each) that are broadcast.
BROADCAST_NODES = 500_000
#: Free cells tried for a node with several children before the arrays grow.
TRIES = 64

ROOT = bytes(16)
_EMPTY = hashlib.sha256().hexdigest()

_SEQUENCES = ("path binary, conv_id long, chunk long, start binary, depth long, last boolean, "
              "turns binary, sizes binary")
_PARTS = ("ends boolean, node binary, parent binary, depth long, bytes long, n long, conv_id long, "
          "kids long, leaves long, saved long, parent_conv long, open boolean, ids binary")


def child(node: bytes, turn: bytes) -> bytes:
    """The name of a node's child."""
    return hashlib.blake2b(node + turn, digest_size=16).digest()


class DoubleArray:
    """A static double-array trie over dense ids.

    ``code`` leads from cell s to cell t = base[s] + code if check[t] = s.
    Cells 0 .. roots-1 are roots.  ``base`` may be negative: a parent with one
    child needs a free cell only, so the cells that parents with many children
    leave free are all used.
    """

    def __init__(self, parent: np.ndarray, code: np.ndarray, roots: int):
        """Edges to nodes ``roots``, ``roots + 1``, ..: (parent, code) of each."""
        n = len(parent)
        self.base = np.zeros(roots + n, np.int64)
        self.check = np.full(roots + n, -1, np.int64)
        cell = np.full(roots + n, -1, np.int64)
        cell[:roots] = np.arange(roots)
        used = np.zeros(roots + n, bool)
        used[:roots] = True
        order = np.lexsort((code, parent))
        of, starts = np.unique(parent[order], return_index=True)
        counts = np.diff(np.append(starts, n))
        base = np.zeros(roots + n, np.int64)
        free = roots
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] == 1:
                break
            kids = order[starts[i]:starts[i] + counts[i]]
            codes = code[kids]
            span = int(codes[-1] - codes[0]) + 1
            while free < len(used) and used[free]:
                free += 1
            at = -1
            for c in free + np.flatnonzero(~used[free:free + 4 * TRIES])[:TRIES]:
                if c + span <= len(used) and not used[c + codes - codes[0]].any():
                    at = int(c)
                    break
            if at < 0:
                at = len(used)
                used = np.append(used, np.zeros(span, bool))
            base[of[i]] = at - codes[0]
            cell[roots + kids] = at + codes - codes[0]
            used[at + codes - codes[0]] = True
        one = np.flatnonzero(counts == 1)
        kids = order[starts[one]]
        cells = np.flatnonzero(~used)[:len(one)]
        if len(cells) < len(one):
            cells = np.append(cells, np.arange(len(used), len(used) + len(one) - len(cells)))
        base[of[one]] = cells - code[kids]
        cell[roots + kids] = cells
        size = max(len(used), int(cell.max(initial=-1)) + 1)
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[cell] = base
        self.check[cell[roots:]] = cell[parent]
        self.cell = cell

    def step(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The cells that ``codes`` lead to; -1 where there is no such arc."""
        to = self.base[cells] + codes
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == cells), to, -1)


class Shard:
    """The trie of some chunks of conversations and the sums over its nodes."""

    def __init__(self):
        self.rows: list[tuple] = []  # (conv_id, start, depth, last, turns, sizes)
        self.n = 0

    def add(self, conv_id, start, depth, last, turns, sizes) -> None:
        turns = np.frombuffer(turns, "V16")
        self.rows.append((conv_id, start, depth, last, turns, np.frombuffer(sizes, np.int64)))
        self.n += len(turns) + 1

    def parts(self) -> Iterator[tuple]:
        rows = self.rows
        conv = np.array([r[0] for r in rows], np.int64)
        starts = sorted({r[1] for r in rows})
        where = {s: i for i, s in enumerate(starts)}
        roots = len(starts)
        root = np.array([where[r[1]] for r in rows], np.int64)
        length = np.array([len(r[4]) for r in rows], np.int64)
        offset = np.concatenate([[0], np.cumsum(length)])
        turns = np.concatenate([r[4] for r in rows])
        sizes = np.concatenate([r[5] for r in rows])
        last = np.array([r[3] for r in rows])
        first_depth = np.zeros(roots, np.int64)
        first_depth[root] = [r[2] for r in rows]

        # dense ids in order of depth, so that siblings' ids lie close together
        level = np.arange(len(turns)) - np.repeat(offset[:-1], length)
        names, inverse = np.unique(turns, return_inverse=True)
        by_level = np.lexsort((np.arange(len(turns)), level))
        seen = np.full(len(names), len(turns), np.int64)
        np.minimum.at(seen, inverse[by_level], np.arange(len(turns)))
        dense = np.empty(len(names), np.int64)
        dense[np.argsort(seen)] = np.arange(len(names))
        code = dense[inverse]
        turn_of = np.empty(len(names), "V16")
        turn_of[dense] = names

        # the distinct edges, level by level
        longest = np.argsort(-length, kind="stable")
        parents, codes, levels = [], [], []
        at, made = root.copy(), roots
        live = len(rows)
        for d in range(int(length.max(initial=0))):
            while live and length[longest[live - 1]] <= d:
                live -= 1
            who = longest[:live]
            pair = at[who] * len(names) + code[offset[who] + d]
            edges, to = np.unique(pair, return_inverse=True)
            parents.append(edges // len(names))
            codes.append(edges % len(names))
            levels.append(np.full(len(edges), d, np.int64))
            at[who] = made + to
            made += len(edges)
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        edge = np.concatenate(codes) if codes else np.empty(0, np.int64)
        level_of = np.concatenate(levels) if levels else np.empty(0, np.int64)
        trie = DoubleArray(parent, edge, roots)

        # traversal: all chunks step together, the longest go on
        cells = len(trie.check)
        n, least = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max)
        size, opened = np.zeros(cells, np.int64), np.zeros(cells, bool)
        stand = root.copy()
        np.add.at(n, stand, 1)
        np.minimum.at(least, stand, conv)
        np.logical_or.at(opened, stand, ~last)
        live = len(rows)
        for d in range(int(length.max(initial=0))):
            while live and length[longest[live - 1]] <= d:
                live -= 1
            who = longest[:live]
            place = offset[who] + d
            to = trie.step(stand[who], code[place])
            if (to < 0).any():
                raise AssertionError("a conversation left its trie")
            stand[who] = to
            np.add.at(n, to, 1)
            np.minimum.at(least, to, conv[who])
            np.logical_or.at(opened, to, ~last[who])
            size[to] = sizes[place]

        # subtree sums, deepest level first; names, top level first
        cell = trie.cell
        up = trie.check
        kids, leaves = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        np.add.at(kids, cell[parent], 1)
        leaves[cell] = kids[cell] == 0
        saved = (n - 1) * size
        cuts = np.searchsorted(level_of, np.arange(int(length.max(initial=0)) + 1))
        for d in range(len(cuts) - 2, -1, -1):
            c = cell[roots + cuts[d]:roots + cuts[d + 1]]
            np.add.at(leaves, up[c], leaves[c])
            np.add.at(saved, up[c], saved[c])
        name = np.empty(cells, object)
        name[:roots] = starts
        turn_bytes = turn_of[edge]
        for i, c in enumerate(cell[roots:]):
            name[c] = child(name[up[c]], turn_bytes[i].tobytes())
        top = cell[:roots]
        depth = np.zeros(cells, np.int64)
        depth[top] = first_depth
        for d in range(len(cuts) - 1):
            c = cell[roots + cuts[d]:roots + cuts[d + 1]]
            depth[c] = depth[up[c]] + 1

        for c in cell.tolist():
            if up[c] < 0:
                if name[c] == ROOT and depth[c] == 0:
                    yield (False, ROOT, None, 0, 0, int(n[c]), int(least[c]), 0, 0, 0, None, True, None)
                continue
            yield (False, name[c], name[up[c]], int(depth[c]), int(size[c]), int(n[c]),
                   int(least[c]), int(kids[c]), int(leaves[c]), int(saved[c]), int(least[up[c]]),
                   bool(opened[c]), None)
        ends: dict[int, list[int]] = {}
        for c, i, done in zip(stand.tolist(), conv.tolist(), last.tolist()):
            if done:
                ends.setdefault(c, []).append(i)
        for c, ids in ends.items():  # rows come by ascending conversation within a node
            yield (True, name[c], None, None, None, None, ids[0], None, None, None, None, None,
                   ",".join(map(str, ids)).encode())


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, size): digest and UTF-8 bytes of the text of each
    turn at its place, from 1.  Order: turn (null first), then role and
    digest; null roles and texts are empty; rows without conv_id are no turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").alias("at"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"),
        F.octet_length(text).cast("long").alias("size"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "turn")
    return rows.select("conv_id", F.row_number().over(w).alias("pos"), "turn", "size")


def families(turns: DataFrame) -> DataFrame:
    """``turns`` of the rebuilt conversations: the first h turns of the
    family's first conversation, then the own turns after the first h; with
    h = crc32(decimal conv_id) % 9.  A row of part 0 stands for each
    conversation, also one without turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_SHARED
    convs = turns.filter("pos = 1").select(
        "conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("src"))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MAX_SHARED)).select(
        F.col("conv_id").alias("src"), "pos", "turn", "size")
    return (convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"),
                         F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"))
            .union(convs.join(heads, "src").filter("pos <= h")
                   .select("conv_id", F.lit(1), "pos", "turn", "size"))
            .union(turns.filter(F.col("pos") > h)
                   .select("conv_id", F.lit(2), "pos", "turn", "size")))


def sequences(rows: DataFrame) -> DataFrame:
    """Chunks of the conversations' turns, in order; see ``_SEQUENCES``."""
    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, held = None, None

        def emit(last: bool):
            return (b"".join(held["path"]), conv, held["chunk"], held["start"], held["depth"], last,
                    b"".join(held["turns"]), np.array(held["sizes"], np.int64).tobytes())

        for conv_id, part, turn, size in rows:
            if part == 0:
                if held is not None:
                    yield emit(True)
                conv = conv_id
                held = {"path": [], "chunk": 0, "start": ROOT, "depth": 0, "node": ROOT,
                        "turns": [], "sizes": []}
                continue
            if len(held["turns"]) == CHUNK_TURNS:
                yield emit(False)
                held |= {"chunk": held["chunk"] + 1, "start": held["node"],
                         "depth": held["depth"] + CHUNK_TURNS, "turns": [], "sizes": []}
            held["node"] = child(held["node"], turn)
            if len(held["path"]) < SHARD_DEPTH:
                held["path"].append(held["node"][:4])
            held["turns"].append(turn)
            held["sizes"].append(size)
        if held is not None:
            yield emit(True)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select(
        "conv_id", "part", "turn", "size")
    return stream(ordered, chunks, _SEQUENCES)


def shard_parts(seqs: DataFrame) -> DataFrame:
    """Partial nodes and blobs of ending conversations (``ends``) of all shards."""
    def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
        shard = Shard()
        for row in rows:
            shard.add(*row)
            if shard.n >= SHARD_TURNS:
                yield from shard.parts()
                shard = Shard()
        if shard.n:
            yield from shard.parts()

    ordered = (seqs.repartitionByRange("path", "conv_id")
               .sortWithinPartitions("path", "conv_id", "chunk")
               .select("conv_id", "start", "depth", "last", "turns", "sizes"))
    return stream(ordered, parts, _PARTS)


def _end_hashes(parts: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending conversations, streamed blob after blob."""
    def hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, h = None, None
        for key, ids in rows:
            if key == node:
                h.update(b",")
            else:
                if h is not None:
                    yield node, h.hexdigest()
                node, h = key, hashlib.sha256()
            h.update(ids)
        if h is not None:
            yield node, h.hexdigest()

    blobs = (parts.filter("ends").select("node", "conv_id", "ids")
             .repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ids"))
    return stream(blobs, hashes, "node binary, ends_sha256 string")


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums of ``leaves`` and ``saved`` over the subtrees.

    After round k a node holds the sums of its descendants less than 2**k
    below it and knows its ancestor 2**k above."""
    s = write_shared(shared.select("node", F.col("parent").alias("up"), "leaves", "saved"), "trie-sums")
    while s.filter("up is not null").limit(1).count():
        below = s.filter("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.sum("leaves").alias("l"), F.sum("saved").alias("v"))
        above = s.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        s = write_shared(
            s.join(below, "node", "left").join(above, "up", "left")
            .select("node", F.col("higher").alias("up"),
                    (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                    (F.col("saved") + F.coalesce("v", F.lit(0))).alias("saved")), "trie-sums")
    return s.select("node", "leaves", "saved")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie's nodes over ``rows`` (conv_id, part, pos, turn, size; see
    ``families``): node and parent digest with the columns of the query.

    No rows, no nodes; conversations without turns are members of the root.
    Equal conversations share all nodes and stay members each.
    """
    parts = write_shared(shard_parts(write_shared(sequences(rows), "sequences")), "trie-parts")
    merged = write_shared(
        parts.filter("not ends").groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"),
            F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
            F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.first("parent_conv").alias("parent_conv"),
            ((F.count(F.lit(1)) > 1) | F.max("open")).alias("shared")), "trie-nodes")
    upper = merged.filter("shared").select("node", "parent", "depth", "bytes", "n", "conv_id")
    final = F.when(~F.col("shared"), 1)
    # added up before the join: a node may have a third of all nodes for children
    sums = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("kids"), F.sum(final * F.col("leaves")).alias("l"),
        F.sum(final * F.col("saved")).alias("s"))
    upper = write_shared(upper.join(sums, "node", "left").select(
        "node", "parent", "depth", "n", "conv_id", F.coalesce("kids", F.lit(0)).alias("kids"),
        (F.coalesce("l", F.lit(0)) + F.when(F.col("kids").isNull(), 1).otherwise(0)).alias("leaves"),
        (F.coalesce("s", F.lit(0)) + (F.col("n") - 1) * F.col("bytes")).alias("saved")), "trie-upper")
    whole = upper.drop("leaves", "saved").join(_subtree_sums(upper), "node")
    columns = ["node", "parent", "depth", "n", "conv_id", "kids", "leaves", "saved", "parent_conv"]
    lower = merged.filter("not shared")
    above = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper_conv"))
    if upper.count() <= BROADCAST_NODES:  # else adaptive execution splits hot parents
        above = F.broadcast(above)
    # a final node's parent is final, too, and known by the shard, or it is an upper one
    lower = lower.join(above, "parent", "left").withColumn(
        "parent_conv", F.coalesce("upper_conv", "parent_conv")).select(columns)
    whole = whole.join(above, "parent", "left").withColumnRenamed("upper_conv", "parent_conv")
    nodes = lower.union(whole.select(columns))
    return nodes.join(_end_hashes(parts), "node", "left").select(
        "node", "parent", "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.  Null roles and texts are empty,
    rows without conv_id are left out, repeated rows are turns each, turns of
    equal number stand by role and digest; other columns are ignored."""
    return prefix_trie(families(write_shared(turns_of(conversations), "turns")))


def op12_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII text."""
    bit = ("list_reduce(list_concat([{x}], list_transform(range(8), lambda r: 0::UBIGINT)), "
           "lambda {v}, {w}: xor({v} >> 1, CASE WHEN {v} & 1 = 1 THEN 3988292384::UBIGINT "
           "ELSE 0::UBIGINT END))")
    byte = bit.format(x="xor(acc & 255, ch)", v="b", w="z")
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), "
            f"lambda c: ascii(c)::UBIGINT)), lambda acc, ch: xor(acc >> 8, {byte})), 4294967295::UBIGINT)")


def oracle() -> str:
    """DuckDB SQL of ``op12_conversation_prefix_trie`` (pairs of prefixes: small tables)."""
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''),
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, c - c % {FAMILY} AS src, {crc32_sql("CAST(c AS VARCHAR)")} % {MAX_SHARED} AS h
  FROM (SELECT DISTINCT c FROM t) AS x
), seq AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, strlen(x) AS size,
         length(r) || ':' || length(x) || ':' || r || x AS turn
  FROM (SELECT k.c, 1 AS part, pos, r, x FROM k JOIN t ON t.c = k.src AND pos <= h
        UNION ALL SELECT k.c, 2, pos, r, x FROM k JOIN t ON t.c = k.c AND pos > h) AS u
), paths AS (
  SELECT c, d, size, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS node
  FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM k
), links AS (
  SELECT c, d, size, node, lag(node) OVER w AS parent,
         row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1 AS ends
  FROM paths WINDOW w AS (PARTITION BY c ORDER BY d)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(size) AS size, count(*) AS n,
         min(c) AS c, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ids
  FROM links GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT DISTINCT a.node, b.node AS lower FROM links AS a JOIN links AS b ON a.c = b.c AND b.d >= a.d
), sums AS (
  SELECT below.node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves,
         sum((l.n - 1) * l.size) AS saved
  FROM below JOIN nodes AS l ON l.node = below.lower LEFT JOIN kids ON kids.node = below.lower
  GROUP BY below.node
)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, CAST(p.c AS DOUBLE) AS parent_conv_id,
       CAST(a.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(a.ids, '')) AS ends_sha256
FROM nodes AS a JOIN sums USING (node) LEFT JOIN kids ON kids.node = a.node
LEFT JOIN nodes AS p ON p.node = a.parent
"""
