"""ML-8, ML-9: cross-validated random forest and gradient boosting over binned rows.

The trees are those of ``pyspark.ml``: the same candidate splits, bootstrap
counts, feature subsets, gains and leaves (``tests/test_trees.py`` compares
the scores).  What differs is how the sums are made.  The library walks each
row through all trees at once and adds to all their nodes, megabytes apart;
here a task takes one tree after another over columns of one-byte bins, and
the folds of the boosting share their passes.  Rows stay on the executors in
``data``'s partitions; a level costs one job, its sums meet by tree (forest)
or in groups of tasks (boosting), and the driver holds splits only.
"""

from __future__ import annotations

import glob
import os
import pickle
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of bootstrap counts.
BLOCK = 131_072
#: Up to so many rows a task adds every dummy's both bins; beyond, one bin is the rest.
WIDE_ROWS = 20_000
#: Beyond, columns share their sums up to so many bins together ...
FUSED = 128
#: ... and are added in blocks of so many rows, which a core's cache holds.
CACHED = 32_768
#: Boosting's sums of more tasks than this meet in so many groups before the driver.
GROUPS = 16
#: Candidate splits come from so many rows at least (the library's number).
SAMPLE = 10_000
NO_GAIN = -np.finfo(float).max
EPS = 2.0 ** -52
BASE, COUNTS = -1, 1_000_000  # kinds of stored rows, beside one for each set of splits


@dataclass(frozen=True)
class Slots:
    """The feature vector: ``numeric`` columns, then dummies by groups of
    which at most one is 1."""

    numeric: int
    groups: tuple[int, ...]

    @property
    def size(self) -> int:
        return self.numeric + sum(self.groups)

    def dummy(self, slot: int) -> tuple[int, int]:
        """(group, code) of a dummy's slot."""
        at = slot - self.numeric
        for g, n in enumerate(self.groups):
            if at < n:
                return g, at + 1
            at -= n
        raise IndexError(slot)


# -- the library's random numbers ---------------------------------------------

class JavaRandom:
    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next32(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        v = self.s >> 16
        return v - (1 << 32) if v >> 31 else v

    def next_long(self) -> int:
        return ((self._next32() << 32) + self._next32()) & ((1 << 64) - 1)


def _murmur(words: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    def rot(x, n):
        return (x << np.uint32(n)) | (x >> np.uint32(32 - n))

    h = seed
    for k in words:
        k = rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4 * len(words))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


class XorShift:
    """``XORShiftRandom`` for many seeds at once."""

    def __init__(self, seeds):
        seeds = np.atleast_1d(np.asarray(seeds, np.uint64))
        zero = np.zeros(len(seeds), np.uint32)
        words = [(seeds >> np.uint64(32)).astype(np.uint32).byteswap(),
                 seeds.astype(np.uint32).byteswap()]
        low = _murmur(words, zero + np.uint32(0x3C074A61))
        self.s = (_murmur(words, low).astype(np.uint64) << np.uint64(32)) | low

    def next(self, bits: int) -> np.ndarray:
        s = self.s
        s = s ^ (s << np.uint64(21))
        s = s ^ (s >> np.uint64(35))
        self.s = s = s ^ (s << np.uint64(4))
        return s & np.uint64((1 << bits) - 1)

    def next_double(self) -> np.ndarray:
        high = self.next(26) << np.uint64(27)
        return (high + self.next(27)).astype(np.float64) * 2.0 ** -53


def feature_subsets(seeds: list[int], size: int, k: int) -> np.ndarray:
    """For each seed the library's reservoir of ``k`` out of ``size`` slots."""
    rand, out = XorShift(seeds), np.tile(np.arange(k), (len(seeds), 1))
    for item in range(k, size):
        at = (rand.next_double() * (item + 1)).astype(np.int64)
        hit = np.flatnonzero(at < k)
        out[hit, at[hit]] = item
    return out


def map_order(spark, keys: list[int]) -> list[int]:
    """The order in which a Scala map of these keys is walked."""
    jvm = spark.sparkContext._jvm
    built = jvm.scala.collection.mutable.HashMap()
    for k in keys:
        built.put(k, k)
    maps = getattr(getattr(jvm.scala.collection.immutable, "Map$"), "MODULE$")
    found = getattr(maps, "from")(built).keysIterator()
    return [found.next() for _ in keys]


# -- candidate splits and bins ------------------------------------------------

def thresholds(values: np.ndarray, weights: np.ndarray, expected: float, bins: int) -> np.ndarray:
    """Candidate splits of one column from sampled rows, of which the zeros are
    taken as what is missing to the ``expected`` weight."""
    held = values != 0
    found, at = np.unique(values[held], return_inverse=True)
    if not len(found):
        return np.zeros(0)
    counts = np.bincount(at, weights=weights[held], minlength=len(found))
    zeros = expected - counts.sum()
    if zeros > 2.220446049250313e-16 * held.sum() * 100:
        pos = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, pos, 0.0), np.insert(counts, pos, zeros)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = expected / bins
    out, now, target = [], counts[0], stride
    for i in range(1, len(found)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def split_sample(train: DataFrame, rows: int, seed: int, bins: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(fraction, vectors, labels) of the rows that candidate splits come from:
    the library's own sample, drawn by its sampler."""
    spark, needed = train.sparkSession, max(bins * bins, SAMPLE)
    fraction = needed / rows if needed < rows else 1.0
    rows_of = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    if fraction < 1:
        draw = int(XorShift([seed]).next(32)[0])
        jrdd = rows_of._jdf.javaRDD().sample(False, fraction, draw - (1 << 32) if draw >> 31 else draw)
        rows_of = DataFrame(spark._jsparkSession.createDataFrame(jrdd, rows_of._jdf.schema()), spark)
    got = rows_of.toArrow().combine_chunks()
    n = got.num_rows
    x = np.array(got["x"].combine_chunks().flatten()).reshape(n, -1) if n else np.zeros((0, 0))
    return fraction, x, np.array(got["y"])


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def binned(data: DataFrame, slots: Slots, sets: list[list[np.ndarray]]) -> DataFrame:
    """(part, kind, cells): each partition's rows as columns of bytes, in their
    order: codes of the dummies' groups, label and fold, and bins by ``sets``."""
    if max(len(t) for thr in sets for t in thr) > 255 or max(slots.groups, default=0) > 32_000:
        raise ValueError("more bins or levels than a stored cell holds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: list[np.ndarray] = []
        bins: list[list[np.ndarray]] = [[] for _ in sets]
        for b in batches:
            part = b.column("part")[0].as_py()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, slots.size)
            cells, at = [], slots.numeric
            for n in slots.groups:
                one = x[:, at:at + n]
                cells.append(np.where(one.any(axis=1), one.argmax(axis=1) + 1, 0))
                at += n
            cells += [b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold")]
            base.append(np.array(cells).astype(np.uint16))
            for thr, to in zip(sets, bins):
                to.append(np.array([np.searchsorted(t, x[:, f]) for f, t in enumerate(thr)], np.uint8))
        if base:
            for kind, cells in [(BASE, base), *enumerate(bins)]:
                yield _batch(part=pa.array([part], pa.int32()), kind=pa.array([kind], pa.int32()),
                             cells=pa.array([np.concatenate(cells, axis=1).tobytes()], pa.binary()))

    return data.select(vector_to_array("features").alias("x"), "label", "fold",
                       F.spark_partition_id().alias("part")).mapInArrow(
        run, "part int, kind int, cells binary")


def bootstrap_counts(spark, sizes: list[int], trees: int, seed: int) -> DataFrame:
    """(part, kind, cells): how often each tree draws each row, in blocks of
    rows by trees.  The library seeds partition i's Poisson numbers with
    seed + i + 1; its own generator draws them here on the executors."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    poisson = jvm.org.apache.spark.mllib.random.PoissonGenerator(1.0)
    rdd = jvm.org.apache.spark.mllib.rdd.RandomVectorRDD(sc, len(sizes), trees, len(sizes), poisson, seed)
    parts = rdd.partitions()
    for i, n in enumerate(sizes):
        parts[i] = jvm.org.apache.spark.mllib.rdd.RandomRDDPartition(i, n, poisson, seed + i + 1)
    kind = jvm.org.apache.spark.sql.Encoders.udt(jvm.org.apache.spark.mllib.linalg.VectorUDT())
    drawn = DataFrame(spark._jsparkSession.createDataset(rdd, kind), spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BLOCK * trees, np.uint8)
        at = block = part = 0

        def out():
            cells = np.ascontiguousarray(held[:at].reshape(-1, trees).T).tobytes()
            return _batch(part=pa.array([part], pa.int32()), kind=pa.array([COUNTS + block], pa.int32()),
                          cells=pa.array([cells], pa.binary()))

        for b in batches:
            part = b.column("part")[0].as_py()
            v = b.column("n").flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            while len(v):
                n = min(len(v), len(held) - at)
                held[at:at + n] = v[:n]
                at, v = at + n, v[n:]
                if at == len(held):
                    yield out()
                    block, at = block + 1, 0
        if at:
            yield out()

    return drawn.select(vector_to_array("value").alias("n"), F.spark_partition_id().alias("part")).mapInArrow(
        run, "part int, kind int, cells binary")


# -- trees --------------------------------------------------------------------

class Forest:
    """Splits and leaves of ``n`` trees; the children of node i are 2i and 2i + 1."""

    def __init__(self, n: int, depth: int):
        shape = (n, 2 ** (depth + 1))
        self.slot = np.full(shape, -1, np.int32)   # -1: no split
        self.cut = np.zeros(shape, np.int16)       # bins up to here go left ...
        self.flip = np.zeros(shape, bool)          # ... or right
        self.value = np.zeros(shape)


class Columns:
    """A partition's rows for one fold's bins."""

    def __init__(self, slots: Slots, base: np.ndarray, bins: np.ndarray):
        self.slots, self.base, self.bins = slots, base, bins

    def rows(self, idx: np.ndarray) -> Columns:
        return Columns(self.slots, np.take(self.base, idx, axis=1), np.take(self.bins, idx, axis=1))

    def cells(self, slot: int, idx=None) -> np.ndarray:
        if slot < self.slots.numeric:
            return self.bins[slot] if idx is None else self.bins[slot].take(idx)
        g, code = self.slots.dummy(slot)
        return (self.base[g] if idx is None else self.base[g].take(idx)) == code

    def walk(self, f: Forest, t: int, node: int, idx: np.ndarray, wanted, visit) -> None:
        """``visit(node, rows)`` for each reached node that has no split."""
        slot = f.slot[t, node]
        if slot < 0:
            visit(node, idx)
            return
        cells = self.cells(slot, idx)
        if slot < self.slots.numeric:
            go = cells <= int(f.cut[t, node])
        else:
            go = cells if f.flip[t, node] else ~cells
        for child, left in ((2 * node, True), (2 * node + 1, False)):
            if wanted is None or child in wanted:
                self.walk(f, t, child, idx.take(np.flatnonzero(go if left else ~go)), wanted, visit)


def _gini(s: np.ndarray) -> np.ndarray:
    total = s[..., 0] + s[..., 1]
    a, b = s[..., 0] / total, s[..., 1] / total
    return np.where(total == 0, 0.0, 1.0 - a * a - b * b)


def _variance(s: np.ndarray) -> np.ndarray:
    return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


@dataclass
class Split:
    slot: int
    cut: int
    flip: bool
    gain: float
    parent: np.ndarray
    left: np.ndarray
    right: np.ndarray


def best_split(cells, parent, numeric: int, gini: bool, least: int, weights=None) -> Split | None:
    """The split of the greatest gain, the first of equal ones; ``cells`` are
    (slot, sums by bin) in the order in which the slots count.  Sums are
    weights by class (``gini``) or count, sum and sum of squares."""
    impurity = _gini if gini else _variance
    weight = (lambda s: s[..., 0] + s[..., 1]) if gini else (lambda s: s[..., 0])
    drawn = (lambda s: np.rint(s / weights).sum(axis=-1)) if gini else (lambda s: s[..., 0])
    cells = [(slot, h) for slot, h in cells if len(h) > 1]
    if not cells:
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        # dummies all at once: the bin of the smaller mean goes left
        ones = [i for i, (slot, _) in enumerate(cells) if slot >= numeric]
        sides: dict[int, tuple] = {}
        if ones:
            h = np.array([cells[i][1] for i in ones])
            mid = np.where(weight(h) == 0, np.inf, h[..., 1] if gini else h[..., 1] / h[..., 0])
            flip = mid[:, 1] < mid[:, 0]
            lefts = np.where(flip[:, None], h[:, 1], h[:, 0])
            rights = h[:, 0] + h[:, 1] - lefts
            sides = {i: (lefts[n:n + 1], rights[n:n + 1], bool(flip[n])) for n, i in enumerate(ones)}
        for i, (slot, h) in enumerate(cells):
            if slot < numeric:
                cum = np.cumsum(h, axis=0)
                sides[i] = cum[:-1], cum[-1] - cum[:-1], False
        if parent is None:
            parent = sides[0][0][0] + sides[0][1][0]
        own = float(impurity(parent))

        def gains(left, right):
            total = weight(left) + weight(right)
            gain = (own - weight(left) / total * impurity(left)) - weight(right) / total * impurity(right)
            valid = (drawn(left) >= least) & (drawn(right) >= least) & (gain >= 0)
            return np.where(valid, gain, NO_GAIN)

        found = {i: g for i, g in zip(ones, gains(lefts, rights)[:, None])} if ones else {}
        best = None
        for i, (slot, _) in enumerate(cells):
            left, right, flip = sides[i]
            gain = found[i] if i in found else gains(left, right)
            at = int(np.argmax(gain))
            if best is None or gain[at] > best.gain:
                best = Split(slot, at, flip, float(gain[at]), parent, left[at], right[at])
    return best


def _bins(slots: Slots, thr: list[np.ndarray]) -> np.ndarray:
    return np.array([len(t) + 1 for t in thr] + [2] * (slots.size - slots.numeric))


def _read(batches: Iterator[pa.RecordBatch], slots: Slots):
    """Rows by part: (part, kind, bytes as columns)."""
    for b in batches:
        for part, kind, cells in zip(*[b.column(c) for c in range(3)]):
            kind, raw = kind.as_py(), np.frombuffer(cells.as_buffer(), np.uint8)
            if kind == BASE:
                raw = raw.view(np.uint16).reshape(len(slots.groups) + 2, -1)
            elif kind < COUNTS:
                raw = raw.reshape(slots.numeric, -1) if slots.numeric else raw.reshape(0, 0)
            yield part.as_py(), kind, raw


# -- random forest ------------------------------------------------------------

def fit_forest(stored: DataFrame, slots: Slots, thr: list[np.ndarray], fold: int, kind: int,
               weights: np.ndarray, est) -> Forest:
    """The forest that ``est`` fits on the rows outside ``fold``."""
    spark, trees, depth = stored.sparkSession, est.getNumTrees(), est.getMaxDepth()
    least, k = est.getMinInstancesPerNode(), int(np.ceil(np.sqrt(slots.size)))
    nbins = _bins(slots, thr)
    rows = stored.filter(F.col("kind").isin(BASE, kind) | (F.col("kind") >= COUNTS))
    forest = Forest(trees, depth)
    sums = [dict() for _ in range(trees)]      # class weights by node
    rand = JavaRandom(est.getSeed())
    stack = [(t, 1) for t in range(trees)]
    room, tasks = est.getMaxMemoryInMB() * 1024 * 1024, rows.rdd.getNumPartitions()
    while stack:
        # the library's choice of the nodes of a pass
        draws = JavaRandom(0)
        draws.s = rand.s
        subsets = feature_subsets([draws.next_long() for _ in stack], slots.size, min(k, slots.size))
        group: dict[int, dict[int, np.ndarray]] = {}
        used = 0
        for (t, node), subset in zip(reversed(list(stack)), subsets):
            rand.next_long()
            size = int(nbins[subset].sum()) * 2 * 8
            if used and used + size > room:
                break
            stack.pop()
            group.setdefault(t, {})[node] = subset
            used += size
        found = _forest_level(rows, tasks, slots, nbins, forest, group, sums, fold, weights, least)
        for t in map_order(spark, list(group)):
            for node in group[t]:
                s = found.get((t, node))
                if s is None:
                    sums[t].setdefault(node, np.zeros(2))
                    continue
                sums[t][node] = s.parent
                level = node.bit_length() - 1
                if s.gain <= 0 or level == depth:
                    continue
                forest.slot[t, node], forest.cut[t, node], forest.flip[t, node] = s.slot, s.cut, s.flip
                for child, own in ((2 * node, s.left), (2 * node + 1, s.right)):
                    sums[t][child] = own
                    if level + 1 < depth and abs(float(_gini(own))) >= EPS:
                        stack.append((t, child))
    for t in range(trees):
        _prune(forest, t, 1, sums[t])
    return forest


def _prune(f: Forest, t: int, node: int, sums: dict) -> None:
    """Leaves get their share of class 1; two leaves of one class become one."""
    if f.slot[t, node] >= 0:
        kids = (2 * node, 2 * node + 1)
        for c in kids:
            _prune(f, t, c, sums)
        if all(f.slot[t, c] < 0 for c in kids) and len({bool(sums[c][1] > sums[c][0]) for c in kids}) == 1:
            f.slot[t, node] = -1
    if f.slot[t, node] < 0:
        total = sums[node].sum()
        f.value[t, node] = sums[node][1] / total if total else 0.0


def _forest_level(rows: DataFrame, tasks: int, slots: Slots, nbins: np.ndarray, forest: Forest, group: dict,
                  sums: list, fold: int, weights: np.ndarray, least: int) -> dict:
    """{(tree, node): best split} for the nodes in ``group``."""
    parents = {t: {n: sums[t].get(n) for n in nodes} for t, nodes in group.items()}
    wanted = {t: {n >> up for n in nodes for up in range(n.bit_length())} for t, nodes in group.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: {n: [np.zeros(2 * nbins[s]) for s in subset] for n, subset in nodes.items()}
                for t, nodes in group.items()}
        base = cols = None
        seen = False
        for _, kind, raw in _read(batches, slots):
            if kind == BASE:
                base, at = raw, 0
            elif kind < COUNTS:
                train = np.flatnonzero(base[-1] != fold)
                cols = Columns(slots, base, raw).rows(train)
            else:
                counts = raw.reshape(len(forest.slot), -1)
                n = min(counts.shape[1], cols.base.shape[1] - at)
                if n <= 0:
                    continue
                seen = True
                block = Columns(slots, cols.base[:, at:at + n], cols.bins[:, at:at + n])
                at += n
                # (bin, class) as one number
                y, wide = block.base[-2], n <= WIDE_ROWS
                y2 = y.astype(np.uint8) if 2 * nbins.max() <= 256 else y
                num2, code2, wy = block.bins.astype(y2.dtype) * 2 + y2, block.base * 2 + y, weights[y]
                for t, nodes in group.items():
                    w = counts[t, :n] * wy

                    def visit(node, idx, nodes=nodes, to=held[t], w=w, y=y, block=block, num2=num2, code2=code2, wide=wide):
                        if node in nodes:
                            _class_sums(block, nodes[node], to[node], idx, w.take(idx), y, num2, code2, wide)

                    block.walk(forest, t, 1, np.flatnonzero(counts[t, :n] != 0), wanted[t], visit)
        if seen:
            for t, nodes in held.items():
                flat = np.concatenate([h for hs in nodes.values() for h in hs])
                yield _batch(tree=pa.array([t], pa.int32()), part=pa.array([TaskContext.get().partitionId()], pa.int32()),
                             sums=pa.array([flat.tobytes()], pa.binary()))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for t, v in zip(b.column("tree").to_pylist(), b.column("sums")):
                h = np.frombuffer(v.as_buffer())
                total[t] = total[t] + h if t in total else h
        for t, flat in total.items():
            at, out = 0, []
            for n, subset in group[t].items():
                cells = []
                for s in subset:
                    cells.append((int(s), flat[at:at + 2 * nbins[s]].reshape(-1, 2)))
                    at += 2 * nbins[s]
                s = best_split(cells, parents[t][n], slots.numeric, True, least, weights)
                if s is not None:
                    out.append([n, s.slot, s.cut, s.flip, s.gain, *s.parent, *s.left, *s.right])
            yield _batch(tree=pa.array([t], pa.int32()),
                         found=pa.array([np.array(out, np.float64).tobytes()], pa.binary()))

    parts = rows.mapInArrow(add, "tree int, part int, sums binary")
    if tasks > 1:
        # in the order of the parts: the same sums whoever came first
        parts = parts.repartition(min(tasks, len(group)), "tree").sortWithinPartitions("tree", "part")
    out = {}
    for r in parts.mapInArrow(choose, "tree int, found binary").collect():
        for v in np.frombuffer(bytes(r.found)).reshape(-1, 11):
            out[r.tree, int(v[0])] = Split(int(v[1]), int(v[2]), bool(v[3]), v[4], v[5:7], v[7:9], v[9:11])
    return out


def _class_sums(cols: Columns, subset, to: list[np.ndarray], idx: np.ndarray, w: np.ndarray,
                y: np.ndarray, num2: np.ndarray, code2: np.ndarray, wide: bool) -> None:
    """Adds the weights of rows ``idx`` by (bin, class) of each slot."""
    groups: dict[int, np.ndarray] = {}
    for s, h in zip(subset, to):
        if s < cols.slots.numeric:
            h += np.bincount(num2[s].take(idx), w, len(h))
        elif wide:
            h += np.bincount(cols.cells(s, idx) * np.uint16(2) + y.take(idx), w, len(h))
        else:
            g, code = cols.slots.dummy(s)
            if g not in groups:
                groups[g] = np.bincount(code2[g].take(idx), w, 2 * cols.slots.groups[g] + 2).reshape(-1, 2)
            one = groups[g][code]
            h[2:] += one
            h[:2] += groups[g].sum(axis=0) - one


def forest_scores(stored: DataFrame, slots: Slots, forest: Forest, fold: int, kind: int) -> DataFrame:
    """(label, rawPrediction) of the fold's rows: the trees' votes for class 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        for _, k, raw in _read(batches, slots):
            if k == BASE:
                base = raw
                continue
            cols = Columns(slots, base, raw).rows(np.flatnonzero(base[-1] == fold))
            n = cols.base.shape[1]
            votes = np.zeros(n)
            for t in range(len(forest.slot)):
                def visit(node, idx, t=t):
                    votes[idx] += forest.value[t, node]

                cols.walk(forest, t, 1, np.arange(n), None, visit)
            yield _batch(label=pa.array(cols.base[-2].astype(float)), rawPrediction=pa.array(votes))

    rows = stored.filter(F.col("kind").isin(BASE, kind))
    return rows.mapInArrow(run, "label double, rawPrediction double")


# -- gradient boosting --------------------------------------------------------

class Boosting:
    """Boosted trees of all folds, grown together: one job for each level.

    The margins of a partition's rows by the trees so far are kept in a file
    of the executor, in the application's own folder there; where the file is
    missing they are made anew from the trees."""

    def __init__(self, stored: DataFrame, slots: Slots, sets: list[list[np.ndarray]], kinds: list[int], est):
        self.rows = stored.filter(F.col("kind").isin(BASE, *kinds))
        self.slots, self.kinds = slots, list(kinds)
        self.nbins = [_bins(slots, thr) for thr in sets]
        self.depth, self.step, self.least = est.getMaxDepth(), est.getStepSize(), est.getMinInstancesPerNode()
        self.trees: list[bytes] = []           # one a round, pickled: a tree for each fold
        self.run = f"repeatlens-boost-{uuid.uuid4().hex}"
        self.tasks = self.rows.rdd.getNumPartitions()

    def _reader(self, done: int):
        """A function from batches to (part, columns of each fold, margins by ``done`` trees)."""
        slots, kinds, run, step = self.slots, self.kinds, self.run, self.step
        trees = self.trees[:done]

        def name(part: int, n: int) -> str:
            return os.path.join(SparkFiles.getRootDirectory(), f"{run}-{part}-{n}.npy")

        def margins(part: int, folds: list[Columns], keep: bool) -> np.ndarray:
            have, f = 0, None
            for n in (done, done - 1):
                if n > 0 and os.path.exists(name(part, n)):
                    try:
                        have, f = n, np.load(name(part, n))
                        break
                    except (OSError, ValueError):
                        continue
            if f is None:
                f = np.zeros((len(folds), folds[0].base.shape[1]))
            every = np.arange(f.shape[1])
            for m in range(have, done):
                tree = pickle.loads(trees[m])
                for k, cols in enumerate(folds):
                    def visit(node, idx, tree=tree, rate=step if m else 1.0, k=k):
                        f[k, idx] += tree.value[k, node] * rate

                    cols.walk(tree, k, 1, every, None, visit)
            if keep and have < done:
                fresh = f"{name(part, done)}.{uuid.uuid4().hex}"
                with open(fresh, "wb") as to:
                    np.save(to, f)
                os.replace(fresh, name(part, done))
                for old in glob.glob(glob.escape(os.path.join(SparkFiles.getRootDirectory(), f"{run}-{part}-")) + "*.npy"):
                    if old != name(part, done):
                        os.unlink(old)
            return f

        def read(batches, keep=True):
            held: dict[int, dict[int, np.ndarray]] = {}
            for part, kind, raw in _read(batches, slots):
                got = held.setdefault(part, {})
                got[kind] = raw
                if len(got) == len(kinds) + 1:
                    folds = [Columns(slots, got[BASE], got[k]) for k in kinds]
                    yield part, folds, margins(part, folds, keep)
                    del held[part]
                    if not keep:
                        for old in glob.glob(glob.escape(os.path.join(SparkFiles.getRootDirectory(), f"{run}-{part}-")) + "*.npy"):
                            os.unlink(old)

        return read

    def grow(self, rounds: int) -> None:
        for m in range(rounds):
            tree = Forest(len(self.kinds), self.depth)
            sums = [dict() for _ in self.kinds]
            front = {k: [1] for k in range(len(self.kinds))}
            while front:
                found = self._level(tree, front, m)
                nxt: dict[int, list[int]] = {}
                for k, nodes in front.items():
                    for node in nodes:
                        cells = found[k, node]
                        s = best_split(cells, sums[k].get(node), self.slots.numeric, False, self.least)
                        if s is None:  # no slot can split
                            sums[k].setdefault(node, cells[0][1].sum(axis=0))
                            continue
                        sums[k][node] = s.parent
                        level = node.bit_length() - 1
                        if s.gain <= 0 or level == self.depth:
                            continue
                        tree.slot[k, node], tree.cut[k, node], tree.flip[k, node] = s.slot, s.cut, s.flip
                        for child, own in ((2 * node, s.left), (2 * node + 1, s.right)):
                            sums[k][child] = own
                            with np.errstate(divide="ignore", invalid="ignore"):
                                if level + 1 < self.depth and abs(float(_variance(own))) >= EPS:
                                    nxt.setdefault(k, []).append(child)
                front = nxt
            for k, nodes in enumerate(sums):
                for node, s in nodes.items():
                    tree.value[k, node] = s[1] / s[0] if s[0] else 0.0
            self.trees.append(pickle.dumps(tree))

    def _level(self, tree: Forest, front: dict[int, list[int]], done: int) -> dict:
        """{(fold, node): [(slot, sums by bin)]} of the rows outside the fold."""
        slots, nbins, read = self.slots, self.nbins, self._reader(done)
        spans = {k: len(nodes) * int(nbins[k].sum()) * 3 for k, nodes in front.items()}
        size = sum(spans.values())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            part = -1
            for part, folds, f in read(batches):
                at = 0
                for k, nodes in front.items():
                    train = np.flatnonzero(folds[k].base[-1] != k)
                    cols = folds[k].rows(train)
                    y = cols.base[-2] * 2.0 - 1.0
                    exp = library_exp if len(y) <= WIDE_ROWS else np.exp
                    g = y if done == 0 else 4.0 * y / (1.0 + exp(2.0 * y * f[k].take(train)))
                    total[at:at + spans[k]] += _fold_sums(cols, nbins[k], tree, k, nodes, g).ravel()
                    at += spans[k]
            if part >= 0:
                yield _batch(part=pa.array([part], pa.int32()), sums=pa.array([total.tobytes()], pa.binary()))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(size), -1
            for b in batches:
                for p, v in zip(b.column("part").to_pylist(), b.column("sums")):
                    total, part = total + np.frombuffer(v.as_buffer()), p
            if part >= 0:
                yield _batch(part=pa.array([part], pa.int32()), sums=pa.array([total.tobytes()], pa.binary()))

        parts = self.rows.mapInArrow(add, "part int, sums binary")
        if self.tasks > GROUPS:
            parts = parts.repartition(GROUPS, F.col("part")).sortWithinPartitions("part").mapInArrow(
                meet, "part int, sums binary")
        total = np.zeros(size)
        for r in sorted(parts.collect()):
            total = total + np.frombuffer(bytes(r.sums))
        out, at = {}, 0
        for k, nodes in front.items():
            h = total[at:at + spans[k]].reshape(len(nodes), -1, 3)
            at += spans[k]
            ends = np.cumsum(nbins[k])
            for i, node in enumerate(nodes):
                out[k, node] = [(s, h[i, e - n:e]) for s, (e, n) in enumerate(zip(ends, nbins[k]))]
        return out

    def scores(self) -> list[DataFrame]:
        """(label, rawPrediction) of each fold's rows; the kept margins go."""
        read = self._reader(len(self.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, folds, f in read(batches, keep=False):
                for k, cols in enumerate(folds):
                    rows = np.flatnonzero(cols.base[-1] == k)
                    yield _batch(fold=pa.array(np.full(len(rows), k, np.int32)),
                                 label=pa.array(cols.base[-2].take(rows).astype(float)),
                                 rawPrediction=pa.array(f[k].take(rows)))

        from repeatlens.session import write_shared

        every = write_shared(self.rows.mapInArrow(run, "fold int, label double, rawPrediction double"), "boosted")
        return [every.filter(F.col("fold") == k) for k in range(len(self.kinds))]


def library_exp(x: np.ndarray) -> np.ndarray:
    """``StrictMath.exp`` (fdlibm) to the last bit, for numbers far from overflow;
    equal gains fall as in the library only where the targets are the same."""
    a = np.abs(x)
    k = np.where(a > 0.34657359027997264, np.where(a < 1.0397207708399179, np.sign(x), np.trunc(
        1.44269504088896338700e+00 * x + np.copysign(0.5, x))), 0.0)
    hi, lo = x - k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
    r = hi - lo
    t = r * r
    c = r - t * (1.66666666666666019037e-01 + t * (-2.77777777770155933842e-03 + t * (
        6.61375632143793436117e-05 + t * (-1.65339022054652515390e-06 + t * 4.13813679705723846039e-08))))
    y = np.where(k == 0, 1.0 - ((r * c) / (c - 2.0) - r), 1.0 - ((lo - (r * c) / (2.0 - c)) - hi))
    return np.ldexp(y, k.astype(int))


def _fused(widths: list[int]) -> list[list[int]]:
    """Columns in sets whose bins together number at most ``FUSED``."""
    out, room = [], 0
    for c in sorted(range(len(widths)), key=lambda c: widths[c]):
        if out and room >= widths[c]:
            out[-1].append(c)
            room //= widths[c]
        else:
            out.append([c])
            room = FUSED // widths[c]
    return out


def _fold_sums(cols: Columns, nbins: np.ndarray, tree: Forest, k: int, nodes: list[int],
               g: np.ndarray) -> np.ndarray:
    """[node, bin of any slot, (count, sum, sum of squares)] of targets ``g``."""
    slots, n = cols.slots, len(g)
    at = {node: i for i, node in enumerate(nodes)}
    where = np.full(n, len(nodes), np.int64)       # rows of no node: the last place

    def visit(node, idx):
        if node in at:
            where[idx] = at[node]

    cols.walk(tree, k, 1, np.arange(n), None, visit)
    q = g * g

    def sums(cells: np.ndarray, width: int, where=where, g=g, q=q) -> np.ndarray:
        key = where * width
        key += cells
        size = (len(nodes) + 1) * width
        h = [np.bincount(key, minlength=size), np.bincount(key, g, size), np.bincount(key, q, size)]
        return np.stack(h, axis=-1).astype(float).reshape(-1, width, 3)[:-1]

    if n <= WIDE_ROWS:
        return np.concatenate([sums(cols.cells(s), nbins[s]) for s in range(slots.size)], axis=1)
    # numeric slots, then codes of groups; columns of few bins share their sums
    columns = [*cols.bins, *cols.base[:len(slots.groups)]]
    widths = [*map(int, nbins[:slots.numeric]), *(size + 1 for size in slots.groups)]
    single: list[np.ndarray] = [np.zeros(0)] * len(columns)
    for fused in _fused(widths):
        own = [widths[c] for c in fused]
        total = np.zeros((len(nodes), int(np.prod(own)), 3))
        for a in range(0, n, CACHED):
            b = slice(a, a + CACHED)
            cells = columns[fused[0]][b].astype(np.uint16)
            for c in fused[1:]:
                cells *= widths[c]
                cells += columns[c][b]
            total += sums(cells, total.shape[1], where[b], g[b], q[b])
        cube = total.reshape(len(nodes), *own, 3)
        for i, c in enumerate(fused):
            single[c] = cube.sum(axis=tuple(1 + o for o in range(len(own)) if o != i))
    out = single[:slots.numeric]
    for h in single[slots.numeric:]:
        whole = h.sum(axis=1)
        out += [np.stack([whole - h[:, j], h[:, j]], axis=1) for j in range(1, h.shape[1])]
    return np.concatenate(out, axis=1)


# -- cross-validation ---------------------------------------------------------

def cross_validate_trees(forest, boosting, data: DataFrame, slots: Slots, folds: int, evaluator,
                         parallelism: int) -> tuple[list[float], list[float]]:
    """Fold scores of the two estimators on the ``fold`` column: (label, fold,
    features) in ``data``, class weights for the forest alone.  Every training
    fold must hold both classes, labelled 0 and 1."""
    spark = data.sparkSession
    sizes = {(r.fold, r.label): r.n for r in data.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    weights, sets = [], []
    pool = ThreadPoolExecutor(max_workers=max(1, parallelism))

    def candidates(k: int):
        n = [sum(v for (f, y), v in sizes.items() if f != k and y == c) for c in (0.0, 1.0)]
        total = n[0] + n[1]
        w = np.array([float(total) / (2.0 * c) for c in n])
        out, drawn = [], {}
        for est in (forest, boosting):
            most = min(est.getMaxBins(), total)
            key = est.getSeed(), most
            if key not in drawn:
                drawn[key] = split_sample(data.filter(F.col("fold") != k), total, *key)
            fraction, x, y = drawn[key]
            own = w[y.astype(int)] if est is forest else np.ones(len(y))
            whole = float(w @ n) if est is forest else float(total)
            out.append([thresholds(x[:, f], own, fraction * whole, most) for f in range(slots.numeric)])
        return w, out

    with pool:
        for w, (a, b) in pool.map(inheritable_thread_target(spark)(candidates), range(folds)):
            weights.append(w)
            sets.append((a, b))
        thr = [s[0] for s in sets] + [s[1] for s in sets]
        base = binned(data, slots, thr).persist()
        try:
            boost = Boosting(base, slots, thr[folds:], list(range(folds, 2 * folds)), boosting)
            boost.grow(boosting.getMaxIter())
            boosted = [float(evaluator.evaluate(s)) for s in boost.scores()]
            held = {(r.part): np.frombuffer(bytes(r.folds), np.int64) for r in _part_sizes(base, slots, folds).collect()}
            parts = base.rdd.getNumPartitions()
            most = [int(held[i].max()) if i in held else 0 for i in range(parts)]
            stored = base.filter(F.col("kind") < folds).union(
                bootstrap_counts(spark, most, forest.getNumTrees(), forest.getSeed()))
            stored = stored.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").persist()

            def fit_one(k: int) -> float:
                f = fit_forest(stored, slots, thr[k], k, k, weights[k], forest)
                return float(evaluator.evaluate(forest_scores(stored, slots, f, k, k)))

            try:
                stored.count()
                grown = list(pool.map(inheritable_thread_target(spark)(fit_one), range(folds)))
            finally:
                stored.unpersist()
        finally:
            base.unpersist()
    return grown, boosted


def _part_sizes(base: DataFrame, slots: Slots, folds: int) -> DataFrame:
    """(part, rows outside each fold as int64 bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, raw in _read(batches, slots):
            n = np.bincount(raw[-1], minlength=folds)
            yield _batch(part=pa.array([part], pa.int32()), folds=pa.array(
                [(raw.shape[1] - n[:folds]).astype(np.int64).tobytes()], pa.binary()))

    return base.filter(F.col("kind") == BASE).mapInArrow(run, "part int, folds binary")
