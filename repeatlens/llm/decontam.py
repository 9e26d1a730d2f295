"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel
distance.

Texts and items are lower-cased and their white space is collapsed.  An item
of m characters may occur in a text with up to k = floor(rate * m) edits; cut
into k + 1 pieces, at least one piece must then occur unchanged, at about its
own place.  An automaton over all pieces reads each text once; where a piece
hits, the item is aligned to the text around it with Myers' algorithm (Python
integers serve as bit vectors of any length), which decides.

Only the benchmark is broadcast, in groups of about ``GROUP_BYTES``; a larger
benchmark makes more groups, held one after another, each of which reads the
texts once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm.common import flat_map, table
from repeatlens.session import write_shared

ERROR_RATE = 0.08
GROUP_BYTES = 2 << 20


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """``item`` in ``parts`` contiguous pieces of nearly equal length, by start."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, anchored: bool) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a substring
    of ``text`` (to a prefix if ``anchored``) and the first end that has it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, carry = full, 0, m, int(anchored)
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best[0]:
                best = (score, j)
        ph = (ph << 1) | carry
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


class Matcher:
    """Finds the items of a benchmark in normalized texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalize(text)
            if not norm:
                continue
            k = int(rate * len(norm))
            self.items.append((item_id, norm, k, _masks(norm), _masks(norm[::-1])))
            for at, piece in pieces(norm, k + 1):
                found.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def _align(self, text: str, n: int, slot: int) -> tuple[int, int, int] | None:
        """Best (distance, start, end) of item n whose start lies near a slot
        of 2k + 1 characters."""
        _, norm, k, masks, back = self.items[n]
        m = len(norm)
        lo = max(0, slot * (2 * k + 1) - k)
        hi = slot * (2 * k + 1) + 4 * k + m  # the last start, the item and k insertions
        window = text[lo:hi]
        at = window.find(norm)
        if at >= 0:
            dist, start, end = 0, lo + at, lo + at + m
        else:
            dist, end = myers(masks, m, window, False)
            if dist > k:
                return None
            _, length = myers(back, m, window[:end][::-1], True)
            start, end = lo + end - length, lo + end
        if not k and (text[start - 1:start].strip() or text[end:end + 1].strip()):
            return None  # an item too short for errors must stand as words
        return dist, start, end

    def find(self, text: str | None):
        """(item_id, distance, start_word, end_word) of each item found, at
        its best place; words count from 0, end exclusive."""
        if not self.items:
            return
        norm = normalize(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (length, uses) in self.automaton.iter(norm):
            for n, at in uses:
                k = self.items[n][2]
                slot = max(0, last + 1 - length - at) // (2 * k + 1)
                if (n, slot) in tried or best.get(n, (1,))[0] == 0:
                    continue
                tried.add((n, slot))
                hit = self._align(norm, n, slot)
                if hit and (n not in best or hit < best[n]):
                    best[n] = hit
        for n, (dist, start, end) in sorted(best.items()):
            yield (self.items[n][0], dist, norm.count(" ", 0, start),
                   norm.count(" ", 0, end) + 1)


def _groups(benchmark: DataFrame, group_bytes: int) -> list[DataFrame]:
    """The benchmark's items dealt into groups of about ``group_bytes``."""
    bench = benchmark.select("item_id", "text").filter("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // group_bytes) or 1
    if n == 1:
        return [bench]
    dealt = write_shared(bench.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
                         .repartition("g"), "benchmark")
    return [dealt.filter(F.col("g") == g).drop("g") for g in range(n)]


def _each_group(benchmark: DataFrame, group_bytes: int, work) -> Iterator[DataFrame]:
    """``work(items)`` of each group's broadcast items.  Of several groups one
    is held at a time, by the driver and by the tasks: its result is written
    before the next one is read."""
    spark = benchmark.sparkSession
    groups = _groups(benchmark, group_bytes)
    for group in groups:
        items = spark.sparkContext.broadcast([tuple(r) for r in group.collect()])
        out = work(items)
        if len(groups) > 1:
            out = write_shared(out, "leaks")
            items.destroy()
        yield out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
               id_col: str = "doc_id", text_col: str = "text",
               group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): one row per input
    row and item found in it, at the place with the fewest edits.

    Null and empty texts and items give no row; repeated rows and items give
    theirs each.  Other columns are ignored.  An empty side, an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("distance", T.LongType()),
        T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])

    def work(items):
        def make():
            matcher = Matcher(items.value, rate)
            return lambda i, text: ((i, *hit) for hit in matcher.find(text))

        return flat_map(rows, make, schema)

    return reduce(DataFrame.union, _each_group(benchmark, group_bytes, work))


def drop_leaky(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
               text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with their columns.

    Rows are dropped where they are read; nothing is shuffled.
    """
    at = docs.columns.index(text_col)
    left = docs

    def work(items):
        def run(batches):
            matcher = Matcher(items.value, rate)
            for batch in batches:
                for i in range(0, batch.num_rows, 128):
                    part = batch.slice(i, 128)
                    clean = [next(matcher.find(t.as_py()), None) is None for t in part.column(at)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return left.mapInArrow(run, left.schema)

    for left in _each_group(benchmark, group_bytes, work):
        pass  # the next group reads what this one left
    return left


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
