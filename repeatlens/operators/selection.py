"""Exact order statistics by radix selection, without ordering the rows.

Values become order-preserving 64-bit keys.  A pass counts the rows of the
16-bit digits that follow the prefixes found so far -- for all columns and
ranks at once, combined before the shuffle -- and keeps of each column and
rank the one digit whose running count reaches it, with the least and the
greatest key below it; a rank is found when these are equal.  Money and day
counts need two or three passes.  What a pass shuffles and gathers is bounded
by the digits of the wanted ranks, whatever the rows: 65,536 for each prefix.

Ties may be broken by further keys (strings by their bytes), so that a rank
is a rank among all rows, as in a total order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.session import write_shared

BITS = 16
#: 2**63 as a signed long: turns signed order into unsigned order of the bits.
_FLIP = -(2**63)


@F.pandas_udf(T.LongType())
def double_key(v: pd.Series) -> pd.Series:
    """Longs in the order of doubles (-0.0 = 0.0, NaN last, as in Spark)."""
    x = v.to_numpy(np.float64) + 0.0
    x = np.where(np.isnan(x), np.nan, x)  # one pattern, with a positive sign
    bits = np.abs(x).view(np.int64)
    return pd.Series(np.where(np.signbit(x) & ~np.isnan(x), -bits - 1, bits))


def key_double(key: int) -> float:
    """The double of a ``double_key``."""
    bits = -key - 1 if key < 0 else key
    value = float(np.int64(bits).view(np.float64))
    return -value if key < 0 else value


def _keyed(df: DataFrame, column: str) -> tuple[Column, str]:
    """(order-preserving long or binary, how to turn it back)."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.IntegralType):
        return c.cast("long"), "long"
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10 ** kind.scale)).cast("decimal(38,0)").cast("long"), f"decimal:{kind.scale}"
    if isinstance(kind, (T.FractionalType,)):
        return double_key(c.cast("double")), "double"
    if isinstance(kind, T.StringType):
        return c.cast("binary"), "string"
    raise TypeError(f"{column}: no key for {kind.simpleString()}")


def _digit(key: str, kind: str, i: int) -> Column:
    """The i-th 16 bits from the front; of a string the i-th two bytes, where
    the end comes before all bytes."""
    if kind == "string":
        first, second = (F.conv(F.hex(F.substring(F.col(key), 2 * i + k, 1)), 16, 10).cast("int")
                         for k in (1, 2))
        left = F.octet_length(F.substring(F.col(key), 2 * i + 1, 2))
        return F.when(left == 0, 0).when(left == 1, 1 + first * 257).otherwise(2 + first * 257 + second)
    bits = F.col(key).bitwiseXOR(F.lit(_FLIP))
    return F.shiftrightunsigned(bits, 64 - BITS * (i + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _value(key, kind: str):
    if kind == "double":
        return key_double(key)
    if kind.startswith("decimal:"):
        return key / 10 ** int(kind[8:])
    return bytes(key).decode() if kind == "string" else int(key)


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[int] | Sequence[float]],
                     ties: Mapping[str, str] | None = None) -> dict[str, dict]:
    """Of each column of ``wanted``: ``n`` (rows with a value) and for each of
    its probabilities or 1-based ranks (ints) the value there.

    A probability p stands for position p * (n - 1) and is interpolated
    linearly between its neighbours, as numpy and pandas do; a rank gives the
    value, with ``ties`` the pair (value, tie).  Null values are left out; of
    a column without values all results are None.  Ranks beyond n are None.
    """
    ties = ties or {}
    names = list(wanted)
    kinds, cols = {}, []
    for i, c in enumerate(names):
        key, kind = _keyed(df, c)
        parts, kinds[c] = [F.when(F.col(c).isNotNull(), key).alias(f"k{i}")], [kind]
        if c in ties:
            tie, tie_kind = _keyed(df, ties[c])
            parts.append(F.when(F.col(c).isNotNull(), tie).alias(f"t{i}"))
            kinds[c].append(tie_kind)
        cols += parts
    keyed = write_shared(df.select(cols), "selection-keys")
    n = keyed.agg(*[F.count(f"k{i}").alias(c) for i, c in enumerate(names)]).first().asDict()
    ranks: dict[str, set[int]] = {}
    for c in names:
        ranks[c] = set()
        for w in wanted[c]:
            if isinstance(w, int):
                ranks[c].add(w)
            else:
                h = w * (n[c] - 1)
                ranks[c] |= {math.floor(h) + 1, math.ceil(h) + 1}
        ranks[c] = {r for r in ranks[c] if 1 <= r <= n[c]}
    found = _select_all(keyed, names, kinds, ranks)
    out: dict[str, dict] = {}
    for c in names:
        out[c] = {"n": n[c]}
        for w in wanted[c]:
            if isinstance(w, int):
                pair = found[c].get(w)
                out[c][w] = pair if pair is None or c in ties else pair[0]
            elif not n[c]:
                out[c][w] = None
            else:
                h = w * (n[c] - 1)
                lo, hi = (float(found[c][r][0]) for r in (math.floor(h) + 1, math.ceil(h) + 1))
                out[c][w] = lo + (hi - lo) * (h - math.floor(h))
    return out


def _select_all(keyed: DataFrame, names: list[str], kinds: dict, ranks: dict) -> dict[str, dict]:
    """{column: {rank: (value[, tie])}}: all columns' passes run as one job each."""
    found: dict[str, dict] = {c: {} for c in names}
    # open searches: (column, word, digits so far, fixed words) -> {rank: rows before}
    open_: dict[tuple, dict[int, int]] = {
        (c, 0, (), ()): {r: 0 for r in ranks[c]} for c in names if ranks[c]}
    while open_:
        searches = list(open_)
        cells = []
        for s, (c, word, digits, fixed) in enumerate(searches):
            i, kind = names.index(c), kinds[c]
            keys = [f"k{i}", f"t{i}"][:len(kind)]
            here = F.col(keys[word]).isNotNull() if word == 0 else F.lit(True)
            for k, v in zip(keys, fixed):
                here &= F.col(k) == F.lit(v)
            for at, digit in enumerate(digits):
                here &= _digit(keys[word], kind[word], at) == digit
            text = kind[word] == "string"
            cells.append(F.when(here, F.struct(
                F.lit(s).alias("s"), _digit(keys[word], kind[word], len(digits)).alias("d"),
                (F.lit(None).cast("long") if text else F.col(keys[word])).alias("long"),
                (F.col(keys[word]) if text else F.lit(None).cast("binary")).alias("text"))))
        rows = keyed.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        counts = rows.groupBy("s", "d").agg(
            F.count(F.lit(1)).alias("n"), F.min("long").alias("lo"), F.max("long").alias("hi"),
            F.min("text").alias("tlo"), F.max("text").alias("thi"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("d")
                               .rowsBetween(Window.unboundedPreceding, 0))
        goals = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r - before).cast("long").alias("r"))
                          for s, key in enumerate(searches) for r, before in open_[key].items()])
        hits = counts.withColumn("upto", upto).filter(F.exists(
            goals, lambda g: (g["s"] == F.col("s")) & (g["r"] <= F.col("upto"))
            & (g["r"] > F.col("upto") - F.col("n")))).collect()  # one row per open rank at most
        now: dict[tuple, dict[int, int]] = {}
        for row in hits:
            c, word, digits, fixed = key = searches[row.s]
            start = row.upto - row.n
            mine = {r: before + start for r, before in open_[key].items()
                    if start < r - before <= row.upto}
            text = kinds[c][word] == "string"
            lo, hi = (bytes(row.tlo), bytes(row.thi)) if text else (row.lo, row.hi)
            if lo != hi:
                now.setdefault((c, word, (*digits, row.d), fixed), {}).update(mine)
            elif word + 1 < len(kinds[c]):  # equal values: on to the tie
                now.setdefault((c, word + 1, (), (*fixed, lo)), {}).update(mine)
            else:
                value = tuple(_value(v, k) for v, k in zip((*fixed, lo), kinds[c]))
                found[c].update(dict.fromkeys(mine, value))
        open_ = now
    return found


def selected_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """(p, quantile) rows of a numeric column; null without values."""
    got = order_statistics(df, {value: list(probs)})[value]
    return df.sparkSession.createDataFrame([(float(p), got[p]) for p in probs], "p double, quantile double")
