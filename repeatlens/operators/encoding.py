"""ML-4, ML-5: dummies as sparse (row, slot, value) triples.

The levels of all categorical columns form one dictionary, numbered by a
range-partitioned scan: no level list reaches the driver, and a column with
very many levels costs more partitions, not more memory.  Slots follow the
assembled vector: the numeric columns first, then each categorical column's
levels from last to first without the alphabetically first one, the baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.operators.ranking import ranked_scan


def level_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, level, pos): levels of each column, ``pos`` = 0.. from the
    alphabetically last one on; ``col`` is the column's place in ``columns``.
    Nulls are no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("level"))
                                for i, c in enumerate(columns)]))
    levels = (df.select(pairs.alias("p")).select("p.*").filter(F.col("level").isNotNull()).distinct())
    numbered = ranked_scan(levels, ["col", F.desc("level")], out="rn")
    starts = numbered.groupBy("col").agg(F.min("rn").alias("first"))  # one row per column
    return numbered.join(starts, "col").select("col", "level", (F.col("rn") - F.col("first")).alias("pos"))


def slots(dictionary: DataFrame, numeric: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(slot, feature, col, level) of the assembled vector; numeric slots have
    no col and level.  Windows run over one row per categorical column."""
    sizes = dictionary.groupBy("col").agg((F.count(F.lit(1)) - 1).alias("n"))
    offsets = sizes.select("col", "n", (F.lit(len(numeric)) + F.coalesce(F.sum("n").over(
        Window.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    names = F.array(*[F.lit(c) for c in columns])
    dummies = dictionary.join(offsets, "col").filter("pos < n").select(
        (F.col("offset") + F.col("pos")).cast("int").alias("slot"),
        F.concat(names[F.col("col")], F.lit("_"), F.col("level")).alias("feature"), "col", "level")
    spark = dictionary.sparkSession
    fixed = spark.createDataFrame([(i, c, None, None) for i, c in enumerate(numeric)],
                                  "slot int, feature string, col int, level string")
    return fixed.unionByName(dummies)


def sparse_matrix(df: DataFrame, key: str, numeric: Sequence[str], columns: Sequence[str],
                  slot_table: DataFrame | None = None) -> DataFrame:
    """(key, slot, feature, value) of every non-zero cell.

    A row with a null key or a null numeric cell has no such cell; null and
    baseline levels have none either.  Only the categorical cells are joined
    with the dictionary, which adaptive execution broadcasts where it is small.
    """
    table = slot_table if slot_table is not None else slots(level_dictionary(df, columns), numeric, columns)
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(c).alias("feature"),
                               F.col(c).cast("double").alias("value")) for i, c in enumerate(numeric)])
    fixed = (df.select(key, F.explode(cells).alias("c")).select(key, "c.slot", "c.feature", "c.value")
             .filter("value <> 0"))
    held = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("level"))
                     for i, c in enumerate(columns)])
    dummies = (df.select(key, F.explode(held).alias("h")).select(key, "h.col", "h.level")
               .join(table.filter("col is not null"), ["col", "level"])
               .select(key, "slot", "feature", F.lit(1.0).alias("value")))
    return fixed.unionByName(dummies)


def moments(matrix: DataFrame, slot_table: DataFrame, n: int) -> DataFrame:
    """(slot, feature, mean, std) of ``n`` rows' sparse cells: the scaling of
    ``StandardScaler`` (sample deviation; 0 for one row).  Cells that are not
    there are zeros, so two sums per slot are enough."""
    sums = matrix.groupBy("slot").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = F.lit(float(n))
    s, q = (F.coalesce(c, F.lit(0.0)) for c in ("s", "q"))
    spread = F.greatest(q - s * s / rows, F.lit(0.0))
    return (slot_table.select("slot", "feature").join(sums, "slot", "left")
            .select("slot", "feature", (s / rows).alias("mean"),
                    F.sqrt(F.coalesce(F.try_divide(spread, rows - 1), F.lit(0.0))).alias("std")))
