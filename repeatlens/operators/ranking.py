"""Global ordering operators that never pull the data into one task.

``Window.orderBy(...)`` without ``partitionBy`` moves every row to a single
partition.  ``ranked_scan`` instead range-partitions on a *total* order
(the caller appends tie keys), sorts inside each partition, numbers rows
locally and adds per-partition offsets.  The offsets frame has one row per
range partition, so the broadcast that carries it is bounded by the
partition count, not by the data.

The range-partitioned, sorted frame is checkpointed (reliable checkpoint
in the session's ``spark.checkpoint.dir``) before it is read twice --
once for per-partition totals, once for local numbering.  Range bounds
come from sampling, so two independent evaluations of the exchange could
cut the data differently; the checkpoint pins one cut, and survives the
loss of executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PID, _LOCAL = "_rl_pid", "_rl_local"


def _cols(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def ranked_scan(df: DataFrame, order_by: Sequence[Column | str], out: str = "row_number",
                weight: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running total of ``weight`` (or of 1 per row,
    i.e. the 1-based global row number) over the total order ``order_by``.

    The result reads from a checkpoint, so any further aggregate over it
    (class sizes, n) is cheap and consistent with the numbering.
    """
    from repeatlens.session import ensure_checkpoint_dir

    cols = _cols(order_by)
    ensure_checkpoint_dir(df.sparkSession)
    # Without a fixed count AQE sizes the range partitions from the data
    # (coalescing only merges adjacent ranges, so the global order holds).
    ranged = (df.repartitionByRange(num_partitions, *cols) if num_partitions
              else df.repartitionByRange(*cols))
    parted = (ranged.sortWithinPartitions(*cols)
              .withColumn(_PID, F.spark_partition_id())
              .checkpoint(eager=True))
    if weight is None:
        # monotonically_increasing_id = (partition << 33) + position, assigned
        # in the sorted iteration order -> local 1-based row number.
        local = parted.withColumn(
            _LOCAL, F.monotonically_increasing_id()
            - F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.lit(1))
        totals = parted.groupBy(_PID).agg(F.count(F.lit(1)).alias("_rl_total"))
    else:
        local = _local_cumsum(parted, weight)
        totals = parted.groupBy(_PID).agg(F.sum(weight).cast("bigint").alias("_rl_total"))
    offsets = totals.select(
        _PID, F.coalesce(F.sum("_rl_total").over(
            Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_rl_offset"))
    return (local.join(F.broadcast(offsets), _PID)
            .withColumn(out, (F.col("_rl_offset") + F.col(_LOCAL)).cast("bigint"))
            .drop(_PID, _LOCAL, "_rl_offset"))


def _local_cumsum(parted: DataFrame, weight: str) -> DataFrame:
    """Inclusive running sum of an integral column inside each sorted partition."""
    schema = T.StructType(parted.schema.fields + [T.StructField(_LOCAL, T.LongType(), False)])

    def run(batches):
        carry = 0
        for pdf in batches:
            c = pdf[weight].fillna(0).astype("int64").cumsum() + carry
            if len(c):
                carry = int(c.iloc[-1])
            yield pdf.assign(**{_LOCAL: c})

    return parted.mapInPandas(run, schema)


def global_row_number(df: DataFrame, order_by: Sequence[Column | str], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number over a total order (ties must be broken by the caller)."""
    return ranked_scan(df, order_by, out=out, num_partitions=num_partitions)


def qcut_ranks(rank: Column | str, n: Column | str, q: int = 5) -> Column:
    """Bin of a unique rank 1..n into q equal-frequency bins (1..q).

    Equals pandas ``qcut(ranks, q)``: edges sit at 1 + k(n-1)/q and bins
    are right-closed, so bin = max(1, ceil(q (r-1) / (n-1))), done in
    integer arithmetic.  ``ntile`` distributes remainders differently.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    nn = F.col(n) if isinstance(n, str) else n
    num = F.lit(q) * (r - 1)
    den = nn - 1
    b = F.when(den > 0, F.floor((num + den - 1) / den))
    return F.when(nn <= 1, F.raise_error(F.lit("qcut: bin edges must be unique (fewer than 2 values)"))) \
        .otherwise(F.greatest(F.lit(1), b).cast("int"))


def quantile_edges(df: DataFrame, value: str, q: int = 5) -> DataFrame:
    """One row with ``e0..eq``: exact linear-interpolated quantile edges.

    Uses Spark's exact ``percentile`` aggregate, whose buffer is a map of
    distinct values -- meant for bounded domains (day counts, small
    integers).  For near-unique values use ``exact_quantiles``.
    """
    probs = [k / q for k in range(q + 1)]
    arr = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs]))
    return df.agg(arr.alias("_e")).select(*[F.col("_e")[k].alias(f"e{k}") for k in range(q + 1)])


def qcut_values(value: Column | str, edges: Sequence[Column], labels: Sequence[int]) -> Column:
    """pandas ``qcut`` on raw values given its edges e0..eq (right-closed bins,
    lowest edge included); raises when edges repeat, as pandas does."""
    v = F.col(value) if isinstance(value, str) else value
    dup = F.lit(False)
    for a, b in zip(edges, edges[1:]):
        dup = dup | (a == b)
    expr = None
    for k, lab in enumerate(labels[:-1], start=1):
        expr = (F.when(v <= edges[k], F.lit(lab)) if expr is None
                else expr.when(v <= edges[k], F.lit(lab)))
    expr = expr.otherwise(F.lit(labels[-1]))
    return F.when(dup, F.raise_error(F.lit("qcut: bin edges must be unique"))).otherwise(expr.cast("int"))


def bounded_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles for a column with a bounded
    domain (day counts, review scores, order counts).

    Rows collapse to a (value, count) histogram with a partial aggregate;
    the running count then runs over the *distinct values* only -- bounded
    by the domain, not by the data -- and one conditional aggregate picks
    the order statistics around each position p*(n-1).  Returns
    (p, quantile) rows.
    """
    v = F.col(value)
    hist = df.filter(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = hist.select(
        "_v",
        F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
        F.sum("_c").over(Window.partitionBy()).alias("_n"))
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        aggs += [F.min(F.when(F.col("_cum") >= F.floor(h) + 1, F.col("_v"))).alias(f"lo{i}"),
                 F.min(F.when(F.col("_cum") >= F.ceil(h) + 1, F.col("_v"))).alias(f"hi{i}"),
                 F.max(h).alias(f"h{i}")]
    row = cum.agg(*aggs)
    items = []
    for i, p in enumerate(probs):
        lo, hi, h = (F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double"), F.col(f"h{i}"))
        items.append(F.struct(F.lit(float(p)).alias("p"),
                              (lo + (hi - lo) * (h - F.floor(h))).alias("quantile")))
    return row.select(F.explode(F.array(*items)).alias("q")).select("q.p", "q.quantile")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], tie: Sequence[str] = (),
                    num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default) of any column.

    Rows are numbered by ``ranked_scan``; the two order statistics around
    each position p*(n-1) are picked with a join against a frame of
    2*len(probs) wanted ranks.  Returns (p, quantile) rows.
    """
    base = df.select(F.col(value).alias("_v"), *tie).filter(F.col("_v").isNotNull())
    numbered = ranked_scan(base, ["_v", *tie], out="_rn", num_partitions=num_partitions)
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    pos = (n.select(F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "_n")
           .withColumn("_h", F.col("p") * (F.col("_n") - 1).cast("double"))
           .withColumn("_lo", F.floor("_h") + 1).withColumn("_hi", F.ceil("_h") + 1))
    want = pos.select("p", F.col("_lo").alias("_rn")).unionByName(pos.select("p", F.col("_hi").alias("_rn")))
    vals = numbered.select("_rn", "_v").join(F.broadcast(want.distinct()), "_rn")
    got = pos.join(vals.groupBy("p").agg(F.min(F.struct("_rn", "_v")).alias("lo"),
                                         F.max(F.struct("_rn", "_v")).alias("hi")), "p")
    lo, hi = F.col("lo._v").cast("double"), F.col("hi._v").cast("double")
    frac = F.col("_h") - F.floor("_h")
    return got.select("p", (lo + (hi - lo) * frac).alias("quantile"))
