"""Quality rules with thresholds learned per language and source.

Fixed part: a text fails with fewer than ``MIN_WORDS`` words or when more
than ``MAX_REPEAT`` percent of its words lie in repeated five-word windows.

Adaptive part: each metric of a document (integers, so that every engine
and every order of summation gives the same result) is counted in buckets
of at most 1/16 relative width.  Those counts are a quantile sketch that
merges by addition: one map-side aggregation builds it for each (language,
source), and summing it again gives the language's and the corpus's sketch.
A document is rejected where a metric lies beyond its group's upper quartile
by ``FENCE`` interquartile ranges and an absolute slack.  A group of n
documents takes its own thresholds by n parts and the language's, which take
the corpus's likewise, by ``PRIOR`` parts: the say of the wider group fades as
a group grows, and no size switches it off.  Outliers are judged against their own group, so a source of
tables or of code is not measured by the prose of others, and an even group
loses nothing.

Only built-in functions run; a document's windows are compared inside its
own row, so no shuffle carries words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import let, table
from repeatlens.session import write_shared

WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20
FENCE = 3
#: So many documents' weight has the wider group in a group's thresholds.
PRIOR = 100
#: Thresholds of up to this many groups (under 100 bytes each) are broadcast;
#: beyond it the join shuffles both sides and leaves hot groups to be split.
BROADCAST_GROUPS = 50_000

#: metric -> (SQL over the base counts, slack above the fence)
METRICS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 180),
    "word_len": ("word_chars * 100 div greatest(n_words, 1)", 300),
}


def _covered_by_repeats(windows: Column) -> Column:
    """Words inside windows (given as hashes, by start) that occur twice."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(t: Column) -> Column:
        return F.sort_array(F.filter(F.transform(t, lambda e, i: F.when(
            (F.get(t, i - 1)["h"] == e["h"]) | (F.get(t, i + 1)["h"] == e["h"]), e["i"])),
            lambda s: s.isNotNull()))

    reach = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s + WINDOW
        return F.struct((acc["n"] + end - F.greatest(s, acc["end"])).alias("n"), end.alias("end"))

    return let(tagged, lambda t: F.aggregate(starts(t), reach, add, lambda acc: acc["n"]))


def _repeat_words(hashes: Column) -> Column:
    windows = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
    return let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long"))
        .otherwise(_covered_by_repeats(w)))


def base_counts(text: Column) -> Column:
    """Struct of the base counts of a text (null: no words); all long."""
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        return F.struct(
            let(words, lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words)
                .alias("n_repeat_words"))).alias("w"),
            F.length(F.regexp_replace(t, F.lit(NOT_SYMBOL), F.lit(""))).cast("long")
            .alias("n_symbols"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
            .alias("l"))

    return let(F.coalesce(text, F.lit("")), of)


def with_counts(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with the base counts as columns."""
    c = f"{prefix}counts"
    df = df.withColumn(c, base_counts(F.col(text)))
    parts = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols",
             "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words",
             "n_lines": "l.n_lines"}
    return df.withColumns({prefix + k: F.col(f"{c}.{v}") for k, v in parts.items()}).drop(c)


def _bucket(v: Column) -> Column:
    """Buckets of five significant bits: exact below 32, then 1/16 wide at most."""
    e = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def _low(bucket: Column) -> Column:
    return F.call_function("shiftleft", (bucket % 32).cast("long"), F.floor(bucket / 32).cast("int"))


def _high(bucket: Column) -> Column:
    return F.call_function("shiftleft", (bucket % 32 + 1).cast("long"),
                           F.floor(bucket / 32).cast("int")) - 1


def sketches(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): mergeable by summing n."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))
    return (metrics.select("lang", "source", F.explode(pairs).alias("m"))
            .groupBy("lang", "source", F.col("m.metric").alias("metric"),
                     _bucket(F.col("m.v")).alias("bucket"))
            .agg(F.count("*").alias("n")))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its size and, per metric, the highest allowed value."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    ranked = (merged.withColumn("total", F.sum("n").over(w))
              .withColumn("upto", F.sum("n").over(w.orderBy("bucket"))))
    quart = ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("b25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("b75"))
    slack = F.element_at(F.create_map(*(x for m, (_, s) in METRICS.items()
                                        for x in (F.lit(m), F.lit(s)))), F.col("metric"))
    high = _high(F.col("b75"))
    fence = high + FENCE * (high - _low(F.col("b25"))) + slack
    rows = quart.withColumn("fence", fence)
    return rows.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(m) for m in METRICS))


def thresholds(metrics: DataFrame) -> DataFrame:
    """(lang, source, t_<metric>...): the thresholds of each group's documents."""
    sketch = write_shared(sketches(metrics), "sketch")
    own = _fences(sketch, ["lang", "source"])
    lang = _fences(sketch, ["lang"])
    whole = _fences(sketch.withColumn("everything", F.lit(1)), ["everything"]).drop("everything")

    def blended(m: str) -> Column:
        lang = f"((l.total * l.{m} + {PRIOR} * w.{m}) div (l.total + {PRIOR}))"
        return F.expr(f"(o.total * o.{m} + {PRIOR} * {lang}) div (o.total + {PRIOR})").alias(f"t_{m}")

    return (own.alias("o").join(lang.alias("l"), F.col("o.lang") == F.col("l.lang"))
            .join(F.broadcast(whole).alias("w"))  # one row
            .select("o.lang", "o.source", *map(blended, METRICS)))


def _judged(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` (with counts) and two booleans, base_failed and kept."""
    p = prefix
    n = {c: F.col(p + c) for c in ("n_words", "n_repeat_words")}
    metrics = df.select(*(F.col(p + c).alias(c) for c in (
        "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_lines"))).selectExpr(
        "lang", "source", *(f"{sql} as {m}" for m, (sql, _) in METRICS.items()))
    limits = write_shared(thresholds(metrics), "thresholds")
    small = limits.count() <= BROADCAST_GROUPS
    limits = limits.withColumnsRenamed({c: p + c for c in limits.columns})
    joined = df.join(F.broadcast(limits) if small else limits, [p + "lang", p + "source"], "left")
    over = F.lit(False)
    for m, (sql, _) in METRICS.items():
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"):
            sql = sql.replace(c, f"`{p}{c}`")
        over = over | (F.expr(sql) > F.col(f"{p}t_{m}"))
    failed = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEAT * n["n_words"])
    return joined.withColumns({p + "base_failed": failed, p + "kept": ~failed & ~over})


def _keyed(df: DataFrame, prefix: str, lang: str, source: str) -> DataFrame:
    return df.withColumns({prefix + "lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
                           prefix + "source": F.coalesce(F.col(source).cast("string"), F.lit(""))})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, the four base counts, n_lines,
    base_failed and kept.

    Null text: no words, so base_failed.  Null language or source: its own
    group, shared with ''.  Repeated rows are judged alike, each counted in
    the sketches.  Other columns are ignored.  Empty input, empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = with_counts(_keyed(rows, "", "lang", "source"), "text").drop("text")
    out = _judged(write_shared(counted, "counts"), "")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "n_lines", "base_failed", "kept")


def drop_rejected(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    The counts are worked out twice, for the sketches and for the verdicts,
    rather than written with the texts.
    """
    counted = with_counts(_keyed(docs, "_q_", lang_col, source_col), text_col, "_q_")
    judged = _judged(counted, "_q_")
    return judged.filter("_q_kept").select(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("n_lines")


def _sql_fences(keys: str, name: str) -> str:
    group = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    pick = ", ".join(f"max(fence) FILTER (metric = '{m}') AS {m}" for m in METRICS)
    slack = " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s) in METRICS.items())
    edge = "((b{q} % 32 + {up}) << (b{q} // 32)){minus}"
    high, low = edge.format(q=75, up=1, minus=" - 1"), edge.format(q=25, up=0, minus="")
    return f"""
  {name} AS (
    SELECT {group}max(total) AS total, {pick} FROM (
      SELECT *, ({high}) + {FENCE} * (({high}) - ({low})) + CASE metric {slack} END AS fence
      FROM (SELECT {group}metric, max(total) AS total,
                   min(bucket) FILTER (upto * 4 >= total) AS b25,
                   min(bucket) FILTER (upto * 4 >= total * 3) AS b75
            FROM (SELECT *, sum(n) OVER (PARTITION BY {group}metric) AS total,
                         sum(n) OVER (PARTITION BY {group}metric ORDER BY bucket) AS upto
                  FROM (SELECT {group}metric, bucket, count(*) AS n FROM sketch
                        GROUP BY {group}metric, bucket))
            GROUP BY {group}metric)) {by})"""


def oracle() -> str:
    """DuckDB SQL for ``op9_quality_rules``: windows by their words, not hashes."""
    values = {m: sql.replace(" div ", " // ") for m, (sql, _) in METRICS.items()}
    unpivot = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, CAST({v} AS BIGINT) AS v FROM counts"
        for m, v in values.items())
    def limit(m: str) -> str:
        lang = f"((l.total * l.{m} + {PRIOR} * a.{m}) // (l.total + {PRIOR}))"
        return f"(o.total * o.{m} + {PRIOR} * {lang}) // (o.total + {PRIOR})"

    over = " OR ".join(f"{v} > {limit(m)}" for m, v in values.items())
    failed = (f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)")
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang,
           coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
  words AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
  windows AS (
    SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
  twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
                                FROM windows) WHERE c > 1),
  covered AS (SELECT rid, count(DISTINCT i + k) AS n
              FROM (SELECT rid, i, unnest([0, 1, 2, 3, 4]) AS k FROM twice) GROUP BY rid),
  lines AS (SELECT rid, list_filter(string_split(t, chr(10)),
                                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM docs),
  counts AS (
    SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(x) AS BIGINT) AS n_lines
    FROM docs JOIN words USING (rid) JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
  sketch AS (
    SELECT lang, source, metric, e * 32 + (v >> e) AS bucket
    FROM (SELECT *, greatest(length(bin(v)) - 5, 0) AS e FROM ({unpivot}))),
  {_sql_fences('lang, source', 'own')}, {_sql_fences('lang', 'langs')},
  {_sql_fences('', 'everything')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {failed} AS base_failed, NOT {failed} AND NOT ({over}) AS kept
FROM counts c JOIN own o USING (lang, source) JOIN langs l USING (lang)
     CROSS JOIN everything a"""
