"""Secret scans: regular expressions find candidates, corpus-wide ownership
tells widely copied examples from live-looking credentials.

Candidates of a text are found inside its row with built-in functions (where
a match lies follows from the lengths of the pieces between the matches).
Only their hashes leave the row: grouped by hash, distinct repositories and
owners are counted, and a value that at least ``EXAMPLE_OWNERS`` owners in as
many repositories have is an example.  The counts join back on the hash.  No
text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import let, table
from repeatlens.session import write_shared

#: Kinds in the order of the span lists; pattern; the group
#: that holds the value; the value's least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # runs are maximal either way; with {16,} the short ones are never listed
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "opaque": (r"[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")
#: The method's own kind: long words that mix digits, capitals and small
#: letters and overlap no base span; only live ones are reported.
MIXED = (r"[0-9].*[0-9].*[0-9]", r"[A-Z].*[A-Z]", r"[a-z].*[a-z]")
EXAMPLE_OWNERS = 3
BLOCK = 256


def _running(steps: Column) -> Column:
    """Running sums of an array of ints, in blocks so that long arrays stay
    near linear."""
    def sums(a: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")),
            lambda s: s["out"])

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(steps) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
        return let(sums(totals, F.lit(0)), lambda ends: F.flatten(F.transform(
            parts, lambda p, i: sums(p, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))))

    return let(blocks, joined)


def _found(text: Column, kind: str, number: int) -> Column:
    """array<struct<start, kind, end, value>>: the matches that pass."""
    pattern, group, least = KINDS[kind]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def spans(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(m)).alias("gap"), m.alias("hit"))
        # [gap, length] steps in one list: every second sum is a match's end
        steps = F.flatten(F.transform(pairs, lambda p: F.array(p["gap"], F.length(p["hit"]))))
        return let(_running(steps), lambda at: F.transform(m, lambda hit, i: F.struct(
            F.get(at, i * 2).alias("start"), F.lit(number).alias("kind"),
            F.get(at, i * 2 + 1).alias("end"),
            (F.regexp_extract(hit, pattern, group) if group else hit).alias("value"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) == 0, none).otherwise(
        F.filter(spans(m), lambda s: F.length(s["value"]) >= least)))


def candidates(text: Column) -> Column:
    """All candidates of a text (null: none), base and own, by start and kind;
    values as hashes."""
    def all_of(t: Column) -> Column:
        return F.struct(
            F.concat(*(_found(t, k, i) for i, k in enumerate(BASE))).alias("base"),
            F.filter(_found(t, "opaque", len(BASE)), lambda s: F.rlike(s["value"], F.lit(MIXED[0]))
                     & F.rlike(s["value"], F.lit(MIXED[1]))
                     & F.rlike(s["value"], F.lit(MIXED[2]))).alias("own"))

    def apart(c: Column) -> Column:
        own = F.filter(c["own"], lambda s: ~F.exists(
            c["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.concat(c["base"], own))

    hashed = let(let(F.coalesce(text, F.lit("")), all_of), apart)
    return F.transform(hashed, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.sha2(s["value"], 256).alias("hash")))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of (hash, repo, owner) rows."""
    once = found.select("hash", "repo", "owner").distinct()
    repos = once.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = once.select("hash", "owner").distinct().groupBy("hash").agg(
        F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def judged_spans(rows: DataFrame) -> DataFrame:
    """(rid, judged) for rows (rid, repo, owner, spans) that have spans; judged:
    their spans by start and kind, with ``live``."""
    each = (rows.filter(F.size("spans") > 0)
            .select("rid", "repo", "owner", F.explode("spans").alias("s"))
            .select("rid", "repo", "owner", "s.*"))
    common = ownership(each).filter(
        f"n_owners >= {EXAMPLE_OWNERS} and n_repos >= {EXAMPLE_OWNERS}").select(
        "hash", F.lit(False).alias("live"))
    return (each.join(common, "hash", "left").groupBy("rid").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", F.coalesce("live", F.lit(True)).alias("live"))))
        .alias("judged")))


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         owner_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, judged (the spans reported, each with
    start, kind number, end and live; code points, end exclusive).

    A document is a repository, ``owner_col`` its owner (null: one owner '').
    Null and empty texts have no spans.  Repeated rows of one id count as one
    repository and get a row each.  Other columns are ignored.  Empty input,
    empty result.
    """
    rows = write_shared(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        candidates(F.col(text_col)).alias("spans")), "candidates")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return (rows.select("rid", F.col("repo").alias("doc_id"))
            .join(judged_spans(rows), "rid", "left")
            .select("doc_id", F.filter(F.coalesce("judged", none), lambda s: (
                s["kind"] < len(BASE)) | s["live"]).alias("judged")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           owner_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with live spans replaced by ``mask``; examples stay.

    Overlapping spans become one mask.  Texts without candidates, null and
    empty ones included, pass as they are and are not shuffled.
    """
    spans = "_s_spans"
    rows = write_shared(docs.withColumns({
        "_s_rid": F.monotonically_increasing_id(), spans: candidates(F.col(text_col))}), "scanned")
    plain = rows.filter(F.size(spans) == 0).select(*docs.columns)
    marked = rows.filter(F.size(spans) > 0)
    judged = judged_spans(rows.select(
        F.col("_s_rid").alias("rid"), F.col(id_col).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.col(spans).alias("spans"))).withColumnsRenamed({"rid": "_s_rid", "judged": "_s_judged"})

    def cut(text: Column, live: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                F.lit(mask)).alias("out"))).otherwise(F.struct(
                    F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(live, start, step, lambda acc: F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    live = F.filter(F.col("_s_judged"), lambda s: s["live"])
    clean = (marked.join(judged, "_s_rid")
             .withColumn(text_col, cut(F.col(text_col), live)).select(*docs.columns))
    return plain.unionByName(clean)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    j = F.col("judged")

    def n(test) -> Column:
        return F.size(F.filter(j, test)).cast("long")

    def of_kind(i: int) -> Column:
        return n(lambda s: s["kind"] == i)

    base = F.filter(j, lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", *(of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(j).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"), n(lambda s: ~s["live"]).alias("n_example"))


def _sql_spans(kind: str, number: int) -> str:
    pattern, group, least = KINDS[kind]
    # RE2 would also match two letters outside ASCII under (?i)
    pattern = pattern.replace(
        "(?i:password|passwd|secret|token|api_?key)", "|".join(
            "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
            for w in ("password", "passwd", "secret", "token", "api_?key"))).replace("'", "''")
    value = f"regexp_extract(hit, '{pattern}', {group})" if group else "hit"
    return rf"""
    SELECT rid, gap_sum + hit_sum - length(hit) AS start, {number} AS kind,
           gap_sum + hit_sum AS "end", {value} AS value
    FROM (SELECT rid, hit, sum(length(gap)) OVER w AS gap_sum, sum(length(hit)) OVER w AS hit_sum
          FROM (SELECT rid, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit,
                       unnest(gaps[1:len(hits)]) AS gap
                FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS hits,
                             string_split_regex(t, '{pattern}') AS gaps FROM docs)
                WHERE len(hits) > 0)
          WINDOW w AS (PARTITION BY rid ORDER BY i))
    WHERE length({value}) >= {least}"""


def oracle() -> str:
    """DuckDB SQL for ``op5_secret_scans``."""
    base = " UNION ALL ".join(_sql_spans(k, i) for i, k in enumerate(BASE))
    mixed = " AND ".join(f"regexp_matches(value, '{m}')" for m in MIXED)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"""string_agg({names}[kind + 1] || ':' || start || ':' || "end", ','
                          ORDER BY start, kind, "end")"""
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner,
                     coalesce(text, '') AS t FROM documents),
  base AS ({base}),
  own AS (SELECT * FROM ({_sql_spans("opaque", len(BASE))}) o
          WHERE {mixed} AND NOT EXISTS (
            SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o."end" AND o.start < b."end")),
  spans AS (SELECT *, sha256(value) AS hash FROM (FROM base UNION ALL FROM own)),
  owners AS (SELECT hash, count(DISTINCT owner) >= {EXAMPLE_OWNERS}
                          AND count(DISTINCT doc_id) >= {EXAMPLE_OWNERS} AS common
             FROM spans JOIN docs USING (rid) GROUP BY hash),
  judged AS (SELECT * FROM spans JOIN owners USING (hash) WHERE kind < {len(BASE)} OR NOT common),
  by_doc AS (SELECT rid, {counts}, {text} FILTER (kind < {len(BASE)}) AS base, {text} AS spans,
                    count(*) FILTER (NOT common) AS n_live, count(*) FILTER (common) AS n_example
             FROM judged GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN by_doc USING (rid)"""
