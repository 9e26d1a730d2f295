"""MinHash near-duplicates: banding, packed b-bit signatures, exact links.

1. Every text becomes its set of word shingles (``hashing``), a 128-bit name
   of that set, band keys over a few minima each, and the low ``BITS`` bits
   of some hundred minima packed into longs (``Scheme``).
2. Texts with equal sets form a *class*; only classes go on, so a group of
   exact copies costs one row however large it is.
3. Classes that share a band key are candidates.  Each class is first paired
   with its bucket's hub only, the member that meets most others; the packed signatures give a similarity
   corrected for chance collisions, and pairs that are clearly too far apart
   (four standard errors below the threshold) go no further.
4. The remaining pairs are decided on the full sets, in integers.
5. Pairs of one bucket that are still in different components are then
   compared too -- all of them, by finer signatures inside the join --
   so no link that could merge two components is lost.  Pairs within one
   component need no look: they cannot change the result.

A link is missed only if no band of the pair agrees (``1e-6`` or less at the
threshold, see ``tune_bands``) or its b-bit estimate errs by four standard
errors (3e-5 at the threshold itself).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm import hashing
from repeatlens.llm.common import flat_map, table
from repeatlens.llm.components import connected_components
from repeatlens.session import discard, write_shared

BITS = 2


@dataclass(frozen=True)
class Scheme:
    """How texts are compared: link from ``percent`` similarity on; bands of
    ``rows`` minima, enough of them to find a pair at the threshold with
    probability ``recall``; ``minima`` (a multiple of 32, at least the bands'
    need) packed into every text's signature, ``fine`` ones into the
    signatures of the few texts that need a closer look."""

    percent: int = 85
    rows: int = 5
    recall: float = 1 - 1e-6
    minima: int = 128
    fine: int = 1024

    @property
    def bands(self) -> int:
        return hashing.tune_bands(self.percent / 100, self.recall, self.rows)


#: Ids of 16 bytes; see ``where_id``.
BROADCAST_IDS = 500_000

FEATURES = [
    T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("sig", T.ArrayType(T.LongType(), False)),
    T.StructField("keys", T.ArrayType(T.LongType(), False)),
]


def describe(sets: list, scheme: Scheme) -> list[tuple]:
    """(fp, n_shingles, sig, keys) of each set of shingle hashes; an empty
    set has no name, signature or keys."""
    m = hashing.minima_of([s for s in sets if len(s)], scheme.minima)
    sigs = iter(hashing.pack_low_bits(m, BITS))
    keys = iter(hashing.band_keys(m, scheme.bands, scheme.rows))
    return [(hashing.fingerprint(s), len(s), next(sigs), next(keys)) if len(s)
            else (None, 0, None, None) for s in sets]


def features(df: DataFrame, id_col: str, text_col: str, scheme: Scheme) -> DataFrame:
    """id, set name, set size, packed signature and band keys of each text.

    Texts without words (null too) have a null name and size 0.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        return lambda i, text: [(i, *describe([hashing.shingles(text)], scheme)[0])]

    return flat_map(rows, make, T.StructType([rows.schema["id"], *FEATURES]))


def shingle_sets(df: DataFrame, text_col: str, keep_text: bool = False) -> DataFrame:
    """(fp, shingles) of each text that has words, or (fp, text)."""
    text = T.StructField("text", T.StringType())
    ids = T.StructField("shingles", T.ArrayType(T.LongType(), False))

    def make():
        def one(text):
            s = hashing.shingles(text)
            return [(hashing.fingerprint(s), text if keep_text else s.view("int64"))] if len(
                s) else []
        return one

    return flat_map(df.select(F.col(text_col).alias("text")), make, T.StructType(
        [T.StructField("fp", T.BinaryType()), text if keep_text else ids]))


def agreeing_minima(a: Column, b: Column, minima: int) -> Column:
    """How many of the packed low-bit values of two signatures agree."""
    total = F.lit(minima)
    low = 0x5555555555555555
    for i in range(minima * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        total = total - F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(low)))
    return total


def estimated_similarity(agreeing: Column, minima: int) -> Column:
    """Similarity from b-bit agreement: unequal minima agree by chance once in 2^b."""
    chance = 2.0 ** -BITS
    return (agreeing / F.lit(float(minima)) - chance) / (1 - chance)


def _least(percent: int, minima: int, errors: float = 4.0) -> float:
    """The estimate that lies ``errors`` standard errors below the threshold."""
    threshold, chance = percent / 100, 2.0 ** -BITS
    p = threshold + (1 - threshold) * chance
    return threshold - errors * (p * (1 - p) / minima) ** 0.5 / (1 - chance)


def close_enough(percent: int, minima: int) -> Column:
    return estimated_similarity(agreeing_minima(
        F.col("a_sig"), F.col("b_sig"), minima), minima) >= F.lit(_least(percent, minima))


def closer_look(percent: int, minima: int) -> Column:
    """``close_enough`` on long signatures: as a loop, since an expression
    of so many terms would be too long to be compiled."""
    low = F.lit(0x5555555555555555)
    apart = F.aggregate(
        F.zip_with("a_fine", "b_fine", lambda a, b: a.bitwiseXOR(b)), F.lit(0),
        lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low)))
    return estimated_similarity(F.lit(minima) - apart, minima) >= F.lit(_least(percent, minima))


def fine_signatures(sets: DataFrame, minima: int) -> DataFrame:
    """(fp, sig) of (fp, shingles), with ``minima`` minima."""
    def make():
        def one(fp, shingles):
            s = np.array(shingles, np.int64).view(np.uint64)
            return [(fp, hashing.pack_low_bits(hashing.minima(s, minima), BITS))]
        return one

    return flat_map(sets.select("fp", "shingles"), make, T.StructType([FEATURES[0], FEATURES[2]]))


def verified(pairs: DataFrame, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame],
             percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose sets have 100 * |both| >= percent * |either|.

    ``fetch(classes)`` returns (fp, shingles) for at least those classes.  The
    pairs are written, so that the sets need not stay.
    """
    pairs = write_shared(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("vid")).union(pairs.select("b")).distinct()
    wanted = write_shared(classes.join(ids, "vid", "left_semi").select("vid", "fp", "rep"),
                          "wanted")
    sets = write_shared(fetch(wanted).join(wanted.select("vid", "fp"), "fp")
                        .groupBy("vid").agg(F.first("shingles").alias("s")), "sets")
    # the pairs are narrow, the rows that the first join makes are not: keep
    # them spread; on the other end, where one hub may have most pairs,
    # adaptive execution sees the real sizes and splits
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = (pairs.repartition(parts, "b")
            .join(sets.select(F.col("vid").alias("b"), F.col("s").alias("sb")), "b")
            .join(sets.select(F.col("vid").alias("a"), F.col("s").alias("sa")), "a")
            .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                    F.size(F.array_intersect("sa", "sb")).alias("common")))
    found = write_shared(both.filter(F.col("common") * (100 + percent)
                                     >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
    discard(sets)
    return found


def link_classes(classes: DataFrame, fetch: Callable[[DataFrame], DataFrame],
                 scheme: Scheme) -> DataFrame:
    """(vid, component) for every class that is linked to another one.

    ``classes``: vid (long, stable), fp, rep (what ``fetch`` finds a text
    by), n (texts of the class), n_shingles, sig, keys.  component: the smallest linked vid.
    """
    percent = scheme.percent
    members = classes.select("vid", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = write_shared(members.join(shared, "key"), "buckets")
    sig = classes.select("vid", "sig")

    def open_buckets(found: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        placed = (buckets.filter("size > 2").join(
            found.select(F.col("id").alias("vid"), "component"), "vid", "left")
            .select("key", "vid", F.coalesce("component", "vid").alias("comp")))
        apart = (placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .filter("lo < hi").select("key"))
        return write_shared(placed.join(apart, "key"), "open")

    # hubs: the members that meet most others, in all their buckets; of these
    # the one with most exact copies
    met = (buckets.groupBy("vid").agg(F.sum("size").alias("met"))
           .join(classes.select("vid", "n"), "vid"))
    hubs = (buckets.join(met, "vid").groupBy("key")
            .agg(F.max(F.struct("met", "n", "vid")).alias("hub"))
            .select("key", F.col("hub.vid").alias("hub")))
    tried = write_shared(
        buckets.join(hubs, "key").filter("vid <> hub")
        .select(F.least("hub", "vid").alias("a"), F.greatest("hub", "vid").alias("b"))
        .distinct(), "tried")
    signed = (tried.join(sig.withColumnsRenamed({"vid": "a", "sig": "a_sig"}), "a")
              .join(sig.withColumnsRenamed({"vid": "b", "sig": "b_sig"}), "b"))
    near = signed.filter(close_enough(percent, scheme.minima)).select("a", "b")
    links = verified(near, classes, fetch, percent)

    # all other pairs of a bucket that could join two components, each at
    # the smallest key that both have; by signatures fine enough to leave few
    still = open_buckets(connected_components(links))
    side = classes.join(still.select("vid").distinct(), "vid", "left_semi").select(
        "vid", "fp", "rep", "n_shingles", "sig", "keys")
    fine = (fine_signatures(fetch(side), scheme.fine).dropDuplicates(["fp"])
            .withColumnRenamed("sig", "fine"))
    side = write_shared(side.join(fine, "fp").drop("fp", "rep"), "fine")
    still = still.join(side, "vid")
    left, right = (still.select(*(F.col(c).alias(f"{x}_{c}") for c in still.columns))
                   for x in "ab")
    rest = (left.join(right, (F.col("a_key") == F.col("b_key"))
                      & (F.col("a_comp") < F.col("b_comp"))
                      & (100 * F.least("a_n_shingles", "b_n_shingles")
                         >= percent * F.greatest("a_n_shingles", "b_n_shingles"))
                      & close_enough(percent, scheme.minima)
                      & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key"))
                      & closer_look(percent, scheme.fine))
            .select(F.least("a_vid", "b_vid").alias("a"), F.greatest("a_vid", "b_vid").alias("b"))
            .join(tried, ["a", "b"], "left_anti"))
    links = links.union(verified(rest, classes, fetch, percent))
    return connected_components(links).select(F.col("id").alias("vid"), "component")


def where_id(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with (unique) ids, the first column of
    ``ids``; nulls match.

    Up to ``BROADCAST_IDS`` ids go to every task, so that texts are not
    shuffled; beyond it both sides are."""
    ids = write_shared(ids.select(F.col(ids.columns[0]).alias("_id")), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]), how)


def _marks(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, fp, n_shingles, key, component_id and kept of (doc_id, text)
    rows; key names the component itself, also where ids are null or repeated."""
    feats = write_shared(features(docs, "doc_id", "text", scheme), "minhash")
    classes = write_shared(
        feats.filter("fp is not null").groupBy("fp")
        .agg(F.min("id").alias("rep"), F.count("*").alias("n"),
             F.first("n_shingles").alias("n_shingles"),
             F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .withColumn("vid", F.monotonically_increasing_id()), "classes")

    def fetch(wanted: DataFrame) -> DataFrame:
        reps = wanted.select("rep").distinct()
        return shingle_sets(where_id(docs, "doc_id", reps, "left_semi"), "text")

    linked = link_classes(classes, fetch, scheme)
    named = classes.select("vid", "fp", "rep").join(linked, "vid")
    least = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    by_set = (classes.select("vid", "fp", "rep")
              .join(named.join(least, "component").select("vid", "smallest", "component"), "vid", "left")
              .select("fp", F.coalesce("smallest", "rep").alias("smallest"),
                      F.coalesce("component", "vid").alias("key")))
    out = feats.select("id", "n_shingles", "fp").join(by_set, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias("doc_id"), "fp", "n_shingles", "key",
                      component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts link when 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest id reachable, its own
    included; kept marks the rows whose id it is.  Repeated rows share a
    component (all rows with its smallest id are kept).  A text without
    words (or null) links with nothing.  A null id never names a component
    that has another id; alone, its component is null and it is kept.  Other
    columns are ignored.  Empty input, empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _marks(rows, Scheme(percent)).drop("fp", "key")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one per component.

    Of repeated rows (and of linked rows with one id) the one with the
    smallest text stays.  Texts without words all stay, as they link with
    nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = write_shared(_marks(rows, Scheme(percent)), "marks")
    ids = marks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    out = where_id(docs, id_col, ids.filter("not kept or n > 1"), "left_anti")
    again = ids.filter("kept and n > 1")
    if again.isEmpty():
        return out

    # ids of several rows: only these are told apart by their sets
    twice = where_id(docs, id_col, again, "left_semi")
    packed = twice.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                          F.struct("*").alias("row"))
    sets = shingle_sets(packed.select("text").distinct(), "text", keep_text=True)
    placed = packed.join(sets, "text", "left").withColumn("fp", F.coalesce("fp", F.lit(b"")))
    kept = (marks.filter("kept").select("doc_id", F.coalesce("fp", F.lit(b"")).alias("fp"),
                                        "key").distinct())
    chosen = placed.alias("p").join(kept.alias("k"), F.col("p.doc_id").eqNullSafe(
        F.col("k.doc_id")) & (F.col("p.fp") == F.col("k.fp"))).select("p.row", "p.text", "p.fp", "key")
    empty = chosen.filter(F.col("fp") == F.lit(b"")).select("row.*")
    one = (chosen.filter(F.col("fp") != F.lit(b"")).groupBy("key")
           .agg(F.min_by("row", "text").alias("row")).select("row.*"))
    return out.unionByName(one).unionByName(empty)


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
