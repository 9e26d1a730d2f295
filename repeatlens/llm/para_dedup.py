"""Substring dedup: paragraphs that recur, exactly or nearly, across and
within documents.

A paragraph is a line.  Each of ``MIN_WORDS`` words or more gets a MinHash
signature of its word shingles; bands are tuned for the recall wanted at the
threshold (``BANDS``).  Equal shingle sets form a class, classes that share a
band key are candidates, exact Jaccard similarity on the full sets decides,
and the links' components are the groups of which one paragraph, the first
of the smallest document, stays.  See ``near_dup`` for how groups of any
size are linked without pairing all their members.

What recurs but is no line of its own -- inside longer lines, across lines,
in lines too short to be compared -- is found in the sequence of all words:
every run of ``RUN`` words that occurs twice, joined to the longest spans.
Of each window of a text one anchor is chosen by its words alone (winnowing),
so that two equal runs have an equal anchor; only windows whose anchor recurs
are compared, by a 64-bit hash of all their words.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repeatlens.llm import hashing
from repeatlens.llm.common import flat_columns, flat_map, table
from repeatlens.llm.near_dup import (BROADCAST_IDS, FEATURES, Scheme, describe, link_classes,
                                     where_id)
from repeatlens.session import discard, write_shared

#: Shorter paragraphs are titles, salutations and the like, not passages.
MIN_WORDS = 20
BANDS = Scheme(percent=80, rows=2, recall=0.999, minima=64)
#: Any run of so many words that recurs is found, wherever lines break.
RUN = 40
#: Words of an anchor; each run holds RUN - ANCHOR + 1 candidates.
ANCHOR = 20


def paragraphs(text: str | None, min_words: int) -> tuple[list[tuple], list]:
    """(number, start, end, n_words) of each line with enough words, and the
    lines' shingle sets; code points, end exclusive."""
    at, spans, lines = 0, [], []
    for i, line in enumerate((text or "").split("\n")):
        words = hashing.split(line)
        if len(words) >= max(1, min_words):
            spans.append((i, at, at + len(line), len(words)))
            lines.append(words)
        at += len(line) + 1
    return spans, hashing.shingles_of(lines)


def features(docs: DataFrame, min_words: int, scheme: Scheme) -> DataFrame:
    """doc_id, para, start, end, n_words and the description of each paragraph."""
    def make():
        def one(doc_id, text):
            spans, sets = paragraphs(text, min_words)
            return [(doc_id, *span, *about) for span, about in zip(spans, describe(sets, scheme))]
        return one

    return flat_map(docs, make, T.StructType([
        docs.schema["doc_id"],
        *(T.StructField(n, T.LongType()) for n in ("para", "start", "end", "n_words")), *FEATURES]))


def _sets(docs: DataFrame, min_words: int) -> DataFrame:
    def make():
        return lambda text: [(hashing.fingerprint(s), s.view("int64"))
                             for s in paragraphs(text, min_words)[1]]

    return flat_map(docs.select("text"), make, T.StructType([
        T.StructField("fp", T.BinaryType()),
        T.StructField("shingles", T.ArrayType(T.LongType(), False))]))


def _anchored(h: np.ndarray, gone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of RUN words and the anchor of each, the least
    hash of its runs of ANCHOR words.  Windows of words that are all gone are
    left out."""
    if len(h) < RUN:
        return np.empty(0, np.int64), h[:0]
    anchors = hashing.sliding_min(hashing.rolling(h, ANCHOR), RUN - ANCHOR + 1)
    starts = np.arange(len(anchors))
    if gone is not None:
        upto = np.concatenate([[0], np.cumsum(gone)])
        left = upto[RUN:] - upto[:-RUN] < RUN
        starts, anchors = starts[left], anchors[left]
    return starts, anchors


def _tags(para: str, fp: str) -> Column:
    """A line's number and 32 bits of its set's name.  The bits only tell
    apart the lines of different texts under one id."""
    bits = F.conv(F.hex(F.substring(fp, 1, 4)), 16, 10).cast("long")
    return F.shiftleft(F.col(para).cast("long"), 32).bitwiseOR(bits)


def _lines(text: str, gone: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray,
                                                  np.ndarray, np.ndarray | None]:
    """Hash, line, start and end (code points) of each word, and whether the
    line is one of ``gone``, ``_tags`` of lines that are repeats already."""
    h, starts, ends = hashing.words_of(text)
    lines = text.split("\n")
    breaks = np.cumsum([len(line) + 1 for line in lines])
    at = np.searchsorted(breaks, starts, "right")
    if not gone:
        return h, at, starts, ends, None
    out = np.zeros(len(lines), bool)
    for tag in gone:
        i = tag >> 32  # rows of one id may have different texts
        out[i:i + 1] = i < len(lines) and int.from_bytes(hashing.fingerprint(
            hashing.shingles_of([hashing.split(lines[i])])[0])[:4], "big") == tag & 0xFFFFFFFF
    return h, at, starts, ends, out[at]


def _cycling(windows: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows that repeat an earlier one of the line because the line cycles:
    the two stretches that agree overlap."""
    order = np.lexsort((starts, windows))
    dist = np.zeros(len(starts), np.int64)
    same = windows[order][1:] == windows[order][:-1]
    dist[order[1:][same]] = np.diff(starts[order])[same]
    dist[(dist > 0) & (at[starts - dist] != at[starts + RUN - 1])] = 0
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (dist[1:] != dist[:-1])
    run = np.cumsum(new) - 1
    return (dist > 0) & (np.bincount(run)[run] + RUN - 1 > dist)


def _few(df: DataFrame, items: str | None = None, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df``, to be broadcast if it has few rows, each counted with the
    entries of its array ``items``."""
    size = df.agg(F.sum(F.size(items) + 1)).first()[0] or 0 if items else df.count()
    return F.broadcast(df) if size <= rows else df


def _passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows like ``repeated_paragraphs``' for runs of RUN words or more that
    recur outside of lines that are ``gone`` (doc_id, gone)."""
    gone = _few(gone.withColumnRenamed("doc_id", "_id"), "gone", 4 * BROADCAST_IDS)
    texts = docs.filter("text is not null").join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "gone")
    longs = T.ArrayType(T.LongType(), False)

    def anchors():
        def one(doc_id, text, gone):
            h, *_, out = _lines(text, gone)
            _, hashes = _anchored(h, out)
            return [(doc_id, np.unique(hashes).view("int64"))] if len(hashes) else []
        return one

    found = write_shared(flat_map(texts, anchors, T.StructType([
        docs.schema["doc_id"], T.StructField("anchors", longs)])), "anchors")
    each = found.select("doc_id", F.explode("anchors").alias("a"))
    again = write_shared(each.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
                         .select("a"), "again")
    wanted = write_shared(each.join(_few(again), "a").groupBy("doc_id")
                          .agg(F.collect_set("a").alias("anchors")), "anchored")
    discard(found, again)
    narrow = _few(wanted.withColumnRenamed("doc_id", "_a_id"), "anchors", 4 * BROADCAST_IDS)
    near = where_id(texts, "doc_id", wanted.select("doc_id"), "left_semi")
    near = near.join(narrow, F.col("doc_id").eqNullSafe(F.col("_a_id")))

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def windows():
        # one id for each row of documents; the rows are written once, below
        task = TaskContext.get().partitionId() << 33
        rids = itertools.count(task)

        def one(doc_id, text, gone, anchors):
            h, at, begins, ends, out = _lines(text, gone)
            starts, hashes = _anchored(h, out)
            starts = starts[np.isin(hashes, np.array(anchors, np.int64).view(np.uint64))]
            if not len(starts):
                return None
            hashes = hashing.rolling(h, RUN)[starts]
            return [np.full(len(starts), next(rids)), pa.repeat(pa.scalar(doc_id, id_type), len(starts)),
                    hashes.view(np.int64), starts << 32 | at[starts],
                    begins[starts] << 32 | ends[starts + RUN - 1], _cycling(hashes, starts, at)]
        return one

    # place: position and line; chars: start and end; 32 bits each, so that rows stay narrow
    longs = [T.StructField(n, T.LongType()) for n in ("h", "place", "chars")]

    def high(c: str) -> Column:
        return F.shiftright(c, 32)

    def low(c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))

    every = write_shared(flat_columns(
        near.select("doc_id", "text", "gone", "anchors"), windows, T.StructType([
            T.StructField("rid", T.LongType()), docs.schema["doc_id"], *longs,
            T.StructField("cycles", T.BooleanType())])), "windows")
    first = write_shared(every.groupBy("h").agg(
        F.min(F.struct("doc_id", "place")).alias("first"),
        F.count(F.when(~F.col("cycles"), 1)).alias("n")).filter("n > 1")
        .select("h", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place")),
        "recurring")
    own = F.col("doc_id").eqNullSafe(F.col("first_doc"))
    # written, so that the join's files are gone before the rows are dealt by document
    hits = write_shared(
        every.join(_few(first), "h")
        .withColumn("kept", own & (high("place") == high("first_place")))
        .filter(~(F.col("cycles") & own) | F.col("kept"))
        .select("rid", "doc_id", "place", "chars", "first_doc", "first_place", "kept"), "hits")
    discard(every, first)
    # neighbours whose first places are neighbours too make one span
    w = Window.partitionBy("rid").orderBy("place")
    follows = ((high("place") == F.lag(high("place")).over(w) + 1)
               & (high("first_place") == F.lag(high("first_place")).over(w) + 1)
               & F.col("first_doc").eqNullSafe(F.lag("first_doc").over(w))
               & (F.col("kept") == F.lag("kept").over(w)))
    spans = hits.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn(
        "span", F.sum("new").over(w))
    passages = write_shared(spans.groupBy("rid", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min(low("place")).alias("para"),
        F.min(high("chars")).alias("start"), F.max(low("chars")).alias("end"),
        (F.count("*") + RUN - 1).alias("n_words"), F.first("first_doc").alias("group_doc_id"),
        F.min("first_place").alias("first_place"), F.first("kept").alias("kept"))
        .select("doc_id", "para", "start", "end", "n_words", "group_doc_id",
                low("first_place").alias("group_para"), "kept"), "passages")
    discard(hits)
    return passages


def _repeats(docs: DataFrame, min_words: int, scheme: Scheme) -> DataFrame:
    """``repeated_paragraphs`` of (doc_id, text), and whether the row is a line."""
    feats = write_shared(features(docs, min_words, scheme), "paragraphs")
    classes = write_shared(
        feats.groupBy("fp").agg(
            F.min(F.struct("doc_id", "para")).alias("first"), F.count("*").alias("n"),
            F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
            F.first("keys").alias("keys"))
        .withColumn("rep", F.col("first.doc_id"))
        .withColumn("vid", F.monotonically_increasing_id()), "classes")

    def fetch(wanted: DataFrame) -> DataFrame:
        near = where_id(docs, "doc_id", wanted.select("rep").distinct(), "left_semi")
        # a document's other paragraphs go before anything is shuffled
        return (where_id(_sets(near, min_words), "fp", wanted.select("fp"), "left_semi")
                .dropDuplicates(["fp"]))

    linked = link_classes(classes, fetch, scheme)
    placed = classes.select("vid", "fp", "first", "n").join(linked, "vid", "left")
    heads = placed.filter("component is not null").groupBy("component").agg(
        F.min("first").alias("head"))
    grouped = (placed.join(heads, "component", "left").filter("n > 1 or head is not null")
               .select("fp", F.coalesce("head", "first").alias("head")))
    out = feats.select("doc_id", "para", "start", "end", "n_words", "fp").join(grouped, "fp")
    lines = write_shared(out.select(
        "doc_id", "para", "start", "end", "n_words", F.col("head.doc_id").alias("group_doc_id"),
        F.col("head.para").alias("group_para"),
        F.struct("doc_id", "para").eqNullSafe(F.col("head")).alias("kept"), "fp"), "lines")
    gone = write_shared(lines.filter("not kept and doc_id is not null").groupBy("doc_id").agg(
        F.collect_set(_tags("para", "fp")).alias("gone")), "gone")
    discard(feats, classes)
    passages = _passages(docs, gone)
    # the first place of a passage may be a line that has its row already
    heads = lines.filter("kept").select("doc_id", "para", "start", "end").distinct()
    inside = (F.col("p.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("p.kept")
              & (F.col("p.para") == F.col("l.para")) & (F.col("p.start") >= F.col("l.start"))
              & (F.col("p.end") <= F.col("l.end")))
    others = passages.alias("p").join(heads.alias("l"), inside, "left_anti")
    return (lines.drop("fp").withColumn("line", F.lit(True))
            .unionByName(others.withColumn("line", F.lit(False))))


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, scheme: Scheme = BANDS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, para, start, end, n_words, group_doc_id, group_para, kept):
    one row per paragraph that another one repeats, and per longest passage
    of ``RUN`` words or more that recurs outside such paragraphs.

    para counts lines from 0 (of a passage, the line it starts in), start and
    end are code points of the text; the group is named by its first
    paragraph or place, which is kept.  A null id sorts before all others.
    Null and empty texts have no paragraphs; repeated rows repeat each
    other's paragraphs, and all rows of the group's name are kept.  A line
    that cycles does not repeat itself.  Other columns are ignored.  Empty
    input, empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _repeats(docs, min_words, scheme).drop("line")


def _without(text: str | None, paras: list | None, spans: list | None) -> str | None:
    """``text`` without some lines, and without spans of the other ones."""
    if text is None:
        return None
    paras, out, at = set(paras or ()), [], 0
    spans = sorted((s["start"], s["end"]) for s in spans or ())
    for i, line in enumerate(text.split("\n")):
        left, done = "", 0
        for a, b in spans:
            a, b = max(a - at, done), min(b - at, len(line))
            if a < b:
                left, done = left + line[done:a], b
        left += line[done:]
        if i not in paras and (left.strip() or not line.strip()):
            out.append(left)
        at += len(line) + 1
    return "\n".join(out)


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS, scheme: Scheme = BANDS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the paragraphs and passages that are not kept (line
    breaks go with their lines).  Ids must be unique; rows with a null id
    stay as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = (_repeats(rows, min_words, scheme).filter("not kept and doc_id is not null")
            .groupBy("doc_id").agg(
                F.collect_set(F.when(F.col("line"), F.col("para"))).alias("_p_gone"),
                F.collect_set(F.when(~F.col("line"), F.struct("start", "end"))).alias("_p_spans"))
            .withColumnRenamed("doc_id", "_p_id"))
    left = F.udf(_without, "string")(F.col(text_col), F.col("_p_gone"), F.col("_p_spans"))
    return (docs.join(gone, docs[id_col] == gone["_p_id"], "left")
            .withColumn(text_col, F.when(F.col("_p_gone").isNull(), F.col(text_col)).otherwise(left))
            .select(*docs.columns))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))
