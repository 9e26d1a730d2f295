"""Line dedup with two Bloom filters.

A line's key is the line without white space at its ends (0x20, 0x09-0x0D)
and with A-Z in lower case.  A key is *repeated* if ``min_docs`` documents or
more hold it; each row counts as a document.

1. Every task puts the 64-bit hashes of its documents' keys into two Bloom
   filters: *once* (seen) and *twice* (seen before).  The filters of two
   tasks merge into ``once_a | once_b`` and ``twice_a | twice_b | (once_a &
   once_b)``; that is associative and never forgets a repeat.  Tasks write
   the blocks of the filters that they touched, compressed, and blocks merge
   in two levels, so no task sees a block from every other.
2. Only keys in the merged *twice* are suspects.  Their 128-bit digests are
   counted within the task, shuffled and counted exactly; a false positive
   of the filters ends here.
3. Repeated keys lose their lines (``keep="none"``), or all but the first
   occurrence, that in the row with the smallest (doc_id, text digest) at its
   first line (``keep="first"``).

The filters have 16 bits for a line, at most ``MAX_BITS``: beyond some 30
million lines they fill up, and more unique lines go to the exact count, whose
result is the same.  The repeated keys are broadcast up to
``BROADCAST_KEYS``; beyond it they are joined with the suspects of the texts,
each text named by its digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import table
from repeatlens.session import write_shared

MIN_DOCS = 10
BITS_PER_LINE = 16
#: 64 MB a filter, the most that is broadcast.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: A block of a filter: 2**20 bits.
BLOCK_BYTES = 1 << 17
#: Partial filters meet in so many groups first.
MERGE_GROUPS = 64
#: Hashes that are put into the filters at once; counts that a task keeps.
HASHES, COUNTS = 100_000, 100_000
#: Repeated keys (16 bytes each) that are broadcast.
BROADCAST_KEYS = 500_000

SPACE = b" \t\n\x0b\x0c\r"
_FILTERS = "block int, salt int, once binary, twice binary"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line of a text."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Bloom:
    """The filters *once* and *twice* of one task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two bits for each hash: (bytes, masks)."""
        both = np.stack([hashes, hashes >> np.uint64(32)]) & np.uint64(bits - 1)
        return both >> np.uint64(3), np.uint8(1) << (both & np.uint64(7)).astype(np.uint8)

    @classmethod
    def member(cls, filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at, mask = cls.places(hashes, len(filter_) * 8)
        return ((filter_[at] & mask) != 0).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of the keys of some documents, one for each (document, key)."""
        new, count = np.unique(hashes, return_counts=True)
        again = new[(count > 1) | self.member(self.once, new)]
        for filter_, h in ((self.once, new), (self.twice, again)):
            at, mask = self.places(h, self.bits)
            np.bitwise_or.at(filter_, at.ravel(), mask.ravel())

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(BLOCK_BYTES, len(self.once))
        for i in range(0, len(self.once), size):
            a, b = self.once[i:i + size], self.twice[i:i + size]
            if a.any():
                yield i // size, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """Two partial filters as one; associative and commutative."""
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def _inflate(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _texts(batches) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _partial_filters(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        bloom, pending, held = Bloom(bits), [], 0
        for (text,) in _texts(batches):
            keys = {k for k in line_keys(text) if k}
            pending.append(_hashes(keys))
            held += len(keys)
            if held >= HASHES:
                bloom.add(np.concatenate(pending))
                pending, held = [], 0
        if held:
            bloom.add(np.concatenate(pending))
        for block, once, twice in bloom.blocks():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([0], pa.int32()),
                 pa.array([once], pa.binary()), pa.array([twice], pa.binary())],
                names=["block", "salt", "once", "twice"])

    return texts.mapInArrow(run, _FILTERS)


def _merge_blocks(batches):
    """One row for each run of rows of one (block, salt)."""
    at, both = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
             pa.array([zlib.compress(both[0].tobytes(), 1)], pa.binary()),
             pa.array([zlib.compress(both[1].tobytes(), 1)], pa.binary())],
            names=["block", "salt", "once", "twice"])

    for block, salt, once, twice in _texts(batches):
        new = _inflate(once), _inflate(twice)
        if at == (block, salt):
            both = merge(both, new)
            continue
        if at is not None:
            yield row()
        at, both = (block, salt), new
    if at is not None:
        yield row()


def seen_twice(texts: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of the keys that two or more documents hold (and some
    others, as Bloom filters go): ``bits`` / 8 bytes."""
    parts = _partial_filters(texts, bits).withColumn(
        "salt", F.spark_partition_id() % MERGE_GROUPS)
    for _ in range(2):
        parts = (parts.repartition("block", "salt").sortWithinPartitions("block", "salt")
                 .mapInArrow(_merge_blocks, _FILTERS)).withColumn("salt", F.lit(0))
    out = np.zeros(bits // 8, np.uint8)
    size = min(BLOCK_BYTES, len(out))
    for block, twice in parts.select("block", "twice").collect():  # at most MAX_BITS / 8 bytes
        out[block * size:(block + 1) * size] = _inflate(bytes(twice))
    return out


def filter_bits(texts: DataFrame) -> int:
    """A power of two of 16 bits for a line or more, within the bounds."""
    text = F.col("text").cast("string")
    lines = texts.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0]
    want = BITS_PER_LINE * (lines or 0)
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, want - 1).bit_length()))


def _suspects(keys, twice: np.ndarray) -> list[bytes]:
    """The keys of one document that may be in another, too."""
    keys = [k for k in keys if k]
    if not keys:
        return []
    return [keys[i] for i in np.flatnonzero(Bloom.member(twice, _hashes(keys)))]


def _place(doc_id, text_digest: bytes) -> tuple:
    """Sorts as Spark does: null ids first."""
    return (doc_id is not None, 0 if doc_id is None else doc_id, text_digest)


def _count_suspects(rows: DataFrame, twice, id_type: str) -> DataFrame:
    """(digest, n_docs, first): counts within tasks, to be added up."""
    schema = f"digest binary, n long, doc_id {id_type}, text_digest binary, line int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        counts: dict[bytes, list] = {}

        def flush():
            cols = zip(*((d, *v) for d, v in counts.items()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for doc_id, text in _texts(batches):
            keys = line_keys(text)
            suspects = _suspects(dict.fromkeys(keys), twice.value)
            if not suspects:
                continue
            name = digest(text)
            place = _place(doc_id, name)
            line = {k: i for i, k in reversed(list(enumerate(keys)))}
            for key in suspects:
                d = digest(key)
                known = counts.get(d)
                if known is None:
                    counts[d] = [1, doc_id, name, line[key]]
                    continue
                known[0] += 1
                if place < _place(known[1], known[2]):
                    known[1:] = doc_id, name, line[key]
            if len(counts) >= COUNTS:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    parts = rows.mapInArrow(run, schema)
    return parts.groupBy("digest").agg(
        F.sum("n").alias("n_docs"),
        F.min(F.struct("doc_id", "text_digest", "line")).alias("first"))


def _apply(rows: DataFrame, schema: str, make) -> DataFrame:
    """Drops lines; ``make()`` gives a function of (doc_id, text, more) to the
    digests that go, each with its first occurrence if that stays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        gone = make()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text, *more in _texts([batch.slice(i, 256)]):
                    lines = text.split(b"\n")
                    drop = gone(doc_id, text, line_keys(text), *more)
                    kept = [x for x, d in zip(lines, drop) if not d]
                    out.append((doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type if f.name != "kept" else pa.binary()).cast(f.type)
                     for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none",
                broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines and n_dropped (long) and ``kept``, the text without the
    lines whose key is repeated, one row per row of ``docs``.

    A null or empty text is one empty line; empty keys are never repeated.
    Repeated rows count one by one, null ids too (in ``keep="first"`` they
    come first, and equal rows all keep their line).  Texts of any length are
    worked on one at a time.  No rows, no output; other columns are ignored.
    """
    if keep not in ("none", "first") or min_docs < 2:
        raise ValueError("keep is 'none' or 'first', min_docs at least 2")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    twice = spark.sparkContext.broadcast(
        seen_twice(rows.select("text"), filter_bits(rows.select("text"))))
    found = _count_suspects(rows, twice, id_type).filter(F.col("n_docs") >= min_docs)
    repeated = write_shared(found, "repeated-lines")
    schema = f"doc_id {id_type}, n_lines long, n_dropped long, kept string"
    first = keep == "first"

    def stays(known, doc_id, text_digest, line) -> bool:
        return first and known == (doc_id, text_digest, line)

    if repeated.count() <= broadcast_keys:
        known = spark.sparkContext.broadcast({
            bytes(r.digest): (r.first.doc_id, bytes(r.first.text_digest), r.first.line)
            if first else None for r in repeated.select("digest", "first").collect()})

        def make():
            of = known.value

            def gone(doc_id, text, keys):
                if not of:
                    return [False] * len(keys)
                name = digest(text) if first else b""
                out = []
                for i, k in enumerate(keys):
                    d = digest(k) if k else b""
                    out.append(d in of and not stays(of[d], doc_id, name, i))
                return out

            return gone

        return _apply(rows, schema, make)

    def pairs(batches):
        for (text,) in _texts(batches):
            found = [digest(k) for k in _suspects(dict.fromkeys(line_keys(text)), twice.value)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(text)] * len(found), pa.binary()),
                     pa.array(found, pa.binary())], names=["text_digest", "digest"])

    held = (rows.select("text").mapInArrow(pairs, "text_digest binary, digest binary").distinct()
            .join(repeated.select("digest", "first"), "digest")
            .groupBy("text_digest").agg(F.collect_list(F.struct("digest", "first")).alias("known")))
    named = _with_digest(rows).join(held, "text_digest", "left").select("doc_id", "text", "known")

    def make_joined():
        def gone(doc_id, text, keys, known):
            of = {x["digest"]: (x["first"]["doc_id"], x["first"]["text_digest"], x["first"]["line"])
                  for x in known or ()}
            name = digest(text) if first and of else b""
            return [bool(k) and bool(of) and (d := digest(k)) in of
                    and not stays(of[d], doc_id, name, i) for i, k in enumerate(keys)]

        return gone

    return _apply(named, schema, make_joined)


def _with_digest(rows: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            names = [*batch.schema.names, "text_digest"]
            new = pa.array([digest(t.as_py()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=names)

    return rows.mapInArrow(run, T.StructType(
        [*rows.schema.fields, T.StructField("text_digest", T.BinaryType())]))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL of ``op11_line_dedup``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    space = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), l AS (
  SELECT rid, i, parts[i] AS line,
         translate(trim(parts[i], {space}), '{upper}', '{upper.lower()}') AS key
  FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM d) AS x
), repeated AS (
  SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}
), k AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n
  FROM l WHERE key NOT IN (SELECT key FROM repeated) GROUP BY rid
)
SELECT d.doc_id, CAST(len(parts) AS BIGINT) AS n_lines,
       CAST(len(parts) - coalesce(k.n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""
