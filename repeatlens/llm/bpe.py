"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens; it accepts exactly the correct tokenizations.
It starts as one state with a loop for each symbol and is rebuilt by one
*merge gadget* per merge, in order of rank.  The gadget of ``u v -> uv``

* adds an arc ``uv`` wherever ``u`` and then ``v`` could be read, leading
  to where ``v`` led (a copy of that state, as it is now);
* sends the arcs ``u`` to a copy of their target without the arc ``v``:
  an unmerged ``u v`` can no longer be read.

All arcs with one label lead to one state, so states are named by tokens and
the gadgets are kept as two tables: of which token a state is a copy and
since which rank, and at which rank a state lost an arc.  Whether a state
has an arc follows from them (``Automaton.arc``); rows are worked out when
first used and kept.  Written out, 49,000 states with 49,000 labels each
would not fit an executor.

Encoding walks a pre-split word by the table, longest token first.  Each
prefix of a word has one correct tokenization, so each position is entered
with one token at most, and a walk that had to turn back costs no more than
one look at each position.  Decoding emits the labels of the arcs.

Normalization and word splitting are what ``word_bpe`` files ask for (NFC,
lower case, white space dropped).
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm.common import append_column, table

#: Words of up to so many symbols are remembered, at least so many of them and
#: at most twice as many; others are walked again.
CACHE_SYMBOLS = 64
CACHE_WORDS = 40_000
#: Worked-out cells of the transition table that a task keeps.
CACHE_ARCS = 150_000

#: Characters whose class and lower case are the same in every Unicode
#: version from 13 on; texts with others go through the library's tables.
_PLAIN = re.compile(r"[\x00-ͷ΄-ԠḀ-ỿ‐-‧‰-⁞"
                       r"₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where
    printable in Latin-1, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


BYTES = _byte_symbols()


class Automaton:
    """Merges compiled gadget by gadget; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.ids = vocab
        size = max(vocab.values(), default=-1) + 1
        self.born = [-1] * size          # rank of the gadget that made a state
        self.left: list[int] = [-1] * size
        self.copied: list[int] = [-1] * size  # the state it was copied from
        self.cut: list[dict[int, int] | None] = [None] * size  # state -> {lost arc: rank}
        #: rows of the transition table that were looked up: state -> arc -> is there
        self.rows: dict[int, dict[int, bool]] = {}
        self.filled = 0
        made: set[int] = set()
        parts = {vocab[x] for pair in merges for x in pair}
        results = {vocab[a + b] for a, b in merges}
        ready = parts - results
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in made or not {u, v} <= ready:
                raise ValueError(f"merge {rank} ({a!r}, {b!r}) is out of order")
            if self.arc(u, v, rank):  # else some earlier merge always takes a part
                self.cut[u] = (self.cut[u] or {}) | {v: rank}
                self.born[w], self.left[w], self.copied[w] = rank, u, v
                made.add(w)
                ready.add(w)
            else:
                raise ValueError(f"merge {rank} ({a!r}, {b!r}) can never apply")
        #: ids of the tokens that may stand before the end of a word
        self.inner = {t: i for t, i in vocab.items() if not suffix or not t.endswith(suffix)}
        self.longest = max(map(len, self.inner), default=0)

    def _ancestors(self, t: int) -> list[tuple[int, int]]:
        """(state, since which rank) of the state of token t and of what it is
        a copy of, down to a symbol's."""
        out = [(t, self.born[t])]
        while out[-1][1] >= 0:
            t = self.copied[t]
            out.append((t, self.born[t]))
        return out

    def arc(self, t: int, x: int, rank: int) -> bool:
        """Had the state of token t an arc x before gadget ``rank``?"""
        states, cut, born = self._ancestors(t), self.cut, self.born
        while True:
            until = rank
            for state, since in states:  # an arc lost by the state or by what it is a copy of
                if since < until:
                    lost = cut[state]
                    if lost is not None and lost.get(x, until) < until:
                        return False
                    until = since
            rank = born[x]
            if rank < 0:
                return True  # a symbol: all states began with it
            u = self.left[x]
            if u == self.copied[x] and next(s for s, since in states if since <= rank) == u:
                return False  # u | u u: the first two merge
            x = u  # the arc uv was added where u could be read

    def _options(self, word: str, start: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that the word has at ``start``, by length."""
        get = self.inner.get
        out = [(end, x) for end in range(start + 1, min(start + self.longest + 1, len(word)))
               if (x := get(word[start:end])) is not None]
        x = self.ids.get(word[start:] + self.suffix)
        if x is not None:
            out.append((len(word), x))
        return out

    def walk(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte symbols.

        Takes the longest token that the state has an arc for and goes back
        where none is left.  At most one token can end a path to a position,
        so a position that led nowhere is never entered again.
        """
        n = len(word)
        if not n:
            return []
        path: list[int] = []
        ends, options, dead = [0], [self._options(word, 0)], set()
        row: dict[int, bool] | None = None
        while True:
            left = options[-1]
            while left:
                end, x = left.pop()
                if end in dead:
                    continue
                if row is not None:
                    ok = row.get(x)
                    if ok is None:
                        ok = row[x] = self.arc(path[-1], x, len(self.born) + 1)
                        self.filled += 1
                        if self.filled > CACHE_ARCS:
                            self.rows.clear()
                            self.filled = 0
                    if not ok:
                        continue
                path.append(x)
                if end == n:
                    return path
                ends.append(end)
                options.append(self._options(word, end))
                row = self.rows.setdefault(x, {})
                break
            else:
                dead.add(ends.pop())
                options.pop()
                if not ends:
                    raise ValueError(f"{word!r} has a symbol that the vocabulary lacks")
                path.pop()
                row = self.rows.setdefault(path[-1], {}) if path else None


def _ranges(prop: str) -> str:
    """The plain characters of a Unicode property as ranges of a class of ``re``."""
    own = [c for c in map(chr, range(0x10000)) if _PLAIN.fullmatch(c) and regex.match(prop, c)]
    out = []
    for c in own:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{a}-{b}" for a, b in out)


def _fast(pattern: str) -> re.Pattern | regex.Pattern:
    """``pattern`` for plain texts: ``re`` is faster, but has no properties
    and another idea of white space."""
    if regex.search(r"\\[ps]", regex.sub(r"\[[^\]]*\]", "", pattern)):
        return regex.compile(pattern)  # one of them outside brackets
    return re.compile(regex.sub(r"\\(p\{\w+\}|s)", lambda m: _ranges(m.group()), pattern))


class Labels:
    """The labels of a tokenizer file's arcs, by token id."""

    def __init__(self, spec: str | Codec):
        if isinstance(spec, Codec):  # read already
            vocab, self.special = spec.automaton.ids, spec.special
        else:
            data = json.loads(spec)
            vocab, self.special = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.table = pa.array([self.labels.get(i) for i in range(max(self.labels) + 1)])

    def decode(self, ids) -> str:
        """Arc labels joined by blanks; ids without a label are skipped."""
        label = self.labels.get
        return " ".join([s for s in map(label, ids) if s is not None])

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """``decode`` of a whole Arrow array (null: '')."""
        ids = lists.flatten()
        if len(ids):
            edge = pc.min_max(ids)
            if edge["min"].as_py() < 0 or edge["max"].as_py() >= len(self.table):
                return pa.array([self.decode(x or ()) for x in lists.to_pylist()], pa.string())
        counts = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        words = pa.ListArray.from_arrays(offsets, self.table.take(ids))
        return pc.binary_join(words, " ")


class Codec:
    """A tokenizer file's automaton with its normalization and splitting."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"]
                       if p["type"] == "Split")
        self.words = _fast(pattern)
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.spec = spec
        self.library = None

    def split(self, text: str) -> list[str]:
        """Normalized words."""
        if _PLAIN.fullmatch(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.spec)
        symbol = {c: b for b, c in enumerate(BYTES)}
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(symbol[c] for c in w).decode()
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Encoder:
    """A codec with one task's memory of words, given up with the task."""

    def __init__(self, codec: Codec):
        self.codec = codec
        #: words seen lately and before that, with their ids as packed int32
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            plain = word.isascii() and word.isalnum()  # these bytes stand for themselves
            ids = array("i", self.codec.automaton.walk(
                word if plain else "".join([BYTES[b] for b in word.encode()]))).tobytes()
        if len(word) <= CACHE_SYMBOLS:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text (null: none)."""
        out, at = [], 0
        text = text or ""
        for mark in chain(self.codec.marks.finditer(text), [None]):
            part = text[at:mark.start() if mark else len(text)]
            known = self.new.get
            out.extend([known(w) or self._word(w) for w in self.codec.split(part)])
            if mark:
                out.append(array("i", [self.codec.special[mark.group()]]).tobytes())
                at = mark.end()
        return np.frombuffer(b"".join(out), np.int32)


def _spec(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def _shared(spark, tokenizer_path: str):
    """The compiled codec (a few MB, of a fixed file) for all tasks: a worker
    holds its tables alone, not what compiling leaves behind."""
    return spark.sparkContext.broadcast(Codec(_spec(tokenizer_path)))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
           ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (null: an empty list).

    Repeated rows are encoded alike; no rows, no output.
    """
    codec = _shared(docs.sparkSession, tokenizer_path)

    def make():
        encoder = Encoder(codec.value)
        return lambda texts: [encoder.encode(v.as_py()) for v in texts]

    field = T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))
    return append_column(docs, text_col, make, field)


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "token_ids",
           text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids (null or empty: '')."""
    labels = docs.sparkSession.sparkContext.broadcast(Labels(_spec(tokenizer_path)))

    def make():
        return labels.value.decode_lists

    return append_column(docs, ids_col, make, T.StructField(text_col, T.StringType()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def recode(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
           ids_col: str = "token_ids", decoded_col: str = "decoded",
           rows: int = 128) -> DataFrame:
    """``docs`` with ``text_col`` replaced by the token ids of each whole text
    (null: none) and the text that they decode to.

    Both in one pass, so that a core holds one Python worker with one copy of
    the tables and the text does not come back.
    """
    shared = _shared(docs.sparkSession, tokenizer_path)
    at = docs.columns.index(text_col)
    others = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        encoder, labels = Encoder(shared.value), Labels(shared.value)
        for batch in batches:
            names = [*(batch.schema.names[i] for i in others), ids_col, decoded_col]
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                ids = [encoder.encode(v.as_py()) for v in part.column(at)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in others), lists, labels.decode_lists(lists)], names=names)

    fields = docs.schema.fields
    return docs.mapInArrow(run, T.StructType([
        *(fields[i] for i in others),
        T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)),
        T.StructField(decoded_col, T.StringType())]))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    both = recode(docs.select("doc_id", "text"), tokenizer_path)
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
