"""License scans: an Aho-Corasick automaton finds notice phrases and
identifier tags among a text's words; a shunting-yard parser evaluates the
tags' licence expressions.

Words are found on the lower-cased text; a phrase stands where its words
stand consecutively.  The automaton reads the words joined by single blanks,
so a phrase costs no more than its place.  Each text is worked on alone and
once.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm.common import flat_map, table

#: The phrases that are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"(?i)spdx[-_ ]license[-_ ]identifier:?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Identifiers with another label than their own lower case.
IDS = {
    "apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3", "mpl-2.0": "mpl", "cc0-1.0": "cc0", "unlicense": "public-domain",
    "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "cc-by-4.0": "cc-by", "cc-by-nc-4.0": "cc-by-nc",
}
#: Further identifiers that a tag may name.
OTHER_IDS = """
0bsd aal afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 artistic-1.0
artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-3.0
cc-by-nc-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1
cecill-2.1 cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-1.0-only
gpl-1.0-or-later icu ijg lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
lgpl-3.0-or-later libpng linux-openib mit-0 mpl-1.0 mpl-1.1 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl
osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 tcl upl-1.0 vim w3c wtfpl x11
zlib zpl-2.1
""".split()
#: How freely a text under a licence can be used, 0 to 1.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "gpl": 0.3, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2,
    "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.2
_KNOWN = {*IDS, *FREEDOM, *OTHER_IDS}
#: Binding strength.
OPERATORS = {"or": 1, "and": 2, "with": 3}

#: A-Z to a-z; digits, letters and bytes from 0x80 stay; the rest parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after
    lower-casing A-Z, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def to_postfix(expression: str) -> list[str]:
    """A licence expression in postfix order, by the shunting-yard method.

    Reads as far as the text is an expression: an operand where none is
    expected, or the end, closes it; operators without a right side and
    brackets left open are dropped.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # is an operand expected?
    at = 0
    while m := _TOKEN.match(expression, at):
        token, low = m.group(1), m.group(1).lower()
        if operand:
            if token == "(":
                stack.append(token)
            elif token == ")" or low in OPERATORS:
                break
            else:
                out.append(low)
                operand = False
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in OPERATORS:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            break
        at = m.end()
    if operand:  # the last operator has no right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out.extend(t for t in reversed(stack) if t != "(")
    return out


def known(postfix: list[str]) -> bool:
    """Does the expression name licences only?  Own ones are ``LicenseRef-..``;
    what follows ``with`` is an exception and may have any name."""
    stack: list[tuple[str, bool]] = []
    for token in postfix:
        if token in OPERATORS:
            (_, right), (name, left) = stack.pop(), stack.pop()
            stack.append((name, left if token == "with" else left and right))
        else:
            name = token.removesuffix("+")
            stack.append((token, name in _KNOWN or name.startswith("licenseref-")))
    return bool(stack) and stack[-1][1]


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """(labels, freedom) of a postfix expression: ``or`` leaves the choice,
    ``and`` binds to both, an exception given by ``with`` frees half of what
    its licence withholds and is no label.  None: no expression."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in OPERATORS:
            right, left = stack.pop(), stack.pop()
            if token == "or":
                stack.append((left[0] | right[0], max(left[1], right[1])))
            elif token == "and":
                stack.append((left[0] | right[0], min(left[1], right[1])))
            else:
                stack.append((left[0], (1 + left[1]) / 2))
        else:
            name = token.removesuffix("+")  # or any later version
            label = IDS.get(name, name)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[-1] if stack else None


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    found = words(text)
    # one character per byte: the phrases are ASCII
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    freedom: list[float] = []
    tagged = False
    for last, phrase in automaton.iter(line):
        if phrase in BASE:
            places.append(last - len(phrase) - 1)  # where the leading blank stands
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(NOTICES[phrase])
            freedom.append(FREEDOM[NOTICES[phrase]])
    if tagged:  # all tag lines, once; a line that names no licence is no tag
        for expression in {m.group(1) for m in _TAG_LINE.finditer(text)}:
            postfix = to_postfix(expression)
            if known(postfix):
                names, value = evaluate(postfix)
                labels |= names
                freedom.append(value)
    freedom.extend(FREEDOM[x] for x in base)
    edges = [line.count(" ", 0, f(places)) for f in (min, max)] if places else [None, None]
    return (len(found), len(places), *edges, ",".join(sorted(base)),
            ",".join(sorted(base | labels)), min(freedom, default=0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (all places of the base
    phrases), first_word and last_word (smallest and largest place, words
    from 0; null without one), base_labels, labels and score: how freely the
    text can be used under all its notices and tags together (0 without any).

    Null and empty texts have no words and no labels.  Repeated rows get a
    row each.  Other columns are ignored.  Empty input, empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        automaton = _automaton()
        return lambda i, text: [(i, *scan_text(text, automaton))]

    return flat_map(rows, make, T.StructType([
        rows.schema["doc_id"], T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]))


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
