import re

import pytest

from repeatlens.llm import license_scan as L
from tests.llm.helpers import docs, odd_rows, table, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(k, label) for p, label in L.BASE.items() for k in range(len(w))
          if w[k:k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in at})))


def test_base_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    rows += [(10_000, "under the MIT license under the mit-license, CC BY NC by nc"),
             (10_001, "x under the mit licenses"), (10_002, "Apache License, Version 2.0 é"),
             (10_003, "cc by nc cc by nc cc_by_nc ccby nc"), (10_004, "undér the mit license")]
    got = {r.doc_id: tuple(r)[1:6] for r in L.scan(docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


@pytest.mark.parametrize("expression,labels,freedom", [
    ("MIT", {"mit"}, 1.0), ("MIT OR GPL-3.0-only", {"mit", "gpl-3"}, 1.0),
    ("MIT AND GPL-3.0-only", {"mit", "gpl-3"}, 0.3),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2"}, 0.65),
    ("MIT AND (Apache-2.0 OR AGPL)", {"mit", "apache-2", "agpl"}, 1.0),
    ("(MIT AND Apache-2.0) OR AGPL", {"mit", "apache-2", "agpl"}, 1.0),
    ("MIT or AGPL and GPL-2.0", {"mit", "agpl", "gpl-2"}, 1.0),
    ("((MIT))", {"mit"}, 1.0), ("MIT */", {"mit"}, 1.0), ("MIT AND", {"mit"}, 1.0),
    ("(MIT OR", {"mit"}, 1.0), ("(MIT", {"mit"}, 1.0), ("MIT) AGPL", {"mit"}, 1.0),
    ("MIT AND (OR", {"mit"}, 1.0), ("LicenseRef-own", {"licenseref-own"}, 0.2),
    ("OR MIT", None, None), ("", None, None), ("()", None, None),
])
def test_expressions(expression, labels, freedom):
    value = L.evaluate(L.to_postfix(expression))
    assert value == (None if labels is None else (labels, pytest.approx(freedom)))


def test_random_expressions_against_python():
    import random
    rng = random.Random(6)
    ids = {"MIT": 1.0, "MPL": 0.6, "GPL": 0.3, "AGPL": 0.2}

    def build(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(list(ids))
            return name, ids[name]
        (a, x), (b, y) = build(depth - 1), build(depth - 1)
        return (f"({a} OR {b})", max(x, y)) if rng.random() < 0.5 else (
            f"({a}) AND ({b})" if " OR " in a + b else f"{a} AND {b}", min(x, y))

    for _ in range(300):
        text, value = build(4)
        assert L.evaluate(L.to_postfix(text))[1] == pytest.approx(value), text


def test_tags_and_notices(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode"),
            (2, "SPDX-License-Identifier: MIT\nAll Rights Reserved"),
            (3, "the GNU General Public License, version 3"), (4, "nothing here"),
            (5, "Released under the MIT License.\nSPDX-License-Identifier: AGPL AND MIT")]
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in L.scan(docs(spark, rows)).collect()}
    assert got == {1: ("", "gpl-2,mit", 1.0), 2: ("", "all-rights-reserved,mit", 0.0),
                   3: ("", "gpl,gpl-3", 0.3), 4: ("", "", 0.0), 5: ("mit", "agpl,mit", 0.2)}


@pytest.mark.parametrize("line,labels,score", [
    ("see the file LICENSE", "", 0.0), ("foo:bar", "", 0.0), ("MIT OR foo", "", 0.0),
    ("GPL-2.0+", "gpl-2", 0.3), ("LicenseRef-own", "licenseref-own", 0.2), ("MIT */", "mit", 1.0),
    ("GPL-2.0-only WITH Some-exception", "gpl-2", 0.65), ("Zlib AND EPL-2.0", "epl-2.0,zlib", 0.2)])
def test_a_tag_names_licences_only(line, labels, score):
    got = L.scan_text(f"// SPDX-License-Identifier: {line}\n", L._automaton())
    assert got[5] == labels and got[6] == pytest.approx(score)


def test_a_long_list_of_tags():
    import time
    text = "\n".join(f"SPDX-License-Identifier: {('MIT', 'GPL-2.0', 'no licence')[i % 3]} # {i}\n"
                     "under the MIT license" for i in range(20_000))
    t = time.perf_counter()
    got = L.scan_text(text, L._automaton())
    assert got[1] == 20_000 and got[5] == "gpl-2,mit" and time.perf_counter() - t < 10


def test_odd_rows_and_empty_table(spark):
    d = with_clashes(docs(spark, odd_rows()), "labels", "score", "n_words")
    got = L.scan(d).collect()
    assert sorted((r.n_words for r in got)) == sorted(brute(t[1])[0] for t in odd_rows())
    assert L.scan(docs(spark, [])).collect() == []
