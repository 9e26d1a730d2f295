from repeatlens.llm import para_dedup
from tests.llm.helpers import docs, odd_rows, prose, with_clashes
from tests.llm.test_near_dup import brute


def test_exact_near_and_own_repeats(spark):
    passage = prose(1, 60)
    near = list(passage)
    near[30] = "changed"
    other = " ".join(prose(2, 60))
    rows = [(1, "title\n" + " ".join(passage) + "\nend"), (2, other + "\n" + " ".join(passage)),
            (3, " ".join(near)), (4, other.upper() + "\n" + " ".join(prose(3, 60))),
            (5, " ".join(prose(4, 70))), (6, "\n".join([" ".join(prose(5, 30))] * 2))]
    got = {(r.doc_id, r.para): r for r in para_dedup.repeated_paragraphs(docs(spark, rows)).collect()}
    groups = {k: (r.group_doc_id, r.group_para) for k, r in got.items()}
    assert groups == {(1, 1): (1, 1), (2, 1): (1, 1), (3, 0): (1, 1), (2, 0): (2, 0),
                      (4, 0): (2, 0), (6, 0): (6, 0), (6, 1): (6, 0)}
    assert {k for k, r in got.items() if r.kept} == {(1, 1), (2, 0), (6, 0)}
    text = dict(rows)
    r = got[2, 1]
    assert text[2][r.start:r.end] == " ".join(passage) and r.n_words == 60
    clean = {r.doc_id: r.text for r in para_dedup.drop_repeated(docs(spark, rows)).collect()}
    assert clean[1] == text[1] and clean[2] == other and clean[3] == "" and clean[5] == text[5]


def test_groups_against_all_pairs(spark):
    rng_rows = []
    base = prose(7, 50)
    for i in range(60):
        w = list(base)
        for j in range(i % 7):
            w[(i * 7 + j * 11) % 50] = f"n{i}_{j}"
        rng_rows.append((i, " ".join(w)))
    expected = {i: c for i, _, c in brute(rng_rows, 80)}
    sizes = {}
    for c in expected.values():
        sizes[c] = sizes.get(c, 0) + 1
    out = para_dedup.repeated_paragraphs(docs(spark, rng_rows))
    assert {r.doc_id: r.group_doc_id for r in out.collect()} == {
        i: c for i, c in expected.items() if sizes[c] > 1}


def test_odd_rows_and_empty_table(spark):
    names = ("para", "start", "end", "kept", "fp", "group_doc_id")
    long = " ".join(prose(11, 30))
    rows = odd_rows() + [(20, long), (20, long), (None, long)]
    out = para_dedup.repeated_paragraphs(with_clashes(docs(spark, rows), *names))
    got = sorted((r.doc_id or -1, r.group_doc_id, r.kept) for r in out.collect())
    assert got == [(-1, None, True), (20, None, False), (20, None, False)]
    assert para_dedup.repeated_paragraphs(docs(spark, [])).collect() == []
    assert para_dedup.drop_repeated(docs(spark, odd_rows())).count() == len(odd_rows())


def test_passages_inside_and_across_lines(spark):
    p = prose(21, 60)
    a = prose(22, 30) + p + prose(23, 40)
    b = prose(24, 50) + p + prose(25, 70)
    wrapped = prose(26, 160)
    short = "\n".join(" ".join(wrapped[i:i + 16]) for i in range(0, 160, 16))
    other = "\n".join([" ".join(prose(27, 11)), *(" ".join(wrapped[i:i + 9])
                                                  for i in range(0, 160, 9))])
    rows = [(1, " ".join(a)), (2, "x\n" + " ".join(b[:80]) + "\n" + " ".join(b[80:])),
            (3, short), (4, other), (5, short), (6, " ".join(prose(28, 90))),
            (7, " ".join(p[:39] + prose(29, 40)))]
    got = para_dedup.repeated_paragraphs(docs(spark, rows)).collect()
    text = dict(rows)
    found = sorted((r.doc_id, r.para, r.n_words, r.group_doc_id, r.group_para, r.kept) for r in got)
    assert found == [(1, 0, 60, 1, 0, True), (2, 1, 60, 1, 0, False), (3, 0, 160, 3, 0, True),
                     (4, 1, 160, 3, 0, False), (5, 0, 160, 3, 0, False)]
    assert {(r.doc_id < 3, *text[r.doc_id][r.start:r.end].split()) for r in got} == {
        (True, *p), (False, *wrapped)}
    clean = {r.doc_id: r.text for r in para_dedup.drop_repeated(docs(spark, rows)).collect()}
    assert clean[1] == text[1] and clean[3] == short and clean[5] == ""
    assert clean[2].split() == ["x"] + b[:50] + b[110:] and clean[4].split() == prose(27, 11)


def test_windows_against_all_runs(spark):
    rng = __import__("random").Random(5)
    pieces = [prose(100 + i, 15 + 9 * i) for i in range(8)]
    rows = []
    for i in range(30):
        w = []
        for _ in range(4):
            w += prose(rng.randrange(10 ** 9), rng.randint(1, 30)) + rng.choice(pieces)
        rows.append((i, "".join(x + rng.choice("   \n") for x in w)))
    n = para_dedup.RUN
    places = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - n + 1):
            places.setdefault(tuple(w[k:k + n]), []).append((i, k))
    want = {(i, k + j) for at in places.values() if len(at) > 1 for i, k in at for j in range(n)}
    covered = set()
    for r in para_dedup.repeated_paragraphs(docs(spark, rows)).collect():
        at = len(dict(rows)[r.doc_id][:r.start].split())
        covered |= {(r.doc_id, at + j) for j in range(r.n_words)}
    assert want and want <= covered


def test_intermediates_do_not_stay(spark):
    import os

    from repeatlens.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    p = prose(31, 60)
    rows = [(1, " ".join(prose(32, 30) + p)), (2, " ".join(prose(33, 45) + p + prose(34, 9))),
            (3, " ".join(prose(35, 30))), (4, " ".join(prose(35, 30)))]
    out = para_dedup.repeated_paragraphs(docs(spark, rows))
    # not "links" and the like: what has a row for each line or window, or shingles
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before}
    assert {"lines", "passages"} <= left
    assert not left & {"paragraphs", "classes", "sets", "anchors", "windows", "recurring", "hits"}
    assert sorted((r.doc_id, r.kept) for r in out.collect()) == [
        (1, True), (2, False), (3, True), (4, False)]


def test_words_and_their_places():
    import re

    import numpy as np

    from repeatlens.llm import hashing

    for t in ("", "  ", "a b\n\nc é x \x85 \U0001f600z\n", "É\x0bA\x1cB \ud800 q",
              " " + "x" * 5000 + " y", "\n\na\rb\n"):
        h, starts, ends = hashing.words_of(t)
        assert list(zip(starts, ends)) == [m.span() for m in re.finditer(r"[^ \t-\r]+", t)]
        assert np.array_equal(h, hashing._hash_words(hashing.split(t)))
        lines = [i for i, line in enumerate(t.split("\n")) for _ in hashing.split(line)]
        assert list(para_dedup._lines(t, None)[1]) == lines
