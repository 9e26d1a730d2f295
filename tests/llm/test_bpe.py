import hashlib
import random

import pytest
from tokenizers import Tokenizer

from repeatlens.llm import bpe
from tests.llm.helpers import docs, odd_rows, table, with_clashes

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture
def encode(codec):
    return lambda s: bpe.Encoder(codec).encode(s).tolist()


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


ALPHABETS = ["ab", "aaaa", "thein ", "abcdefghijklmnopqrstuvwxyz", "éàüßñ中の🎉", "lolo hm 0123!!..--",
             "İΣσςẞǅ ٣𝟘", "it's we'll 're", "\x1c\x1d\x85\xa0  ab", "ſKÅ①²½", "ẹ́ä",
             "՘ꟋᲉ x"]


def test_random_texts_against_the_library(codec, encode):
    labels = bpe.Labels(codec.spec)
    rng = random.Random(4)
    for k in range(2400):
        s = "".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(0, 70)))
        if k % 9 == 0:
            s += "<|endoftext|>" + s + "<|startoftext|>"
        ids = encode(s)
        assert ids == library(s), repr(s)
        assert labels.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_joined_tokens_against_the_library(encode):
    rng = random.Random(8)
    plain = [t.removesuffix("</w>") for t in LIBRARY.get_vocab() if t.isascii() and t.isprintable()]
    for _ in range(6000):
        s = rng.choice(plain) + rng.choice(plain)
        assert encode(s) == library(s), s


def by_merging(merges, word, suffix):
    """Plain BPE: the best-ranked pair, leftmost first, until none is left."""
    rank = {m: i for i, m in enumerate(merges)}
    parts = [*word[:-1], word[-1] + suffix]
    while True:
        best = min((rank.get(p, len(rank)) for p in zip(parts, parts[1:])), default=len(rank))
        if best == len(rank):
            return parts
        a, b = merges[best]
        out, i = [], 0
        while i < len(parts):
            if parts[i:i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_random_merge_lists(suffix):
    """Every word up to seven letters, for merges learned from random text."""
    from itertools import product
    rng = random.Random(5)
    for _ in range(12):
        text = ["".join(rng.choices("abc", (5, 2, 1), k=rng.randint(1, 9))) for _ in range(60)]
        split = [[*w[:-1], w[-1] + suffix] for w in text]
        merges = []
        for _ in range(10):
            pairs = {}
            for w in split:
                for p in zip(w, w[1:]):
                    pairs[p] = pairs.get(p, 0) + 1
            if not pairs:
                break
            merges.append(max(sorted(pairs), key=pairs.get))
            split = [by_merging(merges, w, suffix) for w in text]
        tokens = [*"abc", *(c + suffix for c in "abc" if suffix), *(a + b for a, b in merges)]
        vocab = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        if len(vocab) < len(tokens):
            continue
        machine = bpe.Automaton(vocab, merges, suffix)
        for n in range(1, 7):
            for letters in product("abc", repeat=n):
                w = "".join(letters)
                assert machine.walk(w) == [vocab[t] for t in by_merging(merges, w, suffix)], w


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0}, []).walk("z")


def test_long_words(encode):
    for w in ("a" * 5000, "abcde" * 3000, "the" * 4000):
        assert encode(w) == library(w)


def test_small_cache(encode, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    s = "one two three four five six one two three four five six"
    assert encode(s) == library(s)


def test_query_on_the_driver_table(spark):
    from tests.llm.helpers import SMALL
    got = {r.doc_id: r for r in bpe.op1_bpe_codec(spark, SMALL).collect()}
    for d in table(spark, "documents").collect():
        ids = library(d.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_and_empty_table(spark):
    d = docs(spark, odd_rows())
    out = bpe.decode(bpe.encode(d, PATH), PATH).collect()
    for r in out:
        ids = library(r.text or "")
        assert r.token_ids == ids
        assert r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(docs(spark, []), PATH).collect() == []
    clash = with_clashes(d, "n_tokens", "token_ids", "decoded", "ids_sha256")
    assert bpe.round_trip(clash, PATH).count() == len(odd_rows())


def test_decode_skips_unknown_ids(spark):
    df = spark.createDataFrame([([0, 10**6, -1, 1],), ([],), (None,)], "token_ids array<int>")
    first, second = LIBRARY.id_to_token(0), LIBRARY.id_to_token(1)
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == [f"{first} {second}", "", ""]


def test_a_worker_holds_little(codec):
    """The tables as a worker gets them, and its caches when they are full."""
    import pickle
    import tracemalloc

    sent = pickle.dumps(codec)
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are words of their own
    tracemalloc.start()
    try:
        encoder = bpe.Encoder(pickle.loads(sent))
        for i in range(0, 200_000, 50):
            encoder.encode(" ".join(str(j) for j in range(i, i + 50)).translate(letters))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_codec_is_compiled_once_for_all_tasks(spark, monkeypatch):
    """What is broadcast is the codec, not the file to compile in each task."""
    given = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast",
                        lambda sc, v: given.append(v) or broadcast(sc, v))
    out = bpe.recode(docs(spark, odd_rows()).repartition(3), PATH)
    assert [type(v) for v in given] == [bpe.Codec]
    assert out.count() == len(odd_rows())
