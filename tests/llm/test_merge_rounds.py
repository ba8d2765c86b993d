import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from affinity.llm import merge_rounds as mr
from tests.llm.helpers import docs

PATH = mr.public_model()
FIXED = ["", " ", "  hello   world ", "a\nb", "x\0y", "▁a", "▁", "<s>hi</s>", "<0x41>", "😀", " " * 100, "x" + " " * 33 + "y", " " * 15,
         "a" * 1000, "the " * 50, "日本語のテキストを処理する。中国人民银行", "  　 x", "1234567 89", "…—–", "ab\r\n\r\n\tc"]
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", " etaoin", " ▁", "  \n\tab", "àéèüßñ eia", "日本語中国人民银行的一是不了在有大這", "0123456789abcdef",
             "😀👍🏽é ", "\x00\x01<>/s|", "".join(map(chr, range(32, 0x3000, 7))), "inger tion", "ab", "the an "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) if rng.random() < .1 else rng.choice(a) for _ in range(rng.randint(0, 200)))
            for _ in range(n) for a in [rng.choice(ALPHABETS)]]


def check(library, texts):
    vocab = mr.vocabulary(PATH)
    got = mr.Encoder(vocab).encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [g.tolist() for g in got] == want
    assert mr.decode(vocab, got) == [library.decode(w) for w in want]


def test_equals_the_library(library):
    check(library, FIXED)
    check(library, random_texts(1500))


def test_long_texts_are_cut_at_word_ends(library, monkeypatch):
    monkeypatch.setattr(mr, "CHUNK", 64)
    monkeypatch.setattr(mr, "REMEMBERED", 50)
    check(library, [" ".join(random_texts(30, seed=4)), "a" * 700, " " * 300, "x" * 100 + " y" * 90])


def test_very_long_unbroken_words(library):
    rng = random.Random(2)
    check(library, ["".join(rng.choice("abcdefghijklmnopABCDEFGH0123456789+/") for _ in range(100_000)), " " * 100_000, "ab" * 50_000])


def test_decode_of_any_ids(library):
    rng = random.Random(3)
    vocab = mr.vocabulary(PATH)
    rows = [[rng.choice([rng.randrange(vocab.size), rng.randrange(260), 259, 28705, 1, 2, 0]) for _ in range(rng.randint(0, 30))]
            for _ in range(3000)]
    assert mr.decode(vocab, [np.array(r) for r in rows]) == [library.decode(r) for r in rows]
    with pytest.raises(IndexError):
        mr.decode(vocab, [np.array([vocab.size])])


def one_by_one(vocab, symbols):
    """Best rank first, then leftmost: the definition."""
    symbols = list(symbols)
    while True:
        ranks = [int(vocab.pair(np.array([a]), np.array([b]))[0][0]) for a, b in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == mr.NO_PAIR:
            return symbols
        at = ranks.index(min(ranks))
        symbols[at:at + 2] = [int(vocab.pair(np.array([symbols[at]]), np.array([symbols[at + 1]]))[1][0])]


def test_rounds_equal_single_merges():
    vocab, rng = mr.vocabulary(PATH), random.Random(6)
    words = ["".join(rng.choice("▁aeinorst") for _ in range(rng.randint(1, 25))) for _ in range(80)]
    points = [np.array([vocab.char_symbol[ord(c)] for c in w], np.int32) for w in words]
    symbols, word = mr.merge(vocab, np.concatenate(points), np.repeat(np.arange(len(words)), [len(p) for p in points]))
    for k, p in enumerate(points):
        assert symbols[word == k].tolist() == one_by_one(vocab, p.tolist())


def test_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(FIXED + random_texts(50, seed=8))] + [(3, None), (None, "x y"), (3, "again"), (3, "again")]
    table = docs(spark, rows)
    got = mr.decode_ids(mr.encode_texts(table, PATH), PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids)))
    assert sorted(want) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"],
                                   hashlib.sha256(bytes(r["ids"])).hexdigest(), r["text"]) for r in got)
    assert mr.encode_texts(docs(spark, []), PATH).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert mr.decode_ids(none, PATH).collect()[0]["text"] is None
