import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from affinity.llm import best_fit_packing as bp
from tests.llm.helpers import docs


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2049)]),
                                    (5000, [(0, 904), (904, 2952), (2952, 5000)])])
def test_cuts(n, want):
    assert bp.cuts(n) == want


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer
    args = bp.public_encoder_args()
    encode, slow = bp.encoder(*args), Tokenizer.from_file(args[0])
    rng = random.Random(1)
    texts = ["", "a", "<|endoftext|>", "x <|endoftext|> y", "  two  spaces\n\n", "don't we'll", "١٢٣ ¼ ² 中文 text", "a" * 5000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xd800), rng.randrange(0xe000, 0x20000)]))
                      for _ in range(rng.randrange(40))) for _ in range(500)]
    for t in texts:
        assert encode(t) == slow.encode(t, add_special_tokens=False).ids


def brute_best_fit(lengths, capacity, open_bins):
    """Placement by a plain list of open bins."""
    bins, out, number = [], [], 0
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[1])
        else:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
            b = [number, capacity]
            number += 1
            bins.append(b)
        out.append(capacity - b[1])
        b[1] -= n
        if not b[1]:
            bins.remove(b)
    return out, number


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_bitset_best_fit_equals_a_linear_search(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randint(1, 64) for _ in range(2000)]
    bins = bp.BestFit(64, open_bins, 1)
    got = [bins.put(n)[1] for n in lengths]
    want, number = brute_best_fit(lengths, 64, open_bins)
    # bins of equal free space are alike, so offsets and counts agree
    assert got == want and (bins.next - 1) // 2 == number


def _table(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "and", "word", "xyz", "tion", "é"], k=rng.choice([1, 5, 100, 200, 300, 900]))))
            for i in range(300)]
    return rows + [(900, None), (901, ""), (None, "no id"), (902, "long " * 9000), (3, rows[3][1]), (903, "tok " * 2047)]


@pytest.mark.parametrize("task_rows", [bp.TASK_ROWS, 3])
def test_packing_round_trip(spark, monkeypatch, task_rows):
    # 3: over a hundred packing tasks and three rounds
    monkeypatch.setattr(bp, "TASK_ROWS", task_rows)
    rows = _table(spark)
    encode = bp.encoder(*bp.public_encoder_args())
    got = bp.pack(docs(spark, rows)).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], ids.tolist()))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= bp.CAPACITY
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(encode(t or "") + [0])
    for i, wanted in texts.items():
        pieces = sorted(by_doc[i])
        joined = sorted(sum((p[2] for p in pieces), [])) if len(wanted) > 1 else sum((p[2] for p in pieces), [])
        assert joined == (sorted(sum(wanted, [])) if len(wanted) > 1 else wanted[0])
        if len(wanted) == 1:
            assert [(p[1], p[1] + len(p[2])) for p in pieces] == bp.cuts(len(wanted[0]))
    # close to best-fit decreasing over all pieces at once
    best = brute_best_fit(sorted((r["length"] for r in got), reverse=True), bp.CAPACITY, 10 ** 9)[1]
    assert len(sequences) <= (1.0 if task_rows > 3 else 1.25) * best + 1


def test_without_ids_and_empty(spark):
    assert "ids" not in bp.pack(docs(spark, [(1, "a")]), with_ids=False).columns
    assert bp.pack(docs(spark, [])).collect() == []
