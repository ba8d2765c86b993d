import random

import numpy as np
import pytest
import xxhash

from affinity.llm import simhash_trie as st
from tests.llm.helpers import docs, rows_of


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i:i + 4] for i in range(len(words) - 3)]
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    label = {i: i for i in range(len(ids))}
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = label[a], label[b]
                for k in label:
                    if label[k] in (x, y):
                        label[k] = min(x, y)
    out = {}
    for k, v in label.items():
        members = [ids[m] for m in label if label[m] == v and ids[m] is not None]
        out[k] = min(members) if members else None
    return out


TEXTS = ["", " \n\t", "One", "one two three", "a b c d", "A  B\tC\nD", "É é  x y", "word " * 3000]


@pytest.mark.parametrize("text", [None, *TEXTS])
def test_fingerprint_matches_brute_force(text):
    assert st.fingerprint(text) == brute_fingerprint(text)


def test_trie_pairs_are_exactly_the_near_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    near = base[rng.integers(0, 400, 600)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(2 ** 64 - 1)]]))
    got = set()
    for a, b in st.trie_pairs(fps, np.array([[0, len(fps), 0, len(fps)]]), 4):
        for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()):
            assert p not in got
            got.add(p)
    x = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(x <= 4)) if i < j}


def _corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    rows = []
    for t in base:
        rows.append(t)
        rows.append(t)
        for edits in (1, 2):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows = list(enumerate(rows)) + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    return rows + [(2000, None), (None, None), (None, base[0]), (3, base[3]), (1003, "one two three")]


@pytest.mark.parametrize("part", [st.SUBTRIE_ROWS, 7])
def test_components_match_brute_force(spark, monkeypatch, part):
    # 7: every subtrie with more classes is dealt out as part pairs
    monkeypatch.setattr(st, "SUBTRIE_ROWS", part)
    rows = _corpus()
    got = rows_of(st.near_duplicates(docs(spark, rows)), "doc_id", "fingerprint", "component_id")
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps, 4)
    assert got == sorted(((i, f"{fps[k]:016x}", want[k]) for k, (i, _) in enumerate(rows)),
                         key=lambda r: tuple((x is not None, x) for x in r))


def test_hot_subtries_as_part_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(st, "SUBTRIE_ROWS", 10)
    fps = [b << 40 | a for a in range(16) for b in range(4)]
    got = {tuple(r) for r in st.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()}
    from affinity.llm.common import connected_components
    labels = connected_components(spark.createDataFrame(sorted(got), "u long, v long")).collect()
    assert {r["node"] for r in labels} == set(fps) and {r["component"] for r in labels} == {0}


def test_keep_one_per_group(spark):
    rows = _corpus()
    table = docs(spark, rows)
    kept = st.keep_one(table)
    assert kept.columns == table.columns
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(list(range(len(rows))), fps, 4)
    members = {g: [rows[k][0] for k in group if group[k] == g and rows[k][0] is not None] for g in set(group.values())}
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in got if i is not None) == sorted(min(m) for m in members.values() if m)
    assert got.count(None) == 2


def test_keep_one_decides_per_row(spark):
    x, y = "alpha beta gamma delta epsilon", "one two three four five six seven"
    rows = [(5, x, "a"), (7, x, "b"), (5, y, "c"), (3, y, "d")]
    table = spark.createDataFrame([(i, t, {"k": m}, m, 1) for i, t, m in rows],
                                  "doc_id long, text string, m map<string,string>, label string, count long")
    kept = st.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], r["text"], r["m"]["k"]) for r in kept.collect()) == [(3, y, "d"), (5, x, "a")]


def test_keep_one_repeated_rows_and_null_texts(spark):
    x = "alpha beta gamma delta epsilon"
    rows = [(5, x, "b"), (5, x, "a"), (6, x, "c"), (9, None, "n"), (9, None, "m"), (11, "", "e"), (None, x, "z"), (None, None, "y")]
    table = spark.createDataFrame([(i, t, {"k": m}) for i, t, m in rows], "doc_id long, text string, m map<string,string>")
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["m"]["k"]) for r in st.keep_one(table).collect())
    assert got == [(-1, "", "y"), (-1, x, "z"), (5, x, "a"), (9, "", "m")]


def test_no_group_is_lost_where_ids_repeat(spark):
    rng = random.Random(3)
    texts = [t for _, t in _corpus()]
    rows = [(rng.randrange(30), rng.choice(texts)) for _ in range(300)]
    kept = [(r["doc_id"], r["text"]) for r in st.keep_one(docs(spark, rows)).select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(list(range(len(rows))), fps, 4)
    by_text = {t: group[k] for k, (_, t) in enumerate(rows)}
    assert sorted(by_text[t] for _, t in kept) == sorted(set(group.values()))
    assert all(i == min(rows[k][0] for k in group if group[k] == by_text[t]) for i, t in kept)


def test_empty_table(spark):
    assert st.near_duplicates(docs(spark, [])).collect() == []
    assert st.keep_one(docs(spark, [])).collect() == []


def test_components_of_long_paths_and_hubs(spark):
    from affinity.llm.common import connected_components
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1000), (None, 5), (5000, 5001), (5001, 5000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path + hub, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 5000, 5001: 5000}
