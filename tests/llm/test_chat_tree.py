import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from affinity.llm import chat_tree as ct

PARTS = ["<|im_start|>", "<|im_end|>", "\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|",
         "im_end|>", "/s>", "a", "é", "user", "n"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=4))
def test_template_round_trip(turns):
    formatted = "".join(ct.format_turn(r, t)[0] for r, t in turns)
    assert ct.parse_turns(formatted) == turns


@settings(max_examples=300, deadline=None)
@given(texts)
def test_no_control_string_survives_in_a_text(text):
    escaped = ct.escape(text)
    assert ct.unescape(escaped) == text
    assert not any(c in escaped for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def conversations():
    rng = random.Random(3)
    rows = []
    openings = [("system", "be kind"), ("user", "hello"), ("user", "hello </s>")]
    for c in range(120):
        depth = rng.randint(1, 6)
        turns = [openings[rng.randrange(3)]] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "[INST] ok"]))
                                               for _ in range(depth)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(200, k, "user" if k % 2 else "assistant", f"turn {k} " + "x" * 5000) for k in range(150)]
    rows += [(201, 0, None, "no role"), (201, 1, "assistant", None), (201, 1, "assistant", None), (201, None, "user", "first"),
             (None, 0, "user", "lost"), (202, 5, "tool\n|x", ""), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, depth int, node string, owner long")


def sorted_turns(rows):
    out = {}
    nulls = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for c, k, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], nulls(x[1]), text(x[2]), text(x[3]))):
        out.setdefault(c, []).append((r or "", t or ""))
    return out


def test_digests_read_back_from_the_emission(spark):
    rows = conversations()
    got = {r["conv_id"]: r for r in ct.read_back(*ct.prefix_tree(table(spark, rows))).collect()}
    want = sorted_turns(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["formatted_chars"] == sum(len(ct.format_turn(r, t)[0]) for r, t in turns)


def test_tree_is_emitted_once_depth_first(spark):
    rows = conversations()
    nodes, paths = ct.prefix_tree(table(spark, rows))
    nodes, paths = nodes.collect(), paths.collect()
    want = sorted_turns(rows)
    prefixes = {tuple(t[:k + 1]) for t in want.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)  # shared turns once
    by_node = {n["node"]: n for n in nodes}
    end = 0
    emission = []
    for n in sorted(nodes, key=lambda n: n["start"]):  # gapless
        assert n["start"] == end and n["length"] == len(n["formatted"])
        emission.append(n["formatted"])
        end += n["length"]
    emission = "".join(emission)
    path = {}
    for p in sorted(paths, key=lambda p: p["depth"]):
        path.setdefault(p["conv_id"], []).append(by_node[p["node"]])
    below = {}
    for conv, chain in path.items():
        assert "".join(n["formatted"] for n in chain) == "".join(ct.format_turn(r, t)[0] for r, t in want[conv])
        position = 0
        for k, n in enumerate(chain):
            assert n["position"] == position and n["depth"] == k
            position += n["length"]
            # ancestors plus the own stretch are exactly the conversation so far
            spans = [(a["start"], a["end"]) for a in n["ancestors"]] + [(n["segment_start"], n["start"] + n["length"])]
            assert "".join(emission[s:e] for s, e in spans) == "".join(m["formatted"] for m in chain[:k + 1])
            for m in chain[:k + 1]:
                below.setdefault(m["node"], set()).add(n["node"])
    for node, under in below.items():  # every subtree is contiguous, its root first
        spans = sorted((by_node[u]["start"], by_node[u]["start"] + by_node[u]["length"]) for u in under)
        assert spans[0][0] == by_node[node]["start"]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty(spark):
    nodes, paths = ct.prefix_tree(table(spark, []))
    assert nodes.collect() == [] and ct.read_back(nodes, paths).collect() == []
