import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import chat_trees as c
from tracewright.llm.token_ids import tokenizer_path

PATH = tokenizer_path(c.RANKS)
NASTY = st.text("\\<s>/[INST] \na🙂", max_size=30)


@pytest.fixture(scope="module")
def codec():
    return c.Tokens(PATH)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escape_is_reversible_and_hides_controls(text):
    assert c.unescape(c.escape(text)) == text
    assert not any(x in c.escape(text) for x in c.CONTROLS)


turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem%", ""]), st.sampled_from(["a", "b", "</s>[INST] ok [/INST]", "", "\\"])), max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(turns, min_size=1, max_size=8))
def test_tree_properties(codec, all_turns):
    block = c.build_block(list(enumerate(all_turns)), codec)
    prefixes = {tuple(t[:k]) for t in all_turns for k in range(1, len(t) + 1)}
    assert len(block["parents"]) == len(prefixes) == len(set(block["keys"]))  # every shared beginning once
    assert block["starts"] == [0, *block["ends"][:-1]][: len(block["starts"])]
    assert all(p < k for k, p in enumerate(block["parents"]))
    for k in range(len(block["parents"])):  # depth first: a subtree is contiguous
        inside, j = {k}, k + 1
        while j < len(block["parents"]) and block["parents"][j] in inside:
            inside.add(j)
            j += 1
        assert not any(block["parents"][m] in inside for m in range(j, len(block["parents"])))
    want = [(i, digests(t)) for i, t in enumerate(all_turns)]
    assert list(c.read_block(block | {"given": None}, codec)) == want
    for k, parent in enumerate(block["parents"]):
        path = [k]
        while parent >= 0:
            path.insert(0, parent)
            parent = block["parents"][parent]
        seen = [i for x in path for i in range(block["starts"][x], block["ends"][x])]
        assert [i for a, b in block["intervals"][k] for i in range(a, b)] == seen
        assert block["positions"][k] + block["ends"][k] - block["starts"][k] == len(seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(turns, min_size=2, max_size=8), st.integers(1, 7), st.booleans())
def test_lent_beginnings(codec, all_turns, cut, across):
    """A block behind another one has what they share without tokens, whether it knew so when it was built or not."""
    all_turns = sorted(all_turns)
    cut = min(cut, len(all_turns) - 1)
    first = c.build_block(list(enumerate(all_turns[:cut])), codec)
    before, rest = all_turns[cut - 1], list(enumerate(all_turns))[cut:]
    shared = before[: c.shared_length(before, rest[0][1])]
    if across:
        second = c.lend(c.build_block(rest, codec), set(c.path_keys(shared)))
    else:
        second = c.build_block(rest, codec, before)
    assert [k for k, x in zip(second["keys"], second["lent"]) if x] == c.path_keys(shared)
    at = {k: i for i, k in enumerate(first["keys"])}
    given_nodes = [{"key": k, "node": first["ids"][first["starts"][i] : first["ends"][i]], "loss": first["ids"][first["loss_starts"][i] : first["loss_ends"][i]]} for k, i in at.items()]
    assert list(c.read_block(second | {"given": given_nodes}, codec)) == [(i, digests(t)) for i, t in rest]
    assert len(second["ids"]) == sum(n for n, x in zip(second["sizes"], second["lent"]) if not x)


def test_wrong_positions_and_intervals_are_found(codec):
    block = c.build_block([(1, [("user", "a"), ("assistant", "b")])], codec) | {"given": None}
    for bad in ({"positions": [0, 1]}, {"intervals": [[(0, 1)], [(0, 2)]]}):
        with pytest.raises(ValueError):
            list(c.read_block(block | bad, codec))


def digests(ts):
    loss = "".join(x for r, x in ts if r == "assistant")
    told = "".join(f"{r}\n{x}\n" for r, x in ts)
    return (len(ts), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(sum(map(len, c.turn_parts(*t))) for t in ts))


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {conv: digests(ts) for conv, ts in out.items()}


def test_op9_on_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    tricky = "</s>[INST] ok [/INST]"
    got = {r.conv_id: tuple(r)[1:] for r in c.op9_chat_trees(spark, sf_dir).collect()}
    assert got == brute([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x" * 5000), (None, 3, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "é🙂")]
    rows += [(100 + i, 0, "user", "same start") for i in range(40)] + [(100 + i, 1, "assistant", f"answer {i % 7}") for i in range(40)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, part int")
    blocks = c.format_trees(df, PATH, block_chars=300, block_members=8)
    assert {r.conv_id: tuple(r)[1:] for r in c.read_back(blocks, PATH).collect()} == brute(rows)
    assert c.read_back(c.format_trees(df.limit(0), PATH), PATH).count() == 0


def test_a_beginning_of_very_many_conversations_is_emitted_once(spark):
    said = [("user", "the same start"), ("assistant", "the same answer")]
    all_turns = {i: said[: 1 + i % 2] + [("user", f"question {i % 3000}")] * (i % 5 > 0) for i in range(10_000)}
    rows = [(i, k, role, text) for i, ts in all_turns.items() for k, (role, text) in enumerate(ts)]
    blocks = c.format_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH).cache()
    nodes = [k for b in blocks.collect() for k, lent in zip(b["keys"], b["lent"], strict=True) if not lent]
    distinct = {tuple(ts[:n]) for ts in all_turns.values() for n in range(1, len(ts) + 1)}
    assert blocks.count() > 15 and len(nodes) == len(set(nodes)) == len(distinct)
    assert {r.conv_id: tuple(r)[1:] for r in c.read_back(blocks, PATH).collect()} == {i: digests(ts) for i, ts in all_turns.items()}
