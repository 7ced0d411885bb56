import pytest

from graphloom.llm import chat


@pytest.mark.parametrize("depth", [70])
def test_growing_histories_nest_without_a_limit(spark, depth):
    """A session that is logged again after every turn: each log hangs on the one before."""
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for k in range(depth) for t in range(k + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tree = chat.build(df)
    assert tree.nodes(spark).count() == depth
    got = {r.conv_id: r.n_turns for r in chat.read(spark, tree).collect()}
    assert got == {k: k + 1 for k in range(depth)}


def test_a_chain_of_chains_needs_few_rounds(spark):
    n = 1100
    rows = [(f"{i:05d}", f"{i - 1:05d}" if i else None, i, 10 * i) for i in range(n)]
    chains = spark.createDataFrame(rows, "conv string, up string, branch int, branch_pos long")
    keys = {r.conv: [s.conv for s in r.key] for r in chat._keys(chains).collect()}
    assert len(keys) == n and all(v == [f"{j:05d}" for j in range(int(k) + 1)] for k, v in keys.items())


def test_a_very_long_text_is_one_turn(spark):
    text = "long <|im_end|> text " * 30_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (row,) = chat.read(spark, chat.build(df)).collect()
    assert row.n_turns == 2 and row.loss_chars == len(text)
