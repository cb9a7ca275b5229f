"""Safety of compressions."""

from corvane.operators import budget


def test_safety_of_a_compression(spark):
    rows = [(1, 0, "user", "find the parser module"), (1, 1, "tool", "parser module found"), (1, 2, "user", "does it parse the module"), (1, 3, "user", "no pair"), (2, 0, "user", "alone"), (3, 0, "user", "a"), (3, 1, "tool", "b")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, content string")
    kept = spark.createDataFrame([(1, 1), (1, 2)], "conv_id bigint, turn int")
    got = {r[0]: tuple(r)[1:] for r in budget.compression_safety(messages, kept, "user", "tool", ("it",)).collect()}
    # pairs, broken, removed, at risk, safe
    assert got == {1: (1, 1, 0, 1, False), 2: (0, 0, 0, 0, True), 3: (1, 0, 1, 0, True)}
    assert sorted(map(tuple, budget.safe_removals(messages, kept, "user", "tool", ("it",)).collect())) == [(1, 3), (2, 0)]
    assert budget.compression_safety(messages.limit(0), kept, "user", "tool", ("it",)).count() == 0
