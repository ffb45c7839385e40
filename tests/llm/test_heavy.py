from strataloom.llm.heavy import join_heavy


def test_salted_join_equals_plain_join(spark):
    keys = [1] * 4000 + [2] * 5 + [3] * 2 + [None] * 2000 + [9]
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (7, "d")], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(join_heavy(big, small, ["k"], how).collect(), key=str)
        assert got == sorted(big.join(small, ["k"], how).collect(), key=str)
        assert len(got) == 8005 + (2003 if how == "left" else 0)
