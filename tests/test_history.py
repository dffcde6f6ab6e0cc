from vellum.operators import history


def test_fast_forward_over_a_long_chain(spark):
    chain = [(i, i - 1 if i else None) for i in range(71)]
    parents = spark.createDataFrame([*chain, (200, 201), (201, 200)], "id long, parent long")  # and a cycle
    heads = spark.createDataFrame([("far", 0, 70), ("near", 69, 70), ("ahead", 70, 3), ("cycle", 5, 200)], "doc string, local long, incoming long")
    got = {r["doc"]: r["fast"] for r in history.fast_forward(parents.select("id"), parents, heads).collect()}
    assert got == {"far": True, "near": True, "ahead": False, "cycle": False}
