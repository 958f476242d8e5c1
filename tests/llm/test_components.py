from millwright.llm.components import components


def test_components_of_chains_rings_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    ring = [(i, i + 1) for i in range(200, 215)] + [(215, 200)]
    star = [(300, i) for i in range(301, 330)]
    edges = spark.createDataFrame([*chain, *ring, *star, (7, 7), (None, 3), (201, 200)], "a long, b long")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 200 for i in range(201, 216)} | {i: 300 for i in range(301, 330)}
    assert components(edges.where("false")).count() == 0
