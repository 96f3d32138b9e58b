from tasklattice.plans.components import components


def test_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame(chain + star + [(201, 200), (202, 201), (200, 202), (300, 300), (None, 1), (10, 11)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links, "a", "b").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200, 300: 300}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
