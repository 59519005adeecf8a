"""Components of chains, stars and loops."""

from cohortloom.operators.graph import components


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 30)] + [(50, 50), (None, 3), (61, 60), (62, 61), (62, 60), (29, 100)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == dict.fromkeys([*range(1, 30), *range(100, 161)], 1) | {50: 50, 60: 60, 61: 60, 62: 60}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
