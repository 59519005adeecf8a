"""Replicates of persons against a plain version."""

import random

import numpy as np
import pytest

from cohortloom.operators import adjustment as ad


def plain_intervals(rows, seed, stream, count):
    """(low, high) of each judge, over rows (judge, person, outcome, predicted)."""
    judges = sorted({r[0] for r in rows})
    ratios = []
    for drawn in ad.replicate_weights([r[1] for r in rows], seed, stream, count):
        o, e = (np.array([sum(drawn.get(p, 0) * v[i] for j, p, *v in rows if j == judge) for judge in judges], dtype=float) for i in (0, 1))
        a = ad.fit_shape(o, e)
        ratios.append((a + o) / (a + e))
    low, high = np.quantile(np.array(ratios), [0.025, 0.975], axis=0)
    return dict(zip(judges, zip(low, high)))


def test_draws_are_those_of_the_stream():
    keys = [f"p{i:03}" for i in range(57)]
    for plain, made in zip(ad.replicate_weights(keys, 7, "bootstrap:x:none", 6), ad._draws(7, "bootstrap:x:none", len(keys), 6), strict=True):
        assert [plain.get(k, 0) for k in keys] == made.tolist()


def test_intervals_of_all_judges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(15, 35), f"p{rng.randrange(40)}", rng.randrange(2), rng.random()) for _ in range(300)] + [(99, "p1", 1, 0.4)]
    df = spark.createDataFrame(rows, "judge_id long, person_id string, outcome int, predicted double")
    got = {r.judge_id: (r.low, r.high) for r in ad.bootstrap_intervals(df, 7, "bootstrap:x:none", 20).collect()}
    want = plain_intervals(rows, 7, "bootstrap:x:none", 20)
    assert set(got) == set(want)
    for j in want:
        assert got[j] == pytest.approx(want[j], rel=1e-6)


def test_persons_may_be_many(spark):
    rows = spark.range(1_000_010).selectExpr("id % 3 AS judge_id", "CAST(id AS string) AS person_id", "CAST(id % 2 AS int) AS outcome", "0.5D AS predicted")
    assert {(r.judge_id, r.replicates) for r in ad.bootstrap_intervals(rows, 7, "bootstrap:x:none", 2).collect()} == {(0, 2), (1, 2), (2, 2)}


def test_places_follow_the_sorted_persons(spark):
    names = [f"p{i}" for i in range(500)]
    rows, n = ad._placed(spark.createDataFrame([(x,) for x in names * 2], "person_id string").repartition(7))
    assert n == 500 and {(r.person_id, r.place) for r in rows.collect()} == {(x, i) for i, x in enumerate(sorted(names))}


def test_a_judge_of_several_tasks_has_whole_sums(spark):
    rows = spark.range(90_000).selectExpr("CAST(id % 500 AS int) AS place", "if(id % 10 = 0, id % 7, -1) AS judge_id", "CAST(id % 2 AS int) AS outcome", "0.25D AS predicted")
    rows = ad._in_tasks(rows, "judge_id")
    parts = rows.where("judge_id = -1").selectExpr("spark_partition_id() AS i").distinct().count()
    sums = ad._judge_sums(rows, (7, "bootstrap:x:none", 500, 3)).collect()
    assert parts > 1 and len(sums) == 8
    place, judge = np.arange(90_000) % 500, np.where(np.arange(90_000) % 10 == 0, np.arange(90_000) % 7, -1)
    for r, drawn in enumerate(ad._draws(7, "bootstrap:x:none", 500, 3)):
        for s in sums:
            at = judge == s.judge_id
            assert s.drawn[r] == drawn[place][at].sum() and s.expected[r] == pytest.approx(0.25 * s.drawn[r])
