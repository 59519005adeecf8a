"""Parts of the observed-to-expected ratios against plain versions."""

import numpy as np

from cohortloom.operators import adjustment as ad
from cohortloom.sources import adapter
from cohortloom.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_halves_give_the_sums_of_whole_rows():
    rng, width = np.random.default_rng(5), 9
    x = np.stack([np.zeros(400, dtype=int), rng.choice([1, 2, width], 400), rng.choice([3, width], 400), rng.choice([4, 5, 6, width], 400), rng.choice([7, 8, width], 400)], axis=1)
    dense = np.zeros((400, width + 1))
    np.put_along_axis(dense, x, 1.0, axis=1)
    dense, v, beta = dense[:, :width], rng.random(400), rng.normal(size=width)
    halves = ad._Halves(x, width)
    np.testing.assert_allclose(halves.eta(beta), dense @ beta)
    np.testing.assert_allclose(halves.by_column(v), dense.T @ v)
    np.testing.assert_allclose(halves.by_pair(v), (dense * v[:, None]).T @ dense)


def test_the_logistic_function_does_not_overflow():
    with np.errstate(all="raise", under="ignore"):
        np.testing.assert_allclose(ad.expit(np.array([-1e4, -2.0, 0.0, 2.0, 1e4])), [0.0, 1 / (1 + np.exp(2.0)), 0.5, 1 / (1 + np.exp(-2.0)), 1.0])


def test_a_frame_of_plans_has_the_stored_rows_and_writes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapter, "shared_dir", lambda spark: f"file://{tmp_path}")
    plans = adapter.orders_frame(spark, SF, stored=False)
    assert not list(tmp_path.iterdir())
    stored = adapter.orders_frame(spark, SF)
    assert list(tmp_path.iterdir()) and shared_dir(spark)
    for name in stored.tables:
        assert plans.tables[name].exceptAll(stored.tables[name]).isEmpty() and stored.tables[name].exceptAll(plans.tables[name]).isEmpty()


def test_history_of_charges_filed_at_several_instants(spark):
    day = lambda n: f"TIMESTAMP '2000-01-01' + INTERVAL {n} DAY"
    charges = [("a", "p", 0, 5, "dismissed"), ("a", "p", 12, 13, "convicted_plea"), ("b", "p", 1, 20, "convicted_plea"), ("b", "p", 2, 4, "dismissed"), ("c", "p", None, 3, "dismissed"), ("d", "q", 0, 4, "convicted_verdict")]
    cases = [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("x", 10), ("y", 10)]
    at = lambda n: "CAST(NULL AS TIMESTAMP)" if n is None else day(n)
    frame = type("Tables", (), {})()
    frame.cases = spark.sql(" UNION ALL ".join(f"SELECT 's' AS source_id, '{c}' AS id, 'k' AS court_id, {day(n)} AS filed_at" for c, n in cases))
    frame.charges = spark.sql(" UNION ALL ".join(f"SELECT 's' AS source_id, '{c}' AS case_id, '{p}' AS person_id, {at(f)} AS filed_at, {day(d)} AS disposed_at, '{v}' AS disposition" for c, p, f, d, v in charges))
    one = "SELECT 's' AS source_id, 'm' AS member_id, 'x' AS case_id, 'p' AS person_id"
    for events, want in ((one, [("m", 3, 0, True)]), (f"{one} UNION ALL SELECT 's', 'n', 'y', 'q'", [("m", 3, 0, True), ("n", 1, 1, False)]), (f"{one} UNION ALL SELECT 's', 'm', 'x', 'q'", [("m", 4, 1, True)])):
        found = ad.history_features(frame, ad.with_cases(frame, spark.sql(events)))
        assert sorted((r.member_id, r.cases, r.convictions, r.pending) for r in found.collect()) == want
