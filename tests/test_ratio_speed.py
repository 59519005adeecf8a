"""What the ratios do once or not at all, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import adjustment as ad
from cohortloom.sources import adapter

SF = "/root/testdata/sf0.001"


def test_the_likelihood_of_shapes_is_the_plain_one():
    rng = np.random.default_rng(4)
    for n in (1, 16, 17, 700):
        e = rng.gamma(2, 8, n)
        o = rng.poisson(e).astype(float)
        at = ad._likelihood_of_shapes(o, e)
        for shape in (0.5, 3.0, 80.0, 1000.0):
            assert at(shape) == pytest.approx(ad.marginal_log_likelihood(shape, o, e), rel=1e-10)
    few, huge = np.full(40, 3.0), np.full(40, 1e18)
    assert ad._likelihood_of_shapes(few, huge)(0.5) == pytest.approx(ad.marginal_log_likelihood(0.5, few, huge), rel=1e-10)


def test_packed_weights_are_whole():
    for values in ([0], [0, 255], [256, 1], [70_000, 3], [2**40, 0]):
        assert ad._unpacked(ad._packed(np.array(values))).tolist() == values


def test_weights_are_drawn_once_for_all_passes(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("CAST(id % 200 AS int) AS place", "CAST(id % 3 = 0 AS int) AS outcome", "transform(sequence(0, 11), i -> if(i = 0, 0, if(i = 1 AND id % 2 = 0, 1, if(i = 2 AND id % 5 = 0, 2, -1)))) AS active").repartition(3)
    folded = ad._folded(rows, (7, "bootstrap:x:none", 200, 4), 3)
    place, n, y = np.arange(3000) % 200, {}, {}
    for r in folded.where("replicate IS NOT NULL").collect():
        n[r.replicate] = n.get(r.replicate, 0) + int(ad._unpacked(bytes(r.n)).sum())
        y[r.replicate] = y.get(r.replicate, 0) + int(ad._unpacked(bytes(r.y)).sum())
    for r, drawn in enumerate(ad._draws(7, "bootstrap:x:none", 200, 4)):
        assert (n[r], y[r]) == (drawn[place].sum(), drawn[place][::3].sum())
    passes = []
    newton = ad._newton
    monkeypatch.setattr(ad, "_folded", lambda *a: passes.append("drawn") or folded)
    monkeypatch.setattr(ad, "_newton", lambda *a: passes.append("pass") or newton(*a))
    assert set(ad._refits(rows, (7, "bootstrap:x:none", 200, 4), np.zeros(3), 1.0)) == set(range(4))
    assert passes.count("drawn") == 1 and passes.count("pass") > 1


def test_charges_of_some_cases_are_those_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapter, "shared_dir", lambda spark: f"file://{tmp_path}")
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    given = adapter.inputs(spark, SF, "customer", "supplier", "nation")
    given |= {"orders": orders.union(orders.limit(20)), "lineitem": lines.union(lines.where("l_orderkey % 7 = 0")).union(lines.where("l_orderkey % 7 = 0"))}
    for name, table in given.items():
        table.coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")
    frame = adapter.orders_frame(spark, f"{tmp_path}/in", stored=False)
    cases = frame.cases.where("CAST(id AS long) % 3 = 1").select("source_id", F.col("id").alias("case_id"))
    got, want = frame.charges_of(cases), frame.charges.join(cases.distinct(), ["source_id", "case_id"], "left_semi")
    want = want.select(*got.columns)
    assert 0 < got.count() < frame.charges.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert frame.with_tables(charges=want).charges_of(cases) is want


def test_members_of_one_case_are_folded_where_they_meet_charges(spark):
    frame = adapter.orders_frame(spark, SF, stored=False)
    own = ad.decision_events(frame).cache()
    assert ad.single_members(own)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = lambda single: ad.lead_features(adapter.orders_frame(spark, SF, stored=False), own, single)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(True) == shuffles(False) - 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    once, plain = ad.lead_features(frame, own, True), ad.lead_features(frame, own)
    assert plain.count() and once.exceptAll(plain).isEmpty() and plain.exceptAll(once).isEmpty()
    # One member in two cases is one row, of both cases' charges.
    twice = own.union(own.selectExpr("source_id", "'d0' AS member_id", *[c for c in own.columns if c not in ad.KEY]).select(*own.columns).limit(3))
    assert not ad.single_members(twice)
    levels = ad.lead_features(frame, twice, ad.single_members(twice))
    assert levels.count() == levels.select(*ad.KEY).distinct().count()


def test_starts_leave_all_terms_in_turn(spark):
    terms = {"a": [(0, 5), (5, 9), (20, 30)], "b": [(0, 10), (2, 12), (12, 13)], "c": [(4, 6)], "d": []}
    rows = [(p, t, e, e - t) for p, own in terms.items() for t, e in own]
    days = "SELECT 's' AS source_id, '{}' AS person_id, TIMESTAMP '2000-01-01' + INTERVAL {} DAY AS {}"
    held = spark.sql(" UNION ALL ".join(days.format(p, t, "term_start") + f", TIMESTAMP '2000-01-01' + INTERVAL {e} DAY AS term_end, {n}L AS term_days" for p, t, e, n in rows))
    starts = [(p, s) for p in terms for s in (0, 3, 5, 9, 12)]
    cohort = spark.sql(" UNION ALL ".join(days.format(p, s, "start") + f", 1L AS applied, {s} AS s" for p, s in starts))
    from cohortloom.operators import cohorts

    got = {(r.person_id, r.s): (r.d, r.deferral_days) for r in cohorts.defer(cohort, held).selectExpr("person_id", "s", "datediff(exposure_start, DATE '2000-01-01') AS d", "deferral_days").collect()}
    for p, s in starts:
        at, applied = s, 1
        while own := [(e, e - t) for t, e in terms[p] if t <= at < e]:
            at, applied = max(own)[0], applied + max(own)[1]
        assert got[p, s] == (at, applied)
