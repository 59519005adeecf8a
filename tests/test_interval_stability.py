"""Interval stability is over all judges."""

from cohortloom import queries as reference
from cohortloom.operators import validation as va
from cohortloom.queries import adjustment as aq

SF = "/root/testdata/sf0.01"


def test_interval_stability_is_over_all_judges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(va, "interval_stability", lambda i: seen.append(i) or i)
    reference.queries()["va5_interval_stability"](spark, SF)
    every = {r.judge_id for r in aq._scores(spark, SF).select("judge_id").distinct().collect()}
    assert {r.judge_id for r in seen[0].select("judge_id").collect()} == every
