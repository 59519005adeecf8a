"""A run of all descriptive metrics finds what they share once."""

from cohortloom.operators import cohorts, metrics, outcomes
from cohortloom.queries import cohort as cq

SF = "/root/testdata/sf0.001"


def test_a_run_finds_shared_rows_once(spark, monkeypatch):
    made = []
    for of, name in ((cohorts, "cohort"), (outcomes, "all_justice_events"), (metrics, "_population_rows")):
        monkeypatch.setattr(of, name, lambda *a, f=getattr(of, name), n=name, **b: made.append(n) or f(*a, **b))
    cq.ag11(spark, SF)
    assert (made.count("cohort"), made.count("all_justice_events"), made.count("_population_rows")) == (3, 1, 7)


def test_the_summary_counts_every_metric(spark):
    found = {r.slug: r.observations for r in cq.ag12(spark, SF).collect()}
    assert set(found) == {m.slug for m in cq._DESCRIPTIVE} and all(found.values())


def test_first_of_each_outcome_is_that_of_one(spark):
    f = cq.orders_frame(spark, SF)
    c, events = cohorts.cohort(f, "release", "deciding_judge", ("court",)), outcomes.all_justice_events(f)
    wanted = ("new_case", "failure_to_appear")
    both = outcomes.first_of_each(outcomes.person_events(events, wanted), c, wanted)
    for x in wanted:
        one = outcomes.first_outcomes(events, c, x).select("member_id", "first_outcome_at")
        assert sorted(map(tuple, both.select("member_id", f"first_{x}").collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
