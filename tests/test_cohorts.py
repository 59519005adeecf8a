"""Gates, deferral, outcomes and survival on tiny frames with hard edges."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.frame import SCHEMAS, SOURCES, Frame, FrameError, empty_frame, validate_table
from cohortloom.operators import cohorts, gates, metrics, outcomes
from cohortloom.plans.registry import BY_SLUG, METRICS, Metric, metrics_of

T0 = dt.datetime(2020, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def sources(spark):
    every = ["new_case", "reconviction", "failure_to_appear", "revocation"]
    return spark.createDataFrame([("s", dt.date(2020, 1, 1), dt.date(2021, 12, 31), every, ["deciding_judge"], "cross_case", ["release"])], SOURCES)


def frame_of(spark, sources, **rows):
    f = empty_frame(spark, sources)
    made = {}
    for name, data in rows.items():
        schema = SCHEMAS[name]
        made[name] = spark.createDataFrame([tuple(r.get(c.name, "s" if c.name == "source_id" else None) for c in schema) for r in data], schema)
    return f.with_tables(**made)


def test_tables_are_checked(spark, sources):
    f = empty_frame(spark, sources)
    with pytest.raises(FrameError):
        validate_table("cases", f.cases.drop("status"))
    with pytest.raises(FrameError):
        validate_table("cases", f.cases.withColumn("filed_at", F.lit("x")))
    validate_table("cases", f.cases.withColumn("more", F.lit(1)))


def test_registry():
    assert len(METRICS) == 36 and len(BY_SLUG) == 36
    assert len(metrics_of("windowed_rate")) == 15 and len(metrics_of("survival")) == 3 and len(metrics_of("observed_expected")) == 3
    with pytest.raises(ValueError):
        Metric("x", "count", "cases", "court_of_case")


def test_assignment_edges(spark, sources):
    spans = [("j1", 0, 10), ("j1", 5, 12), ("j2", 10, None), ("j3", 11, 11)]
    f = frame_of(spark, sources, assignments=[{"case_id": "c", "judge_id": j, "start_at": day(a), "end_at": None if b is None else day(b)} for j, a, b in spans])
    rows = spark.createDataFrame([("s", f"r{n}", "c", None if n is None else day(n)) for n in (0, 9, 10, 11, 12, None)], "source_id string, id string, case_id string, at timestamp")
    got = sorted((r.id, r.subject_id) for r in gates.rows_assigned_at_time(f, rows, "at").collect())
    assert got == [("r0", "j1"), ("r10", "j1"), ("r10", "j2"), ("r11", "j1"), ("r11", "j2"), ("r12", "j2"), ("r9", "j1")]
    with pytest.raises(gates.GateError):
        gates.gate_rows(f, "court_of_case", rows, subject_type="judge")
    with pytest.raises(gates.GateError):
        gates.gate_rows(f, "deciding_judge", rows, subject_type="judge", judge_column=None)


def test_coverage_edges(spark, sources):
    f = empty_frame(spark, sources)
    at = [dt.datetime(2019, 12, 31, 23, 59, 59, 999999), T0, dt.datetime(2021, 12, 31, 23, 59, 59, 999999), dt.datetime(2022, 1, 1), None]
    rows = spark.createDataFrame([("s", i, a) for i, a in enumerate(at)], "source_id string, i int, at timestamp")
    assert sorted(r.i for r in gates.within_coverage(f, rows, "at").collect()) == [1, 2]


def slow_defer(start, terms):
    applied, now = 0, start
    while hit := [(b, d) for a, b, d in terms if a <= now < b]:
        end, days = max(hit)
        now, applied = end, applied + days
    return now, applied


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=6), st.lists(st.integers(-2, 40), min_size=1, max_size=4))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_deferral_is_the_plain_fixpoint(spark, terms, starts):
    t = [(a, a + d, d) for a, d in terms]
    tdf = spark.createDataFrame([("s", "p", day(a), day(b), d) for a, b, d in t], "source_id string, person_id string, term_start timestamp, term_end timestamp, term_days long")
    c = spark.createDataFrame([("s", "p", i, day(n), 0) for i, n in enumerate(starts)], "source_id string, person_id string, i int, start timestamp, applied long")
    got = {r.i: ((r.exposure_start - T0).days, r.deferral_days) for r in cohorts.defer(c, tdf).collect()}
    assert got == {i: slow_defer(n, t) for i, n in enumerate(starts)}


def test_outcome_edges(spark):
    events = spark.createDataFrame([("s", "p", "new_case", day(n), c) for n, c in ((0, "other"), (10, "own"), (11, None), (30, "other"), (5, "own"))] + [("s", "p", "revocation", day(3), None)], "source_id string, person_id string, event_type string, event_at timestamp, related_case_id string")
    cohort = spark.createDataFrame([("s", "p", "own", day(0)), ("s", "p", "own", day(30)), ("s", "q", "own", day(0))], "source_id string, person_id string, case_id string, exposure_start timestamp")
    got = [(r.person_id, r.exposure_start, r.first_outcome_at) for r in outcomes.first_outcomes(events, cohort, "new_case").collect()]
    assert sorted(got, key=repr) == sorted([("p", day(0), day(30)), ("p", day(30), None), ("q", day(0), None)], key=repr)
    assert {r.first_outcome_at for r in outcomes.first_outcomes(events, cohort, "revocation").where("person_id = 'p'").collect()} == {day(3), None}


def test_window_edges(spark):
    us = dt.timedelta(microseconds=1)
    rows = [("at_end", day(30), day(61)), ("late", day(30) + us, day(61)), ("censored_at_end", day(30), day(30)), ("followed", day(29), day(30) + us), ("none", None, day(400))]
    c = spark.createDataFrame([(n, T0, o, e) for n, o, e in rows], "member_id string, exposure_start timestamp, first_outcome_at timestamp, covered_to timestamp")
    got = {r.member_id: (r.has_outcome, r.followed, r.counted) for r in outcomes.member_windows(c, (30,)).collect()}
    assert got == {"at_end": (True, True, True), "late": (False, True, False), "censored_at_end": (True, False, False), "followed": (True, True, True), "none": (False, True, False)}


def slow_survival(members, windows):
    out = []
    for w in windows:
        s, v = 1.0, 0.0
        for t in sorted({t for t, e in members if e}):
            if t > w:
                break
            n, d = sum(x >= t for x, _ in members), sum(x == t and e for x, e in members)
            s *= 1 - d / n
            v += 0.0 if n == d else d / (n * (n - d))
        out.append((1 - s, s * math.sqrt(v)))
    return out


@given(st.lists(st.tuples(st.integers(-3, 40), st.booleans()), min_size=1, max_size=25))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_survival_is_the_plain_product(spark, members):
    windows = (5, 10, 30)
    end = day(100)
    rows = [("s", "judge", "j", day(0), end - dt.timedelta(days=t) if not e else day(0), day(t) if e else None, end) for t, e in members]
    c = spark.createDataFrame(rows, "source_id string, subject_type string, subject_id string, index_at timestamp, exposure_start timestamp, first_outcome_at timestamp, covered_to timestamp")
    got = {r.window_days: (r.incidence, r.error) for r in outcomes.kaplan_meier(c, windows).where("calendar_year IS NULL").collect()}
    for w, (i, e) in zip(windows, slow_survival(members, windows)):
        assert got[w] == (pytest.approx(i, abs=1e-9), pytest.approx(e, abs=1e-9))


def test_empty_subjects_have_zero_rows(spark, sources):
    f = frame_of(spark, sources, courts=[{"id": "k", "jurisdiction_id": "x"}], assignments=[{"case_id": "c", "judge_id": "j", "start_at": day(0)}])
    rows = [(r.subject_type, r.subject_id, r.denominator, r.rate, r.suppressed) for r in metrics.compute_share(f, BY_SLUG["pretrial_release_share"]).collect()]
    assert sorted(rows) == [("court", "k", 0, None, True), ("judge", "j", 0, None, True)]


def test_lead_rows_break_ties_as_declared(spark, sources):
    rows = [("a", 5, None, "j1"), ("b", 9, None, "j2"), ("c", 9, "r2", "j3"), ("d", 9, "r1", None)]
    f = frame_of(spark, sources, charges=[{"id": i, "case_id": "c", "person_id": "p", "filed_at": day(0), "disposed_at": day(n), "disposition": "dismissed", "source_row_id": s, "judge_id": j} for i, n, s, j in rows])
    (r,) = cohorts.case_dispositions(f).collect()
    assert (r.disposition_at, r.judge_id) == (day(9), None)
