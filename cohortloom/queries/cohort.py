"""Queries of scans, gates, cohorts, outcomes and metrics over the orders world."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, WINDOWS, Z, round6
from ..operators import cohorts, gates, metrics, outcomes
from ..plans.registry import ANCHORS, BY_SLUG, METRICS, Metric
from ..sources.adapter import ORDERS_SOURCE, oracle_tables, orders_frame
from ..sources.shared import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_FROM, _TO = f"TIMESTAMP '{ORDERS_SOURCE[1]} 00:00:00'", f"(TIMESTAMP '{ORDERS_SOURCE[2]} 00:00:00' + INTERVAL 1 DAY)"
_ALL = oracle_tables("cases", "charges", "decisions", "sentences", "assignments", "events", "justice_events", "persons", "courts")
_FINAL = ", ".join(f"'{v}'" for v in cohorts.FINAL_DISPOSITIONS)
_NOT_JUDICIAL = "actor_type NOT IN ('legislature_or_mandatory_rule', 'unknown') AND discretion NOT IN ('mandatory', 'unknown')"


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def covered(anchor: str) -> str:
    """SQL: the anchor is within coverage."""
    return f"{anchor} >= {_FROM} AND {anchor} < {_TO}"


_SUBJECTS = """subjects AS (
SELECT DISTINCT 'judge' AS subject_type, judge_id AS subject_id FROM (
  SELECT judge_id FROM assignments UNION ALL SELECT judge_id FROM charges UNION ALL SELECT judge_id FROM decisions UNION ALL SELECT judge_id FROM sentences)
WHERE judge_id IS NOT NULL UNION ALL SELECT 'court', id FROM courts)"""
_LD1 = f"""case_disp AS (
SELECT case_id AS id, disposed_at AS disposition_at, judge_id FROM charges WHERE disposition IN ({_FINAL}) AND disposed_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY disposed_at DESC NULLS LAST, source_row_id ASC NULLS LAST, id ASC) = 1)"""


def population_sql(m: Metric) -> str:
    """SQL: rows (subject_type, subject_id, anchor, ...) of a metric's population."""
    anchor = ANCHORS[m.population]
    court = "SELECT 'court' AS subject_type, c.court_id AS subject_id, r.* FROM src r JOIN cases c ON c.id = r.case_id"
    judge_where = ""
    if m.population in ("cases", "defendants"):
        src, judge = "SELECT *, id AS case_id FROM cases", "SELECT 'judge', a.judge_id, r.* FROM src r JOIN (SELECT DISTINCT case_id, judge_id FROM assignments) a ON a.case_id = r.case_id WHERE a.judge_id IS NOT NULL"
    else:
        if m.population == "pretrial_decisions":
            where = ["decision_type = 'pretrial_release'"]
            if m.actors:
                where.append(f"actor_type IN ({', '.join(repr(x) for x in m.actors)})")
            if m.discretion:
                where.append(f"discretion IN ({', '.join(repr(x) for x in m.discretion)})")
            src, judge_where = f"SELECT * FROM decisions WHERE {' AND '.join(where)}", f" AND {_NOT_JUDICIAL}"
        elif m.population == "disposed_charges":
            src = f"SELECT * FROM charges WHERE disposition IN ({_FINAL}) AND disposed_at IS NOT NULL"
        elif m.population == "disposed_cases":
            src = "SELECT k.*, k.id AS case_id, d.disposition_at, d.judge_id FROM cases k JOIN case_disp d ON d.id = k.id"
        else:
            src = "SELECT * FROM sentences"
        judge = f"SELECT 'judge', r.judge_id, r.* FROM src r WHERE r.judge_id IS NOT NULL{judge_where}"
    parts = [p for s, p in (("court", court), ("judge", judge)) if s in m.subjects]
    return f"src AS ({src}),\npop AS (SELECT *, {anchor} AS anchor FROM ({' UNION ALL '.join(parts)}) WHERE {covered(anchor)}),\nboth_periods AS (SELECT pop.*, y.calendar_year FROM pop, UNNEST([NULL, CAST(year(anchor) AS INT)]) AS y(calendar_year))"


def counted_sql(m: Metric) -> str:
    """SQL: the row counts."""
    parts = [f"coalesce({c} = {str(v).lower() if isinstance(v, bool) else repr(v)}, false)" for c, v in m.counted.items()]
    return " AND ".join(parts) or "true"


def wilson_sql(k: str, n: str) -> str:
    """SQL: low and high of the interval, rounded."""
    p, zz = f"(CAST({k} AS DOUBLE) / {n})", Z * Z
    base = f"(1.0 + {zz!r} / {n})"
    mid = f"(({p} + {zz!r} / (2.0 * {n})) / {base})"
    half = f"({Z!r} / {base} * sqrt({p} * (1.0 - {p}) / {n} + {zz!r} / (4.0 * {n} * {n})))"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {mid} - {half}), 6) END AS low, CASE WHEN {n} > 0 THEN round(least(1.0, {mid} + {half}), 6) END AS high"


def empty_sql(m: Metric, zeros: str) -> str:
    """SQL: whole-window zeros of subjects without rows."""
    kinds = ", ".join(repr(s) for s in m.subjects)
    return f"UNION ALL SELECT subject_type, subject_id, NULL, {zeros} FROM subjects s WHERE subject_type IN ({kinds}) AND NOT EXISTS (SELECT 1 FROM agg a WHERE a.subject_type = s.subject_type AND a.subject_id = s.subject_id AND a.calendar_year IS NULL)"


def _tidy(df: DataFrame, *figures: str, places: int = 6) -> DataFrame:
    """Without the constant source; figures at a few places."""
    out = df.drop("source_id")
    for c in figures:
        out = out.withColumn(c, F.round(c, places))
    return out


def _register_metric(m: Metric) -> None:
    prefix = {"count": "ag1", "share": "ag2", "windowed_rate": "ag3", "survival": "ag4", "distribution": "ag5", "median": "ag6"}[m.kind]
    head = f"WITH {_ALL},\n{_SUBJECTS},\n{_LD1},\n"
    keys = "subject_type, subject_id, calendar_year"
    reason = lambda n: f"{n} < {m.threshold} AS suppressed, CASE WHEN {n} < {m.threshold} THEN 'cohort_below_threshold' END AS suppression_reason"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = metrics.COMPUTE[m.kind](orders_frame(spark, sf_dir), m)
        if m.kind == "distribution":
            table = table.drop("distribution")
        if m.kind == "median":
            table = table.withColumn("median", F.col("median").cast("double"))
        return _tidy(table, *[c for c in ("low", "high") if c in table.columns])

    if m.kind == "count":
        if m.population == "defendants":
            agg = f"people AS (SELECT DISTINCT case_id, person_id FROM (SELECT case_id, person_id FROM charges UNION ALL SELECT case_id, person_id FROM decisions UNION ALL SELECT case_id, person_id FROM sentences) WHERE person_id IS NOT NULL), agg AS (SELECT {keys}, count(DISTINCT p.person_id) AS numerator FROM both_periods b LEFT JOIN people p ON p.case_id = b.case_id GROUP BY ALL)"
        else:
            agg = f"agg AS (SELECT {keys}, CAST(sum(CASE WHEN {counted_sql(m)} THEN 1 ELSE 0 END) AS BIGINT) AS numerator FROM both_periods GROUP BY ALL)"
        sql = f"{head}{population_sql(m)},\n{agg}\nSELECT * FROM agg {empty_sql(m, '0')}"
    elif m.kind == "share":
        sql = f"{head}{population_sql(m)},\nagg AS (SELECT {keys}, CAST(sum(CASE WHEN {counted_sql(m)} THEN 1 ELSE 0 END) AS BIGINT) AS numerator, count(*) AS denominator FROM both_periods GROUP BY ALL),\nwhole AS (SELECT * FROM agg {empty_sql(m, '0, 0')})\nSELECT *, CASE WHEN denominator > 0 THEN CAST(numerator AS DOUBLE) / denominator END AS rate, {wilson_sql('numerator', 'denominator')}, {reason('denominator')} FROM whole"
    elif m.kind == "distribution":
        sums = ", ".join(f"CAST(sum(CASE WHEN disposition = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS {v}" for v in cohorts.FINAL_DISPOSITIONS)
        sql = f"{head}{population_sql(m)},\nagg AS (SELECT {keys}, count(*) AS denominator, {sums} FROM both_periods GROUP BY ALL),\nwhole AS (SELECT * FROM agg {empty_sql(m, '0, 0, 0, 0, 0')})\n" + " UNION ALL ".join(f"SELECT {keys}, denominator, '{v}' AS dimension_value, {v} AS numerator FROM whole" for v in cohorts.FINAL_DISPOSITIONS)
    elif m.kind == "median":
        measured = "CASE WHEN date_diff('day', CAST(filed_at AS DATE), CAST(disposition_at AS DATE)) >= 0 THEN date_diff('day', CAST(filed_at AS DATE), CAST(disposition_at AS DATE)) END" if m.measure == "days_to_disposition" else m.measure
        if m.dimension:
            severity = "CASE severity " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(cohorts.SEVERITIES)) + " ELSE 99 END"
            lead = f"lead AS (SELECT case_id, person_id, offense_category FROM charges WHERE disposition IN ('convicted_plea', 'convicted_verdict') QUALIFY row_number() OVER (PARTITION BY case_id, person_id ORDER BY {severity}, source_row_id NULLS LAST, id) = 1)"
            sql = f"{head}{population_sql(m)},\n{lead}\nSELECT {keys}, coalesce(offense_category, 'unclassified') AS dimension_value, count({measured}) AS denominator, CAST(median({measured}) AS DOUBLE) AS median, {reason(f'count({measured})')} FROM both_periods b LEFT JOIN lead l ON l.case_id = b.case_id AND l.person_id = b.person_id GROUP BY ALL HAVING count({measured}) > 0"
        else:
            sql = f"{head}{population_sql(m)},\nagg AS (SELECT {keys}, count({measured}) AS denominator, CAST(median({measured}) AS DOUBLE) AS median FROM both_periods GROUP BY ALL), whole AS (SELECT * FROM agg {empty_sql(m, '0, NULL')}) SELECT *, {reason('denominator')} FROM whole"
    else:
        sql = None
    query(f"{prefix}_{m.slug}", sql)(run)


# Cohorts in SQL: index events, deferral by recursion, first outcomes.
def cohort_sql(kind: str, subjects: tuple[str, ...] = ("judge", "court")) -> str:
    """SQL: co(subject_type, subject_id, member_id, case_id, person_id, index_at, exposure_start, deferral_days)."""
    if kind == "release":
        src, at, member = f"SELECT * FROM decisions WHERE decision_type = 'pretrial_release' AND {covered('decision_at')} AND detained_flag = false AND release_at IS NOT NULL", "release_at", "id"
        judge_where = f" AND {_NOT_JUDICIAL}"
    elif kind == "sentence":
        src, at, member, judge_where = "SELECT * FROM sentences", "sentence_at", "id", ""
    else:
        src = f"SELECT k.id AS case_id, d.disposition_at, d.judge_id, p.person_id FROM cases k JOIN case_disp d ON d.id = k.id JOIN (SELECT DISTINCT case_id, person_id FROM charges WHERE disposition IN ({_FINAL}) AND disposed_at IS NOT NULL) p ON p.case_id = k.id"
        at, member, judge_where = "disposition_at", "case_id", ""
    parts = {"court": f"SELECT 'court' AS subject_type, c.court_id AS subject_id, r.{member} AS member_id, r.case_id, r.person_id, r.{at} AS index_at FROM isrc r JOIN cases c ON c.id = r.case_id", "judge": f"SELECT 'judge', r.judge_id, r.{member}, r.case_id, r.person_id, r.{at} FROM isrc r WHERE r.judge_id IS NOT NULL{judge_where}"}
    start = "CASE WHEN own.own_end > index_at THEN own.own_end ELSE index_at END AS start0, CASE WHEN own.own_end > index_at THEN own.own_days ELSE 0 END AS applied0" if kind == "disposition" else "index_at AS start0, 0 AS applied0"
    return f"""isrc AS ({src}),
idx AS (SELECT * FROM ({' UNION ALL '.join(parts[s] for s in ('court', 'judge') if s in subjects)}) WHERE {covered('index_at')}),
terms AS (SELECT case_id, person_id, sentence_at AS term_start, sentence_at + to_days(CAST(incarceration_days AS INT)) AS term_end, incarceration_days AS term_days FROM sentences WHERE incarceration_days > 0),
own AS (SELECT case_id, person_id, max(term_end) AS own_end, arg_max(term_days, (term_end, term_days)) AS own_days FROM terms GROUP BY ALL),
begun AS (SELECT idx.*, {start} FROM idx LEFT JOIN own ON own.case_id = idx.case_id AND own.person_id = idx.person_id),
walk AS (SELECT DISTINCT person_id, start0, start0 AS s, CAST(0 AS BIGINT) AS applied, 0 AS k FROM begun
 UNION ALL SELECT w.person_id, w.start0, t.term_end, w.applied + t.term_days, w.k + 1 FROM walk w JOIN terms t ON t.person_id = w.person_id AND t.term_start <= w.s AND w.s < t.term_end
 QUALIFY row_number() OVER (PARTITION BY w.person_id, w.start0 ORDER BY t.term_end DESC, t.term_days DESC) = 1),
last_step AS (SELECT person_id, start0, arg_max(s, k) AS s, arg_max(applied, k) AS applied FROM walk GROUP BY ALL),
co AS (SELECT b.subject_type, b.subject_id, b.member_id, b.case_id, b.person_id, b.index_at, l.s AS exposure_start, nullif(b.applied0 + l.applied, 0) AS deferral_days
 FROM begun b JOIN last_step l ON l.person_id = b.person_id AND l.start0 = b.start0)"""


_EVENTS = """je AS (
SELECT DISTINCT person_id, event_type, event_at, related_case_id FROM justice_events WHERE event_type NOT IN ('new_case', 'new_charge', 'reconviction')
UNION SELECT person_id, 'new_charge', filed_at, case_id FROM charges WHERE person_id IS NOT NULL
UNION SELECT person_id, 'new_case', min(filed_at), case_id FROM charges WHERE person_id IS NOT NULL GROUP BY person_id, case_id
UNION SELECT person_id, 'reconviction', disposed_at, case_id FROM charges WHERE person_id IS NOT NULL AND disposed_at IS NOT NULL AND disposition IN ('convicted_plea', 'convicted_verdict'))"""


def outcome_sql(outcome: str) -> str:
    """SQL: oc = co with first_outcome_at."""
    other = "AND e.related_case_id IS NOT NULL AND e.related_case_id <> co.case_id" if outcome in outcomes.OTHER_CASE else ""
    return f"{_EVENTS},\nhits AS (SELECT co.person_id, co.case_id, co.exposure_start, min(e.event_at) AS first_outcome_at FROM (SELECT DISTINCT person_id, case_id, exposure_start FROM co) co JOIN je e ON e.person_id = co.person_id AND e.event_type = '{outcome}' AND e.event_at > co.exposure_start {other} GROUP BY ALL),\noc AS (SELECT co.*, h.first_outcome_at FROM co LEFT JOIN hits h ON h.person_id = co.person_id AND h.case_id = co.case_id AND h.exposure_start = co.exposure_start)"


def _us(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a}))"


def _register_rates() -> None:
    head = f"WITH RECURSIVE {_ALL},\n{_LD1},\n"
    for m in METRICS:
        if m.kind not in ("windowed_rate", "survival"):
            continue
        base = f"{head}{cohort_sql(m.population)},\n{outcome_sql(m.outcome)},\nboth_periods AS (SELECT oc.*, y.calendar_year FROM oc, UNNEST([NULL, CAST(year(index_at) AS INT)]) AS y(calendar_year))"
        windows = f"UNNEST([{', '.join(map(str, WINDOWS))}]) AS w(window_days)"
        keys = "subject_type, subject_id, calendar_year"
        reason = lambda n: f"{n} < {m.threshold} AS suppressed, CASE WHEN {n} < {m.threshold} THEN 'cohort_below_threshold' END AS suppression_reason"  # noqa: E731, B023
        if m.kind == "windowed_rate":
            fol = f"{_us('exposure_start', _TO)} > CAST(window_days AS BIGINT) * {DAY_US}"
            hit = f"coalesce({_us('exposure_start', 'first_outcome_at')} <= CAST(window_days AS BIGINT) * {DAY_US}, false)"
            ORACLE_SQL[f"ag3_{m.slug}"] = f"{base},\nagg AS (SELECT {keys}, CAST(window_days AS INT) AS window_days, count(*) AS eligible, CAST(sum(CASE WHEN {fol} THEN 1 ELSE 0 END) AS BIGINT) AS followed, CAST(sum(CASE WHEN {fol} AND {hit} THEN 1 ELSE 0 END) AS BIGINT) AS numerator FROM both_periods, {windows} GROUP BY ALL)\nSELECT *, CASE WHEN followed > 0 THEN CAST(numerator AS DOUBLE) / followed END AS rate, {wilson_sql('numerator', 'followed')}, {reason('followed')} FROM agg"
        else:
            ORACLE_SQL[f"ag4_{m.slug}"] = f"""{base},
du AS (SELECT {keys}, coalesce(first_outcome_at < {_TO}, false) AS event, CASE WHEN coalesce(first_outcome_at < {_TO}, false) THEN {_us('exposure_start', 'first_outcome_at')} ELSE {_us('exposure_start', _TO)} END AS t FROM both_periods),
tm AS (SELECT {keys}, t, sum(CASE WHEN event THEN 1 ELSE 0 END) AS d, count(*) AS c FROM du GROUP BY ALL),
rk AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY t DESC) AS n FROM tm),
cv AS (SELECT {keys}, t, product(1.0 - CAST(d AS DOUBLE) / n) OVER p AS s, sum(CASE WHEN n = d THEN 0.0 ELSE CAST(d AS DOUBLE) / (CAST(n AS DOUBLE) * (n - d)) END) OVER p AS v FROM rk WHERE d > 0 WINDOW p AS (PARTITION BY {keys} ORDER BY t)),
agg AS (SELECT {keys}, CAST(window_days AS INT) AS window_days, count(*) AS eligible, CAST(sum(CASE WHEN event AND t <= CAST(window_days AS BIGINT) * {DAY_US} THEN 1 ELSE 0 END) AS BIGINT) AS events, CAST(sum(CASE WHEN NOT event AND t < CAST(window_days AS BIGINT) * {DAY_US} THEN 1 ELSE 0 END) AS BIGINT) AS censored FROM du, {windows} GROUP BY ALL),
pt AS (SELECT a.*, coalesce(arg_max(cv.s, cv.t), 1.0) AS s, coalesce(arg_max(cv.v, cv.t), 0.0) AS v FROM agg a LEFT JOIN cv ON cv.subject_type = a.subject_type AND cv.subject_id = a.subject_id AND cv.calendar_year IS NOT DISTINCT FROM a.calendar_year AND cv.t <= CAST(a.window_days AS BIGINT) * {DAY_US} GROUP BY ALL)
SELECT {keys}, window_days, eligible, events, censored, round(1.0 - s, 9) AS incidence, round(s * sqrt(v), 9) AS error, round(greatest(0.0, 1.0 - s - {Z!r} * s * sqrt(v)), 9) AS low, round(least(1.0, 1.0 - s + {Z!r} * s * sqrt(v)), 9) AS high, {reason('eligible')} FROM pt"""


for _m in METRICS:
    if _m.kind != "observed_expected":
        _register_metric(_m)
_register_rates()


def _survival(slug: str):
    m = BY_SLUG[slug]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tidy(metrics.compute_survival(orders_frame(spark, sf_dir), m), "incidence", "error", "low", "high", places=9)

    return run


for _m in METRICS:
    if _m.kind == "survival":
        QUERIES[f"ag4_{_m.slug}"] = _survival(_m.slug)

_T = f"WITH RECURSIVE {_ALL},\n{_SUBJECTS},\n{_LD1}\n"


@query("ga1_rows_of_court", _T + f"SELECT c.court_id AS subject_id, count(*) AS n FROM decisions d JOIN cases c ON c.id = d.case_id WHERE {covered('decision_at')} GROUP BY ALL")
def ga1(spark, sf_dir):
    """GA1, FI1."""
    f = orders_frame(spark, sf_dir)
    return gates.within_coverage(f, gates.rows_of_court(f, f.decisions), "decision_at").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ga2_rows_of_judge_column", _T + "SELECT judge_id AS subject_id, count(*) AS n FROM charges WHERE judge_id IS NOT NULL GROUP BY ALL")
def ga2(spark, sf_dir):
    """GA2."""
    return gates.rows_of_judge_column(orders_frame(spark, sf_dir).charges).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ga3_assigned_at_time", _T + "SELECT judge_id AS subject_id, count(*) AS n FROM (SELECT DISTINCT c.id, a.judge_id FROM charges c JOIN assignments a ON a.case_id = c.case_id WHERE c.disposed_at IS NOT NULL AND a.start_at <= c.disposed_at AND (a.end_at IS NULL OR c.disposed_at < a.end_at)) GROUP BY ALL")
def ga3(spark, sf_dir):
    """GA3, JO4."""
    f = orders_frame(spark, sf_dir)
    return gates.rows_assigned_at_time(f, f.charges.drop("judge_id"), "disposed_at").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ga4_assigned_ever", _T + "SELECT a.judge_id AS subject_id, count(*) AS n FROM cases c JOIN (SELECT DISTINCT case_id, judge_id FROM assignments) a ON a.case_id = c.id GROUP BY ALL")
def ga4(spark, sf_dir):
    """GA4, GA6."""
    f = orders_frame(spark, sf_dir)
    return gates.attributed_cases(f, f.cases, subjects=("judge",)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ga7_pretrial_decisions", _T + f"SELECT judge_id AS subject_id, count(*) AS n FROM decisions WHERE decision_type = 'pretrial_release' AND {_NOT_JUDICIAL} AND {covered('decision_at')} GROUP BY ALL")
def ga7(spark, sf_dir):
    """GA5, GA7, FI3, FI6."""
    return gates.pretrial_decisions(orders_frame(spark, sf_dir), subjects=("judge",)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ga8_not_attributable", "SELECT 'orders' AS source_id, 'x' AS slug, 'filing_judge' AS gate")
def ga8(spark, sf_dir):
    """GA8: one invented gate that the source does not record."""
    return gates.not_attributable(orders_frame(spark, sf_dir), [("x", "filing_judge"), ("y", "deciding_judge"), ("z", "court_of_case")])


@query("ga9_subjects", _T + "SELECT * FROM subjects")
def ga9(spark, sf_dir):
    """GA9, ST2, ST5."""
    return gates.subjects_of(orders_frame(spark, sf_dir)).drop("source_id")


@query("fi7_statutory_releases", _T + f"SELECT c.court_id AS subject_id, count(*) AS n FROM decisions d JOIN cases c ON c.id = d.case_id WHERE decision_type = 'pretrial_release' AND actor_type = 'legislature_or_mandatory_rule' AND discretion = 'mandatory' AND {covered('decision_at')} GROUP BY ALL")
def fi7(spark, sf_dir):
    """FI7."""
    return gates.statutory_releases(orders_frame(spark, sf_dir)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("fi8_unknown_actor", _T + f"SELECT c.court_id AS subject_id, count(*) AS n FROM decisions d JOIN cases c ON c.id = d.case_id WHERE decision_type = 'pretrial_release' AND actor_type = 'unknown' AND {covered('decision_at')} GROUP BY ALL")
def fi8(spark, sf_dir):
    """FI8."""
    return gates.unknown_actor_pretrial_decisions(orders_frame(spark, sf_dir)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("ld1_case_dispositions", _T + "SELECT id, CAST(disposition_at AS DATE) AS disposition_at, judge_id FROM case_disp")
def ld1(spark, sf_dir):
    """LD1, FI4, SO2."""
    return cohorts.case_dispositions(orders_frame(spark, sf_dir)).select("id", F.to_date("disposition_at").alias("disposition_at"), "judge_id")


@query("jo1_disposed_cases", _T + "SELECT k.id, k.court_id, CAST(k.filed_at AS DATE) AS filed_at, CAST(d.disposition_at AS DATE) AS disposition_at FROM cases k JOIN case_disp d ON d.id = k.id")
def jo1(spark, sf_dir):
    """JO1, PO2."""
    return cohorts.disposed_cases(orders_frame(spark, sf_dir)).select("id", "court_id", F.to_date("filed_at").alias("filed_at"), F.to_date("disposition_at").alias("disposition_at"))


@query("jo3_disposed_semi_join", _T + "SELECT id, court_id FROM cases WHERE id IN (SELECT id FROM case_disp)")
def jo3(spark, sf_dir):
    """JO3."""
    f = orders_frame(spark, sf_dir)
    return f.cases.join(cohorts.case_dispositions(f), ["source_id", "id"], "left_semi").select("id", "court_id")


@query("po2_disposed_case_persons", _T + f"SELECT DISTINCT case_id, person_id FROM charges WHERE disposition IN ({_FINAL}) AND disposed_at IS NOT NULL")
def po2(spark, sf_dir):
    """PO2."""
    return cohorts.disposed_case_persons(orders_frame(spark, sf_dir)).drop("source_id")


@query("ag8_case_persons", _T + "SELECT case_id, person_id FROM charges UNION SELECT case_id, person_id FROM decisions UNION SELECT case_id, person_id FROM sentences")
def ag8(spark, sf_dir):
    """AG8, ST2."""
    return cohorts.case_persons(orders_frame(spark, sf_dir)).drop("source_id")


@query("ex1_incarceration_terms", _T + "SELECT case_id, person_id, CAST(sentence_at AS DATE) AS term_start, CAST(sentence_at + to_days(CAST(incarceration_days AS INT)) AS DATE) AS term_end, incarceration_days AS term_days FROM sentences WHERE incarceration_days > 0")
def ex1(spark, sf_dir):
    """EX1."""
    return cohorts.incarceration_terms(orders_frame(spark, sf_dir)).select("case_id", "person_id", F.to_date("term_start").alias("term_start"), F.to_date("term_end").alias("term_end"), "term_days")


for _kind, _gate in (("release", "deciding_judge"), ("disposition", "disposing_judge"), ("sentence", "sentencing_judge")):

    def _cohort(spark, sf_dir, kind=_kind, gate=_gate):
        """IE1-IE4, EX2-EX4, JO6, JO7, LD3."""
        c = cohorts.cohort(orders_frame(spark, sf_dir), kind, gate)
        return c.select("subject_type", "subject_id", "member_id", "case_id", "person_id", F.to_date("index_at").alias("index_at"), F.to_date("exposure_start").alias("exposure_start"), "deferral_days")

    query(f"ex4_{_kind}_cohort", f"WITH RECURSIVE {_ALL},\n{_LD1},\n{cohort_sql(_kind)}\nSELECT subject_type, subject_id, member_id, case_id, person_id, CAST(index_at AS DATE) AS index_at, CAST(exposure_start AS DATE) AS exposure_start, CAST(deferral_days AS BIGINT) AS deferral_days FROM co")(_cohort)


@query("ou2_derived_outcomes", f"WITH {_ALL},\n{_EVENTS}\nSELECT person_id, event_type, CAST(event_at AS DATE) AS event_at, related_case_id FROM je")
def ou2(spark, sf_dir):
    """OU2, OU3, ST1, FN12."""
    return outcomes.all_justice_events(orders_frame(spark, sf_dir)).select("person_id", "event_type", F.to_date("event_at").alias("event_at"), "related_case_id").distinct()


@query("ou1_observability", "SELECT 'orders' AS source_id, * FROM (VALUES ('new_case', NULL, true), ('rearrest', NULL, true), ('technical_violation', NULL, false), ('revocation', 'release', true), ('revocation', 'parole', false)) t(outcome, scope, observable)")
def ou1(spark, sf_dir):
    """OU1."""
    return outcomes.observability(orders_frame(spark, sf_dir), [("new_case", None), ("rearrest", None), ("technical_violation", None), ("revocation", "release"), ("revocation", "parole")])


_M = BY_SLUG["new_case_rate"]
_OC = f"WITH RECURSIVE {_ALL},\n{_LD1},\n{cohort_sql('release', ('court',))},\n{outcome_sql('new_case')}\n"
_FOL = f"{_us('exposure_start', _TO)} > CAST(window_days AS BIGINT) * {DAY_US}"
_HIT = f"coalesce({_us('exposure_start', 'first_outcome_at')} <= CAST(window_days AS BIGINT) * {DAY_US}, false)"


def _release_cohort(spark, sf_dir):
    f = orders_frame(spark, sf_dir)
    c = cohorts.cohort(f, "release", "deciding_judge", ("court",))
    return outcomes.with_coverage_end(f, outcomes.first_outcomes(outcomes.all_justice_events(f), c, "new_case"))


@query("ou4_first_outcomes", _OC + "SELECT member_id, CAST(first_outcome_at AS DATE) AS first_outcome_at FROM oc")
def ou4(spark, sf_dir):
    """OU4, JO2, JO5, WI9."""
    return _release_cohort(spark, sf_dir).select("member_id", F.to_date("first_outcome_at").alias("first_outcome_at"))


@query("ou7_member_windows", _OC + f"SELECT member_id, CAST(window_days AS INT) AS window_days, {_HIT} AS has_outcome, {_FOL} AS followed, {_HIT} AND {_FOL} AS counted FROM oc, UNNEST([{', '.join(map(str, WINDOWS))}]) AS w(window_days)")
def ou7(spark, sf_dir):
    """OU5, OU6, OU7."""
    return outcomes.member_windows(_release_cohort(spark, sf_dir)).select("member_id", "window_days", "has_outcome", "followed", "counted")


@query("ou11_durations", _OC + f"SELECT member_id, coalesce(first_outcome_at < {_TO}, false) AS event, CASE WHEN coalesce(first_outcome_at < {_TO}, false) THEN {_us('exposure_start', 'first_outcome_at')} ELSE {_us('exposure_start', _TO)} END AS duration_us FROM oc")
def ou11(spark, sf_dir):
    """OU11."""
    return outcomes.durations(_release_cohort(spark, sf_dir)).select("member_id", "event", "duration_us")


_DESCRIPTIVE = [m for m in METRICS if m.kind != "observed_expected"]
_PREFIX = {"count": "ag1", "share": "ag2", "windowed_rate": "ag3", "survival": "ag4", "distribution": "ag5", "median": "ag6"}


def observations_sql() -> str:
    """SQL: every descriptive metric's rows in the one shape of observations, by the metric's own SQL."""
    parts = []
    for m in _DESCRIPTIVE:
        own, end = [f"'{m.slug}' AS slug"], ", 9)" if m.kind == "survival" else ", 6)"
        for c, kind in list(metrics.OBSERVATION.items())[1:]:
            if c == "source_id":
                continue
            have = metrics.columns_of(m).get(c)
            value = have or ("false" if c == "suppressed" else "NULL")
            kind = {"string": "VARCHAR", "long": "BIGINT"}.get(kind, kind.upper())
            own.append(f"{'round(' if kind == 'DOUBLE' and have else ''}CAST({value} AS {kind}){end if kind == 'DOUBLE' and have else ''} AS {c}")
        parts.append(f"SELECT {', '.join(own)} FROM ({ORACLE_SQL[_PREFIX[m.kind] + '_' + m.slug]}) AS t")
    return " UNION ALL ".join(parts)


def _run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"
    return metrics.run_all(orders_frame(spark, sf_dir), _DESCRIPTIVE, path)


@query("ag11_observations", observations_sql())
def ag11(spark, sf_dir):
    """AG11, MS7, MS8: one run of all descriptive metrics, every subject, stored in one shape."""
    rows = _run_all(spark, sf_dir).drop("source_id")
    # As the metrics' own queries round: survival at nine places.
    tidy = lambda c: F.when(F.col("slug").endswith("_survival"), F.round(c, 9)).otherwise(F.round(c, 6))
    return rows.withColumns({c: tidy(c) for c in ("value", "low", "high")})


@query("ag12_draft_summary", f"SELECT slug, count(*) AS observations FROM ({observations_sql()}) AS o GROUP BY slug")
def ag12(spark, sf_dir):
    """AG12."""
    return metrics.draft_summary(_run_all(spark, sf_dir))


@query("ag16_round6", "SELECT l_orderkey, l_linenumber, round_even(l_discount * l_tax, 6) AS r FROM lineitem")
def ag16(spark, sf_dir):
    """AG16."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", round6(F.col("l_discount") * F.col("l_tax")).alias("r"))
