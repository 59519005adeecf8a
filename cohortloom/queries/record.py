"""Queries of quality checks, coverage, members, publishing and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import WINDOWS
from ..operators import coverage, gates, members, outcomes, quality
from ..operators import cohorts as co
from ..sources.adapter import inputs, oracle_tables, orders_frame
from ..sources.shared import shared_dir
from .cohort import _ALL, _FOL, _HIT, _LD1, _OC, _SUBJECTS, _release_cohort, covered

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_T = f"WITH RECURSIVE {_ALL},\n{_LD1}\n"
SERVICES = """SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey % 20 AS BIGINT) AS judge_id, CAST(s_nationkey % 3 AS BIGINT) AS court_id,
 CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE DATE '1990-01-01' + CAST(s_suppkey % 400 AS INT) END AS start_date,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 17 = 3 THEN DATE '1989-12-01' ELSE DATE '1990-06-01' + CAST((s_suppkey * 7) % 500 AS INT) END AS end_date,
 concat('p', CAST(s_suppkey % 3 AS STRING)) AS position FROM {supplier}"""
_SV = f"WITH services AS ({SERVICES.format(supplier='supplier')})\n"


def services(spark, sf_dir):
    """Service records derived from suppliers."""
    return spark.sql(SERVICES, **inputs(spark, sf_dir, "supplier"))


def _issue_sql(entity, code, severity, detail, entity_id="id"):
    return f"SELECT '{entity}' AS entity_type, CAST({entity_id} AS VARCHAR) AS entity_id, '{severity}' AS severity, '{code}' AS issue_code, {detail} AS detail"


@query("dq1_service_dates_invalid", _SV + _issue_sql("judge_service", "service_dates_invalid", "error", "'ends before it starts'") + " FROM services WHERE end_date < start_date")
def dq1(spark, sf_dir):
    """DQ1."""
    return quality.service_dates_invalid(services(spark, sf_dir))


@query("dq2_service_overlap", _SV + _issue_sql("judge_service", "service_overlap", "warning", "'overlaps service ' || a.id", "b.id") + " FROM services a JOIN services b ON a.judge_id = b.judge_id AND a.court_id = b.court_id AND (a.start_date, a.position, a.id) < (b.start_date, b.position, b.id) WHERE a.start_date < coalesce(b.end_date, DATE '9999-12-31') AND b.start_date < coalesce(a.end_date, DATE '9999-12-31')")
def dq2(spark, sf_dir):
    """DQ2."""
    return quality.service_overlap(services(spark, sf_dir))


@query("dq3_missing_start_date", _SV + _issue_sql("judge_service", "missing_start_date", "info", "'no start date'") + " FROM services WHERE start_date IS NULL")
def dq3(spark, sf_dir):
    """DQ3."""
    return quality.missing_start_date(services(spark, sf_dir))


@query("dq4_provenance_incomplete", _issue_sql("record", "provenance_incomplete", "error", "CASE WHEN page_id % 7 = 0 THEN 'no source record' ELSE 'source record without a sha256' END", "page_id") + " FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0")
def dq4(spark, sf_dir):
    """DQ4: every seventh page has no record, every fifth a short digest."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sha = F.when(F.col("page_id") % 7 != 0, F.when(F.col("page_id") % 5 == 0, F.lit("abc")).otherwise(F.sha2("html", 256)))
    return quality.provenance_incomplete(p.select(F.col("page_id").alias("id"), sha.alias("raw_sha256")))


@query("dq5_case_number_duplicate", _issue_sql("case", "case_number_duplicate", "info", "n || ' source rows'", "k") + " FROM (SELECT l_orderkey || '|' || l_linenumber AS k, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS kinds FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1 AND kinds > 1")
def dq5(spark, sf_dir):
    """DQ5."""
    return quality.case_number_duplicate(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("dq6_disposition_before_filing", _T + "SELECT * FROM (" + _issue_sql("charge", "disposition_before_filing", "error", "CASE WHEN c.disposed_at < c.filed_at + INTERVAL 1 DAY THEN 'before the charge was filed' END", "c.id") + " FROM charges c JOIN cases k ON k.id = c.case_id) WHERE detail IS NOT NULL")
def dq6(spark, sf_dir):
    """DQ6, over charges whose filing is moved on by a day so that some fail."""
    f = orders_frame(spark, sf_dir)
    return quality.disposition_before_filing(f.with_tables(charges=f.charges.withColumn("filed_at", F.col("filed_at") + F.expr("INTERVAL 1 DAY"))))


_LATE = "CASE WHEN CAST({at} AS DATE) < CAST(k.filed_at AS DATE) + 7 THEN 'before the case was filed' END"


@query(
    "dq7_event_order_impossible",
    _T + ", k AS (SELECT id, filed_at, closed_at FROM cases), fc AS (SELECT case_id, person_id, min(disposed_at) AS at FROM charges WHERE disposition IN ('convicted_plea', 'convicted_verdict') GROUP BY ALL)\nSELECT * FROM ("
    + _issue_sql("case", "event_order_impossible", "error", "CASE WHEN closed_at < filed_at + INTERVAL 7 DAY THEN 'closed before it was filed' END") + " FROM k UNION ALL "
    + _issue_sql("assignment", "event_order_impossible", "error", "CASE WHEN end_at < start_at THEN 'ends before it starts' WHEN CAST(start_at AS DATE) < CAST(k.filed_at AS DATE) + 7 THEN 'before the case was filed' END", "case_id || ':' || judge_id") + " FROM assignments a JOIN k ON k.id = a.case_id UNION ALL "
    + _issue_sql("event", "event_order_impossible", "error", _LATE.format(at="event_at"), "e.id") + " FROM case_events e JOIN k ON k.id = e.case_id UNION ALL "
    + _issue_sql("decision", "event_order_impossible", "error", "CASE WHEN release_at < decision_at THEN 'released before the decision' WHEN decision_type <> 'pretrial_release' AND CAST(decision_at AS DATE) < CAST(k.filed_at AS DATE) + 7 THEN 'before the case was filed' END", "d.id") + " FROM decisions d JOIN k ON k.id = d.case_id UNION ALL "
    + _issue_sql("sentence", "event_order_impossible", "error", "CASE WHEN sentence_at < fc.at THEN 'sentenced before the conviction' WHEN CAST(sentence_at AS DATE) < CAST(k.filed_at AS DATE) + 7 THEN 'before the case was filed' END", "s.id") + " FROM sentences s LEFT JOIN fc ON fc.case_id = s.case_id AND fc.person_id = s.person_id JOIN k ON k.id = s.case_id) WHERE detail IS NOT NULL",
)
def dq7(spark, sf_dir):
    """DQ7, over cases whose filing is moved on by a week so that some fail."""
    f = orders_frame(spark, sf_dir)
    return quality.event_order_impossible(f.with_tables(cases=f.cases.withColumn("filed_at", F.col("filed_at") + F.expr("INTERVAL 7 DAYS"))))


@query("dq8_subsequent_before_index", _T + ", k AS (SELECT id, CAST(filed_at AS DATE) + 15 AS filed FROM cases), pf AS (SELECT c.person_id, min(k.filed) AS first_filed FROM (SELECT DISTINCT case_id, person_id FROM charges) c JOIN k ON k.id = c.case_id GROUP BY ALL)\nSELECT * FROM (" + _issue_sql("justice_event", "subsequent_before_index", "error", "CASE WHEN CAST(event_at AS DATE) < k.filed THEN 'before its case was filed' WHEN CAST(event_at AS DATE) < pf.first_filed THEN 'before the person''s first case was filed' END", "j.id") + " FROM justice_events j LEFT JOIN k ON k.id = j.related_case_id LEFT JOIN pf ON pf.person_id = j.person_id) WHERE detail IS NOT NULL")
def dq8(spark, sf_dir):
    """DQ8, over cases whose filing is moved on by fifteen days."""
    f = orders_frame(spark, sf_dir)
    return quality.subsequent_before_index(f.with_tables(cases=f.cases.withColumn("filed_at", F.col("filed_at") + F.expr("INTERVAL 15 DAYS"))))


@query("dq9_missing_judge")
def dq9(spark, sf_dir):
    """DQ9: every fifth judge is taken from the decisions; dispositions never record one."""
    f = orders_frame(spark, sf_dir)
    hidden = F.when(F.col("judge_id").cast("long") % 5 != 0, F.col("judge_id"))
    return quality.missing_judge_on_decision(f.with_tables(decisions=f.decisions.withColumn("judge_id", hidden)), ("disposition",))


ORACLE_SQL["dq9_missing_judge"] = (
    _T + ", m AS (SELECT * FROM decisions WHERE CAST(judge_id AS BIGINT) % 5 = 0 AND actor_type IN ('judge', 'unknown'))\n"
    + _issue_sql("decision", "missing_judge_on_decision", "warning", "decision_type || ' names no judge'") + " FROM m WHERE decision_type <> 'disposition' UNION ALL "
    + _issue_sql("decision", "missing_judge_on_decision", "info", "count(*) || ' disposition decisions name no judge'", "NULL") + " FROM m WHERE decision_type = 'disposition' HAVING count(*) > 0"
)


@query("dq10_missing_disposition", _T + _issue_sql("charge", "missing_disposition", "info", "'no disposition although the case is closed'", "c.id") + " FROM charges c JOIN cases k ON k.id = c.case_id WHERE k.status = 'closed' AND c.disposition = 'pending'")
def dq10(spark, sf_dir):
    """DQ10: pending charges have no disposition."""
    f = orders_frame(spark, sf_dir)
    return quality.missing_disposition(f.with_tables(charges=f.charges.withColumn("disposition", F.expr("nullif(disposition, 'pending')"))))


@query("dq11_unknown_category", _T + "SELECT 'decision' AS entity_type, NULL::VARCHAR AS entity_id, 'info' AS severity, 'unknown_category_measured' AS issue_code, 'decision.' || f || ': ' || u || ' of ' || n AS detail FROM (SELECT 'actor_type' AS f, count(*) FILTER (actor_type = 'unknown') AS u, count(actor_type) AS n FROM decisions UNION ALL SELECT 'discretion', count(*) FILTER (discretion = 'unknown'), count(discretion) FROM decisions) WHERE u > 0")
def dq11(spark, sf_dir):
    """DQ11."""
    return quality.unknown_category_measured(orders_frame(spark, sf_dir))


@query("dq12_resolution_missing", _issue_sql("case_party", "person_resolution_confidence_missing", "warning", "'resolved to no person'", "o_orderkey") + " FROM orders WHERE o_custkey % 50 = 0")
def dq12(spark, sf_dir):
    """DQ12: customers divisible by 50 resolved to nobody."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return quality.resolution_confidence_missing(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("person_id")))


# Coverage.
_FLAGS = """, fl AS (SELECT k.id, k.court_id, c.jurisdiction_id, k.status = 'closed' AS closed,
 k.id IN (SELECT id FROM case_disp) AS has_disposition, k.id IN (SELECT case_id FROM assignments) AS has_assignment,
 coalesce(d.n > 0, false) AS has_decision, coalesce(d.named, false) AS named, coalesce(v.c, false) AS has_conviction,
 k.id IN (SELECT case_id FROM sentences) AS has_sentence, k.id IN (SELECT case_id FROM charges WHERE person_id IS NOT NULL) AS has_person, k.id IN (SELECT case_id FROM case_events) AS has_event
 FROM cases k LEFT JOIN courts c ON c.id = k.court_id LEFT JOIN (SELECT case_id, count(*) AS n, bool_and(judge_id IS NOT NULL) AS named FROM decisions GROUP BY ALL) d ON d.case_id = k.id
 LEFT JOIN (SELECT case_id, bool_or(disposition LIKE 'convicted%') AS c FROM charges WHERE disposition IN ('dismissed', 'acquitted', 'convicted_plea', 'convicted_verdict') AND disposed_at IS NOT NULL GROUP BY ALL) v ON v.case_id = k.id),
sc AS (SELECT 'source' AS scope_type, 'orders' AS scope_id, fl.* FROM fl UNION ALL SELECT 'jurisdiction', jurisdiction_id, fl.* FROM fl UNION ALL SELECT 'court', court_id, fl.* FROM fl)
"""
_STATS = {
    "cases_with_disposition": ("has_disposition", "true"), "closed_cases_with_disposition": ("closed AND has_disposition", "closed"), "cases_with_assignment": ("has_assignment", "true"),
    "decisions_with_judge": ("named", "has_decision"), "convicted_cases_with_sentence": ("has_conviction AND has_sentence", "has_conviction"), "cases_with_person": ("has_person", "true"), "cases_with_event": ("has_event", "true"),
}


@query("ag17_coverage_statistics", _T + _FLAGS + " UNION ALL ".join(f"SELECT scope_type, scope_id, '{n}' AS statistic, count(*) FILTER ({b} AND ({k})) AS numerator, count(*) FILTER ({b}) AS denominator FROM sc GROUP BY ALL" for n, (k, b) in _STATS.items()))
def ag17(spark, sf_dir):
    """AG17, JO16, ST1."""
    return coverage.frame_statistics(orders_frame(spark, sf_dir)).drop("source_id", "share")


@query("ag18_decimal_share")
def ag18(spark, sf_dir):
    """AG18: exact shares of the statistics (rows only: decimals of other engines round otherwise)."""
    return coverage.frame_statistics(orders_frame(spark, sf_dir)).select("scope_type", "scope_id", "statistic", "share")


@query("ag19_compare_statistics", _T + _FLAGS + "SELECT 'court' AS scope_type, court_id AS scope_id, 'cases_with_event' AS statistic, 'denominator' AS \"column\", CAST(count(*) AS VARCHAR) AS old_value, CAST(count(*) + 1 AS VARCHAR) AS new_value FROM fl GROUP BY court_id")
def ag19(spark, sf_dir):
    """AG19, MS10: stored statistics against ones in which every court has a case more."""
    own = coverage.frame_statistics(orders_frame(spark, sf_dir)).where("statistic = 'cases_with_event' AND scope_type = 'court'")
    return members.mismatches(own, own.withColumn("denominator", F.col("denominator") + 1), ["scope_type", "scope_id", "statistic"], ["numerator", "denominator"])


@query("ag20_source_counts", _T + "SELECT 'orders' AS source_id, count(*) AS cases, CAST(min(filed_at) AS DATE) AS first_filed, CAST(max(filed_at) AS DATE) AS last_filed, (SELECT count(*) FROM charges) AS charges, (SELECT count(*) FROM decisions) AS decisions, (SELECT count(*) FROM sentences) AS sentences, (SELECT count(*) FROM assignments) AS assignments, (SELECT count(*) FROM case_events) AS events, (SELECT count(*) FROM justice_events) AS justice_events FROM cases")
def ag20(spark, sf_dir):
    """AG20."""
    return coverage.source_counts(orders_frame(spark, sf_dir))


@query("ag21_case_window", _T + "SELECT judge_id, count(DISTINCT case_id) AS cases, CAST(min(filed_at) AS DATE) AS first_filed, CAST(max(filed_at) AS DATE) AS last_filed FROM assignments a JOIN cases k ON k.id = a.case_id GROUP BY ALL")
def ag21(spark, sf_dir):
    """AG21."""
    return coverage.case_window(orders_frame(spark, sf_dir))


@query("ag22_filtered_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS fitted, count(*) FILTER (o_orderstatus = 'P') AS unavailable FROM orders GROUP BY ALL")
def ag22(spark, sf_dir):
    """AG22."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("fitted"), F.count_if(F.col("o_orderstatus") == "P").alias("unavailable"))


# Members of the court cohort of new cases after release.
_MASK = lambda e: " + ".join(f"CASE WHEN {e.replace('window_days', str(w))} THEN {1 << i} ELSE 0 END" for i, w in enumerate(WINDOWS))
_MB = _OC + f", mb AS (SELECT subject_type, subject_id, member_id, CAST(year(index_at) AS INT) AS anchor_year, CAST({_MASK(f'({_HIT} AND {_FOL})')} AS INT) AS counted_mask, CAST({_MASK(_FOL)} AS INT) AS followed_mask FROM oc)\n"


def _members(spark, sf_dir):
    return members.cohort_members(_release_cohort(spark, sf_dir), "new_case_rate")


@query("me2_member_masks", _MB + "SELECT subject_id, member_id, anchor_year, counted_mask, followed_mask, count(*) AS multiplicity FROM mb GROUP BY ALL")
def me2(spark, sf_dir):
    """ME1, ME2, ME3, OU12, WI5."""
    return _members(spark, sf_dir).select("subject_id", "member_id", "anchor_year", "counted_mask", "followed_mask", "multiplicity")


@query("me4_family_digest", _MB + "SELECT subject_type, subject_id, sha256('decision' || chr(10) || string_agg(row, chr(10) ORDER BY row)) AS digest, count(*) AS members FROM (SELECT subject_type, subject_id, member_id || '|' || anchor_year || '||' || counted_mask || '|' || followed_mask || '|1' AS row FROM mb) GROUP BY ALL")
def me4(spark, sf_dir):
    """ME4."""
    return members.family_digest(_members(spark, sf_dir), "decision").select("subject_type", "subject_id", "digest", "members")


@query("me5_projection", _MB + "SELECT subject_id, member_id, counted_mask & 8 <> 0 AS counted, followed_mask & 8 <> 0 AS followed, 1::BIGINT AS multiplicity FROM mb WHERE anchor_year = 1997")
def me5(spark, sf_dir):
    """ME5, MS12: the year 1997 and the window of 365 days."""
    return members.project(_members(spark, sf_dir), year=1997, slot=3).select("subject_id", "member_id", "counted", "followed", "multiplicity")


@query("me6_missing_members", _MB + "SELECT DISTINCT member_id FROM mb WHERE member_id NOT IN (SELECT id FROM decisions WHERE CAST(case_id AS BIGINT) % 7 <> 0)")
def me6(spark, sf_dir):
    """ME6, JO9: against decisions of which some are gone."""
    return members.missing_members(_members(spark, sf_dir), orders_frame(spark, sf_dir).decisions.where("CAST(case_id AS BIGINT) % 7 <> 0"))


@query("me7_publish_plan", "SELECT 'court' AS subject_type, CAST(c_nationkey AS VARCHAR) AS subject_id, CASE WHEN c_nationkey % 4 = 0 THEN 'extra' WHEN c_nationkey % 4 = 1 THEN 'missing' WHEN c_nationkey % 4 = 2 THEN 'mismatch' ELSE 'equal' END AS status, CASE WHEN c_nationkey % 4 = 0 THEN 'supersede' WHEN c_nationkey % 4 = 1 THEN 'insert' WHEN c_nationkey % 4 = 2 THEN 'replace' ELSE 'keep' END AS action FROM (SELECT DISTINCT c_nationkey FROM customer)")
def me7(spark, sf_dir):
    """ME7, MS13: courts whose stored and fresh counts differ in four ways."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    c = c.select(F.lit("court").alias("subject_type"), F.col("c_nationkey").cast("string").alias("subject_id"), F.col("c_nationkey").alias("k"), "n")
    return members.publish_plan(c.where("k % 4 <> 1"), c.where("k % 4 <> 0").withColumn("n", F.when(F.col("k") % 4 == 2, F.col("n") + 1).otherwise(F.col("n"))), ["subject_type", "subject_id"], ["n"])


@query("me9_verify", "SELECT CAST(c_nationkey AS VARCHAR) AS subject_id, 'n' AS \"column\", CAST(count(*) AS VARCHAR) AS old_value, CAST(count(*) + 1 AS VARCHAR) AS new_value FROM customer WHERE c_nationkey % 3 = 0 GROUP BY c_nationkey")
def me9(spark, sf_dir):
    """ME9, MS14: a tampered count is reported with its key and column."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("string").alias("subject_id")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"))
    fresh = c.withColumn("n", F.when(F.col("subject_id").cast("int") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return members.mismatches(c, fresh, ["subject_id"], ["n", "low"])


@query("me10_member_multisets", _MB + "SELECT member_id, counted_mask, followed_mask, 1::BIGINT AS stored, 0::BIGINT AS fresh FROM mb WHERE anchor_year = 1996")
def me10(spark, sf_dir):
    """ME10: a fresh family without the members of 1996."""
    m = _members(spark, sf_dir)
    return members.compare_members(m, m.where("anchor_year <> 1996"))


@query("me11_trace", _MB + ", p AS (SELECT subject_id, member_id, counted_mask & 1 <> 0 AS counted, followed_mask & 1 <> 0 AS followed FROM mb)\nSELECT subject_id, member_id, counted, followed, 1::BIGINT AS multiplicity, true AS resolved, (SELECT count(*) FROM p) AS total, (SELECT count(*) FILTER (counted) FROM p) AS total_counted, 0::BIGINT AS unresolved, true AS complete FROM p ORDER BY member_id LIMIT 20 OFFSET 5")
def me11(spark, sf_dir):
    """ME11, MS15, JO13, WI4, SO3: a page of members (the limit is the page)."""
    p = members.project(_members(spark, sf_dir), slot=0).drop("subject_type", "source_id", "slug")
    return members.trace(p, orders_frame(spark, sf_dir).decisions, 20, 5)


@query("me12_impacted_subjects", _T + """, pe AS (SELECT case_id, person_id FROM charges UNION SELECT case_id, person_id FROM decisions),
tp AS (SELECT DISTINCT person_id FROM pe WHERE CAST(case_id AS BIGINT) % 500 = 0), tc AS (SELECT case_id FROM pe WHERE person_id IN (SELECT person_id FROM tp) UNION SELECT id FROM cases WHERE CAST(id AS BIGINT) % 500 = 0)
SELECT DISTINCT subject_type, subject_id FROM (SELECT 'court' AS subject_type, court_id AS subject_id, id AS case_id FROM cases UNION ALL SELECT 'judge', judge_id, case_id FROM assignments UNION ALL SELECT 'judge', judge_id, case_id FROM charges UNION ALL SELECT 'judge', judge_id, case_id FROM decisions UNION ALL SELECT 'judge', judge_id, case_id FROM sentences)
SEMI JOIN tc USING (case_id) WHERE subject_id IS NOT NULL""")
def me12(spark, sf_dir):
    """ME12, ME13."""
    f = orders_frame(spark, sf_dir)
    touched = f.cases.where("CAST(id AS BIGINT) % 500 = 0").select(F.col("id").alias("case_id"))
    return members.impacted_subjects(f, touched)



@query("sc17_upsert")
def sc17(spark, sf_dir):
    """SC17, SC18, MS2, MS25, MS30: changed-only upsert."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    old = c.where("c_custkey % 5 <> 0")
    both = members.upsert(old, new, ["c_custkey"], ["c_acctbal"])
    return both.withColumn("c_custkey", F.col("c_custkey").cast("long"))


ORACLE_SQL["sc17_upsert"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 7 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'insert' WHEN c_custkey % 7 = 0 THEN 'retained' WHEN c_custkey % 3 = 1 THEN 'update' ELSE 'unchanged' END AS action FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 7 = 0)"


@query("ms23_run_statistics", "SELECT 'customers' AS \"table\", count(*) FILTER (c_custkey % 2 = 0) AS seen, count(*) FILTER (c_custkey % 6 = 0) AS created, 0::BIGINT AS updated, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS unchanged FROM customer")
def ms23(spark, sf_dir):
    """MS23: even customers arrive, those divisible by three are new."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return members.run_statistics(members.upsert(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0"), ["c_custkey"], ["c_acctbal"]), "customers")


@query("ld8_keep_first_draft", "SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey, count(*) - 1 AS dropped, count(*) FILTER (l_partkey <> f) AS conflicting FROM (SELECT *, first_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS f FROM lineitem) GROUP BY l_orderkey, l_linenumber")
def ld8(spark, sf_dir):
    """LD8, LD9."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ord", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return members.keep_first(rows, ["l_orderkey", "l_linenumber"], "ord", ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "dropped", "conflicting")


@query("me8_stored_precision", "SELECT o_orderkey, CAST(round_even(CAST(o_totalprice / 7 AS DECIMAL(30, 12)), 4) AS DECIMAL(14, 4)) AS v FROM orders")
def me8(spark, sf_dir):
    """ME8, MS13."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 7).cast("decimal(30,12)").alias("v"))
    return members.stored_precision(o, values=("v",))


@query("me14_retire", "SELECT c_custkey AS id FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def me14(spark, sf_dir):
    """ME14: customers of odd nations retire unless an order of another source names them."""
    g = inputs(spark, sf_dir, "customer", "orders")
    c = g["customer"].select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source_id"))
    refs = g["orders"].select(F.col("o_custkey").alias("ref"), F.when(F.col("o_orderstatus") == "P", F.lit("a")).otherwise(F.lit("b")).alias("source_id"))
    return members.retire(c, "b", [refs]).select("id")


@query("sc19_member_store", _MB + "SELECT subject_id, count(*) AS n FROM mb GROUP BY ALL")
def sc19(spark, sf_dir):
    """SC19, MS11: members written by subject, read again and expanded."""
    import uuid

    from ..sources.files import write_members

    path = f"{shared_dir(spark)}/members-{uuid.uuid4().hex}"
    write_members(_members(spark, sf_dir), path)
    return members.expand(spark.read.parquet(path)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
