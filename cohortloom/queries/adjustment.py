"""Queries of risk adjustment and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjustment as ad
from ..operators import cohorts
from ..operators import validation as va
from ..operators.graph import cut_lineage
from ..sources.adapter import inputs, orders_frame
from ..sources.shared import shared_dir
from .cohort import _ALL, _LD1, covered

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


_SEV = "CASE severity " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(cohorts.SEVERITIES)) + " ELSE 99 END"
_BAND = lambda n, top: f"CASE WHEN {n} >= {top} THEN '{top}+' ELSE CAST({n} AS VARCHAR) END"
_EV = f"""WITH {_ALL},
{_LD1},
ev AS (SELECT d.id AS member_id, judge_id, case_id, person_id, decision_at, CAST(NOT detained_flag AS INT) AS outcome FROM decisions d
 WHERE decision_type = 'pretrial_release' AND actor_type = 'judge' AND discretion = 'discretionary' AND detained_flag IS NOT NULL AND judge_id IS NOT NULL AND {covered('decision_at')}),
ch AS (SELECT ev.member_id, c.id, c.severity, c.offense_category, c.source_row_id FROM ev JOIN charges c ON c.case_id = ev.case_id AND c.person_id = ev.person_id AND c.filed_at < ev.decision_at),
lead AS (SELECT member_id, severity AS lead_severity, offense_category AS lead_category FROM ch QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY {_SEV}, source_row_id NULLS LAST, id) = 1),
cnt AS (SELECT member_id, count(DISTINCT id) AS n FROM ch GROUP BY ALL),
oth AS (SELECT ev.member_id, c.case_id AS other, k.filed_at AS kf, c.filed_at, c.disposed_at, c.disposition FROM ev JOIN cases k ON k.id = ev.case_id JOIN charges c ON c.person_id = ev.person_id AND c.case_id <> ev.case_id JOIN cases o ON o.id = c.case_id AND o.filed_at < k.filed_at),
per AS (SELECT member_id, other, coalesce(bool_or(filed_at < kf AND disposed_at < kf AND disposition IN ('convicted_plea', 'convicted_verdict')), false) AS convicted,
 coalesce(bool_or(filed_at < kf AND disposition IN ('dismissed', 'acquitted', 'convicted_plea', 'convicted_verdict') AND disposed_at >= kf), false)
 OR NOT coalesce(bool_or(filed_at < kf AND disposed_at < kf AND disposition IN ('dismissed', 'acquitted', 'convicted_plea', 'convicted_verdict')), false) AS pending FROM oth GROUP BY ALL),
hist AS (SELECT member_id, count(*) AS cases, count(*) FILTER (convicted) AS convictions, bool_or(pending) AS pending FROM per GROUP BY ALL),
fta AS (SELECT ev.member_id, count(*) AS n FROM ev JOIN cases k ON k.id = ev.case_id JOIN justice_events j ON j.person_id = ev.person_id AND j.event_type = 'failure_to_appear' AND j.event_at < k.filed_at GROUP BY ALL),
lv AS (SELECT ev.member_id, ev.judge_id, ev.outcome, lead.lead_severity, lead.lead_category, {_BAND('cnt.n', 3)} AS charge_count, {_BAND('coalesce(hist.cases, 0)', 3)} AS prior_cases, {_BAND('coalesce(hist.convictions, 0)', 2)} AS prior_convictions,
 {_BAND('coalesce(fta.n, 0)', 1)} AS prior_failures_to_appear, CASE WHEN coalesce(hist.pending, false) THEN 'true' ELSE 'false' END AS pending_case,
 CASE WHEN k.filed_at < TIMESTAMP '1995-01-01' + INTERVAL 1095 DAY THEN 'true' ELSE 'false' END AS history_truncated, k.court_id AS court, co.jurisdiction_id AS jurisdiction, CAST(year(ev.decision_at) AS VARCHAR) AS calendar_year
 FROM ev JOIN lead USING (member_id) JOIN cnt USING (member_id) LEFT JOIN hist USING (member_id) LEFT JOIN fta USING (member_id) JOIN cases k ON k.id = ev.case_id LEFT JOIN courts co ON co.id = k.court_id)
"""


def _levels(spark, sf_dir):
    f = orders_frame(spark, sf_dir)
    return ad.feature_levels(f, ad.decision_events(f))


def _scores(spark, sf_dir):
    """A made-up prediction over line items, for measures that SQL can check."""
    li = inputs(spark, sf_dir, "lineitem")["lineitem"]
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("member_id"), F.col("l_suppkey").alias("judge_id"), F.col("l_partkey").alias("person_id"), (F.col("l_quantity") / 100).alias("predicted"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"), F.col("l_linestatus").alias("attribute"), F.col("l_shipdate").cast("timestamp").alias("index_at"))


_SC = "WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS member_id, l_suppkey AS judge_id, l_quantity / 100 AS predicted, CAST(l_returnflag = 'R' AS INT) AS outcome, l_linestatus AS attribute, l_shipdate AS index_at FROM lineitem)\n"


@query("ad1_availability", "SELECT 'orders' AS source_id, * FROM (VALUES ('pretrial_release', NULL), ('technical_violation', 'outcome'), ('x', 'judge_gate')) t(target, reason)")
def ad1(spark, sf_dir):
    """AD1, MS36."""
    return ad.availability(orders_frame(spark, sf_dir), [("pretrial_release", "deciding_judge", None), ("technical_violation", "deciding_judge", "technical_violation"), ("x", "none", None)])


@query("ad30_feature_levels", _EV + "SELECT * FROM lv")
def ad30(spark, sf_dir):
    """AD2, AD4-AD10, AD30, JO7, JO8, LD4."""
    return _levels(spark, sf_dir).select("member_id", "judge_id", "outcome", *[n for n, _, _ in ad.FEATURES])


@query("ad11_data_encoding", _EV + "SELECT court AS level, CAST(row_number() OVER (ORDER BY count(*) DESC, court) AS VARCHAR) AS label FROM lv GROUP BY court")
def ad11(spark, sf_dir):
    """AD11, LD6."""
    return ad.data_encoding(_levels(spark, sf_dir), "court")


@query("ad3_release_events")
def ad3(spark, sf_dir):
    """AD3: rows only; its parts have oracles of their own (ou7, ex4)."""
    return ad.release_events(orders_frame(spark, sf_dir), "new_case", 365)


def _fitted(spark, sf_dir):
    d = ad.design(cut_lineage(_levels(spark, sf_dir)))
    return d, ad.fit_logistic(cut_lineage(ad.patterns(d)), len(d.columns))


@query("ad14_logistic_fit")
def ad14(spark, sf_dir):
    """AD12-AD15, AD23: coefficients (compared in tests with a plain solver)."""
    d, fit = _fitted(spark, sf_dir)
    return spark.createDataFrame([(c, float(b), fit.iterations, fit.converged) for c, b in zip(d.columns, fit.coefficients)], "column string, coefficient double, iterations int, converged boolean")


@query("ad16_expectations")
def ad16(spark, sf_dir):
    """AD16."""
    d, fit = _fitted(spark, sf_dir)
    return ad.expectations(ad.scored(d, fit.coefficients))


@query("ag10_pretrial_release_observed_expected")
def ag10(spark, sf_dir):
    """AG10, AD17-AD22, MS17-MS19."""
    return ad.observed_expected(orders_frame(spark, sf_dir, stored=False), "pretrial_release")


@query("ag10_new_case_observed_expected")
def ag10b(spark, sf_dir):
    """AG10 for new cases within a year."""
    return ad.observed_expected(orders_frame(spark, sf_dir, stored=False), "new_case", 365)


@query("ag10_failure_to_appear_observed_expected")
def ag10c(spark, sf_dir):
    """AG10 for failures to appear within a year."""
    return ad.observed_expected(orders_frame(spark, sf_dir, stored=False), "failure_to_appear", 365)


@query("ad19_pooled_ratios", _SC + "SELECT judge_id, (20.0 + sum(outcome)) / (20.0 + round(sum(predicted), 2)) AS ratio FROM s GROUP BY ALL")
def ad19(spark, sf_dir):
    """AD19, with a given shape."""
    t = _scores(spark, sf_dir).groupBy("judge_id").agg(F.sum("outcome").alias("observed"), F.round(F.sum("predicted"), 2).alias("expected"))
    return ad.pooled(t, 20.0).select("judge_id", "ratio")


@query("ad20_replicate_weights")
def ad20(spark, sf_dir):
    """AD20: three replicates over suppliers."""
    names = [r.s_name for r in inputs(spark, sf_dir, "supplier")["supplier"].select("s_name").collect()]
    rows = [(r, k, n) for r, drawn in enumerate(ad.replicate_weights(names, 7, "bootstrap:pretrial_release:none", 3)) for k, n in drawn.items()]
    return spark.createDataFrame(rows, "replicate int, cluster string, draws int")


@query("ad24_split_cutoff", _SC + "SELECT epoch_us(quantile_disc(index_at, 0.75)) AS cutoff FROM s")
def ad24(spark, sf_dir):
    """AD24."""
    return va.split_cutoff(_scores(spark, sf_dir), "index_at")


@query("ad25_roc_auc", _SC + ", r AS (SELECT outcome, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS k FROM s), a AS (SELECT sum(outcome) AS p, count(*) AS n, sum(k) FILTER (outcome = 1) AS r FROM r) SELECT round((r - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)), 9) AS auc FROM a")
def ad25(spark, sf_dir):
    """AD25, WI7."""
    return va.roc_auc(_scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query("ad25_brier", _SC + "SELECT round(avg((predicted - outcome) ** 2), 9) AS brier, round(avg(outcome) - avg(predicted), 9) AS in_the_large, count(*) AS n FROM s")
def ad25b(spark, sf_dir):
    """AD25."""
    return va.brier(_scores(spark, sf_dir)).select(F.round("brier", 9).alias("brier"), F.round("in_the_large", 9).alias("in_the_large"), "n")


@query("wi8_calibration_bins", "WITH s AS (SELECT o_orderkey AS member_id, o_totalprice / 1e6 AS predicted, CAST(o_orderstatus = 'F' AS INT) AS outcome FROM orders), b AS (SELECT *, ntile(10) OVER (ORDER BY predicted, member_id) AS bin FROM s) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(predicted), 9) AS mean_predicted, round(avg(outcome), 9) AS observed_rate FROM b GROUP BY ALL")
def wi8(spark, sf_dir):
    """WI8, AD25."""
    o = inputs(spark, sf_dir, "orders")["orders"]
    s = o.select(F.col("o_orderkey").alias("member_id"), (F.col("o_totalprice") / F.lit(1e6)).alias("predicted"), (F.col("o_orderstatus") == "F").cast("int").alias("outcome"))
    return va.calibration_bins(s).select("bin", "n", F.round("mean_predicted", 9).alias("mean_predicted"), F.round("observed_rate", 9).alias("observed_rate"))


@query("wi7_average_ranks", _SC + "SELECT DISTINCT predicted AS value, CAST(rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS DOUBLE) AS average_rank FROM s")
def wi7(spark, sf_dir):
    """WI7."""
    return va.average_ranks(_scores(spark, sf_dir), "predicted").select("value", "average_rank")


@query("va1_subgroup_calibration", _SC + "SELECT attribute AS value, count(*) AS n, sum(outcome)::BIGINT AS observed, round(sum(predicted), 4) AS expected FROM s GROUP BY ALL")
def va1(spark, sf_dir):
    """VA1."""
    return va.subgroup_calibration(_scores(spark, sf_dir), "attribute").select("value", "n", "observed", F.round("expected", 4).alias("expected"))


@query("va2_single_valued", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) = 1")
def va2(spark, sf_dir):
    """VA2."""
    return va.single_valued(inputs(spark, sf_dir, "lineitem")["lineitem"], "l_orderkey", "l_returnflag")


@query("va3_correlations", "WITH r AS (SELECT p_size AS a, p_retailprice AS b, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rb FROM part) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r")
def va3(spark, sf_dir):
    """VA3."""
    return va.correlations(inputs(spark, sf_dir, "part")["part"].select("p_size", "p_retailprice"), "p_size", "p_retailprice").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("va3_quartiles")
def va3b(spark, sf_dir):
    """VA3, VA5."""
    q = va.quartiles(inputs(spark, sf_dir, "orders")["orders"], "o_totalprice")
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


ORACLE_SQL["va3_quartiles"] = "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75 FROM orders"


@query("va5_interval_stability")
def va5(spark, sf_dir):
    """VA4, VA5: intervals of twenty replicates over suppliers' made-up scores."""
    s = _scores(spark, sf_dir).withColumn("person_id", F.col("person_id").cast("string"))
    i = cut_lineage(ad.bootstrap_intervals(s, 7, "bootstrap:x:none", 20))
    return va.interval_stability(i)


@query("ad26_coefficient_stability", "SELECT p_brand AS \"column\", round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS deviation, 1.0 AS same_sign FROM part GROUP BY ALL")
def ad26(spark, sf_dir):
    """AD26, over prices as replicates."""
    p = inputs(spark, sf_dir, "part")["part"].select(F.col("p_brand").alias("column"), F.col("p_retailprice").alias("value"), F.lit(1.0).alias("estimate"))
    return va.coefficient_stability(p).select("column", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "same_sign")


@query("va6_by_year", _SC + ", c AS (SELECT quantile_disc(index_at, 0.75) AS cut FROM s) SELECT CAST(year(index_at) AS INT) AS \"year\", count(*) AS n, round(avg(outcome), 9) AS observed, round(avg(predicted), 9) AS predicted, CASE WHEN bool_and(index_at >= cut) THEN 'test' WHEN bool_or(index_at >= cut) THEN 'both' ELSE 'train' END AS part FROM s, c GROUP BY year(index_at)")
def va6(spark, sf_dir):
    """VA6."""
    s = _scores(spark, sf_dir)
    return va.by_year(s, va.split_cutoff(s, "index_at")).select("year", "n", F.round("observed", 9).alias("observed"), F.round("predicted", 9).alias("predicted"), "part")



@query("va7_recovery", "SELECT count(*) AS judges, avg(CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS sign_agreement FROM supplier")
def va7(spark, sf_dir):
    """VA7: planted effects that half of the intervals cover."""
    s = inputs(spark, sf_dir, "supplier")["supplier"].select(F.col("s_suppkey").alias("judge_id"))
    k = F.col("judge_id")
    est = s.select("judge_id", F.when(k % 3 == 0, 1.2).otherwise(0.9).alias("ratio"), F.lit(1.0).alias("low"), F.when(k % 2 == 0, 1.6).otherwise(1.1).alias("high"))
    return va.recovery(est, s.select("judge_id", F.lit(1.5).alias("effect")))


@query("va8_column_profile", "SELECT 'o_orderstatus' AS column_name, count(*) FILTER (o_orderstatus IS NULL) AS nulls, count(DISTINCT o_orderstatus) AS distinct_values, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders")
def va8(spark, sf_dir):
    """VA8."""
    return va.column_profile(inputs(spark, sf_dir, "orders")["orders"].select("o_orderstatus", "o_orderpriority"))


@query("va9_key_profile", "SELECT k, count(*) AS keys FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY ALL) GROUP BY ALL")
def va9(spark, sf_dir):
    """VA9."""
    return va.key_profile(inputs(spark, sf_dir, "lineitem")["lineitem"], "l_orderkey", "l_suppkey")


@query("va10_anomalies")
def va10(spark, sf_dir):
    """VA10, SC7: every tenth date is no date."""
    from ..functions.text import parse_instant

    o = inputs(spark, sf_dir, "orders")["orders"]
    t = o.select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"))
    return va.anomalies(t, "d", "1996-01-01", "2000-12-31", lambda c: F.to_date(parse_instant(c)))


ORACLE_SQL["va10_anomalies"] = "SELECT count(*) FILTER (o_orderdate < '1996-01-01' AND o_orderkey % 10 <> 0) AS early, count(*) FILTER (CAST(o_orderdate AS DATE) > '2000-12-31' AND o_orderkey % 10 <> 0) AS late, count(*) FILTER (o_orderkey % 10 = 0) AS unparseable FROM orders"


@query("va11_stratified_excerpt", "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def va11(spark, sf_dir):
    """VA11."""
    return va.stratified_excerpt(inputs(spark, sf_dir, "orders")["orders"], "o_orderpriority", "o_orderkey")


@query("ms22_findings", "SELECT event_type AS code, 'events' AS artifact, CAST(user_id % 3 AS VARCHAR) AS detail, count(*) AS n FROM events GROUP BY ALL")
def ms22(spark, sf_dir):
    """MS22."""
    e = inputs(spark, sf_dir, "events")["events"]
    return va.findings(e.select(F.col("event_type").alias("code"), F.lit("events").alias("artifact"), (F.col("user_id") % 3).cast("string").alias("detail")))


@query("ad21_refitted_bootstrap")
def ad21(spark, sf_dir):
    """AD20, AD21: the reference's replicates with the model fitted again."""
    d, fit = _fitted(spark, sf_dir)
    return ad.refitted_sums(d, fit, 7, "bootstrap:pretrial_release:none", ad.REPLICATES)


@query("ad28_model_catalogue")
def ad28(spark, sf_dir):
    """AD23, AD27, AD28: one target is known already, the other is fitted, stored and verified."""
    from ..sources import files

    known = spark.createDataFrame([("new_case", 365)], "target string, window_days int")
    rows = ad.fit_missing(orders_frame(spark, sf_dir), [("new_case", 365), ("pretrial_release", None)], known)
    root = shared_dir(spark)
    checked = [files.first_difference(r, files.read_artifact(spark, files.write_artifact(spark, f"{root}/models", r))) is None for r in rows]
    return spark.createDataFrame([(r["target"], r["window_days"], r["status"], r["rows"], r["events"], len(r["coefficients"]), ok) for r, ok in zip(rows, checked)], "target string, window_days int, status string, rows long, events long, coefficients int, verified boolean")


@query("va4_sensitivity", "SELECT round(corr(a, b), 6) AS pearson, 1.0 AS spearman, round(max(abs(a - b)), 6) AS largest_change, count(*) AS judges FROM (SELECT s_suppkey + 0.5 AS a, (s_suppkey + 0.5) * (s_suppkey + 0.5) AS b FROM supplier)")
def va4(spark, sf_dir):
    """VA4: ratios and their squares have the same order."""
    s = inputs(spark, sf_dir, "supplier")["supplier"].select(F.col("s_suppkey").alias("judge_id"), (F.col("s_suppkey") + F.lit(0.5)).alias("ratio"))
    out = va.sensitivity(s, s.withColumn("ratio", F.col("ratio") * F.col("ratio")))
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), F.round("largest_change", 6).alias("largest_change"), "judges")
