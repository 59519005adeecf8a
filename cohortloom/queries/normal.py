"""Queries of normalisation, scalar functions and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import normalize as no
from ..sources.adapter import inputs

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


def _t(spark, sf_dir, name):
    return inputs(spark, sf_dir, name)[name]


@query("no1_rule_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'prosecutor' WHEN l_returnflag = 'A' THEN 'judge' WHEN l_returnflag = 'N' THEN 'jury' ELSE 'unknown' END AS rule FROM lineitem")
def no1(spark, sf_dir):
    """NO1."""
    rules = spark.createDataFrame([("A", "F", "prosecutor"), ("A", "*", "judge"), ("N", "*", "jury")], "value string, reason string, rule string")
    return no.rule_lookup(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), rules, "l_returnflag", "l_linestatus", "unknown").select("l_orderkey", "l_linenumber", "rule")


@query("no2_total_match", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_orderpriority = '1-URGENT' THEN 'approved' ELSE 'continued' END AS rule FROM orders")
def no2(spark, sf_dir):
    """NO2."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("v"))
    return no.total_match(o, spark.createDataFrame([("1-URGENT", "approved")], "value string, rule string"), "v", "continued", "none").select("o_orderkey", "rule")


@query("no3_pretrial_rule", "SELECT o_orderkey, CASE WHEN o_orderdate >= '1998-01-01' THEN 'fairness_act' ELSE 'monetary_bail' END AS regime, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' AND o_orderdate < '1998-01-01' THEN 'bond' END AS bond_rule, CASE WHEN o_orderstatus = 'P' THEN 'no_bond_type' WHEN NOT (o_orderstatus = 'F' AND o_orderdate < '1998-01-01') THEN 'unlisted_bond_type' END AS reason FROM orders")
def no3(spark, sf_dir):
    """NO3."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("bond_type"), F.to_date("o_orderdate").alias("bond_date"))
    return no.pretrial_rule(o, spark.createDataFrame([("F", "monetary_bail", "bond")], "bond_type string, regime string, rule string"), "1998-01-01").select("o_orderkey", "regime", "bond_rule", "reason")


@query("no4_term_days", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN NULL WHEN floor(p_size * (CASE p_partkey % 3 WHEN 0 THEN 365.25 WHEN 1 THEN 30.4375 ELSE 1 END) + 0.5) > 10000 THEN NULL ELSE CAST(floor(p_size * (CASE p_partkey % 3 WHEN 0 THEN 365.25 WHEN 1 THEN 30.4375 ELSE 1 END) + 0.5) AS BIGINT) END AS days, CASE WHEN p_partkey % 11 = 0 THEN 'missing_term' WHEN p_partkey % 5 = 0 THEN 'life' WHEN p_partkey % 13 = 0 THEN 'unparseable_term' WHEN floor(p_size * (CASE p_partkey % 3 WHEN 0 THEN 365.25 WHEN 1 THEN 30.4375 ELSE 1 END) + 0.5) > 10000 THEN 'implausible_term' END AS flag FROM part")
def no4(spark, sf_dir):
    """NO4."""
    k = F.col("p_partkey")
    unit = F.when(k % 11 == 0, F.lit("")).when(k % 5 == 0, F.lit("Natural Life")).when(k % 3 == 0, F.lit("Year(s)")).when(k % 3 == 1, F.lit("Months")).otherwise(F.lit("Days"))
    term = F.when(k % 13 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string"))
    days, flag = no.term_days(term, unit, {"Year(s)": 365.25, "Months": 30.4375, "Days": 1, "Natural Life": None}, {"Natural Life": "life"}, 10_000)
    return _t(spark, sf_dir, "part").select("p_partkey", days.alias("days"), flag.alias("flag"))


@query("no5_sentence_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'original' END AS phase, CASE o_orderpriority WHEN '1-URGENT' THEN 'incarceration,fine' WHEN '2-HIGH' THEN 'probation' ELSE '' END AS components FROM orders")
def no5(spark, sf_dir):
    """NO5."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sentence_phase"), F.col("o_orderpriority").alias("sentence_type"))
    phases = spark.createDataFrame([("F", "original")], "value string, rule string")
    comps = spark.createDataFrame([("1-URGENT", "incarceration", "fine"), ("2-HIGH", "probation", "probation")], "value string, component string, extra string")
    return no.sentence_row(o, phases, comps).select("o_orderkey", "phase", F.array_join("components", ",").alias("components"))


@query("no6_court_of_case", "SELECT l_orderkey AS case_id, CASE WHEN count(DISTINCT l_suppkey % 3) = 1 THEN CAST(max(l_suppkey % 3) AS VARCHAR) ELSE 'parent' END AS court FROM lineitem GROUP BY ALL")
def no6(spark, sf_dir):
    """NO6."""
    return no.court_of_case(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).cast("string").alias("court")), "parent")


@query("no7_restricted_category", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'unknown' END AS category FROM customer")
def no7(spark, sf_dir):
    """NO7."""
    return _t(spark, sf_dir, "customer").select("c_custkey", no.restricted_category(F.concat(F.lit(" "), "c_mktsegment"), ("automobile", "machinery")).alias("category"))


@query("no8_case_assembly", "SELECT l_orderkey AS case_id, CAST(min(l_shipdate) AS DATE) AS filed_date, count(DISTINCT l_suppkey) AS participants, CASE WHEN bool_and(l_linestatus = 'F') THEN 'closed' ELSE 'open' END AS status, CASE WHEN bool_and(l_linestatus = 'F') THEN CAST(max(l_shipdate) AS DATE) END AS closed_date FROM lineitem GROUP BY ALL")
def no8(spark, sf_dir):
    """NO8."""
    li = _t(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return no.assemble_cases(li.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("participant_id"), day.alias("received"), F.when(F.col("l_linestatus") == "F", day).alias("ended")))


@query("no9_charge_versions", "SELECT l_orderkey AS participant_id, l_linenumber AS charge_id, CASE l_returnflag WHEN 'A' THEN 'disposition' WHEN 'R' THEN 'sentencing' ELSE 'initiation' END AS export, l_partkey AS version FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_partkey DESC) = 1")
def no9(spark, sf_dir):
    """NO9."""
    export = F.when(F.col("l_returnflag") == "A", "disposition").when(F.col("l_returnflag") == "R", "sentencing").otherwise("initiation")
    return no.charge_versions(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("participant_id"), F.col("l_linenumber").alias("charge_id"), export.alias("export"), F.col("l_partkey").alias("version")))


@query("no10_disposition_events", "SELECT l_orderkey AS case_id, l_linenumber AS participant_id, l_returnflag AS disposition, CAST(l_shipdate AS DATE) AS disposed_on, min(l_suppkey) AS judge FROM lineitem GROUP BY ALL")
def no10(spark, sf_dir):
    """NO10."""
    li = _t(spark, sf_dir, "lineitem")
    return no.disposition_events(li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("participant_id"), F.col("l_returnflag").alias("disposition"), F.to_date("l_shipdate").alias("disposed_on"), F.col("l_suppkey").alias("judge")))


@query("no11_first_facts", "SELECT o_custkey AS participant_id, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY ALL")
def no11(spark, sf_dir):
    """NO11."""
    return no.first_facts(_t(spark, sf_dir, "orders").withColumn("participant_id", F.col("o_custkey")), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(
    "no12_sentence_groups",
    """WITH r AS (SELECT o_custkey AS participant_id, CAST(o_orderdate AS DATE) AS sentence_date, o_orderstatus AS phase, o_orderkey % 7 AS judge, o_orderkey % 100 AS days, 'c' || o_orderkey % 4 AS component FROM orders),
j AS (SELECT participant_id, sentence_date, phase, judge, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT participant_id, sentence_date, phase, arg_min(judge, (-n, judge)) AS judge FROM j GROUP BY ALL),
g AS (SELECT participant_id, sentence_date, phase, max(days) AS days, list_sort(list(DISTINCT component)) AS cs FROM r GROUP BY ALL)
SELECT g.participant_id, g.sentence_date, g.phase, g.days, array_to_string(g.cs, ',') AS components, b.judge, EXISTS (SELECT 1 FROM g h WHERE h.participant_id = g.participant_id AND h.sentence_date > g.sentence_date AND list_has_any(h.cs, g.cs)) AS replaced
FROM g JOIN b ON b.participant_id = g.participant_id AND b.sentence_date = g.sentence_date AND b.phase = g.phase""",
)
def no12(spark, sf_dir):
    """NO12."""
    o = _t(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("participant_id"), F.to_date("o_orderdate").alias("sentence_date"), F.col("o_orderstatus").alias("phase"), (F.col("o_orderkey") % 7).alias("judge"), (F.col("o_orderkey") % 100).alias("days"), F.concat(F.lit("c"), (F.col("o_orderkey") % 4).cast("string")).alias("component"))
    return no.sentence_groups(r).withColumn("components", F.array_join("components", ","))


@query("no13_service_spans", "SELECT l_suppkey AS judge, l_partkey % 5 AS court, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date FROM lineitem GROUP BY ALL")
def no13(spark, sf_dir):
    """NO13."""
    return no.service_spans(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("judge"), (F.col("l_partkey") % 5).alias("court"), F.to_date("l_shipdate").alias("day")))


@query("no14_restricted_attributes", "SELECT o_custkey AS participant_id, 'race' AS attribute, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'P') AS value, count(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P') - 1 AS conflicts FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderstatus <> 'P') > 0")
def no14(spark, sf_dir):
    """NO14."""
    o = _t(spark, sf_dir, "orders")
    return no.restricted_attributes(o.select(F.col("o_custkey").alias("participant_id"), F.lit("race").alias("attribute"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"), F.col("o_orderkey").alias("export_rank")))


@query("no15_drafts", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(14,2)) AS amount FROM events WHERE event_id % 9 <> 0")
def no15(spark, sf_dir):
    """NO15, FN7: text columns parsed again; every ninth row has no date."""
    e = _t(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.lit("soon")).alias("day"), F.col("value").cast("decimal(14,2)").cast("string").alias("amount"))
    good, _ = no.drafts(raw, {"event_id": tx.parse_int(F.col("id")), "day": F.to_date(tx.parse_instant(F.col("day"))), "amount": tx.parse_decimal(F.col("amount"))}, ("event_id", "day"))
    return good


@query("no16_party_ordinals", "SELECT l_orderkey AS case_id, CAST(l_suppkey AS VARCHAR) AS participant_id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY encode(CAST(l_suppkey AS VARCHAR))) AS INT) AS ordinal FROM lineitem")
def no16(spark, sf_dir):
    """NO16."""
    return no.party_ordinals(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").cast("string").alias("participant_id")))


@query("no17_derived_at_ingest", "WITH c AS (SELECT o_custkey AS person_id, o_orderkey AS case_id, o_orderdate AS filed, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END AS convicted FROM orders) SELECT c.person_id, c.case_id, EXISTS (SELECT 1 FROM c o WHERE o.person_id = c.person_id AND o.case_id <> c.case_id AND o.filed < c.filed) AS new_case, EXISTS (SELECT 1 FROM c o WHERE o.person_id = c.person_id AND o.case_id <> c.case_id AND o.filed < c.filed AND o.convicted < c.filed) AS reconviction FROM c")
def no17(spark, sf_dir):
    """NO17, JO8."""
    o = _t(spark, sf_dir, "orders")
    return no.derived_at_ingest(o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("filed"), F.when(F.col("o_orderstatus") == "F", F.expr("o_orderdate + INTERVAL 90 DAYS")).alias("convicted")))


@query("no18_appointments", "SELECT judge, place, court, start_date, end_date FROM (SELECT s_suppkey AS judge, p AS place, CASE WHEN (s_suppkey + p) % 3 <> 0 THEN 'court ' || (s_suppkey + p) % 5 END AS court, DATE '1990-01-01' + CAST(s_suppkey + 100 * p AS INT) AS start_date, CASE WHEN p % 2 = 0 THEN DATE '1991-01-01' + CAST(s_suppkey + 100 * p AS INT) END AS end_date FROM supplier, UNNEST([1, 2, 3, 4, 5, 6]) u(p)) WHERE court IS NOT NULL")
def no18(spark, sf_dir):
    """NO18, SC8."""
    return no.appointments(_appointments(spark, sf_dir))


def _appointments(spark, sf_dir):
    k = F.col("s_suppkey")
    cols = [F.col("s_suppkey").alias("judge")]
    for p in range(1, 7):
        day = lambda y, p=p: F.date_add(F.lit(f"{y}-01-01").cast("date"), (k + 100 * p).cast("int"))
        cols += [F.when((k + p) % 3 != 0, F.concat(F.lit("court "), ((k + p) % 5).cast("string"))).alias(f"court_{p}"), day(1990).alias(f"start_{p}"), (day(1991) if p % 2 == 0 else F.lit(None).cast("date")).alias(f"end_{p}")]
    return _t(spark, sf_dir, "supplier").select(*cols)


@query("no19_judge_status", "WITH a AS (SELECT s_suppkey AS judge, p AS place, DATE '1990-01-01' + CAST(s_suppkey + 100 * p AS INT) AS start_date, p % 2 = 0 AS ended FROM supplier, UNNEST([1, 2, 3, 4, 5, 6]) u(p) WHERE (s_suppkey + p) % 3 <> 0) SELECT judge, count(*) AS appointments, CASE WHEN arg_max(ended, (start_date, place)) THEN 'ended' ELSE 'serving' END AS status FROM a GROUP BY ALL")
def no19(spark, sf_dir):
    """NO19."""
    return no.judge_status(no.appointments(_appointments(spark, sf_dir)))


@query("va12_attribution_summary", "SELECT CASE WHEN l_returnflag = 'A' THEN 'judge' ELSE 'unknown' END AS actor, count(*) AS n FROM lineitem GROUP BY ALL")
def va12(spark, sf_dir):
    """VA12."""
    rules = spark.createDataFrame([("A", "*", "judge")], "value string, reason string, rule string")
    return no.attribution_summary(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("disposition"), F.col("l_linestatus").alias("reason")), rules)


@query("fn1_case_number", "SELECT doc_id, sha256(trim(regexp_replace(upper(replace(trim(text), 'ß', 'SS')), '[^A-Z0-9]+', '-', 'g'), '-')) AS n FROM documents")
def fn1(spark, sf_dir):
    """FN1, on whole texts of every language as unruly numbers."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.case_number(F.col("text")), 256).alias("n"))


@query("fn2_person_name")
def fn2(spark, sf_dir):
    """FN2: every text folded (rows only: decomposition of characters is not SQL)."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.person_name(F.col("text")), 256).alias("folded"))


@query("fn3_display_name", "SELECT c_custkey, concat_ws(', ', nullif(concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END, c_name), ''), CASE WHEN c_custkey % 5 = 0 THEN 'Jr' END) AS name FROM customer")
def fn3(spark, sf_dir):
    """FN3."""
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.display_name(F.when(k % 2 == 0, F.lower("c_mktsegment")), F.lit("  "), F.col("c_name"), F.when(k % 5 == 0, F.lit(" Jr "))).alias("name"))


@query("fn4_age_band", "SELECT p_partkey, CASE WHEN p_size >= 55 THEN '55+' WHEN p_size >= 45 THEN '45-54' WHEN p_size >= 35 THEN '35-44' WHEN p_size >= 25 THEN '25-34' WHEN p_size >= 18 THEN '18-24' ELSE 'unknown' END AS band FROM part")
def fn4(spark, sf_dir):
    """FN4."""
    return _t(spark, sf_dir, "part").select("p_partkey", tx.age_band(tx.bounded_age(F.col("p_size").cast("string"))).alias("band"))


@query("fn5_state_code", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'R1' END AS state_code FROM nation")
def fn5(spark, sf_dir):
    """FN5."""
    n = _t(spark, sf_dir, "nation")
    codes = n.where("n_regionkey = 1").select(F.upper(F.concat(F.lit("  "), "n_name")).alias("name"), F.lit("R1").alias("code"))
    return tx.unknown_states(n, "n_name", codes).select("n_name", "state_code")


@query("fn6_vocabulary", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'unknown' END AS s FROM orders")
def fn6(spark, sf_dir):
    """FN6."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.require(F.col("o_orderstatus"), ("F", "O"), "unknown").alias("s"))


@query("fn8_statute_code", "SELECT p_partkey, left(concat_ws('-', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END), 128) AS code FROM part")
def fn8(spark, sf_dir):
    """FN8."""
    return _t(spark, sf_dir, "part").select("p_partkey", tx.statute_code(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit(" ")).alias("code"))


@query("fn9_money", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS amount FROM orders")
def fn9(spark, sf_dir):
    """FN9."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.money(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(14,2)").cast("string")), 100_000).alias("amount"))


@query("fn10_birth_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def fn10(spark, sf_dir):
    """FN10."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.birth_year(F.concat(F.lit("born "), F.date_format("o_orderdate", "yyyy"))).alias("y"))


@query("fn11_iso_instant", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS iso FROM events")
def fn11(spark, sf_dir):
    """FN11, FN15."""
    from ..operators.outcomes import iso_instant

    return _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).select("event_id", iso_instant("ts").alias("iso"))


@query("fn17_json_and_maps", "SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.page')) AS pages FROM events GROUP BY ALL")
def fn17(spark, sf_dir):
    """FN16, FN17."""
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("props", "$.page")).alias("pages"))


@query("fn18_labels", "SELECT DISTINCT upper(left(replace(event_type, '_', ' '), 1)) || substr(replace(event_type, '_', ' '), 2) AS label FROM events")
def fn18(spark, sf_dir):
    """FN18."""
    return _t(spark, sf_dir, "events").select(tx.format_label(F.col("event_type")).alias("label")).distinct()
