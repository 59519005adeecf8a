"""Queries of serving, joins, windows, sorts, sources and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts, members, serving
from ..sources import files
from ..sources.adapter import inputs, oracle_tables, orders_frame
from ..sources.shared import shared_dir
from .cohort import _ALL, _LD1
from .record import SERVICES, services

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


def _observations(spark, sf_dir):
    """One figure per supplier, with two periods and some figures withheld."""
    s = inputs(spark, sf_dir, "supplier")["supplier"]
    k = F.col("s_suppkey")
    return s.select(
        k.cast("string").alias("subject_id"), (k % 17 / F.lit(17.0)).alias("rate"), (k % 6 == 0).alias("suppressed"),
        F.when(k % 4 == 0, F.lit("1996-01-01")).otherwise(F.lit("1995-01-01")).cast("date").alias("period_start"), F.lit("2001-08-01").cast("date").alias("period_end"),
    ), s.select(k.cast("string").alias("subject_id"), F.col("s_name").alias("name"))


@query(
    "sv2_compare_page",
    f"""WITH services AS ({SERVICES.format(supplier='supplier')}),
ls AS (SELECT judge_id, court_id, position FROM services QUALIFY row_number() OVER (PARTITION BY judge_id ORDER BY start_date DESC NULLS LAST, id) = 1),
o AS (SELECT CAST(s_suppkey AS VARCHAR) AS subject_id, s_name AS name, s_suppkey % 17 / 17.0 AS rate, s_suppkey % 6 = 0 AS suppressed, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1996-01-01' ELSE DATE '1995-01-01' END AS period_start, DATE '2001-08-01' AS period_end FROM supplier),
r AS (SELECT o.*, ls.court_id, ls.position, CASE WHEN NOT suppressed THEN rate END AS figure, count(*) OVER (PARTITION BY period_start, period_end) AS period_rows, count(*) OVER () AS total FROM o JOIN ls ON CAST(ls.judge_id AS VARCHAR) = o.subject_id)
SELECT subject_id, name, rate, suppressed, period_start, period_end, court_id, position, figure, period_rows, total,
 CASE WHEN period_start <> first_value(period_start) OVER (ORDER BY period_rows DESC, period_start, period_end) THEN 'covers another period' END AS warning FROM r
ORDER BY figure NULLS LAST, name, subject_id LIMIT 15""",
)
def sv2(spark, sf_dir):
    """SV2, SV3, JO10, FI12, WI1-WI3, SO3: one page (the limit is the page)."""
    o, names = _observations(spark, sf_dir)
    return serving.compare_page(o, services(spark, sf_dir).withColumn("judge_id", F.col("judge_id").cast("string")), names, 15)


@query("sv4_search")
def sv4(spark, sf_dir):
    """SV4, FN14, ST3: the best twenty hits."""
    g = inputs(spark, sf_dir, "supplier", "nation", "orders")
    judges = g["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    courts = g["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return serving.search(judges, courts, g["orders"].select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C-"), "o_orderkey").alias("number")), "nation 1", "C-33", 20)



@query("fn14_similarity", "WITH n AS (SELECT n_nationkey, n_name, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(n_name), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3))))) AS g FROM nation), q AS (SELECT g FROM n WHERE n_nationkey = 3) SELECT n.n_nationkey, len(list_intersect(n.g, q.g)) / CAST(len(n.g) + len(q.g) - len(list_intersect(n.g, q.g)) AS DOUBLE) AS score FROM n, q")
def fn14(spark, sf_dir):
    """FN14: likeness of names to that of nation 3."""
    from ..functions.text import similarity, trigrams

    n = inputs(spark, sf_dir, "nation")["nation"]
    q = n.where("n_nationkey = 3").select(trigrams(F.col("n_name")).alias("q"))
    return n.crossJoin(F.broadcast(q)).select("n_nationkey", similarity(trigrams(F.col("n_name")), F.col("q")).alias("score"))  # one row


@query("sv5_active_judges", f"WITH services AS ({SERVICES.format(supplier='supplier')}) SELECT DISTINCT judge_id FROM services WHERE court_id = 1 AND (start_date IS NULL OR start_date <= '1990-09-01') AND (end_date IS NULL OR end_date >= '1990-09-01')")
def sv5(spark, sf_dir):
    """SV5, FI9, JO11."""
    s = services(spark, sf_dir)
    return serving.active_judges(s.select("judge_id").distinct(), s, 1, "1990-09-01")


@query("sv6_case_detail", _T + "SELECT id AS case_id, court_id, status, case_type, (SELECT count(*) FROM charges WHERE case_id = '33') AS charges, (SELECT count(*) FROM decisions WHERE case_id = '33') AS decisions, (SELECT count(*) FROM sentences WHERE case_id = '33') AS sentences, (SELECT count(*) FROM case_events WHERE case_id = '33') AS events, (SELECT count(DISTINCT judge_id) FROM assignments WHERE case_id = '33') AS judges FROM cases WHERE id = '33'")
def sv6(spark, sf_dir):
    """SV6."""
    return serving.case_detail(orders_frame(spark, sf_dir), "33")


@query("sv7_judge_cases", _T + ", c AS (SELECT id, court_id, CAST(filed_at AS DATE) AS filed_at, status FROM cases WHERE id IN (SELECT case_id FROM assignments WHERE judge_id = '7')) SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY filed_at DESC, id LIMIT 20")
def sv7(spark, sf_dir):
    """SV7: a page of a judge's cases."""
    return serving.judge_cases(orders_frame(spark, sf_dir), "7", 20)


_FACTS = """ti AS (SELECT id AS case_id, filed_at AS at, 1 AS k, 'filing' AS kind, id AS fact_id FROM cases
UNION ALL SELECT case_id, start_at, 2, 'assignment', case_id || ':' || judge_id FROM assignments UNION ALL SELECT case_id, filed_at, 3, 'charge', id FROM charges
UNION ALL SELECT case_id, event_at, 4, 'event', id FROM case_events UNION ALL SELECT case_id, decision_at, 5, 'decision', id FROM decisions
UNION ALL SELECT case_id, release_at, 6, 'release', id FROM decisions WHERE release_at IS NOT NULL UNION ALL SELECT case_id, disposed_at, 7, 'disposition', id FROM charges WHERE disposed_at IS NOT NULL
UNION ALL SELECT case_id, sentence_at, 8, 'sentence', id FROM sentences UNION ALL SELECT id, closed_at, 9, 'closing', id FROM cases WHERE closed_at IS NOT NULL)"""


@query("sv8_timeline", _T + f", {_FACTS} SELECT case_id, kind, fact_id, CAST(ti.at AS DATE) AS \"at\", CAST(row_number() OVER (PARTITION BY case_id ORDER BY ti.at, k, fact_id) AS INT) AS place FROM ti")
def sv8(spark, sf_dir):
    """SV8: timelines of all cases at once."""
    return serving.timeline(orders_frame(spark, sf_dir)).select("case_id", "kind", "fact_id", F.to_date("at").alias("at"), "place")


@query("sv9_courts", "SELECT CAST(n_regionkey AS VARCHAR) AS jurisdiction_id, CAST(n_nationkey AS VARCHAR) AS id, 25::BIGINT AS total FROM nation ORDER BY 1, 2 LIMIT 10")
def sv9(spark, sf_dir):
    """SV9, SO4: a page of courts."""
    return serving.page(orders_frame(spark, sf_dir).courts.select("jurisdiction_id", "id"), [F.col("jurisdiction_id"), F.col("id")], 10)


@query("sv10_latest_orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def sv10(spark, sf_dir):
    """SV10, LD7: the last run of each source."""
    return serving.latest_per_source(inputs(spark, sf_dir, "orders")["orders"], "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("jo12_observation_dimensions", "SELECT o_orderkey, c_name AS source_name, n_name AS snapshot_name, o_orderstatus AS title FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 3 <> 0")
def jo12(spark, sf_dir):
    """JO12, FI11, SV1: observations with their catalogues."""
    g = inputs(spark, sf_dir, "orders", "customer", "nation")
    o = g["orders"].join(g["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    o = o.select("o_orderkey", F.col("o_orderstatus").alias("slug"), F.col("o_custkey").alias("source_id"), F.col("c_nationkey").alias("snapshot_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).alias("superseded_at"))
    defs = g["orders"].select(F.col("o_orderstatus").alias("slug")).distinct().withColumn("title", F.col("slug"))
    out = serving.with_dimensions(o, defs, g["customer"].select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name")), g["nation"].select(F.col("n_nationkey").alias("snapshot_id"), F.col("n_name").alias("snapshot_name")))
    return out.select("o_orderkey", "source_name", "snapshot_name", "title")


@query("jo15_export_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n, coalesce(b.m, 0) AS m FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 4 <> 0 GROUP BY ALL) a FULL JOIN (SELECT c_custkey AS k, 1 AS m FROM customer WHERE c_custkey % 3 <> 0) b ON a.k = b.k")
def jo15(spark, sf_dir):
    """JO15: exports gathered by case and merged with a full outer join."""
    g = inputs(spark, sf_dir, "orders", "customer")
    a = g["orders"].where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.struct("o_orderkey")).alias("rows"))
    b = g["customer"].where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("m"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query("fi14_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fi14(spark, sf_dir):
    """FI14, FI3, FI13."""
    g = inputs(spark, sf_dir, "orders", "customer")
    return g["orders"].join(g["customer"].where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("st4_set_difference", "SELECT c_custkey AS member_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def st4(spark, sf_dir):
    """ST4: customers without an urgent order."""
    g = inputs(spark, sf_dir, "orders", "customer")
    urgent = g["orders"].where("o_orderpriority = '1-URGENT'")
    return members.missing_members(g["customer"].select(F.col("c_custkey").alias("member_id")), urgent.select(F.col("o_custkey").alias("id")))


@query("ld5_earliest_charge", _T + "SELECT case_id, arg_min(coalesce(source_row_id, '~'), (filed_at, coalesce(source_row_id, '~'))) AS first_key FROM charges GROUP BY ALL")
def ld5(spark, sf_dir):
    """LD5, LD6."""
    c = orders_frame(spark, sf_dir).charges
    key = F.coalesce("source_row_id", F.lit("~"))
    return c.groupBy("case_id").agg(F.min_by(key, F.struct("filed_at", key)).alias("first_key"))


@query("ld2_lead_categories", _T + "SELECT case_id, person_id, offense_category AS lead_category FROM charges WHERE disposition IN ('convicted_plea', 'convicted_verdict') QUALIFY row_number() OVER (PARTITION BY case_id, person_id ORDER BY CASE severity " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(cohorts.SEVERITIES)) + " ELSE 99 END, source_row_id NULLS LAST, id) = 1")
def ld2(spark, sf_dir):
    """LD2."""
    return cohorts.lead_categories(orders_frame(spark, sf_dir)).drop("source_id")


@query("wi6_running_sums", "SELECT o_custkey, o_orderkey, sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM orders")
def wi6(spark, sf_dir):
    """WI6."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return inputs(spark, sf_dir, "orders")["orders"].select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("n"))


@query("sc3_sources_with_cases", "SELECT DISTINCT 'orders' AS source_id FROM orders")
def sc3(spark, sf_dir):
    """SC3."""
    f = orders_frame(spark, sf_dir)
    return files.sources_with_cases(f.sources, f.cases).select("source_id")


_MERGED = "CASE WHEN CAST(person_id AS BIGINT) % 5 = 1 THEN CAST(CAST(person_id AS BIGINT) - 1 AS VARCHAR) ELSE person_id END"


@query("sc4_build_tables", _T + f"SELECT case_id, min({_MERGED}) AS person_id, count(*) AS n FROM sentences WHERE CAST(case_id AS BIGINT) % 3 <> 0 AND coalesce(incarceration_days, 0) <= 150 GROUP BY ALL")
def sc4(spark, sf_dir):
    """SC4, SC13, JO17, MS4: sentences of known cases that are not replaced, of merged persons the survivors'."""
    f = orders_frame(spark, sf_dir)
    tables = f.tables | {"cases": f.cases.where("CAST(id AS BIGINT) % 3 <> 0"), "sentences": f.sentences.withColumn("replaced", F.col("incarceration_days") > 150)}
    number = F.col("id").cast("long")
    merges = f.persons.where(number % 5 == 1).select("id", (number - 1).cast("string").alias("survivor"))
    return files.build_tables(tables, merges)["sentences"].groupBy("case_id").agg(F.min("person_id").alias("person_id"), F.count(F.lit(1)).alias("n"))


@query("sc6_read_export", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN '1996-01-01' AND '2000-12-31' THEN CAST(o_orderdate AS DATE) END AS day FROM orders WHERE o_orderkey % 7 <> 0")
def sc6(spark, sf_dir):
    """SC5, SC6, SC9, MS28: orders written as a CSV export and read by our rules."""
    o = inputs(spark, sf_dir, "orders")["orders"]
    at = f"{shared_dir(spark)}/export-{members.__name__}-{id(o)}"
    k = F.col("o_orderkey")
    day = F.when(k % 10 == 0, F.lit("soon")).when(k % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    o.select(F.when(k % 7 != 0, F.concat(F.lit(" "), k.cast("string"))).alias("id"), day.alias("day")).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(at)
    return files.read_export(files.CONNECTORS["csv"](spark, at, ["id", "day"]), ["id"], ["id"], ["day"], "1996-01-01", "2000-12-31")


_SNAPSHOT = {"assignments": "assignments", "cases": "cases", "charges": "charges", "courts": "courts", "decisions": "decisions", "events": "case_events", "justice_events": "justice_events", "persons": "persons", "sentences": "sentences"}


@query("sc12_snapshot", f"WITH {oracle_tables(*_SNAPSHOT)} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in _SNAPSHOT.items()) + " UNION ALL SELECT 'sources', 1")
def sc12(spark, sf_dir):
    """SC1, SC2, SC12, SC14-SC16, SC20, MS5, MS6: a snapshot of all tables written, verified and read."""
    f = orders_frame(spark, sf_dir)
    path = files.export_snapshot(spark, f.tables | {"sources": f.sources}, f"{shared_dir(spark)}/snapshots")
    parts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in files.open_snapshot(spark, path).items()]
    return reduce(DataFrame.unionByName, parts)


@query("ms27_artifacts_to_read", "SELECT page_id AS artifact FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0")
def ms27(spark, sf_dir):
    """MS27: pages whose contents or parser changed."""
    p = inputs(spark, sf_dir, "pages")["pages"].select(F.col("page_id").alias("artifact"), F.sha2("html", 256).alias("sha256"), F.lit(2).alias("parser_version"))
    k = F.col("artifact")
    old = p.withColumn("sha256", F.when(k % 3 == 0, F.lit("old")).otherwise(F.col("sha256"))).withColumn("parser_version", F.when(k % 5 == 0, F.lit(1)).otherwise(F.lit(2)))
    return serving.artifacts_to_read(p, old).select("artifact")


@query("ms9_periods", _T + "SELECT DISTINCT CAST(year(filed_at) AS INT) AS calendar_year, make_date(year(filed_at), 1, 1) AS period_start, make_date(year(filed_at), 12, 31) AS period_end FROM cases")
def ms9(spark, sf_dir):
    """MS9, AG9."""
    y = orders_frame(spark, sf_dir).cases.select(F.year("filed_at").alias("calendar_year")).distinct()
    return y.select("calendar_year", F.make_date("calendar_year", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("calendar_year", F.lit(12), F.lit(31)).alias("period_end"))
