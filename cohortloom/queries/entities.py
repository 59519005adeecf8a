"""Queries of person resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import resolution as er
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


#: Persons, identifiers and cases derived from customers and orders, for both engines.
_ID = {
    "persons": "SELECT c_custkey AS id, c_custkey % 97 AS created_at, CASE WHEN c_custkey % 41 = 0 THEN c_custkey - 1 END AS merged_into FROM {customer}",
    "identifiers": """SELECT c_custkey AS person_id, 'full_name' AS kind, concat('n', CAST(c_custkey - c_custkey % 3 AS STRING)) AS hash FROM {customer}
UNION ALL SELECT c_custkey, 'source_participant_id', concat('p', CAST(c_custkey - c_custkey % 2 AS STRING)) FROM {customer} WHERE c_custkey % 10 < 2
UNION ALL SELECT c_custkey, 'date_of_birth', concat('b', CAST(c_custkey % 4 % 2 AS STRING)) FROM {customer} WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, 'name_dob', concat('n', CAST(c_custkey - c_custkey % 3 AS STRING), 'b', CAST(c_custkey % 4 % 2 AS STRING)) FROM {customer} WHERE c_custkey % 7 <> 0""",
    "cases": """SELECT o_custkey AS person_id, o_orderkey AS case_id, concat('C', CAST(o_orderkey AS STRING)) AS case_number,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('C', CAST(o_orderkey - 1 AS STRING)) END AS related_number, c_nationkey AS court_id, CAST(o_orderdate AS DATE) AS filed_date
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
}
_T = "WITH " + ", ".join(f"{n} AS ({s.format(customer='customer', orders='orders')})" for n, s in _ID.items())
_PAIRS = """, bl AS (SELECT DISTINCT kind, hash, person_id FROM identifiers WHERE kind IN ('full_name', 'source_participant_id') AND person_id IN (SELECT id FROM persons WHERE merged_into IS NULL)),
pairs AS (SELECT DISTINCT a.person_id AS l, b.person_id AS r FROM bl a JOIN bl b ON a.kind = b.kind AND a.hash = b.hash AND a.person_id < b.person_id)"""
_FEATURES = _PAIRS + """, pr AS (SELECT h.*, c.* EXCLUDE (person_id) FROM (SELECT person_id, list(hash) FILTER (kind = 'source_participant_id') AS sp, list(hash) FILTER (kind = 'full_name') AS fn, list(hash) FILTER (kind = 'date_of_birth') AS db, list(hash) FILTER (kind = 'name_dob') AS nd FROM identifiers GROUP BY ALL) h
 LEFT JOIN (SELECT person_id, list(case_id) AS cases, list(case_number) AS numbers, list(related_number) FILTER (related_number IS NOT NULL) AS cited, list(court_id) AS courts FROM cases GROUP BY ALL) c ON c.person_id = h.person_id),
gaps AS (SELECT l, r, min(abs(date_diff('day', a.filed_date, b.filed_date))) AS gap FROM pairs JOIN cases a ON a.person_id = l JOIN cases b ON b.person_id = r GROUP BY ALL),
ft AS (SELECT p.l, p.r, coalesce(list_has_any(a.sp, b.sp), false) AS same_source_id, coalesce(list_has_any(a.fn, b.fn), false) AS same_name, coalesce(list_has_any(a.db, b.db), false) AS same_dob,
 a.db IS NULL OR b.db IS NULL AS dob_missing_either, coalesce(list_has_any(a.nd, b.nd), false) AS same_name_dob, coalesce(list_has_any(a.cases, b.cases), false) AS shared_case,
 coalesce(list_has_any(a.cited, b.numbers), false) OR coalesce(list_has_any(a.numbers, b.cited), false) AS related_case_link, coalesce(list_has_any(a.courts, b.courts), false) AS same_court, CAST(g.gap AS INT) AS filing_gap_days,
 CASE WHEN a.db IS NOT NULL AND b.db IS NOT NULL THEN coalesce(list_has_any(a.db, b.db), false) END AS age_consistent
 FROM pairs p JOIN pr a ON a.person_id = p.l JOIN pr b ON b.person_id = p.r LEFT JOIN gaps g ON g.l = p.l AND g.r = p.r)"""
_DECIDED = _FEATURES + """, dc AS (SELECT l, r, CASE WHEN same_source_id THEN 'matched' WHEN same_name_dob AND (shared_case OR related_case_link) THEN 'matched' WHEN same_name_dob AND same_court THEN 'review'
 WHEN same_name AND dob_missing_either THEN 'rejected' WHEN same_name AND NOT same_dob THEN 'rejected' ELSE 'review' END AS decision,
 CASE WHEN same_source_id THEN 1.0 WHEN same_name_dob AND (shared_case OR related_case_link) THEN 0.98 WHEN same_name_dob AND same_court THEN 0.7 WHEN same_name AND dob_missing_either THEN 0.1 WHEN same_name AND NOT same_dob THEN 0.02 ELSE 0.5 END AS score FROM ft)"""


def _tables(spark, sf_dir):
    given = inputs(spark, sf_dir, "customer", "orders")
    return {n: spark.sql(s, **{k: v for k, v in given.items() if "{" + k + "}" in s}) for n, s in _ID.items()}


def _pairs(t):
    return er.candidate_pairs(er.blocks(t["identifiers"], t["persons"]))


def _decided(t):
    return er.evaluate(er.pair_features(_pairs(t), er.profiles(t["identifiers"], t["cases"])))


@query("er2_candidate_pairs", _T + _PAIRS + " SELECT l AS \"left\", r AS \"right\" FROM pairs")
def er2(spark, sf_dir):
    """ER1, ER2, JO14, FI13."""
    return _pairs(_tables(spark, sf_dir))


@query("er3_pair_features", _T + _FEATURES + " SELECT l AS \"left\", r AS \"right\", * EXCLUDE (l, r) FROM ft")
def er3(spark, sf_dir):
    """ER3, MS31."""
    t = _tables(spark, sf_dir)
    return er.pair_features(_pairs(t), er.profiles(t["identifiers"], t["cases"]))


@query("er7_stages", _T + _DECIDED + " SELECT l AS \"left\", r AS \"right\", decision, CAST(score AS DOUBLE) AS score FROM dc")
def er7(spark, sf_dir):
    """ER4, ER5, ER6, ER7."""
    return _decided(_tables(spark, sf_dir)).select("left", "right", "decision", "score")


@query("er8_resolve_drafts", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'person:' || left(sha256(CAST(o_custkey AS VARCHAR)), 32) END AS person_id, o_custkey % 2 <> 0 AS created FROM orders")
def er8(spark, sf_dir):
    """ER8: even customers are known."""
    g = inputs(spark, sf_dir, "orders", "customer")
    key = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("hash")
    known = g["customer"].where("c_custkey % 2 = 0").select(key("c_custkey"), F.col("c_custkey").cast("string").alias("person_id"))
    return er.resolve_drafts(g["orders"].select("o_orderkey", key("o_custkey")), known).drop("hash")


@query("er9_merge_map", _T.replace("WITH ", "WITH RECURSIVE ") + _DECIDED + """, ed AS (SELECT l AS a, r AS b FROM dc WHERE decision = 'matched' UNION SELECT r, l FROM dc WHERE decision = 'matched'),
re(a, b) AS (SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a), co AS (SELECT a AS id, least(a, min(b)) AS c FROM re GROUP BY a)
SELECT id, first_value(id) OVER (PARTITION BY c ORDER BY created_at, id) AS survivor FROM co JOIN persons USING (id)""")
def er9(spark, sf_dir):
    """ER9, MS30: groups of matched persons and who stays."""
    t = _tables(spark, sf_dir)
    return er.merge_map(er.apply_decisions(_decided(t)), t["persons"])


@query("er10_survivors", "WITH RECURSIVE m AS (SELECT c_custkey AS id, c_custkey - 1 AS \"to\" FROM customer WHERE c_custkey % 5 IN (1, 2, 3)), w AS (SELECT id, \"to\" AS s, 1 AS k FROM m UNION ALL SELECT w.id, m.\"to\", k + 1 FROM w JOIN m ON m.id = w.s) SELECT id, arg_max(s, k) AS survivor FROM w GROUP BY id")
def er10(spark, sf_dir):
    """ER10, MS4: chains of up to three merges."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return graph.survivors(c.select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN c_custkey - 1 END").alias("merged_into")))


@query("er11_repoint", "SELECT DISTINCT CASE WHEN o_custkey % 5 IN (1, 2, 3) THEN o_custkey - o_custkey % 5 ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders")
def er11(spark, sf_dir):
    """ER11, JO17: orders of merged customers move, and collide on customer and priority."""
    g = inputs(spark, sf_dir, "orders", "customer")
    merges = graph.survivors(g["customer"].select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN c_custkey - 1 END").alias("merged_into")))
    return er.repoint(g["orders"].select("o_custkey", "o_orderpriority"), merges, "o_custkey", ["o_custkey", "o_orderpriority"])


@query("er12_review_queue", _T + _DECIDED + " SELECT l AS \"left\", r AS \"right\", CAST(score AS DOUBLE) AS score FROM dc WHERE decision = 'review' ORDER BY score DESC, l, r LIMIT 50 OFFSET 10")
def er12(spark, sf_dir):
    """ER12: one page of the queue."""
    return er.review_queue(er.apply_decisions(_decided(_tables(spark, sf_dir))), 50, 10).select("left", "right", "score")


@query("er13_identifier_hash")
def er13(spark, sf_dir):
    """ER13."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", er.identifier_hash("pepper", F.lit("full_name"), F.col("c_name")).alias("hash"))


ORACLE_SQL["er13_identifier_hash"] = "SELECT c_custkey, sha256(encode('pepper') || '\\x00'::BLOB || encode('full_name') || '\\x00'::BLOB || encode(c_name)) AS hash FROM customer"


@query("er14_alias_lookup", "SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey WHEN s_suppkey % 4 = 1 THEN s_suppkey END AS judge_id, CASE WHEN s_suppkey % 4 <= 1 THEN 'resolved' WHEN s_suppkey % 4 = 2 THEN 'held' ELSE 'unresolved' END AS status FROM supplier")
def er14(spark, sf_dir):
    """ER14: exact, normalised, held and unknown names of suppliers."""
    from ..functions.text import fold_space

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    held = (F.col("s_suppkey") % 4 == 2).alias("held")
    exact = s.where("s_suppkey % 4 IN (0, 2)").select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("judge_id"), held)
    normal = s.where("s_suppkey % 4 = 1").select(fold_space(F.col("s_name")).alias("alias"), F.col("s_suppkey").alias("judge_id"), held)
    return er.alias_lookup(s.select(F.col("s_name").alias("name")), exact, normal, fold_space)
