"""Data-quality checks: each yields rows (entity_type, entity_id, severity, issue_code, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame
from .cohorts import CONVICTIONS

ISSUE = ("entity_type", "entity_id", "severity", "issue_code", "detail")
#: Decisions that may come before their case is filed, and actors that name a judge.
PRE_FILING = ("pretrial_release", "charging")
JUDGE_EXPECTED = ("judge", "unknown")


def _issues(rows: DataFrame, entity: str, code: str, severity: str, detail, entity_id: str | None = "id") -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    own = F.col(entity_id).cast("string") if entity_id else F.lit(None).cast("string")
    return rows.select(F.lit(entity).alias("entity_type"), own.alias("entity_id"), F.lit(severity).alias("severity"), F.lit(code).alias("issue_code"), detail.alias("detail"))


def service_dates_invalid(services: DataFrame) -> DataFrame:
    """A service that ends before it starts (DQ1)."""
    return _issues(services.where("end_date < start_date"), "judge_service", "service_dates_invalid", "error", "ends before it starts")


def service_overlap(services: DataFrame) -> DataFrame:
    """Services of one judge at one court that overlap strictly; touching ones do not (DQ2).

    Ordered by start (undated first) and position; the later one is reported, once for
    each earlier one. Undated services overlap nothing.
    """
    open_end = F.lit("9999-12-31").cast("date")
    own = services.where("start_date IS NOT NULL").withColumn("until", F.coalesce("end_date", open_end))
    a = own.select("judge_id", "court_id", *[F.col(c).alias(f"a_{c}") for c in ("id", "start_date", "until", "position")])
    b = own.select("judge_id", "court_id", *[F.col(c).alias(f"b_{c}") for c in ("id", "start_date", "until", "position")])
    before = F.struct("a_start_date", "a_position", "a_id") < F.struct("b_start_date", "b_position", "b_id")
    hit = a.join(b, ["judge_id", "court_id"]).where(before & (F.col("a_start_date") < F.col("b_until")) & (F.col("b_start_date") < F.col("a_until")))
    return _issues(hit, "judge_service", "service_overlap", "warning", F.concat(F.lit("overlaps service "), F.col("a_id").cast("string")), "b_id")


def missing_start_date(services: DataFrame) -> DataFrame:
    """A service without a start date (DQ3)."""
    return _issues(services.where("start_date IS NULL"), "judge_service", "missing_start_date", "info", "no start date")


def provenance_incomplete(records: DataFrame) -> DataFrame:
    """A record without a source record, or with one that has no SHA-256 (DQ4)."""
    bad = records.where("raw_sha256 IS NULL OR NOT raw_sha256 RLIKE '^[0-9a-f]{64}$'")
    return _issues(bad, "record", "provenance_incomplete", "error", F.when(F.col("raw_sha256").isNull(), F.lit("no source record")).otherwise(F.lit("source record without a sha256")))


def case_number_duplicate(drafts: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Source rows with one natural key and different contents, before deduplication (DQ5)."""
    whole = F.struct(*compared)
    groups = drafts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)).alias("kinds"))
    hit = groups.where("n > 1 AND kinds > 1").withColumn("key", F.concat_ws("|", *key))
    return _issues(hit, "case", "case_number_duplicate", "info", F.concat(F.col("n").cast("string"), F.lit(" source rows")), "key")


def _filed(frame: Frame) -> DataFrame:
    return frame.cases.select("source_id", F.col("id").alias("case_id"), F.to_date("filed_at").alias("filed_date"), F.col("closed_at").alias("case_closed_at"), F.col("status").alias("case_status"))


def disposition_before_filing(frame: Frame) -> DataFrame:
    """A charge disposed before it, or else before its case, was filed (DQ6)."""
    rows = frame.charges.where("disposed_at IS NOT NULL").join(_filed(frame), ["source_id", "case_id"], "left")
    detail = F.when(F.col("disposed_at") < F.col("filed_at"), F.lit("before the charge was filed")).when(F.to_date("disposed_at") < F.col("filed_date"), F.lit("before the case was filed"))
    return _issues(rows.withColumn("problem", detail).where("problem IS NOT NULL"), "charge", "disposition_before_filing", "error", F.col("problem"))


def event_order_impossible(frame: Frame) -> DataFrame:
    """Orders that no case can have, the first that applies to a row (DQ7)."""
    code, severity = "event_order_impossible", "error"
    filed = _filed(frame)
    late = lambda at: F.when(F.to_date(at) < F.col("filed_date"), F.lit("before the case was filed"))

    def found(rows: DataFrame, entity: str, problem, entity_id: str = "id") -> DataFrame:
        return _issues(rows.withColumn("problem", problem).where("problem IS NOT NULL"), entity, code, severity, F.col("problem"), entity_id)

    cases = found(frame.cases, "case", F.when(F.to_date("closed_at") < F.to_date("filed_at"), F.lit("closed before it was filed")))
    spans = frame.assignments.join(filed, ["source_id", "case_id"], "left").withColumn("id", F.concat_ws(":", "case_id", "judge_id"))
    assignments = found(spans, "assignment", F.coalesce(F.when(F.col("end_at") < F.col("start_at"), F.lit("ends before it starts")), late("start_at")))
    events = found(frame.events.join(filed, ["source_id", "case_id"], "left"), "event", late("event_at"))
    early = F.when(F.col("release_at") < F.col("decision_at"), F.lit("released before the decision"))
    decisions = found(frame.decisions.join(filed, ["source_id", "case_id"], "left"), "decision", F.coalesce(early, F.when(~F.col("decision_type").isin(list(PRE_FILING)), late("decision_at"))))
    first = frame.charges.where(F.col("disposition").isin(list(CONVICTIONS))).groupBy("source_id", "case_id", "person_id").agg(F.min("disposed_at").alias("convicted_at"))
    rows = frame.sentences.join(first, ["source_id", "case_id", "person_id"], "left").join(filed, ["source_id", "case_id"], "left")
    sentences = found(rows, "sentence", F.coalesce(F.when(F.col("sentence_at") < F.col("convicted_at"), F.lit("sentenced before the conviction")), late("sentence_at")))
    return reduce(DataFrame.unionByName, [cases, assignments, events, decisions, sentences])


def subsequent_before_index(frame: Frame) -> DataFrame:
    """A justice event before its related case, or else before the person's first case (DQ8)."""
    filed = _filed(frame).select("source_id", "case_id", "filed_date")
    persons = frame.charges.select("source_id", "case_id", "person_id").distinct().join(filed, ["source_id", "case_id"])
    first = persons.groupBy("source_id", "person_id").agg(F.min("filed_date").alias("first_filed"))
    rows = frame.justice_events.join(filed.withColumnRenamed("case_id", "related_case_id"), ["source_id", "related_case_id"], "left").join(first, ["source_id", "person_id"], "left")
    day = F.to_date("event_at")
    problem = F.when(day < F.col("filed_date"), F.lit("before its case was filed")).when(day < F.col("first_filed"), F.lit("before the person's first case was filed"))
    return _issues(rows.withColumn("problem", problem).where("problem IS NOT NULL"), "justice_event", "subsequent_before_index", "error", F.col("problem"))


def missing_judge_on_decision(frame: Frame, never_recorded: tuple[str, ...] = ()) -> DataFrame:
    """A decision by a judge or an unknown actor that names none (DQ9).

    Types of which the source never records the judge give one counted issue each.
    """
    rows = frame.decisions.where(F.col("judge_id").isNull() & F.col("actor_type").isin(list(JUDGE_EXPECTED)))
    silent = F.col("decision_type").isin(list(never_recorded))
    own = _issues(rows.where(~silent), "decision", "missing_judge_on_decision", "warning", F.concat(F.col("decision_type"), F.lit(" names no judge")))
    counted = rows.where(silent).groupBy("decision_type").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(_issues(counted, "decision", "missing_judge_on_decision", "info", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("decision_type"), F.lit(" decisions name no judge")), None))


def missing_disposition(frame: Frame) -> DataFrame:
    """A charge of a closed case without a disposition (DQ10)."""
    rows = frame.charges.where("disposition IS NULL").join(_filed(frame).where("case_status = 'closed'"), ["source_id", "case_id"])
    return _issues(rows, "charge", "missing_disposition", "info", "no disposition although the case is closed")


def unknown_category_measured(frame: Frame) -> DataFrame:
    """How many values of each categorical field are ``unknown`` (DQ11)."""
    fields = [("decision", frame.decisions, ("actor_type", "discretion")), ("charge", frame.charges, ("offense_category", "severity", "disposition_actor"))]
    parts = []
    for entity, table, columns in fields:
        sums = [x for c in columns for x in (F.sum((F.col(c) == "unknown").cast("long")).alias(f"{c}_u"), F.count(c).alias(f"{c}_n"))]
        stack = ", ".join(f"'{c}', {c}_u, {c}_n" for c in columns)
        parts.append(table.agg(*sums).select(F.lit(entity).alias("entity"), F.expr(f"stack({len(columns)}, {stack}) AS (field, unknown, total)")))
    rows = reduce(DataFrame.unionByName, parts).where("unknown > 0")
    detail = F.concat(F.col("entity"), F.lit("."), F.col("field"), F.lit(": "), F.col("unknown").cast("string"), F.lit(" of "), F.col("total").cast("string"))
    return rows.select(F.col("entity").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), F.lit("info").alias("severity"), F.lit("unknown_category_measured").alias("issue_code"), detail.alias("detail"))


def resolution_confidence_missing(parties: DataFrame) -> DataFrame:
    """A party that resolved to no person (DQ12)."""
    return _issues(parties.where("person_id IS NULL"), "case_party", "person_resolution_confidence_missing", "warning", "resolved to no person")
