"""Coverage statistics of cases by source, jurisdiction and court."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.columns import decimal_share
from .cohorts import case_dispositions, disposed_charges

#: Statistics: name, flag that counts, flag of the cases that can count (None: all).
STATISTICS = (
    ("cases_with_disposition", "has_disposition", None),
    ("closed_cases_with_disposition", "closed_with_disposition", "closed"),
    ("cases_with_assignment", "has_assignment", None),
    ("decisions_with_judge", "all_decisions_name_judge", "has_decision"),
    ("convicted_cases_with_sentence", "convicted_with_sentence", "has_conviction"),
    ("cases_with_person", "has_person", None),
    ("cases_with_event", "has_event", None),
)


def case_flags(frame: Frame) -> DataFrame:
    """Per-case flags with court and jurisdiction; courts without a jurisdiction keep null (JO16)."""
    key = ["source_id", "case_id"]
    cases = frame.cases.select("source_id", F.col("id").alias("case_id"), "court_id", (F.col("status") == "closed").alias("closed"))
    courts = frame.courts.select("source_id", F.col("id").alias("court_id"), "jurisdiction_id")
    disposed = case_dispositions(frame).select("source_id", F.col("id").alias("case_id"), F.lit(True).alias("has_disposition"))
    assigned = frame.assignments.select(*key).distinct().withColumn("has_assignment", F.lit(True))
    decided = frame.decisions.groupBy(*key).agg(F.lit(True).alias("has_decision"), F.bool_and(F.col("judge_id").isNotNull()).alias("all_decisions_name_judge"))
    convicted = disposed_charges(frame).groupBy(*key).agg(F.bool_or(F.col("disposition").startswith("convicted")).alias("has_conviction"))
    sentenced = frame.sentences.select(*key).distinct().withColumn("has_sentence", F.lit(True))
    people = frame.charges.groupBy(*key).agg(F.bool_or(F.col("person_id").isNotNull()).alias("has_person"))
    events = frame.events.select(*key).distinct().withColumn("has_event", F.lit(True))
    out = cases.join(courts, ["source_id", "court_id"], "left")
    for part in (disposed, assigned, decided, convicted, sentenced, people, events):
        out = out.join(part, key, "left")
    flags = ("closed", "has_disposition", "has_assignment", "has_decision", "all_decisions_name_judge", "has_conviction", "has_sentence", "has_person", "has_event")
    out = out.select(*key, "court_id", "jurisdiction_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    return out.withColumn("closed_with_disposition", F.col("closed") & F.col("has_disposition")).withColumn("convicted_with_sentence", F.col("has_conviction") & F.col("has_sentence"))


def frame_statistics(frame: Frame) -> DataFrame:
    """Numerator, denominator and share of each statistic and scope (AG17, AG18).

    One pass with grouping sets: the source, each jurisdiction and each court.
    """
    sums = []
    for name, flag, among in STATISTICS:
        base = F.col(among) if among else F.lit(True)
        sums.append(F.sum((base & F.col(flag)).cast("long")).alias(f"{name}_k"))
        sums.append(F.sum(base.cast("long")).alias(f"{name}_n"))
    sets = case_flags(frame).groupingSets([["source_id"], ["source_id", "jurisdiction_id"], ["source_id", "court_id"]], "source_id", "jurisdiction_id", "court_id")
    wide = sets.agg(F.grouping("jurisdiction_id").alias("gj"), F.grouping("court_id").alias("gc"), *sums)
    scope = F.when(F.col("gc") == 0, F.lit("court")).when(F.col("gj") == 0, F.lit("jurisdiction")).otherwise(F.lit("source"))
    stack = ", ".join(f"'{n}', {n}_k, {n}_n" for n, _, _ in STATISTICS)
    tall = wide.withColumn("scope_type", scope).withColumn("scope_id", F.when(F.col("gc") == 0, F.col("court_id")).when(F.col("gj") == 0, F.col("jurisdiction_id")).otherwise(F.col("source_id")))
    tall = tall.where("scope_id IS NOT NULL").select("source_id", "scope_type", "scope_id", F.expr(f"stack({len(STATISTICS)}, {stack}) AS (statistic, numerator, denominator)"))
    return tall.withColumn("share", decimal_share(F.col("numerator"), F.col("denominator")))


def source_counts(frame: Frame) -> DataFrame:
    """Rows of every table and the filing span of each source (AG20)."""
    out = frame.cases.groupBy("source_id").agg(F.count(F.lit(1)).alias("cases"), F.to_date(F.min("filed_at")).alias("first_filed"), F.to_date(F.max("filed_at")).alias("last_filed"))
    for name in ("charges", "decisions", "sentences", "assignments", "events", "justice_events"):
        out = out.join(frame.tables[name].groupBy("source_id").agg(F.count(F.lit(1)).alias(name)), "source_id", "left")
    return out.na.fill(0)


def case_window(frame: Frame) -> DataFrame:
    """Cases of each judge with their first and last filing (AG21)."""
    cases = frame.cases.select("source_id", F.col("id").alias("case_id"), "filed_at")
    return frame.assignments.join(cases, ["source_id", "case_id"]).groupBy("judge_id").agg(F.count_distinct("case_id").alias("cases"), F.to_date(F.min("filed_at")).alias("first_filed"), F.to_date(F.max("filed_at")).alias("last_filed"))
