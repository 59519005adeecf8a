"""Read-side queries: pages, comparison, search, timelines, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.text import format_label, similarity, trigrams, word_similarity
from .cohorts import first_row

#: Kinds of dated facts in the order in which a timeline shows those of one instant.
TIMELINE = ("filing", "assignment", "charge", "event", "decision", "release", "disposition", "sentence", "closing")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with the number of all rows (WI1, SO3, SO4).

    The count is its own aggregate, so the rows are never gathered for a window; an empty
    page has no rows.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def with_dimensions(observations: DataFrame, definitions: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current observations with definition, source and snapshot, all optional (JO12, FI11)."""
    out = observations.where("superseded_at IS NULL")
    for table, key in ((definitions, "slug"), (sources, "source_id"), (snapshots, "snapshot_id")):
        out = out.join(table, key, "left")
    return out


def subject_observations(observations: DataFrame, subject_type: str, subject_id: str) -> DataFrame:
    """A subject's current observations in display order (SV1, SO5)."""
    own = observations.where((F.col("subject_type") == subject_type) & (F.col("subject_id") == subject_id))
    return own.orderBy("slug", F.asc_nulls_first("window_days"), F.asc_nulls_first("dimension_value"), "source_id", F.asc_nulls_first("calendar_year"))


def latest_services(services: DataFrame, courts: list | None = None) -> DataFrame:
    """The latest service of each judge, in the cohort's courts (JO10)."""
    own = services if courts is None else services.where(F.col("court_id").isin(courts))
    return first_row(own, ["judge_id"], [F.desc_nulls_last("start_date"), F.col("id")])


def compare_page(observations: DataFrame, services: DataFrame, names: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One metric over a cohort of judges (SV2, FI12, WI2, WI3).

    Suppressed figures are masked before they sort. The reference period is the one that
    most rows have, of equals the earliest; rows of another period say so.
    """
    rows = observations.join(latest_services(services).select("judge_id", "court_id", "position"), observations["subject_id"] == F.col("judge_id")).drop("judge_id").join(names, "subject_id")
    rows = rows.withColumn("figure", F.when(~F.col("suppressed"), F.col("rate")))
    periods = rows.groupBy("period_start", "period_end").agg(F.count(F.lit(1)).alias("period_rows"))
    reference = periods.agg(F.max_by(F.struct("period_start", "period_end"), F.struct(F.col("period_rows"), -F.unix_date("period_start"), -F.unix_date("period_end"))).alias("reference"))
    rows = rows.join(periods, ["period_start", "period_end"]).crossJoin(F.broadcast(reference))  # one row
    differs = (F.col("period_start") != F.col("reference.period_start")) | (F.col("period_end") != F.col("reference.period_end"))
    rows = rows.withColumn("warning", coverage_warning(differs, F.lit(False))).drop("reference")
    return page(rows, [F.asc_nulls_last("figure"), F.col("name"), F.col("subject_id")], limit, offset)


def coverage_warning(differs: Column, not_observable: Column) -> Column:
    """What a reader must know about a row's coverage (SV3)."""
    text = F.concat_ws("; ", F.when(differs, F.lit("covers another period")), F.when(not_observable, F.lit("the source cannot document the outcome")))
    return F.nullif(text, F.lit(""))


def search(judges: DataFrame, courts: DataFrame, cases: DataFrame, query: str, case_number: str, limit: int = 20, threshold: float = 0.3, word_threshold: float = 0.5) -> DataFrame:
    """Judges and courts by name likeness and cases by exact number, best first (SV4, FN14, ST3).

    A query of one word is compared with runs of words of a name.
    """
    word = len(query.split()) == 1
    q = F.lit(query)

    def arm(table: DataFrame, kind: str) -> DataFrame:
        score = word_similarity(q, F.col("name")) if word else similarity(trigrams(F.col("name")), trigrams(q))
        return table.select(F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("id"), "name", score.alias("score")).where(F.col("score") >= (word_threshold if word else threshold))

    exact = cases.where(F.col("number") == case_number).select(F.lit("case").alias("entity_type"), F.col("id").cast("string").alias("id"), F.col("number").alias("name"), F.lit(1.0).alias("score"))
    return reduce(DataFrame.unionByName, [arm(judges, "judge"), arm(courts, "court"), exact]).orderBy(F.desc("score"), "name", "id").limit(limit)


def active_judges(judges: DataFrame, services: DataFrame, court_id, on: str) -> DataFrame:
    """Judges with a service at a court on a date, both on one record (FI9, SV5, JO11)."""
    day = F.lit(on).cast("date")
    hit = services.where((F.col("court_id") == court_id) & (F.col("start_date").isNull() | (F.col("start_date") <= day)) & (F.col("end_date").isNull() | (F.col("end_date") >= day)))
    return judges.join(hit.select("judge_id"), "judge_id", "left_semi")


def judge_cases(frame: Frame, judge_id: str, limit: int, offset: int = 0) -> DataFrame:
    """A judge's cases, newest first (SV7, JO11)."""
    own = frame.assignments.where(F.col("judge_id") == judge_id).select("source_id", F.col("case_id").alias("id"))
    cases = frame.cases.join(own, ["source_id", "id"], "left_semi").select("id", "court_id", F.to_date("filed_at").alias("filed_at"), "status")
    return page(cases, [F.desc("filed_at"), F.col("id")], limit, offset)


def timeline(frame: Frame, cases: DataFrame | None = None) -> DataFrame:
    """Dated facts of cases in order of instant, kind and id (SV8, FN18).

    Works for one case or for all at once: the order is inside a case.
    """
    keep = (lambda t, c: t) if cases is None else (lambda t, c: t.join(cases.select(F.col("case_id").alias(c)), c, "left_semi"))

    def fact(table: DataFrame, kind: str, at: str, case: str, id_: Column, title: Column) -> DataFrame:
        own = keep(table.where(F.col(at).isNotNull()), case)
        return own.select(F.col(case).alias("case_id"), F.col(at).alias("at"), F.lit(kind).alias("kind"), id_.cast("string").alias("fact_id"), title.alias("title"))

    col = F.col
    parts = [
        fact(frame.cases, "filing", "filed_at", "id", col("id"), F.lit("Case filed")),
        fact(frame.assignments, "assignment", "start_at", "case_id", F.concat_ws(":", "case_id", "judge_id"), F.concat(F.lit("Assigned to "), col("judge_id"))),
        fact(frame.charges, "charge", "filed_at", "case_id", col("id"), F.concat(F.lit("Charge: "), format_label(col("offense_category")))),
        fact(frame.events, "event", "event_at", "case_id", col("id"), format_label(col("event_type"))),
        fact(frame.decisions, "decision", "decision_at", "case_id", col("id"), format_label(col("decision_type"))),
        fact(frame.decisions, "release", "release_at", "case_id", col("id"), F.lit("Released")),
        fact(frame.charges, "disposition", "disposed_at", "case_id", col("id"), format_label(col("disposition"))),
        fact(frame.sentences, "sentence", "sentence_at", "case_id", col("id"), F.lit("Sentenced")),
        fact(frame.cases, "closing", "closed_at", "id", col("id"), F.lit("Case closed")),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    rank = F.array_position(F.array(*[F.lit(k) for k in TIMELINE]), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("at", rank, "fact_id"))
    return rows.withColumn("place", place)


def case_detail(frame: Frame, case_id: str) -> DataFrame:
    """One case with its numbers of charges, decisions, sentences, events and judges (SV6)."""
    key = F.col("case_id") == case_id
    out = frame.cases.where(F.col("id") == case_id).select(F.col("id").alias("case_id"), "court_id", "status", "case_type")
    for name in ("charges", "decisions", "sentences", "events"):
        out = out.join(frame.tables[name].where(key).groupBy("case_id").agg(F.count(F.lit(1)).alias(name)), "case_id", "left")
    return out.join(frame.assignments.where(key).groupBy("case_id").agg(F.count_distinct("judge_id").alias("judges")), "case_id", "left").na.fill(0)


def latest_per_source(runs: DataFrame, source: str, at: str, id_: str) -> DataFrame:
    """The last run of each source (LD7)."""
    return first_row(runs, [source], [F.desc(at), F.desc(id_)])


def artifacts_to_read(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Artifacts whose contents or parser changed (MS27)."""
    return found.join(recorded, ["artifact", "sha256", "parser_version"], "left_anti")
