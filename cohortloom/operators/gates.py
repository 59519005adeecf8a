"""Attribution: which subjects (judges, courts) a row counts for.

A gate is a join that gives (row, subject) pairs: under the assignment gates one row may
count for several judges. Courts always get the rows of their cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame

#: Names of the gates.
JUDGE_COLUMN_GATES = ("deciding_judge", "sentencing_judge", "disposing_judge")
GATES = (*JUDGE_COLUMN_GATES, "assigned_ever", "assigned_at_time", "court_of_case")
#: Actors and kinds of discretion that never count as a judge's decision.
NOT_JUDICIAL_ACTORS = ("legislature_or_mandatory_rule", "unknown")
NOT_JUDICIAL_DISCRETION = ("mandatory", "unknown")


class GateError(ValueError):
    """The gate cannot be applied to this subject or table."""


def filter_values(rows: DataFrame, column: str, values: list[str] | tuple[str, ...] | None) -> DataFrame:
    """Rows whose column is among the values; all rows without values (FI3)."""
    return rows if values is None else rows.where(F.col(column).isin(list(values)))


def rows_of_court(frame: Frame, rows: DataFrame, case_column: str = "case_id") -> DataFrame:
    """Rows with the court of their case as subject (GA1)."""
    cases = frame.cases.select("source_id", F.col("id").alias(case_column), F.col("court_id").alias("subject_id"))
    return rows.join(cases, ["source_id", case_column]).where("subject_id IS NOT NULL").withColumn("subject_type", F.lit("court"))


def rows_of_judge_column(rows: DataFrame, judge_column: str = "judge_id") -> DataFrame:
    """Rows with the judge they name as subject (GA2)."""
    return rows.where(F.col(judge_column).isNotNull()).withColumn("subject_id", F.col(judge_column)).withColumn("subject_type", F.lit("judge"))


def rows_assigned_at_time(frame: Frame, rows: DataFrame, time_column: str, row_id: str = "id", case_column: str = "case_id") -> DataFrame:
    """Rows with every judge assigned to their case at their instant (GA3).

    start_at <= t < end_at, an open end never ends, a null t matches nothing, and a row
    counts once for a judge however many assignments hold it.
    """
    spans = frame.assignments.select("source_id", F.col("case_id").alias(case_column), F.col("judge_id").alias("subject_id"), "start_at", "end_at")
    t = F.col(time_column)
    hit = rows.where(t.isNotNull()).join(spans, ["source_id", case_column]).where((F.col("start_at") <= t) & (F.col("end_at").isNull() | (t < F.col("end_at"))))
    return hit.drop("start_at", "end_at").dropDuplicates(["source_id", row_id, "subject_id"]).withColumn("subject_type", F.lit("judge"))


def rows_assigned_ever(frame: Frame, rows: DataFrame, case_column: str = "case_id") -> DataFrame:
    """Rows with every judge ever assigned to their case (GA4)."""
    pairs = frame.assignments.select("source_id", F.col("case_id").alias(case_column), F.col("judge_id").alias("subject_id")).distinct()
    return rows.join(pairs, ["source_id", case_column]).where("subject_id IS NOT NULL").withColumn("subject_type", F.lit("judge"))


def gate_rows(frame: Frame, gate: str, rows: DataFrame, *, subject_type: str, case_column: str = "case_id", time_column: str | None = None, judge_column: str | None = "judge_id", row_id: str = "id") -> DataFrame:
    """Rows attributed to subjects of one type under a gate (GA5)."""
    if subject_type == "court":
        return rows_of_court(frame, rows, case_column)
    if gate == "court_of_case":
        raise GateError("court_of_case has no judge")
    if gate in JUDGE_COLUMN_GATES:
        if judge_column is None:
            raise GateError(f"{gate} cannot gate a case")
        return rows_of_judge_column(rows, judge_column)
    if gate == "assigned_ever":
        return rows_assigned_ever(frame, rows, case_column)
    if gate == "assigned_at_time" and time_column:
        return rows_assigned_at_time(frame, rows, time_column, row_id, case_column)
    raise GateError(f"unknown gate {gate}")


def both_subjects(frame: Frame, gate: str, rows: DataFrame, judge_filter: Column | None = None, subjects: tuple[str, ...] = ("judge", "court"), **options) -> DataFrame:
    """Rows attributed to judges and courts; ``judge_filter`` holds for judges alone."""
    parts = []
    for subject in subjects:
        own = rows.where(judge_filter) if subject == "judge" and judge_filter is not None else rows
        parts.append(gate_rows(frame, gate, own, subject_type=subject, **options))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judicial_decision() -> Column:
    """A judge's own decision: actors and discretion that are not judicial never count (FI6)."""
    return ~F.col("actor_type").isin(list(NOT_JUDICIAL_ACTORS)) & ~F.col("discretion").isin(list(NOT_JUDICIAL_DISCRETION))


def attributed_decisions(frame: Frame, gate: str = "deciding_judge", decision_types: tuple[str, ...] | None = None, actors: tuple[str, ...] | None = None, discretion: tuple[str, ...] | None = None, subjects: tuple[str, ...] = ("judge", "court")) -> DataFrame:
    """Decisions by subject under row filters (GA6)."""
    rows = filter_values(filter_values(filter_values(frame.decisions, "decision_type", decision_types), "actor_type", actors), "discretion", discretion)
    return both_subjects(frame, gate, rows, judicial_decision(), subjects, time_column="decision_at")


def attributed_charges(frame: Frame, rows: DataFrame, gate: str = "disposing_judge", subjects: tuple[str, ...] = ("judge", "court")) -> DataFrame:
    """Charges by subject (GA6)."""
    return both_subjects(frame, gate, rows, None, subjects, time_column="disposed_at")


def attributed_sentences(frame: Frame, gate: str = "sentencing_judge", subjects: tuple[str, ...] = ("judge", "court")) -> DataFrame:
    """Sentences by subject (GA6)."""
    return both_subjects(frame, gate, frame.sentences, None, subjects, time_column="sentence_at")


def attributed_cases(frame: Frame, rows: DataFrame, gate: str = "assigned_ever", time_column: str = "filed_at", judge_column: str | None = None, subjects: tuple[str, ...] = ("judge", "court")) -> DataFrame:
    """Cases (column id) by subject; a judge column exists only for disposed cases (GA6)."""
    own = rows.withColumn("case_id", F.col("id"))
    return both_subjects(frame, gate, own, None, subjects, time_column=time_column, judge_column=judge_column)


def within_coverage(frame: Frame, rows: DataFrame, anchor: str) -> DataFrame:
    """Rows whose anchor is in the source's coverage, right edge exclusive; null drops (FI1)."""
    span = F.broadcast(frame.coverage)  # one row for each source
    return rows.join(span, "source_id").where((F.col(anchor) >= F.col("covered_from")) & (F.col(anchor) < F.col("covered_to"))).drop("covered_from", "covered_to")


def pretrial_decisions(frame: Frame, gate: str = "deciding_judge", actors=None, discretion=None, subjects: tuple[str, ...] = ("judge", "court")) -> DataFrame:
    """Pretrial-release decisions by subject, decided within coverage (GA7)."""
    return within_coverage(frame, attributed_decisions(frame, gate, ("pretrial_release",), actors, discretion, subjects), "decision_at")


def statutory_releases(frame: Frame) -> DataFrame:
    """Pretrial releases of a court that a statute made (FI7)."""
    rows = frame.decisions.where("decision_type = 'pretrial_release' AND actor_type = 'legislature_or_mandatory_rule' AND discretion = 'mandatory'")
    return within_coverage(frame, rows_of_court(frame, rows), "decision_at")


def unknown_actor_pretrial_decisions(frame: Frame) -> DataFrame:
    """Pretrial decisions of a court whose actor is unknown (FI8)."""
    rows = frame.decisions.where("decision_type = 'pretrial_release' AND actor_type = 'unknown'")
    return within_coverage(frame, rows_of_court(frame, rows), "decision_at")


def subjects_of(frame: Frame) -> DataFrame:
    """Rows (source_id, subject_type, subject_id): judges named anywhere, and courts (GA9).

    A function of the frame alone: listed once for it, or read where it is stored beside it.
    """
    return frame.once("subjects", _list_subjects)


def _list_subjects(frame: Frame) -> DataFrame:
    named = [t.select("source_id", "judge_id") for t in (frame.assignments, frame.charges, frame.decisions, frame.sentences)]
    judges = named[0].union(named[1]).union(named[2]).union(named[3]).where("judge_id IS NOT NULL").distinct()
    courts = frame.courts.select("source_id", F.col("id").alias("judge_id")).distinct()
    return judges.withColumn("subject_type", F.lit("judge")).union(courts.withColumn("subject_type", F.lit("court"))).select("source_id", "subject_type", F.col("judge_id").alias("subject_id"))


def not_attributable(frame: Frame, gates: list[tuple[str, str]]) -> DataFrame:
    """Rows (source_id, slug, gate) for metrics whose gate the source does not record (GA8)."""
    wanted = frame.sources.sparkSession.createDataFrame(gates, "slug string, gate string")
    return frame.sources.crossJoin(F.broadcast(wanted)).where("gate <> 'court_of_case'").where("NOT array_contains(judge_gates, gate)").select("source_id", "slug", "gate")
