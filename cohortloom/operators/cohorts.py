"""Lead rows, populations, index events and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.columns import days
from . import gates

#: Final dispositions, and severities and categories in their order.
FINAL_DISPOSITIONS = ("dismissed", "acquitted", "convicted_plea", "convicted_verdict")
CONVICTIONS = ("convicted_plea", "convicted_verdict")
SEVERITIES = ("felony_m", "felony_x", "felony_1", "felony_2", "felony_3", "felony_4", "misdemeanor_a", "misdemeanor_b", "misdemeanor_c", "petty_offense", "unclassified")
CATEGORIES = ("drug", "property", "person", "weapon", "public_order", "traffic", "financial", "other", "unclassified")
#: Columns of an index event, subject columns first.
INDEX_COLUMNS = ("source_id", "subject_type", "subject_id", "member_kind", "member_id", "case_id", "person_id", "index_at")


def first_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: a limited window, so a group keeps one row early."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("row_place", at).where("row_place = 1").drop("row_place")


def rank_in(column: str, values: tuple[str, ...]) -> Column:
    """Place of a value in a closed list; unknown values come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(F.lit(len(values) + 1))


def disposed_charges(frame: Frame) -> DataFrame:
    """Charges with a final disposition and its instant (FI4)."""
    return frame.charges.where(F.col("disposition").isin(list(FINAL_DISPOSITIONS)) & F.col("disposed_at").isNotNull())


def case_dispositions(frame: Frame) -> DataFrame:
    """Rows (source_id, id, disposition_at, judge_id): the last disposed charge decides (LD1)."""
    order = [F.col("disposed_at").desc_nulls_last(), F.col("source_row_id").asc_nulls_last(), F.col("id").asc()]
    lead = first_row(disposed_charges(frame).select("source_id", "case_id", "disposed_at", "source_row_id", "id", "judge_id"), ["source_id", "case_id"], order)
    return lead.select("source_id", F.col("case_id").alias("id"), F.col("disposed_at").alias("disposition_at"), "judge_id")


def disposed_cases(frame: Frame) -> DataFrame:
    """Cases with their disposition (JO1)."""
    return frame.cases.join(case_dispositions(frame), ["source_id", "id"])


def disposed_case_persons(frame: Frame) -> DataFrame:
    """Distinct (source_id, case_id, person_id) with a disposed charge (PO2)."""
    return disposed_charges(frame).select("source_id", "case_id", "person_id").distinct()


def case_persons(frame: Frame) -> DataFrame:
    """Distinct (source_id, case_id, person_id) over charges, decisions and sentences (AG8)."""
    parts = [t.select("source_id", "case_id", "person_id") for t in (frame.charges, frame.decisions, frame.sentences)]
    return parts[0].union(parts[1]).union(parts[2]).where("person_id IS NOT NULL").distinct()


def lead_categories(frame: Frame) -> DataFrame:
    """Rows (source_id, case_id, person_id, lead_category): the gravest convicted charge (LD2)."""
    convicted = frame.charges.where(F.col("disposition").isin(list(CONVICTIONS)))
    order = [rank_in("severity", SEVERITIES), F.col("source_row_id").asc_nulls_last(), F.col("id").asc()]
    lead = first_row(convicted.select("source_id", "case_id", "person_id", "severity", "source_row_id", "id", "offense_category"), ["source_id", "case_id", "person_id"], order)
    return lead.select("source_id", "case_id", "person_id", F.col("offense_category").alias("lead_category"))


def released(decisions: DataFrame) -> DataFrame:
    """Decisions that certainly released, with the instant; an unknown flag is neither (FI5)."""
    return decisions.where(F.coalesce(~F.col("detained_flag"), F.lit(False)) & F.col("release_at").isNotNull())


def _select_index(rows: DataFrame, kind: str, member: str, at: str) -> DataFrame:
    """Rows in the shape of index events (FI10)."""
    return rows.select("source_id", "subject_type", "subject_id", F.lit(kind).alias("member_kind"), F.col(member).alias("member_id"), "case_id", "person_id", F.col(at).alias("index_at"))


def pretrial_release_index(frame: Frame, gate: str = "deciding_judge", subjects=("judge", "court")) -> DataFrame:
    """Releases at their instant; the decision must be covered as well (IE1)."""
    return _select_index(released(gates.pretrial_decisions(frame, gate, subjects=subjects)), "decision", "id", "release_at")


def disposition_index(frame: Frame, gate: str = "disposing_judge", subjects=("judge", "court")) -> DataFrame:
    """Case dispositions, once for each defendant with a disposed charge (IE2)."""
    cases = gates.attributed_cases(frame, disposed_cases(frame), gate, "disposition_at", "judge_id", subjects)
    return _select_index(cases.join(disposed_case_persons(frame), ["source_id", "case_id"]), "case", "case_id", "disposition_at")


def sentence_index(frame: Frame, gate: str = "sentencing_judge", subjects=("judge", "court")) -> DataFrame:
    """Sentences at their instant (IE3)."""
    return _select_index(gates.attributed_sentences(frame, gate, subjects), "sentence", "id", "sentence_at")


def index_events(frame: Frame, kind: str, gate: str, subjects=("judge", "court")) -> DataFrame:
    """Index events of a kind (release, disposition, sentence) within coverage (IE4)."""
    build = {"release": pretrial_release_index, "disposition": disposition_index, "sentence": sentence_index}[kind]
    return gates.within_coverage(frame, build(frame, gate, subjects), "index_at")


def incarceration_terms(frame: Frame) -> DataFrame:
    """Rows (source_id, case_id, person_id, term_start, term_end, term_days) of positive terms (EX1)."""
    own = frame.sentences.where("incarceration_days > 0")
    return own.select(
        "source_id", "case_id", "person_id", F.col("sentence_at").alias("term_start"),
        (F.col("sentence_at") + days(F.col("incarceration_days"))).alias("term_end"), F.col("incarceration_days").alias("term_days"),
    )


def own_terms(frame: Frame) -> DataFrame:
    """The latest end of a person's own terms in a case (LD3)."""
    return incarceration_terms(frame).groupBy("source_id", "case_id", "person_id").agg(F.max("term_end").alias("own_end"), F.max_by("term_days", F.struct("term_end", "term_days")).alias("own_days"))


def defer(cohort: DataFrame, terms: DataFrame) -> DataFrame:
    """Move starts out of custody until none contains them (EX3).

    While a term of the person contains the start, the start moves to the end of the
    containing term that ends last (of equal ends, the longer) and its days count as
    applied. A person's terms travel as one array, so the fixpoint is a fold inside the row.
    Expects a column ``start`` and ``applied``.
    """
    per_person = terms.groupBy("source_id", "person_id").agg(F.sort_array(F.collect_set(F.struct("term_start", "term_end", "term_days"))).alias("terms"))
    latest = (
        "array_max(transform(filter(terms, t -> t.term_start <= a.start AND a.start < t.term_end),"
        " t -> named_struct('to', t.term_end, 'days', t.term_days)))"
    )
    # One more step than terms is never needed: each term is left at most once. Once nothing contains the start, terms are not read again.
    step = f"if(a.going, transform(array({latest}), m -> named_struct('start', coalesce(m.to, a.start), 'applied', a.applied + if(m IS NULL, 0L, m.days), 'going', m IS NOT NULL))[0], a)"
    moved = F.expr(f"aggregate(sequence(1, size(terms)), named_struct('start', start, 'applied', applied, 'going', true), (a, i) -> {step}, a -> named_struct('start', a.start, 'applied', a.applied))")
    joined = cohort.join(per_person, ["source_id", "person_id"], "left")
    out = F.when(F.coalesce(F.size("terms"), F.lit(0)) > 0, moved).otherwise(F.struct("start", "applied"))
    return joined.withColumn("moved", out).drop("terms", "start", "applied").select("*", F.col("moved.start").alias("exposure_start"), F.col("moved.applied").alias("deferral_days")).drop("moved")


def with_exposure(frame: Frame, index: DataFrame, kind: str) -> DataFrame:
    """Index events with exposure_start and deferral_days, null where nothing defers (EX4).

    Dispositions first start at the end of the person's own term if that is later (EX2).
    """
    zero = F.lit(0).cast("long")
    if kind == "disposition":
        index = index.join(own_terms(frame), ["source_id", "case_id", "person_id"], "left")
        later = F.coalesce(F.col("own_end") > F.col("index_at"), F.lit(False))
        index = index.withColumn("start", F.when(later, F.col("own_end")).otherwise(F.col("index_at"))).withColumn("applied", F.when(later, F.col("own_days")).otherwise(zero)).drop("own_end", "own_days")
    else:
        index = index.withColumn("start", F.col("index_at")).withColumn("applied", zero)
    return defer(index, incarceration_terms(frame)).withColumn("deferral_days", F.expr("nullif(deferral_days, 0)"))


def cohort(frame: Frame, kind: str, gate: str, subjects=("judge", "court")) -> DataFrame:
    """Index events of a kind with their exposure."""
    return with_exposure(frame, index_events(frame, kind, gate, subjects), kind)
