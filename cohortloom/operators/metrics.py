"""Metric kinds: counts, shares, rates, survival, distributions, medians.

Every function computes all subjects of all sources at once. Rows are grouped by subject
and period; a subject without rows still has its whole window, with zeros.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.columns import ratio, suppression_reason, wilson
from ..plans.registry import ANCHORS, Metric
from . import cohorts, gates, outcomes
from .outcomes import SUBJECT, by_period

KEYS = [*SUBJECT, "calendar_year"]


def counted_filter(counted: dict[str, object]) -> Column:
    """All conditions column = value hold; without conditions, true (FI2)."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in counted.items()], F.lit(True))


def shared_key(metric: Metric) -> str:
    """Metrics of one key have the same population rows, or the same index events and exposure."""
    m = metric
    return f"rows:{'cases' if m.population == 'defendants' else m.population}:{m.gate}:{m.subjects}:{m.actors}:{m.discretion}"


def population_rows(frame: Frame, metric: Metric) -> DataFrame:
    """Rows of the metric's population by subject, anchor within coverage (PO1)."""
    return frame.once(shared_key(metric), lambda own: _population_rows(own, metric))


def _population_rows(frame: Frame, metric: Metric) -> DataFrame:
    m, subjects = metric, metric.subjects
    if m.population in ("cases", "defendants"):
        rows = gates.attributed_cases(frame, frame.cases, m.gate, "filed_at", subjects=subjects)
    elif m.population == "pretrial_decisions":
        rows = gates.attributed_decisions(frame, m.gate, ("pretrial_release",), m.actors, m.discretion, subjects)
    elif m.population == "disposed_charges":
        rows = gates.attributed_charges(frame, cohorts.disposed_charges(frame), m.gate, subjects)
    elif m.population == "disposed_cases":
        rows = gates.attributed_cases(frame, cohorts.disposed_cases(frame), m.gate, "disposition_at", "judge_id", subjects)
    elif m.population == "sentences":
        rows = gates.attributed_sentences(frame, m.gate, subjects)
    else:
        raise ValueError(f"{m.slug}: {m.population} is a cohort, not a population")
    return gates.within_coverage(frame, rows, ANCHORS[m.population])


def with_empty_subjects(frame: Frame, table: DataFrame, subjects: tuple[str, ...], zeros: dict[str, Column]) -> DataFrame:
    """Add a whole-window row with zeros for each subject that has none."""
    present = table.where("calendar_year IS NULL").select(*SUBJECT).distinct()
    absent = gates.subjects_of(frame).where(F.col("subject_type").isin(list(subjects))).join(present, list(SUBJECT), "left_anti")
    filled = absent.select(*SUBJECT, *[zeros.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in SUBJECT])
    return table.unionByName(filled)


def compute_count(frame: Frame, metric: Metric) -> DataFrame:
    """numerator by subject and period; defendants count distinct persons of the cases (AG1)."""
    rows = by_period(population_rows(frame, metric), ANCHORS[metric.population])
    if metric.population == "defendants":
        persons = cohorts.case_persons(frame)
        pairs = rows.select(*KEYS, "case_id").join(persons, ["source_id", "case_id"], "left")
        table = pairs.groupBy(*KEYS).agg(F.count_distinct("person_id").alias("numerator"))
    else:
        table = rows.groupBy(*KEYS).agg(F.sum(counted_filter(metric.counted).cast("long")).alias("numerator"))
    return with_empty_subjects(frame, table, metric.subjects, {"numerator": F.lit(0)})


def compute_share(frame: Frame, metric: Metric) -> DataFrame:
    """numerator, denominator, rate and Wilson interval, with suppression (AG2, AG13, AG14)."""
    rows = by_period(population_rows(frame, metric), ANCHORS[metric.population])
    table = rows.groupBy(*KEYS).agg(F.sum(counted_filter(metric.counted).cast("long")).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    table = with_empty_subjects(frame, table, metric.subjects, {"numerator": F.lit(0), "denominator": F.lit(0)})
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    table = table.withColumn("rate", ratio(F.col("numerator"), F.col("denominator"))).withColumn("low", low).withColumn("high", high)
    return with_suppression(table, F.col("denominator"), metric.threshold)


def with_suppression(table: DataFrame, cohort: Column, threshold: int) -> DataFrame:
    """Add suppressed and suppression_reason (AG13)."""
    return table.withColumn("suppression_reason", suppression_reason(cohort, threshold)).withColumn("suppressed", F.col("suppression_reason").isNotNull())


def metric_cohort(frame: Frame, metric: Metric) -> DataFrame:
    """The metric's index events with exposure, first outcome and end of coverage."""
    if stored := frame.derived.get(shared_key(metric)):
        return outcomes.with_coverage_end(frame, stored.withColumnRenamed(f"first_{metric.outcome}", "first_outcome_at"))
    exposed = cohorts.cohort(frame, metric.population, metric.gate, metric.subjects)
    found = outcomes.first_outcomes(outcomes.all_justice_events(frame), exposed, metric.outcome)
    return outcomes.with_coverage_end(frame, found)


def compute_windowed_rate(frame: Frame, metric: Metric) -> DataFrame:
    """Rates of first outcomes by window; sources that cannot document the outcome have none (AG3)."""
    table = outcomes.fixed_window_rates(observable(frame, metric, metric_cohort(frame, metric)))
    return with_suppression(table, F.col("followed"), metric.threshold)


def compute_survival(frame: Frame, metric: Metric) -> DataFrame:
    """Cumulative incidence by window (AG4)."""
    table = outcomes.kaplan_meier(observable(frame, metric, metric_cohort(frame, metric)))
    return with_suppression(table, F.col("eligible"), metric.threshold)


def observable(frame: Frame, metric: Metric, rows: DataFrame) -> DataFrame:
    """Rows of the sources that document the metric's outcome."""
    seen = outcomes.observability(frame, [(metric.outcome, metric.scope)]).where("observable").select("source_id")
    return rows.join(F.broadcast(seen), "source_id", "left_semi")  # one row for each source


def compute_distribution(frame: Frame, metric: Metric) -> DataFrame:
    """Rows of every final disposition, zeros included, and the whole as a map (AG5)."""
    rows = by_period(population_rows(frame, metric), ANCHORS[metric.population])
    values = cohorts.FINAL_DISPOSITIONS
    wide = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("denominator"), *[F.sum((F.col(metric.dimension) == v).cast("long")).alias(v) for v in values])
    wide = with_empty_subjects(frame, wide, metric.subjects, {c: F.lit(0) for c in ("denominator", *values)})
    whole = F.create_map(*[x for v in values for x in (F.lit(v), F.col(v))])
    stack = ", ".join(f"'{v}', {v}" for v in values)
    return wide.select(*KEYS, "denominator", whole.alias("distribution"), F.expr(f"stack({len(values)}, {stack}) AS (dimension_value, numerator)"))


def with_measure(rows: DataFrame, measure: str) -> DataFrame:
    """Add the measured value; days to disposition are null when negative (AG7)."""
    if measure == "days_to_disposition":
        n = F.datediff(F.to_date("disposition_at"), F.to_date("filed_at"))
        return rows.withColumn("measured", F.when(n >= 0, n).cast("long"))
    return rows.withColumn("measured", F.col(measure).cast("long"))


def compute_median(frame: Frame, metric: Metric) -> DataFrame:
    """Exact median of the measure, by the lead offense where that is the dimension (AG6).

    Only dimension values with a measured row appear; subjects without any have a whole
    window without a median.
    """
    rows = with_measure(population_rows(frame, metric), metric.measure)
    keys = list(KEYS)
    if metric.dimension:
        rows = rows.join(cohorts.lead_categories(frame), ["source_id", "case_id", "person_id"], "left").withColumn("dimension_value", F.coalesce("lead_category", F.lit("unclassified")))
        keys.append("dimension_value")
    grouped = by_period(rows, ANCHORS[metric.population]).groupBy(*keys)
    table = grouped.agg(F.count("measured").alias("denominator"), F.median("measured").alias("median"))
    if metric.dimension:
        table = table.where("denominator > 0")
    else:
        table = with_empty_subjects(frame, table, metric.subjects, {"denominator": F.lit(0)})
    return with_suppression(table, F.col("denominator"), metric.threshold)


COMPUTE = {"count": compute_count, "share": compute_share, "windowed_rate": compute_windowed_rate, "survival": compute_survival, "distribution": compute_distribution, "median": compute_median}
#: Columns of an observation; a kind fills those it has.
OBSERVATION = {
    "slug": "string", "source_id": "string", "subject_type": "string", "subject_id": "string", "calendar_year": "int", "window_days": "int", "dimension_value": "string",
    "numerator": "long", "denominator": "long", "value": "double", "low": "double", "high": "double", "suppressed": "boolean", "suppression_reason": "string",
}
_AS = {"windowed_rate": {"denominator": "followed", "value": "rate"}, "survival": {"numerator": "events", "denominator": "eligible", "value": "incidence"}, "share": {"value": "rate"}, "median": {"value": "median"}}
#: Columns of an observation that a kind has beside the keys.
_HAS = {
    "count": ("numerator",), "share": ("numerator", "denominator", "value", "low", "high", "suppressed", "suppression_reason"),
    "windowed_rate": ("window_days", "numerator", "denominator", "value", "low", "high", "suppressed", "suppression_reason"),
    "survival": ("window_days", "numerator", "denominator", "value", "low", "high", "suppressed", "suppression_reason"),
    "distribution": ("dimension_value", "numerator", "denominator"), "median": ("denominator", "value", "suppressed", "suppression_reason"),
}


def columns_of(metric: Metric) -> dict[str, str]:
    """Columns of an observation that a metric has, with their names in its own table."""
    has = ("subject_type", "subject_id", "calendar_year", *_HAS[metric.kind], *(("dimension_value",) if metric.dimension else ()))
    return {c: _AS.get(metric.kind, {}).get(c, c) for c in has}


def observation(frame: Frame, metric: Metric) -> DataFrame:
    """One metric's rows in the shape of observations."""
    table, names = COMPUTE[metric.kind](frame, metric), {"source_id": "source_id"} | columns_of(metric)
    own = [F.lit(metric.slug).alias("slug")]
    for c, kind in list(OBSERVATION.items())[1:]:
        value = F.col(names[c]) if c in names else F.lit(False) if c == "suppressed" else F.lit(None)
        own.append(value.cast(kind).alias(c))
    return table.select(*own)


def observations(frame: Frame, metrics: list[Metric]) -> DataFrame:
    """All observations of descriptive metrics in one shape (AG11)."""
    return reduce(DataFrame.unionByName, [observation(frame, m) for m in metrics])


#: Jobs that a run gives to Spark at once: one alone leaves cores idle while it is planned and ends.
AT_ONCE = 4
_COHORTS = ("windowed_rate", "survival")


def _used(metric: Metric) -> tuple[str, ...]:
    """Columns of its population's rows that a metric reads beside the subject."""
    m, days = metric, ("disposition_at", "filed_at")
    persons = ("case_id", "person_id") if m.dimension and m.kind == "median" else ("case_id",) if m.population == "defendants" else ()
    return (ANCHORS[m.population], *m.counted, *((m.dimension,) if m.kind == "distribution" else ()), *(days if m.measure == "days_to_disposition" else (m.measure,) if m.measure else ()), *persons)


def shared_rows(frame: Frame, metrics: list[Metric], path: str) -> Frame:
    """The frame with what several metrics read, each written once under ``path``.

    Population rows, with the columns that their metrics read; cohorts with exposure and
    the first of each of their metrics' outcomes; before these, the persons' events.
    """
    spark, derived = frame.sources.sparkSession, dict(frame.derived)

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    families: dict[str, list[Metric]] = {}
    for m in metrics:
        families.setdefault(shared_key(m), []).append(m)
    wanted = tuple(dict.fromkeys(m.outcome for m in metrics if m.kind in _COHORTS))

    def find(own: list[Metric]) -> DataFrame:
        m = own[0]
        if m.kind not in _COHORTS:
            return _population_rows(frame, m).select(*SUBJECT, *dict.fromkeys(c for x in own for c in _used(x)))
        found = outcomes.first_of_each(people.result(), cohorts.cohort(frame, m.population, m.gate, m.subjects), tuple(dict.fromkeys(x.outcome for x in own)))
        return found.drop("member_kind", "member_id", "case_id", "person_id", "deferral_days")

    gates.subjects_of(frame)  # before threads meet in it
    with ThreadPoolExecutor(AT_ONCE) as pool:
        submit = lambda f, *a: pool.submit(inheritable_thread_target(spark)(f), *a)
        people = submit(lambda: kept("people", outcomes.person_events(outcomes.all_justice_events(frame), wanted))) if wanted else None
        late = sorted(families, key=lambda k: families[k][0].kind in _COHORTS)  # these wait for the events
        stored = {k: submit(lambda k=k, i=i: kept(f"rows-{i}", find(families[k]))) for i, k in enumerate(late)}
        return replace(frame, derived=derived | {k: f.result() for k, f in stored.items()})


def run_all(frame: Frame, metrics: list[Metric], path: str) -> DataFrame:
    """The whole engine's run (MS7): each metric's observations written under ``path``, then read as one table.

    Rows that several metrics count are found once, and a few jobs run at once. A metric is a job of its own, so a lost
    executor costs one metric at most; all read the same stored frame.
    """
    shared = shared_rows(frame, metrics, f"{path}-rows")
    write = lambda m: observation(shared, m).drop("slug").write.mode("overwrite").parquet(f"{path}/slug={m.slug}")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(inheritable_thread_target(frame.sources.sparkSession)(write), metrics))
    schema = ", ".join(f"{c} {kind}" for c, kind in OBSERVATION.items() if c != "slug")
    return frame.sources.sparkSession.read.schema(f"{schema}, slug string").parquet(path).select(*OBSERVATION)


def draft_summary(found: DataFrame) -> DataFrame:
    """Observations by slug (AG12)."""
    return found.groupBy("slug").agg(F.count(F.lit(1)).alias("observations"))
