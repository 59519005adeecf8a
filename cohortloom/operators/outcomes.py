"""Outcomes after exposure: derived events, windows, censoring, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.columns import DAY_US, WINDOWS, microseconds, ratio, wilson
from .cohorts import CONVICTIONS

#: Outcomes that count only in another case than the index event's.
OTHER_CASE = ("new_case", "new_charge", "reconviction")
SUBJECT = ("source_id", "subject_type", "subject_id")


def observability(frame: Frame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """Rows (source_id, outcome, scope, observable) for outcomes and revocation scopes (OU1)."""
    asked = frame.sources.sparkSession.createDataFrame(wanted, "outcome string, scope string")
    # A handful of sources and of outcomes: both sides are parameters.
    pairs = frame.sources.crossJoin(F.broadcast(asked))
    seen = F.array_contains("observable_outcomes", F.col("outcome")) & (F.col("scope").isNull() | F.array_contains("revocation_scopes", F.col("scope")))
    return pairs.select("source_id", "outcome", "scope", seen.alias("observable"))


def derived_outcomes(frame: Frame) -> DataFrame:
    """Events that charges imply: new_charge, new_case, reconviction (OU2).

    A new case is at the person's earliest charge of the case. Identifiers name type, case
    and instant, so a repeated event is one event.
    """
    charges = frame.charges.where("person_id IS NOT NULL")
    new_charge = charges.select("source_id", "person_id", F.lit("new_charge").alias("event_type"), F.col("filed_at").alias("event_at"), "case_id")
    new_case = charges.groupBy("source_id", "person_id", "case_id").agg(F.min("filed_at").alias("event_at")).select("source_id", "person_id", F.lit("new_case").alias("event_type"), "event_at", "case_id")
    again = charges.where(F.col("disposition").isin(list(CONVICTIONS)) & F.col("disposed_at").isNotNull()).select("source_id", "person_id", F.lit("reconviction").alias("event_type"), F.col("disposed_at").alias("event_at"), "case_id")
    out = new_charge.unionByName(new_case).unionByName(again).distinct()
    return out.select("source_id", F.concat_ws(":", F.lit("derived"), "event_type", "case_id", iso_instant("event_at")).alias("id"), "person_id", "event_type", "event_at", F.col("case_id").alias("related_case_id"))


def iso_instant(column: str) -> Column:
    """ISO text of an instant, microseconds only where there are any (FN11)."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.unix_micros(F.col(column)) % 1_000_000
    return F.concat(whole, F.when(part != 0, F.date_format(column, ".SSSSSS")).otherwise(F.lit("")), F.lit("+00:00"))


def all_justice_events(frame: Frame) -> DataFrame:
    """Stored events and derived ones (OU3)."""
    stored = frame.justice_events.where(~F.col("event_type").isin(list(OTHER_CASE)))
    return stored.select("source_id", "id", "person_id", "event_type", "event_at", "related_case_id").unionByName(derived_outcomes(frame))


def person_events(events: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Rows (source_id, person_id, seen_<outcome>): a person's events of each wanted type as one sorted array."""
    of = lambda x: F.sort_array(F.collect_list(F.when(F.col("event_type") == x, F.struct("event_at", "related_case_id")))).alias(f"seen_{x}")
    own = events.where(F.col("event_type").isin(list(wanted))).select("source_id", "person_id", "event_type", "event_at", "related_case_id").distinct()
    return own.groupBy("source_id", "person_id").agg(*[of(x) for x in wanted])


def first_of_each(people: DataFrame, cohort: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The cohort with first_<outcome>, the first event of ``person_events`` strictly after exposure starts (OU4).

    For outcomes that need another case, an event without a related case does not count.
    One join serves all outcomes: the cohort keeps its rows and is never regrouped.
    """
    other = lambda x: "e.related_case_id IS NOT NULL AND e.related_case_id <> case_id AND " if x in OTHER_CASE else ""
    first = {f"first_{x}": F.expr(f"array_min(transform(filter(seen_{x}, e -> {other(x)}e.event_at > exposure_start), e -> e.event_at))") for x in wanted}
    own = people.select("source_id", "person_id", *[f"seen_{x}" for x in wanted])
    return cohort.join(own, ["source_id", "person_id"], "left").withColumns(first).drop(*[f"seen_{x}" for x in wanted])


def first_outcomes(events: DataFrame, cohort: DataFrame, outcome: str) -> DataFrame:
    """The cohort with first_outcome_at, the first event strictly after exposure starts (OU4)."""
    found = first_of_each(person_events(events, (outcome,)), cohort, (outcome,))
    return found.withColumnRenamed(f"first_{outcome}", "first_outcome_at")


def with_coverage_end(frame: Frame, cohort: DataFrame) -> DataFrame:
    """The cohort with covered_to, the exclusive right edge of coverage."""
    return cohort.join(F.broadcast(frame.coverage.select("source_id", "covered_to")), "source_id")


def followed(window: Column) -> Column:
    """True if follow-up ends strictly before coverage does (OU6)."""
    return microseconds(F.col("exposure_start"), F.col("covered_to")) > window.cast("long") * F.lit(DAY_US)


def has_outcome(window: Column) -> Column:
    """True if the first outcome is within (start, start + w] (OU5)."""
    return F.coalesce(microseconds(F.col("exposure_start"), F.col("first_outcome_at")) <= window.cast("long") * F.lit(DAY_US), F.lit(False))


def member_windows(cohort: DataFrame, windows=WINDOWS) -> DataFrame:
    """One row per member and window: has_outcome, followed, counted (OU7)."""
    w = F.col("window_days")
    rows = cohort.withColumn("window_days", F.explode(F.array(*[F.lit(x) for x in windows])))
    rows = rows.withColumn("has_outcome", has_outcome(w)).withColumn("followed", followed(w))
    return rows.withColumn("counted", F.col("has_outcome") & F.col("followed"))


def by_period(rows: DataFrame, anchor: str) -> DataFrame:
    """Every row twice: in the whole window (calendar_year null) and in its UTC year (AG9)."""
    return rows.withColumn("calendar_year", F.explode(F.array(F.lit(None).cast("int"), F.year(anchor))))


def fixed_window_rates(cohort: DataFrame, windows=WINDOWS) -> DataFrame:
    """Rates by subject, period and window: eligible, followed, numerator, rate, interval (OU8).

    Members are folded into one row per subject and period before windows become rows.
    """
    keys = [*SUBJECT, "calendar_year"]
    sums = [F.count(F.lit(1)).alias("eligible")]
    for w in windows:
        sums.append(F.sum(followed(F.lit(w)).cast("long")).alias(f"f{w}"))
        sums.append(F.sum((followed(F.lit(w)) & has_outcome(F.lit(w))).cast("long")).alias(f"n{w}"))
    wide = by_period(cohort, "index_at").groupBy(*keys).agg(*sums)
    stack = ", ".join(f"{w}, f{w}, n{w}" for w in windows)
    tall = wide.select(*keys, "eligible", F.expr(f"stack({len(windows)}, {stack}) AS (window_days, followed, numerator)"))
    low, high = wilson(F.col("numerator"), F.col("followed"))
    return tall.withColumn("rate", ratio(F.col("numerator"), F.col("followed"))).withColumn("low", low).withColumn("high", high)


def durations(cohort: DataFrame) -> DataFrame:
    """duration_us to the first outcome or the end of coverage, and whether it is an event (OU11).

    A member whose exposure starts after coverage has a negative duration, which is legal.
    """
    event = F.coalesce(F.col("first_outcome_at") < F.col("covered_to"), F.lit(False))
    end = F.when(event, F.col("first_outcome_at")).otherwise(F.col("covered_to"))
    return cohort.withColumn("event", event).withColumn("duration_us", microseconds(F.col("exposure_start"), end))


def product_limit(durations_: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: curve, an array of (t, survival, sum of d / (n (n - d))) in time order (OU9).

    Members are counted by distinct time first; at-risk counts come from a running sum over
    those times; the product is a left-to-right fold, so floats add up as in a loop.
    """
    times = durations_.groupBy(*keys, "duration_us").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count(F.lit(1)).alias("c"))
    later = Window.partitionBy(*keys).orderBy(F.col("duration_us").desc()).rowsBetween(Window.unboundedPreceding, 0)
    risk = times.withColumn("n", F.sum("c").over(later)).where("d > 0")
    steps = risk.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("duration_us").alias("t"), "d", "n"))).alias("steps"))
    fold = """aggregate(steps, named_struct('s', 1D, 'v', 0D, 'curve', CAST(array() AS array<struct<t:bigint,s:double,v:double>>)),
      (a, x) -> named_struct('s', a.s * (1D - CAST(x.d AS double) / x.n),
                             'v', a.v + if(x.n = x.d, 0D, CAST(x.d AS double) / (CAST(x.n AS double) * (x.n - x.d))),
                             'curve', array_append(a.curve, named_struct('t', x.t, 's', a.s * (1D - CAST(x.d AS double) / x.n),
                                'v', a.v + if(x.n = x.d, 0D, CAST(x.d AS double) / (CAST(x.n AS double) * (x.n - x.d)))))),
      a -> a.curve)"""
    return steps.select(*keys, F.expr(fold).alias("curve"))


def kaplan_meier(cohort: DataFrame, windows=WINDOWS) -> DataFrame:
    """Cumulative incidence by subject, period and window with its error and interval (OU10).

    1 - S(w), Greenwood's standard error (0 once nobody is left), a clipped normal interval,
    events up to w and members censored before w.
    """
    keys = [*SUBJECT, "calendar_year"]
    rows = durations(by_period(cohort, "index_at"))
    curves = product_limit(rows, keys)
    sums = [F.count(F.lit(1)).alias("eligible")]
    for w in windows:
        sums.append(F.sum((F.col("event") & (F.col("duration_us") <= w * DAY_US)).cast("long")).alias(f"e{w}"))
        sums.append(F.sum((~F.col("event") & (F.col("duration_us") < w * DAY_US)).cast("long")).alias(f"c{w}"))
    stack = ", ".join(f"{w}, e{w}, c{w}" for w in windows)
    counts = rows.groupBy(*keys).agg(*sums).select(*keys, "eligible", F.expr(f"stack({len(windows)}, {stack}) AS (window_days, events, censored)"))
    same = [counts[k].eqNullSafe(curves[k]) for k in keys]
    joined = counts.join(curves, same, "left").select(*[counts[k] for k in keys], "eligible", "window_days", "events", "censored", "curve")
    at = F.expr(f"element_at(filter(curve, p -> p.t <= CAST(window_days AS bigint) * {DAY_US}), -1)")
    at = F.when(F.size(F.coalesce(F.expr(f"filter(curve, p -> p.t <= CAST(window_days AS bigint) * {DAY_US})"), F.array())) > 0, at)
    point = joined.withColumn("at", at).drop("curve")
    s, v = F.coalesce(F.col("at.s"), F.lit(1.0)), F.coalesce(F.col("at.v"), F.lit(0.0))
    point = point.withColumn("incidence", 1.0 - s).withColumn("error", s * F.sqrt(v)).drop("at")
    from ..functions.columns import normal_interval

    low, high = normal_interval(F.col("incidence"), F.col("error"))
    return point.withColumn("low", low).withColumn("high", high)


def window_flags(windows=WINDOWS, survival: bool = False) -> tuple[list[Column], list[Column]]:
    """Counted and followed flags of a member in each window, for rates or survival (OU12)."""
    if not survival:
        return [has_outcome(F.lit(w)) & followed(F.lit(w)) for w in windows], [followed(F.lit(w)) for w in windows]
    event = F.coalesce(F.col("first_outcome_at") < F.col("covered_to"), F.lit(False))
    return [event & has_outcome(F.lit(w)) for w in windows], [F.lit(True) for _ in windows]
