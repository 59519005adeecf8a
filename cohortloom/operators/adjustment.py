"""Observed against expected: features, design, penalised logistic fit, pooling, bootstrap.

Features and designs are DataFrame plans. The fit sums gradient and Hessian on the
executors, over distinct design rows with weights, and solves the small system of the
coefficients on the driver. What the driver holds is one row per judge or per coefficient.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame
from . import cohorts, gates, outcomes
from .cohorts import CATEGORIES, CONVICTIONS, FINAL_DISPOSITIONS, SEVERITIES

#: Design features: name, levels with the reference first (None: levels of the data, the
#: commonest first), and whether a missing level excludes the row.
FEATURES: tuple[tuple[str, tuple[str, ...] | None, bool], ...] = (
    ("lead_severity", ("misdemeanor_b", *[s for s in SEVERITIES if s != "misdemeanor_b"]), True),
    ("lead_category", ("public_order", *[c for c in CATEGORIES if c != "public_order"]), True),
    ("charge_count", ("1", "2", "3+"), True),
    ("prior_cases", ("0", "1", "2", "3+", "unrecorded"), False),
    ("prior_convictions", ("0", "1", "2+", "unrecorded"), False),
    ("prior_failures_to_appear", ("0", "1+", "unrecorded"), False),
    ("pending_case", ("false", "true", "unrecorded"), False),
    ("history_truncated", ("false", "true", "unrecorded"), False),
    ("court", None, True),
    ("jurisdiction", None, False),
    ("calendar_year", None, True),
)
#: Fixed value: days of history that a source must cover before an event.
LOOKBACK_DAYS = 1095
#: Replicates of the reference's intervals.
REPLICATES = 500
KEY = ["source_id", "member_id"]


def availability(frame: Frame, targets: list[tuple[str, str, str | None]]) -> DataFrame:
    """Rows (source_id, target, reason): the first reason a target has no model, or null (AD1)."""
    asked = frame.sources.sparkSession.createDataFrame(targets, "target string, gate string, outcome string")
    rows = frame.sources.crossJoin(F.broadcast(asked))  # a few sources, three targets
    reason = (
        F.when(~F.array_contains("judge_gates", F.col("gate")), F.lit("judge_gate")).when(F.col("outcome").isNotNull() & ~F.array_contains("observable_outcomes", F.col("outcome")), F.lit("outcome"))
        .when(F.coalesce("person_key_scope", F.lit("")) != "cross_case", F.lit("person_key"))
    )
    return rows.select("source_id", "target", reason.alias("reason"))


def decision_events(frame: Frame) -> DataFrame:
    """Judges' own pretrial decisions with a known flag; outcome: released (AD2, LD9)."""
    rows = gates.pretrial_decisions(frame, actors=("judge",), discretion=("discretionary",), subjects=("judge",)).where("detained_flag IS NOT NULL")
    return rows.select("source_id", F.col("id").alias("member_id"), F.col("subject_id").alias("judge_id"), "case_id", "person_id", F.col("decision_at").alias("index_at"), "decision_at", (~F.col("detained_flag")).cast("int").alias("outcome"))


def release_events(frame: Frame, outcome: str, window: int) -> DataFrame:
    """Released members followed for a window; outcome: it happened (AD3)."""
    found = outcomes.with_coverage_end(frame, outcomes.first_outcomes(outcomes.all_justice_events(frame), cohorts.cohort(frame, "release", "deciding_judge", ("judge",)), outcome))
    at = cohorts.released(frame.decisions).where("decision_type = 'pretrial_release'").select("source_id", F.col("id").alias("member_id"), "decision_at")
    rows = found.where(outcomes.followed(F.lit(window))).join(at, KEY)
    return rows.select("source_id", "member_id", F.col("subject_id").alias("judge_id"), "case_id", "person_id", "index_at", "decision_at", outcomes.has_outcome(F.lit(window)).cast("int").alias("outcome"))


def band(count, top: int):
    """Count as text, the highest band open (AD9)."""
    return F.when(count >= top, F.lit(f"{top}+")).otherwise(count.cast("string"))


def index_charges(frame: Frame, events: DataFrame) -> DataFrame:
    """The person's charges of the index case filed before the decision (AD4, JO7)."""
    own = frame.charges_of(events).select("source_id", "case_id", "person_id", F.col("id").alias("charge_id"), "filed_at", "severity", "offense_category", "source_row_id")
    return events.select(*KEY, "case_id", "person_id", "decision_at").join(own, ["source_id", "case_id", "person_id"]).where("filed_at < decision_at")


def lead_features(frame: Frame, events: DataFrame, single: bool = False) -> DataFrame:
    """lead_severity, lead_category and charge_count of each event (AD4, LD4).

    With ``single`` members (``single_members``) are folded where they met their charges, without another shuffle.
    """
    keys = [*KEY, "case_id", "person_id"] if single else KEY
    order = F.struct(cohorts.rank_in("severity", SEVERITIES), F.col("source_row_id").isNull(), "source_row_id", "charge_id")
    found = index_charges(frame, events).groupBy(*keys).agg(F.min_by(F.struct("severity", "offense_category"), order).alias("lead"), F.count_distinct("charge_id").alias("n"))
    return found.select(*KEY, F.col("lead.severity").alias("lead_severity"), F.col("lead.offense_category").alias("lead_category"), band(F.col("n"), 3).alias("charge_count"))


def single_members(events: DataFrame) -> bool:
    """True if no member has events of several cases or persons."""
    own = F.struct("case_id", "person_id")
    return events.groupBy(*KEY).agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a < b").isEmpty()


def with_cases(frame: Frame, events: DataFrame) -> DataFrame:
    """Events with case_filed and court_id of their index case, stored: every feature starts from them."""
    from .graph import cut_lineage

    cases = frame.cases.select("source_id", F.col("id").alias("case_id"), F.col("filed_at").alias("case_filed"), "court_id")
    return cut_lineage(events.join(cases, ["source_id", "case_id"]))


def history_features(frame: Frame, events: DataFrame, single: bool | None = None) -> DataFrame:
    """Rows (source_id, member_id, cases, convictions, pending) as of the index case's filing (AD5, AD7), of events ``with_cases``.

    Charges of a case filed at one instant are one row before they meet events: whether
    such a charge was disposed of by then, or after, shows in the first and the last date.
    """
    cases = frame.cases.select("source_id", F.col("id").alias("other"), F.col("filed_at").alias("other_filed"))
    when = lambda values, f: f(F.when(F.col("disposition").isin(list(values)), F.col("disposed_at")))
    charged = frame.charges.where("person_id IS NOT NULL").groupBy("source_id", "person_id", F.col("case_id").alias("other"), "filed_at").agg(
        when(CONVICTIONS, F.min).alias("convicted_at"), when(FINAL_DISPOSITIONS, F.min).alias("first_final"), when(FINAL_DISPOSITIONS, F.max).alias("last_final")
    )
    linked = charged.join(cases, ["source_id", "other"])
    both = events.select(*KEY, "case_id", "person_id", "case_filed").join(linked, ["source_id", "person_id"]).where((F.col("other") != F.col("case_id")) & (F.col("other_filed") < F.col("case_filed")))
    known = F.col("filed_at") < F.col("case_filed")
    # A member of one person alone is counted where the person's rows are, without another shuffle.
    single = single_members(events) if single is None else single
    keys = [*KEY, "person_id"] if single else KEY
    per_case = both.groupBy(*keys, "other").agg(
        F.bool_or(known & (F.col("convicted_at") < F.col("case_filed"))).alias("convicted"),
        F.bool_or(known & (F.col("last_final") >= F.col("case_filed"))).alias("open_then"),
        F.bool_or(known & (F.col("first_final") < F.col("case_filed"))).alias("disposed_before"),
    )
    pending = F.coalesce("open_then", F.lit(False)) | ~F.coalesce("disposed_before", F.lit(False))
    counts = per_case.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.coalesce("convicted", F.lit(False))).alias("convictions"), F.bool_or(pending).alias("pending"))
    return counts.select(*KEY, "cases", "convictions", "pending")


def failure_features(frame: Frame, events: DataFrame) -> DataFrame:
    """Rows (source_id, member_id, failures) before the filing (AD6), of events ``with_cases``."""
    seen = frame.justice_events.where("event_type = 'failure_to_appear'").select("source_id", "person_id", "event_at")
    base = events.select(*KEY, "person_id", "case_filed").distinct()
    return base.join(seen, ["source_id", "person_id"]).where("event_at < case_filed").groupBy(*KEY).agg(F.count(F.lit(1)).alias("failures"))


def place_features(frame: Frame, events: DataFrame) -> DataFrame:
    """Events ``with_cases`` with history_truncated, court, jurisdiction and calendar_year (AD8)."""
    courts = frame.courts.select("source_id", F.col("id").alias("court_id"), F.col("jurisdiction_id").alias("jurisdiction"))
    rows = events.join(courts, ["source_id", "court_id"], "left").join(F.broadcast(frame.coverage.select("source_id", "covered_from")), "source_id")
    short = F.col("case_filed") < F.col("covered_from") + F.make_dt_interval(F.lit(LOOKBACK_DAYS))
    return rows.withColumn("history_truncated", short.cast("string")).withColumnRenamed("court_id", "court").withColumn("calendar_year", F.year("index_at").cast("string")).drop("covered_from")


def feature_levels(frame: Frame, events: DataFrame) -> DataFrame:
    """Events with a level for every feature; rows that lack a needed one go (AD10, AD30).

    Bands of history are null where the filing is; an event without a case has no court and goes.
    """
    events = with_cases(frame, events)
    out, single = place_features(frame, events), single_members(events)
    for part in (lead_features(frame, events, single), history_features(frame, events, single), failure_features(frame, events)):
        out = out.join(part, KEY, "left")
    count = lambda n, top: F.when(F.col("case_filed").isNotNull(), band(F.coalesce(F.col(n), F.lit(0)), top))
    out = out.withColumns(
        {
            "prior_cases": count("cases", 3), "prior_convictions": count("convictions", 2), "prior_failures_to_appear": count("failures", 1),
            "pending_case": F.when(F.col("case_filed").isNotNull(), F.coalesce("pending", F.lit(False)).cast("string")),
        }
    ).drop("cases", "convictions", "pending", "failures", "case_filed")
    for name, _, excludes in FEATURES:
        out = out.where(F.col(name).isNotNull()) if excludes else out.withColumn(name, F.coalesce(name, F.lit("unrecorded")))
    return out


def data_encoding(levels: DataFrame, feature: str) -> DataFrame:
    """Rows (level, label): levels by falling number of events, then by level (AD11).

    Levels are courts, jurisdictions or years: a short list, which joins broadcast.
    """
    counts = levels.groupBy(F.col(feature).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("level", F.row_number().over(Window.orderBy(F.desc("n"), "level")).cast("string").alias("label"))


@dataclass
class Design:
    """Distinct design rows with weights, and what the columns mean."""

    rows: DataFrame
    columns: list[str]
    labels: dict[str, dict[str, str]]

    def vector(self):
        """Column: the dense design row of levels."""
        parts = [F.lit(1.0)]
        for c in self.columns[1:]:
            name, _, level = c.partition("=")
            parts.append((F.col(name) == level).cast("double"))
        return F.array(*parts)


def design(levels: DataFrame) -> Design:
    """Intercept and one column per observed level but the reference (AD12, AD13).

    Levels come from one pass that counts them; a reference nobody has is replaced by none.
    """
    labels: dict[str, dict[str, str]] = {}
    out = levels
    for name, fixed, _ in FEATURES:
        if fixed is None:
            code = data_encoding(levels, name)
            labels[name] = {r.level: r.label for r in code.collect()}  # courts, jurisdictions, years
            out = out.join(F.broadcast(code.select(F.col("level").alias(name), F.col("label").alias("own_label"))), name).drop(name).withColumnRenamed("own_label", name)
    names = [n for n, _, _ in FEATURES]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names])).alias("p")
    seen = {(r.f, r.v) for r in out.select(pairs).select("p.f", "p.v").distinct().collect()}  # features x levels
    columns = ["intercept"]
    for name, fixed, _ in FEATURES:
        order = list(fixed) if fixed else [str(i + 1) for i in range(len(labels[name]))]
        columns += [f"{name}={v}" for v in order[1:] if (name, v) in seen]
    return Design(out, columns, labels)


def patterns(d: Design, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (x, n, y): distinct design rows with their events and positive outcomes."""
    names = [n for n, _, _ in FEATURES]
    folded = d.rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("outcome").cast("double").alias("y"))
    return folded.select(*keys, d.vector().alias("x"), "n", "y")


def expit(eta: np.ndarray) -> np.ndarray:
    """Logistic function that does not overflow (AD15)."""
    small = np.exp(-np.abs(eta))
    return np.where(eta >= 0, 1.0, small) / (1.0 + small)


def _partials(beta: np.ndarray):
    """Objective, gradient and Hessian of a task's rows, as one row of doubles."""
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n, y = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            eta = x @ beta
            p = expit(eta)
            total[0] += (y * eta - n * np.logaddexp(0, eta)).sum()
            total[1 : 1 + k] += x.T @ (y - n * p)
            total[1 + k :] += ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    return run


@dataclass
class Fit:
    """Coefficients and how they were reached."""

    coefficients: np.ndarray
    iterations: int
    gradient_norm: float
    converged: bool
    objective: float


def fit_logistic(rows: DataFrame, width: int, lam: float = 1.0, most: int = 50, tolerance: float = 1e-8, halvings: int = 30, start: np.ndarray | None = None) -> Fit:
    """Penalised maximum likelihood by Newton steps; the intercept is free (AD14).

    Each step is one pass over rows (x, n, y) that returns 1 + k + k^2 sums.
    """
    free = np.ones(width)
    free[0] = 0.0

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = rows.select("x", "n", "y").mapInArrow(_partials(beta), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(1 + width + width * width)
        for r in found:
            v[r.i] = r.v
        penalty = lam * free * beta
        return v[0] - 0.5 * float(penalty @ beta), v[1 : 1 + width] - penalty, v[1 + width :].reshape(width, width) + np.diag(lam * free)

    beta = np.zeros(width) if start is None else np.array(start, dtype=float)
    value, gradient, hessian = sums(beta)
    steps = 0
    while np.abs(gradient).max() >= tolerance and steps < most:
        try:
            np.linalg.cholesky(hessian)
            move = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError:
            break
        size = 1.0
        for _ in range(halvings + 1):
            after = sums(beta + size * move)
            if np.isfinite(after[0]) and after[0] >= value - 1e-12 * max(1.0, abs(value)):
                break
            size /= 2
        else:
            break
        beta, (value, gradient, hessian), steps = beta + size * move, after, steps + 1
    norm = float(np.abs(gradient).max())
    return Fit(beta, steps, norm, norm < tolerance, value)


def fit_status(events: int, rows: int, width: int, fit: Fit | None, least: int = 5) -> str:
    """fitted, insufficient_events or not_converged (AD23)."""
    if min(events, rows - events) < least * width:
        return "insufficient_events"
    return "fitted" if fit is not None and fit.converged else "not_converged"


def scored(d: Design, coefficients: np.ndarray) -> DataFrame:
    """Events with the predicted chance (AD15, AD16)."""
    eta = reduce(lambda a, b: a + b, [F.lit(float(coefficients[0])), *[F.when(F.col(c.partition("=")[0]) == c.partition("=")[2], F.lit(float(b))).otherwise(F.lit(0.0)) for c, b in zip(d.columns[1:], coefficients[1:])]])
    return d.rows.withColumn("predicted", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))


def expectations(scores: DataFrame) -> DataFrame:
    """Members, observed and expected outcomes of each judge (AD16)."""
    return scores.groupBy("source_id", "judge_id").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("observed"), F.sum("predicted").alias("expected"))


def marginal_log_likelihood(shape: float, observed: np.ndarray, expected: np.ndarray) -> float:
    """Log-likelihood of counts under a gamma mixture of Poissons (AD18)."""
    counts, at = np.unique(observed, return_inverse=True)
    return _log_likelihood(shape, counts, at, observed, expected)


def _log_likelihood(shape: float, counts: np.ndarray, at: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> float:
    """The log-likelihood, given the distinct counts and each judge's place among them."""
    start = math.lgamma(shape)
    rising = np.array([math.lgamma(shape + o) - start - math.lgamma(o + 1) for o in counts.tolist()])[at]
    return float((rising + shape * np.log(shape / (shape + expected)) + observed * np.log(expected / (shape + expected))).sum())


def _likelihood_of_shapes(observed: np.ndarray, expected: np.ndarray, block: int = 16) -> Callable[[float], float]:
    """The log-likelihood as a function of the shape alone.

    Judges of one count share a weight, so they stand in blocks whose factors 1 + E / shape
    are multiplied before one logarithm is taken. A block's product stays finite up to
    expected counts of 1e18; a block's empty places have the factor 1.
    """
    counts, place, own = np.unique(observed, return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    blocks = -(-own // block)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(own) - own, own)
    first = np.repeat(np.cumsum(blocks) - blocks, own)
    held, logs = np.zeros((block, int(blocks.sum()))), np.zeros((block, int(blocks.sum())))
    to = (rank % block, first + rank // block)
    held[to] = expected[order]
    logs[to] = np.log(held[to])
    logs, members = logs.sum(axis=0), (held > 0).sum(axis=0)
    weight, factors = np.repeat(counts, blocks), np.empty_like(held)
    fixed = [math.lgamma(o + 1) for o in counts.tolist()]

    def at(shape: float) -> float:
        np.multiply(held, 1.0 / shape, out=factors)
        np.add(factors, 1.0, out=factors)
        product = np.log(np.multiply.reduce(factors, axis=0))
        start = math.lgamma(shape)
        rising = own @ np.array([math.lgamma(shape + o) - start - f for o, f in zip(counts.tolist(), fixed)])
        return float(rising + (weight * (logs - members * math.log(shape) - product) - shape * product).sum())

    return at


def fit_shape(observed: np.ndarray, expected: np.ndarray, bounds: tuple[float, float] = (0.5, 1000.0), grid: int = 200) -> float:
    """The likeliest shape: a grid in logarithms, then golden section around its best point (AD17)."""
    use = expected > 0
    o, e = observed[use], expected[use]
    if not len(o):
        raise ValueError("no judge has a positive expected count")
    logs = np.linspace(math.log(bounds[0]), math.log(bounds[1]), grid)
    likelihood = _likelihood_of_shapes(o, e)
    at = lambda x: likelihood(min(max(math.exp(x), bounds[0]), bounds[1]))
    values = [at(x) for x in logs]
    best = int(np.argmax(values))
    low, high = logs[max(best - 1, 0)], logs[min(best + 1, grid - 1)]
    golden = (math.sqrt(5) - 1) / 2
    while high - low > 1e-10:
        c, d = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, d) if at(c) >= at(d) else (c, high)
    x = (low + high) / 2
    x = x if at(x) > values[best] else logs[best]
    return min(max(math.exp(x), bounds[0]), bounds[1])


def pooled(table: DataFrame, shape: float) -> DataFrame:
    """Pooled ratio (a + O) / (a + E) and the weight of the judge's own figures E / (E + a) (AD19)."""
    a = F.lit(float(shape))
    return table.withColumn("ratio", (a + F.col("observed")) / (a + F.col("expected"))).withColumn("weight", F.col("expected") / (F.col("expected") + a))


def replicate_weights(clusters: list[str], seed: int, stream: str, count: int) -> Iterator[dict[str, int]]:
    """How often each cluster is drawn in each replicate (AD20).

    Draws come from a Mersenne stream seeded by the SHA-256 of "seed:stream", one number per
    draw, over the sorted distinct clusters.
    """
    keys = sorted(set(clusters))
    source = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{stream}".encode()).digest(), "big"))
    for _ in range(count):
        drawn: dict[str, int] = {}
        for _ in keys:
            k = keys[int(source.random() * len(keys))]
            drawn[k] = drawn.get(k, 0) + 1
        yield drawn


def _draws(seed: int, stream: str, people: int, count: int) -> Iterator[np.ndarray]:
    """Draws per place of the sorted clusters in each replicate: those of ``replicate_weights``.

    NumPy continues the same Mersenne state, so tasks make the weights themselves; a task
    holds 16 bytes a person.
    """
    state = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{stream}".encode()).digest(), "big")).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    draw, places, some = np.random.Generator(source).random, np.empty(people, dtype=np.intp), np.empty(1 << 13)
    for _ in range(count):
        for i in range(0, people, len(some)):
            part = places[i : i + len(some)]
            drawn = draw(out=some[: len(part)])
            drawn *= people
            part[:] = drawn
        yield np.bincount(places, minlength=people)


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with the place of their person among the sorted distinct ones, and how many these are.

    Persons are numbered range by range, and each range after all those before it.
    """
    from .graph import cut_lineage

    people = rows.select("person_id").where("person_id IS NOT NULL").distinct()
    cores = people.sparkSession.sparkContext.defaultParallelism
    people = cut_lineage(people.repartitionByRange(cores, "person_id").select("person_id", F.spark_partition_id().alias("part")))
    sizes = {r.part: r["count"] for r in people.groupBy("part").count().collect()}  # one row per range
    before, n = {}, 0
    for part in sorted(sizes):
        before[part], n = n, n + sizes[part]
    if not n:
        return rows.withColumn("place", F.lit(None).cast("int")).where("false"), 0
    base = F.create_map(*[F.lit(int(x)) for pair in before.items() for x in pair])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy("person_id")) - 1 + base
    return rows.join(people.select("person_id", place.cast("int").alias("place")), "person_id"), n


def _in_tasks(rows: DataFrame, *by: str, most: int = 1_000_000, least: int = 20_000) -> DataFrame:
    """The rows in tasks of ranges of columns, as few as keep the cores busy: each makes all weights.

    Ranges end with the place of a person, so no key, however common, is one task's alone.
    """
    from .graph import cut_lineage

    rows = cut_lineage(rows)
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores * -(-n // (most * cores)) if n > cores * least else -(-n // least)
    return cut_lineage(rows.repartitionByRange(max(1, tasks), *by, "place"))


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _active(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of design columns that are 1, and each row's place among them; ``width`` stands for none."""
    x = part["active"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
    return _places(np.where(x < 0, width, x))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of integers, and each row's place among them."""
    x = np.ascontiguousarray(x.astype(np.int32))
    _, first, at = np.unique(x.view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return x[first].astype(np.int64), at.ravel()


class _Halves:
    """Design rows (columns that are 1, ``width`` for none) as a left and a right half.

    Halves have far fewer distinct rows than the whole, so a value of every row is folded to
    the halves, and to each left column beside the right half, before columns and pairs of
    columns are summed.
    """

    def __init__(self, x: np.ndarray, width: int, pairs: bool = True) -> None:
        self.width, cut = width, x.shape[1] // 2
        self.left, self.at_left = _places(x[:, :cut])
        self.right, self.at_right = _places(x[:, cut:])
        if not pairs:
            return
        self.folds, index, source, base = [], [], [], 0
        for place, a, b in self._parts(x[:, :cut]):
            n = len(a)
            self.folds.append((place, n))
            index.append((np.minimum(a, b) * (width + 1) + np.maximum(a, b)).ravel())
            source.append(np.repeat(np.arange(base, base + n), a.shape[1]))
            base += n
        self.index, self.source = np.concatenate(index), np.concatenate(source)
        self.columns = np.concatenate([self.left.ravel(), self.right.ravel()])
        self.of_column = np.concatenate([np.repeat(np.arange(len(h)) + start, h.shape[1]) for h, start in ((self.left, 0), (self.right, len(self.left)))])

    def _parts(self, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the rows in a fold, and the columns of each pair that the fold sums."""
        for half, at in ((self.left, self.at_left), (self.right, self.at_right)):
            low, high = np.triu_indices(half.shape[1])
            yield at, half[:, low], half[:, high]
        for i in range(left.shape[1]):
            both, at = np.unique(left[:, i].astype(np.int64) * len(self.right) + self.at_right, return_inverse=True)
            b = self.right[both % len(self.right)]
            yield at.ravel(), np.repeat((both // len(self.right))[:, None], b.shape[1], axis=1), b

    def eta(self, beta: np.ndarray) -> np.ndarray:
        """Linear predictor of each row."""
        b = np.append(beta, 0.0)
        return b[self.left].sum(axis=1)[self.at_left] + b[self.right].sum(axis=1)[self.at_right]

    def by_column(self, value: np.ndarray) -> np.ndarray:
        """Sums of a value over the rows in which each column is 1."""
        folded = np.concatenate([np.bincount(self.at_left, value, len(self.left)), np.bincount(self.at_right, value, len(self.right))])
        return np.bincount(self.columns, folded[self.of_column], self.width + 1)[: self.width]

    def by_pair(self, value: np.ndarray) -> np.ndarray:
        """Sums of a value over the rows in which both of two columns are 1; a column is active for one feature alone, so no pair counts twice."""
        k = self.width
        folded = np.concatenate([np.bincount(at, value, n) for at, n in self.folds])
        h = np.bincount(self.index, folded[self.source], (k + 1) ** 2).reshape(k + 1, k + 1)[:k, :k]
        return h + np.triu(h, 1).T


def _judge_sums(rows: DataFrame, draws: tuple[int, str, int, int], betas: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Rows (judge_id, drawn, observed, expected): arrays with a value for each replicate, in their order.

    Of rows (place, judge_id, outcome) and ``predicted`` or ``active`` in ranges of judges;
    only the judges at a range's ends meet in other ranges.
    """
    kind, kept = rows.schema["judge_id"].dataType.simpleString(), sorted(range(draws[3]) if betas is None else betas)
    shape = f"judge_id {kind}, whole boolean, drawn array<long>, observed array<long>, expected array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _held(batches)
        if part is None:
            return
        place, y = part["place"].to_numpy(), part["outcome"].to_numpy().astype(float)
        judges = part["judge_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, m = judges.indices.to_numpy(zero_copy_only=False), len(judges.dictionary)
        if betas is not None:
            width = len(next(iter(betas.values()), ()))
            x, at = _active(part, width)
            halves = _Halves(x, width, pairs=False)
        drawn, observed, expected = (np.zeros((m, len(kept)), dtype=t) for t in (np.int64, np.int64, float))
        wanted = {r: i for i, r in enumerate(kept)}
        for r, times in enumerate(_draws(*draws)):
            if r not in wanted:
                continue
            w, i = times[place].astype(float), wanted[r]
            p = part["predicted"].to_numpy() if betas is None else expit(halves.eta(betas[r]))[at]
            drawn[:, i], observed[:, i], expected[:, i] = np.bincount(code, w, m), np.bincount(code, w * y, m), np.bincount(code, w * p, m)
        value = judges.dictionary.to_pylist()
        ends = {min(value, key=lambda v: (v is not None, v)), max(value, key=lambda v: (v is not None, v))} if m else set()
        for i in range(0, m, 1000):
            own, size = value[i : i + 1000], len(kept)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * size), pa.array(a[i : i + 1000].ravel())) for a in (drawn, observed, expected)]
            yield pa.RecordBatch.from_arrays([judges.dictionary[i : i + 1000], pa.array([v not in ends for v in own]), *lists], names=["judge_id", "whole", "drawn", "observed", "expected"])

    from .graph import cut_lineage

    found = cut_lineage(rows.mapInArrow(run, shape))
    add = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(kept) - 1)), lambda i: F.aggregate(f"all_{c}", F.lit(0).cast("double" if c == "expected" else "long"), lambda a, v: a + v[i])).alias(c)
    names = ("drawn", "observed", "expected")
    if not kept:
        return found.select("judge_id", *names)
    met = found.where("NOT whole").groupBy("judge_id").agg(*[F.collect_list(c).alias(f"all_{c}") for c in names])
    return found.where("whole").select("judge_id", *names).union(met.select("judge_id", *[add(c) for c in names]))


def _flat(sums: DataFrame, kept: list[int]) -> DataFrame:
    """Rows (replicate, judge_id, observed, expected) of the replicates in which the judge has events."""
    tall = sums.select("judge_id", F.inline(F.arrays_zip(F.array(*[F.lit(r) for r in kept]).alias("replicate"), "drawn", "observed", "expected")))
    return tall.toDF("judge_id", "replicate", "drawn", "observed", "expected").where("drawn > 0").select("replicate", "judge_id", "observed", "expected")


def _intervals(sums: DataFrame, judges: DataFrame, level: float, replicates: int) -> DataFrame:
    """Percentile interval of each judge's pooled ratio; a judge without events in a replicate has ratio 1."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _held(batches)
        if part is None:
            return
        n = part.num_rows
        o, e, there = (part[c].combine_chunks().flatten().to_numpy().reshape(n, replicates) for c in ("observed", "expected", "drawn"))
        for i in range(replicates):
            on = there[:, i] > 0
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([o[on, i].astype(float).tobytes()], pa.binary()), pa.array([e[on, i].tobytes()], pa.binary())], names=["i", "o", "e"])

    def shape(key: tuple, group: pa.Table) -> pa.Table:
        o, e = (np.concatenate([np.frombuffer(b) for b in group[c].to_pylist()]) for c in ("o", "e"))
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "shape": pa.array([fit_shape(o, e)])})

    every = judges.select("judge_id").distinct()
    one = F.lit(1.0)
    if not replicates:
        return every.select("judge_id", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("replicates")).where("false")
    tasks = max(1, min(replicates, sums.sparkSession.sparkContext.defaultParallelism * 4))
    shapes = sums.mapInArrow(turn, "i int, o binary, e binary").repartition(tasks, "i").groupBy("i").applyInArrow(shape, "i int, shape double").collect()  # one row per replicate
    a = np.array([r.shape for r in sorted(shapes, key=lambda r: r.i)])
    tail = (1 - level) / 2
    kind = sums.schema["judge_id"].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            o, e = (b.column(c).flatten().to_numpy().reshape(b.num_rows, replicates) for c in ("observed", "expected"))
            q = np.sort((a + o) / (a + e), axis=1)
            found = []
            for share in (tail, 1 - tail):
                at = share * (replicates - 1)
                lo, hi = math.floor(at), math.ceil(at)
                found.append(pa.array(q[:, lo] if lo == hi else (hi - at) * q[:, lo] + (at - lo) * q[:, hi]))
            yield pa.RecordBatch.from_arrays([b.column("judge_id"), *found], names=["judge_id", "low", "high"])

    known = sums.mapInArrow(ends, f"judge_id {kind}, low double, high double")
    return every.join(known, "judge_id", "left").select("judge_id", F.coalesce("low", one).alias("low"), F.coalesce("high", one).alias("high"), F.lit(replicates).cast("long").alias("replicates"))


def bootstrap_intervals(scores: DataFrame, seed: int, stream: str, count: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of each judge's pooled ratio over replicates of persons (AD21).

    Tasks make the weights of all persons from the state of the one stream; nothing per
    person is on the driver.
    """
    from .graph import cut_lineage

    rows, people = _placed(scores.select("person_id", "judge_id", "outcome", F.col("predicted").cast("double").alias("predicted")))
    rows = _in_tasks(rows.select("place", "judge_id", "outcome", "predicted"), "judge_id")
    return _intervals(cut_lineage(_judge_sums(rows, (seed, stream, people, count))), rows, level, count)


def _folded(rows: DataFrame, draws: tuple[int, str, int, int], width: int) -> DataFrame:
    """Rows (design, replicate, n, y): of each task, its distinct design rows, then their weights in each replicate.

    Weights do not change with the coefficients: they are drawn and folded once and stored,
    compressed, in as few bytes as hold them, and every pass reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _held(batches)
        if part is None:
            return
        x, at = _active(part, width)
        order = np.argsort(at, kind="stable")
        place, at = part["place"].to_numpy()[order], at[order]
        positive = part["outcome"].to_numpy()[order] == 1
        starts, m = np.searchsorted(at, np.arange(len(x))), len(x)
        of = lambda *v: pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(v, (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], names=["design", "replicate", "n", "y"])
        yield of(_packed(x.ravel()), None, None, None)
        for r, drawn in enumerate(_draws(*draws)):
            w = drawn[place]
            yield of(None, r, _packed(np.add.reduceat(w, starts)), _packed(np.bincount(at[positive], w[positive], m).astype(np.int64)))

    from .graph import cut_lineage

    return cut_lineage(rows.mapInArrow(run, "design binary, replicate int, n binary, y binary"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as hold them: a byte for that size, one long of the bytes' number, then these compressed."""
    small = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([small.itemsize]) + small.nbytes.to_bytes(8, "little") + pa.compress(small.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``_packed``."""
    return np.frombuffer(pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), codec="zstd"), dtype=f"u{data[0]}")


def _newton(folded: DataFrame, betas: dict[int, np.ndarray], lam: float) -> dict[int, tuple[float, float, np.ndarray | None]]:
    """Objective, gradient norm and Newton step (None where singular) of each replicate at its coefficients.

    Of rows ``_folded``: tasks fold their design rows to halves and add up 1 + k + k^2 sums a
    replicate; these are added and solved on the executors.
    """
    k = len(next(iter(betas.values())))
    free = np.ones(k)
    free[0] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = None
        for b in batches:
            for design, r, n, s in zip(*(b.column(c) for c in ("design", "replicate", "n", "y"))):
                if design.is_valid:
                    halves = _Halves(_unpacked(design.as_py()).astype(np.int64).reshape(-1, len(FEATURES) + 1), k)
                    continue
                r = r.as_py()
                if r not in betas:
                    continue
                n, s = (_unpacked(v.as_py()).astype(float) for v in (n, s))
                eta = halves.eta(betas[r])
                small = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
                soft = np.maximum(eta, 0.0) + np.log1p(small)
                total = np.concatenate([[(s * eta - n * soft).sum()], halves.by_column(s - n * p), halves.by_pair(n * p * (1 - p)).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["replicate", "sums"])

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        r = key[0].as_py()
        v = sum(np.frombuffer(s) for s in group["sums"].to_pylist())
        penalty = lam * free * betas[r]
        gradient, hessian = v[1 : 1 + k] - penalty, v[1 + k :].reshape(k, k) + np.diag(lam * free)
        try:
            np.linalg.cholesky(hessian)
            move = np.linalg.solve(hessian, gradient).tobytes()
        except np.linalg.LinAlgError:
            move = None
        return pa.table({"replicate": pa.array([r], pa.int32()), "value": pa.array([v[0] - 0.5 * float(penalty @ betas[r])]), "norm": pa.array([float(np.abs(gradient).max())]), "move": pa.array([move], pa.binary())})

    found = folded.mapInArrow(run, "replicate int, sums binary").groupBy("replicate").applyInArrow(solve, "replicate int, value double, norm double, move binary")
    return {r.replicate: (r.value, r.norm, None if r.move is None else np.frombuffer(bytes(r.move))) for r in found.collect()}


def _refits(rows: DataFrame, draws: tuple[int, str, int, int], start: np.ndarray, lam: float, most: int = 50, tolerance: float = 1e-8, halvings: int = 30) -> dict[int, np.ndarray]:
    """Coefficients of the replicates that converge: the steps of ``fit_logistic``, all replicates a pass."""
    beta = {r: np.array(start, dtype=float) for r in range(draws[3])}
    rows = _folded(rows, draws, len(start))
    state = _newton(rows, beta, lam)
    size, steps, done = dict.fromkeys(beta, 1.0), dict.fromkeys(beta, 0), {}
    going = set(state)
    while True:
        for r in list(going):
            if state[r][1] < tolerance:
                done[r] = beta[r]
            if r in done or state[r][2] is None or steps[r] >= most or size[r] < 2.0**-halvings:
                going.discard(r)
        if not going:
            return done
        tried = {r: beta[r] + size[r] * state[r][2] for r in going}
        for r, after in _newton(rows, tried, lam).items():
            if np.isfinite(after[0]) and after[0] >= state[r][0] - 1e-12 * max(1.0, abs(state[r][0])):
                beta[r], state[r], size[r], steps[r] = tried[r], after, 1.0, steps[r] + 1
            else:
                size[r] /= 2


def _refit_rows(d: Design) -> tuple[DataFrame, int]:
    """Rows (place, judge_id, outcome, active) of a design; active: its columns that are 1, -1 for none."""
    parts = [F.lit(0)]
    for name, _, _ in FEATURES:
        part = F.lit(-1)
        for i, c in enumerate(d.columns):
            if c.partition("=")[0] == name:
                part = F.when(F.col(name) == c.partition("=")[2], F.lit(i)).otherwise(part)
        parts.append(part)
    rows, people = _placed(d.rows)
    return rows.select("place", "judge_id", "outcome", F.array(*parts).alias("active")), people


def _refitted(d: Design, published: Fit, seed: int, stream: str, count: int, lam: float = 1.0) -> tuple[DataFrame, list[int]]:
    """``_judge_sums`` with the model fitted again in every replicate, and the replicates that converge."""
    rows, people = _refit_rows(d)
    draws = (seed, stream, people, count)
    betas = _refits(_in_tasks(rows, "active"), draws, published.coefficients, lam)
    return _judge_sums(_in_tasks(rows, "judge_id"), draws, betas), sorted(betas)


def refitted_sums(d: Design, published: Fit, seed: int, stream: str, count: int, lam: float = 1.0) -> DataFrame:
    """Rows (replicate, judge_id, observed, expected) with the model fitted again in every replicate (AD20, AD21).

    A replicate weighs each person's events by how often the person was drawn; its fit
    starts from the published coefficients. Replicates that do not converge are left out.
    """
    return _flat(*_refitted(d, published, seed, stream, count, lam))


def fit_missing(frame: Frame, wanted: list[tuple[str, int | None]], known: DataFrame | None = None, lam: float = 1.0) -> list[dict]:
    """Catalogue entries of the models that are not known yet (AD23, AD28, MS16-MS18).

    Each holds its status, coefficients at twelve significant digits and the hash of these.
    """
    from ..sources.files import significant
    from .graph import cut_lineage

    have = set() if known is None else {(r.target, r.window_days) for r in known.select("target", "window_days").collect()}
    out = []
    for target, window in wanted:
        if (target, window) in have:
            continue
        events = decision_events(frame) if target == "pretrial_release" else release_events(frame, target, window)
        d = design(cut_lineage(feature_levels(frame, events)))
        n = d.rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("outcome").alias("events")).first()
        enough = fit_status(n.events or 0, n.rows, len(d.columns), None) != "insufficient_events"
        fit = fit_logistic(cut_lineage(patterns(d)), len(d.columns), lam) if enough else None
        coefficients = {c: significant(float(b)) for c, b in zip(d.columns, fit.coefficients)} if fit else {}
        digest = hashlib.sha256(repr(sorted(coefficients.items())).encode()).hexdigest()
        out.append({"target": target, "window_days": window, "status": fit_status(n.events or 0, n.rows, len(d.columns), fit), "rows": n.rows, "events": n.events or 0, "coefficients": coefficients, "model_hash": digest})
    return out


def ratio_drafts(table: DataFrame, intervals: DataFrame, threshold: int = 30, least_expected: float = 5.0) -> DataFrame:
    """One draft per judge, withheld where members or expected outcomes are few (AD22, AG10)."""
    from ..functions.columns import suppression_reason

    out = table.join(intervals, "judge_id", "left")
    out = out.withColumn("suppression_reason", suppression_reason(F.col("n"), threshold, F.col("expected"), least_expected)).withColumn("suppressed", F.col("suppression_reason").isNotNull())
    return out


def observed_expected(frame: Frame, target: str, window: int | None = None, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """Observed-to-expected ratios of every judge of every source in the frame (AG10).

    The model is fitted again in every replicate of the intervals.
    """
    events = decision_events(frame) if target == "pretrial_release" else release_events(frame, target, window or 365)
    from .graph import cut_lineage

    d = design(cut_lineage(feature_levels(frame, events)))
    fit = fit_logistic(cut_lineage(patterns(d)), len(d.columns))
    table = cut_lineage(expectations(scored(d, fit.coefficients)))
    rows = table.select("observed", "expected").collect()  # one row per judge
    shape = fit_shape(np.array([float(r.observed) for r in rows]), np.array([r.expected for r in rows]))
    sums, kept = _refitted(d, fit, seed, f"bootstrap:{target}:{window or 'none'}", replicates)
    return ratio_drafts(pooled(table, shape), _intervals(cut_lineage(sums), table, 0.95, len(kept)))
