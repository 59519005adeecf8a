"""The declared metrics: one row of parameters for each."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Metric:
    """What a metric counts, for whom, and from which cohort size it is shown."""

    slug: str
    kind: str
    population: str
    gate: str
    subjects: tuple[str, ...] = ("judge", "court")
    outcome: str | None = None
    scope: str | None = None
    actors: tuple[str, ...] | None = None
    discretion: tuple[str, ...] | None = None
    counted: dict[str, object] = field(default_factory=dict)
    measure: str | None = None
    dimension: str | None = None
    threshold: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.slug}: unknown kind {self.kind}")
        if "judge" in self.subjects and self.gate == "court_of_case":
            raise ValueError(f"{self.slug}: court_of_case has no judge")


KINDS = ("count", "share", "windowed_rate", "survival", "distribution", "median", "observed_expected")
#: Calendar-year anchor of each population.
ANCHORS = {"cases": "filed_at", "defendants": "filed_at", "pretrial_decisions": "decision_at", "disposed_charges": "disposed_at", "disposed_cases": "disposition_at", "sentences": "sentence_at", "release": "index_at", "disposition": "index_at", "sentence": "index_at"}

_JUDGE = {"actors": ("judge",), "discretion": ("discretionary",)}
_AFTER = {"release": "deciding_judge", "disposition": "disposing_judge", "sentence": "sentencing_judge"}


def _rate(slug: str, index: str, outcome: str, kind: str = "windowed_rate", scope: str | None = None) -> Metric:
    return Metric(slug, kind, index, _AFTER[index], outcome=outcome, scope=scope, threshold=10)


#: The metrics by slug.
METRICS: tuple[Metric, ...] = (
    Metric("eligible_cases", "count", "cases", "assigned_ever"),
    Metric("eligible_defendants", "count", "defendants", "assigned_ever"),
    Metric("pretrial_decisions", "count", "pretrial_decisions", "deciding_judge", **_JUDGE),
    Metric("pretrial_released", "count", "pretrial_decisions", "deciding_judge", counted={"detained_flag": False}, **_JUDGE),
    Metric("pretrial_detained", "count", "pretrial_decisions", "deciding_judge", counted={"detained_flag": True}, **_JUDGE),
    Metric("pretrial_release_share", "share", "pretrial_decisions", "deciding_judge", counted={"detained_flag": False}, threshold=10, **_JUDGE),
    Metric("statutory_release_count", "count", "pretrial_decisions", "court_of_case", ("court",), actors=("legislature_or_mandatory_rule",), discretion=("mandatory",)),
    Metric("unknown_actor_pretrial_count", "count", "pretrial_decisions", "court_of_case", ("court",), actors=("unknown",)),
    _rate("failure_to_appear_rate", "release", "failure_to_appear"),
    _rate("new_case_rate", "release", "new_case"),
    _rate("new_charge_rate", "release", "new_charge"),
    _rate("reconviction_rate", "release", "reconviction"),
    _rate("release_violation_rate", "release", "release_violation"),
    _rate("revocation_rate", "release", "revocation", scope="release"),
    _rate("rearrest_rate", "release", "rearrest"),
    _rate("failure_to_appear_survival", "release", "failure_to_appear", "survival"),
    _rate("new_case_survival", "release", "new_case", "survival"),
    _rate("reconviction_survival", "release", "reconviction", "survival"),
    _rate("new_case_rate_after_disposition", "disposition", "new_case"),
    _rate("new_charge_rate_after_disposition", "disposition", "new_charge"),
    _rate("reconviction_rate_after_disposition", "disposition", "reconviction"),
    _rate("revocation_rate_after_disposition", "disposition", "revocation", scope="supervision"),
    _rate("new_case_rate_after_sentence", "sentence", "new_case"),
    _rate("new_charge_rate_after_sentence", "sentence", "new_charge"),
    _rate("reconviction_rate_after_sentence", "sentence", "reconviction"),
    _rate("revocation_rate_after_sentence", "sentence", "revocation", scope="supervision"),
    Metric("disposition_distribution", "distribution", "disposed_charges", "disposing_judge", dimension="disposition"),
    Metric("judicial_dismissal_rate", "share", "disposed_charges", "disposing_judge", counted={"disposition": "dismissed", "disposition_actor": "judge"}, threshold=10),
    Metric("median_days_to_disposition", "median", "disposed_cases", "disposing_judge", measure="days_to_disposition", threshold=10),
    Metric("sentence_count", "count", "sentences", "sentencing_judge"),
    Metric("incarceration_days_median", "median", "sentences", "sentencing_judge", measure="incarceration_days", threshold=10),
    Metric("probation_days_median", "median", "sentences", "sentencing_judge", measure="probation_days", threshold=10),
    Metric("incarceration_days_median_by_offense_category", "median", "sentences", "sentencing_judge", measure="incarceration_days", dimension="offense_category", threshold=10),
    Metric("pretrial_release_observed_expected", "observed_expected", "pretrial_decisions", "deciding_judge", ("judge",), threshold=30, **_JUDGE),
    Metric("new_case_observed_expected", "observed_expected", "release", "deciding_judge", ("judge",), outcome="new_case", threshold=30),
    Metric("failure_to_appear_observed_expected", "observed_expected", "release", "deciding_judge", ("judge",), outcome="failure_to_appear", threshold=30),
)
BY_SLUG = {m.slug: m for m in METRICS}


def metrics_of(kind: str | None = None, subject: str | None = None) -> list[Metric]:
    """Metrics of a kind and for a subject type (MS1)."""
    return [m for m in METRICS if (kind is None or m.kind == kind) and (subject is None or subject in m.subjects)]
