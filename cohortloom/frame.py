"""The nine case tables: schemas, validation, and the bundle that operators take."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _TS, _L, _B = T.StringType(), T.TimestampType(), T.LongType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("source_id", _S), *[T.StructField(n, t) for n, t in columns.items()]])


#: Declared columns of each table; every row names its source. Extra columns are allowed.
SCHEMAS: dict[str, T.StructType] = {
    "cases": _schema(id=_S, court_id=_S, filed_at=_TS, closed_at=_TS, status=_S, case_type=_S),
    "assignments": _schema(case_id=_S, judge_id=_S, start_at=_TS, end_at=_TS),
    "charges": _schema(id=_S, case_id=_S, person_id=_S, filed_at=_TS, disposed_at=_TS, disposition=_S, disposition_actor=_S, offense_category=_S, severity=_S, source_row_id=_S, judge_id=_S),
    "decisions": _schema(id=_S, case_id=_S, person_id=_S, judge_id=_S, decision_type=_S, decision_at=_TS, actor_type=_S, discretion=_S, release_at=_TS, detained_flag=_B, release_type=_S),
    "sentences": _schema(id=_S, case_id=_S, person_id=_S, judge_id=_S, sentence_at=_TS, incarceration_days=_L, probation_days=_L),
    "events": _schema(id=_S, case_id=_S, person_id=_S, judge_id=_S, event_type=_S, event_at=_TS),
    "justice_events": _schema(id=_S, person_id=_S, event_type=_S, event_at=_TS, related_case_id=_S),
    "persons": _schema(id=_S),
    "courts": _schema(id=_S, jurisdiction_id=_S),
}

#: One row for each source: coverage dates (inclusive) and what it can document.
SOURCES = T.StructType(
    [
        T.StructField("source_id", _S), T.StructField("coverage_start", T.DateType()), T.StructField("coverage_end", T.DateType()),
        T.StructField("observable_outcomes", T.ArrayType(_S)), T.StructField("judge_gates", T.ArrayType(_S)),
        T.StructField("person_key_scope", _S), T.StructField("revocation_scopes", T.ArrayType(_S)),
    ]
)


class FrameError(ValueError):
    """A table lacks a declared column or holds it with another type."""


def validate_table(name: str, table: DataFrame) -> DataFrame:
    """The table, or FrameError for a missing column or another type (MS3)."""
    have = {f.name: f.dataType for f in table.schema}
    for wanted in SCHEMAS[name]:
        if wanted.name not in have:
            raise FrameError(f"{name}: no column {wanted.name}")
        if have[wanted.name] != wanted.dataType:
            raise FrameError(f"{name}.{wanted.name}: {have[wanted.name].simpleString()}, not {wanted.dataType.simpleString()}")
    return table


@dataclass(frozen=True)
class Frame:
    """All sources' tables, and a small table of sources, which joins may broadcast."""

    tables: dict[str, DataFrame]
    sources: DataFrame
    derived: dict[str, DataFrame] = field(default_factory=dict)
    #: Charges of cases (source_id, case_id), where they can be derived without those of the other cases.
    narrowed: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        for name, table in self.tables.items():
            validate_table(name, table)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def coverage(self) -> DataFrame:
        """Rows (source_id, covered_from, covered_to): instants, the right edge exclusive."""
        return self.sources.select(
            "source_id",
            F.col("coverage_start").cast("timestamp").alias("covered_from"),
            F.date_add("coverage_end", 1).cast("timestamp").alias("covered_to"),
        )

    def with_tables(self, **tables: DataFrame) -> Frame:
        """The frame with some tables replaced."""
        return replace(self, tables=self.tables | tables, derived={}, narrowed=None)

    def charges_of(self, cases: DataFrame) -> DataFrame:
        """All charges of the given cases (source_id, case_id), and perhaps of others: for joins on the case."""
        return self.charges if self.narrowed is None else self.narrowed(cases)

    def once(self, key: str, build) -> DataFrame:
        """A derived table that is a function of the frame alone, planned once."""
        if key not in self.derived:
            self.derived[key] = build(self)
        return self.derived[key]


def empty_frame(spark: SparkSession, sources: DataFrame) -> Frame:
    """A frame without rows."""
    return Frame({name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}, sources)
