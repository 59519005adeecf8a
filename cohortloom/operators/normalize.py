"""Normalisation: rule lookups, case assembly, sentences, service records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_space

#: What replaces what among versions of a charge, the best first.
VERSION_RANK = {"disposition": 0, "sentencing": 1, "initiation": 2}
WILDCARD = "*"


def blank(c: Column) -> Column:
    """Null for white space."""
    return F.nullif(F.trim(c), F.lit(""))


def rule_lookup(rows: DataFrame, rules: DataFrame, value: str, reason: str, fallback: str) -> DataFrame:
    """The rule of the exact pair, else of the value with any reason, else the fallback (NO1).

    ``rules`` (value, reason, rule) is a table of fixed rules.
    """
    v, r = blank(F.col(value)), blank(F.col(reason))
    exact = rules.where(F.col("reason").isNull() | (F.col("reason") != WILDCARD)).select(F.col("value").alias("ev"), F.coalesce("reason", F.lit("\x00")).alias("er"), F.col("rule").alias("exact_rule"))
    wild = rules.where(F.col("reason") == WILDCARD).select(F.col("value").alias("wv"), F.col("rule").alias("wild_rule"))
    out = rows.withColumn("rv", v).withColumn("rr", F.coalesce(r, F.lit("\x00")))
    out = out.join(exact, (F.col("rv") == F.col("ev")) & (F.col("rr") == F.col("er")), "left").join(wild, F.col("rv") == F.col("wv"), "left")
    return out.withColumn("rule", F.coalesce("exact_rule", "wild_rule", F.lit(fallback))).drop("rv", "rr", "ev", "er", "wv", "exact_rule", "wild_rule")


def total_match(rows: DataFrame, rules: DataFrame, column: str, fallback: str | None, when_blank: str | None) -> DataFrame:
    """The rule of a value: a fallback for unlisted ones, another outcome for blank ones (NO2)."""
    key = rules.select(F.col("value").alias("mv"), F.col("rule").alias("found"))
    out = rows.withColumn("k", blank(F.col(column))).join(key, F.col("k") == F.col("mv"), "left")
    return out.withColumn("rule", F.when(F.col("k").isNull(), F.lit(when_blank)).otherwise(F.coalesce("found", F.lit(fallback)))).drop("k", "mv", "found")


def pretrial_rule(rows: DataFrame, bonds: DataFrame, effective: str, type_column: str = "bond_type", date_column: str = "bond_date") -> DataFrame:
    """Regime by the bond's own date and its rule, or why there is none (NO3)."""
    kind = blank(F.col(type_column))
    regime = F.when(F.col(date_column) >= F.lit(effective).cast("date"), F.lit("fairness_act")).when(F.col(date_column).isNotNull(), F.lit("monetary_bail"))
    key = bonds.select(F.col("bond_type").alias("bt"), F.col("regime").alias("br"), F.col("rule").alias("bond_rule"))
    out = rows.withColumn("regime", regime).withColumn("kind", kind).join(key, (F.col("kind") == F.col("bt")) & (F.col("regime") == F.col("br")), "left")
    why = F.when(F.col("kind").isNull(), F.lit("no_bond_type")).when(F.col("regime").isNull(), F.lit("no_bond_date")).when(F.col("bond_rule").isNull(), F.lit("unlisted_bond_type"))
    return out.withColumn("reason", why).drop("kind", "bt", "br")


def term_days(term: Column, unit: Column, units: dict[str, float | None], flags: dict[str, str] | None = None, most: int = 36_500) -> tuple[Column, Column]:
    """Whole days of a term, halves up, and the flag where there are none (NO4)."""
    t, u = blank(term), blank(unit)
    per = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(v).cast("decimal(20,6)"))])
    own = F.create_map(*[x for k in units for x in (F.lit(k), F.lit((flags or {}).get(k, "unit_not_a_term")))])
    rate = F.try_element_at(per, u)
    number = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.cast("decimal(16,4)"))
    days = F.round(number * rate, 0)
    flag = (
        F.when(u.isNull(), F.lit("missing_term")).when(~u.isin(list(units)), F.lit("unparseable_term")).when(rate.isNull(), F.try_element_at(own, u))
        .when(t.isNull(), F.lit("missing_term")).when(number.isNull(), F.lit("unparseable_term")).when(days > most, F.lit("implausible_term"))
    )
    return F.when(flag.isNull(), days.cast("long")), flag


def sentence_row(rows: DataFrame, phases: DataFrame, components_: DataFrame) -> DataFrame:
    """Phase and components of a sentence row; null components go, repeats count once (NO5)."""
    p = phases.select(F.col("value").alias("pv"), F.col("rule").alias("phase"))
    c = components_.select(F.col("value").alias("cv"), F.col("component"), F.col("extra"))
    out = rows.join(p, blank(F.col("sentence_phase")) == F.col("pv"), "left").join(c, blank(F.col("sentence_type")) == F.col("cv"), "left")
    made = F.array_distinct(F.array_compact(F.array("component", "extra")))
    return out.withColumn("components", made).withColumn("flags", F.when(F.size(made) == 0, F.array(F.lit("unlisted_type"))).otherwise(F.array().cast("array<string>"))).drop("pv", "cv", "component", "extra")


def court_of_case(rows: DataFrame, parent: str) -> DataFrame:
    """The case's one district court, else its parent court (NO6)."""
    found = rows.groupBy("case_id").agg(F.count_distinct("court").alias("n"), F.max("court").alias("one"))
    return found.select("case_id", F.when(F.col("n") == 1, F.col("one")).otherwise(F.lit(parent)).alias("court"))


def restricted_category(value: Column, allowed: tuple[str, ...]) -> Column:
    """A code of a closed list from free text; other text is unknown, blank is null (NO7)."""
    key = F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(blank(value).isNull(), F.lit(None)).when(key.isin(list(allowed)), key).otherwise(F.lit("unknown"))


def assemble_cases(participants: DataFrame) -> DataFrame:
    """Cases from participant rows: filing, status, closing (NO8).

    Filed at the earliest receipt; closed only if every charge has ended, then on the last
    end. The number of participants is that of distinct ones.
    """
    out = participants.groupBy("case_id").agg(
        F.min("received").alias("filed_date"), F.count_distinct("participant_id").alias("participants"),
        F.bool_and(F.col("ended").isNotNull()).alias("all_ended"), F.max("ended").alias("last_end"),
    )
    return out.select("case_id", "filed_date", "participants", F.when(F.col("all_ended"), F.lit("closed")).otherwise(F.lit("open")).alias("status"), F.when(F.col("all_ended"), F.col("last_end")).alias("closed_date"))


def party_ordinals(parties: DataFrame, key: str = "participant_id") -> DataFrame:
    """Place of each participant in its case, in code point order (NO16, NO8)."""
    return parties.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("case_id").orderBy(F.col(key).cast("binary"))))


def charge_versions(versions: DataFrame) -> DataFrame:
    """One version of a charge: disposition over sentencing over initiation, then the highest (NO9).

    An initiation version goes where a later export replaces it.
    """
    rank = F.create_map(*[x for k, v in VERSION_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("export")]
    first = F.row_number().over(Window.partitionBy("participant_id", "charge_id").orderBy(rank, F.desc("version")))
    return versions.withColumn("place", first).where("place = 1").drop("place")


def disposition_events(rows: DataFrame) -> DataFrame:
    """Distinct disposition events with the smallest judge (NO10)."""
    return rows.groupBy("case_id", "participant_id", "disposition", "disposed_on").agg(F.min("judge").alias("judge"))


def first_facts(rows: DataFrame, order: str, facts: list[str]) -> DataFrame:
    """The first row of each participant in export order (NO11)."""
    return rows.groupBy("participant_id").agg(F.min_by(F.struct(*facts), order).alias("f")).select("participant_id", *[F.col(f"f.{c}").alias(c) for c in facts])


def sentence_groups(rows: DataFrame) -> DataFrame:
    """Sentences of one participant, day and phase (NO12).

    The largest term, all components, and the commonest judge (of equals the smallest). A
    group is replaced where a later one of the participant shares a component.
    """
    key = ["participant_id", "sentence_date", "phase"]
    judge = rows.groupBy(*key, "judge").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.min_by("judge", F.struct(-F.col("n"), F.col("judge"))).alias("judge"))
    own = rows.groupBy(*key).agg(F.max("days").alias("days"), F.sort_array(F.collect_set("component")).alias("components")).join(judge, key)
    later = own.select("participant_id", F.col("sentence_date").alias("later_date"), F.col("components").alias("later_components"))
    hit = own.join(later, "participant_id").where((F.col("later_date") > F.col("sentence_date")) & F.arrays_overlap("components", "later_components"))
    return own.join(hit.select(*key).distinct().withColumn("replaced", F.lit(True)), key, "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)))


def service_spans(rows: DataFrame) -> DataFrame:
    """First and last day of each judge at each court (NO13)."""
    return rows.where("judge IS NOT NULL AND day IS NOT NULL").groupBy("judge", "court").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))


def restricted_attributes(rows: DataFrame) -> DataFrame:
    """The first valid value of each participant in export order, with conflicts counted (NO14)."""
    ok = rows.where("value IS NOT NULL")
    return ok.groupBy("participant_id", "attribute").agg(F.min_by("value", "export_rank").alias("value"), (F.count_distinct("value") - 1).alias("conflicts"))


def drafts(table: DataFrame, columns: dict[str, Column], required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and those rejected because a required column could not be read (NO15)."""
    parsed = table.select("*", *[c.alias(f"parsed_{n}") for n, c in columns.items()])
    bad = reduce(lambda a, b: a | b, [F.col(f"parsed_{n}").isNull() for n in required], F.lit(False))
    good = parsed.where(~bad).select(*[F.col(f"parsed_{n}").alias(n) for n in columns])
    return good, parsed.where(bad).select(*table.columns)


def derived_at_ingest(cases: DataFrame) -> DataFrame:
    """Whether a case is a new one of its person, and one after a conviction (NO17, JO8)."""
    before = cases.select("person_id", F.col("case_id").alias("o"), F.col("filed").alias("o_filed"), F.col("convicted").alias("o_convicted"))
    both = cases.join(before, "person_id", "left").where(F.col("o").isNull() | (F.col("o") != F.col("case_id")) | F.col("o_filed").isNull() | (F.col("o") == F.col("case_id")))
    earlier = (F.col("o") != F.col("case_id")) & (F.col("o_filed") < F.col("filed"))
    return both.groupBy("person_id", "case_id").agg(F.coalesce(F.bool_or(earlier), F.lit(False)).alias("new_case"), F.coalesce(F.bool_or(earlier & (F.col("o_convicted") < F.col("filed"))), F.lit(False)).alias("reconviction"))


def appointments(rows: DataFrame, groups: int = 6) -> DataFrame:
    """Up to six appointments in the columns of one row, as rows; undated ones keep their place (NO18)."""
    made = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"court_{i}").alias("court"), F.col(f"start_{i}").alias("start_date"), F.col(f"end_{i}").alias("end_date")) for i in range(1, groups + 1)])
    return rows.select("judge", F.inline(F.filter(made, lambda a: a["court"].isNotNull())))


def judge_status(services: DataFrame) -> DataFrame:
    """Serving or not by the latest appointment (NO19)."""
    last = services.groupBy("judge").agg(F.max_by("end_date", F.struct("start_date", "place")).alias("end_date"), F.count(F.lit(1)).alias("appointments"))
    return last.select("judge", "appointments", F.when(F.col("end_date").isNull(), F.lit("serving")).otherwise(F.lit("ended")).alias("status"))


def attribution_summary(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows by the actor that the rule of their disposition names (VA12)."""
    return rule_lookup(rows, rules, "disposition", "reason", "unknown").groupBy(F.col("rule").alias("actor")).agg(F.count(F.lit(1)).alias("n"))


def state_key(c: Column) -> Column:
    """Key of a state's name (FN5)."""
    return fold_space(c)
