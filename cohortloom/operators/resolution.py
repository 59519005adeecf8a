"""Person resolution: blocking, pair features, stages, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

#: Identifier kinds that block pairs, and thresholds of the optional scorer.
BLOCKING = ("full_name", "source_participant_id")
MATCH_FROM, REJECT_BELOW = 0.95, 0.20


def identifier_hash(pepper: str, kind: Column, value: Column, source: Column | None = None) -> Column:
    """SHA-256 of pepper, kind, source and value with zero bytes between (ER13)."""
    if not pepper.strip():
        raise ValueError("the pepper is empty")
    zero, parts = F.lit(b"\x00"), [F.lit(pepper.encode()), kind.cast("binary")]
    if source is not None:
        parts.append(source.cast("binary"))
    joined = [x for p in parts for x in (p, zero)] + [value.cast("binary")]
    return F.sha2(F.concat(*joined), 256)


def blocks(identifiers: DataFrame, persons: DataFrame) -> DataFrame:
    """Rows (kind, hash, person_id) of identifiers that several unmerged persons share (ER1, FI13)."""
    alive = persons.where("merged_into IS NULL").select(F.col("id").alias("person_id"))
    own = identifiers.where(F.col("kind").isin(list(BLOCKING))).join(alive, "person_id", "left_semi").select("kind", "hash", "person_id").distinct()
    shared = own.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "hash")
    return own.join(shared, ["kind", "hash"], "left_semi")


def candidate_pairs(blocks_: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Distinct pairs left < right that share a block; with an anchor, pairs that touch it (ER2, JO14)."""
    a = blocks_.select("kind", "hash", F.col("person_id").alias("left"))
    b = blocks_.select("kind", "hash", F.col("person_id").alias("right"))
    pairs = a.join(b, ["kind", "hash"]).where(F.col("left") < F.col("right")).select("left", "right").distinct()
    if anchor is None:
        return pairs
    ids = anchor.select(F.col("id").alias("x"))
    return pairs.join(ids, F.col("left") == F.col("x"), "left_semi").union(pairs.join(ids, F.col("right") == F.col("x"), "left_semi")).distinct()


def profiles(identifiers: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per person: hashes by kind and the person's cases as arrays (MS31)."""
    kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("hash"))).alias(k)
    hashes = identifiers.groupBy("person_id").agg(*[kind(k) for k in ("source_participant_id", "full_name", "date_of_birth", "name_dob")])
    linked = cases.groupBy("person_id").agg(
        F.collect_set("case_id").alias("cases"), F.collect_set("case_number").alias("numbers"), F.collect_set("related_number").alias("cited"),
        F.collect_set("court_id").alias("courts"), F.collect_set("filed_date").alias("filed"),
    )
    return hashes.join(linked, "person_id", "left")


def pair_features(pairs: DataFrame, profiles_: DataFrame) -> DataFrame:
    """Eight booleans, the smallest filing gap in days and age consistency of each pair (ER3)."""
    side = lambda s: profiles_.select(F.col("person_id").alias(s), F.struct(*[c for c in profiles_.columns if c != "person_id"]).alias(f"{s}_p"))
    both = pairs.join(side("left"), "left").join(side("right"), "right")
    meet = lambda x, y=None: F.coalesce(F.arrays_overlap(f"left_p.{x}", f"right_p.{y or x}"), F.lit(False))
    no_dob = (F.size("left_p.date_of_birth") < 1) | (F.size("right_p.date_of_birth") < 1)
    same_dob = meet("date_of_birth")
    gap = F.expr("array_min(transform(left_p.filed, x -> array_min(transform(right_p.filed, y -> abs(datediff(x, y))))))")
    return both.select(
        "left", "right", meet("source_participant_id").alias("same_source_id"), meet("full_name").alias("same_name"), same_dob.alias("same_dob"),
        no_dob.alias("dob_missing_either"), meet("name_dob").alias("same_name_dob"), meet("cases").alias("shared_case"),
        (meet("cited", "numbers") | meet("numbers", "cited")).alias("related_case_link"), meet("courts").alias("same_court"),
        gap.alias("filing_gap_days"), F.when(~no_dob, same_dob).alias("age_consistent"),
    )


def _result(decision: str, score: float, stage: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(score).alias("score"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))


def deterministic_stage() -> Column:
    """A shared source identifier matches; otherwise no decision (ER4)."""
    return F.when(F.col("same_source_id"), _result("matched", 1.0, "deterministic", "same_source_id"))


def rule_stage() -> Column:
    """The first rule that applies (ER5)."""
    differs = ~F.col("dob_missing_either") & ~F.col("same_dob")
    return (
        F.when(F.col("same_name_dob") & (F.col("shared_case") | F.col("related_case_link")), _result("matched", 0.98, "rule", "name_dob_case_link"))
        .when(F.col("same_name_dob") & F.col("same_court") & F.coalesce("age_consistent", F.lit(False)) & ~differs, _result("review", 0.70, "rule", "name_dob_same_court"))
        .when(F.col("same_name") & F.col("dob_missing_either"), _result("rejected", 0.10, "rule", "name_only"))
        .when(F.col("same_name") & differs, _result("rejected", 0.02, "rule", "dob_differs"))
    )


def score_stage(score: Column | None) -> Column:
    """An optional score decides at its thresholds and leaves the rest to review (ER6)."""
    none = F.lit(None).cast("struct<decision:string,score:double,stage:string,reason:string>")
    if score is None:
        return none
    made = lambda d: F.struct(F.lit(d).alias("decision"), score.cast("double").alias("score"), F.lit("probabilistic").alias("stage"), F.lit("score").alias("reason"))
    return F.when(score.isNull(), none).when(score >= MATCH_FROM, made("matched")).when(score < REJECT_BELOW, made("rejected")).otherwise(made("review"))


def evaluate(features: DataFrame, scorer: Callable[[], Column] | None = None) -> DataFrame:
    """Stages in order: the first decisive one ends; else the first pending review; else review (ER7)."""
    rows = features.withColumn("s1", deterministic_stage()).withColumn("s2", rule_stage()).withColumn("s3", score_stage(scorer() if scorer else None))
    decisive = lambda s: F.col(f"{s}.decision").isin("matched", "rejected")
    out = F.when(decisive("s1"), F.col("s1")).when(decisive("s2"), F.col("s2")).when(decisive("s3"), F.col("s3"))
    out = out.when(F.col("s2").isNotNull(), F.col("s2")).when(F.col("s3").isNotNull(), F.col("s3")).otherwise(_result("review", 0.50, "review", "ambiguous"))
    trace = lambda s, none: F.coalesce(F.concat_ws(":", F.col(f"{s}.decision"), F.col(f"{s}.reason")), F.lit(none))
    passed = F.concat_ws(" ", F.when(F.col("s1").isNull(), F.lit("no_signal")).otherwise(trace("s1", "")), F.when(decisive("s1"), F.lit(None)).when(F.col("s2").isNull(), F.lit("no_decision")).otherwise(trace("s2", "")))
    return rows.withColumn("o", out).select("left", "right", "o.decision", "o.score", "o.stage", "o.reason", passed.alias("trace"))


def resolve_drafts(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """Each draft's person by its stable hash, or a new id made from that hash (ER8)."""
    one = known.groupBy("hash").agg(F.min("person_id").alias("known_id"))
    out = drafts.join(one, "hash", "left")
    return out.select(*drafts.columns, F.coalesce("known_id", F.concat(F.lit("person:"), F.left("hash", F.lit(32)))).alias("person_id"), F.col("known_id").isNull().alias("created"))


def apply_decisions(found: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """System decisions with human ones kept over them (ER9, MS30)."""
    if human is None:
        return found.withColumn("decided_by", F.lit("system"))
    h = human.select("left", "right", F.col("decision").alias("human_decision"))
    return found.join(h, ["left", "right"], "left").withColumn("decided_by", F.when(F.col("human_decision").isNotNull(), F.lit("human")).otherwise(F.lit("system"))).withColumn("decision", F.coalesce("human_decision", "decision")).drop("human_decision")


def merge_map(decided: DataFrame, persons: DataFrame) -> DataFrame:
    """Rows (id, survivor) of matched groups: the person created first, of equals the smallest id (ER9)."""
    links = decided.where("decision = 'matched'").select(F.col("left").alias("a"), F.col("right").alias("b"))
    groups = components(links)
    lead = groups.join(persons, "id").groupBy("component").agg(F.min(F.struct("created_at", "id")).alias("lead"))
    return groups.join(lead, "component").select("id", F.col("lead.id").alias("survivor"))


def repoint(rows: DataFrame, merges: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Rows moved to survivors; of rows that then share their natural key one stays (ER11, JO17)."""
    m = merges.select(F.col("id").alias(column), "survivor")
    moved = rows.join(m, column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")
    return moved.select(*rows.columns).dropDuplicates(key)


def review_queue(decided: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Pairs for review, likeliest first (ER12)."""
    return decided.where("decision = 'review'").orderBy(F.desc("score"), "left", "right").offset(offset).limit(limit)


def alias_lookup(names: DataFrame, exact: DataFrame, normal: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    """Judge of a name: exact alias, else normalised one; held aliases resolve to nobody (ER14)."""
    e = exact.select(F.col("alias").alias("name"), F.col("judge_id").alias("e_id"), F.col("held").alias("e_held"))
    n = normal.select(F.col("alias").alias("folded"), F.col("judge_id").alias("n_id"), F.col("held").alias("n_held"))
    out = names.withColumn("folded", normalise(F.col("name"))).join(e, "name", "left").join(n, "folded", "left")
    held = F.coalesce("e_held", "n_held", F.lit(False))
    status = F.when(F.col("name").isNull(), F.lit("blank")).when(held, F.lit("held")).when(F.coalesce("e_id", "n_id").isNotNull(), F.lit("resolved")).otherwise(F.lit("unresolved"))
    return out.select("name", F.when(status == "resolved", F.coalesce("e_id", "n_id")).alias("judge_id"), status.alias("status"))

