"""Member rows behind observations, publishing, verification and tracing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.columns import WINDOWS
from .outcomes import window_flags

FAMILY = ("subject_type", "subject_id", "source_id", "slug")
#: How members of an observation are chosen, by metric kind and dimension.
PLAIN, BELONGS_TO, COUNTED_IN = "plain", "belongs_to", "counted_in"


def mode_for(kind: str, dimension: str | None) -> str:
    """Membership of a dimension's observations (MS12)."""
    if dimension is None:
        return PLAIN
    return COUNTED_IN if kind == "distribution" else BELONGS_TO


def mask(flags: list[Column]) -> Column:
    """Bit mask of up to 15 flags; a null flag is 0 (ME1)."""
    if len(flags) > 15:
        raise ValueError("a mask holds 15 flags")
    bits = [F.when(F.coalesce(f, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a + b, bits, F.lit(0)).cast("int")


def atoms(rows: DataFrame, member: str, anchor: str, counted: list[Column], followed: list[Column], dimension: str | None = None) -> DataFrame:
    """One row per member with its year, dimension value and masks (ME2)."""
    keys = [c for c in FAMILY if c in rows.columns]
    value = F.col(dimension) if dimension else F.lit(None).cast("string")
    return rows.select(*keys, F.col(member).alias("member_id"), F.year(anchor).alias("anchor_year"), value.alias("dimension_value"), mask(counted).alias("counted_mask"), mask(followed).alias("followed_mask"))


def canonical(members: DataFrame, slots: int = len(WINDOWS)) -> DataFrame:
    """One row per distinct member, with how often it occurs (ME3).

    Rows of one member may differ in their flags. Per slot the flag pairs of a member's rows
    are sorted, and the k-th pairs of all slots make the k-th row: what a projection shows
    stays the same, and equal families have equal rows whatever their order was.
    """
    keys = [c for c in members.columns if c not in ("counted_mask", "followed_mask")]
    code = lambda i: (F.shiftright("followed_mask", i).bitwiseAND(F.lit(1)) * 2 + F.shiftright("counted_mask", i).bitwiseAND(F.lit(1)))
    gathered = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sort_array(F.collect_list(code(i))).alias(f"slot{i}") for i in range(slots)])
    at = lambda i: F.get(F.col(f"slot{i}"), F.col("k") - 1)
    rows = gathered.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    counted = reduce(lambda a, b: a + b, [at(i).bitwiseAND(F.lit(1)) * (1 << i) for i in range(slots)])
    followed = reduce(lambda a, b: a + b, [F.shiftright(at(i), 1) * (1 << i) for i in range(slots)])
    return rows.groupBy(*keys, counted.cast("int").alias("counted_mask"), followed.cast("int").alias("followed_mask")).agg(F.count(F.lit(1)).alias("multiplicity"))


def family_digest(members: DataFrame, kind: str) -> DataFrame:
    """SHA-256 of a family's kind and sorted rows (ME4).

    Row digests are sorted within the family; a family is one subject's rows of one metric.
    """
    keys = [c for c in FAMILY if c in members.columns]
    row = F.concat_ws("|", F.coalesce("member_id", F.lit("")), F.coalesce(F.col("anchor_year").cast("string"), F.lit("")), F.coalesce("dimension_value", F.lit("")), "counted_mask", "followed_mask", "multiplicity")
    text = F.concat_ws("\n", F.lit(kind), F.sort_array(F.collect_list(row)))
    return members.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"), F.sum("multiplicity").alias("members"))


def project(members: DataFrame, *, year: int | None = None, slot: int | None = None, mode: str = PLAIN, dimension: str | None = None) -> DataFrame:
    """Members of one observation with counted and followed (ME5)."""
    rows = members if year is None else members.where(F.col("anchor_year") == year)
    bit = lambda c: F.col(c).bitwiseAND(F.lit(1 << (slot or 0))) != 0
    counted = bit("counted_mask")
    if mode == BELONGS_TO:
        rows = rows.where(F.col("dimension_value") == dimension)
    elif mode == COUNTED_IN:
        counted = F.coalesce(F.col("dimension_value") == dimension, F.lit(False))
    return rows.select(*[c for c in FAMILY if c in rows.columns], "member_id", counted.alias("counted"), bit("followed_mask").alias("followed"), "multiplicity")


def cohort_members(cohort: DataFrame, slug: str, survival: bool = False) -> DataFrame:
    """Canonical members of a windowed metric's cohort."""
    counted, followed = window_flags(survival=survival)
    return canonical(atoms(cohort.withColumn("slug", F.lit(slug)), "member_id", "index_at", counted, followed))


def missing_members(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Member ids without a row behind them; must be empty (ME6, JO9)."""
    return members.select("member_id").distinct().join(existing.select(F.col("id").alias("member_id")), "member_id", "left_anti")


def expand(members: DataFrame) -> DataFrame:
    """Members once for each time they count (MS11)."""
    return members.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("multiplicity", "copy")


def stored_precision(table: DataFrame, rates: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Rates at six places and values at four, ties to even, as stored (ME8)."""
    for c in rates:
        table = table.withColumn(c, F.bround(F.col(c).cast("decimal(38,18)"), 6).cast("decimal(9,6)"))
    for c in values:
        table = table.withColumn(c, F.bround(F.col(c).cast("decimal(38,18)"), 4).cast("decimal(14,4)"))
    return table


def compare(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows (keys, status) with status equal, mismatch, missing (only fresh) or extra (only stored) (ME9)."""
    a = stored.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(k) for k in keys], F.struct(*columns).alias("old"))
    b = fresh.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(k) for k in keys], F.struct(*columns).alias("new"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("old").isNull(), F.lit("missing")).when(F.col("new").isNull(), F.lit("extra")).when(F.col("old").eqNullSafe(F.col("new")), F.lit("equal")).otherwise(F.lit("mismatch"))
    return both.select(*[F.nullif(F.col(k), F.lit("\x00")).alias(k) for k in keys], status.alias("status"), "old", "new")


def mismatches(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows (keys, column, old, new) of every column that differs (ME9, AG19)."""
    found = compare(stored, fresh, keys, columns).where("status = 'mismatch'")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"old.{c}").cast("string").alias("old_value"), F.col(f"new.{c}").cast("string").alias("new_value")) for c in columns])
    return found.select(*keys, F.inline(F.filter(cells, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))))


def compare_members(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Members whose numbers of copies differ (ME10)."""
    keys = ["member_id", "counted_mask", "followed_mask"]
    a = stored.groupBy(*keys).agg(F.sum("multiplicity").alias("stored"))
    b = fresh.groupBy(*keys).agg(F.sum("multiplicity").alias("fresh"))
    return a.join(b, keys, "full_outer").na.fill(0, ["stored", "fresh"]).where("stored <> fresh")


def publish_plan(current: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What publishing does with each observation (ME7).

    A subject whose rows all agree is left alone (``keep``); otherwise its old rows are
    superseded and its new ones inserted, or revived where the very row exists.
    """
    both = compare(current, fresh, keys, columns).drop("old", "new")
    subject = ["subject_type", "subject_id"]
    changed = both.groupBy(*subject).agg(F.max((F.col("status") != "equal").cast("int")).alias("changed"))
    action = (
        F.when(F.col("changed") == 0, F.lit("keep")).when(F.col("status") == "equal", F.lit("revive")).when(F.col("status") == "missing", F.lit("insert"))
        .when(F.col("status") == "extra", F.lit("supersede")).otherwise(F.lit("replace"))
    )
    return both.join(changed, subject).select(*keys, "status", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Changed-only upsert: every row with action insert, update, unchanged or retained (SC17)."""
    status = F.when(F.col("status") == "missing", F.lit("insert")).when(F.col("status") == "mismatch", F.lit("update")).when(F.col("status") == "extra", F.lit("retained")).otherwise(F.lit("unchanged"))
    both = compare(old, new, keys, compared)
    row = F.coalesce(F.col("new"), F.col("old"))
    return both.select(*keys, *[row.getField(c).alias(c) for c in compared], status.alias("action"))


def run_statistics(changes: DataFrame, table: str) -> DataFrame:
    """Rows seen, created, updated and left by an upsert (MS23)."""
    return changes.where("action <> 'retained'").groupBy(F.lit(table).alias("table")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("action") == "insert").alias("created"),
        F.count_if(F.col("action") == "update").alias("updated"), F.count_if(F.col("action") == "unchanged").alias("unchanged"),
    )


def trace(members: DataFrame, existing: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of an observation's members with totals; dangling members stay visible (ME11, JO13, WI4).

    Totals are computed once and joined to the page: only the page is sorted out.
    """
    rows = members.join(existing.select(F.col("id").alias("member_id"), F.lit(True).alias("resolved")), "member_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    totals = rows.agg(F.sum("multiplicity").alias("total"), F.sum(F.when(F.col("counted"), F.col("multiplicity")).otherwise(0)).alias("total_counted"), F.count_if(~F.col("resolved")).alias("unresolved"))
    page = rows.orderBy("member_id", "counted", "followed").offset(offset).limit(limit)
    # One row of totals.
    return page.crossJoin(F.broadcast(totals)).withColumn("complete", F.col("unresolved") == 0)


def impacted_subjects(frame: Frame, touched: DataFrame) -> DataFrame:
    """Courts and judges whose figures a change of cases (case_id) can move (ME12).

    touched cases, their persons, all cases of those persons, and the subjects of those.
    """
    people = frame.charges.select("case_id", "person_id").union(frame.decisions.select("case_id", "person_id")).distinct()
    persons = people.join(touched.select("case_id").distinct(), "case_id", "left_semi").select("person_id").distinct()
    cases = people.join(persons, "person_id", "left_semi").select("case_id").union(touched.select("case_id")).distinct()
    courts = frame.cases.select(F.col("id").alias("case_id"), F.lit("court").alias("subject_type"), F.col("court_id").alias("subject_id"))
    judges = reduce(DataFrame.union, [t.select("case_id", F.lit("judge").alias("subject_type"), F.col("judge_id").alias("subject_id")) for t in (frame.assignments, frame.charges, frame.decisions, frame.sentences)])
    return courts.union(judges).where("subject_id IS NOT NULL").join(cases, "case_id", "left_semi").select("subject_type", "subject_id").distinct()


def must_defer(touched: int, subjects: int, most_cases: int = 50_000, most_subjects: int = 500) -> bool:
    """Whether recomputing is left to a batch run (ME13)."""
    return touched > most_cases or subjects > most_subjects


def retire(table: DataFrame, source: str, references: list[DataFrame] = ()) -> DataFrame:
    """Rows that stay when a source is retired: other sources', and referenced ones (ME14)."""
    own = table.where(F.col("source_id") == source)
    kept = [own.join(r.where(F.col("source_id") != source).select(F.col("ref").alias("id")).distinct(), "id", "left_semi").select(*table.columns) for r in references]
    return reduce(DataFrame.unionByName, kept, table.where(F.col("source_id") != source)).distinct()


def current_groups(observations: DataFrame) -> DataFrame:
    """Current observations by their key (AG23, FI11)."""
    keys = ["slug", "subject_type", "subject_id", "source_id", "calendar_year", "window_days", "dimension_value"]
    return observations.where("superseded_at IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def keep_first(drafts: DataFrame, key: list[str], order: str, compared: list[str]) -> DataFrame:
    """The first draft of each natural key, with how many were dropped and how many differed (LD8)."""
    first = F.first_value(F.struct(*compared)).over(Window.partitionBy(*key).orderBy(order))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    marked = drafts.select("*", first.alias("lead_row"), place.alias("place"))
    differs = ~F.struct(*compared).eqNullSafe(F.col("lead_row"))
    counts = marked.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("dropped"), F.count_if(differs).alias("conflicting"))
    return marked.where("place = 1").drop("lead_row", "place").join(counts, key)
