"""A bounded sample of training documents, spread evenly over the values of a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) modulo FOLDS that is held out from all learning.
FOLDS, HELD_OUT = 4, 2


def is_held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the rows that no classifier may learn from; false for a null id."""
    id_of = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(id_of.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def spread_sample(ids: DataFrame, label: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_label`` rows (id, label) of each label, chosen by the hash of the id.

    Each label's rows fall into ``per_label`` slots by hash, and the row of smallest hash
    wins a slot: one pre-aggregated group by, whatever a label's share of the rows is.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    slot = F.pmod(h, F.lit(per_label))
    return ids.groupBy(F.col(label), slot.alias("slot")).agg(F.min_by(F.col(id_col), F.struct(h, F.col(id_col))).alias(id_col)).select(id_col, label)


def bounded_sample(rows: DataFrame, most: int, id_col: str) -> DataFrame:
    """At most ``most`` rows, the same ones whatever the partitioning.

    Values of ``id_col``, which must be unique, fall into ``most`` slots by hash and the one of
    smallest hash wins its slot. Rows without a value are left out.
    """
    slotted = rows.where(F.col(id_col).isNotNull()).select(id_col, F.lit(0).alias("all"))
    chosen = spread_sample(slotted, "all", most, id_col).select(id_col)
    # At most ``most`` identifiers.
    return rows.join(F.broadcast(chosen), id_col, "left_semi")
