"""Validation: discrimination, calibration, subgroups, stability, profiles of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import suppression_reason


def ordered_parts(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``part``: consecutive ranges of the column, about as many as shuffle partitions.

    The bounds are fixed numbers from approximate quantiles, so every use of the result cuts
    at the same places. Equal values share a part.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000).alias("q")).first().q or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))]) if found else F.array().cast("array<double>")
    return rows.withColumn("part", F.size(F.filter(bounds, lambda b: b < F.col(column))))


def counts_before(rows: DataFrame, column: str, weight: str) -> DataFrame:
    """Rows with ``before``: the weights of all smaller values. One row per value is expected.

    Weights are summed per part, parts (a row each) are accumulated, and a window runs inside
    each part: no task sees all values.
    """
    parts = ordered_parts(rows, column)
    sums = parts.groupBy("part").agg(F.sum(weight).alias("part_sum"))
    earlier = sums.select("part", (F.sum("part_sum").over(Window.orderBy("part")) - F.col("part_sum")).alias("earlier"))
    inside = F.sum(weight).over(Window.partitionBy("part").orderBy(column)) - F.col(weight)
    return parts.withColumn("inside", inside).join(F.broadcast(earlier), "part").withColumn("before", F.col("earlier") + F.col("inside")).drop("part", "inside", "earlier")


def split_cutoff(rows: DataFrame, at: str, quantile: float = 0.75) -> DataFrame:
    """Nearest-rank quantile of instants, one row; rows from it on are the test set (AD24)."""
    counts = rows.groupBy(F.unix_micros(at).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) * F.lit(quantile)), F.lit(1)).alias("rank"))
    return counts_before(counts, "t", "c").crossJoin(F.broadcast(total)).where("before + c >= rank").agg(F.min("t").alias("cutoff"))  # one row


def average_ranks(scores: DataFrame, column: str) -> DataFrame:
    """Rows (value, average_rank): ties share their mean rank (WI7)."""
    counts = scores.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    return counts_before(counts, "value", "ties").select("value", "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("average_rank"))


def roc_auc(scores: DataFrame, predicted: str = "predicted", outcome: str = "outcome") -> DataFrame:
    """Mann-Whitney AUC with ties averaged; null unless both outcomes occur (AD25)."""
    per = scores.groupBy(F.col(predicted).alias("value")).agg(F.count(F.lit(1)).alias("ties"), F.sum(F.col(outcome).cast("long")).alias("pos"))
    rank = F.col("before") + (F.col("ties") + 1) / 2
    sums = counts_before(per, "value", "ties").select("ties", "pos", rank.alias("rank")).agg(F.sum("pos").alias("p"), F.sum("ties").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return sums.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def brier(scores: DataFrame) -> DataFrame:
    """Mean squared error and calibration in the large (AD25)."""
    return scores.agg(F.avg(F.pow(F.col("predicted") - F.col("outcome"), 2)).alias("brier"), (F.avg("outcome") - F.avg("predicted")).alias("in_the_large"), F.count(F.lit(1)).alias("n"))


def calibration_bins(scores: DataFrame, bins: int = 10, tie: str = "member_id") -> DataFrame:
    """Equal-count bins of the rows by prediction, larger bins first (WI8, AD25).

    Rows are numbered inside ranges of the prediction, and the rows of earlier ranges added.
    """
    parts = ordered_parts(scores, "predicted")
    inside = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("predicted", tie)))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    total = scores.agg(F.count(F.lit(1)).alias("total"))
    rows = inside.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))  # a row per range; one row
    i, n = F.col("before") + F.col("place") - 1, F.col("total")
    small, extra = F.floor(n / bins), n % bins
    edge = extra * (small + 1)
    number = F.when(i < edge, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - edge) / F.greatest(small, F.lit(1)))) + 1
    return rows.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg("outcome").alias("observed_rate"))


def subgroup_calibration(scores: DataFrame, attribute: str, threshold: int = 30, least_expected: float = 5.0) -> DataFrame:
    """Observed over expected by subgroup, withheld where few (VA1, AG13)."""
    out = scores.groupBy(F.col(attribute).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("observed"), F.sum("predicted").alias("expected"))
    return out.withColumn("ratio", F.try_divide(F.col("observed"), F.col("expected"))).withColumn("reason", suppression_reason(F.col("n"), threshold, F.col("expected"), least_expected))


def single_valued(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """The attribute of each key that has just one value (VA2)."""
    return rows.groupBy(key).agg(F.min(attribute).alias(attribute), F.count_distinct(attribute).alias("values")).where("values = 1").drop("values")


def correlations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation (VA3)."""
    ra = average_ranks(rows, a).select(F.col("value").alias(a), F.col("average_rank").alias("ra"))
    rb = average_ranks(rows, b).select(F.col("value").alias(b), F.col("average_rank").alias("rb"))
    return rows.join(ra, a).join(rb, b).agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    """Linear quantiles 0.25, 0.5 and 0.75 (VA3, VA5)."""
    return rows.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def sensitivity(before: DataFrame, after: DataFrame) -> DataFrame:
    """How ratios move between two fits: rank correlation and largest change (VA4)."""
    both = before.select("judge_id", F.col("ratio").alias("a")).join(after.select("judge_id", F.col("ratio").alias("b")), "judge_id")
    return correlations(both, "a", "b").crossJoin(both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_change"), F.count(F.lit(1)).alias("judges")))  # one row each


def interval_stability(intervals: DataFrame) -> DataFrame:
    """Quartiles of interval widths and the share of intervals without 1 (VA5)."""
    width = intervals.select((F.col("high") - F.col("low")).alias("width"), ((F.col("low") > 1) | (F.col("high") < 1)).cast("double").alias("excludes"))
    return quartiles(width, "width").crossJoin(width.agg(F.avg("excludes").alias("share_excluding_one")))  # one row each


def coefficient_stability(replicates: DataFrame) -> DataFrame:
    """Mean, deviation and share of equal sign of each coefficient over replicates (AD26)."""
    sign = F.signum("value") == F.signum("estimate")
    return replicates.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.avg(sign.cast("double")).alias("same_sign"))


def by_year(scores: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Observed rate and mean prediction of each year, and the set it lies in (VA6)."""
    rows = scores.crossJoin(F.broadcast(cutoff)).withColumn("test", F.unix_micros("index_at") >= F.col("cutoff"))  # one row
    out = rows.groupBy(F.year("index_at").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("observed"), F.avg("predicted").alias("predicted"), F.bool_and("test").alias("all_test"), F.bool_or("test").alias("any_test"))
    return out.select("year", "n", "observed", "predicted", F.when(F.col("all_test"), "test").when(F.col("any_test"), "both").otherwise("train").alias("part"))


def recovery(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimates against planted effects: coverage of intervals and agreement of sides (VA7)."""
    both = estimates.join(truth, "judge_id")
    inside = (F.col("low") <= F.col("effect")) & (F.col("effect") <= F.col("high"))
    side = F.signum(F.col("ratio") - 1) == F.signum(F.col("effect") - 1)
    return both.agg(F.count(F.lit(1)).alias("judges"), F.avg(inside.cast("double")).alias("coverage"), F.avg(side.cast("double")).alias("sign_agreement"))


def column_profile(table: DataFrame) -> DataFrame:
    """Per column: nulls, distinct values, smallest and largest as text, in one pass (VA8)."""
    text = [F.col(c).cast("string") for c in table.columns]
    aggs = [x for c, t in zip(table.columns, text) for x in (F.count_if(t.isNull()).alias(f"{c}__n"), F.count_distinct(t).alias(f"{c}__d"), F.min(t).alias(f"{c}__a"), F.max(t).alias(f"{c}__b"))]
    stack = ", ".join(f"'{c}', `{c}__n`, `{c}__d`, `{c}__a`, `{c}__b`" for c in table.columns)
    return table.agg(*aggs).select(F.expr(f"stack({len(table.columns)}, {stack}) AS (column_name, nulls, distinct_values, low, high)"))


def key_profile(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """How many outer keys have k distinct inner ones (VA9)."""
    return rows.groupBy(outer).agg(F.count_distinct(inner).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("keys"))


def anomalies(rows: DataFrame, column: str, early: str, late: str, parsed) -> DataFrame:
    """Counts of dates before and after bounds and of text that is no date (VA10)."""
    d = parsed(F.col(column))
    return rows.agg(F.count_if(d < F.lit(early).cast("date")).alias("early"), F.count_if(d > F.lit(late).cast("date")).alias("late"), F.count_if(F.col(column).isNotNull() & d.isNull()).alias("unparseable"))


def examples(rows: DataFrame, column: str, parsed, limit: int = 5) -> DataFrame:
    """The commonest texts that are no date (VA10): a report of a few."""
    return rows.where(F.col(column).isNotNull() & parsed(F.col(column)).isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(limit)


def stratified_excerpt(rows: DataFrame, strata: str, key: str) -> DataFrame:
    """The first case of each stratum (VA11)."""
    return rows.groupBy(strata).agg(F.min(key).alias(key))


def findings(rows: DataFrame) -> DataFrame:
    """Findings by code, artifact and detail (MS22)."""
    return rows.groupBy("code", "artifact", "detail").agg(F.count(F.lit(1)).alias("n"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables of one shape in one (ST1)."""
    return reduce(DataFrame.unionByName, parts)
