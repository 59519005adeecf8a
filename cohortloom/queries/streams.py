"""Streaming queries: each drains the event files and returns what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _folder(spark) -> str:
    """A new folder in the shared place of the session."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drain(spark, rows):
    at = _folder(spark)
    ev.run_to_table(rows, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("st_deduplicated_events", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def st1(spark, sf_dir):
    """Deduplication within the watermark."""
    return _drain(spark, ev.deduplicated(ev.read_events(spark, sf_dir), "60 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st_tumbling_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def st2(spark, sf_dir):
    """Tumbling windows of a day, those that the watermark has not closed included."""
    at = _folder(spark)
    rows = ev.tumbling_counts(ev.read_events(spark, sf_dir))
    ev.run_to_result(rows, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select(F.to_date("window_start").alias("day"), "event_type", "n")


@query("st_follow_up", "SELECT i.event_id AS index_id, o.event_id AS outcome_id FROM events i JOIN events o ON o.user_id = i.user_id AND o.ts > i.ts AND o.ts <= i.ts + INTERVAL 3 DAY WHERE i.event_type = 'signup' AND o.event_type = 'error'")
def st3(spark, sf_dir):
    """Outcomes in a follow-up window, as a stream-stream interval join."""
    return _drain(spark, ev.follow_up(ev.read_events(spark, sf_dir), "signup", "error", 3, "40 days")).select("index_id", "outcome_id")


@query("st_impacted_users", "SELECT CAST(user_id % 10 AS VARCHAR) AS subject_id, count(*) AS n FROM events GROUP BY ALL")
def st4(spark, sf_dir):
    """Batches recompute the subjects they touch, from all rows stored so far."""
    at = _folder(spark)
    count = lambda rows: rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    ev.recompute_impacted(ev.read_events(spark, sf_dir), at, (F.col("user_id") % 10).cast("string"), count, f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("n long, subject_id string").parquet(f"{at}/subjects").select("subject_id", "n")


@query("st_right_censored", "SELECT i.event_id AS index_id, i.ts + INTERVAL 3 DAY < (SELECT max(ts) FROM events) AS followed, count(o.event_id) AS outcomes FROM events i LEFT JOIN events o ON o.user_id = i.user_id AND o.event_type = 'error' AND o.ts > i.ts AND o.ts <= i.ts + INTERVAL 3 DAY WHERE i.event_type = 'signup' GROUP BY ALL")
def st5(spark, sf_dir):
    """Follow-up with right-censoring: index events whose window the coverage does not reach are told apart."""
    at, stream = _folder(spark), ev.read_events(spark, sf_dir)
    pairs = _drain(spark, ev.follow_up(stream, "signup", "error", 3, "40 days"))
    ev.run_to_table(stream, f"{at}/rows", f"{at}/checkpoint")
    return ev.censored(spark.read.schema(stream.schema).parquet(f"{at}/rows"), pairs, "signup", 3)
