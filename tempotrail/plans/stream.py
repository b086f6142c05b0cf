"""Queries of the streaming extension, on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model
from tempotrail.streaming import passages as op


@query("ext_window_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS hundredths FROM events GROUP BY 1, 2")
def ext_window_counts(m: Model) -> DataFrame:
    return op.windowed_counts(m.table("events"))


@query("ext_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s")
def ext_sessions(m: Model) -> DataFrame:
    return op.runs(m.table("events"))
