"""The two streaming aggregates over the events table, run until nothing is left."""

from __future__ import annotations

from sparkrecon.plans.lineage import scratch_path
from sparkrecon.queries.registry import registrar
from sparkrecon.streaming import status as S

QUERIES: dict = {}
query = registrar(QUERIES)


def finished(t, build, label: str, key: str):
    """Run ``build`` over a stream of events and return the rows it ended with."""
    stream = S.read_stream(t.spark, t.path("events"), t.events.schema)
    path = scratch_path(t.spark, label)
    S.run_available(build(stream), path, key)
    return S.current_rows(t.spark, path)


@query(
    "latest_status",
    """SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS msg FROM events GROUP BY 1""",
)
def latest_status(t):
    return finished(t, lambda s: S.latest_status(s, "user_id", "ts", "event_id", "event_type"), "latest", "user_id")


@query("running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def running_counts(t):
    return finished(t, lambda s: S.running_counts(s, "event_type"), "counts", "event_type")
