"""Shared-cache audit on ``events``: the key is the event type, the client the user."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import cache as op
from tidemark.plans.registry import query
from tidemark.sources.writers import materialise
from tidemark.streaming import runs, ttl

TTL_US = 6 * op.HOUR_US


def replay_sql(source: str) -> str:
    """Recursive replay: ``source`` yields ``k, us, id, c, private``."""
    return f"""
req AS ({source}), e AS (SELECT * FROM req WHERE NOT private),
fill(k, f) AS (
  SELECT k, min({{'us': us, 'id': id, 'c': c}}) FROM e GROUP BY k
  UNION ALL
  SELECT fill.k, min({{'us': e.us, 'id': e.id, 'c': e.c}}) FROM fill JOIN e
  ON e.k = fill.k AND e.us >= fill.f.us + {TTL_US} GROUP BY fill.k),
flat AS (SELECT k, f.us AS us, f.id AS fid, f.c AS owner FROM fill),
log AS (
  SELECT e.k, e.us, e.id, e.c, CASE WHEN e.id = flat.fid THEN 'MISS' ELSE 'HIT' END AS status, flat.owner
  FROM e ASOF JOIN flat ON e.k = flat.k AND e.us >= flat.us
  UNION ALL SELECT k, us, id, c, 'MISS', c FROM req WHERE private)
"""


BY_TYPE = "SELECT event_type AS k, epoch_us(ts) AS us, event_id AS id, user_id AS c, false AS private FROM events"
LOG_SQL = "WITH RECURSIVE " + replay_sql(BY_TYPE)
RUNS_SQL = LOG_SQL + """
, runs AS (SELECT k, us, id, owner FROM
  (SELECT *, lag(owner) OVER w AS prev, row_number() OVER w AS rn FROM log WHERE status = 'HIT'
   WINDOW w AS (PARTITION BY k ORDER BY us, id)) WHERE rn = 1 OR prev <> owner)
, stretches AS (SELECT k, owner, us, round((nxt - us) / 1e6, 1) AS seconds FROM
  (SELECT *, lead(us) OVER (PARTITION BY k ORDER BY us, id) AS nxt FROM runs) WHERE nxt IS NOT NULL)
"""


def requests(t):
    return op.as_requests(t.events, F.col("event_type"))


def log(t):
    return op.ttl_replay(requests(t), TTL_US)


def written_log(t):
    """The labelled log, written once: operators that read it more than once share one replay."""
    return materialise(log(t), "log")


@query(LOG_SQL + "SELECT k AS cache_key, us, id, c AS client, status, owner FROM log")
def ttl_replay(t):
    return log(t).select("cache_key", "us", "id", "client", "status", "owner")


@query(LOG_SQL + """
SELECT id, k AS cache_key, CASE WHEN c = owner THEN 'own doors' ELSE 'LEAK: ' || owner || '''s doors' END AS verdict
FROM log
""")
def leak_verdict(t):
    return log(t).select("id", "cache_key", op.verdict(F.col("client"), F.col("owner")).alias("verdict"))


@query(LOG_SQL + """
SELECT k AS cache_key, count(*) AS polls, count(*) FILTER (c = owner) AS own, count(*) FILTER (c <> owner) AS foreign_polls,
       round(count(*) FILTER (c <> owner) / count(*), 6) AS foreign_share,
       count(DISTINCT owner) FILTER (c <> owner) AS accounts_exposed
FROM log GROUP BY k
""")
def leak_summary(t):
    return op.leak_summary(log(t), ["cache_key"])


@query(LOG_SQL + "SELECT owner, count(*) AS n FROM log WHERE c <> owner GROUP BY owner")
def leak_by_owner(t):
    return op.leak_by_owner(log(t))


@query(LOG_SQL + "SELECT owner, count(*) AS n FROM log WHERE status = 'MISS' GROUP BY owner")
def origin_answers(t):
    return op.origin_answers(log(t))


@query(RUNS_SQL + "SELECT k AS cache_key, owner, us, id FROM runs")
def owner_runs(t):
    return op.owner_runs(written_log(t))


@query(RUNS_SQL + "SELECT k AS cache_key, owner, us, seconds FROM stretches")
def run_stretches(t):
    return op.run_stretches(op.owner_runs(written_log(t)))


@query(RUNS_SQL + """
SELECT k AS cache_key, count(*) AS runs, count(*) - count(DISTINCT owner) AS repeats FROM runs GROUP BY k
""")
def run_repeats(t):
    return op.run_repeats(op.owner_runs(written_log(t)))


@query(RUNS_SQL + """
SELECT k AS cache_key, count(*) AS stretches, count(*) FILTER (seconds BETWEEN 21600 AND 23400) AS in_band,
       round(count(*) FILTER (seconds BETWEEN 21600 AND 23400) / count(*), 6) AS share
FROM stretches GROUP BY k
""")
def ttl_signature(t):
    return op.ttl_signature(op.run_stretches(op.owner_runs(written_log(t))), 21_600, 1_800)


CLIENT_RUNS_SQL = LOG_SQL + """
, seen AS (SELECT c, us, id, owner, CASE WHEN lag(owner) OVER w IS DISTINCT FROM owner THEN 1 ELSE 0 END AS fresh
           FROM log WINDOW w AS (PARTITION BY c ORDER BY us, id))
, numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY us, id) AS run_no FROM seen)
, compact AS (SELECT c AS client, CAST(run_no AS BIGINT) AS run_no,
                     CASE WHEN any_value(owner) = c THEN 'OWN' ELSE CAST(any_value(owner) AS VARCHAR) END AS account,
                     count(*) AS n FROM numbered GROUP BY c, run_no)
"""


@query(CLIENT_RUNS_SQL + "SELECT client, run_no, account, n FROM compact")
def client_runs(t):
    return op.client_runs(written_log(t))


@query(CLIENT_RUNS_SQL + """
SELECT client, string_agg(account || ' x' || n, ', ' ORDER BY run_no) AS saw FROM compact
WHERE client IN (SELECT DISTINCT c FROM log ORDER BY c LIMIT 3) GROUP BY client
""")
def client_run_summary(t):
    return op.client_run_summary(written_log(t), 3)


POLICY_SQL = "WITH RECURSIVE " + replay_sql("""
SELECT 'key|' || event_type AS k, epoch_us(ts) AS us, event_id AS id, user_id AS c, false AS private FROM events
UNION ALL SELECT 'key and user|' || event_type || '/' || user_id, epoch_us(ts), event_id, user_id, false FROM events
UNION ALL SELECT 'private|' || event_type, epoch_us(ts), event_id, user_id, event_type = 'purchase' FROM events
""")


@query(POLICY_SQL + """
SELECT split_part(k, '|', 1) AS policy, count(*) AS requests, count(*) FILTER (status = 'HIT') AS hits,
       count(*) FILTER (c <> owner) AS leaks FROM log GROUP BY 1
""")
def leak_by_policy(t):
    kind = F.col("event_type")
    return op.leak_by_policy(
        t.events,
        {
            "key": (kind, None),
            "key and user": (F.concat_ws("/", kind, F.col("user_id").cast("string")), None),
            "private": (kind, kind == "purchase"),
        },
        TTL_US,
    )


@query(LOG_SQL + "SELECT k AS cache_key, us, id, c AS client, status, owner FROM log")
def ttl_replay_stream(t):
    requests = op.as_requests(t.events, F.col("event_type"))
    stream = runs.file_stream(t.spark, runs.in_time_order(requests, "us", "requests"), requests.schema, 2)
    return runs.run_append(ttl.ttl_replay_stream(stream, TTL_US), "ttl-replay")


@query("""
SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, event_type AS cache_key, count(*) AS polls,
       count(*) FILTER (user_id <> floor(value)) AS foreign_polls,
       round(count(*) FILTER (user_id <> floor(value)) / count(*), 6) AS foreign_share
FROM events GROUP BY 1, 2
""")
def leak_monitor(t):
    """The response log is the event stream; ``floor(value)`` stands for the account returned."""
    stream = runs.file_stream(t.spark, t.path("events"), t.events.schema).select(
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_type").alias("cache_key"),
        F.col("user_id").alias("client"),
        F.floor("value").alias("owner"),
    )
    seen = runs.run_update(runs.leak_monitor(stream), ["start_us", "cache_key"], "leak-monitor")
    return seen.withColumn("foreign_share", F.round("foreign_share", 6))
