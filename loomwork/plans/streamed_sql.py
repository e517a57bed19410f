"""SQL, for DuckDB, of the queries in `streamed`."""

from .streamed import DELAY, GAP, SITTINGS

_N = "(SELECT count(*) FROM events)"
_US = "epoch_us(ts)"
SQL = {
    "sessions_with_late_rows": f"""WITH e AS (SELECT user_id, {_US} AS us, CAST(round(value * 100) AS BIGINT) AS cents, greatest(0, least({SITTINGS - 1}, CAST(floor((event_id + CASE WHEN event_id % 37 = 5 THEN 100000000 ELSE 0 END) * {SITTINGS} / {_N}) AS BIGINT))) AS k FROM events),
m AS (SELECT k, max(max(us)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY} AS mark FROM e GROUP BY k),
x AS (SELECT e.*, coalesce(us < mark, false) AS late FROM e JOIN m USING (k)),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {GAP} THEN 0 ELSE 1 END AS new FROM x WHERE NOT late),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g),
r AS (SELECT user_id, min(us) AS first_at, max(us) AS last_at, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY user_id, session)
SELECT CASE WHEN last_at + {GAP} <= (SELECT max(us) FROM e) - {DELAY} THEN 'closed' ELSE 'open' END AS kind, * FROM r
UNION ALL SELECT 'late', user_id, us, us, 1, cents FROM x WHERE late""",
    "first_events_of_a_stream": """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY""",
    "events_written_once": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type",
}
