"""Oracle SQL for limiter and stream jobs (the limiter as a recursive CTE)."""

from oracle.adapters import FIN, SID, with_views
from oracle.sql_identity import ATTEMPTS, REQS, UPDATES, parse_int

DAY_US, WEEK_US = "86400000000", "604800000000"


def limiter(hits_sql: str, cols: str = "") -> str:
    """Greedy sliding log per key: expire entries <= t - window, admit while < max."""
    extra = (", " + cols) if cols else ""
    return f"""
WITH RECURSIVE h AS (
  SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY key ORDER BY epoch_us(ts), id) AS rn FROM ({hits_sql}) x),
r AS (
  SELECT key, rn, id, ts, w, m{extra}, true AS admitted, [t] AS log FROM h WHERE rn = 1
  UNION ALL
  SELECT h.key, h.rn, h.id, h.ts, h.w, h.m{(", " + ", ".join("h." + c.strip() for c in cols.split(","))) if cols else ""},
         len(list_filter(r.log, lambda x: x > h.t - h.w)) < h.m,
         CASE WHEN len(list_filter(r.log, lambda x: x > h.t - h.w)) < h.m
              THEN list_append(list_filter(r.log, lambda x: x > h.t - h.w), h.t)
              ELSE list_filter(r.log, lambda x: x > h.t - h.w) END
  FROM r JOIN h ON h.key = r.key AND h.rn = r.rn + 1)"""


REQUESTS = """SELECT *, CASE WHEN event_type = 'signup' THEN 'new_session' WHEN event_type = 'click' THEN 'message'
    WHEN event_type = 'purchase' THEN 'report' WHEN event_type = 'error' THEN 'admin_login'
    WHEN user_id % 10 = 0 THEN 'webhook' WHEN user_id % 10 = 1 THEN 'health' ELSE 'read' END AS route,
    CASE WHEN event_type IN ('click', 'purchase') THEN 's' ELSE 'ip' END || CAST(user_id AS VARCHAR) AS caller FROM events"""

SQL = {
    "admission_limit": limiter(
        "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts, 86400000000 AS w, 3 AS m FROM events") + """
SELECT key, id, ts, admitted FROM r""",
    "stream_admission_limit": limiter(
        "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts, 86400000000 AS w, 3 AS m FROM events") + """
SELECT key, id, ts, admitted FROM r""",
    # Limits of the product's routes: new sessions 5 a day, messages 20 a minute, reports 2 in half a minute, public
    # reads and webhook calls 120 a minute, admin logins 5 a minute; any other route is free.
    "limit_policies": limiter(f"""
SELECT route, prefix || caller AS key, event_id AS id, ts, w, m FROM ({REQUESTS}) e
JOIN (VALUES ('new_session', 'newsess:', 86400000000, 5), ('message', 'msg:', 60000000, 20),
             ('report', 'report:', 30000000, 2), ('read', 'report:', 60000000, 120),
             ('admin_login', 'adminlogin:', 60000000, 5), ('webhook', 'tgwebhook:', 60000000, 120))
     p(r, prefix, w, m) ON p.r = e.route""", "route") + f"""
SELECT route, key, id, ts, admitted FROM r
UNION ALL SELECT route, NULL, event_id, ts, true FROM ({REQUESTS}) e WHERE route = 'health'""",
    "ingest_messages": with_views(["messages"], "SELECT * FROM messages"),
    "ingest_sessions": f"""
WITH {REQS.strip()},
x AS (SELECT *, trim(coalesce(nickname, '')) AS nick, {parse_int('grade')} AS g,
             (age IS NULL OR age = '') AS age_blank, {parse_int('age')} AS a FROM reqs)
SELECT request_id AS id, nick AS nickname, g AS grade, CASE WHEN NOT age_blank THEN a END AS age,
       nullif(substr(trim(coalesce(goal, '')), 1, 300), '') AS goal,
       nullif(substr(trim(coalesce(notes, '')), 1, 500), '') AS notes,
       md5('req-' || CAST(request_id AS VARCHAR)) AS session_token, 'active' AS status
FROM x
WHERE coalesce(consent, false) AND nick <> '' AND length(nick) <= 60 AND g BETWEEN 1 AND 4
  AND (age_blank OR a BETWEEN 3 AND 18)""",
    "ingest_delivery_updates": f"""
WITH u AS (
  SELECT l_orderkey AS update_id, l_partkey AS chat_id,
         CASE l_suppkey % 4 WHEN 0 THEN md5({SID}) WHEN 1 THEN md5({SID}) WHEN 2 THEN NULL
              ELSE md5('gone-' || {SID}) END AS token,
         {FIN} + INTERVAL 2 HOUR AS ts, l_returnflag, l_linenumber
  FROM lineitem WHERE l_linestatus = 'F')
SELECT update_id, chat_id, token, ts FROM u WHERE l_returnflag <> 'R'
UNION ALL SELECT update_id, chat_id, token, ts + INTERVAL 1 DAY FROM u WHERE l_returnflag = 'N' AND l_linenumber = 1""",
    "webhook_match": with_views(["reports"], f"""
SELECT u.update_id, u.token, r.share_token IS NOT NULL AS found, r.session_id, u.ts
FROM (
  SELECT l_orderkey AS update_id,
         CASE l_suppkey % 4 WHEN 0 THEN md5({SID}) WHEN 1 THEN md5({SID}) WHEN 2 THEN NULL
              ELSE md5('gone-' || {SID}) END AS token,
         {FIN} + INTERVAL 2 HOUR AS ts
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R'
  UNION ALL
  SELECT l_orderkey,
         CASE l_suppkey % 4 WHEN 0 THEN md5({SID}) WHEN 1 THEN md5({SID}) WHEN 2 THEN NULL
              ELSE md5('gone-' || {SID}) END,
         {FIN} + INTERVAL 2 HOUR + INTERVAL 1 DAY
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N' AND l_linenumber = 1) u
LEFT JOIN reports r ON r.share_token = u.token
WHERE u.token IS NOT NULL"""),
    "delivery_replies": with_views(["reports"], f"""
SELECT update_id, chat_id, token, CASE WHEN token IS NULL THEN 'help' WHEN r.share_token IS NULL THEN 'not found'
       ELSE 'delivered' END AS outcome, r.session_id, ts
FROM (
  SELECT update_id, chat_id, token, ts + INTERVAL 1 DAY * again AS ts
  FROM (SELECT l_orderkey AS update_id, l_partkey AS chat_id, l_returnflag, l_linenumber,
               CASE WHEN l_suppkey % 4 < 2 THEN md5({SID}) WHEN l_suppkey % 4 = 3 THEN md5('gone-' || {SID}) END AS token,
               {FIN} + INTERVAL 2 HOUR AS ts
        FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R') first
  CROSS JOIN (VALUES (0), (1)) a(again)
  WHERE again = 0 OR (l_returnflag = 'N' AND l_linenumber = 1)) u
LEFT JOIN reports r ON r.share_token = u.token"""),
    "stream_first_report": f"""
WITH {ATTEMPTS.strip()}
SELECT session_id, arg_min(share_token, (created_at, share_token)) AS share_token, min(created_at) AS created_at,
       CAST(count(*) AS BIGINT) AS attempts
FROM a GROUP BY session_id""",
    "stream_delivery": with_views(["reports"], """
SELECT r.session_id, r.share_token, r.delivered OR d.token IS NOT NULL AS delivered,
       coalesce(r.delivered_at, d.at) AS delivered_at
FROM reports r LEFT JOIN (SELECT token, min(ts) AS at FROM upd WHERE token IS NOT NULL GROUP BY token) d
  ON d.token = r.share_token""", extra=[UPDATES]),
    "stream_session_state": f"""
SELECT {SID} AS session_id, CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS BIGINT) AS turns,
       CAST(sum(100) AS BIGINT) AS input_tokens, CAST(sum(200) AS BIGINT) AS output_tokens,
       bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 0) AS done_mantiq,
       bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 1) AS done_psixologiya,
       bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 2) AS done_harakat
FROM lineitem GROUP BY 1""",
    "stream_funnel": with_views(["funnel_events"], f"""
SELECT make_timestamp(CAST(floor(epoch_us(ts) / us) AS BIGINT) * us) AS window_start,
       make_timestamp(CAST(floor(epoch_us(ts) / us) AS BIGINT) * us + us) AS window_end,
       metric, CAST(count(*) AS BIGINT) AS n
FROM funnel_events CROSS JOIN (VALUES ({DAY_US}), ({WEEK_US})) w(us) GROUP BY 1, 2, 3"""),
}
