"""Oracle SQL for the metric jobs."""

from oracle.adapters import with_views

WEEK_US = "604800000000.0"


def _bucket_ctes(source_cte: str, as_of: str) -> list[str]:
    a = f"TIMESTAMP '{as_of}'"
    return [f"""
b AS (
  SELECT metric, CAST(floor((epoch_us({a}) - epoch_us(ts)) / {WEEK_US}) AS BIGINT) AS wk
  FROM {source_cte}
  WHERE ts IS NOT NULL AND ts >= {a} - INTERVAL 28 DAY)""", "spine AS (SELECT range AS wk FROM range(4))"]


BUCKET_SELECT = """
SELECT spine.wk,
  CAST(count(b.metric) FILTER (WHERE b.metric = 'started') AS BIGINT) AS started,
  CAST(count(b.metric) FILTER (WHERE b.metric = 'finished') AS BIGINT) AS finished,
  CAST(count(b.metric) FILTER (WHERE b.metric = 'contact') AS BIGINT) AS contact,
  CAST(count(b.metric) FILTER (WHERE b.metric = 'delivered') AS BIGINT) AS delivered
FROM spine LEFT JOIN b ON b.wk = spine.wk
GROUP BY spine.wk"""


ENTITY_EVENTS = """
ev AS (
  SELECT 'started' AS metric, started_at AS ts FROM sessions
  UNION ALL SELECT 'finished', finished_at FROM sessions
  UNION ALL SELECT 'contact', consented_at FROM parents
  UNION ALL SELECT 'delivered', delivered_at FROM reports)"""


def _funnel(views, source, as_of, extra=()):
    return with_views(views, BUCKET_SELECT, extra=list(extra) + _bucket_ctes(source, as_of))


WEEKLY_FUNNEL = _funnel(["funnel_events"], "funnel_events", "2024-01-31 00:00:00")

SQL = {
    "weekly_funnel": WEEKLY_FUNNEL,
    "weekly_funnel_entities": _funnel(["sessions", "parents", "reports"], "ev", "2001-11-05 00:00:00",
                                      extra=[ENTITY_EVENTS]),
    "funnel_conversion": f"""
SELECT wk, started, finished, contact, delivered,
  CASE WHEN started > 0 THEN CAST(finished AS DOUBLE) / started END AS finish_rate,
  CASE WHEN finished > 0 THEN CAST(contact AS DOUBLE) / finished END AS contact_rate,
  CASE WHEN contact > 0 THEN CAST(delivered AS DOUBLE) / contact END AS delivery_rate
FROM ({WEEKLY_FUNNEL}) f""",
    "token_totals": with_views(["sessions"], """
SELECT CAST(count(*) AS BIGINT) AS sessions,
  CAST(count(*) FILTER (WHERE finished_at IS NOT NULL) AS BIGINT) AS finished,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
FROM sessions"""),
    "cost_estimate": with_views(["sessions"], """
SELECT sessions, finished, input_tokens, output_tokens,
  floor(raw * 100 + 0.5) / 100 AS est_usd,
  CASE WHEN finished > 0 THEN floor(raw / finished * 100 + 0.5) / 100 END AS per_finished_usd
FROM (SELECT *, input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0 AS raw FROM t) x""", extra=["""
t AS (SELECT CAST(count(*) AS BIGINT) AS sessions,
  CAST(count(*) FILTER (WHERE finished_at IS NOT NULL) AS BIGINT) AS finished,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM sessions)"""]),
    "ops_finished_per_day": with_views(["sessions"], """
SELECT CAST(finished_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS finished
FROM sessions WHERE finished_at IS NOT NULL GROUP BY 1"""),
    "ops_avg_tokens": with_views(["sessions"], """
SELECT model, CAST(count(*) AS BIGINT) AS sessions,
  CAST(sum(input_tokens) AS DOUBLE) / count(input_tokens) AS avg_input_tokens,
  CAST(sum(output_tokens) AS DOUBLE) / count(output_tokens) AS avg_output_tokens,
  CAST(sum(input_tokens + output_tokens) AS DOUBLE) / count(*) AS avg_total_tokens
FROM sessions GROUP BY model"""),
    "ops_delivery_rate": with_views(["reports"], """
SELECT CAST(count(*) AS BIGINT) AS reports,
  CAST(count(*) FILTER (WHERE delivered) AS BIGINT) AS delivered,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE delivered) AS DOUBLE) / count(*) END AS delivery_rate
FROM reports"""),
    "by_prompt_version_model": with_views(["sessions", "reports"], """
SELECT s.prompt_version, s.model, CAST(count(*) AS BIGINT) AS sessions,
  CAST(count(*) FILTER (WHERE s.finished_at IS NOT NULL) AS BIGINT) AS finished,
  CAST(count(*) FILTER (WHERE s.finished_at IS NOT NULL) AS DOUBLE) / count(*) AS finish_rate,
  CAST(sum(s.input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(s.output_tokens) AS BIGINT) AS output_tokens,
  CAST(count(r.level_logic) AS BIGINT) AS reports_with_logic,
  CAST(count(*) FILTER (WHERE r.level_logic = 'kuchli') AS BIGINT) AS logic_kuchli,
  CAST(count(*) FILTER (WHERE r.level_logic = 'meyorda') AS BIGINT) AS logic_meyorda,
  CAST(count(*) FILTER (WHERE r.level_logic = 'shakllanmoqda') AS BIGINT) AS logic_shakllanmoqda
FROM sessions s LEFT JOIN reports r ON r.session_id = s.id
GROUP BY s.prompt_version, s.model"""),
    "token_outliers": with_views(["sessions"], """
SELECT s.id, s.model, s.tokens FROM (
  SELECT id, model, tokens, avg(tokens) OVER by_model AS mean_tokens, stddev_pop(tokens) OVER by_model AS sd_tokens
  FROM (SELECT id, model, input_tokens * CASE WHEN child_id % 97 = 0 THEN 40 ELSE 1 END + output_tokens AS tokens
        FROM sessions) AS t WINDOW by_model AS (PARTITION BY model)) AS s
WHERE s.tokens > s.mean_tokens + 3 * s.sd_tokens"""),
    "level_mix": with_views(["reports"], """
SELECT track, level, CAST(count(*) AS BIGINT) AS reports FROM (
  SELECT 'mantiq' AS track, level_logic AS level FROM reports
  UNION ALL SELECT 'psixologiya', level_psych FROM reports
  UNION ALL SELECT 'harakat', level_activity FROM reports) u
WHERE level IS NOT NULL GROUP BY track, level"""),
    "sport_counts": with_views(["reports"], """
SELECT sport, CAST(count(*) AS BIGINT) AS reports FROM (SELECT unnest(sports) AS sport FROM reports) u
GROUP BY sport"""),
}
