"""Oracle SQL for the rubric jobs."""

ANS = """
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
           WHERE event_type IN ('click', 'view', 'purchase')),
ans AS (
  SELECT user_id AS session_id,
         CASE event_type WHEN 'click' THEN 'mantiq' WHEN 'view' THEN 'psixologiya' ELSE 'harakat' END AS track,
         CASE WHEN event_type = 'click' THEN ['pattern', 'count', 'compare', 'language'][k % 4 + 1]
              WHEN event_type = 'view' THEN ['riasec', 'growth', 'self_control', 'feelings'][k % 4 + 1]
              WHEN k % 2 = 0 THEN 'preference' ELSE 'mini_task' END AS kind,
         CASE WHEN event_type = 'view' AND k % 4 = 0 THEN substr('RIASEC', k % 6 + 1, 1) END AS riasec_letter,
         CASE WHEN event_type = 'click' THEN value >= 20 END AS correct
  FROM e)
"""

SQL = {
    "riasec_top2": ANS + """
SELECT session_id, riasec_letter AS letter, n, rank FROM (
  SELECT session_id, riasec_letter, CAST(count(*) AS BIGINT) AS n,
         CAST(row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, instr('RIASEC', riasec_letter)) AS BIGINT) AS rank
  FROM ans WHERE riasec_letter IS NOT NULL GROUP BY session_id, riasec_letter) x
WHERE rank <= 2 AND n >= 2""",
    "logic_level": ANS + """
SELECT session_id, tasks, correct,
       CASE WHEN correct / tasks < 0.5 THEN 'shakllanmoqda' WHEN correct / tasks >= 0.9 THEN 'kuchli' ELSE 'meyorda' END AS level
FROM (SELECT session_id, CAST(count(*) AS BIGINT) AS tasks, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct
      FROM ans WHERE track = 'mantiq' GROUP BY session_id) x""",
    "track_coverage": ANS + """
SELECT session_id, logic_tasks, logic_kinds,
       logic_tasks >= 5 AND logic_kinds >= 3 AND language >= 1 AS mantiq_ok,
       riasec >= 3 AND growth >= 2 AND self_control >= 1 AND feelings >= 1 AS psixologiya_ok,
       preference >= 2 AND mini_task >= 2 AS harakat_ok,
       logic_tasks >= 5 AND logic_kinds >= 3 AND language >= 1 AND riasec >= 3 AND growth >= 2
         AND self_control >= 1 AND feelings >= 1 AND preference >= 2 AND mini_task >= 2 AS all_ok
FROM (SELECT session_id,
        CAST(count(*) FILTER (WHERE track = 'mantiq') AS BIGINT) AS logic_tasks,
        CAST(count(DISTINCT CASE WHEN track = 'mantiq' THEN kind END) AS BIGINT) AS logic_kinds,
        count(*) FILTER (WHERE track = 'mantiq' AND kind = 'language') AS language,
        count(*) FILTER (WHERE kind = 'riasec') AS riasec, count(*) FILTER (WHERE kind = 'growth') AS growth,
        count(*) FILTER (WHERE kind = 'self_control') AS self_control, count(*) FILTER (WHERE kind = 'feelings') AS feelings,
        count(*) FILTER (WHERE kind = 'preference') AS preference, count(*) FILTER (WHERE kind = 'mini_task') AS mini_task
      FROM ans GROUP BY session_id) x""",
}
