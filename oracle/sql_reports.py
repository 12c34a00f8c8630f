"""Oracle SQL for the report jobs.

The expected parse is computed from the columns the replies were rendered
from (per fence variant), not by parsing the rendered text.
"""

from oracle.adapters import NL, SID, with_views

LVL = ("CASE {c} WHEN 'kuchli' THEN '\"KUCHLI daraja\"' WHEN 'meyorda' THEN '\"Me''yorda\"' "
       "WHEN 'shakllanmoqda' THEN '\"Shakllanmoqda\"' ELSE 'null' END")
SPORTS_JSON = "'[' || coalesce(array_to_string(list_transform(sports, lambda x: '\"' || x || '\"'), ', '), '') || ']'"
GOOD = ("'{\"levels\": {\"mantiq\": ' || " + LVL.format(c="level_logic") + " || ', \"psixologiya\": ' || "
        + LVL.format(c="level_psych") + " || ', \"harakat\": ' || " + LVL.format(c="level_activity")
        + " || '}, \"sports\": ' || " + SPORTS_JSON + " || '}'")
PRE = (f"'## Xulosa' || {NL} || 'Mashg''ulot ' || session_id || ' yakunlandi.' || {NL} || {NL} || "
       f"'## Kuchli tomonlar' || {NL} || '- **Mantiq** — ' || coalesce(level_logic, '-') || {NL} || "
       f"'- **Psixologiya** — ' || coalesce(level_psych, '-') || {NL} || {NL} || '## Tavsiyalar' || {NL} || "
       f"'1. Kitob o''qish' || {NL} || '2. Sport: ' || coalesce(array_to_string(sports, ', '), '') || {NL} || 'Rahmat!'")
FIRST = f"'```json' || {NL} || '{{\"levels\": {{\"mantiq\": \"kuchli\"}}, \"sports\": [\"X\"]}}' || {NL} || '```'"
GOOD_FENCE = f"'```json' || {NL} || {GOOD} || {NL} || '```'"

RR = f"""
rr AS (
  SELECT r.*, v.variant FROM reports r
  JOIN (SELECT {SID} AS sid, l_suppkey % 7 AS variant FROM lineitem WHERE l_linestatus = 'F') v
    ON v.sid = r.session_id)"""

PR = f"""
pr AS (
  SELECT session_id, child_id, partial,
    CASE variant WHEN 1 THEN {PRE} || ' ' || {NL} || {FIRST}
                 WHEN 2 THEN {PRE} || ' ' || {NL} || {GOOD_FENCE}
                 ELSE {PRE} END AS content_md,
    CASE WHEN variant IN (0, 1, 4, 6) THEN level_logic END AS level_logic,
    CASE WHEN variant IN (0, 1, 4, 6) THEN level_psych END AS level_psych,
    CASE WHEN variant IN (0, 1, 4, 6) THEN level_activity END AS level_activity,
    CASE WHEN variant IN (0, 1, 4, 5) THEN sports ELSE []::VARCHAR[] END AS sports
  FROM rr)"""

SECTIONS = f"""
SELECT session_id, CAST(ord AS BIGINT) AS ord, split_part(chunk, {NL}, 1) AS heading,
       substr(chunk, length(split_part(chunk, {NL}, 1)) + 2) || CASE WHEN ord < n THEN {NL} ELSE '' END AS body
FROM (SELECT session_id, unnest(chunks[2:]) AS chunk, generate_subscripts(chunks[2:], 1) AS ord, len(chunks) - 1 AS n
      FROM (SELECT session_id, string_split({NL} || content_md, {NL} || '## ') AS chunks FROM pr) a) b"""

BUL = "^- \\*\\*(.+?)\\*\\* — (.*)$"
NUM = "^([0-9]+)\\. (.*)$"
W = "PARTITION BY child_id ORDER BY created_at, session_id"
RANK = "CASE {c} WHEN 'shakllanmoqda' THEN 1 WHEN 'meyorda' THEN 2 WHEN 'kuchli' THEN 3 END"


def marker(track: str) -> str:
    return f"coalesce(regexp_matches(content, '(?i)\\[YAKUN:\\s*{track}\\s*\\]'), false)"


SQL = {
    "parse_report": with_views(["reports"], """
SELECT session_id, content_md, level_logic, level_psych, level_activity,
       array_to_string(sports, ',') AS sports, CAST(len(sports) AS BIGINT) AS n_sports FROM pr""", extra=[RR, PR]),
    "report_sections": with_views(["reports"], SECTIONS, extra=[RR, PR]),
    "report_bullets": with_views(["reports"], f"""
SELECT session_id, section, CAST(line_no AS BIGINT) AS line_no,
       CASE WHEN regexp_matches(line, '{BUL}') THEN 'bullet' ELSE 'numbered' END AS kind,
       CASE WHEN regexp_matches(line, '{BUL}') THEN regexp_extract(line, '{BUL}', 1) ELSE regexp_extract(line, '{NUM}', 1) END AS name,
       CASE WHEN regexp_matches(line, '{BUL}') THEN regexp_extract(line, '{BUL}', 2) ELSE regexp_extract(line, '{NUM}', 2) END AS text
FROM (SELECT session_id, ord AS section, unnest(string_split(body, {NL})) AS line,
             generate_subscripts(string_split(body, {NL}), 1) AS line_no FROM s) x
WHERE regexp_matches(line, '{BUL}') OR regexp_matches(line, '{NUM}')""", extra=[RR, PR, "s AS (" + SECTIONS + ")"]),
    "child_facing_cards": with_views(["messages"], """
SELECT session_id, id, CAST(card_no AS BIGINT) AS card_no, card FROM (
  SELECT session_id, id, unnest(regexp_extract_all(content, '(?m)^>[ \\t]?(.*)$', 1)) AS card,
         generate_subscripts(regexp_extract_all(content, '(?m)^>[ \\t]?(.*)$', 1), 1) AS card_no
  FROM messages WHERE role = 'assistant') x"""),
    "adult_text": with_views(["messages"], """
SELECT session_id, id, array_to_string(list_filter(string_split(coalesce(content, ''), chr(10)),
       lambda x: NOT starts_with(x, '>')), chr(10)) AS adult_text
FROM messages WHERE role = 'assistant'"""),
    "greeting_audit": with_views(["messages"], r"""
SELECT *, greeting_ok AND has_card AND no_early_marker AS ok FROM (
  SELECT session_id, CAST(length(content) AS BIGINT) AS greeting_chars, length(content) > 50 AS greeting_ok,
         regexp_matches(content, '(?m)^>') AS has_card, NOT regexp_matches(content, '(?i)\[YAKUN:') AS no_early_marker
  FROM (SELECT session_id, coalesce(content, '') AS content FROM messages WHERE role = 'assistant'
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) = 1) AS first) AS checks"""),
    "report_quality_audit": with_views(["reports"], r"""
SELECT *, body_ok AND sections_ok AND partial_ok AND not_all_kuchli AND no_marker_left AS ok FROM (
  SELECT session_id, CAST(length(content_md) AS BIGINT) AS body_chars,
         CAST(len(regexp_extract_all(content_md, '(?m)^## ')) AS BIGINT) AS sections,
         length(content_md) > 400 AS body_ok, len(regexp_extract_all(content_md, '(?m)^## ')) >= 3 AS sections_ok,
         NOT partial OR level_logic IS NULL OR level_psych IS NULL OR level_activity IS NULL AS partial_ok,
         NOT coalesce(level_logic = 'kuchli' AND level_psych = 'kuchli' AND level_activity = 'kuchli', false) AS not_all_kuchli,
         NOT coalesce(regexp_matches(content_md, '(?i)\[YAKUN:'), false) AS no_marker_left
  FROM pr) AS checks""", extra=[RR, PR]),
    "premature_markers": with_views(["messages"], f"""
SELECT p.session_id, g.real_answers, p.done_mantiq, p.done_psixologiya, p.done_harakat
FROM (SELECT session_id, bool_or({marker('MANTIQ')}) AS done_mantiq, bool_or({marker('PSIXOLOGIYA')}) AS done_psixologiya,
             bool_or({marker('HARAKAT')}) AS done_harakat FROM messages WHERE role = 'assistant' GROUP BY session_id) p
JOIN (SELECT session_id, CAST(count(*) FILTER (WHERE role = 'user' AND NOT meta AND session_id % 5 <> 0) AS BIGINT) AS real_answers
      FROM messages GROUP BY session_id) g ON g.session_id = p.session_id
WHERE (p.done_mantiq OR p.done_psixologiya OR p.done_harakat) AND g.real_answers = 0"""),
    "first_report_wins": f"""
WITH a AS (
  SELECT {SID} AS session_id, md5({SID}) AS share_token,
         l_shipdate + to_minutes(CAST(l_quantity AS INTEGER)) AS created_at
  FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL
  SELECT {SID}, md5('retry-' || {SID}),
         l_shipdate + to_minutes(CAST(l_quantity AS INTEGER)) - CASE WHEN l_linenumber % 2 = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A')
SELECT session_id, arg_min(share_token, (created_at, share_token)) AS share_token, min(created_at) AS created_at,
       CAST(count(*) AS BIGINT) AS attempts
FROM a GROUP BY session_id""",
    "progress_timeline": with_views(["reports"], f"""
SELECT child_id, session_id, created_at, CAST(row_number() OVER ({W}) AS BIGINT) AS seq, level_logic,
       lag(level_logic) OVER ({W}) AS prev_level_logic,
       CAST({RANK.format(c='level_logic')} - {RANK.format(c=f'lag(level_logic) OVER ({W})')} AS INTEGER) AS level_delta
FROM reports"""),
    "reassessment_due": with_views(["parents", "children", "sessions"], """
SELECT p.id AS parent_id, p.name, max(s.finished_at) AS last_finished_at
FROM parents p JOIN children c ON c.parent_id = p.id JOIN sessions s ON s.child_id = c.id
WHERE p.marketing_consent AND s.finished_at IS NOT NULL
GROUP BY p.id, p.name
HAVING max(s.finished_at) <= TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 3 MONTH"""),
}
