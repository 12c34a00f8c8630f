"""Oracle SQL for the conversation jobs (DuckDB window functions)."""

from oracle.adapters import NL, with_views

M = ["messages"]
CAP = "'Savollar chegarasiga yetdik. Iltimos, mashg‘ulotni yakunlab, hisobotni oling.'"
ROLE = "CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END"
W = "PARTITION BY session_id ORDER BY created_at, id"


def marker(track: str) -> str:
    return f"coalesce(regexp_matches(content, '(?i)\\[YAKUN:\\s*{track}\\s*\\]'), false)"


INTRO = ("'Assalomu alaykum! Yangi mashg''ulotni boshlaymiz. Men bolaning yonidagi katta odamman "
         "(ota-ona yoki o''qituvchi).' || chr(10) || 'Bola haqida:' || chr(10) || '- Ismi: ' || nickname || "
         "chr(10) || '- Sinfi: ' || CAST(grade AS VARCHAR) || '-sinf (' || "
         "(CASE WHEN grade <= 2 THEN 'A' ELSE 'B' END) || ' guruh savollari)' || "
         "(CASE WHEN coalesce(age, 0) <> 0 THEN chr(10) || '- Yoshi: ' || CAST(age AS VARCHAR) ELSE '' END) || "
         "chr(10) || 'Meni qisqa kutib oling, bolaning ismi va sinfini tasdiqlang va darhol birinchi savollar "
         "guruhini bering. Bolaning maqsadi yoki orzusini suhbat davomida o''zimizdan so''rang.'")

SQL = {
    "transcript_order": with_views(M, f"""
SELECT session_id, id, role, meta, created_at, CAST(row_number() OVER ({W}) AS BIGINT) AS pos FROM messages"""),
    "visible_transcript": with_views(M, """
SELECT session_id, id, role, content, created_at FROM messages WHERE NOT meta"""),
    "merge_turns": with_views(M, f"""
SELECT session_id, CAST(island AS BIGINT) AS turn, role,
       string_agg(content, {NL} || {NL} ORDER BY created_at, id) AS content
FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role THEN 1 ELSE 0 END)
             OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM (SELECT session_id, id, created_at, {ROLE} AS role, coalesce(content, '') AS content,
               lag({ROLE}) OVER ({W}) AS prev FROM messages) a) b
GROUP BY session_id, island, role
HAVING NOT (island = 1 AND role = 'assistant')"""),
    "openai_turns": with_views(M, f"""
SELECT DISTINCT session_id, 'system' AS role, 'Siz bolalar qobiliyatini baholovchi yordamchisiz.' AS content,
       CAST(0 AS BIGINT) AS pos FROM messages
UNION ALL
SELECT session_id, {ROLE} AS role, coalesce(content, '') AS content,
       CAST(row_number() OVER ({W}) AS BIGINT) AS pos
FROM messages WHERE coalesce(content, '') <> ''"""),
    "last_turn": with_views(M, """
SELECT session_id, arg_max(id, (created_at, id)) AS last_id, arg_max(role, (created_at, id)) AS last_role,
       arg_max(meta, (created_at, id)) AS last_meta
FROM messages GROUP BY session_id"""),
    "dangling_user_turn": with_views(M, """
SELECT session_id, last_id, last_role, last_role <> 'assistant' AS pending,
       NOT (last_role <> 'assistant' AND last_meta) AS needs_report_request
FROM (SELECT session_id, arg_max(id, (created_at, id)) AS last_id, arg_max(role, (created_at, id)) AS last_role,
             arg_max(meta, (created_at, id)) AS last_meta FROM messages GROUP BY session_id) x"""),
    "turn_cap": with_views(M, f"""
SELECT session_id, id, role, tb AS turns_before, role <> 'assistant' AND tb >= 60 AS over_cap
FROM (SELECT *, CAST(coalesce(sum(CASE WHEN role = 'assistant' AND coalesce(content, '') <> {CAP} THEN 1 ELSE 0 END)
                 OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tb
      FROM (SELECT * REPLACE (session_id // 40 AS session_id) FROM messages) AS long_sessions) x"""),
    "engagement_gate": with_views([*M, "sessions"], """
SELECT id AS session_id, CAST(coalesce(answers, 0) AS BIGINT) AS real_answers, coalesce(answers, 0) >= 1 AS gate_ok
FROM sessions LEFT JOIN (
  SELECT first_id, count(*) AS answers FROM messages
  JOIN (SELECT child_id, min(id) AS first_id FROM sessions GROUP BY child_id) AS f ON f.child_id = messages.session_id
  WHERE role = 'user' AND NOT meta GROUP BY first_id) AS a ON a.first_id = sessions.id"""),
    "track_markers": with_views(M, f"""
SELECT session_id, id, {marker('MANTIQ')} AS m_mantiq, {marker('PSIXOLOGIYA')} AS m_psixologiya,
       {marker('HARAKAT')} AS m_harakat
FROM messages WHERE role = 'assistant'"""),
    "progress_from_messages": with_views(M, f"""
SELECT session_id, bool_or({marker('MANTIQ')}) AS done_mantiq, bool_or({marker('PSIXOLOGIYA')}) AS done_psixologiya,
       bool_or({marker('HARAKAT')}) AS done_harakat,
       bool_or({marker('MANTIQ')}) AND bool_or({marker('PSIXOLOGIYA')}) AND bool_or({marker('HARAKAT')}) AS all_done
FROM messages WHERE role = 'assistant' GROUP BY session_id"""),
    "session_progress": with_views(["sessions"], """
SELECT id, done_mantiq, done_psixologiya, done_harakat, done_mantiq AND done_psixologiya AND done_harakat AS done,
       NOT (done_mantiq AND done_psixologiya AND done_harakat) AS partial FROM sessions"""),
    "session_counters": with_views(M, f"""
SELECT session_id, CAST(count(*) FILTER (WHERE role = 'assistant' AND coalesce(content, '') <> {CAP}) AS BIGINT) AS turn_count,
       CAST(count(*) FILTER (WHERE role = 'user' AND NOT meta) AS BIGINT) AS answers,
       CAST(count(*) FILTER (WHERE meta) AS BIGINT) AS meta_turns,
       CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS chars,
       min(created_at) AS first_at, max(created_at) AS last_at
FROM messages GROUP BY session_id"""),
    "grade_band": with_views(["children"], """
SELECT id, grade, CASE WHEN grade <= 2 THEN 'A' ELSE 'B' END AS band FROM children"""),
    "minimized_llm_view": with_views(["children"], f"""
SELECT id AS child_id, nickname, grade, age, CASE WHEN grade <= 2 THEN 'A' ELSE 'B' END AS band, {INTRO} AS intro
FROM children"""),
}
