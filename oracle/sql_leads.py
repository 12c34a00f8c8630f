"""Oracle SQL for the lead jobs: each fact is counted where it lives, then families are put together once."""

from oracle.adapters import with_views
from oracle.sql_reports import PR, RR

V4 = ["parents", "children", "sessions", "reports"]
AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"


def rollup(where: str = "") -> str:
    """Families with the number of their children and sessions, the newest report and their children's names."""
    runs = "SELECT child_id, count(DISTINCT id) AS runs FROM sessions GROUP BY child_id"
    newest = "SELECT child_id, max(created_at) AS newest FROM reports GROUP BY child_id"
    family = f"""
SELECT parent_id, count(*) AS kids, sum(coalesce(runs, 0)) AS runs, max(newest) AS newest,
       list_aggregate(list_sort(list_distinct(list(nickname || ' · ' || grade || '-sinf'))), 'string_agg', ', ') AS names
FROM children LEFT JOIN ({runs}) AS a ON a.child_id = children.id LEFT JOIN ({newest}) AS b ON b.child_id = children.id
WHERE parent_id IS NOT NULL GROUP BY parent_id"""
    return f"""
SELECT p.id, p.name, p.phone, p.marketing_consent, p.lead_status, p.created_at,
       CAST(coalesce(kids, 0) AS BIGINT) AS children_count, CAST(coalesce(runs, 0) AS BIGINT) AS sessions_count,
       newest AS last_report_at, names AS children_label
FROM ({family}) AS f RIGHT JOIN parents AS p ON p.id = f.parent_id
{where}"""


def fmt_phone(col: str) -> str:
    pat = r"^\+998([0-9]{2})([0-9]{3})([0-9]{2})([0-9]{2})$"
    return (f"CASE WHEN regexp_matches({col}, '{pat}') THEN regexp_replace({col}, '{pat}', '+998 \\1 \\2-\\3-\\4') "
            f"ELSE coalesce({col}, '') END")


LABEL = ("CASE {c} WHEN 'new' THEN 'Yangi' WHEN 'contacted' THEN 'Bog''lanildi' WHEN 'interested' THEN "
         "'Qiziqish bildirdi' WHEN 'enrolled' THEN 'Yozildi' WHEN 'closed' THEN 'Yopildi' ELSE {c} END")


def cell(expr: str) -> str:
    s = f"coalesce(CAST({expr} AS VARCHAR), '')"
    s2 = f"(CASE WHEN regexp_matches({s}, '^[=+\\-@\\t\\r]') THEN '''' || {s} ELSE {s} END)"
    return f"'\"' || replace({s2}, '\"', '\"\"') || '\"'"


CSV_CELLS = [
    "name",
    f"CASE WHEN coalesce(phone, '') = '' THEN '' ELSE {fmt_phone('phone')} END",
    LABEL.format(c="lead_status"),
    "CASE WHEN marketing_consent THEN 'Ha' ELSE 'Yo''q' END",
    "coalesce(children_label, '')",
    "sessions_count",
    "coalesce(strftime(created_at, '%Y-%m-%d'), '')",
]

#: One row per session of a family's child (a child without sessions has one row), with its report's token.
LEAD_CHILDREN = """
SELECT k.parent_id, k.id AS child_id, k.nickname, k.grade, k.created_at AS child_created_at,
       v.session_id, v.status, v.started_at, v.share_token, v.partial, v.report_at
FROM (SELECT * FROM children WHERE parent_id IS NOT NULL) AS k
LEFT JOIN (SELECT sessions.child_id, id AS session_id, status, started_at, share_token, partial,
                  reports.created_at AS report_at
           FROM sessions LEFT JOIN reports ON reports.session_id = sessions.id) AS v ON v.child_id = k.id"""

def iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%gZ')"


PUBLIC = f"""
SELECT r.share_token, t.content_md, c.nickname, c.grade, r.partial, {iso('r.created_at')} AS date, r.level_logic,
       r.level_psych, r.level_activity, r.sports
FROM pr AS t JOIN reports AS r USING (session_id) JOIN children AS c ON c.id = r.child_id"""

SQL = {
    "load_entities": with_views(["parents", "children", "sessions", "reports", "messages"], """
SELECT 'parents' AS entity, CAST(count(*) AS BIGINT) AS rows FROM parents
UNION ALL SELECT 'children', count(*) FROM children
UNION ALL SELECT 'sessions', count(*) FROM sessions
UNION ALL SELECT 'reports', count(*) FROM reports
UNION ALL SELECT 'messages', count(*) FROM messages"""),
    "lead_rollup": with_views(V4, rollup()),
    "lead_children_label": with_views(V4, f"SELECT id, children_label FROM ({rollup()}) x"),
    "lead_filter_status": with_views(V4, rollup("WHERE p.lead_status = 'enrolled'")),
    "lead_filter_grade": with_views(V4, rollup(
        "WHERE p.id IN (SELECT parent_id FROM children WHERE grade = 2)")),
    "lead_filter_since": with_views(V4, rollup(f"WHERE p.created_at >= {AS_OF} - INTERVAL 30 DAY")),
    "leads_filtered": with_views(V4, rollup(
        "WHERE p.lead_status = 'contacted' AND p.id IN (SELECT parent_id FROM children "
        f"WHERE grade = 3) AND p.created_at >= {AS_OF} - INTERVAL 200 DAY")),
    "leads_sorted": with_views(V4, f"""
SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS pos FROM ({rollup()}) x"""),
    "lead_rows": with_views(V4, f"""
SELECT id, name, CASE WHEN coalesce(phone, '') = '' THEN NULL ELSE {fmt_phone('phone')} END AS phone,
       children_label, children_count, sessions_count, last_report_at, lead_status,
       {LABEL.format(c='lead_status')} AS lead_status_label, marketing_consent, created_at
FROM ({rollup()}) x"""),
    "export_leads_csv": with_views(V4, f"""
SELECT 0 AS line, chr(65279) || '"Ota-ona","Telefon","Holat","Marketing roziligi","Bolalar","Mashg''ulotlar","Qo''shilgan"' AS csv_line
UNION ALL
SELECT row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS line,
       {" || ',' || ".join(cell(c) for c in CSV_CELLS)} AS csv_line
FROM ({rollup()}) x"""),
    "lead_children": with_views(["children", "sessions", "reports"], f"""
SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY child_created_at, child_id, started_at, session_id) AS pos
FROM ({LEAD_CHILDREN}) lc"""),
    "lead_detail": with_views(["children", "sessions", "reports"], f"""
SELECT parent_id, child_id, nickname AS name, grade,
       CAST(count(share_token) AS BIGINT) AS report_sessions,
       coalesce(string_agg(share_token, ',' ORDER BY started_at, share_token), '') AS share_tokens,
       arg_min(coalesce(report_at, started_at), struct_pack(a := started_at, b := share_token))
           FILTER (WHERE share_token IS NOT NULL) AS first_date
FROM ({LEAD_CHILDREN}) lc
GROUP BY parent_id, child_id, nickname, grade"""),
    "report_with_child": with_views(["reports", "children"], """
SELECT r.session_id, r.child_id, r.share_token, c.nickname, c.grade, r.level_logic, r.level_psych,
       r.level_activity, r.partial, r.delivered, r.created_at
FROM reports r JOIN children c ON c.id = r.child_id"""),
    "public_report": with_views(["reports", "children"], f"""
SELECT share_token, content_md, nickname, grade, partial, date, level_logic, level_psych, level_activity,
       array_to_string(sports, ',') AS sports FROM ({PUBLIC}) AS x""", extra=[RR, PR]),
    "public_report_json": with_views(["reports", "children"], f"""
SELECT share_token, CAST(to_json(struct_pack(content_md, nickname, grade, partial, date,
       levels := struct_pack(logic := level_logic, psych := level_psych, activity := level_activity), sports)) AS VARCHAR) AS doc
FROM ({PUBLIC}) AS x""", extra=[RR, PR]),
    "lead_detail_json": with_views(V4, f"""
SELECT p.id, CAST(to_json(struct_pack(
    parent := struct_pack(id := p.id, name := p.name,
        phone := CASE WHEN coalesce(phone, '') = '' THEN NULL ELSE {fmt_phone('phone')} END,
        marketing_consent := marketing_consent, consent_text_version := consent_text_version,
        consented_at := {iso('consented_at')}, lead_status := lead_status, admin_notes := admin_notes,
        created_at := {iso('created_at')}),
    children := coalesce(kids, []),
    statuses := list_transform(['new', 'contacted', 'interested', 'enrolled', 'closed'],
                               lambda v: struct_pack(value := v, label := {LABEL.format(c='v')})))) AS VARCHAR) AS doc
FROM parents AS p LEFT JOIN (
  SELECT parent_id, list(struct_pack(name := nickname, grade := grade, sessions := runs)
                         ORDER BY child_created_at, child_id) AS kids
  FROM (SELECT parent_id, child_id, nickname, grade, child_created_at,
               coalesce(list(struct_pack(date := {iso('coalesce(report_at, started_at)')}, partial := partial, share_token := share_token)
                             ORDER BY started_at, share_token) FILTER (WHERE share_token IS NOT NULL), []) AS runs
        FROM ({LEAD_CHILDREN}) AS lc GROUP BY ALL) AS c GROUP BY parent_id) AS k ON k.parent_id = p.id"""),
    "resume_json": with_views(["children", "sessions", "reports", "messages"], """
SELECT s.id AS session_id, CAST(to_json(struct_pack(
    child := struct_pack(nickname := c.nickname, grade := c.grade, age := c.age, goal := c.goal, notes := c.notes),
    messages := coalesce(m.said, []), status := s.status,
    progress := struct_pack(mantiq := done_mantiq, psixologiya := done_psixologiya, harakat := done_harakat),
    done := done_mantiq AND done_psixologiya AND done_harakat, turn_count := turn_count,
    report := CASE WHEN r.share_token IS NOT NULL
                   THEN struct_pack(share_token := r.share_token, partial := r.partial) END)) AS VARCHAR) AS doc
FROM sessions AS s LEFT JOIN children AS c ON c.id = s.child_id LEFT JOIN reports AS r ON r.session_id = s.id
LEFT JOIN (SELECT f.sid, list(struct_pack(role := role, content := content, meta := meta) ORDER BY created_at, messages.id) AS said
           FROM messages JOIN (SELECT child_id, min(id) AS sid FROM sessions GROUP BY child_id) AS f
                ON f.child_id = messages.session_id GROUP BY f.sid) AS m ON m.sid = s.id"""),
    "report_filter_level_sport": with_views(["parents", "children", "reports"], """
SELECT p.id, p.name, p.lead_status FROM parents p
WHERE EXISTS (SELECT 1 FROM children c JOIN reports r ON r.child_id = c.id
              WHERE c.parent_id = p.id AND r.level_logic = 'kuchli' AND list_contains(r.sports, 'Futbol'))"""),
    "lookup_by_token": with_views(["reports", "children", "sessions"], """
SELECT q.token, r.share_token IS NOT NULL AS found, r.session_id, r.child_id, c.nickname, c.grade
FROM (SELECT share_token AS token FROM reports
      UNION ALL SELECT md5('missing-' || id) FROM sessions WHERE finished_at IS NULL) q
LEFT JOIN (reports r JOIN children c ON c.id = r.child_id) ON r.share_token = q.token"""),
    "lead_status_dim": with_views(["parents"], f"""
SELECT lead_status AS value, {LABEL.format(c='lead_status')} AS label,
       CAST(list_position(['new', 'contacted', 'interested', 'enrolled', 'closed'], lead_status) - 1 AS INTEGER) AS ord,
       CAST(count(*) AS BIGINT) AS leads
FROM parents GROUP BY lead_status"""),
}
