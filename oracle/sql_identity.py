"""Oracle SQL for identity, change and governance jobs."""

from oracle.adapters import FIN, SID, norm_phone, with_views

BASE = "1000000000000"
AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"
NORM = norm_phone("phone_raw")
BLANK = "trim(coalesce(phone_raw, '')) = ''"

AC = f"""
ac AS (
  SELECT *, CASE WHEN {BLANK} THEN NULL ELSE {NORM} END AS phone FROM contacts
  WHERE {BLANK} OR {NORM} IS NOT NULL)"""
UC = "uc AS (SELECT * FROM ac WHERE child_id IN (SELECT id FROM children WHERE parent_id IS NULL))"
AGG_PHONE = """
agg AS (
  SELECT phone, arg_max(parent_name, (ts, contact_id)) AS new_name,
         arg_max(email, (ts, contact_id)) FILTER (WHERE email IS NOT NULL) AS new_email,
         bool_or(marketing) AS new_marketing, arg_max(consent_version, (ts, contact_id)) AS new_version,
         max(ts) AS new_consented_at, min(ts) AS first_ts, arg_min(contact_id, (ts, contact_id)) AS first_contact_id
  FROM uc WHERE phone IS NOT NULL GROUP BY phone)"""
UPSERT = f"""
SELECT coalesce(p.id, {BASE} + a.first_contact_id) AS id,
       CASE WHEN a.new_name IS NOT NULL THEN a.new_name ELSE p.name END AS name,
       coalesce(p.phone, a.phone) AS phone, coalesce(a.new_email, p.email) AS email,
       coalesce(p.marketing_consent, false) OR coalesce(a.new_marketing, false) AS marketing_consent,
       CASE WHEN a.new_name IS NOT NULL THEN a.new_version ELSE p.consent_text_version END AS consent_text_version,
       CASE WHEN a.new_name IS NOT NULL THEN a.new_consented_at ELSE p.consented_at END AS consented_at,
       coalesce(p.lead_status, 'new') AS lead_status, p.admin_notes, coalesce(p.created_at, a.first_ts) AS created_at
FROM parents p FULL OUTER JOIN agg a ON a.phone = p.phone
UNION ALL
SELECT {BASE} + contact_id, parent_name, NULL, email, coalesce(marketing, false), consent_version, ts, 'new', NULL, ts
FROM uc WHERE phone IS NULL"""

ENUM = ("CASE WHEN coalesce({c}, '') = '' THEN NULL "
        "WHEN lower(trim({c})) IN ('new', 'contacted', 'interested', 'enrolled', 'closed') THEN lower(trim({c})) "
        "WHEN lower(trim({c})) = 'yangi' THEN 'new' WHEN lower(trim({c})) = 'bog''lanildi' THEN 'contacted' "
        "WHEN lower(trim({c})) = 'qiziqish bildirdi' THEN 'interested' WHEN lower(trim({c})) = 'yozildi' THEN 'enrolled' "
        "WHEN lower(trim({c})) = 'yopildi' THEN 'closed' END")

PATCHES = """
patches AS (
  SELECT o_orderkey AS patch_id, o_custkey AS parent_id,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Yozildi'
              WHEN o_orderstatus = 'O' THEN ' CONTACTED ' ELSE 'noma''lum' END AS lead_status_text,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'qo''ng''iroq ' || CAST(o_orderkey AS VARCHAR)
              ELSE repeat('x', CAST(o_orderkey % 5000 AS INTEGER)) END AS admin_notes,
         o_orderdate AS ts
  FROM orders WHERE o_orderpriority = '1-URGENT')"""

ATTEMPTS = f"""
a AS (
  SELECT {SID} AS session_id, md5({SID}) AS share_token, {FIN} AS created_at
  FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL
  SELECT {SID}, md5('retry-' || {SID}),
         {FIN} - CASE WHEN l_linenumber % 2 = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A')"""

UPDATES = f"""
upd AS (
  SELECT CASE l_suppkey % 4 WHEN 0 THEN md5({SID}) WHEN 1 THEN md5({SID}) WHEN 2 THEN NULL
              ELSE md5('gone-' || {SID}) END AS token,
         {FIN} + INTERVAL 2 HOUR AS ts
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R'
  UNION ALL
  SELECT CASE l_suppkey % 4 WHEN 0 THEN md5({SID}) WHEN 1 THEN md5({SID}) WHEN 2 THEN NULL
              ELSE md5('gone-' || {SID}) END,
         {FIN} + INTERVAL 2 HOUR + INTERVAL 1 DAY
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N' AND l_linenumber = 1)"""

MASK = ("CASE WHEN coalesce({c}, '') = '' THEN 'no-phone' WHEN length({c}) > 4 THEN "
        "regexp_replace(substr({c}, 1, length({c}) - 4), '[0-9]', '*', 'g') || right({c}, 4) ELSE {c} END")


def parse_int(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(CAST({c} AS VARCHAR), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


REQS = """
reqs AS (
  SELECT o_orderkey AS request_id, o_orderstatus <> 'P' AS consent,
         CASE WHEN o_orderkey % 11 = 1 THEN '   ' WHEN o_orderkey % 11 = 2 THEN repeat('a', 61)
              ELSE ' kid' || CAST(o_orderkey % 100 AS VARCHAR) || ' ' END AS nickname,
         CASE WHEN o_orderkey % 11 = 3 THEN '5' WHEN o_orderkey % 11 = 4 THEN 'x' WHEN o_orderkey % 11 = 5 THEN '3abc'
              ELSE substr(o_orderpriority, 1, 1) END AS grade,
         CASE WHEN o_orderkey % 11 = 6 THEN '2' WHEN o_orderkey % 11 = 7 THEN '' WHEN o_orderkey % 11 = 8 THEN NULL
              ELSE CAST(o_orderkey % 10 + 5 AS VARCHAR) END AS age,
         CASE WHEN o_orderkey % 11 = 9 THEN repeat('g', 310) ELSE ' matematika ' END AS goal,
         CASE WHEN o_orderkey % 11 = 10 THEN '  ' ELSE 'izoh ' || CAST(o_orderkey AS VARCHAR) END AS notes
  FROM orders)"""

ERASE = """
req AS (SELECT DISTINCT id FROM (
  SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey + 1000000000 FROM customer WHERE c_acctbal < -900) r)"""

V5 = ["parents", "children", "sessions", "reports", "messages"]

BROKEN = """
p AS (SELECT * REPLACE (CASE id % 500 WHEN 3 THEN 'lost' WHEN 4 THEN NULL ELSE lead_status END AS lead_status,
        CASE WHEN id % 500 = 5 THEN '+998900000000' ELSE phone END AS phone,
        CASE WHEN id % 500 = 6 THEN NULL ELSE name END AS name) FROM parents),
c AS (SELECT * REPLACE (CASE WHEN id % 1000 = 7 THEN 9 ELSE grade END AS grade, CASE WHEN id % 1000 = 11 THEN 40 ELSE age END AS age,
        CASE WHEN id % 1000 = 13 THEN NULL ELSE nickname END AS nickname,
        CASE WHEN id % 1000 = 17 THEN -1 ELSE parent_id END AS parent_id) FROM children),
s AS (SELECT * REPLACE (CASE child_id % 1000 WHEN 19 THEN 'lost' WHEN 20 THEN NULL ELSE status END AS status,
        CASE child_id % 1000 WHEN 29 THEN 'same' WHEN 30 THEN NULL ELSE session_token END AS session_token,
        CASE child_id % 1000 WHEN 23 THEN -5 WHEN 24 THEN NULL ELSE child_id END AS child_id) FROM sessions),
r AS (SELECT * REPLACE (CASE WHEN child_id % 1000 = 31 THEN 'zor' ELSE level_logic END AS level_logic,
        CASE WHEN child_id % 1000 = 32 THEN 'zor' ELSE level_psych END AS level_psych,
        CASE WHEN child_id % 1000 = 33 THEN 'zor' ELSE level_activity END AS level_activity,
        CASE child_id % 1000 WHEN 37 THEN 'x' || session_id WHEN 38 THEN NULL ELSE session_id END AS session_id,
        CASE child_id % 1000 WHEN 41 THEN 'dup' WHEN 42 THEN NULL ELSE share_token END AS share_token,
        CASE child_id % 1000 WHEN 43 THEN -1 WHEN 44 THEN NULL ELSE child_id END AS child_id) FROM reports),
f AS (SELECT child_id, min(id) AS sid FROM sessions GROUP BY child_id),
m AS (SELECT CASE WHEN ord = 2 THEN 2 ELSE id END AS id, coalesce(sid, CAST(session_id AS VARCHAR)) AS session_id, role,
             CASE WHEN ord = 1 THEN NULL ELSE content END AS content
      FROM messages LEFT JOIN f ON f.child_id = messages.session_id)"""


def _repeated(table: str, name: str, col: str) -> str:
    return (f"SELECT '{name}' AS \"table\", 'unique_{col}' AS rule, CAST({col} AS VARCHAR) AS key FROM {table} "
            f"WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1")


def _wrong(table: str, name: str, rule: str, where: str) -> str:
    key = "session_id" if table == "r" else "id"
    return f"SELECT '{name}', '{rule}', CAST({key} AS VARCHAR) FROM {table} WHERE {where}"


def _dangling(table: str, name: str, col: str, target: str) -> str:
    return _wrong(table, name, f"fk_{col}", f"CAST({col} AS VARCHAR) NOT IN (SELECT CAST(id AS VARCHAR) FROM {target})")


#: What the product's schema forbids, constraint by constraint.
BROKEN_RULES = "\nUNION ALL ".join([
    _repeated("p", "parents", "id"), _repeated("p", "parents", "phone"), _repeated("c", "children", "id"),
    _repeated("s", "sessions", "id"), _repeated("s", "sessions", "session_token"), _repeated("m", "messages", "id"),
    _repeated("r", "reports", "session_id"), _repeated("r", "reports", "share_token"),
    *(_wrong(t, n, f"required_{col}", f"{col} IS NULL") for t, n, col in [
        ("p", "parents", "name"), ("p", "parents", "lead_status"), ("c", "children", "nickname"), ("c", "children", "grade"),
        ("s", "sessions", "child_id"), ("s", "sessions", "session_token"), ("s", "sessions", "status"),
        ("m", "messages", "session_id"), ("m", "messages", "role"), ("m", "messages", "content"),
        ("r", "reports", "session_id"), ("r", "reports", "child_id"), ("r", "reports", "share_token")]),
    _wrong("p", "parents", "lead_status_domain", "lead_status NOT IN ('new', 'contacted', 'interested', 'enrolled', 'closed')"),
    _wrong("s", "sessions", "status_domain", "status NOT IN ('active', 'paused', 'finished', 'abandoned')"),
    _wrong("m", "messages", "role_domain", "role NOT IN ('user', 'assistant')"),
    *(_wrong("r", "reports", f"{col}_domain", f"{col} NOT IN ('shakllanmoqda', 'meyorda', 'kuchli')")
      for col in ("level_logic", "level_psych", "level_activity")),
    _wrong("c", "children", "grade_range", "NOT (grade BETWEEN 1 AND 4)"),
    _wrong("c", "children", "age_range", "NOT (age BETWEEN 3 AND 18)"),
    _dangling("c", "children", "parent_id", "p"), _dangling("s", "sessions", "child_id", "c"),
    _dangling("m", "messages", "session_id", "s"), _dangling("r", "reports", "session_id", "s"),
    _dangling("r", "reports", "child_id", "c")])

SQL = {
    "standardize_contacts": with_views(["contacts"], f"""
SELECT contact_id, phone_raw, phone, phone IS NOT NULL AS phone_valid,
       CASE WHEN coalesce(phone, '') = '' THEN NULL
            WHEN regexp_matches(phone, '^\\+998([0-9]{{2}})([0-9]{{3}})([0-9]{{2}})([0-9]{{2}})$')
            THEN regexp_replace(phone, '^\\+998([0-9]{{2}})([0-9]{{3}})([0-9]{{2}})([0-9]{{2}})$', '+998 \\1 \\2-\\3-\\4')
            ELSE phone END AS phone_display,
       {MASK.format(c='phone')} AS phone_masked
FROM (SELECT contact_id, phone_raw, {NORM} AS phone FROM contacts) x"""),
    "upsert_parents": with_views(["parents", "children", "contacts"], UPSERT, extra=[AC, UC, AGG_PHONE]),
    "link_children": with_views(["parents", "children", "contacts"], f"""
SELECT c.id, coalesce(c.parent_id, l.new_parent) AS parent_id
FROM children c LEFT JOIN (
  SELECT uc.child_id, coalesce(u.id, {BASE} + uc.contact_id) AS new_parent
  FROM uc LEFT JOIN (SELECT * FROM up WHERE phone IS NOT NULL) u ON u.phone = uc.phone) l ON l.child_id = c.id""",
                                 extra=[AC, UC, AGG_PHONE, "up AS (" + UPSERT + ")"]),
    "update_contact": with_views(["parents", "children", "contacts"], """
SELECT p.id, CASE WHEN a.new_name IS NOT NULL THEN a.new_name ELSE p.name END AS name,
       coalesce(p.phone, a.new_phone) AS phone, coalesce(a.new_email, p.email) AS email,
       p.marketing_consent OR coalesce(a.new_marketing, false) AS marketing_consent,
       CASE WHEN a.new_name IS NOT NULL THEN a.new_version ELSE p.consent_text_version END AS consent_text_version,
       CASE WHEN a.new_name IS NOT NULL THEN a.new_consented_at ELSE p.consented_at END AS consented_at,
       p.lead_status, p.admin_notes, p.created_at
FROM parents p LEFT JOIN (
  SELECT k.parent_id, arg_max(parent_name, (ts, contact_id)) AS new_name,
         arg_max(email, (ts, contact_id)) FILTER (WHERE email IS NOT NULL) AS new_email,
         bool_or(marketing) AS new_marketing, arg_max(consent_version, (ts, contact_id)) AS new_version,
         arg_min(phone, (ts, contact_id)) FILTER (WHERE phone IS NOT NULL) AS new_phone,
         max(ts) AS new_consented_at
  FROM ac JOIN children k ON k.id = ac.child_id AND k.parent_id IS NOT NULL
  GROUP BY k.parent_id) a ON a.parent_id = p.id""", extra=[AC]),
    "patch_leads": with_views(["parents"], f"""
SELECT p.id, coalesce(n.new_status, p.lead_status) AS lead_status,
       CASE WHEN coalesce(n.has_notes, false) THEN n.new_notes ELSE p.admin_notes END AS admin_notes
FROM parents p LEFT JOIN (
  SELECT parent_id, arg_max(st, (ts, patch_id)) FILTER (WHERE st IS NOT NULL) AS new_status,
         arg_max(substr(admin_notes, 1, 4000), (ts, patch_id)) FILTER (WHERE admin_notes IS NOT NULL) AS new_notes,
         bool_or(admin_notes IS NOT NULL) AS has_notes
  FROM (SELECT *, {ENUM.format(c='lead_status_text')} AS st FROM patches) x
  WHERE NOT (lead_status_text IS NOT NULL AND st IS NULL)
  GROUP BY parent_id) n ON n.parent_id = p.id""", extra=[PATCHES]),
    "patch_rejects": with_views(["parents"], f"""
SELECT patch_id, parent_id, 'bad_status' AS reason FROM (SELECT *, {ENUM.format(c='lead_status_text')} AS st FROM patches) x
WHERE lead_status_text IS NOT NULL AND st IS NULL""", extra=[PATCHES]),
    "apply_turns": with_views(["sessions"], f"""
SELECT s.id, CAST(s.turn_count + coalesce(d.d_turns, 0) AS BIGINT) AS turn_count,
       CAST(s.input_tokens + coalesce(d.d_in, 0) AS BIGINT) AS input_tokens,
       CAST(s.output_tokens + coalesce(d.d_out, 0) AS BIGINT) AS output_tokens,
       s.done_mantiq OR coalesce(d.d_m, false) AS done_mantiq,
       s.done_psixologiya OR coalesce(d.d_p, false) AS done_psixologiya,
       s.done_harakat OR coalesce(d.d_h, false) AS done_harakat
FROM sessions s LEFT JOIN (
  SELECT {SID} AS sid, sum(100) AS d_in, sum(200) AS d_out, count(*) FILTER (WHERE l_linestatus <> 'F') AS d_turns,
         bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 0) AS d_m, bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 1) AS d_p,
         bool_or(l_linestatus <> 'F' AND l_suppkey % 3 = 2) AS d_h
  FROM lineitem GROUP BY 1) d ON d.sid = s.id"""),
    "finish_sessions": with_views(["sessions"], """
SELECT s.id, CASE WHEN f.session_id IS NOT NULL THEN 'finished' ELSE s.status END AS status,
       CASE WHEN f.session_id IS NOT NULL THEN coalesce(s.finished_at, f.created_at) ELSE s.finished_at END AS finished_at
FROM (SELECT id, CASE WHEN child_id % 4 = 0 THEN 'active' ELSE status END AS status,
             CASE WHEN child_id % 4 <> 0 THEN finished_at END AS finished_at FROM sessions) AS s LEFT JOIN (SELECT session_id, min(created_at) AS created_at FROM a GROUP BY session_id) f
  ON f.session_id = s.id""", extra=[ATTEMPTS]),
    "insert_report_if_absent": f"""
WITH {ATTEMPTS.strip()},
ex AS (SELECT {SID} AS session_id, md5({SID}) AS share_token, {FIN} AS created_at
       FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'A')
SELECT session_id, share_token, created_at, false AS inserted FROM ex
UNION ALL
SELECT session_id, arg_min(share_token, (created_at, share_token)), min(created_at), true
FROM a WHERE session_id NOT IN (SELECT session_id FROM ex) GROUP BY session_id""",
    "delivery_targets": with_views(["reports", "children", "parents"], f"""
SELECT r.share_token, r.session_id, c.nickname, p.id AS parent_id, {MASK.format(c='p.phone')} AS phone_masked,
       'https://example.uz/hisobot/' || r.share_token AS report_url,
       'https://t.me/example_bot?start=' || r.share_token AS deep_link
FROM reports r LEFT JOIN children c ON c.id = r.child_id LEFT JOIN parents p ON p.id = c.parent_id
WHERE p.phone IS NOT NULL"""),
    "mark_delivered": with_views(["reports"], """
SELECT r.session_id, r.share_token, r.delivered OR d.token IS NOT NULL AS delivered,
       coalesce(r.delivered_at, d.at) AS delivered_at
FROM reports r LEFT JOIN (SELECT token, min(ts) AS at FROM upd WHERE token IS NOT NULL GROUP BY token) d
  ON d.token = r.share_token""", extra=[UPDATES]),
    "model_audit": with_views(["sessions"], """
SELECT id, model, effective_model FROM (
  SELECT id, model, CASE WHEN coalesce(model, '') LIKE '%/%' THEN model ELSE 'anthropic/claude-sonnet-4.6' END AS effective_model
  FROM sessions) x WHERE coalesce(model, '') <> effective_model"""),
    "llm_call_outcomes": """
SELECT model, day, outcome, CAST(count(*) AS BIGINT) AS calls FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'claude-sonnet-4-6' WHEN 'N' THEN 'anthropic/claude-sonnet-4.6'
              ELSE 'claude-haiku-4-5-20251001' END AS model,
         CAST(l_shipdate AS DATE) AS day,
         CASE WHEN l_suppkey % 10 IN (0, 1, 3) THEN 'retryable' WHEN l_suppkey % 10 IN (2, 4) THEN 'final'
              WHEN l_suppkey % 10 IN (5, 6, 7) THEN 'retryable_failure' ELSE 'ok' END AS outcome
  FROM lineitem) x GROUP BY model, day, outcome""",
    "last_activity": with_views(["sessions"], """
SELECT child_id, max(coalesce(finished_at, started_at)) AS last_activity FROM sessions GROUP BY child_id"""),
    "children_expired": with_views(["sessions"], f"""
SELECT child_id AS id FROM sessions GROUP BY child_id
HAVING max(coalesce(finished_at, started_at)) < {AS_OF} - INTERVAL 24 MONTH"""),
    "orphan_parents": with_views(["parents", "children"], """
SELECT p.id, p.name, p.phone FROM parents p
WHERE NOT EXISTS (SELECT 1 FROM children c WHERE c.parent_id = p.id)"""),
    "retention_purge": with_views(V5, f"""
SELECT 'parents' AS "table", (SELECT count(*) FROM parents) AS before, (SELECT count(*) FROM p2) AS after,
       (SELECT count(*) FROM parents) - (SELECT count(*) FROM p2) AS removed
UNION ALL SELECT 'children', (SELECT count(*) FROM children), (SELECT count(*) FROM c2),
       (SELECT count(*) FROM children) - (SELECT count(*) FROM c2)
UNION ALL SELECT 'sessions', (SELECT count(*) FROM sessions), (SELECT count(*) FROM s2),
       (SELECT count(*) FROM sessions) - (SELECT count(*) FROM s2)
UNION ALL SELECT 'messages', (SELECT count(*) FROM messages), (SELECT count(*) FROM m2),
       (SELECT count(*) FROM messages) - (SELECT count(*) FROM m2)
UNION ALL SELECT 'reports', (SELECT count(*) FROM reports), (SELECT count(*) FROM r2),
       (SELECT count(*) FROM reports) - (SELECT count(*) FROM r2)""", extra=[
        f"""gone AS (SELECT child_id AS id FROM sessions GROUP BY child_id
            HAVING max(coalesce(finished_at, started_at)) < {AS_OF} - INTERVAL 24 MONTH)""",
        "c2 AS (SELECT * FROM children WHERE id NOT IN (SELECT id FROM gone))",
        "s2 AS (SELECT * FROM sessions WHERE child_id NOT IN (SELECT id FROM gone))",
        "r2 AS (SELECT * FROM reports WHERE child_id NOT IN (SELECT id FROM gone))",
        # conversation n is the first session of child n, where that child has a session
        """m2 AS (SELECT * FROM messages WHERE session_id NOT IN (
               SELECT id FROM gone WHERE id IN (SELECT child_id FROM sessions)))""",
        "p2 AS (SELECT * FROM parents p WHERE EXISTS (SELECT 1 FROM c2 WHERE c2.parent_id = p.id))"]),
    "erase_parents": with_views(V5, """
SELECT 'parents' AS "table", (SELECT count(*) FROM parents) AS before, (SELECT count(*) FROM p2) AS after,
       (SELECT count(*) FROM parents) - (SELECT count(*) FROM p2) AS removed
UNION ALL SELECT 'children', (SELECT count(*) FROM children), (SELECT count(*) FROM c2),
       (SELECT count(*) FROM children) - (SELECT count(*) FROM c2)
UNION ALL SELECT 'sessions', (SELECT count(*) FROM sessions), (SELECT count(*) FROM s2),
       (SELECT count(*) FROM sessions) - (SELECT count(*) FROM s2)
UNION ALL SELECT 'messages', (SELECT count(*) FROM messages), (SELECT count(*) FROM m2),
       (SELECT count(*) FROM messages) - (SELECT count(*) FROM m2)
UNION ALL SELECT 'reports', (SELECT count(*) FROM reports), (SELECT count(*) FROM r2),
       (SELECT count(*) FROM reports) - (SELECT count(*) FROM r2)
UNION ALL SELECT 'not_found', (SELECT count(*) FROM req WHERE id NOT IN (SELECT id FROM parents)), 0,
       (SELECT count(*) FROM req WHERE id NOT IN (SELECT id FROM parents))""", extra=[
        ERASE,
        "gone AS (SELECT id FROM children WHERE parent_id IN (SELECT id FROM req))",
        "c2 AS (SELECT * FROM children WHERE id NOT IN (SELECT id FROM gone))",
        "s2 AS (SELECT * FROM sessions WHERE child_id NOT IN (SELECT id FROM gone))",
        "r2 AS (SELECT * FROM reports WHERE child_id NOT IN (SELECT id FROM gone))",
        # conversation n is the first session of child n, where that child has a session
        """m2 AS (SELECT * FROM messages WHERE session_id NOT IN (
               SELECT id FROM gone WHERE id IN (SELECT child_id FROM sessions)))""",
        "p2 AS (SELECT * FROM parents WHERE id NOT IN (SELECT id FROM req))"]),
    "dq_session_requests": f"""
WITH {REQS.strip()},
x AS (SELECT *, trim(coalesce(nickname, '')) AS nick, {parse_int('grade')} AS g,
             (age IS NULL OR age = '') AS age_blank, {parse_int('age')} AS a FROM reqs),
y AS (SELECT *, CASE WHEN NOT coalesce(consent, false) THEN 'consent_required'
                     WHEN nick = '' THEN 'required' WHEN length(nick) > 60 THEN 'too_long'
                     WHEN g IS NULL OR g < 1 OR g > 4 THEN 'bad_grade'
                     WHEN NOT age_blank AND (a IS NULL OR a < 3 OR a > 18) THEN 'bad_age' END AS reason FROM x)
SELECT request_id, reason IS NULL AS valid, reason,
       CASE WHEN reason IS NULL THEN nick END AS nickname, CASE WHEN reason IS NULL THEN g END AS grade,
       CASE WHEN reason IS NULL AND NOT age_blank THEN a END AS age,
       CASE WHEN reason IS NULL THEN nullif(substr(trim(coalesce(goal, '')), 1, 300), '') END AS goal,
       CASE WHEN reason IS NULL THEN nullif(substr(trim(coalesce(notes, '')), 1, 500), '') END AS notes
FROM y""",
    "dq_messages": with_views(["messages"], """
SELECT session_id, id, reason IS NULL AS valid, reason, chars FROM (
  SELECT session_id, id, CAST(length(trim(coalesce(content, ''))) AS BIGINT) AS chars,
         CASE WHEN trim(coalesce(content, '')) = '' THEN 'required'
              WHEN length(trim(coalesce(content, ''))) > 2000 THEN 'too_long' END AS reason
  FROM (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN ' ' ELSE repeat(content, 1 + id % 4) END AS content)
        FROM messages WHERE role = 'user') AS said) x"""),
    "dq_contacts": with_views(["contacts"], f"""
SELECT contact_id, reason IS NULL AS valid, reason, CASE WHEN {BLANK} THEN NULL ELSE {NORM} END AS phone,
       nullif(substr(trim(coalesce(email, '')), 1, 120), '') AS email,
       coalesce(CAST(marketing AS VARCHAR), '') IN ('true', '1') AS marketing
FROM (SELECT *, CASE WHEN trim(coalesce(parent_name, '')) = '' THEN 'required'
                     WHEN length(trim(coalesce(parent_name, ''))) > 100 THEN 'too_long'
                     WHEN NOT ({BLANK}) AND {NORM} IS NULL THEN 'bad_phone' END AS reason FROM contacts) x"""),
    "dq_entities": with_views(V5, BROKEN_RULES, extra=[BROKEN]),
}
