"""The adapter views written independently in DuckDB SQL (oracle side).

They restate the fixture rules of ``leadlens.sources.adapters`` in plain SQL
over the pre-registered driver tables, so the oracle never runs Spark code.
"""

from __future__ import annotations

NL, CR = "chr(10)", "chr(13)"


def norm_phone(raw: str) -> str:
    d0 = f"regexp_replace(CAST({raw} AS VARCHAR), '[^0-9]', '', 'g')"
    d = f"(CASE WHEN starts_with({d0}, '00') THEN substr({d0}, 3) ELSE {d0} END)"
    return (f"(CASE WHEN {d0} = '' THEN NULL "
            f"WHEN length({d}) = 12 AND starts_with({d}, '998') THEN '+' || {d} "
            f"WHEN length({d}) = 9 THEN '+998' || {d} "
            f"WHEN length({d}) = 10 AND starts_with({d}, '0') THEN '+998' || substr({d}, 2, 9) "
            f"ELSE NULL END)")


def phone_raw(key: str) -> str:
    n = f"('9' || lpad(CAST({key} AS VARCHAR), 8, '0'))"
    styled = (f"'+998 (' || substr({n},1,2) || ') ' || substr({n},3,3) || '-' || substr({n},6,2)"
              f" || '-' || substr({n},8,2)")
    return (f"(CASE {key} % 6 WHEN 0 THEN NULL WHEN 1 THEN {styled} WHEN 2 THEN {n} "
            f"WHEN 3 THEN '0' || {n} WHEN 4 THEN '00998' || {n} ELSE CAST({key} AS VARCHAR) END)")


SID = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
       "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")
FIN = ("CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_minutes(CAST(l_quantity AS INTEGER)) END")

VIEWS: dict[str, str] = {
    "parents": f"""
parents AS (
  SELECT c_custkey AS id, c_name AS name, {norm_phone(phone_raw('c_custkey'))} AS phone,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'ota' || CAST(c_custkey AS VARCHAR) || '@example.uz' END AS email,
         c_acctbal > 0 AS marketing_consent,
         'v1' AS consent_text_version,
         TIMESTAMP '2001-11-05 00:00:00' - to_days(CAST(c_custkey % 400 AS INTEGER))
             + to_days(CAST(c_custkey % 3 AS INTEGER)) AS consented_at,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'new' WHEN 'BUILDING' THEN 'contacted'
              WHEN 'FURNITURE' THEN 'interested' WHEN 'HOUSEHOLD' THEN 'enrolled' ELSE 'closed' END AS lead_status,
         CAST(NULL AS VARCHAR) AS admin_notes,
         TIMESTAMP '2001-11-05 00:00:00' - to_days(CAST(c_custkey % 400 AS INTEGER)) AS created_at
  FROM customer)""",
    "children": """
children AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS parent_id,
         'kid' || CAST(o_orderkey % 100 AS VARCHAR) AS nickname,
         least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 4) AS grade,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 4) + 5 END AS age,
         CASE WHEN o_orderkey % 3 = 0 THEN 'matematika' END AS goal,
         CASE WHEN o_orderkey % 7 = 0 THEN 'izoh ' || CAST(o_orderkey AS VARCHAR) END AS notes,
         o_orderdate AS created_at
  FROM orders)""",
    "sessions": f"""
sessions AS (
  SELECT {SID} AS id, l_orderkey AS child_id, md5('tok-' || {SID}) AS session_token,
         CASE WHEN l_linestatus = 'F' THEN 'finished' ELSE 'active' END AS status,
         CASE WHEN l_linenumber % 2 = 0 THEN 'v1-3f2a9c4d1e0b' ELSE 'v1-8b7c6d5e4f3a' END AS prompt_version,
         CASE l_returnflag WHEN 'A' THEN 'claude-sonnet-4-6' WHEN 'N' THEN 'anthropic/claude-sonnet-4.6'
              ELSE 'claude-haiku-4-5-20251001' END AS model,
         CAST(l_quantity AS INTEGER) AS turn_count,
         CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens,
         CAST(l_quantity * 100 AS BIGINT) AS output_tokens,
         l_discount >= 0.01 AS done_mantiq, l_tax >= 0.01 AS done_psixologiya, l_quantity >= 5 AS done_harakat,
         l_shipdate AS started_at, {FIN} AS finished_at
  FROM lineitem)""",
    "reports": f"""
reports AS (
  SELECT {SID} AS session_id, l_orderkey AS child_id, md5({SID}) AS share_token,
         CASE WHEN l_discount >= 0.01 THEN CASE WHEN l_discount < 0.03 THEN 'kuchli' WHEN l_discount < 0.07 THEN 'meyorda' ELSE 'shakllanmoqda' END END AS level_logic,
         CASE WHEN l_tax >= 0.01 THEN CASE WHEN l_tax < 0.03 THEN 'meyorda' WHEN l_tax < 0.06 THEN 'kuchli' ELSE 'shakllanmoqda' END END AS level_psych,
         CASE WHEN l_quantity >= 5 THEN CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'kuchli' WHEN 1 THEN 'meyorda' ELSE 'shakllanmoqda' END END AS level_activity,
         CASE l_partkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Futbol'] WHEN 2 THEN ['Shaxmat']
              WHEN 3 THEN ['Futbol', 'Shaxmat'] ELSE ['Suzish', 'Futbol'] END AS sports,
         NOT (l_discount >= 0.01 AND l_tax >= 0.01 AND l_quantity >= 5) AS partial,
         l_returnflag = 'R' AS delivered,
         CASE WHEN l_returnflag = 'R' THEN {FIN} + INTERVAL 1 HOUR END AS delivered_at,
         {FIN} AS created_at
  FROM lineitem WHERE l_linestatus = 'F')""",
    "messages": f"""
messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS ord, role,
         CASE WHEN role = 'assistant' THEN
              (CASE WHEN turn % 2 = 1 THEN '> Savol ' || CAST(turn AS VARCHAR) || {NL} || '>qisqa javob' || {NL} ELSE '' END)
              || text ||
              (CASE (conv_id + turn) % 6
                 WHEN 0 THEN {NL} || '[YAKUN: MANTIQ]'
                 WHEN 1 THEN ' [yakun:psixologiya] davom'
                 WHEN 2 THEN {CR} || {NL} || '[YAKUN:  HARAKAT ]' || {CR} || {NL}
                 WHEN 3 THEN {NL} || {NL} || '[YAKUN: MANTIQ]' || {NL} || '[YAKUN: HARAKAT]'
                 WHEN 4 THEN {NL} || '[YAKUN: SPORT]'
                 ELSE '' END)
              ELSE text END AS content,
         role = 'system' AS meta,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn // 2 AS INTEGER)) AS created_at
  FROM conversations)""",
    "contacts": f"""
contacts AS (
  SELECT o_orderkey AS contact_id, o_orderkey AS child_id, {phone_raw('c_custkey')} AS phone_raw,
         c_name || '-' || CAST(o_orderkey % 3 AS VARCHAR) AS parent_name,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'p' || CAST(o_orderkey % 3 AS VARCHAR) || '@example.uz' END AS email,
         o_orderpriority = '1-URGENT' AS marketing,
         CASE WHEN o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'v1' ELSE 'v2' END AS consent_version,
         o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "funnel_events": """
funnel_events AS (
  SELECT CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'finished'
              WHEN 'click' THEN 'contact' ELSE 'delivered' END AS metric, ts
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase'))""",
}

ORDER = ["parents", "children", "sessions", "reports", "messages", "contacts", "funnel_events"]


def with_views(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` the named adapter views (in dependency order), extra CTEs, then ``body``."""
    ctes = [VIEWS[n].strip() for n in ORDER if n in names] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
