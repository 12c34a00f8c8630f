"""Erasure, retention and data-quality rules.

Cascades start from one id list. When tables are written, integer ids become
bitmaps that are broadcast up to a fixed size, so wide rows are not shuffled;
otherwise each table is shuffled once on its foreign key by a ``left_anti`` join.
Audits are counts.
DQ rules split input into valid rows and quarantined rows with the reason of
the first failing rule, in the order the product checks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leadlens.functions.exprs import (LEAD_STATUS_ORDER, LEVELS, MAX_MESSAGE_CHARS, js_trim, normalize_phone, parse_int_prefix)
from leadlens.sources.snapshots import write_snapshot, write_tables


def last_activity(sessions: DataFrame) -> DataFrame:
    """Per child, the most recent session time: finished_at, else started_at."""
    return sessions.groupBy("child_id").agg(F.max(F.coalesce("finished_at", "started_at")).alias("last_activity"))


def children_expired(sessions: DataFrame, as_of: Column, months: int = 24) -> DataFrame:
    """Children with at least one session and none active since as_of - N months."""
    if months <= 0:
        raise ValueError("retention months must be > 0")
    cutoff = F.timestamp_add("MONTH", F.lit(-months), as_of)
    return last_activity(sessions).filter(F.col("last_activity") < cutoff).select(F.col("child_id").alias("id"))


def orphan_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents no child points to (any of them, with or without a phone)."""
    linked = children.filter(F.col("parent_id").isNotNull()).select("parent_id")
    return parents.join(linked, parents.id == linked.parent_id, "left_anti")


#: Bitmaps that a cascade broadcasts at most, each of 4 KB for 32,768 neighbouring ids: 64 MB.
MOST_MARKS = 16_384


def id_marks(ids: DataFrame) -> DataFrame | None:
    """``ids`` (id) as bitmaps (_bucket, _bits), written once; None when they are no integers or so scattered that they
    would take more than MOST_MARKS bitmaps."""
    if not isinstance(ids.schema["id"].dataType, IntegralType):
        return None
    i = F.col("id").cast("long")
    spread = ids.where(i.isNotNull()).select(F.bitmap_bucket_number(i).alias("_bucket"), F.bitmap_bit_position(i).alias("_pos"))
    if spread.select("_bucket").distinct().count() > MOST_MARKS:
        return None
    # Ids are brought together first: partial bitmaps of 4 KB from each task would be far larger than they.
    marks = spread.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_pos").alias("_bits"))
    return write_snapshot(marks, "id_marks")


def _split_by_ids(df: DataFrame, key: str, ids: DataFrame, marks: DataFrame | None, kept: bool) -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``kept``: is not) among ``ids``. With ``marks`` a lookup in the broadcast bitmaps,
    so no row of ``df`` is shuffled or sorted; else a join."""
    if marks is None or not isinstance(df.schema[key].dataType, IntegralType):
        return df.join(ids.select(F.col("id").alias(key)), key, "left_anti" if kept else "left_semi")
    k = F.col(key).cast("long")
    at = F.bitmap_bit_position(k)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    rows = df.join(F.broadcast(marks), F.bitmap_bucket_number(k) == F.col("_bucket"), "left")
    return rows.where(~found if kept else found).select(key, *(c for c in df.columns if c != key))


def cascade_children(children: DataFrame, sessions: DataFrame, messages: DataFrame, reports: DataFrame,
                     gone_children: DataFrame, marks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Remove children and everything hanging off them; ``marks`` are ``id_marks`` of the children."""
    gone_sessions = _split_by_ids(sessions, "child_id", gone_children, marks, False).select(F.col("id").alias("session_id"))
    return {
        "children": _split_by_ids(children, "id", gone_children, marks, True),
        "sessions": _split_by_ids(sessions, "child_id", gone_children, marks, True),
        "messages": messages.join(gone_sessions, messages.session_id.cast("string") == gone_sessions.session_id,
                                  "left_anti"),
        "reports": _split_by_ids(reports, "child_id", gone_children, marks, True),
    }


def _audit(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in before:
        b = before[name].agg(F.count(F.lit(1)).alias("before")).withColumn("table", F.lit(name))
        a = after[name].agg(F.count(F.lit(1)).alias("after")).withColumn("table", F.lit(name))
        row = b.join(a, "table").select("table", "before", "after",
                                        (F.col("before") - F.col("after")).alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out


def retention_purge(parents, children, sessions, messages, reports, as_of: Column, months: int = 24,
                    write: bool = False):
    """Monthly purge: expired children (cascade), then every parent left without
    children. Returns (new tables, per-table audit). With ``write`` the new
    tables are written as one snapshot version first and the audit counts the
    written files (lineage cut; a retry re-reads instead of recomputing)."""
    gone = children_expired(sessions, as_of, months)
    if write:  # five rewrites use the ids: aggregate the sessions once
        gone = write_snapshot(gone, "retention_purge_ids")
    after = cascade_children(children, sessions, messages, reports, gone, id_marks(gone) if write else None)
    after["parents"] = parents.join(orphan_parents(parents, after["children"]).select("id"), "id", "left_anti")
    if write:
        after = write_tables(after, "retention_purge")
    before = {"parents": parents, "children": children, "sessions": sessions, "messages": messages,
              "reports": reports}
    return after, _audit(before, after)


def erase_parents(parents, children, sessions, messages, reports, requests: DataFrame, write: bool = False):
    """Right to erasure: cascade parents -> children -> sessions -> messages, reports.

    Returns (new tables, audit, not_found) where not_found lists requested ids
    that match no parent.
    """
    req = requests.select(F.col("parent_id").alias("id")).distinct()
    not_found = req.join(parents.select("id"), "id", "left_anti")
    gone_children = (children.filter(F.col("parent_id").isNotNull())
                     .join(req.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id"))
    if write:
        gone_children = write_snapshot(gone_children, "erase_parents_ids")
    after = cascade_children(children, sessions, messages, reports, gone_children, id_marks(gone_children) if write else None)
    after["parents"] = parents.join(req, "id", "left_anti")
    if write:
        after = write_tables(after, "erase_parents")
    before = {"parents": parents, "children": children, "sessions": sessions, "messages": messages,
              "reports": reports}
    return after, _audit(before, after), not_found


# ---------------------------------------------------------------------------
# Data-quality rules
# ---------------------------------------------------------------------------
def _first_failing(rules: list[tuple[Column, str]]) -> Column:
    e = F.lit(None).cast("string")
    for cond, code in reversed(rules):
        e = F.when(F.coalesce(cond, F.lit(True)), F.lit(code)).otherwise(e)
    return e


def dq_session_requests(requests: DataFrame) -> DataFrame:
    """consent must be exactly true; nickname trimmed 1-60; grade int 1-4;
    age blank or int 3-18; goal cut to 300, notes to 500 (blank -> NULL)."""
    nick = js_trim(F.coalesce(F.col("nickname"), F.lit("")))
    grade = parse_int_prefix(F.col("grade"))
    age_blank = F.col("age").isNull() | (F.col("age").cast("string") == "")
    age = parse_int_prefix(F.col("age"))
    reason = _first_failing([
        (~F.coalesce(F.col("consent"), F.lit(False)), "consent_required"),
        (nick == "", "required"),
        (F.length(nick) > 60, "too_long"),
        (grade.isNull() | (grade < 1) | (grade > 4), "bad_grade"),
        (~age_blank & (age.isNull() | (age < 3) | (age > 18)), "bad_age"),
    ])

    def opt(c: str, n: int) -> Column:
        s = js_trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(s == "", F.lit(None).cast("string")).otherwise(F.substring(s, 1, n))

    return requests.select("request_id", reason.isNull().alias("valid"), reason.alias("reason"),
                           F.when(reason.isNull(), nick).alias("nickname"),
                           F.when(reason.isNull(), grade).alias("grade"),
                           F.when(reason.isNull() & ~age_blank, age).alias("age"),
                           F.when(reason.isNull(), opt("goal", 300)).alias("goal"),
                           F.when(reason.isNull(), opt("notes", 500)).alias("notes"))


def dq_messages(messages: DataFrame, max_chars: int = MAX_MESSAGE_CHARS,
                sessions: DataFrame | None = None) -> DataFrame:
    """User messages: the session must not be finished yet (when ``sessions``
    is given: sent after finished_at -> session_finished), then content,
    trimmed, must be 1..max_chars characters."""
    m = messages.filter(F.col("role") == "user")
    rules = []
    if sessions is not None:
        fin = sessions.select(F.col("id").alias("_sid"), F.col("finished_at").alias("_fin"))
        m = m.join(fin, m.session_id == fin._sid, "left")
        rules.append((F.coalesce(F.col("created_at") > F.col("_fin"), F.lit(False)), "session_finished"))
    s = js_trim(F.coalesce(F.col("content"), F.lit("")))
    reason = _first_failing(rules + [(s == "", "required"), (F.length(s) > max_chars, "too_long")])
    return m.select("session_id", "id", reason.isNull().alias("valid"), reason.alias("reason"),
                    F.length(s).cast("long").alias("chars"))


def dq_contacts(contacts: DataFrame) -> DataFrame:
    """Parent name 1..100; phone blank -> NULL, else it must normalize; email
    cut to 120; marketing true only for true/'true'/1/'1'."""
    name = js_trim(F.coalesce(F.col("parent_name"), F.lit("")))
    raw = js_trim(F.coalesce(F.col("phone_raw").cast("string"), F.lit("")))
    phone = normalize_phone(F.col("phone_raw"))
    reason = _first_failing([(name == "", "required"), (F.length(name) > 100, "too_long"),
                             ((raw != "") & phone.isNull(), "bad_phone")])
    email = js_trim(F.coalesce(F.col("email"), F.lit("")))
    mk = F.coalesce(F.col("marketing").cast("string"), F.lit(""))  # 'TRUE' is no consent
    return contacts.select("contact_id", reason.isNull().alias("valid"), reason.alias("reason"),
                           F.when(raw == "", F.lit(None).cast("string")).otherwise(phone).alias("phone"),
                           F.when(email == "", F.lit(None).cast("string")).otherwise(F.substring(email, 1, 120)).alias("email"),
                           mk.isin("true", "1").alias("marketing"))


def _violations(df: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _dupes(df: DataFrame, col: str, table: str) -> DataFrame:
    d = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _violations(d, table, f"unique_{col}", F.col(col))


#: Constraints of the product's tables, as data: columns that identify a row or may not repeat, columns that must be
#: there, allowed values, allowed ranges, references. Fixed values.
UNIQUE = {"parents": ["id", "phone"], "children": ["id"], "sessions": ["id", "session_token"], "messages": ["id"],
          "reports": ["session_id", "share_token"]}
REQUIRED = {"parents": ["name", "lead_status"], "children": ["nickname", "grade"],
            "sessions": ["child_id", "session_token", "status"], "messages": ["session_id", "role", "content"],
            "reports": ["session_id", "child_id", "share_token"]}
DOMAINS = {("parents", "lead_status"): LEAD_STATUS_ORDER, ("sessions", "status"): ["active", "paused", "finished", "abandoned"],
           ("messages", "role"): ["user", "assistant"], ("reports", "level_logic"): LEVELS,
           ("reports", "level_psych"): LEVELS, ("reports", "level_activity"): LEVELS}
RANGES = {("children", "grade"): (1, 4), ("children", "age"): (3, 18)}
REFERENCES = [("children", "parent_id", "parents"), ("sessions", "child_id", "children"),
              ("messages", "session_id", "sessions"), ("reports", "session_id", "sessions"),
              ("reports", "child_id", "children")]


def dq_entities(parents, children, sessions, messages, reports) -> DataFrame:
    """One row per violated constraint (table, rule, key): repeated or missing values, values outside their domain or
    range, references to rows that do not exist. NULL is reported as missing where it may not be, and nowhere else."""
    tables = {"parents": parents, "children": children, "sessions": sessions, "messages": messages, "reports": reports}
    key = {name: F.col("session_id" if name == "reports" else "id") for name in tables}
    found = [_dupes(tables[t], c, t) for t, columns in UNIQUE.items() for c in columns]
    found += [_violations(tables[t].filter(F.col(c).isNull()), t, f"required_{c}", key[t])
              for t, columns in REQUIRED.items() for c in columns]
    found += [_violations(tables[t].filter(~F.col(c).isin(*allowed)), t, f"{c}_domain", key[t])
              for (t, c), allowed in DOMAINS.items()]
    found += [_violations(tables[t].filter(~F.col(c).between(*bounds)), t, f"{c}_range", key[t])
              for (t, c), bounds in RANGES.items()]
    for t, c, target in REFERENCES:
        ids = tables[target].select(F.col("id").cast("string").alias("target_id"))
        rows = tables[t].filter(F.col(c).isNotNull())
        found.append(_violations(rows.join(ids, F.col(c).cast("string") == F.col("target_id"), "left_anti"),
                                 t, f"fk_{c}", key[t]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
