"""Lead roll-ups, filters, detail documents and the CSV export.

Scale notes: sessions and reports are reduced to one row per child before
any join, and children to one row per parent, so the big tables are
shuffled once each (with map-side partial aggregation) and never fanned out
sessions x reports as the naive four-way join would.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents keep null members, as JSON.stringify does (Spark drops them by default).
JSON_OPTS = {"ignoreNullFields": "false"}

from leadlens.functions.exprs import (LEAD_STATUS_ORDER, display_phone, format_phone, iso_utc, status_to_enum,
                                      status_to_label)
from leadlens.plans.sequence import positions


def child_label(nickname: Column, grade: Column) -> Column:
    return F.concat(nickname, F.lit(" · "), grade.cast("string"), F.lit("-sinf"))


def per_child_activity(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """(child_id, distinct sessions_count, last_report_at) from one union + one aggregation."""
    s = sessions.select("child_id", F.col("id").alias("session"), F.lit(None).cast("timestamp_ntz").alias("rep_at"))
    r = reports.select("child_id", F.lit(None).cast(sessions.schema["id"].dataType).alias("session"),
                       F.col("created_at").alias("rep_at"))
    return (s.unionByName(r).groupBy("child_id")
            .agg(F.count_distinct("session").alias("sessions_count"),
                 F.max("rep_at").alias("last_report_at")))


def lead_rollup(parents: DataFrame, children: DataFrame, sessions: DataFrame,
                reports: DataFrame) -> DataFrame:
    """One row per parent: distinct children, sessions, last report, children label.

    Counts are 0 and last_report_at / children_label NULL when there is nothing.
    """
    act = per_child_activity(sessions, reports)
    kids = children.filter(F.col("parent_id").isNotNull()) \
        .select("id", "parent_id", child_label(F.col("nickname"), F.col("grade")).alias("label"))
    per_parent = (kids.join(act, kids.id == act.child_id, "left")
                  .groupBy("parent_id")
                  .agg(F.count("id").alias("children_count"),  # id is the key; act is 1 row per child
                       F.coalesce(F.sum("sessions_count"), F.lit(0)).cast("long").alias("sessions_count"),
                       F.max("last_report_at").alias("last_report_at"),
                       F.array_sort(F.collect_set("label")).alias("labels")))
    p = parents.select("id", "name", "phone", "marketing_consent", "lead_status", "created_at")
    return (p.join(per_parent, p.id == per_parent.parent_id, "left")
            .select("id", "name", "phone", "marketing_consent", "lead_status", "created_at",
                    F.coalesce("children_count", F.lit(0)).cast("long").alias("children_count"),
                    F.coalesce("sessions_count", F.lit(0)).cast("long").alias("sessions_count"),
                    "last_report_at",
                    F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.array_join("labels", ", "))
                     .alias("children_label")))


def filter_parents(parents: DataFrame, children: DataFrame, as_of: Column, status: str | None = None,
                   grade=None, since_days=None) -> DataFrame:
    """Optional filters composed at plan-build time; only given ones are applied.

    status: enum or label text; 'all', empty or unknown -> no filter.
    grade: semi-join (EXISTS a child with the grade) — the roll-up still counts
    all children of a kept parent.
    since_days: created_at >= as_of - N days (inclusive).
    """
    p = parents
    if status is not None and str(status) != "all":
        st = status_to_enum(F.lit(str(status)))
        # Unknown text maps to NULL, which means "no filter" (not "no rows").
        p = p.filter(st.isNull() | (F.col("lead_status") == st))
    g = _parse_int(grade) if grade is not None and str(grade) != "all" else None
    if g is not None:
        kids = children.filter((F.col("grade") == g) & F.col("parent_id").isNotNull()).select("parent_id")
        p = p.join(kids, p.id == kids.parent_id, "left_semi")
    n = _parse_int(since_days) if since_days is not None and str(since_days) != "all" else None
    if n is not None:
        p = p.filter(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-n), as_of))
    return p


def _parse_int(v):
    """parseInt(v, 10) on a request parameter; None when it has no leading digits."""
    m = re.match(r"\s*([+-]?\d+)", str(v))
    return int(m.group(1)) if m else None


def leads(parents, children, sessions, reports, as_of, status=None, grade=None, since_days=None) -> DataFrame:
    return lead_rollup(filter_parents(parents, children, as_of, status, grade, since_days),
                       children, sessions, reports)


def lead_rows(rollup: DataFrame) -> DataFrame:
    """Admin list shape: display phone (NULL stays NULL), status label."""
    return rollup.select(
        "id", "name", display_phone(F.col("phone")).alias("phone"),
        "children_label", "children_count", "sessions_count", "last_report_at",
        "lead_status", status_to_label(F.col("lead_status")).alias("lead_status_label"),
        "marketing_consent", "created_at")


def list_order() -> list[Column]:
    """Newest first, leads without a date last, id as the tie-break; all ascending."""
    newest = -F.unix_micros(F.col("created_at").cast("timestamp"))
    return [F.coalesce(newest, F.lit((1 << 63) - 1)), F.col("id")]


def leads_sorted(rollup: DataFrame) -> DataFrame:
    """The lead list with each lead's place in it (``pos``)."""
    return positions(rollup, list_order())


# ---------------------------------------------------------------------------
# CSV export
# ---------------------------------------------------------------------------
# Header cells and consent words of the export.
CSV_HEADER = ["Ota-ona", "Telefon", "Holat", "Marketing roziligi", "Bolalar", "Mashg'ulotlar", "Qo'shilgan"]
CSV_YES, CSV_NO = "Ha", "Yo'q"
BOM = "﻿"


def csv_cell(c: Column) -> Column:
    """Quote every cell, double quotes, and prefix formula-leading text with '."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rollup: DataFrame) -> DataFrame:
    """One quoted CSV line per lead, with the sort keys kept for the sink."""
    phone = F.when(F.coalesce(F.col("phone"), F.lit("")) == "", F.lit("")).otherwise(format_phone(F.col("phone")))
    cells = [F.col("name"), phone, status_to_label(F.col("lead_status")),
             F.when(F.col("marketing_consent"), F.lit(CSV_YES)).otherwise(F.lit(CSV_NO)),
             F.coalesce(F.col("children_label"), F.lit("")), F.col("sessions_count"),
             F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))]
    return rollup.select("id", "created_at", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("csv_line"))


def csv_file_lines(lines: DataFrame) -> DataFrame:
    """(line, csv_line) of the file: BOM and header are line 0, the leads follow in list order."""
    header = BOM + ",".join('"' + h.replace('"', '""') + '"' for h in CSV_HEADER)
    head = lines.sparkSession.createDataFrame([(0, header)], "line long, csv_line string")
    return head.unionByName(positions(lines, list_order(), "line").select("line", "csv_line"))


def write_leads_csv(lines: DataFrame, path: str, files: int | None = None) -> None:
    """The file of ``csv_file_lines`` as part files, '\n' between lines: read in the order of their names they are the
    file. Ranges of line numbers are sorted side by side, none holds the whole list.

    Spark's text writer ends every line with the separator (an empty one is
    rejected), so the file ends with one '\n' where the product's response
    has none; all else is byte-identical.
    """
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (csv_file_lines(lines).repartitionByRange(n, "line").sortWithinPartitions("line")
     .select("csv_line").write.mode("overwrite").option("lineSep", "\n").text(path))


# ---------------------------------------------------------------------------
# Children, detail documents, report joins
# ---------------------------------------------------------------------------
def lead_children(children: DataFrame, sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Linked children, each session, and the report of that session (joined on session)."""
    c = children.filter(F.col("parent_id").isNotNull()) \
        .select("parent_id", F.col("id").alias("child_id"), "nickname", "grade", F.col("created_at").alias("child_created_at"))
    s = sessions.select(F.col("id").alias("session_id"), F.col("child_id").alias("s_child"), "status", "started_at")
    r = reports.select(F.col("session_id").alias("r_session"), "share_token", "partial",
                       F.col("created_at").alias("report_at"))
    return (c.join(s, c.child_id == s.s_child, "left")
            .join(r, F.col("session_id") == F.col("r_session"), "left")
            .select("parent_id", "child_id", "nickname", "grade", "child_created_at", "session_id",
                    "status", "started_at", "share_token", "partial", "report_at"))


def lead_children_sorted(rows: DataFrame) -> DataFrame:
    """``lead_children`` with ``pos``, a row's place among those of its parent: children by creation, then sessions by
    start; ids break ties."""
    order = [F.col(c) for c in ("child_created_at", "child_id", "started_at", "session_id")]
    return positions(rows, order, key="parent_id")


def lead_detail(lead_children_df: DataFrame) -> DataFrame:
    """Per linked child: its sessions that produced a report, in start order.

    Children without any keep an empty list. date = report time, else start.
    """
    d = lead_children_df.withColumn("date", F.coalesce("report_at", "started_at"))
    item = F.struct(F.col("started_at").alias("_o1"), F.col("share_token").alias("_o2"),
                    F.col("date"), F.col("partial"), F.col("share_token"))
    g = d.groupBy("parent_id", "child_id", "nickname", "grade", "child_created_at").agg(
        F.array_sort(F.collect_list(F.when(F.col("share_token").isNotNull(), item))).alias("items"))
    return g.select("parent_id", "child_id", F.col("nickname").alias("name"), "grade", "child_created_at",
                    F.transform("items", lambda x: F.struct(x["date"].alias("date"), x["partial"].alias("partial"),
                                                            x["share_token"].alias("share_token"))).alias("sessions"))


def lead_detail_json(parents: DataFrame, detail: DataFrame) -> DataFrame:
    """One JSON document per parent: parent fields, children[].sessions[], and the status options."""
    kids = detail.groupBy("parent_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("child_created_at").alias("_o"), F.col("child_id").alias("_id"),
                 F.col("name"), F.col("grade"), F.col("sessions")))).alias("kids"))
    p = parents.select("id", "name", display_phone(F.col("phone")).alias("phone"), "marketing_consent",
                       "consent_text_version", iso_utc(F.col("consented_at")).alias("consented_at"), "lead_status",
                       "admin_notes", iso_utc(F.col("created_at")).alias("created_at"))
    j = p.join(kids, p.id == kids.parent_id, "left")

    def session(x: Column) -> Column:
        return F.struct(iso_utc(x["date"]).alias("date"), x["partial"].alias("partial"),
                        x["share_token"].alias("share_token"))

    def child(k: Column) -> Column:
        return F.struct(k["name"].alias("name"), k["grade"].alias("grade"),
                        F.transform(k["sessions"], session).alias("sessions"))

    statuses = F.array(*[F.struct(F.lit(v).alias("value"), status_to_label(F.lit(v)).alias("label"))
                         for v in LEAD_STATUS_ORDER])
    doc = F.struct(F.struct(*[F.col(c) for c in p.columns]).alias("parent"),
                   F.transform(F.coalesce("kids", F.array().cast(kids.schema["kids"].dataType)), child).alias("children"),
                   statuses.alias("statuses"))
    return j.select("id", F.to_json(doc, JSON_OPTS).alias("doc"))


def report_with_child(reports: DataFrame, children: DataFrame) -> DataFrame:
    c = children.select(F.col("id").alias("c_id"), "nickname", "grade")
    return reports.join(c, reports.child_id == c.c_id, "inner").drop("c_id")


PUBLIC_FIELDS = ["content_md", "nickname", "grade", "partial", "date", "levels", "sports"]


def public_report(rwc: DataFrame, contents: DataFrame) -> DataFrame:
    """What a share link shows: text, child, date, levels and sports. contents: (session_id, content_md)."""
    text = contents.select(F.col("session_id").alias("t_session"), "content_md")
    return rwc.join(text, rwc.session_id == text.t_session, "left").select(
        "share_token", "content_md", "nickname", "grade", "partial", iso_utc(F.col("created_at")).alias("date"),
        F.struct(F.col("level_logic").alias("logic"), F.col("level_psych").alias("psych"),
                 F.col("level_activity").alias("activity")).alias("levels"),
        "sports")


def public_report_json(pub: DataFrame) -> DataFrame:
    return pub.select("share_token", F.to_json(F.struct(*PUBLIC_FIELDS), JSON_OPTS).alias("doc"))


def report_filter_level_sport(reports: DataFrame, children: DataFrame, parents: DataFrame,
                              level: str, sport: str, track_col: str = "level_logic") -> DataFrame:
    """Leads having at least one report with the level on a track and the sport."""
    hits = reports.filter((F.col(track_col) == level) & F.array_contains("sports", sport)).select("child_id")
    kids = children.filter(F.col("parent_id").isNotNull()).select("id", "parent_id")
    parent_ids = kids.join(hits, kids.id == hits.child_id, "left_semi").select("parent_id")
    return parents.join(parent_ids, parents.id == parent_ids.parent_id, "left_semi")


def lookup_by_token(requests: DataFrame, rwc: DataFrame, token_col: str = "token") -> DataFrame:
    """Batch form of the per-request token lookup: every request, found or not."""
    r = rwc.select(F.col("share_token"), "session_id", "child_id", "nickname", "grade")
    return (requests.join(r, requests[token_col] == r.share_token, "left")
            .select(requests[token_col].alias("token"), F.col("share_token").isNotNull().alias("found"),
                    "session_id", "child_id", "nickname", "grade"))


def lead_status_dim(parents: DataFrame) -> DataFrame:
    """Status dimension with live counts: value, label, display position, leads."""
    from leadlens.functions.exprs import status_order
    return (parents.groupBy("lead_status").agg(F.count(F.lit(1)).alias("leads"))
            .select(F.col("lead_status").alias("value"), status_to_label(F.col("lead_status")).alias("label"),
                    status_order(F.col("lead_status")).alias("ord"), "leads"))


def write_documents(docs: DataFrame, path: str, doc_col: str = "doc") -> None:
    """JSON-lines sink for the document jobs (public report, lead detail,
    resume): one document per line, written by every task in parallel."""
    docs.select(doc_col).write.mode("overwrite").option("lineSep", "\n").text(path)
