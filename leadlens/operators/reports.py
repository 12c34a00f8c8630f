"""Report parsing, splitting and auditing — all native string/JSON expressions.

JSON is parsed with ``try_parse_json`` (variant), which rejects what
JSON.parse rejects (single quotes, NaN, trailing commas, truncation) and,
with ``spark.sql.variant.allowDuplicateKeys``, keeps the last duplicate key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.exprs import JS_SPACE, TRACKS, js_trim, marker_like, marker_pattern, norm_level

BULLET_RE = r"^- \*\*(.+?)\*\* — (.*)$"
NUMBERED_RE = r"^([0-9]+)\. (.*)$"
CARD_RE = r"(?m)^>[ \t]?(.*)$"
LEVEL_RANK = {"shakllanmoqda": 1, "meyorda": 2, "kuchli": 3}


# JS \s without the line feed: what may surround a marker on its own line.
_LINE_WS = JS_SPACE.replace("\\n", "")
# Patterns start with a case-sensitive literal ('\\n', '[', '`') so the regex
# engine skips ahead cheaply; only the words inside are case-insensitive.
_MARKER_CORE = marker_pattern(*TRACKS)
# A line feed followed by a marker-only line (the text gets a leading '\\n').
_MARKER_LINE_RE = "\\n" + _LINE_WS + _MARKER_CORE + _LINE_WS + "(?=\\n|\\z)"
FENCE_FULL_RE = "(```(?i:json)(?s:.*?)```)"


def strip_markers(text: Column) -> Column:
    """Drop lines that are only a marker, then inline markers, then trim.

    Same result as split('\\n') / filter / join: with a '\\n' put in front, each
    marker-only line goes together with the line feed before it, so the blank
    line before a marker survives. Texts without '[' skip the regexes.
    """
    t = F.coalesce(text, F.lit(""))
    lines_gone = F.substring(F.regexp_replace(F.concat(F.lit("\n"), t), _MARKER_LINE_RE, ""), 2, 1 << 30)
    cleaned = F.regexp_replace(lines_gone, _MARKER_CORE, "")
    return js_trim(F.when(t.contains("["), cleaned).otherwise(t))


def parse_report(raw: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Raw reply -> content_md, three levels, sports (and riasec when present).

    The last json fence wins; it is cut from the text even when its JSON is
    bad; bad JSON gives NULL levels and empty sports; an earlier valid fence
    is not used. Non-object levels -> NULL; non-array sports -> [].
    """
    d = raw.withColumn("_t", strip_markers(F.col(text_col)))
    t = F.col("_t")
    fences = F.when(t.contains("```"), F.regexp_extract_all(t, F.lit(FENCE_FULL_RE), 1))
    d = d.withColumn("_full", F.try_element_at(fences, F.lit(-1)))
    full = F.col("_full")
    # Text after the last occurrence of the fence; the head is what precedes it.
    tail = F.call_function("substring_index", t, full, F.lit(-1))
    head = F.substring(t, F.lit(1), F.length(t) - F.length(full) - F.length(tail))
    d = d.withColumn("content_md", F.when(full.isNull(), t).otherwise(js_trim(F.concat(head, tail))))
    d = d.withColumn("_b", js_trim(F.regexp_extract(full, r"(?s)^```....\s*(.*)```\z", 1)))
    b = F.col("_b")
    # JSON.parse rejects text after the value; the variant parser does not,
    # so an object must also end at the closing brace.
    d = d.withColumn("_v", F.when(b.startswith("{") & b.endswith("}"), F.try_parse_json(b)))
    # Casting to map / array succeeds exactly when the value is an object / array.
    levels_ok = F.try_variant_get("_v", "$.levels", "map<string,variant>").isNotNull()
    sp = F.try_variant_get("_v", "$.sports", "array<variant>")
    sports = F.filter(F.transform(sp, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null"))),
                      lambda x: x != "")
    riasec = F.try_variant_get("_v", "$.riasec", "array<string>")

    def lvl(key: str) -> Column:
        at = f"$.levels.{key}"
        plain = F.try_variant_get("_v", at, "map<string,variant>").isNull()  # an object is no level
        return F.when(levels_ok & plain, norm_level(F.try_variant_get("_v", at, "string")))

    out_cols = [c for c in raw.columns if c != text_col]
    return d.select(*out_cols, "content_md",
                    lvl("mantiq").alias("level_logic"), lvl("psixologiya").alias("level_psych"),
                    lvl("harakat").alias("level_activity"),
                    F.coalesce(sports, F.array().cast("array<string>")).alias("sports"),
                    riasec.alias("riasec"))


def _section_chunks(text: Column) -> Column:
    """'Heading\nbody' chunks: split where a line starts with '## ', drop the
    text before the first heading and headings with no line after them."""
    chunks = F.slice(F.split(F.coalesce(text, F.lit("")), r"(?m)^## ", -1), 2, 1 << 30)
    return F.filter(chunks, lambda ch: ch.contains("\n"))


def report_sections(parsed: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per '## ' section: (key, ord, heading, body), in text order.

    A body runs to the next line starting with '## ' (its final newline
    included) or to the end of the text.
    """
    z = parsed.select(key, F.posexplode(_section_chunks(F.col("content_md"))).alias("pos", "chunk"))
    return z.select(key, (F.col("pos") + 1).cast("long").alias("ord"),
                    F.substring_index("chunk", "\n", 1).alias("heading"),
                    F.expr("substring(chunk, instr(chunk, '\\n') + 1)").alias("body"))


def report_bullets(sections: DataFrame, key: str = "session_id") -> DataFrame:
    """Bullet items '- **Name** — text' and numbered items 'N. text' of each section."""
    lines = sections.select(key, F.col("ord").alias("section"),
                            F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    bullet = F.col("line").rlike(BULLET_RE)
    numbered = F.col("line").rlike(NUMBERED_RE)
    return (lines.filter(bullet | numbered)
            .select(key, "section", (F.col("pos") + 1).cast("long").alias("line_no"),
                    F.when(bullet, F.lit("bullet")).otherwise(F.lit("numbered")).alias("kind"),
                    F.when(bullet, F.regexp_extract("line", BULLET_RE, 1))
                     .otherwise(F.regexp_extract("line", NUMBERED_RE, 1)).alias("name"),
                    F.when(bullet, F.regexp_extract("line", BULLET_RE, 2))
                     .otherwise(F.regexp_extract("line", NUMBERED_RE, 2)).alias("text")))


def child_facing_cards(messages: DataFrame) -> DataFrame:
    """Read-aloud '>' lines of assistant replies, one row per card."""
    a = messages.filter(F.col("role") == "assistant")
    cards = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(CARD_RE), 1)
    return a.select("session_id", "id", F.posexplode(cards).alias("pos", "card")).select(
        "session_id", "id", (F.col("pos") + 1).cast("long").alias("card_no"), "card")


def adult_text(messages: DataFrame) -> DataFrame:
    """The rest of each assistant reply: its non-'>' lines."""
    a = messages.filter(F.col("role") == "assistant")
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    return a.select("session_id", "id",
                    F.array_join(F.filter(lines, lambda ln: ~ln.startswith(">")), "\n").alias("adult_text"))


def report_quality_audit(parsed: DataFrame) -> DataFrame:
    """Contract checks on stored reports (the live-smoke warnings, per row)."""
    headings = F.regexp_count("content_md", F.lit(r"(?m)^## "))  # every heading, with a body or without
    p = parsed.withColumn("sections", F.coalesce(headings, F.lit(0)))
    lv = [F.col("level_logic"), F.col("level_psych"), F.col("level_activity")]
    has_null = lv[0].isNull() | lv[1].isNull() | lv[2].isNull()
    all_kuchli = (lv[0] == "kuchli") & (lv[1] == "kuchli") & (lv[2] == "kuchli")
    body_ok = F.length("content_md") > 400
    sec = F.coalesce(F.col("sections"), F.lit(0)).cast("long")
    partial_ok = ~F.col("partial") | has_null
    not_all_kuchli = ~F.coalesce(all_kuchli, F.lit(False))
    no_marker = ~marker_like(F.col("content_md"))
    return p.select("session_id", F.length("content_md").cast("long").alias("body_chars"), sec.alias("sections"),
                    body_ok.alias("body_ok"), (sec >= 3).alias("sections_ok"), partial_ok.alias("partial_ok"),
                    not_all_kuchli.alias("not_all_kuchli"), no_marker.alias("no_marker_left"),
                    (body_ok & (sec >= 3) & partial_ok & not_all_kuchli & no_marker).alias("ok"))


def premature_markers(progress: DataFrame, gate: DataFrame) -> DataFrame:
    """Sessions reporting a track done while the child gave zero real answers."""
    j = progress.join(gate, "session_id", "inner")
    anyd = F.col("done_mantiq") | F.col("done_psixologiya") | F.col("done_harakat")
    return j.filter(anyd & (F.col("real_answers") == 0)).select(
        "session_id", "real_answers", "done_mantiq", "done_psixologiya", "done_harakat")


def first_report_wins(attempts: DataFrame) -> DataFrame:
    """Exactly one report per session: the first insert (created_at, then token).

    ``min_by`` over a struct key is a plain aggregate: partial per task, one
    row per session through the shuffle, no window sort.
    """
    key = F.struct("created_at", "share_token")
    return attempts.groupBy("session_id").agg(
        F.min_by("share_token", key).alias("share_token"),
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("attempts"))


def _rank(c: Column) -> Column:
    e = F.lit(None).cast("int")
    for k, v in LEVEL_RANK.items():
        e = F.when(c == k, F.lit(v)).otherwise(e)
    return e


def progress_timeline(reports: DataFrame) -> DataFrame:
    """Per child, reports in time order with the previous logic level and the rank change."""
    from leadlens.plans.sequence import lay_out, sequence
    order = ["created_at", "session_id"]
    laid = lay_out(reports.select("child_id", "session_id", "created_at", "level_logic"), "child_id", order)
    s = sequence(laid, "child_id", order, prev_cols=["level_logic"])
    prev = F.col("_prev_level_logic")
    return s.select("child_id", "session_id", "created_at", F.col("_rn").cast("long").alias("seq"),
                    "level_logic", prev.alias("prev_level_logic"),
                    (_rank(F.col("level_logic")) - _rank(prev)).alias("level_delta"))


def reassessment_due(parents: DataFrame, children: DataFrame, sessions: DataFrame, as_of: Column,
                     months: int = 3) -> DataFrame:
    """Consenting parents whose latest finished session is N months old or older."""
    last = (sessions.filter(F.col("finished_at").isNotNull())
            .groupBy("child_id").agg(F.max("finished_at").alias("last_finished_at")))
    kids = children.filter(F.col("parent_id").isNotNull()).select("id", "parent_id")
    per_parent = (kids.join(last, kids.id == last.child_id, "inner")
                  .groupBy("parent_id").agg(F.max("last_finished_at").alias("last_finished_at")))
    p = parents.filter(F.col("marketing_consent")).select("id", "name")
    cutoff = F.timestamp_add("MONTH", F.lit(-months), as_of)
    return (p.join(per_parent, p.id == per_parent.parent_id, "inner")
            .filter(F.col("last_finished_at") <= cutoff)
            .select(F.col("id").alias("parent_id"), "name", "last_finished_at"))


def greeting_audit(messages: DataFrame) -> DataFrame:
    """The conversation half of the live-smoke contract, per session: the
    first assistant reply (the greeting) is longer than 50 chars, holds a
    child-facing '>' card and reports no track as done yet. ``min_by`` over
    (created_at, id): an aggregate, no window."""
    a = messages.filter(F.col("role") == "assistant")
    g = a.groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("greeting"))
    chars = F.length(F.coalesce("greeting", F.lit(""))).cast("long")
    card = F.coalesce(F.col("greeting").rlike(r"(?m)^>"), F.lit(False))
    early = marker_like(F.col("greeting"))
    return g.select("session_id", chars.alias("greeting_chars"), (chars > 50).alias("greeting_ok"),
                    card.alias("has_card"), (~early).alias("no_early_marker"),
                    ((chars > 50) & card & ~early).alias("ok"))
