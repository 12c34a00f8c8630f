"""Identity, consent and other mutations as snapshot-in -> snapshot-out transforms.

Plain Parquet has no MERGE, so every change is a pure function
(target, changes) -> new target: the change batch is first collapsed to one
row per target key with order-aware aggregates (``max_by`` over an
(event time, id) struct), then merged with a single join. No per-row loops,
no driver collects; a hot key (one phone with many contacts) is reduced by
partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.exprs import (display_phone, js_trim, mask_phone, normalize_phone,
                                      status_to_enum)
from leadlens.sources.snapshots import write_snapshot

NEW_ID_BASE = 10 ** 12  # ids of parents inserted by a batch: base + first contact id


def standardize_contacts(contacts: DataFrame) -> DataFrame:
    """Raw contact rows -> normalized, validity, display and log-safe phone columns."""
    n = contacts.select("contact_id", "phone_raw", normalize_phone(F.col("phone_raw")).alias("phone"))
    ph = F.col("phone")
    return n.select("contact_id", "phone_raw", ph, ph.isNotNull().alias("phone_valid"),
                    display_phone(ph).alias("phone_display"), mask_phone(ph).alias("phone_masked"))


def accepted_contacts(contacts: DataFrame) -> DataFrame:
    """Contacts the gate accepts: a blank phone is allowed (NULL), an
    unparseable one rejects the whole submission (``dq_contacts``)."""
    blank = js_trim(F.coalesce(F.col("phone_raw"), F.lit(""))) == ""
    n = normalize_phone(F.col("phone_raw"))
    return (contacts.withColumn("phone", F.when(blank, F.lit(None).cast("string")).otherwise(n))
            .filter(blank | n.isNotNull()))


def _order_key() -> Column:
    return F.struct("ts", "contact_id")


def _collapse(changes: DataFrame, key: str) -> DataFrame:
    """One row per key: last name/version, last non-NULL email, OR of marketing,
    first non-NULL phone, latest consent time, first contact id."""
    o = _order_key()
    return changes.groupBy(key).agg(
        F.max_by("parent_name", o).alias("new_name"),
        F.max_by("email", F.when(F.col("email").isNotNull(), o)).alias("new_email"),
        F.bool_or("marketing").alias("new_marketing"),
        F.max_by("consent_version", o).alias("new_version"),
        F.min_by("phone", F.when(F.col("phone").isNotNull(), o)).alias("new_phone"),
        F.max("ts").alias("new_consented_at"),
        F.min("ts").alias("first_ts"),
        F.min_by("contact_id", o).alias("first_contact_id"))


PARENT_COLS = ["id", "name", "phone", "email", "marketing_consent", "consent_text_version", "consented_at",
               "lead_status", "admin_notes", "created_at"]


def upsert_parents(parents: DataFrame, contacts: DataFrame) -> DataFrame:
    """Dedupe by normalized phone; consent is never downgraded.

    Existing phone: name replaced, email = last non-NULL (else old), marketing
    = old OR any new, version replaced, consented_at = latest. New phone: one
    inserted parent per phone. No phone: every contact inserts its own parent.
    lead_status and notes of existing parents are untouched.
    """
    with_phone = _collapse(contacts.filter(F.col("phone").isNotNull()), "phone")
    # Parents without a phone never match: they bypass the join, so NULL keys
    # (possibly a large share of all parents) are not hashed into one task.
    p_all = parents.select(*PARENT_COLS)
    p = p_all.filter(F.col("phone").isNotNull())
    m = p.join(with_phone, "phone", "full_outer")
    exists = F.col("id").isNotNull()
    has_new = F.col("new_name").isNotNull()
    merged = m.select(
        F.when(exists, F.col("id")).otherwise(F.lit(NEW_ID_BASE) + F.col("first_contact_id")).alias("id"),
        F.when(has_new, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        "phone",
        F.coalesce("new_email", "email").alias("email"),
        (F.coalesce("marketing_consent", F.lit(False)) | F.coalesce("new_marketing", F.lit(False))).alias("marketing_consent"),
        F.when(has_new, F.col("new_version")).otherwise(F.col("consent_text_version")).alias("consent_text_version"),
        F.when(has_new, F.col("new_consented_at")).otherwise(F.col("consented_at")).alias("consented_at"),
        F.coalesce("lead_status", F.lit("new")).alias("lead_status"),
        "admin_notes",
        F.coalesce("created_at", "first_ts").alias("created_at"))
    merged = merged.unionByName(p_all.filter(F.col("phone").isNull()))
    no_phone = contacts.filter(F.col("phone").isNull()).select(
        (F.lit(NEW_ID_BASE) + F.col("contact_id")).alias("id"), F.col("parent_name").alias("name"),
        F.lit(None).cast("string").alias("phone"), "email", F.coalesce("marketing", F.lit(False)).alias("marketing_consent"),
        F.col("consent_version").alias("consent_text_version"), F.col("ts").alias("consented_at"),
        F.lit("new").alias("lead_status"), F.lit(None).cast("string").alias("admin_notes"), F.col("ts").alias("created_at"))
    return merged.unionByName(no_phone)


def split_submissions(contacts: DataFrame, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(first, later): the first submission (ts, then id) of each child in the batch links it; later ones of the
    same child update that family's contact instead of making another. With ``write`` the batch is written, parted."""
    first = contacts.groupBy("child_id").agg(F.min(_order_key()).alias("_first"))
    first = first.select(F.col("child_id").alias("_child"), F.col("_first.contact_id").alias("_contact"))
    tagged = contacts.join(first, contacts.child_id == F.col("_child"), "left")
    is_first = F.col("child_id").isNull() | (F.col("contact_id") == F.col("_contact"))
    if write:
        tagged = write_snapshot(tagged.withColumn("_is_first", is_first), "submissions_parted")
        is_first = F.col("_is_first")
    return (tagged.filter(is_first).select(*contacts.columns), tagged.filter(~is_first).select(*contacts.columns))


def submit_contacts(parents: DataFrame, children: DataFrame, contacts: DataFrame,
                    write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after a batch of accepted submissions of still unlinked children.

    With ``write`` the batch and the upserted parents, which several later steps read, are each computed and written
    once instead of once for each use."""
    if write:
        contacts = write_snapshot(contacts, "submissions")
    first, later = split_submissions(contacts, write)
    upserted = upsert_parents(parents, first)
    if write:
        upserted = write_snapshot(upserted, "upserted_parents")
    linked = link_children(children, first, upserted)
    return update_contact(upserted, later, linked), linked


def link_children(children: DataFrame, contacts: DataFrame, upserted: DataFrame) -> DataFrame:
    """Set parent_id of each contacted, still unlinked child to its (upserted) parent; its first contact decides."""
    contacts, _ = split_submissions(contacts)
    by_phone = upserted.filter(F.col("phone").isNotNull()).select(F.col("phone").alias("p_phone"), F.col("id").alias("p_id"))
    c = contacts.select(F.col("child_id").alias("c_child"), "phone", "contact_id")
    # Phone-less contacts link to the parent they inserted; only the others
    # go through the phone join (no NULL-key hot partition).
    by_ph = (c.filter(F.col("phone").isNotNull()).join(by_phone, F.col("phone") == by_phone.p_phone, "inner")
             .select("c_child", F.col("p_id").alias("new_parent")))
    no_ph = c.filter(F.col("phone").isNull()).select("c_child", (F.lit(NEW_ID_BASE) + F.col("contact_id")).alias("new_parent"))
    link = by_ph.unionByName(no_ph)
    j = children.join(link, children.id == link.c_child, "left")
    return j.select(*[F.coalesce("parent_id", "new_parent").alias("parent_id") if c == "parent_id" else F.col(c)
                      for c in children.columns])


def update_contact(parents: DataFrame, contacts: DataFrame, children: DataFrame) -> DataFrame:
    """Re-submits for children already linked: same as upsert, except the
    phone is only set when the parent has none (first new phone wins)."""
    kids = children.filter(F.col("parent_id").isNotNull()).select(F.col("id").alias("k_id"), "parent_id")
    ch = contacts.join(kids, contacts.child_id == kids.k_id, "inner")
    per_parent = _collapse(ch, "parent_id")
    p = parents.select(*PARENT_COLS)
    j = p.join(per_parent, p.id == per_parent.parent_id, "left")
    has_new = F.col("new_name").isNotNull()
    return j.select(
        "id",
        F.when(has_new, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("phone", "new_phone").alias("phone"),
        F.coalesce("new_email", "email").alias("email"),
        (F.col("marketing_consent") | F.coalesce("new_marketing", F.lit(False))).alias("marketing_consent"),
        F.when(has_new, F.col("new_version")).otherwise(F.col("consent_text_version")).alias("consent_text_version"),
        F.when(has_new, F.col("new_consented_at")).otherwise(F.col("consented_at")).alias("consented_at"),
        "lead_status", "admin_notes", "created_at")


def phone_conflicts(updated: DataFrame) -> DataFrame:
    """Phones held by more than one parent (a UNIQUE violation the product would raise)."""
    return (updated.filter(F.col("phone").isNotNull()).groupBy("phone")
            .agg(F.count(F.lit(1)).alias("parents"), F.array_sort(F.collect_set("id")).alias("ids"))
            .filter(F.col("parents") > 1))


NOTES_MAX = 4000


def patch_leads(parents: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply admin patches in (ts, patch_id) order; returns (parents, rejects).

    Only provided fields change; a status that maps to no enum rejects the
    whole patch; notes are cut to 4000 chars.
    """
    st = status_to_enum(F.col("lead_status_text"))
    p = patches.withColumn("status_enum", st)
    bad = F.col("lead_status_text").isNotNull() & F.col("status_enum").isNull()
    rejects = p.filter(bad).select("patch_id", "parent_id", F.lit("bad_status").alias("reason"))
    ok = p.filter(~bad)
    o = F.struct("ts", "patch_id")
    last = ok.groupBy("parent_id").agg(
        F.max_by("status_enum", F.when(F.col("status_enum").isNotNull(), o)).alias("new_status"),
        F.max_by(F.substring("admin_notes", 1, NOTES_MAX), F.when(F.col("admin_notes").isNotNull(), o)).alias("new_notes"),
        F.max(F.col("admin_notes").isNotNull()).alias("has_notes"))
    j = parents.join(last, parents.id == last.parent_id, "left")
    out = j.select(*[F.coalesce("new_status", "lead_status").alias("lead_status") if c == "lead_status" else
                     (F.when(F.coalesce("has_notes", F.lit(False)), F.col("new_notes")).otherwise(F.col("admin_notes"))
                      .alias("admin_notes") if c == "admin_notes" else F.col(c)) for c in parents.columns])
    return out, rejects


def apply_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Fold a turn log into session counters: tokens add up, turn_count counts
    turns with inc_turn, done flags are OR-ed (never cleared)."""
    d = turns.groupBy("session_id").agg(
        F.sum("input_tokens").alias("d_in"), F.sum("output_tokens").alias("d_out"),
        F.count_if("inc_turn").alias("d_turns"),
        F.bool_or("m_mantiq").alias("d_m"), F.bool_or("m_psixologiya").alias("d_p"), F.bool_or("m_harakat").alias("d_h"))
    j = sessions.join(d, sessions.id == d.session_id, "left")
    z = F.lit(0)
    return j.select(
        "id",
        (F.col("turn_count") + F.coalesce("d_turns", z)).cast("long").alias("turn_count"),
        (F.col("input_tokens") + F.coalesce("d_in", z)).cast("long").alias("input_tokens"),
        (F.col("output_tokens") + F.coalesce("d_out", z)).cast("long").alias("output_tokens"),
        (F.col("done_mantiq") | F.coalesce("d_m", F.lit(False))).alias("done_mantiq"),
        (F.col("done_psixologiya") | F.coalesce("d_p", F.lit(False))).alias("done_psixologiya"),
        (F.col("done_harakat") | F.coalesce("d_h", F.lit(False))).alias("done_harakat"))


def finish_sessions(sessions: DataFrame, first_reports: DataFrame) -> DataFrame:
    """A stored report finishes its session; finished_at is set once."""
    r = first_reports.select(F.col("session_id").alias("r_sid"), F.col("created_at").alias("r_at"))
    j = sessions.join(r, sessions.id == r.r_sid, "left")
    has = F.col("r_sid").isNotNull()
    return j.select("id", F.when(has, F.lit("finished")).otherwise(F.col("status")).alias("status"),
                    F.when(has, F.coalesce("finished_at", "r_at")).otherwise(F.col("finished_at")).alias("finished_at"))


def insert_report_if_absent(existing: DataFrame, attempts: DataFrame) -> DataFrame:
    """Existing report wins; otherwise the first attempt per session is stored."""
    from leadlens.operators.reports import first_report_wins
    fresh = attempts.join(existing.select("session_id"), "session_id", "left_anti")
    new = first_report_wins(fresh).select("session_id", "share_token", "created_at", F.lit(True).alias("inserted"))
    old = existing.select("session_id", "share_token", "created_at", F.lit(False).alias("inserted"))
    return old.unionByName(new)


def report_url(base: str, token: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/hisobot/"), token)


def deep_link(bot: str, token: Column) -> Column:
    return F.concat(F.lit("https://t.me/" + bot.lstrip("@") + "?start="), F.url_encode(token))


def delivery_targets(reports: DataFrame, children: DataFrame, parents: DataFrame, base_url: str,
                     bot: str) -> DataFrame:
    """report -> child -> parent; deliverable only when the parent has a phone."""
    c = children.select(F.col("id").alias("c_id"), "parent_id", "nickname")
    p = parents.select(F.col("id").alias("p_id"), F.col("phone").alias("p_phone"))
    j = (reports.select("share_token", "session_id", "child_id")
         .join(c, F.col("child_id") == F.col("c_id"), "left")
         .join(p, F.col("parent_id") == F.col("p_id"), "left"))
    return (j.filter(F.col("p_phone").isNotNull())
            .select("share_token", "session_id", "nickname", F.col("p_id").alias("parent_id"),
                    mask_phone(F.col("p_phone")).alias("phone_masked"),
                    report_url(base_url, F.col("share_token")).alias("report_url"),
                    deep_link(bot, F.col("share_token")).alias("deep_link")))


def mark_delivered(reports: DataFrame, deliveries: DataFrame) -> DataFrame:
    """delivered = true for matched tokens; delivered_at keeps the first delivery ever."""
    first = deliveries.groupBy(F.col("token").alias("d_token")).agg(F.min("ts").alias("d_at"))
    j = reports.join(first, reports.share_token == first.d_token, "left")
    hit = F.col("d_token").isNotNull()
    return j.select("session_id", "share_token", (F.col("delivered") | hit).alias("delivered"),
                    F.coalesce("delivered_at", "d_at").alias("delivered_at"))


# Default model ids per provider.
ANTHROPIC_DEFAULT_MODEL = "claude-sonnet-4-6"
OPENROUTER_DEFAULT_MODEL = "anthropic/claude-sonnet-4.6"


def effective_model(stored: Column, provider: str) -> Column:
    """openrouter keeps namespaced ids (with '/'); anthropic keeps non-empty
    ids without '/'; anything else falls back to the provider default."""
    m = F.coalesce(stored, F.lit(""))
    if provider == "openrouter":
        return F.when(m.contains("/"), m).otherwise(F.lit(OPENROUTER_DEFAULT_MODEL))
    return F.when((m != "") & ~m.contains("/"), m).otherwise(F.lit(ANTHROPIC_DEFAULT_MODEL))


def model_audit(sessions: DataFrame, provider: str) -> DataFrame:
    """Sessions whose stored model does not fit the active provider."""
    eff = effective_model(F.col("model"), provider)
    return (sessions.select("id", "model", eff.alias("effective_model"))
            .filter(F.coalesce(F.col("model"), F.lit("")) != F.col("effective_model")))


def prompt_version(prompt_text: Column) -> Column:
    """'v1-' + first 12 hex chars of sha256 of the assembled prompt sources."""
    return F.concat(F.lit("v1-"), F.substring(F.sha2(prompt_text, 256), 1, 12))


def call_outcome(status: Column, request_error: Column, choice_error: Column, empty_text: Column) -> Column:
    """429 or >= 500 retryable; other 4xx final; 200 with an error or no text
    is a retryable failure; else ok. Timeouts/network arrive as 504."""
    return (F.when((status == 429) | (status >= 500), F.lit("retryable"))
            .when(status >= 400, F.lit("final"))
            .when(request_error | choice_error | empty_text, F.lit("retryable_failure"))
            .otherwise(F.lit("ok")))


def llm_call_outcomes(calls: DataFrame) -> DataFrame:
    o = call_outcome(F.col("status"), F.col("request_error"), F.col("choice_error"), F.col("empty_text"))
    return (calls.groupBy("model", F.to_date("ts").alias("day"), o.alias("outcome"))
            .agg(F.count(F.lit(1)).alias("calls")))
