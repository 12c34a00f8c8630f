"""Adapter views: the product's tables expressed over the driver tables.

parents <- customer, children <- orders, sessions/reports <- lineitem,
messages <- conversations, contacts <- orders x customer,
funnel_events <- events. Each is a narrow projection of one scan (or one
join), so Catalyst prunes every column a job does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.exprs import normalize_phone
from leadlens.sources.tables import Tables

# Fixed clocks of the fixtures.
ENTITY_AS_OF = "2001-11-05 00:00:00"   # sessions/parents/reports clock
EVENTS_AS_OF = "2024-01-31 00:00:00"   # events end 2024-01-30 at every scale


def ts_lit(s: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{s}'")


def add_units(unit: str, n: Column, ts: Column) -> Column:
    return F.timestamp_add(unit, n.cast("int"), ts)


def _phone_raw(key: Column) -> Column:
    """Five spellings of one national number plus NULL and an invalid value.

    The national number is '9' + the key zero-padded to 8 digits: unique per key.
    """
    n = F.concat(F.lit("9"), F.lpad(key.cast("string"), 8, "0"))
    styled = F.concat(F.lit("+998 ("), F.substring(n, 1, 2), F.lit(") "), F.substring(n, 3, 3),
                      F.lit("-"), F.substring(n, 6, 2), F.lit("-"), F.substring(n, 8, 2))
    r = key % 6
    return (F.when(r == 0, F.lit(None).cast("string"))
            .when(r == 1, styled)
            .when(r == 2, n)
            .when(r == 3, F.concat(F.lit("0"), n))
            .when(r == 4, F.concat(F.lit("00998"), n))
            .otherwise(key.cast("string")))


def parents(t: Tables) -> DataFrame:
    c = t.customer
    created = add_units("DAY", -(F.col("c_custkey") % 400), ts_lit(ENTITY_AS_OF))
    seg = F.col("c_mktsegment")
    status = (F.when(seg == "AUTOMOBILE", "new").when(seg == "BUILDING", "contacted")
              .when(seg == "FURNITURE", "interested").when(seg == "HOUSEHOLD", "enrolled")
              .otherwise("closed"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        normalize_phone(_phone_raw(F.col("c_custkey"))).alias("phone"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ota"), F.col("c_custkey").cast("string"), F.lit("@example.uz"))).alias("email"),
        (F.col("c_acctbal") > 0).alias("marketing_consent"),
        F.lit("v1").alias("consent_text_version"),
        add_units("DAY", F.col("c_custkey") % 3, created).alias("consented_at"),
        status.alias("lead_status"),
        F.lit(None).cast("string").alias("admin_notes"),
        created.alias("created_at"),
    )


def children(t: Tables) -> DataFrame:
    o = t.orders
    grade = F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("parent_id"),
        F.concat(F.lit("kid"), (F.col("o_orderkey") % 100).cast("string")).alias("nickname"),
        grade.alias("grade"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("int")).otherwise(grade + 5).alias("age"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("matematika")).otherwise(F.lit(None).cast("string")).alias("goal"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("izoh "), F.col("o_orderkey").cast("string")))
         .otherwise(F.lit(None).cast("string")).alias("notes"),
        F.col("o_orderdate").alias("created_at"),
    )


def _session_id() -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _finished_at() -> Column:
    return F.when(F.col("l_linestatus") == "F",
                  add_units("MINUTE", F.col("l_quantity"), F.col("l_shipdate")))


def _done_flags() -> list[Column]:
    return [(F.col("l_discount") >= 0.01).alias("done_mantiq"),
            (F.col("l_tax") >= 0.01).alias("done_psixologiya"),
            (F.col("l_quantity") >= 5).alias("done_harakat")]


def sessions(t: Tables) -> DataFrame:
    l = t.lineitem
    flag = F.col("l_returnflag")
    model = (F.when(flag == "A", "claude-sonnet-4-6").when(flag == "N", "anthropic/claude-sonnet-4.6")
             .otherwise("claude-haiku-4-5-20251001"))
    return l.select(
        _session_id().alias("id"),
        F.col("l_orderkey").alias("child_id"),
        F.md5(F.concat(F.lit("tok-"), _session_id())).alias("session_token"),
        F.when(F.col("l_linestatus") == "F", "finished").otherwise("active").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, "v1-3f2a9c4d1e0b").otherwise("v1-8b7c6d5e4f3a").alias("prompt_version"),
        model.alias("model"),
        F.col("l_quantity").cast("int").alias("turn_count"),
        F.floor("l_extendedprice").cast("long").alias("input_tokens"),
        (F.col("l_quantity") * 100).cast("long").alias("output_tokens"),
        *_done_flags(),
        F.col("l_shipdate").alias("started_at"),
        _finished_at().alias("finished_at"),
    )


# Sports drawn per report (fixture rule).
_SPORTS = {0: [], 1: ["Futbol"], 2: ["Shaxmat"], 3: ["Futbol", "Shaxmat"], 4: ["Suzish", "Futbol"]}


def _sports(k: Column) -> Column:
    e = None
    for i, arr in _SPORTS.items():
        v = F.array(*[F.lit(x) for x in arr]) if arr else F.array().cast("array<string>")
        e = F.when(k == i, v) if e is None else e.when(k == i, v)
    return e


def reports(t: Tables, extra: tuple = ()) -> DataFrame:
    """One report per finished session, written at finish time."""
    l = t.lineitem.filter(F.col("l_linestatus") == "F")
    fin = _finished_at()
    d, tax, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity").cast("long") % 3
    lvl_logic = F.when(d < 0.03, "kuchli").when(d < 0.07, "meyorda").otherwise("shakllanmoqda")
    lvl_psych = F.when(tax < 0.03, "meyorda").when(tax < 0.06, "kuchli").otherwise("shakllanmoqda")
    lvl_act = F.when(q == 0, "kuchli").when(q == 1, "meyorda").otherwise("shakllanmoqda")
    dm, dp, dh = (F.col("l_discount") >= 0.01), (F.col("l_tax") >= 0.01), (F.col("l_quantity") >= 5)
    nul = F.lit(None).cast("string")
    return l.select(
        _session_id().alias("session_id"),
        F.col("l_orderkey").alias("child_id"),
        F.md5(_session_id()).alias("share_token"),
        F.when(dm, lvl_logic).otherwise(nul).alias("level_logic"),
        F.when(dp, lvl_psych).otherwise(nul).alias("level_psych"),
        F.when(dh, lvl_act).otherwise(nul).alias("level_activity"),
        _sports(F.col("l_partkey") % 5).alias("sports"),
        (~(dm & dp & dh)).alias("partial"),
        (F.col("l_returnflag") == "R").alias("delivered"),
        F.when(F.col("l_returnflag") == "R", add_units("HOUR", F.lit(1), fin)).alias("delivered_at"),
        fin.alias("created_at"),
        *extra,
    )


def _card_prefix(turn: Column) -> Column:
    return F.when(turn % 2 == 1, F.concat(F.lit("> Savol "), turn.cast("string"),
                                          F.lit("\n>qisqa javob\n"))).otherwise(F.lit(""))


def _marker_suffix(k: Column) -> Column:
    """Marker spellings: own line, inline lower case, CRLF + extra spaces,
    blank line then two markers, unknown track, none."""
    return (F.when(k == 0, F.lit("\n[YAKUN: MANTIQ]"))
            .when(k == 1, F.lit(" [yakun:psixologiya] davom"))
            .when(k == 2, F.lit("\r\n[YAKUN:  HARAKAT ]\r\n"))
            .when(k == 3, F.lit("\n\n[YAKUN: MANTIQ]\n[YAKUN: HARAKAT]"))
            .when(k == 4, F.lit("\n[YAKUN: SPORT]"))
            .otherwise(F.lit("")))


def messages(t: Tables) -> DataFrame:
    c = t.conversations
    turn, conv = F.col("turn"), F.col("conv_id")
    assistant = F.col("role") == "assistant"
    content = F.when(assistant, F.concat(_card_prefix(turn), F.col("text"), _marker_suffix((conv + turn) % 6))) \
        .otherwise(F.col("text"))
    created = add_units("MINUTE", F.floor(turn / 2), add_units("HOUR", conv, ts_lit("2024-01-01 00:00:00")))
    return c.select(
        (conv * 1000 + turn).alias("id"),
        conv.alias("session_id"),
        turn.alias("ord"),
        F.col("role"),
        content.alias("content"),
        (F.col("role") == "system").alias("meta"),
        created.alias("created_at"),
    )


def session_messages(t: Tables) -> DataFrame:
    """Messages with the id of the session they belong to: conversation n is the first session (least id) of child n.

    Conversations without such a child keep their own number."""
    first = sessions(t).groupBy(F.col("child_id").alias("_child")).agg(F.min("id").alias("_session"))
    m = messages(t)
    own = F.coalesce("_session", m.session_id.cast("string"))
    return m.join(first, m.session_id == F.col("_child"), "left").withColumn("session_id", own).drop(
        "_child", "_session")


def contacts(t: Tables) -> DataFrame:
    """Contact-gate submissions: one per order, several per phone."""
    o, c = t.orders, t.customer
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    return j.select(
        k.alias("contact_id"),
        k.alias("child_id"),
        _phone_raw(F.col("c_custkey")).alias("phone_raw"),
        F.concat(F.col("c_name"), F.lit("-"), (k % 3).cast("string")).alias("parent_name"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("p"), (k % 3).cast("string"), F.lit("@example.uz"))).alias("email"),
        (F.col("o_orderpriority") == "1-URGENT").alias("marketing"),
        F.when(F.col("o_orderdate") < ts_lit("1997-01-01 00:00:00"), "v1").otherwise("v2").alias("consent_version"),
        F.col("o_orderdate").alias("ts"),
    )


def funnel_events(t: Tables) -> DataFrame:
    e = t.events
    et = F.col("event_type")
    metric = (F.when(et == "signup", "started").when(et == "view", "finished")
              .when(et == "click", "contact").when(et == "purchase", "delivered"))
    return e.filter(et.isin("signup", "view", "click", "purchase")) \
        .select(metric.alias("metric"), F.col("ts"))


# Display forms the model writes for each level (normalized back by parse_report).
_LEVEL_TEXT = {"kuchli": "KUCHLI daraja", "meyorda": "Me'yorda", "shakllanmoqda": "Shakllanmoqda"}


def _level_json(c: Column) -> Column:
    e = F.lit("null")
    for k, v in _LEVEL_TEXT.items():
        e = F.when(c == k, F.lit('"' + v + '"')).otherwise(e)
    return e


def report_replies(t: Tables) -> DataFrame:
    """Raw model replies for each finished session's report.

    Rendered from the report columns: headed sections with bullets and a
    numbered list, a marker on its own line and one inline, then a fence
    variant chosen by l_suppkey % 7: one fence; two (last wins); last invalid;
    none; upper-case JSON tag; levels not an object; sports not an array.
    """
    j = reports(t, extra=((F.col("l_suppkey") % 7).alias("variant"),))
    sports_json = F.concat(F.lit("["), F.array_join(F.transform("sports", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", "), F.lit("]"))
    levels_json = F.concat(F.lit('{"mantiq": '), _level_json(F.col("level_logic")),
                           F.lit(', "psixologiya": '), _level_json(F.col("level_psych")),
                           F.lit(', "harakat": '), _level_json(F.col("level_activity")), F.lit("}"))
    good = F.concat(F.lit('{"levels": '), levels_json, F.lit(', "sports": '), sports_json, F.lit("}"))
    fence = lambda body, tag="json": F.concat(F.lit("```" + tag + "\n"), body, F.lit("\n```"))
    first = F.lit('```json\n{"levels": {"mantiq": "kuchli"}, "sports": ["X"]}\n```\n\n')
    v = F.col("variant")
    tail = (F.when(v == 0, fence(good))
            .when(v == 1, F.concat(first, fence(good)))
            .when(v == 2, F.concat(fence(good), F.lit("\n\n"), fence(F.lit('{"levels": {"mantiq": "kuchli"},}'))))
            .when(v == 3, F.lit(""))
            .when(v == 4, fence(good, "JSON"))
            .when(v == 5, fence(F.concat(F.lit('{"levels": "kuchli", "sports": '), sports_json, F.lit("}"))))
            .otherwise(fence(F.concat(F.lit('{"levels": '), levels_json, F.lit(', "sports": "Futbol"}')))))
    body = F.concat(
        F.lit("[YAKUN: MANTIQ]\n## Xulosa\nMashg'ulot "), F.col("session_id"), F.lit(" yakunlandi.\n\n"),
        F.lit("## Kuchli tomonlar\n- **Mantiq** — "), F.coalesce("level_logic", F.lit("-")),
        F.lit("\n- **Psixologiya** — "), F.coalesce("level_psych", F.lit("-")),
        F.lit("\n\n## Tavsiyalar\n1. Kitob o'qish\n2. Sport: "), F.array_join("sports", ", "),
        F.lit("\nRahmat! [YAKUN: HARAKAT]\n"), tail)
    return j.select("session_id", "child_id", "created_at", "partial", body.alias("raw_text"))


def report_attempts(t: Tables) -> DataFrame:
    """Report inserts as they arrive: every finished session once, and a
    concurrent second attempt for return flag 'A' (earlier for odd line
    numbers, same instant for even ones)."""
    l = t.lineitem.filter(F.col("l_linestatus") == "F")
    fin = _finished_at()
    base = l.select(_session_id().alias("session_id"), F.md5(_session_id()).alias("share_token"),
                    fin.alias("created_at"))
    retry = l.filter(F.col("l_returnflag") == "A").select(
        _session_id().alias("session_id"), F.md5(F.concat(F.lit("retry-"), _session_id())).alias("share_token"),
        F.when(F.col("l_linenumber") % 2 == 1, add_units("SECOND", F.lit(-1), fin)).otherwise(fin).alias("created_at"))
    return base.unionByName(retry)


def lead_patches(t: Tables) -> DataFrame:
    """Admin patches: one per urgent order, for its customer. Status text by
    order status: a label, a padded mixed-case enum, an unknown word; notes
    for some, long enough to be cut for others."""
    o = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    text = F.when(st == "F", F.lit("Yozildi")).when(st == "O", F.lit(" CONTACTED ")).otherwise(F.lit("noma'lum"))
    notes = (F.when(k % 3 == 0, F.lit(None).cast("string"))
             .when(k % 3 == 1, F.concat(F.lit("qo'ng'iroq "), k.cast("string")))
             .otherwise(F.repeat(F.lit("x"), (k % 5000).cast("int"))))
    return o.select(k.alias("patch_id"), F.col("o_custkey").alias("parent_id"),
                    F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(text).alias("lead_status_text"),
                    notes.alias("admin_notes"), F.col("o_orderdate").alias("ts"))


def turn_log(t: Tables) -> DataFrame:
    """LLM calls not yet folded into the session counters: a conversation turn
    for open sessions, a report call (no turn) for finished ones."""
    l = t.lineitem
    fin = F.col("l_linestatus") == "F"
    return l.select(_session_id().alias("session_id"),
                    F.lit(100).cast("long").alias("input_tokens"), F.lit(200).cast("long").alias("output_tokens"),
                    (~fin).alias("inc_turn"),
                    (~fin & (F.col("l_suppkey") % 3 == 0)).alias("m_mantiq"),
                    (~fin & (F.col("l_suppkey") % 3 == 1)).alias("m_psixologiya"),
                    (~fin & (F.col("l_suppkey") % 3 == 2)).alias("m_harakat"))


def delivery_updates(t: Tables) -> DataFrame:
    """Bot webhook updates as JSON text: '/start <token>' for reports not yet
    delivered (some twice), a greeting without a token, and unknown tokens."""
    l = t.lineitem.filter(F.col("l_linestatus") == "F")
    fin = _finished_at()
    sid = _session_id()
    k = F.col("l_suppkey") % 4
    text = (F.when(k == 0, F.concat(F.lit("/start "), F.md5(sid)))
            .when(k == 1, F.concat(F.lit("  /start   "), F.md5(sid), F.lit(" ")))
            .when(k == 2, F.lit("salom"))
            .otherwise(F.concat(F.lit("/start "), F.md5(F.concat(F.lit("gone-"), sid)))))
    at = add_units("HOUR", F.lit(2), fin)

    def upd(when: Column) -> Column:
        # The text holds no quote or backslash, so plain formatting is valid JSON.
        return F.format_string('{"update_id": %d, "message": {"chat": {"id": %d}, "text": "%s", "date": %d}}',
                               F.col("l_orderkey"), F.col("l_partkey"), text, F.unix_timestamp(when.cast("timestamp")))

    first = l.filter(F.col("l_returnflag") != "R").select(upd(at).alias("update_json"))
    again = l.filter((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)).select(
        upd(add_units("DAY", F.lit(1), at)).alias("update_json"))
    return first.unionByName(again)


def call_log(t: Tables) -> DataFrame:
    """Model calls with their HTTP outcome (one per session)."""
    l = t.lineitem
    k = F.col("l_suppkey") % 10
    status = (F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 402).when(k == 3, 504).when(k == 4, 400)
              .otherwise(200))
    flag = F.col("l_returnflag")
    model = (F.when(flag == "A", "claude-sonnet-4-6").when(flag == "N", "anthropic/claude-sonnet-4.6")
             .otherwise("claude-haiku-4-5-20251001"))
    return l.select(model.alias("model"), F.col("l_shipdate").alias("ts"), status.cast("int").alias("status"),
                    (k == 5).alias("request_error"), (k == 6).alias("choice_error"), (k == 7).alias("empty_text"))


def session_requests(t: Tables) -> DataFrame:
    """New-session form posts: one per order, with every rejection branch."""
    o = t.orders
    k = F.col("o_orderkey")
    r = k % 11
    nick = (F.when(r == 1, F.lit("   ")).when(r == 2, F.repeat(F.lit("a"), 61))
            .otherwise(F.concat(F.lit(" kid"), (k % 100).cast("string"), F.lit(" "))))
    grade = (F.when(r == 3, F.lit("5")).when(r == 4, F.lit("x")).when(r == 5, F.lit("3abc"))
             .otherwise(F.substring("o_orderpriority", 1, 1)))
    age = (F.when(r == 6, F.lit("2")).when(r == 7, F.lit("")).when(r == 8, F.lit(None).cast("string"))
           .otherwise((k % 10 + 5).cast("string")))
    return o.select(k.alias("request_id"), (F.col("o_orderstatus") != "P").alias("consent"),
                    nick.alias("nickname"), grade.alias("grade"), age.alias("age"),
                    F.when(r == 9, F.repeat(F.lit("g"), 310)).otherwise(F.lit(" matematika ")).alias("goal"),
                    F.when(r == 10, F.lit("  ")).otherwise(F.concat(F.lit("izoh "), k.cast("string"))).alias("notes"))


def erasure_requests(t: Tables) -> DataFrame:
    """Erasure requests: customers with a negative balance, plus ids that
    match no parent (rejected as not found)."""
    c = t.customer.filter(F.col("c_acctbal") < 0)
    known = c.select(F.col("c_custkey").alias("parent_id"))
    unknown = c.filter(F.col("c_acctbal") < -900).select((F.col("c_custkey") + F.lit(10 ** 9)).alias("parent_id"))
    return known.unionByName(unknown)


def answers(t: Tables) -> DataFrame:
    """Answer log from events: click = logic task, view = psychology item,
    purchase = movement item; props.k picks the kind and the RIASEC letter;
    a logic answer is correct when value >= 20."""
    e = t.events
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    track = F.when(et == "click", "mantiq").when(et == "view", "psixologiya").when(et == "purchase", "harakat")
    logic_kind = F.element_at(F.array(*[F.lit(x) for x in ("pattern", "count", "compare", "language")]), (k % 4) + 1)
    psych_kind = F.element_at(F.array(*[F.lit(x) for x in ("riasec", "growth", "self_control", "feelings")]), (k % 4) + 1)
    move_kind = F.when(k % 2 == 0, "preference").otherwise("mini_task")
    kind = F.when(et == "click", logic_kind).when(et == "view", psych_kind).otherwise(move_kind)
    letter = F.when((et == "view") & (k % 4 == 0), F.substring(F.lit("RIASEC"), (k % 6) + 1, 1))
    return e.filter(et.isin("click", "view", "purchase")).select(
        F.col("user_id").alias("session_id"), track.alias("track"), kind.alias("kind"), letter.alias("riasec_letter"),
        F.when(et == "click", F.col("value") >= 20).alias("correct"), "ts")
