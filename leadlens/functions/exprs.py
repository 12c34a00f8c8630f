"""Scalar column expressions used across jobs.

All of them are compositions of Spark built-ins, so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the product's, stated once.
# ---------------------------------------------------------------------------
# Lead status enum in display order, with its Uzbek labels.
LEAD_STATUS_ORDER = ["new", "contacted", "interested", "enrolled", "closed"]
LEAD_STATUS_LABELS = {
    "new": "Yangi",
    "contacted": "Bog'lanildi",
    "interested": "Qiziqish bildirdi",
    "enrolled": "Yozildi",
    "closed": "Yopildi",
}
# Completion-marker tracks.
TRACKS = ["MANTIQ", "PSIXOLOGIYA", "HARAKAT"]
# Report levels.
LEVELS = ["shakllanmoqda", "meyorda", "kuchli"]
# Token prices, USD per 1M tokens (input, output).
PRICE_IN_PER_MTOK = 3.0
PRICE_OUT_PER_MTOK = 15.0
# Caps, and the reply stored instead of an LLM turn once the cap is reached.
CAP_REPLY = "Savollar chegarasiga yetdik. Iltimos, mashg‘ulotni yakunlab, hisobotni oling."
MAX_TURNS = 60
MAX_MESSAGE_CHARS = 2000
MIN_ANSWERS_FOR_REPORT = 1
WEEK_MICROS = 604800 * 1_000_000


# Characters JS String.trim removes: WhiteSpace (TAB, VT, FF, SP, NBSP, ZWNBSP
# and the other Zs spaces) and LineTerminators (LF, CR, LS, PS).
JS_WHITESPACE = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                 "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


# JS \s as a Java character class (Java's own \s is ASCII only).
JS_SPACE = ("[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
            "\\x{3000}\\x{FEFF}]*")


def marker_pattern(*tracks: str) -> str:
    """A completion marker of one of the tracks, in any case. The literal '[' in front lets the regex engine skip ahead."""
    return "\\[(?i:YAKUN):" + JS_SPACE + "(?i:" + "|".join(tracks) + ")" + JS_SPACE + "\\]"


def js_trim(c: Column) -> Column:
    """Trim like JS String.trim (Spark's one-argument ``trim`` strips only ' ').

    ``trim(str, chars)`` strips a character set: no regex on the hot path.
    """
    return F.trim(c, F.lit(JS_WHITESPACE))


def iso_utc(c: Column) -> Column:
    """A UTC timestamp as JSON writes a date: 2024-01-31T08:00:00.000Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def round_half_up(c: Column, digits: int = 2) -> Column:
    """JS Math.round(x * 10^d) / 10^d on doubles (Spark ``round`` rounds 1.005 up)."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def parse_int_prefix(c: Column) -> Column:
    """parseInt(v, 10): optional sign and leading digits after leading spaces; else NULL."""
    digits = F.regexp_extract(c.cast("string"), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits == "", F.lit(None).cast("long")).otherwise(digits.try_cast("long"))


# ---------------------------------------------------------------------------
# Phone numbers
# ---------------------------------------------------------------------------
_NATIONAL = r"^(?:998|0)?([0-9]{9})$"


def normalize_phone(c: Column) -> Column:
    """Raw phone text -> +998XXXXXXXXX or NULL.

    Keep digits; drop one leading 00; then accept 998 + 9 digits, 9 digits,
    or 0 + 9 digits — anything else (including empty) is NULL. Two regex
    passes, so the expression stays small when it is composed further.
    """
    d = F.regexp_replace(F.regexp_replace(c.cast("string"), "[^0-9]", ""), "^00", "")
    return F.when(d.rlike(_NATIONAL), F.regexp_replace(d, _NATIONAL, "+998$1"))


_E164_UZ = r"^\+998([0-9]{2})([0-9]{3})([0-9]{2})([0-9]{2})\z"


def format_phone(c: Column) -> Column:
    """+998901234567 -> '+998 90 123-45-67'; other text unchanged; NULL -> ''."""
    return F.when(c.rlike(_E164_UZ), F.regexp_replace(c, _E164_UZ, "+998 $1 $2-$3-$4")) \
        .otherwise(F.coalesce(c, F.lit("")))


def display_phone(c: Column) -> Column:
    """Lead rows: formatted phone, NULL stays NULL (and '' stays NULL)."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string")).otherwise(format_phone(c))


def mask_phone(c: Column) -> Column:
    """Log-safe phone: digits before the last four become '*'; none -> 'no-phone'.

    Like JS slice(0,-4) / slice(-4): a value of 4 chars or fewer is kept whole.
    """
    n = F.length(c)
    head = F.when(n > 4, F.substring(c, 1, n - 4)).otherwise(F.lit(""))
    tail = F.when(n > 4, F.substring(c, -4, 4)).otherwise(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("no-phone")) \
        .otherwise(F.concat(F.regexp_replace(head, "[0-9]", "*"), tail))


# ---------------------------------------------------------------------------
# Lead status
# ---------------------------------------------------------------------------
def _label_map() -> Column:
    return F.create_map(*[x for k in LEAD_STATUS_ORDER for x in (F.lit(k), F.lit(LEAD_STATUS_LABELS[k]))])


def _reverse_map() -> Column:
    return F.create_map(*[x for k in LEAD_STATUS_ORDER
                          for x in (F.lit(LEAD_STATUS_LABELS[k].lower()), F.lit(k))])


def status_to_label(c: Column) -> Column:
    """Enum -> label; unknown passes through."""
    return F.coalesce(F.element_at(_label_map(), c), c)


def status_to_enum(c: Column) -> Column:
    """Enum or label text (any case, padded) -> enum; else NULL."""
    low = F.lower(js_trim(c.cast("string")))
    known = F.array(*[F.lit(k) for k in LEAD_STATUS_ORDER])
    return (F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(None).cast("string"))
            .when(F.array_contains(known, low), low)
            .otherwise(F.try_element_at(_reverse_map(), low)))


def status_order(c: Column) -> Column:
    """Display position of an enum value (0-based); NULL when unknown."""
    return F.array_position(F.array(*[F.lit(k) for k in LEAD_STATUS_ORDER]), c).cast("int") - 1


# ---------------------------------------------------------------------------
# Markers and levels
# ---------------------------------------------------------------------------
def has_marker(c: Column, track: str) -> Column:
    """True when the text reports ``track`` complete anywhere (any case, repeated ok)."""
    return F.coalesce(c.rlike(marker_pattern(track)), F.lit(False))


def any_marker(c: Column) -> Column:
    return F.coalesce(c.rlike(marker_pattern(*TRACKS)), F.lit(False))


def marker_like(c: Column) -> Column:
    """True when anything that begins like a marker is left, whatever its track."""
    return F.coalesce(c.rlike(r"\[(?i:YAKUN):"), F.lit(False))


def norm_level(c: Column) -> Column:
    """Free text -> kuchli / shakllanmoqda / meyorda (first hit in that order) or NULL."""
    s = F.lower(c.cast("string"))
    return (F.when(s.contains("kuchli"), F.lit("kuchli"))
            .when(s.contains("shakl"), F.lit("shakllanmoqda"))
            .when(s.contains("yor"), F.lit("meyorda"))
            .otherwise(F.lit(None).cast("string")))


def grade_band(grade: Column) -> Column:
    return F.when(grade <= 2, F.lit("A")).otherwise(F.lit("B"))


def micros(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))
