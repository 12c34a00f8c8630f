from pyspark.sql import functions as F

from leadlens.functions import exprs as X
from tests.conftest import rows


def one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in rows(df.orderBy("i").select(fn(F.col("v"))))]


def test_normalize_phone(spark):
    vals = ["+998 (90) 123-45-67", "00998901234567", "901234567", "0901234567", "00901234567",
            "0012345678", "123", "998901", "+7 901 234 56 78", "", None, "998998123456", "998123456"]
    got = one(spark, vals, X.normalize_phone)
    assert got == ["+998901234567"] * 5 + [None] * 6 + ["+998998123456", "+998998123456"]


def test_format_and_mask_phone(spark):
    assert one(spark, ["+998901234567", "+99890", None], X.format_phone) == ["+998 90 123-45-67", "+99890", ""]
    assert one(spark, ["+998901234567", "", None, "1234"], X.mask_phone) == \
        ["+********4567", "no-phone", "no-phone", "1234"]
    assert one(spark, ["+998901234567", None], X.display_phone) == ["+998 90 123-45-67", None]


def test_norm_level(spark):
    vals = ["Kuchli", "KUCHLI daraja", "Shakllanmoqda", "Me'yorda", "Me‘yorda", "meyorda", "kuchli va shakl", "x", None]
    assert one(spark, vals, X.norm_level) == ["kuchli", "kuchli", "shakllanmoqda", "meyorda", "meyorda", "meyorda",
                                              "kuchli", None, None]


def test_markers(spark):
    vals = ["a\n[YAKUN: MANTIQ]", "x [yakun:mantiq] y", "[YAKUN:  MANTIQ ]\r\n", "[YAKUN: SPORT]", None]
    assert one(spark, vals, lambda c: X.has_marker(c, "MANTIQ")) == [True, True, True, False, False]


def test_status_enum_and_label(spark):
    vals = ["new", "Yozildi", " CONTACTED ", "qiziqish bildirdi", "all", "", None, "x"]
    assert one(spark, vals, X.status_to_enum) == ["new", "enrolled", "contacted", "interested", None, None, None, None]
    assert one(spark, ["new", "closed", "weird"], X.status_to_label) == ["Yangi", "Yopildi", "weird"]


def test_js_trim_and_round(spark):
    assert one(spark, ["  a b　﻿\n", "  ", None], X.js_trim) == ["a b", "", None]
    assert one(spark, [1.005, 2.675, 0.125, -1.5], lambda c: X.round_half_up(c), "double") == [1.0, 2.68, 0.13, -1.5]


def test_parse_int_prefix(spark):
    assert one(spark, ["3abc", " 2", "x", "", None, "-4", "+7"], X.parse_int_prefix) == [3, 2, None, None, None, -4, 7]
