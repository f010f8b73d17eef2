import hashlib

import pytest
from pyspark.sql import functions as F

from parcelon.functions import scalars as S
from parcelon.functions import wkb


def values(spark, kind, given, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers_and_angles(spark):
    assert values(spark, "string", [" 1.5 ", "  ", None], S.blank_to_null) == [1.5, None, None]
    assert values(spark, "string", ["129°30′00″", "-36°0'0.36\"", None], S.dms_to_degrees) == [129.5, -36.0001, None]
    with pytest.raises(Exception, match="no angle"):
        values(spark, "string", ["129.5"], S.dms_to_degrees)


def test_lists_and_codes(spark):
    assert values(spark, "string", ["14; 9;10", "", None], S.split_ints) == [[9, 10, 14], [], None]
    assert values(spark, "array<int>", [[10, 9, 10], []], S.join_sorted) == ["9;10", ""]
    assert values(spark, "string", ["01234", "1234", "01234\n", "０１２３４", None], S.is_code) == [True, False, False, False, False]


def test_ids_and_widths(spark):
    assert values(spark, "string", ["a"], lambda c: S.short_id("gap-", c)) == ["gap-" + hashlib.sha256(b"a").hexdigest()[:16]]
    assert values(spark, "string", ["é", None], lambda c: S.fits_bytes(c, 2)) == ["é", None]
    with pytest.raises(Exception, match="over 2 bytes"):
        values(spark, "string", ["éa"], lambda c: S.fits_bytes(c, 2))


def test_grid(spark):
    assert values(spark, "double", [139.123456789, 139.1234567891, 0.0], S.on_grid) == [True, False, True]


def test_flags(spark):
    blob = wkb.pack(6668, b"")
    rows = values(spark, "binary", [blob, blob[:3] + bytes([0b10010]) + blob[4:]], S.geometry_flags)
    assert list(map(tuple, rows)) == [(True, 0, False), (False, 1, True)]
