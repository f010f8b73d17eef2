import math

import pytest

from parcelon.operators import rules as R
from parcelon.operators import versions as V
from parcelon.plans import registry

from .conftest import SF


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    other = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


RULES = [dict(rule_id=1, zone=14, prefecture="T", lat_max=28.0), dict(rule_id=2, zone=9, prefecture="T"), dict(rule_id=3, zone=2, prefecture="K", code="00001")]


def record(spark, prefecture, code="00001", lon=142.0, lat=28.0):
    return spark.createDataFrame([(prefecture, "", "", "", code, lon, lat)], "prefecture string, subprefecture string, county string, municipality string, code string, lon double, lat double")


def test_bounds_are_closed_and_the_first_rule_wins(spark):
    assert R.classify(record(spark, "T"), RULES).first()["zone"] == 14
    assert R.classify(record(spark, "T", lat=28.1), RULES).first()["zone"] == 9
    assert R.classify(record(spark, "X"), RULES).first()["zone"] is None


def test_missing_point_or_code_fails(spark):
    with pytest.raises(Exception, match="needs a point"):
        R.classify(record(spark, "T", lon=None), RULES).collect()
    with pytest.raises(Exception, match="needs a code"):
        R.classify(record(spark, "K", code=""), RULES).collect()


def test_repeated_key_fails(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        V.one_to_one(a, a, ["k"])
