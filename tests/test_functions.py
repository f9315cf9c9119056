from pyspark.sql import functions as F

from featflow.functions import features as X
from featflow.functions import parse as P


def test_parse_count_examples(spark):
    # FIXTURES §3.3: 6회 이상, 3회, ' 0회 ', abc, NULL, 12 -> 6, 3, 0, 0, 0, 12
    df = spark.createDataFrame([("6회 이상",), ("3회",), (" 0회 ",), ("abc",), (None,), ("12",)], "s string")
    got = [r[0] for r in df.select(P.parse_count("s")).collect()]
    assert got == [6, 3, 0, 0, 0, 12]
    f = [r[0] for r in df.select(P.parse_count("s", as_float=True)).collect()]
    assert f == [6.0, 3.0, 0.0, 0.0, 0.0, 12.0]


def test_band_ordinal_three_valued(spark):
    df = spark.createDataFrame([(" b1 ",), ("unknown",), ("zz",), (None,)], "s string")
    got = [r[0] for r in df.select(P.band_ordinal("s", {"b1": 5, "unknown": None})).collect()]
    assert got == [5.0, None, 0.0, 0.0]


def test_map_lookup_and_indicator(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [r[0] for r in df.select(P.map_lookup("s", {"a": 1})).collect()] == [1.0, None, None]
    assert [r[0] for r in df.select(P.map_lookup("s", {"a": 1}, default=0)).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(P.missing_indicator("s", "b")).collect()] == [0.0, 1.0, 0.0]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(P.coerce_numeric("s")).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(25.0,), (25.5,), (40.0,), (41.0,), (None,)], "x double")
    got = [r[0] for r in df.select(X.cut("x", [25, 30, 35, 40], list("abcde"))).collect()]
    assert got == ["a", "b", "d", "e", None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (5.0,), (50.0,), (None,)], "x double")
    assert [r[0] for r in df.select(X.clip("x", 0.0, 10.0)).collect()] == [0.0, 5.0, 10.0, None]


def test_risk_index_two_steps(spark):
    df = spark.createDataFrame([(30.0,), (38.0,), (45.0,)], "x double")
    got = [round(r[0], 9) for r in df.select(X.risk_index("x")).collect()]
    # 38 -> 35 + 3*1.5 = 39.5 ; 45 -> 35 + 15 = 50 -> 40 + 10*2 = 60
    assert got == [round(30 / 30, 9), round(39.5 / 30, 9), round(60 / 30, 9)]


def test_positional_pairs_count():
    cols = [f"c{i}" for i in range(12)]
    assert len(X.positional_pairs(cols)) == 55
    assert len(X.positional_pairs(cols[:4])) == 6


def test_leaky_columns():
    cols = ["Target_x", "prior_score", "age", "난자 해동 경과일", "해동 후 경과", "임신 횟수", "safe"]
    assert X.leaky_columns(cols) == ["Target_x", "prior_score", "난자 해동 경과일", "해동 후 경과", "임신 횟수"]
