import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from netquill.functions import scalar


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_missing_markers(spark):
    assert values(spark, [None, "", " - ", "nan", "None", ' a"b\nc ', "0"], scalar.clean_value) == [None, None, None, None, None, "a'b c", "0"]


def test_numbers(spark):
    assert values(spark, ["1.5", " 2 ", "inf", "-Infinity", "NaN", "x", None], scalar.safe_number) == [1.5, 2.0, None, None, None, None, None]


def test_literals(spark):
    got = values(spark, ['{"a": 1}', "{'a': True, 'b': None}", "[1, 2]", "3", "{oops", None], scalar.literal_to_json)
    assert got == ['{"a": 1}', '{"a": true, "b": null}', "[1, 2]", None, None, None]


def test_names(spark):
    cn = "www.example.com"
    assert values(spark, [cn], scalar.name_hash) == [290]
    df = spark.createDataFrame([(cn,), ("",)], "v string")
    r = df.withColumns(scalar.char_ratios(F.col("v"))).collect()
    assert r[0].cn_vowel_ratio == round(4 / 15, 4) and r[0].cn_digit_density == 0 and r[0].cn_special_char_density == round(2 / 15, 4)
    assert r[1].cn_vowel_ratio == 0.0
    e = values(spark, ["aabb", "", "aaaa"], scalar.entropy_bits)
    assert e[0] == pytest.approx(1.0) and e[1] == 0.0 and math.isclose(e[2], 0.0, abs_tol=1e-12)
    f = df.withColumns(scalar.name_features(F.col("v"))).first()
    assert (f.cn_len, f.cn_subdomain_count, f.cn_has_ip, f.cn_is_www, f.cn_has_hyphen) == (15, 2, 0, 1, 0)


def test_labels(spark):
    assert values(spark, [" Benign ", "3", "smsmalware", None], scalar.label_id) == [0, 3, 7, None]
    with pytest.raises(PySparkException):
        values(spark, ["martian"], scalar.label_id)
    assert values(spark, [0, 7, 8], scalar.label_name, "int") == ["benign", "smsmalware", None]


def test_addresses(spark):
    assert values(spark, ["1.2.3.4", "255.0.0.1", "x", None], scalar.ip_to_long) == [16909060, 4278190081, 0, 0]
    assert values(spark, [16909060], scalar.long_to_ip, "long") == ["1.2.3.4"]
    assert values(spark, [0x01020304], scalar.swap_bytes, "long") == [0x04030201]


def test_dates(spark):
    assert values(spark, ["5/7/2017 8:42:42 AM", "nonsense", None], lambda c: scalar.parse_epoch(c, scalar.DAY_FIRST, -3)) == [1499244162 + 3 * 3600, 0, 0]
    assert values(spark, ["2020-01-02 03:04:05", "2020/1/2 下午 3:04:05"], lambda c: scalar.parse_epoch(c, scalar.YEAR_FIRST, 8)) == [1577934245 - 28800, 1577934245 - 28800 + 43200]


def test_small_ones(spark):
    assert values(spark, ["[1, 2]", "x", None], scalar.parse_array) == [[1.0, 2.0], [], []]
    assert values(spark, [[1, 3, 2, 5], [], [4]], scalar.array_steps, "array<int>") == [[2, 3], [], []]
    assert values(spark, [90, 60, 30, 1], scalar.risk_level, "int") == ["critical", "high", "medium", "low"]
    assert values(spark, ["3/4 done", "none", "1/0"], scalar.progress_ratio) == [0.75, None, None]
    assert values(spark, [10.0], lambda c: scalar.days_between(c, F.lit(20.0)), "double") == [-1.0]
    assert scalar.standard_names([" Source IP", "Dst_Port", "Timestamp", "x"]) == {" Source IP": "src_ip", "Dst_Port": "dst_port", "Timestamp": "timestamp"}
