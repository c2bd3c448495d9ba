import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing as P
from tidemark.functions import rendering as R
from tidemark.functions.sets import changed, jaccard, safe_ratio


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "name"), [("酒黄精10g1.000", "酒黄精"), ("白芍. ", "白芍"), ("北柴胡10g.", "北柴胡10g"), ("　丹参 1.000", "丹参"), ("1.5克", ""), ("1" * 5000 + "x", "1" * 5000 + "x")])
def test_item_names(spark, raw, name):
    assert one(spark, raw, P.normalize_item) == name


def test_item_names_with_options(spark):
    assert one(spark, "北柴胡10g.", lambda c: P.normalize_item(c, strict=False)) == "北柴胡"
    assert one(spark, "a1.000", lambda c: P.normalize_item(c, known={"a": "b"})) == "b"
    assert one(spark, "北柴胡10g", P.name_violation) is True


def test_lists(spark):
    assert one(spark, "陈皮1.000,丹参1.000,,陈皮 2g", P.parse_items) == ["陈皮", "丹参"]
    assert one(spark, None, P.parse_items) == [] and one(spark, None, P.parse_labels) == []
    assert one(spark, " 头痛，失眠;; 头痛；", P.parse_codes) == ["头痛", "失眠"]
    got = one(spark, "腰痛/肾气不充证/补肾扶元,精浊/肾气不充证/补肾扶元,腰痛/肾气不充证/补肾扶元", P.parse_labels)
    assert [tuple(x) for x in got] == [("腰痛", "肾气不充证", "补肾扶元"), ("精浊", "肾气不充证", "补肾扶元")]
    assert [one(spark, x, P.parse_labels) for x in ("a/b", "a//c", "a/b/c/d", "a/b/c/")] == [[]] * 4


def test_scalars(spark):
    assert (one(spark, "89岁", P.parse_age), one(spark, None, P.parse_age), one(spark, "x", P.parse_age)) == (89, None, None)
    days = [one(spark, x, P.parse_date) for x in ("2025-6-30", "2025/07/01", "2025-13-01", "x", None)]
    assert days == [datetime.date(2025, 6, 30), datetime.date(2025, 7, 1), None, None, None]
    assert one(spark, "偶有腰痛，不痛；否认外伤", P.clauses) == ["腰痛", "无痛", "无认外伤"]
    assert one(spark, "清热利湿", lambda c: P.segment(c, ["利湿", "清", "清热"])) == ["清热", "利湿"]
    assert [tuple(x) for x in one(spark, "北柴胡10g, 茯苓 12, 甘草", P.parse_dosed)] == [("北柴胡", 10.0), ("茯苓", 12.0), ("甘草", None)]
    assert one(spark, "a<think>x\ny</think>b", P.strip_think) == "ab"
    assert (one(spark, "", P.estimate_tokens), one(spark, "abcde", P.estimate_tokens)) == (1, 4)
    assert one(spark, "abc", P.bigrams) == ["ab", "bc"] and one(spark, "a", P.bigrams) == []


def test_sets(spark):
    def j(a, b):
        return spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(jaccard(F.col("a"), F.col("b")).alias("y")).first().y

    assert j([], []) == 0 and j(["a", "b"], ["b", "c"]) == 1 / 3 and j(["a", "a"], ["a"]) == 1
    assert one(spark, 0.0, lambda c: safe_ratio(F.lit(1), c), "double") == 0
    c = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(changed(F.col("a"), F.col("b")).alias("y")).first().y
    assert (c.kept, c.added, c.removed) == (["b"], ["a"], ["c"])


def test_headed_text(spark):
    schema = "labels array<struct<disease:string,pattern:string,goal:string>>, items array<string>"
    rows = [([("腰痛", "肾虚", "补肾"), ("x", "y", "")], ["丹参", "黄芪"]), ([], [])]
    v = spark.createDataFrame(rows, schema)
    labels, items = P.parse_headed(R.target(F.col("labels"), F.col("items")))
    got = v.select(labels.alias("l"), items.alias("i")).collect()
    assert [([tuple(x) for x in r.l], r.i) for r in got] == rows
    for text, want in (("a·b·c", ([("a", "b", "c")], [])), ("a/b\n【中药处方】\n丹参，黄芪10g 丹参", ([("a", "b", "")], ["丹参", "黄芪"])), ("【中医诊断】\na|b|c|d", ([], [])), (None, ([], []))):
        r = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for c, n in zip(P.parse_headed(F.col("t")), "li")]).first()
        assert ([tuple(x) for x in r.l], r.i) == want
