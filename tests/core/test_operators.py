import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bayes, checks, history, knowledge, metrics, priors, resample, rules, splits
from tidemark.sources import files

VISITS = "rid long, pid string, date date, items array<string>, has_items boolean"


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(n)


def test_history_skips_visits_without_items(spark):
    rows = [(1, "p", day(1), ["a"], True), (2, "p", day(2), [], False), (3, "p", day(3), ["b"], True), (4, "p", day(4), [], False), (5, "q", day(1), ["z"], True)]
    got = {r.rid: r for r in history.link_history(spark.createDataFrame(rows, VISITS)).collect()}
    assert [got[i].prev_items for i in (1, 2, 3, 4, 5)] == [None, ["a"], ["a"], ["b"], None]
    assert [got[i].visit_ix_items for i in (1, 2, 3, 4)] == [0, None, 1, None] and got[1].n_items_visits == 2
    assert [got[i].prev_gap for i in (2, 3, 4)] == [1, 2, 1]


def test_history_never_looks_ahead(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        items = [str(i)] if rng.random() < 0.7 else []
        rows.append((i, f"p{rng.randrange(12)}", day(rng.randrange(20)), items, bool(items)))
    order = {r[0]: (r[2], r[0]) for r in rows}
    for r in history.link_history(spark.createDataFrame(rows, VISITS)).collect():
        if r.prev_items:
            assert order[int(r.prev_items[0])] < order[r.rid]


def test_padding_gives_exactly_k(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (None,), ([],)], "t array<string>")
    assert [r.y for r in df.select(priors.padded(F.col("t"), ["z", "a", "q", "w"], 4).alias("y")).collect()] == [["a", "b", "c", "z"], ["z", "a", "q", "w"], ["z", "a", "q", "w"]]
    rows = spark.createDataFrame([("k", ["b", "a"]), ("k", ["b", "a", "c"])], "key string, items array<string>")
    assert priors.keyed_top(rows, F.col("key"), 2).first().top == ["a", "b"]


def test_index_median_is_the_upper_one(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert checks.pick_by_index(df, [], "v", {"m": F.expr("c div 2")}).first().m == 3
    assert checks.pick_by_index(df.where("false"), [], "v", {"m": F.expr("c div 2")}).collect()[0].m is None


def test_auc(spark):
    df = spark.createDataFrame([("g", 0.1, 0), ("g", 0.1, 1), ("g", 0.5, 0), ("g", 0.9, 1), ("h", 0.4, 1)], "k string, score double, y int")
    assert {r.k: r.auc for r in bayes.auc(df, ["k"]).collect()} == {"g": 0.625, "h": None}


def test_splits_don_t_share_entities(spark):
    rows = spark.createDataFrame([(i, f"p{i % 97}", day(i % 300)) for i in range(1000)], "rid long, pid string, date date")
    parts = {r.pid: r.split for r in splits.entity_split(rows).collect()}
    assert sorted(map(list(parts.values()).count, ("train", "val", "test"))) == [9, 11, 77]
    ranks = [r._rank for r in splits.hash_rank(rows, "rid").collect()]
    assert sorted(ranks) == list(range(1, 1001))
    timed = splits.by_time(rows, "2020-08-01").groupBy("pid").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert timed.count() == 0
    assert {r.fold for r in splits.folds(rows, "rid", 5).collect()} == set(range(5))


def test_metrics_of_hand_made_rows(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], ["a"])], "pred array<string>, items array<string>")
    m = {r.metric: r.value for r in metrics.item_metrics(rows, ["b"], ["a", "c"]).collect()}
    assert m["jaccard"] == pytest.approx(4 / 9, abs=1e-6) and m["jaccard_median"] == pytest.approx(1 / 3, abs=1e-6) and m["exact"] == pytest.approx(1 / 3, abs=1e-6)
    assert (m["precision"], m["recall"], m["empty_rate"], m["unknown_rate"], m["repeat_rate"], m["key_recall"]) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), 0.25, 1.0)
    gates = metrics.gate_status(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "metric string, value double"), [("a", 0.4, 0.6, ">="), ("b", 0.4, 0.6, "<=")])
    assert {r.metric: r.status for r in gates.collect()} == {"a": "must", "b": "target"}


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "rid long, v double")
    r = resample.bootstrap_ci(rows, "rid", "v", 80).first()
    assert r.n == 200 and r.low < 4.5 < r.high and r.high - r.low < 2
    p = resample.paired_bootstrap(rows.withColumn("w", F.col("v") + 1), "rid", "w", "v", 20).first()
    assert (p["mean"], p.p) == (1.0, 0.0)


RULES = rules.Rules(vocabulary=["丁香", "郁金", "a", "b"], pairs=[("郁金", "丁香"), ("a", "b")], downgraded={tuple(sorted(("丁香", "郁金"))): "warn"}, forbidden=["a"], caution=["b"], caps={"a": 3.0}, toxic=["b"], opposing={"g": "hot"})


def test_rules(spark):
    item = "array<struct<item:string,dose:double>>"
    rows = spark.createDataFrame([(1, [("丁香", None), ("郁金", None)], ["g"], False), (2, [("a", 9.0), ("b", 99.0), ("x", None)], ["g", "h", "i"], True), (3, [("郁金", None)], [], False)], f"rid long, items {item}, goals array<string>, restricted boolean")
    dictionary = spark.createDataFrame([("a", 2.0, 10.0, ["c1"]), ("b", 1.0, 10.0, ["hot"]), ("丁香", 2.0, 3.0, [])], "item string, dose_min double, dose_max double, capabilities array<string>")
    goal_map = spark.createDataFrame([("h", ["c1"]), ("i", ["hot"]), ("g", ["cold"])], "goal string, wanted array<string>")
    found = rules.findings(rows, RULES, dictionary, goal_map)
    got = {(r.rid, r.code): (r.level, r.detail) for r in found.collect()}
    assert got[1, "INCOMPATIBLE"][0] == "warn" and got[2, "INCOMPATIBLE"] == ("block", "a+b")
    assert got[2, "ILLEGAL_ITEM"] == ("block", "x") and got[2, "DOSE_CAP"] == ("block", "a") and got[2, "DOSE_EXCEEDED"] == ("warn", "b")
    assert got[2, "COVERAGE_LOW"] == ("warn", "g")  # two of three goals are less than .67
    assert got[2, "CONTRADICTION"] == ("warn", "g:hot") and got[2, "RESTRICTED_FORBIDDEN"] == ("block", "a") and got[1, "LOW_CONFIDENCE"][0] == "note"
    verdict = {r.rid: r.verdict for r in rules.verdicts(rows, found).collect()}
    assert verdict == {1: "warn", 2: "block", 3: "note"}
    filled = spark.createDataFrame([(1, ["a", "b", "zz", "丁香"])], "rid long, items array<string>")
    r = rules.fill_doses(filled, dictionary, RULES.toxic).first()
    assert (r.n, r.n_filled, r.total, r.any_toxic) == (4, 3, 6.0 + 1.0 + 2.0, True)
    assert rows.select(rules.repair(rules.names(), RULES).alias("h")).collect()[1].h == ["a"]
    import re

    pattern = re.compile(rules.grammar(RULES.vocabulary))
    assert pattern.match("丁香 郁金") and not pattern.match("丁 郁金") and not pattern.match("丁香 ")


def test_repair_in_rounds_and_the_schema(spark):
    r = rules.Rules(vocabulary=["a", "b", "c", "d"], pairs=[("a", "b"), ("b", "c"), ("c", "d")], downgraded={("c", "d"): "warn"})
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c", "d"]), (3, []), (4, ["b", "a"]), (5, ["a", "a"])], "rid long, items array<string>")
    got = {x.rid: x for x in rows.select("rid", rules.validated(F.col("items"), r).alias("v"), rules.fits_schema(F.col("items"), rules.schema(r.vocabulary, 1, 2)).alias("fits")).collect()}
    assert [(got[k].v["items"], got[k].v.attempts, got[k].v.failed) for k in (1, 2, 3, 4)] == [(["a"], 2, False), (["a", "c", "d"], 1, False), ([], 1, False), (["b"], 2, False)]
    assert [got[k].fits for k in (1, 2, 3, 4, 5)] == [False, False, False, True, False]
    assert rules.grammar_check(r.vocabulary) | {"length": 0} == {"items": 4, "single": 4, "several": True, "refuses": True, "length": 0}
    assert rules.schema(["b", "a"])["properties"]["items"]["items"]["enum"] == ["a", "b"]


def test_findings_as_text(spark):
    rows = spark.createDataFrame([(1,), (2,)], "rid long")
    found = spark.createDataFrame([(1, "warn", "DOSE_EXCEEDED", "b"), (1, "block", "INCOMPATIBLE", "a+b")], "rid long, level string, code string, detail string")
    got = {r.rid: r.text for r in rules.rendered(rows, found).collect()}
    assert got == {1: "block (2)\n- [block] INCOMPATIBLE: a+b\n- [warn] DOSE_EXCEEDED: b", 2: "ok (0)"}


def test_unclean_names_are_errors(spark):
    from tidemark.functions.parsing import clean_name

    df = spark.createDataFrame([("丹参",), ("x1",)], "n string")
    assert df.where("n = '丹参'").select(clean_name(F.col("n")).alias("n")).first().n == "丹参"
    with pytest.raises(Exception, match="unclean name: x1"):
        df.select(clean_name(F.col("n"))).collect()


def test_first_entry_with_content(spark):
    df = spark.createDataFrame([("raw rice",), ("raw dust",)], "n string")
    got = df.select(knowledge.first_with(F.col("n"), ["^raw "], {"rice": "RICE"}).alias("g")).collect()
    assert [r.g is None for r in got] == [False, True]


def test_name_resolution(spark):
    names = spark.createDataFrame([("炙甘草片",), ("甘草",), ("unknown",)], "name string")
    known = spark.createDataFrame([("甘草", "GC", 2), ("炙甘草", "ZGC", 3)], "alias string, target string, tier int")
    got = {r.name: (r.target, r.step) for r in knowledge.resolve(names, known, ["^炙", "片$"]).collect()}
    assert got["甘草"] == ("GC", 0) and got["炙甘草片"][0] == "ZGC" and got["unknown"] == (None, None)


def test_files(spark, tmp_path):
    raw = [("1", "m", "男", "40岁", "腰痛", "腰痛，不痛", "a,b", "x/y/z", "丹参1.000", "2025-6-30"), ("2", "m", "女", None, None, None, None, None, None, "bad")]
    spark.createDataFrame(raw, list(files.RAW)).coalesce(1).write.csv(f"{tmp_path}/raw.csv", header=True)
    df = files.load_raw(spark, f"{tmp_path}/raw.csv")
    v = files.build_visits(df, F.col("pid"), sex_outlier=F.col("sex") != "男", lengths=(5, 40))
    got = {r.rid: r for r in v.collect()}
    assert got[1].flags == ["length_outlier", "text_prefix"] and got[2].flags == ["sex_outlier"] and got[2].date is None and got[2].text_short == ""
    files.write_jsonl(v, f"{tmp_path}/v")
    assert sorted(map(str, files.read_jsonl(spark, f"{tmp_path}/v", files.VISIT).collect())) == sorted(map(str, v.collect()))
    (tmp_path / "bad.jsonl").write_text('{"rid": 1}\n\n{"rid": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", files.VISIT).collect()
    with pytest.raises(ValueError):
        files.load_raw(spark, f"{tmp_path}/raw.csv", ("a", "b"))
    files.write_json({"a": [1, 2]}, f"{tmp_path}/doc.json")
    assert files.read_json(spark, f"{tmp_path}/doc.json").first().a == [1, 2]
    sheet = spark.createDataFrame([("x", "1.0"), ("y", None), ("z", "0")], "n string, Suppress string")
    assert sorted(r.n for r in files.drop_suppressed(sheet).collect()) == ["y", "z"]
    chat = spark.createDataFrame([([("system", "s"), ("user", "u@x.de u@x.de"), ("assistant", "a")],), ([("user", "u")],)], files.CHAT)
    assert files.unsound_chats(chat).count() == 1
    once = files.redact_rows(chat, r"\S+@\S+", "[x]", messages="messages")
    assert [r.redacted for r in once.collect()] == [2, 0]
    assert {r.redacted for r in files.redact_rows(once.drop("redacted"), r"\S+@\S+", "[x]", messages="messages").collect()} == {0}
    assert files.markdown(sheet, "t").startswith("# t\n\n| n | Suppress |")


def test_split_counts_pass_on_few_rows(spark):
    """Counts of the first rows of each split are those of a sort, for any share and for bands that miss at first; without a sort of all rows."""
    import hashlib
    import random
    from collections import Counter

    from tidemark.operators import resample

    rng = random.Random(4)
    rows = [(i, rng.sample("abcdef", rng.randrange(4))) for i in range(600)] + [(9, ["a"]), (9, ["a"])]
    base = spark.createDataFrame(rows, "rid long, items array<string>")
    for n, width in ((0, 6), (1, 6), (150, 6), (300, 0.001), (len(rows), 6)):
        want = Counter()
        for b in range(8):
            order = sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}:{b}:perm".encode()).hexdigest())  # noqa: B023
            want.update((b, x) for _, items in order[:n] for x in items)
        got = resample.split_counts(base, 8, n, len(rows), width).collect()
        assert {(r.b, r.item): r.n for r in got} == dict(want), n
    low, high = resample.band(500_000, 2_000_000, 6)
    assert int(high, 16) - int(low, 16) < 0.01 * 16**12
