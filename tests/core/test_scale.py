"""Operators whose rows must not grow with the number of pairs, held against plain code."""

import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import FOLDER, TABLES, rows
from tidemark.operators import bayes, retrieval
from tidemark.operators.splits import folds
from tidemark.plans.all import ORACLES, QUERIES


def most_rows(spark, run):
    """What run() gives, and the most rows that a node of its plans has made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        run_ = runs.apply(k)
        values, metrics = store.executionMetrics(run_.executionId()), run_.metrics()
        for i in range(metrics.size()):
            m = metrics.apply(i)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return out, most


def test_candidates_of_a_common_label_are_not_rows(spark):
    rng = random.Random(3)
    row = lambda rid: (rid, ["i%d" % rng.randrange(6)], rng.sample("abcdefgh", rng.randrange(0, 5)), rng.choice([["p"], ["p", "q"], ["p", "q"], ["r"]]), [rng.choice("xyz")])
    pool, asked = [row(k) for k in range(4000)], [row(10_000 + k) for k in range(40)]
    asked.append((20_000, ["i1"], ["a", "b"], ["alone"], ["x"]))
    pool.append((30_000, ["i2"], ["a"], ["alone"], ["nowhere"]))
    schema = "rid long, items array<string>, tokens array<string>, patterns array<string>, diseases array<string>"
    frames = spark.createDataFrame(asked, schema), spark.createDataFrame(pool, schema).repartition(4)
    found, most = most_rows(spark, lambda: retrieval.candidates(*frames, 7, 3).collect())
    want = {}
    for q, items, tokens, patterns, diseases in asked:
        near = lambda x: round(len({*tokens} & {*x[2]}) / (len({*tokens} | {*x[2]}) or 1), 9)  # noqa: E731, B023
        mine = [x for x in pool if {*patterns} & {*x[3]}]
        if len(mine) < 3:
            mine = [x for x in pool if {*patterns} & {*x[3]} or {*diseases} & {*x[4]}]
        for rank, x in enumerate(sorted(mine, key=lambda x: (-near(x), x[0]))[:7], 1):  # noqa: B023
            want[q, rank] = (x[0], round(len({*items} & {*x[1]}) / len({*items} | {*x[1]}), 9))
    assert {(r.q, r["rank"]): (r.rid, r.j) for r in found} == want
    assert most < 8000  # 4,001 visits; pairs that share a pattern are over 60,000


def test_every_test_visit_asks(spark):
    """Against the SQL without a limit on queries, on tables with more test visits than that."""
    import duckdb

    folder, c = Path(FOLDER).parent / "sf0.01", duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = c.execute(ORACLES["retrieval_ceiling"].replace(" ORDER BY sha256(rid || ':q'), rid LIMIT 800", ""))
    names, want = [d[0] for d in out.description], out.fetchall()
    found = QUERIES["retrieval_ceiling"](spark, str(folder))
    assert min(r[names.index("queries")] for r in want) > 800
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("least", [3, 60])
def test_shards_and_blocks_of_a_common_label_give_the_nearest(spark, monkeypatch, least):
    rng = random.Random(least)
    monkeypatch.setattr(retrieval, "CELLS", 20)
    monkeypatch.setattr(retrieval, "ASKS", 9)
    some = lambda values, most: rng.sample(values, rng.randrange(0, most + 1))
    row = lambda rid: (rid, some("uvwxyz", 4), some(["a", "b", "c", "d", "e,", 'f"', "无"], 4), [*some("pqrs", 2), *(["all"] if rid % 3 else [])], some("klm", 2))
    pool, asked = [row(k) for k in rng.sample(range(5000), 700)], [row(10_000 + k) for k in range(150)]
    asked += [(20_000, ["u"], ["a"], ["nowhere"], ["k"]), (20_001, ["u"], ["a"], ["nowhere"], ["nothing"]), (20_002, ["u"], None, None, None)]
    pool += [(30_000, ["v"], None, ["all"], None), (30_001, ["v"], ["a"], None, ["k"])]
    schema = "rid long, items array<string>, tokens array<string>, patterns array<string>, diseases array<string>"
    found = retrieval.candidates(spark.createDataFrame(asked, schema), spark.createDataFrame(pool, schema).repartition(5), 7, least).collect()
    share = lambda a, b: round(len({*(a or [])} & {*(b or [])}) / (len({*(a or [])} | {*(b or [])}) or 1), 9)
    want = {}
    for q, items, tokens, patterns, diseases in asked:
        mine = [x for x in pool if share(patterns, x[3])]
        if len(mine) < least:
            mine = [x for x in pool if share(patterns, x[3]) or share(diseases, x[4])]
        for rank, x in enumerate(sorted(mine, key=lambda x: (-share(tokens, x[2]), x[0]))[:7], 1):  # noqa: B023
            want[q, rank] = (x[0], share(items, x[1]), len({*items} - {*x[1]}), len({*x[1]} - {*items}))
    assert {(r.q, r["rank"]): (r.rid, r.j, r.adds, r.deletes) for r in found} == want and len(found) == len(want)
    assert (20_000, 1) in want and (20_001, 1) not in want


def test_pieces_of_a_tile_give_the_same_lists(monkeypatch):
    rng = random.Random(8)
    sets = [json.dumps(sorted(rng.sample("abcdefg", k % 5))) for k in range(60)]
    own = list(dict.fromkeys((key, t) for key in "pq" for t in sets))
    ids = rng.sample(range(10_000), 4 * len(own))
    cells = pa.table({"key": [k for k, _ in own], "t": [t for _, t in own], "rids": [sorted(ids[4 * n : 4 * n + 1 + n % 4]) for n in range(len(own))]})
    asks = pa.table({"q_key": [k for k, _ in own], "q_t": [t for _, t in own]})
    lists = lambda: {(r["key"], r["t"]): [(x["s"], x["rid"]) for x in r["found"]] for r in retrieval._meet(6, 4)(cells, asks).to_pylist()}
    whole = lists()
    monkeypatch.setattr(retrieval, "BLOCK", (7, 3))
    assert lists() == whole and len(whole) == len(own)
    for (key, t), got in whole.items():
        mine, every = {*json.loads(t)}, []
        for r in cells.to_pylist():
            both = len(mine & {*json.loads(r["t"])})
            if r["key"] == key:
                every += [(-round(np.round(both / (len(mine | {*json.loads(r["t"])}) or 1), 9) * 1e9), rid) for rid in r["rids"]]
        assert got == sorted(every)[:6]


def test_scores_of_levels_are_not_rows(spark):
    visits = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    found, most = most_rows(spark, lambda: QUERIES["ablation_levels"](spark, FOLDER).collect())
    assert len(found) == 6 and most < 20 * visits  # rows of lines and features; scores are six levels of 25 items


def test_ranges_of_scores_give_the_whole_auc(spark, monkeypatch):
    rng = random.Random(5)
    data = [(k, rng.sample("xyz", rng.randrange(0, 3)), rng.sample("abc", rng.randrange(0, 3)), rng.sample("defgh", rng.randrange(0, 5))) for k in range(300)]
    data = [(k, sorted({*i, *("x" if "a" in f and k % 3 else "")}), f, g) for k, i, f, g in data]
    rows = spark.createDataFrame(data, "rid long, items array<string>, f array<string>, g array<string>")
    monkeypatch.setattr(bayes, "RANGE", 40)
    found = {(r.level, r.item): (r.n, r.positives, r.auc) for r in bayes.naive_bayes_auc(rows, ["f", "g"], 5, 50).collect()}
    fold = {r.rid: r.fold for r in folds(rows.select("rid"), "rid", 5).collect()}
    want = {}
    for level, item in ((level, item) for level in (0, 1) for item in "xyz"):
        features = {k: {*f} | ({*g} if level else set()) for k, _, f, g in data}
        scores = []
        for k, items, *_ in data:
            other = [x for x in data if fold[x[0]] != fold[k]]
            ones = [x[0] for x in other if item in x[1]]
            zeros = [x[0] for x in other if item not in x[1]]
            c1, c0 = (Counter(v for x in side for v in features[x]) for side in (ones, zeros))
            score = math.log(len(ones) / len(zeros))
            for v in "abcdefgh" if level else "abc":
                p1, p0 = (c1[v] + 1) / (len(ones) + 2), (c0[v] + 1) / (len(zeros) + 2)
                score += math.log(p1 / p0) if v in features[k] else math.log((1 - p1) / (1 - p0))
            scores.append((round(score, 9), item in items))
        up, down = ([s for s, y in scores if y is side] for side in (True, False))
        won = sum((a > b) + (a == b) / 2 for a in up for b in down)
        want[level, item] = (300, len(up), round(won / len(up) / len(down), 6))
    assert found == want
