import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tidemark.llm import mixing
from tidemark.llm.mixing import mixed

SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "source", "size", "row", "p", "target")])


def goals(docs):
    """Shares the excess anew until no target is above its limit."""
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len((text or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * size[s] + 1e-9}
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = 2.0 * size[s]
            left -= out[s]
        free -= over
    return size, out


def run(spark, docs, **more):
    return mixed(spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], SCHEMA), **more).collect()


def made(n, seed=0, sources=("a", "b", "c", "é", None)):
    rng = random.Random(seed)
    return [(i, "w " * rng.randrange(0, 90), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("n", [700, 60])
def test_targets_are_met(spark, n):
    docs = [(d[0], d[1], "a" if d[0] % 3 == 0 else d[2]) for d in made(n)] + [(None, "x y z", "b"), (3, None, "c"), (3, "", "b"), (9, "one", "only"), (10, None, "empty")]
    got = run(spark, docs)
    size, goal = goals(docs)
    taken, most = defaultdict(int), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert not r["size"] or int(r.target / r.source_size) <= r.copies <= int(r.target / r.source_size) + 1
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s in size:
        assert abs(taken[s] - goal[s]) <= most[s] + 1e-6, s
    assert sorted(map(str, run(spark, docs))) == sorted(map(str, got))


def test_reruns_agree_whatever_the_partitions(spark):
    docs = made(300) + [(5, "w w w", "a")] * 200 + [(None, "w w", "b")] * 90
    df = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], SCHEMA)
    runs = [sorted((str(r.doc_id), r["size"], r.taken) for r in mixed(df.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    size, goal = goals(docs)
    got = defaultdict(int)
    for r in mixed(df).collect():
        got[r.source] += r.taken
    assert all(abs(got[s] - goal[s]) <= 90 for s in goal)


def test_each_document_keeps_its_probability(spark):
    docs = [(i, "w " * (1 + i % 7), s) for i in range(40) for s in ("a", "b")]
    total, runs = defaultdict(int), 12
    for seed in range(runs):
        for r in run(spark, docs, seed=seed):
            total[r.source, r["size"] <= 3] += r.copies - r.target / r.source_size
    assert all(abs(v) / runs < 6 for v in total.values()), total


def test_no_documents_and_no_words(spark):
    assert run(spark, []) == []
    assert [(r.taken, r.target) for r in run(spark, [(1, None, None), (2, " ", "a")])] == [(0, 0.0), (0, 0.0)]


def test_only_dataframe_functions(spark):
    plan = mixed(spark.createDataFrame([(1, "a", "b", "", "", "", "")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_alike_are_numbered_across_parts(spark):
    rows = [(i, None if i % 3 else i % 5, "s" if i % 2 else None) for i in range(300)] + [(1000, 77, "s")]
    got = mixing.numbered_alike(spark.createDataFrame(rows, "row long, doc_id long, source string"), ["doc_id", "source"], parts=4).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.doc_id, r.source), []).append(r)
    assert len(got) == 301 and len(groups[77, "s"]) == 1
    assert all(sorted(r.number for r in g) == list(range(1, len(g) + 1)) and {r.alike for r in g} == {len(g)} for g in groups.values())
