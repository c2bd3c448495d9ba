import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tidemark.llm.passages import Block, kept_words, leftmost_least, short_rows

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType())])


def brute(docs, window):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = [w.decode() for w in (text or "").encode().split()]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, window=20, start=5, parts=3):
    df = spark.createDataFrame([(*d, "other") for d in docs], SCHEMA).repartition(1).coalesce(1) if parts == 1 else spark.createDataFrame([(*d, "other") for d in docs], SCHEMA)
    got = kept_words(df, window, start, block_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(docs, window)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(30)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if docs and rng.random() < 0.6:
            other = (rng.choice(docs)[1] or "").split()
            a = rng.randrange(len(other) + 1)
            words[5:5] = other[a : a + rng.randrange(60)]
        docs.append((100 - i, "\n ".join(words)))
    got = check(spark, docs)
    assert sum(r.n_removed for r in got) > 100
    check(spark, docs, window=4, start=1)
    check(spark, docs, window=8, start=8)


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(None, passage), (1, passage), (2, None), (3, ""), (4, "\t\n"), (5, "a " * 60), (6, "x " + passage + " y z"), (6, passage + " tail"), (7, passage[:-1]), (-9, "pre " + passage)]
    got = check(spark, docs)
    assert {r.doc_id: r.kept for r in got if r.doc_id == 5} == {5: "a"}
    assert [r.kept for r in got if r.doc_id == 1] == [""]


def test_empty_and_long(spark):
    assert kept_words(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"t{i % 50021}" for i in range(400_000))
    check(spark, [(1, long), (2, "short"), (3, long[:3000])])


def test_levels(spark):
    with pytest.raises(ValueError):
        kept_words(spark.createDataFrame([], SCHEMA), window=20, start=7)


def test_least_of_each_stretch():
    rng = np.random.default_rng(3)
    for n, width in ((1, 1), (40, 16), (60, 7), (16, 16)):
        h = rng.integers(0, 9, n).astype(np.uint64)
        assert leftmost_least(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(n - width + 1)]


def test_rows_of_a_group_are_a_share_of_its_words():
    """What a map group sends on the first level depends on its own words alone: a row of fixed width for about 2 of 12 of them."""
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 20_000))) for _ in range(5)]
    block = Block(pa.table({"row": list(range(5)), "doc_id": list(range(5)), "text": texts}), [5, 10, 20])
    sent = short_rows(0, block, 5, None)
    assert 0.14 < sent.num_rows / 100_000 < 0.19 and sent.nbytes == 20 * sent.num_rows
    again = np.asarray(sent.column("key")).view(np.uint64)
    assert block.candidates(10, again).all() and not block.candidates(10, again[:0]).any()
    assert short_rows(0, block, 10, again).num_rows == sent.num_rows


def test_no_texts_in_a_shuffle_after_the_first(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], SCHEMA)
    plan = kept_words(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 6 and all("block" in line or "key" in line or "one" in line for line in exchanges)
    assert not any("text" in line for line in exchanges)
