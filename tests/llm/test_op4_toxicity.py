import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from tidemark.llm import toxicity
from tidemark.llm.toxicity import Index, platt, score

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.StringType()), T.StructField("score", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["ka", "lo", "mi", "té"], k=3)) for _ in range(rng.randrange(1, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "Vilest", "grubby"])
        docs.append((i, " ".join(words), "clash", "clash"))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = made(600)
    extra = [(None, "vile", "", ""), (2000, None, "", ""), (2001, "", "", ""), (2002, "…!", "", ""), (2003, "lokami " * 200_000 + " vile", "", ""), (5, docs[5][1], "", "")]
    got = score(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(7, 0, None), (None, 0, 1), (9, 0, labels[9][2])], LABELS)).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97
    assert by[None].predicted == 1 and by[2000].score == by[2001].score == by[2002].score < 0.5
    assert by[2003].predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame(made(4)[0], DOCS)
    assert len(score(docs, spark.createDataFrame([], LABELS)).collect()) == 4
    assert score(docs.where("false"), spark.createDataFrame(made(50)[1], LABELS)).collect() == []


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "FIRST", 2)
    rng = np.random.default_rng(3)
    dense = np.zeros((1500, 90))
    for i in range(1500):
        at = rng.choice(90, rng.integers(0, 6), replace=False, p=np.arange(1, 91) / 4095)
        dense[i, at] = rng.integers(1, 4, len(at))
    toxic, weights = (rng.random(1500) < 0.3).astype(float), rng.random(90) + 0.1
    row, term = np.nonzero(dense)
    index = Index(row, term, dense[row, term], weights, toxic, list(range(1500)))
    assert 0 < len(index.frequent) < 90 and index.blocks > 10
    x = np.where(dense > 0, (1 + np.log(np.maximum(dense, 1))) * weights, 0)
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    votes, alone = index.votes(row, term, dense[row, term], 1500), index.votes(row, term, dense[row, term], 1500, index.of, toxic)
    skipped = 0
    for i in range(1500):
        for found, left in ((votes[i], np.arange(1500) >= 0), (alone[i], np.arange(1500) != i)):
            cos = np.where(left, x @ x[i] if x[i].any() else (~x.any(axis=1)).astype(float), 0)
            last = np.sort(cos)[::-1][toxicity.NEIGHBOURS - 1]
            near = np.flatnonzero((cos >= last - 1e-9) & (cos > 1e-9))
            w = cos[near] ** 2
            assert abs(found[0] - (w @ toxic[near] + toxicity.PRIOR * index.prior) / (w.sum() + toxicity.PRIOR)) < 1e-6
            assert abs(found[2] - cos.max()) < 1e-6
    few = slice(0, np.searchsorted(row, 50))
    scores, _ = index.nearest(row[few], term[few], toxicity.unit(row[few], index.weighted(term[few], dense[row, term][few]), 50), 50, None)
    skipped = (scores < 0).mean()
    assert skipped > 0.2


def brute(docs, labels):
    """Scores of all documents by dictionaries and full comparison."""
    words = lambda t: re.findall("[a-z\u0080-\U0010ffff]+", (t or "").lower())
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = dict(docs)
    mine = {i: y for i, y in labels if i in texts and not held(i)}
    bags = {i: Counter(words(texts[i])) for i in mine}
    vocabulary = set().union(*bags.values())
    df = Counter(w for _, t in docs for w in set(words(t)))
    first = [i for i in mine if half(i) == 0]
    share = sum(mine[i] for i in first) / len(first)
    weight = {}
    for w in vocabulary:
        n1, n = sum(mine[i] for i in first if w in bags[i]), sum(1 for i in first if w in bags[i])
        z = (n1 - n * share) / math.sqrt(n * share * (1 - share) + 1)
        weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * (toxicity.LIGHT + (1 - toxicity.LIGHT) * max(0.0, 1 - (toxicity.SURE / max(z, toxicity.SURE)) ** 2))

    def vector(bag):
        x = {w: (1 + math.log(n)) * weight[w] for w, n in bag.items() if w in weight}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / length for w, v in x.items()}

    own, prior = {i: vector(b) for i, b in bags.items()}, (sum(mine.values()) + 0.5) / (len(mine) + 1)

    def vote(x, without=None):
        if x:
            cos = sorted(((sum(v * o.get(w, 0) for w, v in x.items()), i) for i, o in own.items() if i != without), reverse=True)
        else:
            cos = [(1.0, i) for i, o in own.items() if not o and i != without]
        last = cos[toxicity.NEIGHBOURS - 1][0] if x and len(cos) >= toxicity.NEIGHBOURS else 0
        near = [(c, i) for c, i in cos if c >= max(last - 1e-9, 1e-9)]
        total = sum(c * c for c, _ in near)
        return (sum(c * c * mine[i] for c, i in near) + toxicity.PRIOR * prior) / (total + toxicity.PRIOR)

    second = [i for i in mine if half(i) == 1]
    slope, offset = platt(np.array([vote(own[i], i) for i in second]), np.array([float(mine[i]) for i in second]))
    return {i: 1 / (1 + math.exp(-(slope * toxicity.logit(vote(vector(Counter(words(t))))) + offset))) for i, t in docs}


half = {}.get


def test_whole_score_against_brute_force(spark):
    global half
    docs, labels = made(150, 5)
    frame = spark.createDataFrame([(y[0], y[2]) for y in labels[:110]], "doc_id long, toxic int")
    picked = {r.doc_id: r.half for r in toxicity.examples_of(frame, 1000).collect()}
    half = picked.get
    want = brute([d[:2] for d in docs], [(y[0], y[2]) for y in labels[:110]])
    got = score(spark.createDataFrame(docs, DOCS), frame).collect()
    assert len(got) == 150 and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6


def test_few_toxic_labels_and_repeated_ids(spark):
    """With 6 toxic of 60 labels scores still differ; an id that is there a thousand times is one example."""
    docs, _ = made(200, 9)
    docs = [(i, t + (" vile" if i % 10 == 0 else ""), *c) for i, t, *c in docs]
    labels = [(i, 0, int(i % 10 == 0)) for i in range(60)]
    got = score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len({r.score for r in got}) > 100
    again = score(spark.createDataFrame(docs + [docs[11]] * 1000, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(again) == 1200 and len({r.score for r in again if r.doc_id == 11}) == 1


def test_calibration_follows_the_votes():
    votes = np.repeat([0.1, 0.9], 500)
    y = np.concatenate([np.repeat([0.0, 1.0], [490, 10]), np.repeat([0.0, 1.0], [10, 490])])
    slope, offset = platt(votes, y)
    p = 1 / (1 + np.exp(-(slope * toxicity.logit(np.array([0.1, 0.9])) + offset)))
    assert abs(p[0] - 0.02) < 0.01 and abs(p[1] - 0.98) < 0.01
