import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from tidemark.llm import quality
from tidemark.llm.quality import STATS, consistency, estimates, judged

SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "lang", "source", "n_words", "kept", "group", "x1")])


def plain(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    many = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if many[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def made(n, seed=0):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = ["".join(rng.choices(["ka", "lo", "mi", "té", "s"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(55, 300))]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), rng.choice(["aa", None]), rng.choice(["s1", "s2", None])))
    return docs


def run(spark, docs, carry=("doc_id", "n_words", "kept")):
    return judged(spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], SCHEMA), list(carry)).collect()


def test_statistics_and_edge_cases(spark):
    odd = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x x", "l 1\nl 1\n\n \n \nl 2\n l 1", "p\r\nq\r\np\x0b\x0cq", "# $ a|b <é>  z 😀", "a b c d " * 30_000, "α β γ\n" * 3, "w " * 60]
    docs = [(None if i == 4 else i, t, "de", "s") for i, t in enumerate(odd)] + [(1, odd[5], None, None)]
    got = run(spark, docs)
    assert sorted((tuple(r[c] for c in STATS) for r in got), key=str) == sorted((plain(d[1]) for d in docs), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed) and all(r.doc.n_words == "a" for r in got)


def test_outliers_go_and_clean_texts_stay(spark):
    docs = made(600)
    got = {r.doc.doc_id: r for r in run(spark, docs)}
    assert [k for k, r in sorted(got.items()) if not r.kept] == list(range(0, 600, 20))
    assert run(spark, []) == []
    assert all(r.kept for r in run(spark, docs[:9]))  # too few rows for an estimate
    same = run(spark, [(i, docs[1][1], "aa", "s1") for i in range(120)])
    assert all(r.kept and r.distance < 1e-6 for r in same)


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal([1, 2, 3, 4], np.diag([1.0, 4.0, 2.0, 1.0]) + 0.5, 4000)
    bad = rng.normal(60, 1, (900, 4))
    df = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([clean, bad])], "group string, x1 double, x2 double, x3 double, x4 double")
    e = estimates(df).first()
    assert np.abs([e.m0 - 1, e.m1 - 2, e.m2 - 3, e.m3 - 4]).max() < 0.3
    w = np.array([[e[f"w{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    d = ((np.vstack([clean, bad]) - [e.m0, e.m1, e.m2, e.m3]) @ w.T) ** 2
    assert d.sum(1)[4000:].min() > quality.quantile(0.999) > np.quantile(d.sum(1)[:4000], 0.99)
    cov = np.linalg.inv(w.T @ w)
    assert 0.6 < np.linalg.det(cov) / np.linalg.det(np.cov(clean.T)) < 8  # the subset has more than its share of the clean rows


def test_groups_with_much_junk(spark):
    """In one group 35 % of the rows are junk, in the other 45 %."""
    rng = random.Random(8)
    docs = []
    for i in range(800):
        words = ["".join(rng.choices(["ka", "lo", "mi", "té", "s"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(60, 200))]
        junk = i % 20 < (7 if i < 400 else 9)
        docs.append((i, " ".join(w + "#" * (junk and k % 2) for k, w in enumerate(words)), "de", "s1" if i < 400 else "s2"))
    got = {r.doc.doc_id: r for r in run(spark, docs)}
    assert [k for k, r in sorted(got.items()) if r.kept] == [d[0] for d in docs if "#" not in d[1]]


def plain_distances(x):
    """Squared distances by a minimum-covariance-determinant estimate in numpy, from the same two starts."""
    n, floor, best = len(x), np.diag([v[2] ** 2 for v in quality.VECTOR]), (math.inf,)
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for centre, cov in ((middle, np.diag(((high - low) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        cov, before = cov + floor, math.inf
        while True:
            d = np.einsum("ij,ij->i", (x - centre) @ np.linalg.inv(cov), x - centre)
            near = x[d <= np.sort(d)[(n + 5) // 2 - 1]]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * consistency(len(near) / n) + floor
            det = np.linalg.slogdet(cov)[1]
            best = min(best, (det, tuple(centre), cov.tolist()))
            if det >= before - quality.FALL:
                break
            before = det
    x = x - best[1]
    return np.einsum("ij,ij->i", x @ np.linalg.inv(np.array(best[2])), x)


def test_verdict_against_numpy(spark):
    """Each language and source by itself, large and small; rows whose distance is within a tenth of the cut may go either way."""
    docs, got = made(700), {}
    docs = [(i, t, lang, source if i % 50 else "small") for i, t, lang, source in docs]
    for r in run(spark, docs, ("doc_id", "lang", "source")):
        got.setdefault((r.doc.lang, r.doc.source), []).append(r)
    judged_rows, near = 0, 0
    for rows in got.values():
        fair = [r for r in rows if not r.base_failed]
        if len(fair) < quality.LEAST_ROWS:
            continue
        x = np.log([[max(r.word_chars, 1) / max(r.n_words, 1), *(1 + 100 * r[c] / max(r.n_words, 1) for c in ("n_symbols", "n_repeat_words", "n_dup_lines"))] for r in fair])
        cut = quality.quantile(quality.KEPT)
        for r, d in zip(fair, plain_distances(x)):
            judged_rows += 1
            near += abs(d / cut - 1) < 0.1
            assert r.kept == (d <= cut) or abs(d / cut - 1) < 0.1
    assert judged_rows > 400 and near < 0.02 * judged_rows


def test_small_groups_go_by_their_language(spark):
    docs = [(i, t, "aa", "s") for i, t, *_ in made(300) if i % 20] + [(1000, made(1)[0][1], "aa", "lone"), (1001, made(2)[1][1], "aa", "lone")]
    got = {r.doc.doc_id: r.kept for r in run(spark, docs)}
    assert not got[1000] and got[1001]


def test_quantiles():
    assert [round(quality.quantile(p), 2) for p in (0.5, 0.975, 0.999)] == [3.36, 11.14, 18.47]


def test_consistency_factor():
    x = np.random.default_rng(0).normal(size=(200_000, 4))
    near = x[np.argsort((x**2).sum(1))[:150_000]]
    assert abs(consistency(0.75) - 1 / near.var()) < 0.02


def test_only_dataframe_functions(spark):
    plan = judged(spark.createDataFrame([(*d, "a", "b", "c", "d") for d in made(3)], SCHEMA), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
