import math
import random

import numpy as np
from pyspark.sql import types as T

from tests.oracle import FOLDER
from tidemark.llm import langid
from tidemark.llm.langid import chosen, fit, fitted, ftrl, held_out, identify, temperature
from tidemark.llm.ngrams import CHUNK, counted, grams, letters

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
SOUNDS = {"aa": ["ka", "lo", "mi"], "bb": ["ñu", "per", "st"], "cc": ["zor", "qui", "éa"]}


def made(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SOUNDS))
        out.append((i, " ".join("".join(rng.choices(SOUNDS[lang], k=3)) for _ in range(rng.randrange(3, 60))), lang, "x"))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    rows = made(400)
    extra = [(None, "kalomi lokami", None, "x"), (1001, None, "aa", "x"), (1002, "", "bb", "x"), (1003, "123 !?", "cc", "x"), (1004, "kalomi " * 300_000, "aa", "x"), (3, rows[3][1], rows[3][2], "x")]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    got = identify(docs, docs.where(~held_out())).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1001, 1002, 1003)] == ["und"] * 3 and by[1003].score == 0
    assert by[1004].lang_pred == by[None].lang_pred == "aa"
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and np.mean([by[r.doc_id].lang_pred == rows[r.doc_id][2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(made(3), SCHEMA)
    assert {r.lang_pred for r in identify(docs, docs.where("false")).collect()} == {"und"}
    assert identify(docs.where("false"), docs.where("false")).collect() == []


def test_grams_of_long_texts_are_those_of_the_whole():
    data = letters("abc de " * (CHUNK // 3))
    at, n = counted(data, range(2, 6), 16)
    assert n.sum() == sum(len(data) - k + 1 for k in range(2, 6))
    small = letters("Ab1cé")
    assert "".join(map(chr, small)) == " ab cé " and len(next(grams(small, range(2, 3), 8))) == len(small) - 1


def plain_ftrl(rows, y, classes):
    """FTRL-Proximal coordinate by coordinate, with dictionaries."""
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= langid.L1:
            return 0.0
        return (math.copysign(langid.L1, z[key]) - z[key]) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for (at, x), k in zip(rows, y):
            margins = [sum(v * weight((i, c)) for i, v in zip(at.tolist(), x.tolist())) for c in range(classes)]
            top = max(margins)
            p = [math.exp(m - top) / sum(math.exp(o - top) for o in margins) for m in margins]
            old = {(i, c): weight((i, c)) for i in at.tolist() for c in range(classes)}
            for i, v in zip(at.tolist(), x.tolist()):
                for c in range(classes):
                    g = v * (p[c] - (c == k))
                    was = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / langid.ALPHA * old[i, c]
                    n[i, c] = was + g * g
    return weight


def test_ftrl_against_plain_code():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(12, 5, replace=False)), rng.random(5)) for _ in range(60)]
    y = rng.integers(0, 3, 60)
    got, want = ftrl(rows, y, 3, 12), plain_ftrl(rows, y.tolist(), 3)
    assert np.allclose(got, [[want((i, c)) for c in range(3)] for i in range(12)], atol=1e-9) and np.abs(got).max() > 0.01


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(2)
    margins, y = rng.normal(0, 4, (300, 3)), rng.integers(0, 3, 300)
    margins[np.arange(300), y] += 3

    def loss(t):
        e = np.exp(margins / t - (margins / t).max(axis=1, keepdims=True))
        return -np.log(e[np.arange(300), y] / e.sum(axis=1)).mean()

    t = temperature(margins, y)
    assert loss(t) <= min(loss(x) for x in np.exp(np.linspace(-2.9, 2.9, 400))) + 1e-6
    assert temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_rare_languages_are_learned_and_copies_count_once(spark):
    rows = [(i, t, "aa", "x") for i, (_, t, lang, _) in enumerate(made(3000)) if lang == "aa"] * 2
    rows += [(10_000 + i, "ñustper perñu", "bb", "x") for i in range(5)] + [(20_000, "kalomi", "aa", "x")] * 500
    train = spark.createDataFrame(rows, SCHEMA)
    picked = chosen(train, 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in picked} == {"aa": 100, "bb": 5}
    model = fit(train, 100)
    assert model.langs == ["aa", "bb"]
    assert model.predict("perstñu perper")[0] == "bb" and model.predict("lokami kaka")[0] == "aa"


def test_letters_outside_ascii_count_as_one():
    """A window has as many characters in each script."""
    data = letters("Яблоко 日本")
    assert len(data) == 11 and [len(g) for g in grams(data, range(1, 6), 18)] == [11, 10, 9, 8, 7]
    rows = [(lang, *counted(letters(w * 3), langid.SIZES, langid.BITS)) for lang, words in (("ru", ["да нет", "дом"]), ("ja", ["日本", "本日"])) for w in words]
    model = fitted(rows, np.ones(1 << langid.BITS))
    assert model.predict("нет дом")[0] == "ru" and model.predict("日本")[0] == "ja"


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in identify(docs, docs.where(~held_out())).collect() if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.97 * len(got) > 0
