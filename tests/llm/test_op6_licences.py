import random
import re

from pyspark.sql import types as T

from tidemark.llm.licences import COVER, NOTICES, PHRASES, SLACK, scan

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.StringType())])


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return words, len(found), min(places, default=None), max(places, default=None), {label for _, label in found}


def notices(words):
    """Every notice at every place, without an index."""
    out = set()
    for label, text, keys in NOTICES:
        want = text.split()
        for b in range(-SLACK, len(words)):
            near = words[max(0, b - SLACK) : b + len(want) + SLACK]
            hit = sum(any(0 <= b + o + s < len(words) and words[b + o + s] == w for s in range(-SLACK, SLACK + 1)) for o, w in enumerate(want))
            if hit / len(want) >= COVER and all(any(near[i : i + len(k.split())] == k.split() for i in range(len(near))) for k in keys):
                out.add(label)
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for i in range(160):
        words = [rng.choice(["alpha", "the", "license", "mit", "Cc", "BY", "été", "x1", "public", "software"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            _, text, _ = rng.choice(NOTICES)
            own = text.split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "other"
            a = rng.randrange(len(words) + 1)
            words[a:a] = [w.upper() if rng.random() < 0.2 else w for w in own]
        docs.append((i, rng.choice([" ", ", ", "\n# "]).join(words)))
    docs += [(None, "MIT License, mit-license"), (500, None), (501, ""), (502, "§ ÀB ab_c İ"), (503, "cc by " * 20_000), (503, "cc by"), (504, "mit licence"), (505, "Cc by")]
    got = {}
    for r in scan(spark.createDataFrame([(*d, "", "") for d in docs], SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    for doc_id, text in docs:
        words, n, first, last, labels = base(text)
        r = next(x for x in got[doc_id] if x.n_words == len(words))
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (n, first, last, ",".join(sorted(labels))), text
        more = set(filter(None, r.labels.split(",")))
        assert labels <= more and 0 <= r.score <= 1 and (r.score > 0) == bool(more)
        if len(words) < 500:
            assert more == labels | notices(words), (text, more)


def test_no_documents(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []
