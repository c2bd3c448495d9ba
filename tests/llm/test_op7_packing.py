import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.packing import assign, capacities, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])


def check(spark, docs, **more):
    tokenizer = Tokenizer.from_file(PATH)
    rows = pack(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA), PATH, **more).collect()
    want = defaultdict(list)
    for key, text in docs:
        want[key].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= more.get("size", 2048) and at & (at - 1) == 0  # nothing is padded
    assert set(pieces) == set(want)
    for key, texts in want.items():
        assert sum(r.length for r in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = texts[0], 0
            for r in sorted(pieces[key], key=lambda r: r.start):
                own = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own))
                at += r.length
    return rows


def test_round_trip(spark):
    docs = [(i, "Ein Wort, deux mots <|endoftext|> 3 \n\n  été'll 😀 " * (i % 40)) for i in range(150)] + [(None, "x"), (900, None), (901, ""), (902, "very long " * 60_000), (7, "again")]
    check(spark, docs)
    check(spark, docs, size=256, group_tokens=1000)
    assert check(spark, []) == []


@pytest.mark.parametrize("size", [1, 8, 100])
def test_assignment_covers_all(size):
    rng = np.random.default_rng(size)
    lengths = [int(x) for x in rng.integers(1, 3 * size + 2, 80)]
    rows = list(assign(lengths, size))
    assert sorted((i, s + k) for i, s, n, _, _ in rows for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    cells = sorted((q, o + k) for _, _, n, q, o in rows for k in range(n))
    assert len(set(cells)) == len(cells) == sum(lengths)
    assert sum(capacities(sum(lengths), size)) == sum(lengths)
