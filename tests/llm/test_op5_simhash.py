import random

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import roots
from tidemark.llm.simhash import fingerprint, links, near_duplicates

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("root", T.StringType())])


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    own = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute(docs):
    prints = [plain_print(t) for _, t in docs]
    n = range(len(docs))
    found = components([(i, j) for i in n for j in n if i < j and (prints[i] ^ prints[j]).bit_count() <= 3], n)
    least = {}
    for i in n:
        if docs[i][0] is not None:
            least[found[i]] = min(docs[i][0], least.get(found[i], docs[i][0]))
    return sorted(((docs[i][0], prints[i], least.get(found[i])) for i in n), key=str)


def run(spark, docs):
    got = near_duplicates(spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)).collect()
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs = []
    for i in range(150):
        words = [f"W{rng.randrange(300)}ß" for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            docs.append((2000 - len(docs), " ".join(words)))
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
    docs += [(None, docs[10][1]), (7, None), (8, ""), (3, " \n"), (9, "A b"), (9, "A b"), (None, "alone here now then"), (12, "long " * 50_000)]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []
    assert fingerprint("İ A b".encode()) == plain_print("İ a B")


def test_links_are_all_found(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum({1 << rng.randrange(64) for _ in range(k)}) for b in base for k in (0, 1, 2, 3, 3, 4)}
    signed = sorted(x - (1 << 64 if x >> 63 else 0) for x in prints)
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_lookups_are_not_broadcast(spark, tmp_path):
    """Each fingerprint makes 66 lookups, which Catalyst doesn't foresee; they never go through the driver."""
    spark.range(2000).select((F.col("id") * 7_919_000_003).alias("fp")).write.parquet(f"{tmp_path}/f")
    plan = links(spark.read.parquet(f"{tmp_path}/f"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(700, 700), (559, 900)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != v}
    assert roots(spark.createDataFrame([], "a long, b long")).collect() == []
