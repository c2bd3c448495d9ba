"""Near-duplicates by SimHash and multi-index hashing (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.components import roots

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text: ASCII lower case, shingles of `words` words, XXH64 with SEED; bit set if in over half the hashes."""
    own = (text or b"").lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(own) - words + 1)
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints `classes` (fp) that differ in at most `distance` bits.

    Multi-index hashing with two segments of 32 bits: of a pair, one segment differs in distance // 2 bits at most. Each
    fingerprint is filed under both segments, and looks up every value in the Hamming ball of that radius around its own
    two; of the matches, whole fingerprints are compared. Catalyst takes exploded rows to be as few as those before, so without
    a hint it would broadcast all lookups, 66 for a fingerprint, through the driver.
    """
    radius = distance // 2
    balls = [0]
    for _ in range(radius):
        balls = sorted({b ^ bit for b in balls for bit in [0, *(1 << k for k in range(32))]})
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")), F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(low).alias("value")))
    filed = classes.select("fp", F.explode(halves).alias("h")).select("fp", "h.part", "h.value")
    ball = F.array(*[F.lit(b).cast("long") for b in balls])
    asked = filed.select(F.col("fp").alias("a"), "part", "value", F.explode(ball).alias("flip")).select("a", "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    near = asked.hint("merge").join(filed.hint("merge"), ["part", "value"]).where((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance))
    return near.select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id of each row of `docs` (doc_id, text).

    Rows with the same fingerprint are one class; only classes are compared, so a large group of copies is one
    fingerprint. Classes link at `distance` differing bits or fewer; component_id is the smallest doc_id that can be
    reached. Joins back to the rows are keyed by the fingerprint; AQE splits the partition of a very frequent one.

    Null or empty text (no words): fingerprint zero, linked like any other. Fewer words than a shingle: the whole
    sequence is hashed. Null doc_id: kept, never a component_id unless no other id is in reach (then null). Repeated rows
    are returned as often as they come. No rows: no rows. Other columns are ignored.
    """
    prints = written(fingerprints(docs, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = roots(links(classes.select("fp"), distance))
    linked = found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    reach = classes.join(linked, F.col("fp") == F.col("node"))
    smallest = reach.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = written(reach.join(smallest, "root").select("fp", F.col("component_id").alias("reached"), F.lit(True).alias("in_link")))
    whole = classes.join(joined, "fp", "left").select("fp", F.when(F.col("in_link"), F.col("reached")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")
