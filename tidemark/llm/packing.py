"""Cost-balanced packing of token sequences (operator 7)."""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Weights of the estimated attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A task packs its documents in groups; a group is closed at so many tokens.
GROUP_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, size: int) -> list[int]:
    """Lengths of the sequences for `total` tokens: full ones, and powers of two for the rest, so that nothing is padded."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Yields (document, start, length, sequence, offset), for documents of the given numbers of tokens.

    A document's full multiples of `size` are sequences by themselves. What is left of the documents goes, in descending
    order of cost, to the sequence of the lowest cost that has room; a piece that is longer than the room is cut, and
    its rest is dealt in the same way.
    """
    sequence = 0
    rests = []
    for i, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            yield i, start, size, sequence, 0
            sequence += 1
        if n % size:
            rests.append((i, n - n % size, n % size))
    rooms = capacities(sum(r[2] for r in rests), size)
    # A short sequence begins with the cost that it will never have, so that it fills last.
    heap = [(LINEAR * (size - room) + QUADRATIC * (size - room) ** 2, k, room) for k, room in enumerate(rooms)]
    heapq.heapify(heap)
    for i, start, n in sorted(rests, key=lambda r: (-r[2], r[0])):
        while n:
            cost, k, room = heapq.heappop(heap)
            take = min(n, room)
            yield i, start, take, sequence + k, rooms[k] - room
            if room > take:
                heapq.heappush(heap, (cost + LINEAR * take + QUADRATIC * take * take, k, room - take))
            start, n = start + take, n - take


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """An encoder with the ids that the tokenizers library gives for the byte-level BPE file at `path`; a worker keeps it.

    The ranks of the same vocabulary, which lie beside it, let tiktoken make the same ids several times faster. Texts with
    the string of a special token are left to the tokenizers library, which is loaded when the first of them comes.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(slow().encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t), dtype="<u4") for t in texts]

    return encode


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packs every document of `docs` (doc_id, text) into sequences of at most `size` tokens; returns a row per piece.

    A document's ids are those of its text (null: empty text) and `end`. Each task packs the rows that it reads, group by
    group, so nothing is shuffled and a task holds one group's ids at a time (or one document's, if that is longer).
    Sequences that aren't full have a length that is a power of two: no token is padding. sequence_id is unique over all
    tasks: the task's number times 2^33, plus a counter. ids_crc32 is the CRC-32 of the piece's ids as little-endian
    unsigned 32-bit numbers.

    Null text: a document of one token. Null doc_id: kept, with a null doc_id in its pieces. Rows that repeat are packed
    each by itself. Equal costs go to the smaller sequence, equal lengths to the earlier row. No rows: no pieces. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_bpe(tokenizer)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = used = 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            lengths = [len(x) for x in ids]
            rows = list(assign(lengths, size))
            out = [
                [keys[i] for i, *_ in rows],
                [r[1] for r in rows],
                [r[2] for r in rows],
                [zlib.crc32(ids[i][s : s + n]) for i, s, n, _, _ in rows],
                [lengths[r[0]] for r in rows],
                [task + used + r[3] for r in rows],
                [r[4] for r in rows],
            ]
            used += 1 + max(r[3] for r in rows)
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for key, one in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    keys.append(key)
                    ids.append(np.append(one, np.uint32(end)).astype("<u4"))
                    held += len(ids[-1])
                if held >= group_tokens:
                    yield flush()
                    ids.clear()
                    keys.clear()
                    held = 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
